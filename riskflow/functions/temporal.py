"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from riskflow.functions.time_formats import parse

PARTS = ("year", "month", "dayofweek", "hour", "quarter")

def parse_time(c: str, fmt: str | None) -> Column:
    """A column as a timestamp: native time columns as they are, text with the fitted format (`time_formats`)."""
    if fmt is None:
        return F.col(f"`{c}`")
    return parse(F.col(f"`{c}`"), fmt)


def calendar_parts(ts: Column, prefix: str) -> dict[str, Column]:
    """<c>_year, _month, _dayofweek (Monday = 0: `weekday`, not `dayofweek`), _hour, _quarter."""
    return {
        f"{prefix}_year": F.year(ts),
        f"{prefix}_month": F.month(ts),
        f"{prefix}_dayofweek": F.weekday(ts),
        f"{prefix}_hour": F.hour(ts),
        f"{prefix}_quarter": F.quarter(ts),
    }
