"""Risk level expressions (R8 engine bands, V5 map bands)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from riskflow.params import LEVEL_LOW_MAX, LEVEL_MEDIUM_MAX


def risk_level(score: Column | str, low_max: float = LEVEL_LOW_MAX, medium_max: float = LEVEL_MEDIUM_MAX) -> Column:
    """Low [0, low_max), medium [low_max, medium_max), high otherwise (left-closed). NULL and NaN have no level."""
    s = known(score)
    return (F.when(s.isNull(), F.lit(None).cast("string"))
             .when((s >= 0) & (s < low_max), "low")
             .when((s >= low_max) & (s < medium_max), "medium")
             .otherwise("high"))


def map_band(score: Column | str, low_max: float = LEVEL_LOW_MAX, medium_max: float = LEVEL_MEDIUM_MAX) -> Column:
    """V5: right-closed bands of the map, (-inf..low_max] Low, (low_max, medium_max] Medium, above High.

    Scores outside [0, 1.01] fall outside the map's bins and get NULL.
    """
    s = F.col(score) if isinstance(score, str) else score
    return (F.when((s >= 0) & (s <= low_max), "Low")
             .when((s > low_max) & (s <= medium_max), "Medium")
             .when((s > medium_max) & (s <= 1.01), "High"))


def known(c: Column | str) -> Column:
    """A number as double; NaN is missing, as NULL is."""
    x = F.col(f"`{c}`") if isinstance(c, str) else c
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def clip01(c: Column | str) -> Column:
    """Clipped to [0, 1]; a missing number stays NULL (`least` and `greatest` alone would skip it)."""
    x = known(c)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
