"""Geographic feature expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def geo_feature_columns(lat: str, lon: str) -> dict[str, Column]:
    """geo_lat_rad, geo_lon_rad, geo_distance_eq (sqrt(lat^2 + lon^2) in degrees) and geo_quadrant
    (2*[lat >= 0] + [lon >= 0], a missing coordinate counting as false)."""
    la, lo = F.col(f"`{lat}`").cast("double"), F.col(f"`{lon}`").cast("double")
    return {
        "geo_lat_rad": F.radians(la),
        "geo_lon_rad": F.radians(lo),
        "geo_distance_eq": F.sqrt(la * la + lo * lo),
        "geo_quadrant": (F.coalesce((la >= 0).cast("int"), F.lit(0)) * 2
                         + F.coalesce((lo >= 0).cast("int"), F.lit(0))),
    }
