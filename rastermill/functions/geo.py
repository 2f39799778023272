"""Areas and coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: kilometres per degree of latitude.
KM_PER_DEGREE = 111.32


def area_km2_metres(w: Column, s: Column, e: Column, n: Column) -> Column:
    return F.abs((e - w) * (n - s)) / F.lit(1e6)


def area_km2_degrees(w: Column, s: Column, e: Column, n: Column) -> Column:
    lon = F.lit(KM_PER_DEGREE) * F.cos(F.radians((n + s) / 2))
    return F.abs((e - w) * lon * (n - s) * F.lit(KM_PER_DEGREE))


def area_km2(w: Column, s: Column, e: Column, n: Column) -> Column:
    """Metres when the eastings are too large to be degrees, degrees otherwise."""
    projected = (F.abs(w) > 1000) | (F.abs(e) > 1000)
    return F.when(projected, area_km2_metres(w, s, e, n)).otherwise(area_km2_degrees(w, s, e, n))


def pixel_centre(west: Column, east: Column, width: Column, x: Column) -> Column:
    return west + (x + F.lit(0.5)) * (east - west) / width


def pixel_middle(north: Column, south: Column, height: Column, y: Column) -> Column:
    return north - (y + F.lit(0.5)) * (north - south) / height
