"""Keep one row per key without gathering the key's rows in one place.

``min_by``/``max_by`` combine on the map side, so a key that owns a large
share of the input costs one partial row per task instead of one big group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: list[str], order: list[Column], chooser) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    chosen = chooser(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(chosen).select(*keys, "_row.*").select(*df.columns)


def first_per_key(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """Row with the smallest ``order`` tuple per key."""
    return _pick(df, keys, [F.col(o) if isinstance(o, str) else o for o in order], F.min_by)


def last_per_key(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """Row with the largest ``order`` tuple per key."""
    return _pick(df, keys, [F.col(o) if isinstance(o, str) else o for o in order], F.max_by)
