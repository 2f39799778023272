"""Join a large frame with a one-row-per-key lookup when few keys may own most rows.

Adaptive execution splits a crowded partition only when both join sides come
straight from a shuffle. A lookup that was itself grouped by the key does not:
it is already dealt by it. Such a lookup is therefore dealt out evenly first,
so that the join deals it by the key once more and may then split the crowded
keys of the large side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 64


def lookup_join(left: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Left join of ``left`` with ``lookup`` (unique ``key``); rows with a null key find nothing."""
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.join(lookup.repartition(parts), key, "left")


def salted_join(left: DataFrame, lookup: DataFrame, key: str, spread: str) -> DataFrame:
    """Inner join with a lookup that has few keys, each of which may own a large share of ``left``.

    Every key's rows are spread over ``SALTS`` parts by the column ``spread``
    and meet a copy of the lookup row there; the lookup grows by that factor.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [key, "_salt"]).drop("_salt")
