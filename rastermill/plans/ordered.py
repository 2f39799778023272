"""Running values over long orderings, without a single-partition window.

Two shapes are used:

* a *global* running sum: range-partition on the full order, add up each
  partition, carry the partition totals forward. Only one row per partition
  meets in the carry step. The range-partitioned frame is checkpointed so the
  totals and the rows agree on the partitioning even after an executor loss.
* *per key* running values over slices: a key that owns most rows is cut at
  fixed slice borders taken from the data (an hour, a block of sequence
  numbers); slices are summarised, carried, and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastermill.functions.numbers import floor_div
from rastermill.session import pin


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running_sum(df: DataFrame, order: list[Column], value: str, out: str, partitions: int | None = None) -> DataFrame:
    """Add ``out`` = sum of ``value`` over all rows up to and including this one.

    ``order`` must end in a unique column, which also lets the range
    partitioner split rows that tie on the leading columns.
    """
    count = partitions or _partitions(df)
    ranged = pin(df.repartitionByRange(count, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # at most `count` rows, one per range partition: bounded by configuration
    carried = (
        ranged.groupBy("_part")
        .agg(F.sum(value).alias("_total"))
        .select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_carry"))
    )
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ranged.join(F.broadcast(carried), "_part")
        .withColumn(out, F.sum(value).over(within) + F.col("_carry"))
        .drop("_part", "_carry")
    )


def global_row_number(df: DataFrame, order: list[Column], out: str, partitions: int | None = None) -> DataFrame:
    """1-based position of each row in the global order."""
    return running_sum(df.withColumn("_one", F.lit(1).cast("bigint")), order, "_one", out, partitions).drop("_one")


def carried_max(df: DataFrame, keys: list[str], slice_col: str, order: list[str], value: Column, out: str) -> DataFrame:
    """Largest non-null ``value`` among the rows of ``keys`` strictly before this one.

    ``slice_col`` must be non-decreasing in ``order`` within a key.
    """
    marked = df.withColumn("_v", value)
    rows_before = Window.partitionBy(*keys, slice_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    slices_before = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        marked.groupBy(*keys, slice_col)
        .agg(F.max("_v").alias("_m"))
        .select(*keys, slice_col, F.max("_m").over(slices_before).alias("_carry"))
    )
    return (
        marked.withColumn("_in", F.max("_v").over(rows_before))
        .join(carried, [*keys, slice_col])
        # greatest() ignores nulls
        .withColumn(out, F.greatest("_in", "_carry"))
        .drop("_v", "_in", "_carry")
    )


def trailing_counts(
    df: DataFrame, key: str, micros: str, windows_s: tuple[int, ...], names: tuple[str, ...], slice_s: int | None = None
) -> DataFrame:
    """Rows of the same key in the trailing ``w`` seconds (both ends included), this row counted.

    Rows of one instant are counted first, on the map side. A key's timeline is
    then cut into slices of ``slice_s`` seconds; each instant is also copied
    into the next slices its window reaches, so every slice is counted on its
    own and holds at most two slices' worth of distinct instants, however many
    rows there are. An instant leaves a mark where each of its windows begins,
    in front of the rows there; one running count along instants and marks tells
    what a window holds, so the work follows the instants and not what their
    windows hold. The counts are joined back to the rows.
    """
    widest = max(windows_s)
    width = max(slice_s or widest, widest) * 1_000_000
    own, reach = floor_div(micros, width), floor_div(F.col(micros) + F.lit(widest * 1_000_000), width)
    instants = df.groupBy(key, micros).agg(F.count(F.lit(1)).alias("_n"))
    sliced = instants.withColumn("_own", own).withColumn("_slice", F.explode(F.sequence(F.col("_own"), reach)))
    at_home, none, itself = F.col("_own") == F.col("_slice"), F.lit(0).cast("bigint"), len(windows_s)
    step = lambda at, kind, n: F.struct(at.alias("_at"), F.lit(kind).alias("_kind"), n.alias("_add"))
    instant = step(F.col(micros), itself, F.col("_n"))
    begins = [step(F.col(micros) - F.lit(seconds * 1_000_000), k, none) for k, seconds in enumerate(windows_s)]
    # marks are made where the slice is counted, so they do not travel
    steps = F.inline(F.when(at_home, F.array(instant, *begins)).otherwise(F.array(instant)))
    steps = sliced.repartition(key, "_slice").select(key, "_slice", micros, at_home.alias("_home"), steps)
    upto = Window.partitionBy(key, "_slice").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = steps.withColumn("_upto", F.sum("_add").over(upto)).filter("_home")
    of_kind = lambda kind: F.sum(F.when(F.col("_kind") == kind, F.col("_upto")))
    held = [(of_kind(itself) - of_kind(k)).alias(name) for k, name in enumerate(names)]
    counted = counted.groupBy(key, "_slice", micros).agg(*held).select(F.col(key).alias("_k"), F.col(micros).alias("_t"), *names)
    return df.join(counted, df[key].eqNullSafe(F.col("_k")) & (df[micros] == F.col("_t"))).drop("_k", "_t")
