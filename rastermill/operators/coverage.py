"""Coverage and catalogue size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastermill.functions.geo import area_km2, area_km2_metres


def coverage_by_collection(items: DataFrame, order: str = "seq", degrees_aware: bool = False) -> DataFrame:
    """Items, distinct footprints and km² per collection.

    Footprints are boxes rounded half-even to 1000; the first box of a
    footprint (by ``order``) gives its area. ``degrees_aware`` measures boxes
    that look like degrees as degrees instead of metres; those footprints are
    told apart to three decimals.
    """
    box = [F.col(c) for c in ("bbox_west", "bbox_south", "bbox_east", "bbox_north")]
    area = area_km2(*box) if degrees_aware else area_km2_metres(*box)

    def rounded(c):
        metric = F.bround(c, -3)
        if not degrees_aware:
            return metric
        return F.when((F.abs(box[0]) > 1000) | (F.abs(box[2]) > 1000), metric).otherwise(F.bround(c, 3))

    keyed = items.select("collection", order, area.alias("_area"), *[rounded(c).alias(f"_k{i}") for i, c in enumerate(box)])
    footprints = keyed.groupBy("collection", "_k0", "_k1", "_k2", "_k3").agg(
        F.count(F.lit(1)).alias("_n"), F.min_by("_area", order).alias("_area")
    )
    return footprints.groupBy("collection").agg(
        F.sum("_n").alias("items"),
        F.count(F.lit(1)).alias("tiles"),
        F.bround(F.sum("_area"), 0).cast("bigint").alias("area_km2"),
    )


def sensors_only(coverage: DataFrame) -> DataFrame:
    """Coverage of collections that are not derived, with the total beside each row."""
    kept = coverage.filter(~F.contains("collection", F.lit("_derived")))
    return kept.withColumn("total_area_km2", kept.agg(F.sum("area_km2")).scalar())


def item_count(items: DataFrame, by_collection: bool = False) -> DataFrame:
    groups = ["collection"] if by_collection else []
    return items.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))


def catalog_summary(items: DataFrame, collections: DataFrame) -> DataFrame:
    """One row: ids of the collections table, number of items, total km², coverage per collection that has items."""
    covered = coverage_by_collection(items).agg(
        F.coalesce(F.sum("items"), F.lit(0)).alias("item_count"),
        F.coalesce(F.sum("area_km2"), F.lit(0)).alias("total_area_km2"),
        F.sort_array(F.collect_list(F.struct("collection", "items", "tiles", "area_km2"))).alias("coverage"),
    )
    ids = collections.agg(F.sort_array(F.collect_list("id")).alias("x")).scalar()
    return covered.select(ids.alias("collections"), "item_count", "total_area_km2", "coverage")


def km2_queried(access: DataFrame) -> DataFrame:
    """Searches with an area and the km² they asked for; unreadable areas count as requests only."""
    parts = F.split("query_bbox", ",")
    numbers = F.transform(parts, lambda p: F.trim(p).try_cast("double"))
    readable = (F.size(numbers) == 4) & ~F.exists(numbers, lambda v: v.isNull())
    w, s, e, n = (F.get(numbers, F.lit(k)) for k in range(4))
    asked = access.filter(F.col("query_bbox") != "")
    return asked.agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.coalesce(F.bround(F.sum(F.when(readable, area_km2(w, s, e, n))), 0), F.lit(0)).cast("bigint").alias("total_km2"),
    )
