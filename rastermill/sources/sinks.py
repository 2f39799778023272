"""Writers and the row-level decisions made before a write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rastermill.functions.times import moment
from rastermill.plans.ordered import running_sum
from rastermill.plans.pick import first_per_key, last_per_key
from rastermill.session import pin
from rastermill.sources.folders import folder_exists, folder_names, remove_folder

GIB = 1024**3
LICENCE = "EUPL-1.2"  # fixed value: licence of a collection that names none


def sink_items_upsert(
    stored: DataFrame, updates: DataFrame, collections: DataFrame | None = None, version: str = "version"
) -> tuple[DataFrame, DataFrame | None]:
    """Insert-or-replace by id; also the collections after the write.

    An update replaces the stored row, and the highest ``version`` wins among
    updates of one id. Stored rows are only filtered by an anti join, so a small
    set of updates does not move the catalogue.
    """
    newest = last_per_key(updates, ["id"], version)
    items = stored.join(newest.select("id"), "id", "left_anti").unionByName(newest)
    if collections is None:
        return items, None
    named = updates.select(F.col("collection").alias("id")).distinct()
    return items, collections.select("id").unionByName(named).distinct()


def content_hash(data: str | Column = "data") -> Column:
    return F.sha2(data, 256)


def sink_chunks_put(store: DataFrame, incoming: DataFrame, order: str | None = None) -> DataFrame:
    """New chunks among ``incoming`` (column ``data``): hashed, deduplicated, not yet in ``store``.

    Only the hash and the bytes travel; copies of the same content collapse on
    the map side before the shuffle.
    """
    hashed = incoming.withColumn("sha", content_hash())
    fresh = first_per_key(hashed, ["sha"], order) if order else hashed.dropDuplicates(["sha"])
    return fresh.join(store.select("sha"), "sha", "left_anti")


def write_chunks(new_chunks: DataFrame, path: str) -> None:
    """Append to the chunk table, one folder per leading hash byte.

    The rebalance hint lets adaptive execution cut or merge a folder's rows
    into even files instead of one file per task and folder.
    """
    prefixed = new_chunks.withColumn("prefix", F.substring("sha", 1, 2)).hint("rebalance", "prefix")
    prefixed.write.mode("append").partitionBy("prefix").parquet(path)


def sink_storage_limit(
    store: DataFrame, incoming: DataFrame, limit_bytes: int | Column, key: str = "sha", order: str = "seq"
) -> DataFrame:
    """Leading new chunks that fit: everything before the first chunk that would overflow the limit.

    ``limit_bytes`` of 0 means no limit; it may also be a scalar column. ``incoming`` needs ``key``, ``bytes``
    and the arrival ``order`` (unique).
    """
    first = first_per_key(incoming.select(key, "bytes", order), [key], order)
    fresh = first.join(store.select(key), key, "left_anti")
    if isinstance(limit_bytes, int) and limit_bytes <= 0:
        return fresh
    # The running total only grows, so "fits" is true on a prefix and the
    # first overflow ends it.
    used = store.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("used")).scalar()
    totals = running_sum(fresh, [F.col(order)], "bytes", "_running")
    return totals.filter(F.col("_running") + used <= limit_bytes).drop("_running")


def sink_retention(spark: SparkSession, path: str, now: str, retain_days: int = 90, day: str = "day") -> None:
    """Drop the rows of a log older than ``retain_days``, in place; the log is stored in one folder per ``day`` of its ``ts``.

    Folders of expired days go as a whole, and the day that the border cuts is rewritten. Other days are neither read nor
    touched, so the work follows what expires. Repeating it changes nothing more.
    """
    border = spark.range(1).select(moment(now, retain_days * 24)).first()[0]
    cut = str(border.date())
    for name in folder_names(spark, path):
        if name.startswith(f"{day}=") and name.removeprefix(f"{day}=") < cut:
            remove_folder(spark, f"{path}/{name}")
    if folder_exists(spark, f"{path}/{day}={cut}"):
        split = pin(spark.read.parquet(f"{path}/{day}={cut}").filter(F.col("ts") >= moment(now, retain_days * 24)).withColumn(day, F.lit(cut)))
        if split.isEmpty():
            remove_folder(spark, f"{path}/{day}={cut}")
        else:
            split.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def sink_volume_gate(store: DataFrame, incoming: DataFrame, max_gb: float) -> DataFrame:
    """All of ``incoming`` while the store is below ``max_gb``, nothing once it is not."""
    used_gb = store.agg((F.coalesce(F.sum("bytes"), F.lit(0)) / F.lit(GIB)).alias("gb")).scalar()
    return incoming.filter(used_gb < F.lit(float(max_gb)))


def to_stac(items: DataFrame, include_chunks: bool = False, prefix: str = "grid:") -> Column:
    """STAC Feature of an item row as JSON text.

    A stored ``geometry`` (JSON text or a struct) is kept; the box stands in where there is none.
    """
    have = set(items.columns)
    bbox = F.array("bbox_west", "bbox_south", "bbox_east", "bbox_north")
    ring = [("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"), ("west", "south")]
    corners = F.array(*[F.array(F.col(f"bbox_{x}"), F.col(f"bbox_{y}")) for x, y in ring])
    polygon = F.struct(F.lit("Polygon").alias("type"), F.array(corners).alias("coordinates"))
    geometry = _stored_geometry(items, polygon)
    properties = F.col("properties") if "properties" in have else F.struct(F.col("datetime"))
    if "other_properties" in have:  # as the readers decode them
        named = [(f if f == "datetime" else prefix + f, F.col(f"properties.{f}")) for f in items.schema["properties"].dataType.names]
        typed = F.create_map(*[c for name, value in named for c in (F.lit(name), value.cast("variant"))])
        others = F.coalesce("other_properties", F.create_map().cast("map<string,variant>"))
        properties = F.map_concat(F.map_filter(typed, lambda _, v: v.isNotNull()), others)
    assets = F.col("assets") if "assets" in have else F.create_map().cast("map<string,string>")
    if "assets" in have and isinstance(items.schema["assets"].dataType, T.StringType):
        assets = F.coalesce(F.try_parse_json("assets"), F.parse_json(F.lit("{}")))
    fields = [
        F.lit("Feature").alias("type"),
        F.lit("1.0.0").alias("stac_version"),
        F.col("id"),
        F.col("collection"),
        geometry.alias("geometry"),
        bbox.alias("bbox"),
        properties.alias("properties"),
        assets.alias("assets"),
        F.array().cast("array<string>").alias("links"),
    ]
    if include_chunks:
        fields.append(F.col("chunk_hashes").alias(prefix + "chunk_hashes"))
    return F.to_json(F.struct(*fields))


def _stored_geometry(items: DataFrame, polygon: Column) -> Column:
    if "geometry" not in items.columns:
        return polygon
    box = F.parse_json(F.to_json(polygon))
    text = F.col("geometry") if isinstance(items.schema["geometry"].dataType, T.StringType) else F.to_json("geometry")
    return F.coalesce(F.try_parse_json(text), box)


def sink_stac_json(items: DataFrame, include_chunks: bool = False, prefix: str = "grid:") -> DataFrame:
    return items.select("id", to_stac(items, include_chunks, prefix).alias("json"))


def collection_json(collections: DataFrame) -> DataFrame:
    """STAC Collection documents; a missing extent means the whole world, all times."""
    have = set(collections.columns)
    world = F.lit('{"spatial":{"bbox":[[-180,-90,180,90]]},"temporal":{"interval":[[null,null]]}}')
    title = F.col("title") if "title" in have else F.col("id")
    text = F.col("description") if "description" in have else F.concat(F.lit("Collection: "), F.col("id"))
    doc = F.struct(
        F.lit("Collection").alias("type"), F.lit("1.0.0").alias("stac_version"), F.col("id"), title.alias("title"),
        text.alias("description"), F.parse_json(F.col("extent") if "extent" in have else world).alias("extent"),
        F.array().cast("array<string>").alias("links"),
        (F.coalesce("license", F.lit(LICENCE)) if "license" in have else F.lit(LICENCE)).alias("license"),
    )
    return collections.select("id", F.to_json(doc).alias("json"))


def sink_replica_export(items: DataFrame, collection: str | None = None, prefix: str = "grid:") -> DataFrame:
    """Items of a collection with their chunk hashes, one JSON document per row."""
    chosen = items.filter(F.col("collection") == collection) if collection else items
    return sink_stac_json(chosen, include_chunks=True, prefix=prefix)


def write_json_documents(documents: DataFrame, path: str) -> None:
    documents.select("json").write.mode("overwrite").text(path)


def sink_result_raster(tiles: DataFrame, items: DataFrame, path: str) -> None:
    """Write result tiles with the georeference a raster file would carry, split by band."""
    georeference = items.select("item_id", "crs", "width", "height", "bbox_west", "bbox_south", "bbox_east", "bbox_north")
    located = tiles.join(georeference, "item_id").withColumns(
        {
            "pixel_width": (F.col("bbox_east") - F.col("bbox_west")) / F.col("width"),
            "pixel_height": (F.col("bbox_north") - F.col("bbox_south")) / F.col("height"),
        }
    )
    located.write.mode("overwrite").partitionBy("band").parquet(path)


def sink_audit_append(entries: DataFrame, path: str) -> None:
    entries.select("ts", "action", "detail", "ip", "ok").write.mode("append").json(path)
