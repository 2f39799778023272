"""Hash-addressed chunks: availability, integrity, synchronisation and eviction.

Chunk references may be very uneven (one empty tile can be referenced by a
large share of all items). References are therefore joined to one narrow row
per hash, computed before the join, and no reference list is gathered per
hash. All joins come straight from a shuffle on both sides, where adaptive
execution splits the crowded partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastermill.functions.times import moment
from rastermill.operators.search import batch_bbox_search, open_period
from rastermill.plans.lookup import lookup_join
from rastermill.plans.ordered import running_sum
from rastermill.sources.sinks import content_hash

# Band name of all-band chunks, layout and tile edge where an item names none.
ALL_BANDS, LEGACY, TILE_SIZE = "*", "legacy", 512
MIB = 1024 * 1024
GIB = 1024**3


def chunk_refs(items: DataFrame) -> DataFrame:
    """(item_id, band, idx, sha) from the ``chunk_hashes`` map of each item."""
    by_band = items.select("item_id", F.explode("chunk_hashes").alias("band", "hashes"))
    return by_band.select("item_id", "band", F.posexplode("hashes").alias("idx", "sha"))


def chunk_availability(refs: DataFrame, store: DataFrame) -> DataFrame:
    """References with a flag telling whether the chunk is stored (a store has one row per hash).

    One outer join, whose crowded hashes adaptive execution can split, as both sides come straight from a shuffle.
    """
    held = store.select("sha", F.lit(True).alias("_held"))
    return refs.join(held, "sha", "left").withColumn("local", F.coalesce("_held", F.lit(False))).drop("_held")


def missing_chunks(refs: DataFrame, store: DataFrame) -> DataFrame:
    return refs.join(store.select("sha"), "sha", "left_anti")


def has_chunk(shas: DataFrame, store: DataFrame) -> DataFrame:
    return shas.join(store.select("sha"), "sha", "left_semi")


def delete_chunks(store: DataFrame, shas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Store without the given hashes, and per hash whether it existed."""
    asked = shas.select("sha").distinct()
    return store.join(asked, "sha", "left_anti"), chunk_availability(asked, store).withColumnRenamed("local", "existed")


def items_needed(missing: DataFrame) -> DataFrame:
    """Chunks to fetch per item."""
    return missing.groupBy("item_id").agg(F.count(F.lit(1)).alias("chunk_count"))


def orphan_chunks(store: DataFrame, refs: DataFrame) -> DataFrame:
    """Stored chunks that no item refers to."""
    return store.join(refs.select("sha").distinct(), "sha", "left_anti")


def orphan_summary(orphans: DataFrame) -> DataFrame:
    size = F.coalesce(F.sum("bytes"), F.lit(0))
    return orphans.agg(
        F.count(F.lit(1)).alias("orphaned_chunks"), size.alias("orphaned_bytes"), F.bround(size / MIB, 1).alias("orphaned_mb")
    )


def verify_items(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per item: chunks in total, valid, corrupted and missing, and ``OK`` or ``FAILED``.

    Hashes are recomputed where the bytes are; only (sha, valid) is shuffled.
    """
    checked = chunks.select("sha", (content_hash() == F.col("sha")).alias("valid"))
    checked = checked.groupBy("sha").agg(F.bool_and("valid").alias("valid"))
    return (
        lookup_join(refs, checked, "sha").groupBy("item_id")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("valid")).alias("valid"),
            F.count_if(~F.col("valid")).alias("corrupted"),
            F.count_if(F.col("valid").isNull()).alias("missing"),
        )
        .withColumn("integrity", F.when(F.col("corrupted") + F.col("missing") == 0, "OK").otherwise("FAILED"))
    )


def verify_summary(verified: DataFrame, by: str = "collection") -> DataFrame:
    return verified.groupBy(by).agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(F.col("integrity") == "OK").alias("items_ok"),
        *[F.sum(c).alias(c) for c in ("total", "valid", "corrupted", "missing")],
    )


def store_stats(chunks: DataFrame, limit_gb: float = 0) -> DataFrame:
    """One row: chunk count, bytes, gigabytes, percent of the limit."""
    size = F.coalesce(F.sum("bytes"), F.lit(0))
    used = F.bround(size / F.lit(limit_gb * GIB) * 100, 1) if limit_gb > 0 else F.lit(0.0)
    return chunks.agg(
        F.count(F.lit(1)).alias("chunk_count"), size.alias("total_bytes"), F.bround(size / GIB, 2).alias("used_gb"), used.alias("used_pct")
    )


def evict_oldest(chunks: DataFrame, target_bytes: int) -> DataFrame:
    """Oldest chunks (by mtime, sha) to delete until at most ``target_bytes`` remain."""
    return _evict(chunks, ["mtime", "sha"], target_bytes)


def _evict(chunks: DataFrame, order: list[str], target_bytes: int, total: DataFrame | None = None) -> DataFrame:
    excess = (total or chunks).agg((F.coalesce(F.sum("bytes"), F.lit(0)) - F.lit(target_bytes)).alias("x")).scalar()
    running = running_sum(chunks, [F.col(c) for c in order], "bytes", "_running")
    # a chunk goes while the bytes freed before it do not suffice
    return running.filter(F.col("_running") - F.col("bytes") < excess).drop("_running")


def evict_safe(
    chunks: DataFrame, placements: DataFrame, log: DataFrame, target_bytes: int, now: str, hot_days: int = 7
) -> DataFrame:
    """Like ``evict_oldest`` but never a sole copy.

    Order: idle chunks with three or more copies, idle chunks with two, then
    chunks used in the last ``hot_days``; oldest first inside each step.
    """
    copies = placements.groupBy("sha").agg(F.countDistinct("node").alias("copies"))
    used = log.filter(F.col("ts") > moment(now, hot_days * 24)).select("sha").distinct().withColumn("hot", F.lit(True))
    ranked = (
        chunks.join(copies, "sha", "left").join(used, "sha", "left").filter(F.coalesce("copies", F.lit(1)) > 1)
        .withColumn("step", F.when(F.col("hot"), 2).when(F.col("copies") == 2, 1).otherwise(0))
        .select("sha", "bytes", "mtime", "copies", "step")
    )
    return _evict(ranked, ["step", "mtime", "sha"], target_bytes, total=chunks)


def sync_plan(
    local_items: DataFrame, store: DataFrame, remote_items: DataFrame, remote_refs: DataFrame,
    collections: list[str] | None = None, max_items: int = 0,
) -> DataFrame:
    """Per remote collection what a sync would do.

    Columns: collection, new_collection, items, chunks_missing,
    chunks_skipped. Items that are known and complete are skipped with all
    their chunks. ``max_items`` stops after that many incomplete items in
    (collection, id) order; items after the stop count nowhere, but their
    collections keep a row.
    """
    if collections:
        remote_items = remote_items.filter(F.col("collection").isin(list(collections)))
    counts = chunk_availability(remote_refs, store).groupBy("item_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("local")).alias("missing")
    )
    known = local_items.select(F.col("id")).distinct().withColumn("known", F.lit(True))
    state = (
        remote_items.select("id", "collection").join(counts.withColumnRenamed("item_id", "id"), "id", "left")
        .join(known, "id", "left").fillna(0, ["total", "missing"])
        .withColumn("complete", F.coalesce("known", F.lit(False)) & (F.col("missing") == 0))
    )
    if max_items:
        chosen = state.filter(~F.col("complete")).orderBy("collection", "id").limit(max_items)
        stop = chosen.agg(
            F.when(F.count(F.lit(1)) == max_items, F.max(F.struct("collection", "id"))).alias("stop")
        ).scalar()
        state = state.withColumn("_stop", stop)
        reached = F.coalesce(F.struct("collection", "id") <= F.col("_stop"), F.lit(True))
        state = state.withColumns({c: F.when(reached, F.col(c)).otherwise(0) for c in ("total", "missing")})
        state = state.withColumn("complete", F.col("complete") | ~reached).drop("_stop")
    held = local_items.select("collection").distinct().withColumn("held", F.lit(True))
    todo = ~F.col("complete")
    return (
        state.groupBy("collection")
        .agg(
            F.count_if(todo).alias("items"),
            F.coalesce(F.sum(F.when(todo, F.col("missing"))), F.lit(0)).alias("chunks_missing"),
            F.sum(F.when(todo, F.col("total") - F.col("missing")).otherwise(F.col("total"))).alias("chunks_skipped"),
        )
        .join(held, "collection", "left")
        .select("collection", F.col("held").isNull().alias("new_collection"), "items", "chunks_missing", "chunks_skipped")
    )


def sync_apply(
    local_items: DataFrame, local_chunks: DataFrame, remote_items: DataFrame, remote_refs: DataFrame, remote_chunks: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items, chunks and errors after pulling everything the remote side has.

    A chunk is copied only if the recomputed hash of one of its copies matches;
    it is an error only if none does. An incomplete or unknown item replaces the
    local one. Copies that nobody asked for are left out before they are hashed.
    """
    lacking = missing_chunks(remote_refs, local_chunks)
    wanted = lacking.select("sha").distinct()
    offered = remote_chunks.select("sha", "data").join(wanted, "sha", "left_semi").withColumn("valid", content_hash() == F.col("sha"))
    chunks = local_chunks.select("sha", "data").unionByName(offered.filter("valid").drop("valid").dropDuplicates(["sha"]))
    verdicts = offered.groupBy("sha").agg(F.bool_or("valid").alias("valid"))
    answered = wanted.join(verdicts, "sha", "left")
    errors = answered.filter(~F.coalesce("valid", F.lit(False))).select(
        "sha", F.when(F.col("valid").isNull(), "not found").otherwise("hash mismatch").alias("error")
    )
    incomplete = lacking.select(F.col("item_id").alias("id")).distinct()
    new_or_open = remote_items.join(local_items.select("id"), "id", "left_anti").unionByName(
        remote_items.join(local_items.select("id"), "id", "left_semi").join(incomplete, "id", "left_semi")
    )
    items = local_items.join(new_or_open.select("id"), "id", "left_anti").unionByName(new_or_open)
    return items, chunks, errors


def chunk_map(refs: DataFrame, placements: DataFrame, bands: list[str] | None = None) -> DataFrame:
    """References with the nodes that hold each chunk (at most one entry per node of the network).

    ``bands`` chooses among per-band chunks; chunks of all bands (``*``) always stay.
    """
    if bands:
        refs = refs.filter(F.col("band").isin(ALL_BANDS, *bands))
    holders = placements.groupBy("sha").agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    return lookup_join(refs, holders, "sha").withColumn("nodes", F.coalesce("nodes", F.array().cast("array<bigint>")))


def chunk_grid(items: DataFrame, bands: list[str] | None = None) -> DataFrame:
    """What a client needs to put an item's chunks together again, one row per item.

    ``items``: item_id, collection, ``properties`` as the readers decode them, and
    ``chunk_hashes``. ``total_chunks`` counts what ``chunk_map`` lists for the same ``bands``.
    """
    chosen = F.col("chunk_hashes")
    if bands:
        chosen = F.map_filter(chosen, lambda band, _: band.isin(ALL_BANDS, *bands))
    total = F.aggregate(F.map_values(chosen), F.lit(0), lambda n, hashes: n + F.size(hashes))
    p = F.col("properties")
    return items.select(
        "item_id", "collection", F.coalesce(p["chunk_format"], F.lit(LEGACY)).alias("format"),
        F.coalesce(p["tile_size"], F.lit(TILE_SIZE)).alias("tile_size"), F.coalesce(p["tile_cols"], F.lit(1)).alias("tile_cols"),
        F.coalesce(p["tile_rows"], F.lit(1)).alias("tile_rows"), p["width"].alias("width"), p["height"].alias("height"),
        p["dtype"].alias("dtype"), p["crs"].alias("crs"),
        F.coalesce(p["band_names"], F.array().cast("array<string>")).alias("bands"), F.coalesce(total, F.lit(0)).alias("total_chunks"),
    )


def validate_report(requests: DataFrame, items: DataFrame, refs: DataFrame, store: DataFrame) -> DataFrame:
    """Dry run: stored and missing chunks per request.

    Chunk counts are made once per item and travel with the item through the
    area join, so a popular item is never looked up again.
    """
    requests = open_period(requests)
    per_item = chunk_availability(refs, store).groupBy("item_id").agg(
        F.count_if(F.col("local")).alias("l"), F.count_if(~F.col("local")).alias("m")
    )
    counted_items = items.join(per_item.withColumnRenamed("item_id", "id"), "id")
    hits = batch_bbox_search(requests, counted_items, same_collection=True, carry=("l", "m"))
    hits = hits.filter((F.col("datetime") >= F.col("date_from")) & (F.col("datetime") <= F.col("date_to")))
    counted = hits.groupBy("request_id").agg(F.sum("l").alias("local_chunks"), F.sum("m").alias("missing_chunks"))
    return (
        requests.select("request_id").join(counted, "request_id", "left").fillna(0, ["local_chunks", "missing_chunks"])
        .withColumn("needs_download", F.col("missing_chunks") > 0)
    )
