"""Node registries, peers, users and work distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rastermill.functions.times import moment
from rastermill.operators.search import alive_nodes, alive_peers, search_bbox, search_collections, search_datetime
from rastermill.plans.ordered import global_row_number
from rastermill.plans.pick import first_per_key

# What a newer remote row may change, and what a new node starts with.
USER_UPDATES = ("role", "active", "updated_at")
NODE_FIELDS = ["node_name", "url", "collections", "item_count", "chunk_count", "chunks_bytes"]


def network_stats(nodes: DataFrame, peers: DataFrame, now_s: int) -> DataFrame:
    """One row of totals over alive nodes, plus how many nodes and peers exist."""
    alive = alive_nodes(nodes, now_s)
    held = alive.select(F.explode("collections").alias("c")).distinct().agg(F.sort_array(F.collect_list("c"))).scalar()
    return alive.agg(
        F.count(F.lit(1)).alias("nodes_alive"),
        F.coalesce(F.sum("item_count"), F.lit(0)).alias("total_items"),
        F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("total_chunks"),
        F.coalesce(F.sum("chunks_bytes"), F.lit(0)).alias("total_bytes"),
    ).withColumns(
        {
            "nodes_total": nodes.agg(F.count(F.lit(1))).scalar(),
            "collections": held,
            "peers": peers.agg(F.count(F.lit(1))).scalar(),
            "peers_alive": alive_peers(peers, now_s).agg(F.count(F.lit(1))).scalar(),
        }
    )


def redundancy_index(placements: DataFrame, approximate: bool = False) -> DataFrame:
    """Copies per distinct chunk. ``approximate`` trades exactness for a sketch."""
    distinct = F.approx_count_distinct("sha") if approximate else F.countDistinct("sha")
    return placements.agg(F.bround(F.count(F.lit(1)) / distinct, 2).alias("redundancy"), distinct.alias("chunks"))


def replica_histogram(placements: DataFrame, log: DataFrame, now: str, hot_per_day: int = 10, cold_days: int = 30) -> DataFrame:
    """Copies per chunk and its class: critical, hot, cold or normal."""
    copies = placements.groupBy("sha").agg(F.countDistinct("node").alias("copies"))
    use = log.groupBy("sha").agg(F.count_if(F.col("ts") > moment(now, 24)).alias("today"), F.max("ts").alias("last"))
    label = (
        F.when(F.col("copies") == 1, "critical")
        .when(F.col("today") > hot_per_day, "hot")
        .when(F.col("last").isNull() | (F.col("last") < moment(now, cold_days * 24)), "cold")
        .otherwise("normal")
    )
    return copies.join(use, "sha", "left").select("sha", "copies", label.alias("class"))


def gossip_merge(local: DataFrame, remote: DataFrame, now_s: int) -> DataFrame:
    """Registry after hearing from a peer: unknown nodes added, known ones refreshed.

    A field the peer leaves null keeps its local value; name and url of a known
    node are its own. ``merged`` marks the nodes that were new.
    """
    mine = local.select("node_id", F.struct(*[f for f in NODE_FIELDS], "last_seen_s").alias("l"))
    theirs = remote.filter(F.coalesce(F.col("node_id").cast("string"), F.lit("")) != "").select("node_id", F.struct(*NODE_FIELDS).alias("r"))
    both = mine.join(theirs, "node_id", "full_outer")
    known = F.col("l").isNotNull()

    def field(name: str):
        if name == "url":
            return F.when(known, F.col("l.url")).otherwise(F.col("r.url"))
        if name == "node_name":
            return F.when(known, F.col("l.node_name")).otherwise(F.coalesce("r.node_name", F.lit("")))
        empty = F.array().cast("array<string>") if name == "collections" else F.lit(0)
        return F.when(known, F.coalesce(f"r.{name}", f"l.{name}")).otherwise(F.coalesce(f"r.{name}", empty))

    return both.select(
        "node_id",
        *[field(f).alias(f) for f in NODE_FIELDS],
        F.when(F.col("r").isNotNull(), F.lit(now_s)).otherwise(F.col("l.last_seen_s")).cast("bigint").alias("last_seen_s"),
        (~known).alias("merged"),
    )


def discover_peers(known: DataFrame, remote: DataFrame, self_url: str | None = None) -> DataFrame:
    """Peer urls heard of for the first time."""
    tidy = F.rtrim(F.col("url"), F.lit("/"))
    heard = remote.select(tidy.alias("url")).filter(F.coalesce("url", F.lit("")) != "").distinct()
    if self_url:
        heard = heard.filter(F.col("url") != self_url)
    return heard.join(known.select(tidy.alias("url")), "url", "left_anti")


def user_merge(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Every local and remote user with ``action``: kept, added, updated or skipped.

    Both sides have user_id, username, updated_at and the same further columns.
    A newer remote row updates role, active and updated_at of a known user; an
    unknown user is added unless its name is taken, by a local user or by an
    earlier added one. Where users have an ``api_key`` it must be free as well; of
    remote users that claim the same name and those that claim the same key only
    the first by user_id may pass each test.
    """
    fields = [c for c in local.columns if c != "user_id"]
    mine = local.select("user_id", F.struct(*fields).alias("l"))
    theirs = remote.select("user_id", F.struct(*fields).alias("r"))
    both = mine.join(theirs, "user_id", "full_outer")
    known = both.filter(F.col("l").isNotNull())
    newer = F.col("r").isNotNull() & (F.col("r.updated_at") > F.col("l.updated_at"))

    def settled_field(name: str):
        mine = F.col(f"l.{name}")
        return (F.when(newer, F.col(f"r.{name}")).otherwise(mine) if name in USER_UPDATES else mine).alias(name)

    settled = known.select(
        "user_id",
        *[settled_field(f) for f in fields],
        F.when(newer, "updated").when(F.col("r").isNotNull(), "skipped").otherwise("kept").alias("action"),
    )
    unknown = both.filter(F.col("l").isNull()).select("user_id", "r.*")
    uniques = [c for c in ("username", "api_key") if c in fields]
    added = unknown
    for unique in uniques:
        added = added.join(local.select(unique), unique, "left_anti").select(*unknown.columns)
    for unique in uniques:
        claimed = added.filter(F.col(unique).isNotNull())
        # keys that are null collide with nothing
        added = first_per_key(claimed, [unique], "user_id").unionByName(added.filter(F.col(unique).isNull()))
    refused = unknown.join(added.select("user_id"), "user_id", "left_anti")
    return settled.unionByName(added.withColumn("action", F.lit("added"))).unionByName(
        refused.withColumn("action", F.lit("refused"))
    )


def merged_users(merge: DataFrame) -> DataFrame:
    """The registry after the merge."""
    return merge.filter(F.col("action") != "refused").drop("action")


def user_merge_counts(merge: DataFrame) -> DataFrame:
    return merge.agg(
        F.count_if(F.col("action") == "added").alias("added"),
        F.count_if(F.col("action") == "updated").alias("updated"),
        F.count_if(F.col("action").isin("skipped", "refused")).alias("skipped"),
    )


def _search_each(rows: DataFrame, rank: str, collections, bbox, datetime_range, limit: int | None) -> DataFrame:
    """One row per id from the first source; with ``limit`` the newest per source, newest first within a source."""
    found = search_datetime(search_bbox(search_collections(rows, collections), bbox), datetime_range)
    if limit is None:
        return first_per_key(found, ["id"], rank, F.col("datetime"))
    newest = Window.partitionBy(rank).orderBy(F.col("datetime").desc(), "id")
    listed = found.withColumn("_place", F.row_number().over(newest)).filter(F.col("_place") <= limit)
    unique = first_per_key(listed, ["id"], rank, "_place")
    return unique.orderBy(rank, "_place").limit(limit).drop("_place")


def routed_search(
    node_items: DataFrame, nodes: DataFrame, now_s: int, collections: list[str] | None = None,
    bbox: list[float] | None = None, datetime_range: str | None = None, limit: int | None = None,
    peer_items: DataFrame | None = None, peers: DataFrame | None = None,
) -> DataFrame:
    """Search on the alive, reachable nodes that hold one of the collections, then on alive peer registries.

    ``peer_items`` (with the column ``peer``, which gives their order) and ``peers``
    (``peer, url, last_seen_s``) are left out or given together. What peers find
    follows what nodes find; an id that a node found stays with the node. Rows of
    peers have no ``node_id`` and ``source_name``, rows of nodes no ``peer``.
    """
    chosen = alive_nodes(nodes, now_s).filter(F.coalesce("url", F.lit("")) != "")
    if collections:
        chosen = chosen.filter(F.arrays_overlap("collections", F.array(*[F.lit(c) for c in collections])))
    tagged = node_items.join(
        chosen.select("node_id", F.col("url").alias("source_node"), F.col("node_name").alias("source_name")), "node_id"
    )
    found = _search_each(tagged, "node_id", collections, bbox, datetime_range, limit)
    if peer_items is None:
        return found
    heard = peer_items.drop("node_id").join(alive_peers(peers, now_s).select("peer", F.col("url").alias("source_node")), "peer")
    more = _search_each(heard, "peer", collections, bbox, datetime_range, limit).join(found.select("id"), "id", "left_anti")
    both = found.unionByName(more, allowMissingColumns=True)
    if limit is None:
        return both
    # each side is already cut, and nodes that fill the limit leave no room
    return both.orderBy(F.col("node_id").asc_nulls_last(), "peer", F.col("datetime").desc(), "id").limit(limit)


def federated_search(
    peer_items: DataFrame, collections: list[str] | None = None, bbox: list[float] | None = None,
    datetime_range: str | None = None, limit: int | None = None,
) -> DataFrame:
    """Search on every peer (column ``peer`` gives their order)."""
    return _search_each(peer_items, "peer", collections, bbox, datetime_range, limit)


def swarm_assign(nodes: DataFrame, bands: DataFrame) -> DataFrame:
    """Deal bands (by ``position``) round-robin over nodes, best ``score`` first."""
    ranked = global_row_number(nodes.select("node_id", "score"), [F.col("score").desc(), F.col("node_id")], "_n")
    slots = ranked.select("node_id", (F.col("_n") - 1).alias("_slot"))
    dealt = global_row_number(bands.select("band", "position"), [F.col("position")], "_b")
    count = nodes.agg(F.count(F.lit(1))).scalar()
    return dealt.withColumn("_slot", (F.col("_b") - 1) % count).join(slots, "_slot").select("node_id", "band")


def notify_targets(new_items: DataFrame, nodes: DataFrame) -> DataFrame:
    """Reachable nodes with the notice they get: how many new items, and their span.

    Each node is sent the whole list once, so the result holds one row per
    node, not one per node and item.
    """
    reachable = nodes.filter((F.coalesce("url", F.lit("")) != "") & ~F.contains("url", F.lit("0.0.0.0")))
    notice = new_items.agg(
        F.struct(F.count(F.lit(1)).alias("items"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    ).scalar()
    return reachable.select("node_id", F.rtrim("url", F.lit("/")).alias("url"), notice.alias("_n")).select("node_id", "url", "_n.*")


