"""Node registry, peer and user queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rastermill.fixtures import NOW, NOW_SECONDS, Inputs
from rastermill.operators import network
from rastermill.registry import query


def nodes_with_collections(i: Inputs):
    held = i.node_collections.groupBy("node_id").agg(F.sort_array(F.collect_set("collection")).alias("collections"))
    return i.nodes.join(held, "node_id")


def _peers(i: Inputs):
    return i.nodes.select("node_id", (F.col("last_seen_s") - F.col("node_id") % 3 * 100).alias("last_seen_s"))


@query("network_stats",
    f"""WITH a AS (SELECT * FROM nodes WHERE {NOW_SECONDS} - last_seen_s < 300)
        SELECT count(*) AS nodes_alive, (SELECT count(*) FROM nodes) AS nodes_total, CAST(sum(item_count) AS BIGINT) AS total_items,
               CAST(sum(chunk_count) AS BIGINT) AS total_chunks, CAST(sum(chunks_bytes) AS BIGINT) AS total_bytes,
               (SELECT list_sort(list(DISTINCT collection)) FROM node_collections WHERE node_id IN (SELECT node_id FROM a)) AS collections,
               (SELECT count(*) FROM nodes) AS peers,
               (SELECT count(*) FROM nodes WHERE {NOW_SECONDS} - last_seen_s + node_id % 3 * 100 < 600) AS peers_alive FROM a""",
    ("nodes", "node_collections"))
def _(i: Inputs):
    return network.network_stats(nodes_with_collections(i), _peers(i), NOW_SECONDS)


def _placements(i: Inputs):
    return i.placements.select(F.col("chunk_no").alias("sha"), F.col("node_no").alias("node"))


@query("redundancy_index",
    "SELECT round_even(count(*) / count(DISTINCT chunk_no)::DOUBLE, 2) AS redundancy, count(DISTINCT chunk_no) AS chunks FROM placements", ("placements",))
def _(i: Inputs):
    return network.redundancy_index(_placements(i))


@query("replica_histogram",
    """WITH c AS (SELECT chunk_no AS sha, count(DISTINCT node_no) AS copies FROM placements GROUP BY 1),
       u AS (SELECT chunk_no AS sha, count(*) FILTER (ts > TIMESTAMP '2024-01-30') AS today, max(ts) AS last FROM access_log GROUP BY 1)
       SELECT c.sha, copies, CASE WHEN copies = 1 THEN 'critical' WHEN today > 2 THEN 'hot' WHEN last IS NULL OR last < TIMESTAMP '2024-01-26' THEN 'cold'
              ELSE 'normal' END AS class FROM c LEFT JOIN u ON c.sha = u.sha""", ("placements", "access_log"))
def _(i: Inputs):
    log = i.access_log.withColumnRenamed("chunk_no", "sha")
    return network.replica_histogram(_placements(i), log, NOW, hot_per_day=2, cold_days=5)


def _gossip(i: Inputs):
    local = nodes_with_collections(i).filter("url IS NOT NULL")
    remote = nodes_with_collections(i).filter("chunks_bytes > 3000").withColumns(
        {
            "node_name": F.concat(F.lit("peer "), "node_name"),
            "item_count": F.when(F.col("node_id") % 4 == 0, None).otherwise(F.col("item_count") + 100),
            "collections": F.when(F.col("node_id") % 8 == 0, None).otherwise(F.array(F.lit("landsat-c2-l2"))),
        }
    )
    return local, remote


@query("gossip_merge",
    f"""WITH full_nodes AS (SELECT n.*, (SELECT list_sort(list(collection)) FROM node_collections c WHERE c.node_id = n.node_id) AS collections FROM nodes n),
        l AS (SELECT * FROM full_nodes WHERE url IS NOT NULL),
        r AS (SELECT node_id, concat('peer ', node_name) AS node_name, url, CASE WHEN node_id % 8 = 0 THEN NULL ELSE ['landsat-c2-l2'] END AS collections,
                     CASE WHEN node_id % 4 = 0 THEN NULL ELSE item_count + 100 END AS item_count, chunk_count, chunks_bytes FROM full_nodes WHERE chunks_bytes > 3000)
        SELECT coalesce(l.node_id, r.node_id) AS node_id, CASE WHEN l.node_id IS NULL THEN r.node_name ELSE l.node_name END AS node_name,
               CASE WHEN l.node_id IS NULL THEN r.url ELSE l.url END AS url, CASE WHEN l.node_id IS NULL THEN coalesce(r.collections, []) ELSE coalesce(r.collections, l.collections) END AS collections,
               CASE WHEN l.node_id IS NULL THEN coalesce(r.item_count, 0) ELSE coalesce(r.item_count, l.item_count) END AS item_count, coalesce(r.chunk_count, l.chunk_count) AS chunk_count,
               coalesce(r.chunks_bytes, l.chunks_bytes) AS chunks_bytes,
               CASE WHEN r.node_id IS NOT NULL THEN {NOW_SECONDS} ELSE l.last_seen_s END AS last_seen_s, l.node_id IS NULL AS merged
        FROM l FULL JOIN r ON l.node_id = r.node_id""", ("nodes", "node_collections"))
def _(i: Inputs):
    return network.gossip_merge(*_gossip(i), NOW_SECONDS)


@query("gossip_merge_count", "SELECT count(*) AS merged FROM nodes WHERE chunks_bytes > 3000 AND url IS NULL", ("nodes",))
def _(i: Inputs):
    return network.gossip_merge(*_gossip(i), NOW_SECONDS).agg(F.count_if(F.col("merged")).alias("merged"))


@query("discover_peers", "SELECT DISTINCT url FROM nodes WHERE url IS NOT NULL AND item_count <> 0 AND url <> 'n7'", ("nodes",))
def _(i: Inputs):
    known = i.nodes.filter("item_count = 0").select("url")
    remote = i.nodes.select(F.concat("url", F.lit("/")).alias("url"))
    return network.discover_peers(known, remote, "n7")


USERS = """act AS (SELECT coalesce(l.user_id, r.user_id) AS user_id, l.user_id AS lid, r.user_id AS rid, l.username AS lname, r.username AS rname,
                   l.updated_at AS lu, r.updated_at AS ru, l.active AS la, r.active AS ra FROM users_local l FULL JOIN users_remote r ON l.user_id = r.user_id),
   fresh AS (SELECT rid, row_number() OVER (PARTITION BY rname ORDER BY rid) AS rn FROM act WHERE lid IS NULL AND rname NOT IN (SELECT username FROM users_local)),
   merged AS (SELECT user_id, CASE WHEN lid IS NULL THEN rname ELSE lname END AS username, CASE WHEN lid IS NULL OR ru > lu THEN ru ELSE lu END AS updated_at,
                     CASE WHEN lid IS NULL OR ru > lu THEN ra ELSE la END AS active,
                     CASE WHEN lid IS NOT NULL AND ru > lu THEN 'updated' WHEN lid IS NOT NULL AND rid IS NOT NULL THEN 'skipped' WHEN lid IS NOT NULL THEN 'kept'
                          WHEN rid IN (SELECT rid FROM fresh WHERE rn = 1) THEN 'added' ELSE 'refused' END AS action FROM act)"""


@query("user_merge", f"WITH {USERS} SELECT user_id, username, updated_at, active FROM merged WHERE action <> 'refused'", ("users_local", "users_remote"))
def _(i: Inputs):
    return network.merged_users(network.user_merge(i.users_local, i.users_remote))


@query("user_merge_api_key",
    """WITH l AS (SELECT user_id, username, concat('key-', CAST(user_id % 97 AS VARCHAR)) AS api_key FROM users_local WHERE user_id % 97 < 40),
        r AS (SELECT user_id, concat('r', CAST(user_id AS VARCHAR)) AS username, concat('key-', CAST(user_id % 97 AS VARCHAR)) AS api_key FROM users_remote),
        fresh AS (SELECT *, row_number() OVER (PARTITION BY api_key ORDER BY user_id) AS rn FROM r
                  WHERE user_id NOT IN (SELECT user_id FROM l) AND api_key NOT IN (SELECT api_key FROM l))
       SELECT user_id, username, api_key FROM l UNION ALL SELECT user_id, username, api_key FROM fresh WHERE rn = 1""", ("users_local", "users_remote"))
def _(i: Inputs):
    key = F.concat(F.lit("key-"), (F.col("user_id") % 97).cast("string"))
    local = i.users_local.filter("user_id % 97 < 40").withColumn("api_key", key)
    remote = i.users_remote.withColumns({"username": F.concat(F.lit("r"), F.col("user_id").cast("string")), "api_key": key})
    return network.merged_users(network.user_merge(local, remote)).select("user_id", "username", "api_key")


@query("user_merge_counts",
    f"""WITH {USERS} SELECT count(*) FILTER (action='added') AS added, count(*) FILTER (action='updated') AS updated,
            count(*) FILTER (action IN ('skipped','refused')) AS skipped FROM merged""", ("users_local", "users_remote"))
def _(i: Inputs):
    return network.user_merge_counts(network.user_merge(i.users_local, i.users_remote))


NODE_COUNT = "(SELECT count(*) FROM supplier)"


def _node_items(i: Inputs):
    nodes = i.supplier.agg(F.count(F.lit(1))).scalar()
    items = i.items.select("id", "collection", "datetime", "bbox_west", "bbox_south", "bbox_east", "bbox_north", "seq")
    first = items.withColumn("node_id", F.col("seq") % nodes)
    second = items.withColumn("node_id", F.col("seq") * 7 % nodes).filter(F.col("node_id") != F.col("seq") % nodes)
    return first.unionByName(second)


NODE_ITEMS = f"""ni AS (SELECT *, seq % {NODE_COUNT} AS node_id FROM items UNION ALL SELECT *, seq * 7 % {NODE_COUNT} FROM items
                        WHERE seq * 7 % {NODE_COUNT} <> seq % {NODE_COUNT})"""


@query("routed_search",
    f"""WITH {NODE_ITEMS}, good AS (SELECT node_id, url, node_name FROM nodes WHERE {NOW_SECONDS} - last_seen_s < 300 AND url IS NOT NULL
           AND node_id IN (SELECT node_id FROM node_collections WHERE collection IN ('sentinel-2-l2a'))),
        f AS (SELECT id, node_id, datetime, row_number() OVER (PARTITION BY node_id ORDER BY datetime DESC, id) AS p FROM ni
              WHERE node_id IN (SELECT node_id FROM good) AND collection IN ('sentinel-2-l2a') AND bbox_east >= -100 AND bbox_west <= 100
              AND bbox_north >= -60 AND bbox_south <= 60 AND datetime >= '1995'),
        u AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY node_id, p) AS rn FROM f WHERE p <= 100)
        SELECT id, u.node_id, good.url AS source_node, good.node_name AS source_name, datetime FROM u JOIN good ON u.node_id = good.node_id
        WHERE rn = 1 ORDER BY u.node_id, p LIMIT 100""", ("items", "nodes", "node_collections"))
def _(i: Inputs):
    found = network.routed_search(
        _node_items(i), nodes_with_collections(i), NOW_SECONDS, ["sentinel-2-l2a"], [-100.0, -60.0, 100.0, 60.0], "1995/..", 100
    )
    return found.select("id", "node_id", "source_node", "source_name", "datetime")


@query("routed_search_all",
    f"""WITH {NODE_ITEMS}, good AS (SELECT node_id, url, node_name FROM nodes WHERE {NOW_SECONDS} - last_seen_s < 300 AND url IS NOT NULL
           AND node_id IN (SELECT node_id FROM node_collections WHERE collection IN ('sentinel-2-l2a'))),
        f AS (SELECT id, node_id, datetime FROM ni
              WHERE node_id IN (SELECT node_id FROM good) AND collection IN ('sentinel-2-l2a') AND bbox_east >= -100 AND bbox_west <= 100
              AND bbox_north >= -60 AND bbox_south <= 60 AND datetime >= '1995'),
        u AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY node_id) AS rn FROM f)
        SELECT id, u.node_id, good.url AS source_node, good.node_name AS source_name, datetime FROM u JOIN good ON u.node_id = good.node_id
        WHERE rn = 1""", ("items", "nodes", "node_collections"))
def _(i: Inputs):
    found = network.routed_search(_node_items(i), nodes_with_collections(i), NOW_SECONDS, ["sentinel-2-l2a"], [-100.0, -60.0, 100.0, 60.0], "1995/..")
    return found.select("id", "node_id", "source_node", "source_name", "datetime")


@query("routed_search_peers",
    f"""WITH {NODE_ITEMS}, good AS (SELECT node_id, url, node_name FROM nodes WHERE {NOW_SECONDS} - last_seen_s < 300 AND url IS NOT NULL
           AND node_id IN (SELECT node_id FROM node_collections WHERE collection IN ('sentinel-2-l2a'))),
        f AS (SELECT DISTINCT id, node_id, datetime FROM ni WHERE collection IN ('sentinel-2-l2a') AND bbox_east >= -100 AND bbox_west <= 100
              AND bbox_north >= -60 AND bbox_south <= 60 AND datetime >= '1995'),
        u AS (SELECT f.*, url, node_name, row_number() OVER (PARTITION BY id ORDER BY node_id) AS rn FROM f JOIN good USING (node_id)),
        p AS (SELECT f.id, f.node_id AS peer, url, datetime, row_number() OVER (PARTITION BY id ORDER BY f.node_id) AS rn
              FROM f JOIN nodes AS n ON f.node_id = n.node_id
              WHERE {NOW_SECONDS} - last_seen_s + n.node_id % 3 * 100 < 600 AND id NOT IN (SELECT id FROM u))
        SELECT id, node_id, NULL AS peer, url AS source_node, node_name AS source_name, datetime FROM u WHERE rn = 1
        UNION ALL SELECT id, NULL, peer, url, NULL, datetime FROM p WHERE rn = 1""", ("items", "nodes", "node_collections"))
def _(i: Inputs):
    peers = _peers(i).join(i.nodes.select("node_id", "url"), "node_id").withColumnRenamed("node_id", "peer")
    found = network.routed_search(
        _node_items(i), nodes_with_collections(i), NOW_SECONDS, ["sentinel-2-l2a"], [-100.0, -60.0, 100.0, 60.0], "1995/..",
        peer_items=_node_items(i).withColumnRenamed("node_id", "peer"), peers=peers,
    )
    return found.select("id", "node_id", "peer", "source_node", "source_name", "datetime")


@query("federated_search",
    f"""WITH {NODE_ITEMS}, f AS (SELECT id, node_id % 3 AS peer, datetime, row_number() OVER (PARTITION BY node_id % 3 ORDER BY datetime DESC, id) AS p FROM
              (SELECT DISTINCT id, node_id % 3 AS node_id, datetime, collection FROM ni) WHERE collection = 'landsat-c2-l2'),
        u AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY peer, p) AS rn FROM f WHERE p <= 200)
        SELECT id, peer, datetime FROM u WHERE rn = 1 ORDER BY peer, p LIMIT 200""", ("items",))
def _(i: Inputs):
    peers = _node_items(i).withColumn("peer", F.col("node_id") % 3).drop("node_id").distinct()
    return network.federated_search(peers, ["landsat-c2-l2"], limit=200).select("id", "peer", "datetime")


@query("federated_search_all",
    f"""WITH {NODE_ITEMS}, f AS (SELECT DISTINCT id, node_id % 3 AS peer, datetime FROM ni WHERE collection = 'landsat-c2-l2'),
        u AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY peer, datetime DESC) AS rn FROM f)
        SELECT id, peer, datetime FROM u WHERE rn = 1""", ("items",))
def _(i: Inputs):
    peers = _node_items(i).withColumn("peer", F.col("node_id") % 3).drop("node_id").distinct()
    return network.federated_search(peers, ["landsat-c2-l2"]).select("id", "peer", "datetime")


@query("swarm_assign",
    """WITH n AS (SELECT s_suppkey AS node_id, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 AS slot FROM supplier),
       b AS (SELECT concat('band-', CAST(p_partkey AS VARCHAR)) AS band, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part)
       SELECT node_id, band FROM b JOIN n ON n.slot = b.pos % (SELECT count(*) FROM supplier)""")
def _(i: Inputs):
    nodes = i.supplier.select(F.col("s_suppkey").alias("node_id"), F.col("s_acctbal").alias("score"))
    bands = i.part.select(F.concat(F.lit("band-"), F.col("p_partkey").cast("string")).alias("band"), F.col("p_partkey").alias("position"))
    return network.swarm_assign(nodes, bands)


@query("notify_targets",
    """SELECT node_id, url, (SELECT count(*) FROM items) AS items, (SELECT min(id) FROM items) AS first_id,
              (SELECT max(id) FROM items) AS last_id FROM nodes WHERE url IS NOT NULL""", ("items", "nodes"))
def _(i: Inputs):
    return network.notify_targets(i.items, i.nodes)
