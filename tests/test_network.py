"""Registries, users, distribution and statistics."""

from pyspark.sql import functions as F

from rastermill.operators import network, stats

NODE = "node_id string, node_name string, url string, collections array<string>, item_count int, chunk_count int, chunks_bytes bigint, last_seen_s bigint"


def nodes(spark, *rows):
    return spark.createDataFrame(list(rows), NODE)


def test_network_stats(spark):
    df = nodes(
        spark, ("n1", "a", "u", ["s2", "landsat"], 10, 100, 5000, 1000), ("n2", "b", None, ["s2"], 5, 50, 2000, 1000), ("old", "c", "u", ["x"], 9, 9, 9, 0)
    )
    peers = spark.createDataFrame([("p", 500), ("q", 0)], "url string, last_seen_s bigint")
    r = network.network_stats(df, peers, 1050).first()
    assert (r.nodes_alive, r.nodes_total, r.total_items, r.total_chunks, r.total_bytes) == (2, 3, 15, 150, 7000)
    assert (r.collections, r.peers, r.peers_alive) == (["landsat", "s2"], 2, 1)


def test_gossip_merges_once(spark):
    local = nodes(spark, ("mine", "me", "u", ["s2"], 1, 1, 1, 10))
    remote = nodes(spark, ("remote-1", "r1", "u1", ["s2"], 2, 2, 2, 0), ("remote-2", "r2", None, None, 0, 0, 0, 0), ("", "bad", None, None, 0, 0, 0, 0))
    first = network.gossip_merge(local, remote, 99)
    assert first.agg(F.count_if("merged")).first()[0] == 2 and first.count() == 3
    second = network.gossip_merge(first.drop("merged"), remote, 120)
    assert second.agg(F.count_if("merged")).first()[0] == 0
    seen = {r.node_id: r.last_seen_s for r in second.collect()}
    assert seen == {"mine": 10, "remote-1": 120, "remote-2": 120}


def test_gossip_keeps_fields_the_peer_leaves_out(spark):
    local = nodes(spark, ("n", "mine", "u", ["s2"], 1, 2, 3, 10))
    remote = nodes(spark, ("n", "theirs", "other", None, None, 7, None, 0))
    r = network.gossip_merge(local, remote, 50).first()
    assert (r.node_name, r.url, r.collections, r.item_count, r.chunk_count, r.chunks_bytes) == ("mine", "u", ["s2"], 1, 7, 3)


def test_discover_peers(spark):
    urls = lambda *u: spark.createDataFrame([(x,) for x in u], "url string")
    got = network.discover_peers(urls("http://a"), urls("http://a/", "http://b/", "http://b", None, "", "http://me"), "http://me")
    assert [r.url for r in got.collect()] == ["http://b"]


def test_user_merge(spark):
    user = "user_id int, username string, updated_at int, active boolean"
    local = spark.createDataFrame([(1, "ann", 10, True), (2, "bob", 10, True), (9, "zoe", 1, True)], user)
    remote = spark.createDataFrame(
        [(1, "ann", 20, False), (2, "bob", 5, False), (3, "cat", 1, True), (4, "ann", 99, True), (5, "dup", 1, True), (6, "dup", 1, True)], user
    )
    merge = network.user_merge(local, remote)
    assert tuple(network.user_merge_counts(merge).first()) == (2, 1, 3)
    got = {r.user_id: (r.username, r.active) for r in network.merged_users(merge).collect()}
    assert got == {1: ("ann", False), 2: ("bob", True), 9: ("zoe", True), 3: ("cat", True), 5: ("dup", True)}


def test_searches_keep_the_first_source(spark):
    rows = [("i1", "c", "2024-01", 1), ("i1", "c", "2024-01", 2), ("i2", "c", "2024-03", 2), ("i3", "d", "2024-02", 1), ("i4", "c", "2024-09", 3)]
    items = spark.createDataFrame(rows, "id string, collection string, datetime string, node_id int").withColumns(
        {c: F.lit(0.0) for c in ("bbox_west", "bbox_south", "bbox_east", "bbox_north")}
    )
    registry = spark.createDataFrame(
        [(1, "one", "u1", ["c"], 100), (2, "two", "u2", ["c"], 100), (3, "dead", "u3", ["c"], -900)], "node_id int, node_name string, url string, collections array<string>, last_seen_s bigint"
    )
    got = [(r.id, r.source_name) for r in network.routed_search(items, registry, 200, ["c"]).collect()]
    assert got == [("i1", "one"), ("i2", "two")]
    peers = items.withColumnRenamed("node_id", "peer")
    assert [(r.id, r.peer) for r in network.federated_search(peers, limit=3).collect()] == [("i3", 1), ("i1", 1), ("i2", 2)]


def test_peer_registries_follow_the_nodes(spark):
    box = {c: F.lit(0.0) for c in ("bbox_west", "bbox_south", "bbox_east", "bbox_north")}
    items = spark.createDataFrame([("i1", "c", "2024-01", 1), ("i2", "c", "2024-03", 2)], "id string, collection string, datetime string, node_id int").withColumns(box)
    registry = spark.createDataFrame(
        [(1, "one", "u1", ["c"], 100), (2, "two", "u2", ["c"], 100)], "node_id int, node_name string, url string, collections array<string>, last_seen_s bigint"
    )
    heard = [("i1", "c", "2024-01", 7), ("i3", "c", "2024-02", 7), ("i3", "c", "2024-02", 8), ("i4", "c", "2024-05", 8), ("i5", "c", "2024-09", 9), ("i6", "d", "2024-09", 7)]
    heard = spark.createDataFrame(heard, "id string, collection string, datetime string, peer int").withColumns(box)
    peers = spark.createDataFrame([(7, "p7", 100), (8, "p8", -300), (9, "dead", -900)], "peer int, url string, last_seen_s bigint")
    search = lambda limit, rows=heard: network.routed_search(items, registry, 200, ["c"], limit=limit, peer_items=rows, peers=peers).collect()
    expected = [("i1", 1, None, "u1"), ("i2", 2, None, "u2"), ("i3", None, 7, "p7"), ("i4", None, 8, "p8")]
    assert sorted((r.id, r.node_id, r.peer, r.source_node) for r in search(None)) == expected
    for limit in (1, 2, 3, 4, 9):
        assert [(r.id, r.node_id, r.peer, r.source_node) for r in search(limit)] == expected[:limit]
    assert [r.id for r in search(9, heard.limit(0))] == ["i1", "i2"]


def test_swarm_assign_round_robin(spark):
    n = spark.createDataFrame([("slow", 1.0), ("fast", 9.0)], "node_id string, score double")
    b = spark.createDataFrame([(f"B{k}", k) for k in range(5)], "band string, position int")
    got = {r.band: r.node_id for r in network.swarm_assign(n, b).collect()}
    assert got == {"B0": "fast", "B1": "slow", "B2": "fast", "B3": "slow", "B4": "fast"}


def test_notify_targets(spark):
    df = nodes(spark, ("a", "a", "http://a/", [], 0, 0, 0, 0), ("b", "b", None, [], 0, 0, 0, 0), ("c", "c", "http://0.0.0.0:1", [], 0, 0, 0, 0))
    items = spark.createDataFrame([("i1",), ("i2",)], "id string")
    assert [tuple(r) for r in network.notify_targets(items, df).collect()] == [("a", "http://a", 2, "i1", "i2")]


def test_redundancy(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "sha string, node int")
    assert network.redundancy_index(df).first().redundancy == 1.5
    assert network.redundancy_index(df, approximate=True).first().chunks == 2
    log = spark.sql("SELECT 'a' AS sha, TIMESTAMP_NTZ '2024-01-30 12:00:00' AS ts")
    got = {r.sha: (r.copies, r["class"]) for r in network.replica_histogram(df, log, "2024-01-31 00:00:00", hot_per_day=0).collect()}
    assert got == {"a": (2, "hot"), "b": (1, "critical")}


def test_advice_is_promote_demote_and_ok(spark):
    log = spark.sql(
        """SELECT 'hot' AS sha, 'c' AS collection_id, TIMESTAMP_NTZ '2024-01-30 00:00:00' AS ts FROM range(120)
           UNION ALL SELECT 'cold', 'c', TIMESTAMP_NTZ '2023-12-01 00:00:00' UNION ALL SELECT 'ok', 'd', TIMESTAMP_NTZ '2024-01-20 00:00:00'"""
    )
    now = "2024-01-31 00:00:00"
    got = {r.sha: (r.advice, r.replicas) for r in stats.replication_advice(log, now).collect()}
    assert got == {"hot": ("promote", 5), "cold": ("demote", 2), "ok": ("ok", 3)}
    assert {r.sha for r in stats.replication_promote(log, now).collect()} == {"hot"}
    assert {r.sha for r in stats.replication_demote(log, now).collect()} == {"cold"}
    assert {r.sha for r in stats.retention_cleanup(log, now, 30).collect()} == {"hot", "ok"}
    transfers = log.select("ts", F.lit("upload").alias("direction"), F.lit(5).alias("bytes"))
    assert set(stats.access_overview(log, transfers, now)) >= {"top_collections_7d", "bandwidth_24h", "replication_advice"}


def test_log_classify(spark):
    raw = spark.createDataFrame(
        [("GET", "/chunks/abc", 200, None, 5), ("HEAD", "/chunks/abc", 200, None, 5), ("GET", "/chunks/abc", 404, None, 5), ("GET", "/stac/search", 200, "a, b,,", 1),
         ("GET", "/stac/search", 200, None, 1), ("GET", "/download/s2/item-1", 200, None, 77), ("GET", "/download/s2", 200, None, 9), ("GET", "/", 200, None, 1)],
        "method string, path string, status int, query_collections string, bytes bigint",
    ).withColumns({"ts": F.lit("2024-01-01").cast("timestamp_ntz"), "client": F.lit("ip")})
    chunk, collection, download = stats.log_classify(raw)
    assert [r.sha for r in chunk.collect()] == ["abc"]
    assert sorted((r.collection_id, r.access_type) for r in collection.collect()) == [("a", "query"), ("b", "query"), ("s2", "download")]
    assert [(r.collection_id, r.item_id, r.bytes) for r in download.collect()] == [("s2", "item-1", 77)]
