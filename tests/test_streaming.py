"""Streams against their batch twins, fed file by file."""

import datetime
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastermill.operators import flow
from rastermill.sources.folders import folder_names
from rastermill.sources.sinks import content_hash
from rastermill.streaming import merges, replay, run, stateful, windows


def as_stream(spark, df, path, parts=4, order="seq"):
    """Write ``df`` as several files, one after the other in order, and stream one file per batch."""
    rows = df.orderBy(order).collect()
    step = -(-len(rows) // parts)
    for k in range(0, len(rows), step):
        spark.createDataFrame(rows[k : k + step], df.schema).coalesce(1).write.mode("append").parquet(path)
    return run.file_stream(spark, path, df.schema, files_per_batch=1)


def events(spark, rows):
    """rows: (seq, key, seconds)"""
    return spark.createDataFrame(rows, "seq bigint, key bigint, s double").select(
        "seq", "key", F.timestamp_micros((F.lit(1_704_067_200_000_000) + F.col("s") * 1_000_000).cast("bigint")).cast("timestamp_ntz").alias("ts")
    )


def in_order(n, span, seed):
    rng = random.Random(seed)
    times = sorted(rng.uniform(0, span) for _ in range(n))
    return [(k, 0 if rng.random() < 0.4 else rng.randrange(4), round(t, 3)) for k, t in enumerate(times)]


def drained(start, stream, schema, tmp_path, **options):
    run.finish(start(stream, str(tmp_path / "out"), str(tmp_path / "progress"), available_now=True, **options))
    return replay.read_replayed(stream.sparkSession, str(tmp_path / "out"), schema)


def test_rate_limit_equals_batch(spark, tmp_path):
    df = events(spark, in_order(400, 150, 1)).select("seq", "ts", F.col("key").alias("client"), F.lit("/x").alias("path"))
    stream = as_stream(spark, df, str(tmp_path / "in"))
    for _ in range(2):  # a restart on the same checkpoint changes nothing
        found = drained(stateful.st_rate_limit, stream, stateful.RATE_SCHEMA, tmp_path, rpm=20, burst=5)
        got = sorted((r.seq, r.admitted) for r in found.collect())
        assert got == sorted((r.seq, r.admitted) for r in flow.rate_admission(df, 20, 5).collect())


def test_a_flood_of_one_client_is_read_batch_by_batch(spark, tmp_path):
    """One client sends all rows of a batch; Python never sees more of them than an Arrow batch holds."""
    sizes = spark.sparkContext.accumulator(0)
    df = spark.range(100_000).select(F.lit(1).cast("bigint").alias("client"), (F.lit(100_000) - F.col("id")).alias("seq"), (F.col("id") * -7 % 1000).alias("us"))

    def step(state, rows):
        sizes.add(len(rows["seq"]) > 2048)
        assert (np.diff(rows["us"]) >= 0).all() and (not state or state[1] <= rows["us"][0])
        state[:] = [(state or [0])[0] + len(rows["seq"]), int(rows["us"][-1])]
        return {"seq": rows["seq"]}

    done = replay.replayed(df, None, "client", ["us", "seq"], ["seq"], step, {"seq": "bigint"}, None).cache()
    assert done.filter("kind = 'row'").count() == 100_000 and sizes.value == 0
    assert done.filter("kind = 'state'").first().state[0] == 100_000


def test_states_fade_and_null_keys_are_a_key(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 6), (7, 3, 100)], "client bigint, seq bigint, us bigint")

    def step(state, rows):
        state += rows["us"].tolist()
        return {"seq": rows["seq"]}

    first = replay.replayed(df, None, "client", ["us"], ["seq"], step, {"seq": "bigint"}, None)
    states = first.filter("kind = 'state'").select("client", "state")
    assert {(r.client, tuple(r.state)) for r in states.collect()} == {(None, (5, 6)), (7, (100,))}
    second = replay.replayed(df.filter("seq = 2"), states, "client", ["us"], ["seq"], step, {"seq": "bigint"}, 50)
    assert [(r.client, r.state) for r in second.filter("kind = 'state'").collect()] == [(7, [100])]


def test_breaker_trips_once(spark, tmp_path):
    rng = random.Random(4)
    df = spark.createDataFrame([(k, rng.randrange(3), rng.random() < 0.3) for k in range(300)], "seq bigint, account_id bigint, success boolean")
    found = drained(stateful.st_fail_breaker, as_stream(spark, df, str(tmp_path / "in"), parts=7), stateful.BREAKER_SCHEMA, tmp_path, limit=4).collect()
    got = {r.account_id: r.seq for r in found}
    expected, streak = {}, {}
    for r in df.orderBy("seq").collect():
        streak[r.account_id] = 0 if r.success else streak.get(r.account_id, 0) + 1
        if streak[r.account_id] == 4:
            expected.setdefault(r.account_id, r.seq)
    assert got == expected and len(found) == len(expected) == 3


def test_daily_and_hot(spark, tmp_path):
    df = events(spark, in_order(300, 5 * 86400, 2)).withColumn("bytes", F.col("seq"))
    got = {r.day: (r.served, r.bytes) for r in run.drain(windows.st_access_daily(as_stream(spark, df, str(tmp_path / "a")))).collect()}
    batch = df.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).collect()
    expected = {r.day: (r.n, r.b) for r in batch}
    assert len(got) == 4 and all(expected[d] == v for d, v in got.items())  # the last day is still open
    hot = run.drain(windows.st_hot_chunks(as_stream(spark, df.withColumnRenamed("key", "sha"), str(tmp_path / "b")), hot=30)).collect()
    assert hot and all(r.accesses >= 30 for r in hot)


def test_liveness_intervals(spark, tmp_path):
    beats = [0, 100, 390, 900, 1000, 5000]
    df = events(spark, [(k, 1, float(s)) for k, s in enumerate(beats)] + [(99, 2, 9000.0)]).withColumnRenamed("key", "node_id")
    up = run.drain(windows.st_liveness(as_stream(spark, df, str(tmp_path / "in")), 300)).filter("node_id = 1").orderBy("up_from").collect()
    assert [(r.heartbeats, int((r.gone_at - r.last_seen).total_seconds())) for r in up] == [(3, 300), (2, 300), (1, 300)]


def changes(spark, batches, tmp_path, ttl=300, watermark="10 minutes"):
    """Changes after each list of (node, second) is one micro-batch, told in this order."""
    rows = [(k, n, float(s), b) for b, beats in enumerate(batches) for k, (n, s) in enumerate(beats)]
    df = events(spark, [(b * 1000 + k, n, s) for k, n, s, b in rows]).withColumnRenamed("key", "node_id")
    folder = str(tmp_path / "in")
    for b in range(len(batches)):
        df.filter(F.floor(F.col("seq") / 1000) == b).coalesce(1).write.mode("append").parquet(folder)
    found = run.drain(stateful.st_liveness_changes(run.file_stream(spark, folder, df.schema, files_per_batch=1), ttl, watermark)).collect()
    start = datetime.datetime(2024, 1, 1)
    at = lambda r: (r["at"].replace(tzinfo=None) - start).total_seconds()
    return sorted((r.node_id, at(r), r.alive) for r in found)


def test_liveness_changes_by_timer(spark, tmp_path):
    got = changes(spark, [[(1, 0), (1, 100)], [(1, 390)], [(1, 900), (1, 1000)], [(2, 9000)]], tmp_path)
    assert got == [(1, 0, True), (1, 690, False), (1, 900, True), (1, 1300, False)]  # node 2 is not settled yet


def test_liveness_weighs_beats_that_are_late_but_in_time(spark, tmp_path):
    # the gap between 0 and 500 is filled later; the beat at 10 after 2000 is too late and dropped
    got = changes(spark, [[(1, 0), (1, 500)], [(1, 250)], [(1, 2000)], [(1, 10), (1, 5000)], [(2, 9000)]], tmp_path)
    assert got == [(1, 0, True), (1, 800, False), (1, 2000, True), (1, 2300, False), (1, 5000, True), (1, 5300, False)]


def test_liveness_at_the_very_edge(spark, tmp_path):
    assert changes(spark, [[(1, 0)], [(1, 300)], [(2, 9000)]], tmp_path) == [(1, 0, True), (1, 300, False), (1, 300, True), (1, 600, False)]


def test_quota_windows(spark, tmp_path):
    df = events(spark, [(k, 1, float(60 * k)) for k in range(200)]).withColumnRenamed("key", "account_id")
    rows = run.drain(windows.st_quota(as_stream(spark, df, str(tmp_path / "in")))).collect()
    assert max(r.requests for r in rows) == 60


def test_registry_keeps_the_newest(spark, tmp_path):
    df = events(spark, in_order(100, 1000, 3)).select(F.col("key").alias("node_id"), "ts", F.col("seq").alias("item_count"))
    stream = as_stream(spark, df, str(tmp_path / "in"), order="ts")
    for _ in range(2):  # a restart on the same checkpoint changes nothing
        run.finish(merges.st_heartbeat_registry(stream, str(tmp_path / "nodes"), str(tmp_path / "progress"), available_now=True))
    got = {r.node_id: r.item_count for r in merges.read_registry(spark, str(tmp_path / "nodes")).collect()}
    assert got == {r.node_id: r.m for r in df.groupBy("node_id").agg(F.max("item_count").alias("m")).collect()}


def test_registry_writes_what_a_batch_changes(spark, tmp_path):
    rows = [(k, k if k < 300 else k % 3, float(k)) for k in range(340)]  # the first batches hear from all nodes, the others from three
    df = events(spark, rows).select(F.col("key").alias("node_id"), "ts", F.col("seq").alias("item_count"))
    stream = as_stream(spark, df, str(tmp_path / "in"), parts=34, order="ts")
    target = str(tmp_path / "nodes")
    run.finish(merges.st_heartbeat_registry(stream, target, str(tmp_path / "progress"), available_now=True, snapshot_every=8))
    names = folder_names(spark, target, finished=True)
    # two snapshots are kept, and the deltas that the older one does not hold
    assert [n for n in names if n.startswith("snapshot")] == ["snapshot=23", "snapshot=31"]
    deltas = sorted(int(n.split("=")[1]) for n in names if n.startswith("delta"))
    assert deltas == list(range(24, 34))
    assert spark.read.parquet(f"{target}/delta=33").count() == 3
    got = {r.node_id: r.item_count for r in merges.read_registry(spark, target).collect()}
    assert got == {r.node_id: r.m for r in df.groupBy("node_id").agg(F.max("item_count").alias("m")).collect()}


def test_dedup_stores_each_content_once_even_when_late(spark, tmp_path):
    df = spark.createDataFrame([(k, f"text {k % 7}".encode()) for k in range(40)], "seq bigint, data binary")
    store = str(tmp_path / "chunks")
    for attempt in range(2):  # the second stream brings the same content again
        stream = as_stream(spark, df, str(tmp_path / f"in{attempt}"))
        run.finish(merges.st_dedup_chunks(stream, store, str(tmp_path / f"progress{attempt}"), available_now=True))
    assert spark.read.parquet(store).count() == 7


def test_new_items_sync_copies_valid_absent_chunks(spark, tmp_path):
    chunks = spark.createDataFrame([(b"a",), (b"b",), (b"c",)], "data binary").withColumn("sha", content_hash())
    chunks = chunks.withColumn("data", F.when(F.col("data") == b"c", F.lit(b"broken")).otherwise(F.col("data")))
    refs = chunks.select(F.lit("item").alias("item_id"), "sha").unionByName(spark.createDataFrame([("other", "x")], "item_id string, sha string"))
    notices = spark.createDataFrame([(1, "item"), (2, "item")], "seq bigint, item_id string")
    stream = as_stream(spark, notices, str(tmp_path / "in"), parts=2)
    store = str(tmp_path / "chunks")
    run.finish(merges.st_new_items_sync(stream, refs, chunks, store, str(tmp_path / "progress"), available_now=True))
    assert sorted(bytes(r.data) for r in spark.read.parquet(store).collect()) == [b"a", b"b"]


@pytest.mark.parametrize("watermark, expected", [("10 minutes", 2), ("2 days", 0)])
def test_open_windows_are_not_emitted(spark, tmp_path, watermark, expected):
    df = events(spark, [(0, 1, 10.0), (1, 1, 86500.0), (2, 1, 180000.0)]).withColumn("bytes", F.lit(1))
    assert run.drain(windows.st_access_daily(as_stream(spark, df, str(tmp_path / "in")), watermark)).count() == expected


@pytest.mark.parametrize("parts", [1, 3])
def test_a_table_of_one_file_or_many_is_streamed_whole(spark, tmp_path, parts):
    """Tables beside it are left out, whatever they are made of."""
    rows = [(k, f"text {k // 2}", "en") for k in range(30)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(parts)
    if parts > 1:
        table.write.parquet(str(tmp_path / "in" / "documents.parquet"))
    else:
        (tmp_path / "in").mkdir()
        table.toPandas().to_parquet(tmp_path / "in" / "documents.parquet")
    spark.range(5).write.parquet(str(tmp_path / "in" / "others.parquet"))
    stream = run.table_stream(spark, str(tmp_path / "in"), "documents.parquet", table.schema)
    assert sorted(map(tuple, run.drain(stream, str(tmp_path / "out")).collect())) == rows


@pytest.mark.parametrize("texts", [["a", "b", "a", "ü"], []])
def test_queries_over_documents_in_a_folder(spark, tmp_path, texts):
    """Documents stored as several files, or as none with rows."""
    import rastermill.queries  # noqa: F401  (fills the registry)
    from rastermill.registry import QUERIES

    rows = [(k, t, "en", f"src{k}") for k, t in enumerate(texts, 1)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    table.repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    digest = {hashlib.sha256(t.encode()).hexdigest(): len(t.encode()) for t in texts}
    assert {(r.sha, r.bytes) for r in QUERIES["st_dedup_chunks"](spark, str(tmp_path)).collect()} == set(digest.items())
    offered = {hashlib.sha256(t.encode()).hexdigest() for _, t, _, source in rows if source != "src3"}
    assert [r.sha for r in QUERIES["st_new_items_sync"](spark, str(tmp_path)).orderBy("sha").collect()] == sorted(offered)
