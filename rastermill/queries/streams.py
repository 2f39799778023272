"""Streaming queries, each run to the end of its input."""

from __future__ import annotations

from pyspark.sql import functions as F

from rastermill.fixtures import Inputs
from rastermill.queries.flow import REPLAY, REPLAY_TABLES
from rastermill.queries.stats import CLASSIFY, classified, raw_requests
from rastermill.registry import query
from rastermill.streaming import merges, replay, run, stateful, windows

CLOSED = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)"


def event_stream(i: Inputs):
    return run.table_stream(i.spark, i.folder, "events.parquet", i.events.schema)


def _plain(name: str):
    return F.col(name).cast("timestamp_ntz").alias(name)


@query("st_access_daily",
    f"""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS served, CAST(sum(CAST(floor(value*1000) AS BIGINT)) AS BIGINT) AS bytes, count(*) AS requests
        FROM events GROUP BY CAST(ts AS DATE) HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= {CLOSED}""")
def _(i: Inputs):
    stream = event_stream(i).select("ts", F.floor(F.col("value") * 1000).cast("bigint").alias("bytes"))
    return run.drain(windows.st_access_daily(stream))


@query("st_hot_chunks",
    f"""SELECT sha, week_end, count(*) AS accesses FROM (SELECT user_id AS sha, unnest(generate_series(date_trunc('day', ts) + INTERVAL 1 DAY, date_trunc('day', ts) + INTERVAL 7 DAY, INTERVAL 1 DAY)) AS week_end FROM events)
        WHERE week_end <= {CLOSED} GROUP BY 1, 2 HAVING count(*) >= 20""")
def _(i: Inputs):
    stream = event_stream(i).select("ts", F.col("user_id").alias("sha"))
    return run.drain(windows.st_hot_chunks(stream, hot=20)).select("sha", _plain("week_end"), "accesses")


@query("st_quota",
    f"""SELECT account_id, window_end, count(*) AS requests FROM (
          SELECT user_id % 25 AS account_id, unnest(generate_series(time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE, time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 1 HOUR, INTERVAL 5 MINUTE)) AS window_end FROM events)
        WHERE window_end <= {CLOSED} GROUP BY 1, 2""")
def _(i: Inputs):
    stream = event_stream(i).select("ts", (F.col("user_id") % 25).alias("account_id"))
    return run.drain(windows.st_quota(stream)).select("account_id", _plain("window_end"), "requests")


@query("st_liveness",
    f"""WITH e AS (SELECT user_id % 20 AS node_id, ts FROM events),
        m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY node_id ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM e),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY node_id ORDER BY ts) AS sid FROM m)
        SELECT node_id, min(ts) AS up_from, max(ts) AS last_seen, max(ts) + INTERVAL 2 HOUR AS gone_at, count(*) AS heartbeats FROM s GROUP BY node_id, sid
        HAVING max(ts) + INTERVAL 2 HOUR <= {CLOSED}""")
def _(i: Inputs):
    stream = event_stream(i).select("ts", (F.col("user_id") % 20).alias("node_id"))
    up = run.drain(windows.st_liveness(stream, ttl_s=7200))
    return up.select("node_id", _plain("up_from"), _plain("last_seen"), _plain("gone_at"), "heartbeats")


SPANS = """e AS (SELECT user_id % 20 AS node_id, ts FROM events),
        m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY node_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM e),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY node_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM m),
        spans AS (SELECT node_id, min(ts) AS up_from, max(ts) + INTERVAL 2 HOUR AS gone_at FROM s GROUP BY node_id, sid)"""


@query("st_liveness_changes",
    f"""WITH {SPANS} SELECT * FROM (SELECT node_id, up_from AS \"at\", TRUE AS alive FROM spans UNION ALL SELECT node_id, gone_at, FALSE FROM spans) WHERE \"at\" <= {CLOSED}""")
def _(i: Inputs):
    """Four micro-batches, the heartbeats of each in no order."""
    beats = run.in_batches(i.events.select("ts", (F.col("user_id") % 20).alias("node_id")), "ts", 4)
    changes = run.drain(stateful.st_liveness_changes(beats, ttl_s=7200))
    return changes.select("node_id", _plain("at"), "alive")


@query("st_log_classify", f"WITH ok AS (SELECT *, event_id % 5 AS k FROM events WHERE event_type <> 'error') {CLASSIFY}")
def _(i: Inputs):
    return classified(*map(run.drain, windows.st_log_classify(raw_requests(event_stream(i)))))


@query("st_heartbeat_registry",
    "SELECT user_id % 40 AS node_id, max(ts) AS ts, arg_max(CAST(floor(value) AS BIGINT), ts) AS item_count FROM events GROUP BY 1")
def _(i: Inputs):
    """Five micro-batches, a snapshot at every second one."""
    beats = i.events.select((F.col("user_id") % 40).alias("node_id"), "ts", F.floor("value").cast("bigint").alias("item_count"))
    folder = run.work_folder(i.spark)
    stream = run.in_batches(beats, "ts", 5)
    run.finish(merges.st_heartbeat_registry(stream, f"{folder}/nodes", f"{folder}/progress", available_now=True, snapshot_every=2))
    return merges.read_registry(i.spark, f"{folder}/nodes")


def document_stream(i: Inputs):
    return run.table_stream(i.spark, i.folder, "documents.parquet", i.documents.schema)


@query("st_dedup_chunks", "SELECT DISTINCT sha256(text) AS sha, CAST(strlen(text) AS BIGINT) AS bytes FROM documents")
def _(i: Inputs):
    arrivals = document_stream(i).select(F.encode("text", "UTF-8").alias("data"))
    folder = run.work_folder(i.spark)
    run.finish(merges.st_dedup_chunks(arrivals, f"{folder}/chunks", f"{folder}/progress", available_now=True))
    return merges.read_chunks(i.spark, f"{folder}/chunks").select("sha", "bytes")


@query("st_new_items_sync",
    """SELECT DISTINCT claimed_sha AS sha FROM chunks WHERE claimed_sha = sha AND source <> 'src3'
       AND claimed_sha IN (SELECT claimed_sha FROM chunks WHERE lang = 'en')""", ("chunks",))
def _(i: Inputs):
    refs = i.chunks.select(F.col("doc_id").alias("item_id"), F.col("claimed_sha").alias("sha"))
    remote = i.chunks.filter("source <> 'src3'").select(F.col("claimed_sha").alias("sha"), "data")
    notices = document_stream(i).filter("lang = 'en'").select(F.col("doc_id").alias("item_id"))
    folder = run.work_folder(i.spark)
    run.finish(merges.st_new_items_sync(notices, refs, remote, f"{folder}/chunks", f"{folder}/progress", available_now=True))
    return merges.read_chunks(i.spark, f"{folder}/chunks").select("sha")


@query("st_rate_limit", f"WITH {REPLAY} SELECT client, seq, admitted FROM step", REPLAY_TABLES)
def _(i: Inputs):
    path = F.when(F.col("event_id") % 11 == 0, "/health").otherwise("/stac/search")
    requests = i.events.select(F.col("event_id").alias("seq"), "ts", (F.col("user_id") % 20).alias("client"), path.alias("path"))
    folder = run.work_folder(i.spark)
    stream = run.in_batches(requests, "ts", 3)
    run.finish(stateful.st_rate_limit(stream, f"{folder}/verdicts", f"{folder}/progress", rpm=20, burst=4, minute_s=86400, burst_s=3600, available_now=True))
    return replay.read_replayed(i.spark, f"{folder}/verdicts", stateful.RATE_SCHEMA)


@query("st_fail_breaker",
    """WITH m AS (SELECT event_id AS seq, user_id % 25 AS account_id, event_type <> 'error' AS success,
                  sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id % 25 ORDER BY event_id) AS isl FROM events),
       r AS (SELECT account_id, seq, row_number() OVER (PARTITION BY account_id, isl ORDER BY seq) AS n FROM m WHERE NOT success)
       SELECT account_id, min(seq) AS seq FROM r WHERE n = 3 GROUP BY 1""")
def _(i: Inputs):
    calls = i.events.select(
        F.col("event_id").alias("seq"), (F.col("user_id") % 25).alias("account_id"), (F.col("event_type") != "error").alias("success")
    )
    folder = run.work_folder(i.spark)
    stream = run.in_batches(calls, "seq", 3)
    run.finish(stateful.st_fail_breaker(stream, f"{folder}/trips", f"{folder}/progress", limit=3, available_now=True))
    return replay.read_replayed(i.spark, f"{folder}/trips", stateful.BREAKER_SCHEMA)
