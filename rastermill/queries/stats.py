"""Access, bandwidth, download and audit statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rastermill.fixtures import NOW, Inputs
from rastermill.operators import stats
from rastermill.registry import query
from rastermill.sources import readers
from rastermill.sources.sinks import sink_retention
from rastermill.streaming.run import work_folder

SINCE_WEEK = "ts > TIMESTAMP '2024-01-24'"
SINCE_DAY = "ts > TIMESTAMP '2024-01-30'"
SINCE_720H = "ts > TIMESTAMP '2024-01-01'"
COUNTS = "count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, round_even(sum(bytes)/1073741824.0::DOUBLE, 2) AS gb"


def _access(i: Inputs):
    return i.access_log.withColumnRenamed("chunk_no", "sha")


@query("top_collections",
    f"SELECT collection_id, count(*) AS access_count, max(ts) AS last_access FROM access_log WHERE {SINCE_WEEK} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    ("access_log",))
def _(i: Inputs):
    return stats.top_collections(i.access_log, NOW)


@query("chunk_heat_map",
    f"""SELECT chunk_no AS sha, count(*) AS access_count, arg_max(collection_id, (ts, collection_id)) AS collection_id, max(ts) AS last_access
        FROM access_log WHERE {SINCE_WEEK} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""", ("access_log",))
def _(i: Inputs):
    return stats.chunk_heat_map(_access(i), NOW)


@query("replication_promote",
    f"""SELECT chunk_no AS sha, count(*) AS weekly_accesses, CAST(least(6, 3 + count(*) // 15) AS BIGINT) AS replicas, arg_max(collection_id, (ts, collection_id)) AS collection_id
        FROM access_log WHERE {SINCE_WEEK} GROUP BY 1 HAVING count(*) >= 15""", ("access_log",))
def _(i: Inputs):
    return stats.replication_promote(_access(i), NOW, hot=15)


@query("replication_demote",
    """SELECT chunk_no AS sha, max(ts) AS last_access, count(*) AS total_accesses, CAST(2 AS BIGINT) AS replicas, arg_max(collection_id, (ts, collection_id)) AS collection_id
       FROM access_log GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-30'""", ("access_log",))
def _(i: Inputs):
    return stats.replication_demote(_access(i), NOW, cold_days=1)


@query("replication_advice",
    f"""SELECT sha, weekly, last_access, total, collection_id, advice, CAST(CASE advice WHEN 'promote' THEN least(6, 3 + weekly // 15) WHEN 'demote' THEN 2 ELSE 3 END AS BIGINT) AS replicas
        FROM (SELECT *, CASE WHEN weekly >= 15 THEN 'promote' WHEN last_access < TIMESTAMP '2024-01-30' THEN 'demote' ELSE 'ok' END AS advice
              FROM (SELECT chunk_no AS sha, count(*) FILTER ({SINCE_WEEK}) AS weekly, max(ts) AS last_access, count(*) AS total, arg_max(collection_id, (ts, collection_id)) AS collection_id FROM access_log GROUP BY 1))""",
    ("access_log",))
def _(i: Inputs):
    return stats.replication_advice(_access(i), NOW, hot=15, cold_days=1)


@query("bandwidth_summary",
    f"""SELECT CAST(d AS BIGINT) AS download_bytes, CAST(u AS BIGINT) AS upload_bytes, round_even(d/1073741824.0::DOUBLE,2) AS download_gb,
               round_even(u/1073741824.0::DOUBLE,2) AS upload_gb, n AS total_transfers
        FROM (SELECT sum(bytes) FILTER (direction='download') AS d, sum(bytes) FILTER (direction='upload') AS u, count(*) AS n
              FROM bandwidth_log WHERE {SINCE_DAY})""", ("bandwidth_log",))
def _(i: Inputs):
    return stats.bandwidth_summary(i.bandwidth_log, NOW)


@query("bandwidth_per_account",
    f"""SELECT account_id, CAST(sum(bytes) AS BIGINT) AS bytes, round_even(sum(bytes)/1073741824.0::DOUBLE,2) AS gb, count(*) AS transfers
        FROM bandwidth_log WHERE {SINCE_DAY} AND account_id > 0 GROUP BY 1""", ("bandwidth_log",))
def _(i: Inputs):
    return stats.bandwidth_per_account(i.bandwidth_log, NOW)


@query("download_totals", f"SELECT origin, {COUNTS} FROM download_log WHERE {SINCE_720H} GROUP BY 1", ("download_log",))
def _(i: Inputs):
    return stats.download_totals(i.download_log, NOW)


@query("downloads_by_provider",
    f"SELECT provider, collection_id, {COUNTS} FROM download_log WHERE {SINCE_720H} AND origin='source' GROUP BY 1,2", ("download_log",))
def _(i: Inputs):
    return stats.downloads_by_provider(i.download_log, NOW)


@query("downloads_by_collection",
    f"SELECT collection_id, {COUNTS} FROM download_log WHERE {SINCE_720H} AND origin='user' GROUP BY 1", ("download_log",))
def _(i: Inputs):
    return stats.downloads_by_collection(i.download_log, NOW)


@query("downloads_daily",
    f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, origin, {COUNTS} FROM download_log WHERE {SINCE_720H} GROUP BY 1,2", ("download_log",))
def _(i: Inputs):
    return stats.downloads_daily(i.download_log, NOW)


@query("access_overview",
    f"""SELECT 'top_24h' AS part, collection_id AS what, n FROM (SELECT collection_id, count(*) AS n FROM access_log WHERE {SINCE_DAY} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
        UNION ALL SELECT 'top_7d', collection_id, n FROM (SELECT collection_id, count(*) AS n FROM access_log WHERE {SINCE_WEEK} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
        UNION ALL SELECT 'heat_7d', CAST(chunk_no AS VARCHAR), n FROM (SELECT chunk_no, count(*) AS n FROM access_log WHERE {SINCE_WEEK} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)
        UNION ALL SELECT 'advice', CAST(chunk_no AS VARCHAR), count(*) FROM access_log GROUP BY chunk_no
        UNION ALL SELECT 'bandwidth_24h', 'transfers', count(*) FROM bandwidth_log WHERE {SINCE_DAY}
        UNION ALL SELECT 'bandwidth_7d', 'transfers', count(*) FROM bandwidth_log WHERE {SINCE_WEEK}""", ("access_log", "bandwidth_log"))
def _(i: Inputs):
    parts = stats.access_overview(_access(i), i.bandwidth_log, NOW)

    def row(name, part, what, n):
        return parts[name].select(F.lit(part).alias("part"), what.cast("string").alias("what"), F.col(n).alias("n"))

    return (
        row("top_collections_24h", "top_24h", F.col("collection_id"), "access_count")
        .unionByName(row("top_collections_7d", "top_7d", F.col("collection_id"), "access_count"))
        .unionByName(row("chunk_heat_map_7d", "heat_7d", F.col("sha"), "access_count"))
        .unionByName(row("replication_advice", "advice", F.col("sha"), "total"))
        .unionByName(row("bandwidth_24h", "bandwidth_24h", F.lit("transfers"), "total_transfers"))
        .unionByName(row("bandwidth_7d", "bandwidth_7d", F.lit("transfers"), "total_transfers"))
    )


@query("retention_cleanup", "SELECT event_id, chunk_no, ts FROM access_log WHERE ts >= TIMESTAMP '2024-01-21'", ("access_log",))
def _(i: Inputs):
    return stats.retention_cleanup(i.access_log, NOW, retain_days=10).select("event_id", "chunk_no", "ts")


@query("retention_folders", "SELECT event_id, chunk_no, ts FROM access_log WHERE ts >= TIMESTAMP '2024-01-21 06:00:00'", ("access_log",))
def _(i: Inputs):
    """The log stored by day, its expired days dropped in place."""
    folder = f"{work_folder(i.spark)}/log"
    log = i.access_log.select("event_id", "chunk_no", "ts", F.to_date("ts").cast("string").alias("day"))
    log.repartition("day").write.partitionBy("day").parquet(folder)
    sink_retention(i.spark, folder, "2024-01-31 06:00:00", retain_days=10)
    return i.spark.read.parquet(folder).select("event_id", "chunk_no", "ts")


@query("serve_history",
    """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS served, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS requests
       FROM download_log WHERE origin = 'user' GROUP BY 1 ORDER BY 1 DESC LIMIT 20""", ("download_log",))
def _(i: Inputs):
    return stats.serve_history(i.download_log.filter("origin = 'user'"), days=20)


def _audit_lines(i: Inputs):
    entry = F.to_json(
        F.struct(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), F.col("event_type").alias("action"),
            F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("detail"),
            F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string")).alias("ip"), (F.col("event_type") != "error").alias("ok"),
        )
    )
    broken = F.when(F.col("event_id") % 19 == 0, F.substring_index(entry, ":", 2)).otherwise(entry)
    return i.events.select(broken.alias("value"))


@query("src_audit",
    """SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, event_type AS action, concat('event ', CAST(event_id AS VARCHAR)) AS detail,
              concat('10.0.0.', CAST(user_id % 250 AS VARCHAR)) AS ip, event_type <> 'error' AS ok
       FROM events WHERE event_id % 19 <> 0 ORDER BY events.ts DESC, 2, 3 LIMIT 50""")
def _(i: Inputs):
    return readers.tail_audit(readers.decode_audit(_audit_lines(i)), 50)


@query("audit_counts", "SELECT event_type AS action, event_type <> 'error' AS ok, count(*) AS n FROM events WHERE event_id % 19 <> 0 GROUP BY 1, 2")
def _(i: Inputs):
    return stats.audit_counts(readers.decode_audit(_audit_lines(i)))


@query("ingest_report",
    """SELECT CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 3 = 0 THEN 'skipped' ELSE 'ingested' END AS status, count(*) AS n
       FROM events GROUP BY 1""")
def _(i: Inputs):
    results = i.events.select(
        F.when(F.col("event_type") == "error", F.lit("failed")).alias("error"), (F.col("event_id") % 3 == 0).alias("skipped")
    )
    return stats.ingest_report(results)


def raw_requests(events):
    """A request log made from the event stream."""
    kind, n, u = F.col("event_id") % 5, F.col("event_id").cast("string"), F.col("user_id").cast("string")
    path = (
        F.when(kind == 0, F.concat(F.lit("/chunks/"), F.sha2(u, 256)))
        .when(kind == 1, F.lit("/stac/search"))
        .when(kind == 2, F.concat(F.lit("/download/c"), (F.col("user_id") % 4).cast("string"), F.lit("/item-"), n))
        .when(kind == 3, F.concat(F.lit("/download/"), n))
        .otherwise(F.lit("/health"))
    )
    return events.select(
        "event_id", "ts", F.when(F.col("event_id") % 15 == 0, "HEAD").otherwise("GET").alias("method"), path.alias("path"),
        F.when(F.col("event_type") == "error", 404).otherwise(200).alias("status"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("a, b"), F.col("user_id") % 3)).otherwise(F.lit("c,,")).alias("query_collections"),
        F.floor(F.col("value") * 100).cast("bigint").alias("bytes"), F.concat(F.lit("ip"), u).alias("client"),
    )


CLASSIFY = """SELECT * FROM (
    SELECT 'chunk' AS kind, ts, sha256(CAST(user_id AS VARCHAR)) AS what, 'read' AS how, CAST(0 AS BIGINT) AS bytes FROM ok WHERE k = 0 AND event_id % 15 <> 0
    UNION ALL SELECT 'collection', ts, unnest(CASE WHEN event_id % 2 = 0 THEN ['a', concat('b', CAST(user_id % 3 AS VARCHAR))] ELSE ['c'] END), 'query', 0 FROM ok WHERE k = 1
    UNION ALL SELECT 'collection', ts, concat('c', CAST(user_id % 4 AS VARCHAR)), 'download', 0 FROM ok WHERE k = 2
    UNION ALL SELECT 'download', ts, concat('item-', CAST(event_id AS VARCHAR)), concat('ip', CAST(user_id AS VARCHAR)), CAST(floor(value*100) AS BIGINT) FROM ok WHERE k = 2)"""


def classified(chunk, collection, download):
    """The three kinds of events in one frame."""
    zero = F.lit(0).cast("bigint").alias("bytes")
    return (
        chunk.select(F.lit("chunk").alias("kind"), "ts", F.col("sha").alias("what"), F.col("access_type").alias("how"), zero)
        .unionByName(collection.select(F.lit("collection").alias("kind"), "ts", F.col("collection_id").alias("what"), F.col("access_type").alias("how"), zero))
        .unionByName(download.select(F.lit("download").alias("kind"), "ts", F.col("item_id").alias("what"), F.col("client_ip").alias("how"), "bytes"))
    )


@query("log_classify", f"WITH ok AS (SELECT *, event_id % 5 AS k FROM events WHERE event_type <> 'error') {CLASSIFY}")
def _(i: Inputs):
    return classified(*stats.log_classify(raw_requests(i.events)))


@query("sink_audit_append",
    """SELECT event_type AS action, event_type <> 'error' AS ok, count(*) AS n FROM events WHERE event_id % 19 <> 0 GROUP BY 1, 2
       UNION ALL SELECT 'again', TRUE, count(*) FROM events WHERE event_id % 19 <> 0 AND event_type = 'click' HAVING count(*) > 0""")
def _(i: Inputs):
    from rastermill.sources.sinks import sink_audit_append
    from rastermill.streaming.run import work_folder

    entries = readers.decode_audit(_audit_lines(i))
    folder = work_folder(i.spark)
    sink_audit_append(entries, folder)
    sink_audit_append(entries.filter("action = 'click'").withColumn("action", F.lit("again")), folder)
    return stats.audit_counts(readers.decode_audit(i.spark.read.text(folder)))
