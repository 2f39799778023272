"""Access, bandwidth and download statistics.

Logs are filtered on ``ts`` first (a pushed-down parquet filter, or partition
pruning on a table laid out by day) and aggregated with map-side combine, so a
chunk or collection that owns most of the log costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastermill.functions.times import moment
from rastermill.operators.search import recent_window

# Replication thresholds.
HOT_PER_WEEK = 50
COLD_DAYS = 30
DEFAULT_REPLICAS = 3
MAX_REPLICAS = 6
COLD_REPLICAS = 2
HISTORY_DAYS = 90
GIB = 1024**3


def _gb(total: Column) -> Column:
    return F.bround(F.coalesce(total, F.lit(0)) / F.lit(GIB), 2)


def top_collections(log: DataFrame, now: str, hours: float = 168, limit: int = 20) -> DataFrame:
    counted = recent_window(log, now, hours).groupBy("collection_id").agg(
        F.count(F.lit(1)).alias("access_count"), F.max("ts").alias("last_access")
    )
    return counted.orderBy(F.col("access_count").desc(), "collection_id").limit(limit)


def chunk_heat_map(log: DataFrame, now: str, hours: float = 168, limit: int = 50, key: str = "sha") -> DataFrame:
    """Most used chunks, with the collection of their latest access."""
    counted = _by_chunk(recent_window(log, now, hours), key, access_count=F.count(F.lit(1)))
    return counted.orderBy(F.col("access_count").desc(), key).limit(limit)


def _by_chunk(log: DataFrame, key: str, **counts: Column) -> DataFrame:
    """Counts, latest access and the collection of that access (of accesses at the same time the last by name) per chunk.

    The log is counted per chunk and collection with numbers alone, which hash aggregation does without sorting; a collection is
    chosen among the few rows this leaves for a chunk.
    """
    pairs = log.groupBy(key, "collection_id").agg(*[c.alias(name) for name, c in counts.items()], F.max("ts").alias("last_access"))
    return pairs.groupBy(key).agg(
        *[F.sum(name).alias(name) for name in counts], F.max("last_access").alias("last_access"),
        F.max_by("collection_id", F.struct("last_access", "collection_id")).alias("collection_id"),
    )


def _replicas(count: Column, hot: int) -> Column:
    return F.least(F.lit(MAX_REPLICAS), F.lit(DEFAULT_REPLICAS) + F.floor(count / hot)).cast("bigint")


def replication_advice(log: DataFrame, now: str, hot: int = HOT_PER_WEEK, cold_days: int = COLD_DAYS, key: str = "sha") -> DataFrame:
    """Every tracked chunk with ``promote``, ``demote`` or ``ok``, in one pass over the log."""
    per_chunk = _by_chunk(log, key, weekly=F.count_if(F.col("ts") > moment(now, 7 * 24)), total=F.count(F.lit(1)))
    advice = (
        F.when(F.col("weekly") >= hot, "promote").when(F.col("last_access") < moment(now, cold_days * 24), "demote").otherwise("ok")
    )
    replicas = (
        F.when(F.col("advice") == "promote", _replicas(F.col("weekly"), hot))
        .when(F.col("advice") == "demote", F.lit(COLD_REPLICAS).cast("bigint"))
        .otherwise(F.lit(DEFAULT_REPLICAS).cast("bigint"))
    )
    return per_chunk.withColumn("advice", advice).withColumn("replicas", replicas)


def replication_promote(log: DataFrame, now: str, hot: int = HOT_PER_WEEK, key: str = "sha") -> DataFrame:
    weekly = _by_chunk(recent_window(log, now, 7 * 24), key, weekly_accesses=F.count(F.lit(1))).drop("last_access")
    return weekly.filter(F.col("weekly_accesses") >= hot).withColumn("replicas", _replicas(F.col("weekly_accesses"), hot))


def replication_demote(log: DataFrame, now: str, cold_days: int = COLD_DAYS, key: str = "sha") -> DataFrame:
    last = _by_chunk(log, key, total_accesses=F.count(F.lit(1)))
    cold = last.filter(F.col("last_access") < moment(now, cold_days * 24))
    return cold.withColumn("replicas", F.lit(COLD_REPLICAS).cast("bigint"))


def bandwidth_summary(log: DataFrame, now: str, hours: float = 24) -> DataFrame:
    def of(direction: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("direction") == direction, F.col("bytes"))), F.lit(0))

    return recent_window(log, now, hours).agg(
        of("download").alias("download_bytes"),
        of("upload").alias("upload_bytes"),
        _gb(of("download")).alias("download_gb"),
        _gb(of("upload")).alias("upload_gb"),
        F.count(F.lit(1)).alias("total_transfers"),
    )


def bandwidth_per_account(log: DataFrame, now: str, hours: float = 24) -> DataFrame:
    used = recent_window(log, now, hours).filter(F.col("account_id") > 0)
    return used.groupBy("account_id").agg(
        F.sum("bytes").alias("bytes"), _gb(F.sum("bytes")).alias("gb"), F.count(F.lit(1)).alias("transfers")
    ).orderBy(F.col("bytes").desc(), "account_id")


def _download_groups(log: DataFrame, keys: list[str | Column]) -> DataFrame:
    return log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), _gb(F.sum("bytes")).alias("gb")
    )


def download_totals(log: DataFrame, now: str, hours: float = 720) -> DataFrame:
    return _download_groups(recent_window(log, now, hours), ["origin"])


def downloads_by_provider(log: DataFrame, now: str, hours: float = 720) -> DataFrame:
    source = recent_window(log, now, hours).filter(F.col("origin") == "source")
    return _download_groups(source, ["provider", "collection_id"]).orderBy(F.col("bytes").desc(), "provider", "collection_id")


def downloads_by_collection(log: DataFrame, now: str, hours: float = 720) -> DataFrame:
    user = recent_window(log, now, hours).filter(F.col("origin") == "user")
    return _download_groups(user, ["collection_id"]).orderBy(F.col("bytes").desc(), "collection_id")


def downloads_daily(log: DataFrame, now: str, hours: float = 720) -> DataFrame:
    recent = recent_window(log, now, hours)
    return _download_groups(recent, [F.to_date("ts").cast("string").alias("day"), "origin"]).orderBy("day", "origin")


def access_overview(access: DataFrame, bandwidth: DataFrame, now: str, key: str = "sha", top: int = 10, hottest: int = 20) -> dict[str, DataFrame]:
    """The dashboard's tables by name; each stays lazy. ``top`` and ``hottest`` are the lengths of its lists."""
    return {
        "top_collections_7d": top_collections(access, now, 168, top),
        "top_collections_24h": top_collections(access, now, 24, top),
        "chunk_heat_map_7d": chunk_heat_map(access, now, 168, hottest, key),
        "replication_advice": replication_advice(access, now, key=key),
        "bandwidth_24h": bandwidth_summary(bandwidth, now, 24),
        "bandwidth_7d": bandwidth_summary(bandwidth, now, 168),
    }


def retention_cleanup(log: DataFrame, now: str, retain_days: int = 90) -> DataFrame:
    """Rows to keep. On a table partitioned by day this drops whole folders."""
    return log.filter(F.col("ts") >= moment(now, retain_days * 24))


def serve_history(log: DataFrame, days: int = HISTORY_DAYS) -> DataFrame:
    """Served, bytes and requests per day for the latest ``days`` days that have traffic."""
    daily = log.groupBy(F.to_date("ts").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("served"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("requests")
    )
    return daily.orderBy(F.col("day").desc()).limit(days)


def audit_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("action", "ok").agg(F.count(F.lit(1)).alias("n"))


def ingest_report(results: DataFrame) -> DataFrame:
    """Ingest outcomes by status; a row is an error, skipped, or ingested."""
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("skipped"), "skipped").otherwise("ingested")
    return results.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def log_classify(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunk accesses, collection accesses and downloads in a request log.

    ``raw``: ts, method, path, status, query_collections, bytes, client. Works
    on batch and streaming frames alike.
    """
    ok = raw.filter(F.col("status") == 200)
    path = F.col("path")

    def after(prefix: str) -> Column:
        """Text between ``prefix`` and its next occurrence or the end."""
        return F.get(F.split(path, prefix), F.lit(1))

    chunk = ok.filter(F.startswith(path, F.lit("/chunks/")) & (F.col("method") == "GET")).select(
        "ts", after("/chunks/").alias("sha"), F.lit("read").alias("access_type")
    )
    names = F.filter(F.transform(F.split(F.coalesce("query_collections", F.lit("")), ","), lambda c: F.trim(c)), lambda c: c != "")
    searched = ok.filter(F.startswith(path, F.lit("/stac/search"))).select(
        "ts", F.explode(names).alias("collection_id"), F.lit("query").alias("access_type")
    )
    parts = F.split(after("/download/"), "/")
    downloads = ok.filter(F.startswith(path, F.lit("/download/")) & (F.size(parts) >= 2)).select(
        "ts", F.lit("user").alias("origin"), F.get(parts, F.lit(0)).alias("collection_id"), F.get(parts, F.lit(1)).alias("item_id"),
        F.coalesce("bytes", F.lit(0)).alias("bytes"), F.col("client").alias("client_ip"),
    )
    collections = searched.unionByName(downloads.select("ts", "collection_id", F.lit("download").alias("access_type")))
    return chunk, collections, downloads
