"""Windowed aggregates: all state is kept by the engine, partial results combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastermill.operators import stats
from rastermill.streaming.run import timed

WATERMARK = "10 minutes"


def st_access_daily(stream: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Served, bytes and requests per day."""
    daily = timed(stream, watermark).groupBy(F.window("ts", "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("served"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("requests")
    )
    return daily.select(F.to_date("w.start").cast("string").alias("day"), "served", "bytes", "requests")


def st_hot_chunks(stream: DataFrame, hot: int = stats.HOT_PER_WEEK, watermark: str = WATERMARK) -> DataFrame:
    """Chunks with at least ``hot`` accesses in a trailing week, day by day. Accesses are counted per day first, then weeks add up days."""
    daily = timed(stream, watermark).groupBy(F.window("ts", "1 day").alias("d"), "sha").agg(F.count(F.lit(1)).alias("accesses"))
    weekly = daily.groupBy(F.window(F.window_time("d"), "7 days", "1 day").alias("w"), "sha").agg(F.sum("accesses").alias("accesses"))
    return weekly.filter(F.col("accesses") >= hot).select("sha", F.col("w.end").alias("week_end"), "accesses")


def st_quota(stream: DataFrame, hours: int = 1, watermark: str = WATERMARK) -> DataFrame:
    """Requests per account in a sliding window of ``hours``, every five minutes; counted in panes of five minutes first."""
    panes = timed(stream, watermark).groupBy(F.window("ts", "5 minutes").alias("d"), "account_id").agg(F.count(F.lit(1)).alias("requests"))
    hourly = panes.groupBy(F.window(F.window_time("d"), f"{hours} hours", "5 minutes").alias("w"), "account_id").agg(F.sum("requests").alias("requests"))
    return hourly.select("account_id", F.col("w.end").alias("window_end"), "requests")


def st_liveness(stream: DataFrame, ttl_s: int = 300, watermark: str = WATERMARK) -> DataFrame:
    """Uptime intervals per node: a node is gone ``ttl_s`` seconds after its last heartbeat."""
    up = timed(stream, watermark).groupBy(F.session_window("ts", f"{ttl_s} seconds").alias("w"), "node_id").agg(
        F.count(F.lit(1)).alias("heartbeats"), F.max("ts").alias("last_seen")
    )
    return up.select("node_id", F.col("w.start").alias("up_from"), "last_seen", F.col("w.end").alias("gone_at"), "heartbeats")


def st_log_classify(stream: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunk, collection and download events; stateless, the batch function itself."""
    return stats.log_classify(stream)
