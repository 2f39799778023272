"""Session settings the operators are written for."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# What a cluster job should set; every value can be overridden at submit time.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # tile rows carry whole pixel blocks, so Python batches must stay small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    "spark.sql.execution.pythonUDF.arrow.enabled": "true",
}


def build_session(app: str = "rastermill", master: str | None = None, **overrides: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cores: str = "8", **overrides: str) -> SparkSession:
    """Single-machine session for tests and benchmarks."""
    return build_session(
        "rastermill-local",
        f"local[{cores}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cores,
            "spark.driver.memory": "8g",
            **overrides,
        },
    )


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches take 8 MB instead of Spark's 64 where the session names no size of its own; their rows stay the same.

    For steps whose rows are whole tiles: a batch on its way to Python lies in the JVM, in part twice, and in the worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "67108864b"):
        spark.conf.set(key, "8m")


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Used where a later step needs two reads of a frame to agree row for row
    even if an executor is lost in between (for example partition numbers).
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark, "checkpoint"))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset, a temporary folder serves a session that runs in one
    process (tests, trial runs); on a cluster that is an error, because each
    executor would write to a disk of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix=f"rastermill-{purpose}-")
