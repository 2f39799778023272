"""Running a stream to the end of its input, for tests, backfills and batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from rastermill.session import shared_folder
from rastermill.sources.folders import is_folder


def work_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared checkpoint folder of the session."""
    return f"{shared_folder(spark, 'stream')}/rastermill-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def table_stream(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    """The stored table ``name`` of a folder as a stream, be it one file or a folder of files."""
    if is_folder(spark, f"{folder}/{name}"):
        return file_stream(spark, f"{folder}/{name}", schema)
    return file_stream(spark, folder, schema, name)


def drain(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Process all available input into parquet files and return them as a frame."""
    spark = stream.sparkSession
    folder = folder or work_folder(spark)
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True).start(f"{folder}/rows")
    )
    finish(query)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def finish(query: StreamingQuery) -> None:
    query.awaitTermination()


def timed(stream: DataFrame, watermark: str) -> DataFrame:
    """Stream with ``ts`` as event time; rows later than ``watermark`` are dropped."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def in_batches(rows: DataFrame, order: str, batches: int) -> DataFrame:
    """A stored table as a stream of ``batches`` micro-batches, cut at equal shares of ``order``."""
    spark, folder = rows.sparkSession, work_folder(rows.sparkSession)
    cuts = rows.select(F.approx_percentile(order, [k / batches for k in range(1, batches)], 10_000)).first()[0] or []
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        part = rows if lo is None else rows.filter(F.col(order) >= lo)
        (part if hi is None else part.filter(F.col(order) < hi)).coalesce(1).write.mode("append").parquet(f"{folder}/rows")
    return file_stream(spark, f"{folder}/rows", rows.schema, files_per_batch=1)
