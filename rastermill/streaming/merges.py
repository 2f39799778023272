"""Streams that change a stored table, one micro-batch at a time.

Every batch writes in a way that can be repeated after a failure: a delta of
the registry is overwritten by the same batch number, and chunk appends first
drop what is already stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from rastermill.operators.chunks import missing_chunks
from rastermill.plans.pick import last_per_key
from rastermill.sources.sinks import content_hash, sink_chunks_put, write_chunks
from rastermill.sources.folders import folder_names, remove_folder


def _start(stream: DataFrame, apply, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def st_heartbeat_registry(stream: DataFrame, target: str, checkpoint: str, available_now: bool = False, snapshot_every: int = 10) -> StreamingQuery:
    """Keep the newest heartbeat per node in ``target``: the nodes of a batch as its delta, and a snapshot every few batches.

    What a batch writes follows the nodes it hears from, not the registry. A snapshot takes in all deltas before it; those
    that the snapshot before it already held are removed then, so that readers of the older one can finish.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last_per_key(batch, ["node_id"], "ts").write.mode("overwrite").parquet(f"{target}/delta={batch_id}")
        if (batch_id + 1) % snapshot_every:
            return
        whole = _registry(spark, target, batch.schema, batch_id)
        whole.write.mode("overwrite").parquet(f"{target}/snapshot={batch_id}")
        before = max((n for n in _numbers(spark, target, "snapshot") if n < batch_id), default=-1)
        for kind, least in (("delta", before + 1), ("snapshot", before)):
            for n in _numbers(spark, target, kind):
                if n < least:
                    remove_folder(spark, f"{target}/{kind}={n}")

    return _start(stream, apply, checkpoint, available_now)


def _numbers(spark: SparkSession, target: str, kind: str) -> list[int]:
    return [int(name.split("=")[1]) for name in folder_names(spark, target, finished=True) if name.startswith(f"{kind}=")]


def _registry(spark: SparkSession, target: str, schema: StructType | None, upto: int | None = None) -> DataFrame:
    """The last snapshot (before ``upto``) and the deltas after it, newest row per node."""
    base = max((n for n in _numbers(spark, target, "snapshot") if upto is None or n < upto), default=-1)
    paths = [f"{target}/snapshot={base}"] if base >= 0 else []
    paths += [f"{target}/delta={n}" for n in sorted(_numbers(spark, target, "delta")) if n > base and (upto is None or n <= upto)]
    reader = spark.read.schema(schema) if schema else spark.read
    return last_per_key(reader.parquet(*paths), ["node_id"], "ts")


def read_registry(spark: SparkSession, target: str) -> DataFrame:
    """The registry as it is now."""
    return _registry(spark, target, None)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table as it is now, without rows where nothing was stored yet."""
    return spark.read.schema("sha string, data binary, bytes bigint, prefix string").parquet(path)


def _ensure_table(spark: SparkSession, path: str) -> None:
    """An empty chunk table, so that the first batch has something to read."""
    empty = spark.createDataFrame([], "sha string, data binary, bytes bigint, prefix string")
    empty.write.mode("append").partitionBy("prefix").parquet(path)


def st_dedup_chunks(stream: DataFrame, store: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Store each content once: repeats in the stream and chunks already stored are dropped.

    Duplicates are found against the batch and the store, not within a
    watermark, so content that arrives late is stored all the same.
    """
    _ensure_table(stream.sparkSession, store)
    arrivals = stream.select("data", F.octet_length("data").cast("bigint").alias("bytes"))

    def apply(batch: DataFrame, batch_id: int) -> None:
        fresh = sink_chunks_put(read_chunks(batch.sparkSession, store), batch)
        write_chunks(fresh.select("sha", "data", "bytes"), store)

    return _start(arrivals, apply, checkpoint, available_now)


def st_new_items_sync(
    notices: DataFrame, remote_refs: DataFrame, remote_chunks: DataFrame, store: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Copy the chunks of announced items that are absent here and whose hash is right.

    ``remote_refs`` and ``remote_chunks`` are stored tables of the announcing
    side; each batch reads only the rows of its items.
    """
    _ensure_table(notices.sparkSession, store)

    def apply(batch: DataFrame, batch_id: int) -> None:
        announced = batch.select("item_id").distinct()
        refs = remote_refs.join(announced, "item_id", "left_semi")
        wanted = missing_chunks(refs, read_chunks(batch.sparkSession, store)).select("sha").distinct()
        offered = remote_chunks.select("sha", "data").join(wanted, "sha", "left_semi")
        valid = offered.filter(content_hash() == F.col("sha")).dropDuplicates(["sha"])
        write_chunks(valid.select("sha", "data", F.octet_length("data").cast("bigint").alias("bytes")), store)

    return _start(notices, apply, checkpoint, available_now)
