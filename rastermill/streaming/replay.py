"""Streams whose rows must be taken in order: each micro-batch is sorted by the engine and read through once.

A batch's rows meet the states that the batch before left behind. They are dealt by key and sorted, keys and orders alike
by the engine, which spills; Python sees one Arrow batch at a time and the state of one key, so memory does not depend
on how many rows a key has. Verdicts and new states are written by one job into the folder of their batch, so a repeated batch
replaces its own output and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rastermill.sources.folders import folder_exists, remove_folder

Step = Callable[[list[int], dict[str, np.ndarray]], dict[str, np.ndarray]]


def _key_runs(batch: pa.RecordBatch, key: str) -> Iterator[tuple[object, pa.RecordBatch]]:
    codes = batch.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy()
    borders = np.flatnonzero(codes[1:] != codes[:-1]) + 1
    for lo, hi in zip([0, *borders], [*borders, batch.num_rows]):
        yield batch.column(key)[int(lo)].as_py(), batch.slice(int(lo), int(hi - lo))


def replayed(rows: DataFrame, states: DataFrame | None, key: str, order: list[str], read: list[str], step: Step, out: dict[str, str], oldest: int | None) -> DataFrame:
    """Rows ``(key, out…, state, kind)``: what ``step`` makes of each key's rows in order, and each key's state at the end.

    ``step(state, columns)`` gets whole numbers, changes the state in place and returns the columns of ``out``. States whose
    last number lies before ``oldest`` are dropped.
    """
    kind = rows.schema[key].dataType.simpleString()
    columns = [c for c in dict.fromkeys([*order, *read])]
    given = rows.select(key, *[F.col(c).cast("bigint").alias(c) for c in columns], F.lit(None).cast("array<bigint>").alias("state"), F.lit(1).alias("turn"))
    if states is not None:
        empty = [F.lit(None).cast("bigint").alias(c) for c in columns]
        given = given.unionByName(states.select(key, *empty, "state", F.lit(0).alias("turn")))
    names = [key, *out, "state", "kind"]
    types = {"bigint": pa.int64(), "boolean": pa.bool_(), "int": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, begun, keys = None, [], False, None

        def ended() -> Iterator[pa.RecordBatch]:
            if begun and state and (oldest is None or state[-1] >= oldest):
                nothing = [pa.nulls(1, types[t]) for t in out.values()]
                yield pa.RecordBatch.from_arrays([keys, *nothing, pa.array([state], pa.list_(pa.int64())), pa.array(["state"])], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            for value, part in _key_runs(batch, key):
                if not begun or value != current:
                    yield from ended()
                    current, state, begun, keys = value, [], True, part.column(key).slice(0, 1)
                turn = part.column("turn").to_numpy()
                for k in np.flatnonzero(turn == 0):
                    state[:] = part.column("state")[int(k)].as_py()
                part = part.filter(pa.array(turn == 1))
                if part.num_rows:
                    made = step(state, {c: part.column(c).to_numpy(zero_copy_only=False) for c in columns})
                    arrays = [pa.array(made[c], types[t]) for c, t in out.items()]
                    n = len(arrays[0])
                    own = pa.chunked_array([keys] * n).combine_chunks() if n else keys.slice(0, 0)
                    yield pa.RecordBatch.from_arrays([own, *arrays, pa.nulls(n, pa.list_(pa.int64())), pa.array(["row"] * n, pa.string())], names=names)
        yield from ended()

    schema = f"`{key}` {kind}, " + ", ".join(f"{n} {t}" for n, t in out.items()) + ", state array<bigint>, kind string"
    # sorted by the key itself, so that a key's rows lie together and its state comes first
    return given.repartition(key).sortWithinPartitions(key, "turn", *order).mapInArrow(run, schema)


def replay_stream(
    stream: DataFrame, target: str, checkpoint: str, key: str, order: list[str], read: list[str], step: Step, out: dict[str, str],
    newest: str | None = None, span: int = 0, available_now: bool = False,
) -> StreamingQuery:
    """Run ``step`` over a stream; results go to ``target`` and are read by ``read_replayed``.

    With ``newest``, a whole-number column, states fade when their last number is more than ``span`` below the batch's largest.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = f"{target}/batch={batch_id - 1}/kind=state"
        kind = batch.schema[key].dataType.simpleString()
        states = spark.read.schema(f"`{key}` {kind}, state array<bigint>").parquet(before) if batch_id and folder_exists(spark, before) else None
        top = batch.agg(F.max(newest)).first()[0] if newest else None
        done = replayed(batch, states, key, order, read, step, out, None if top is None else top - span)
        done.write.mode("overwrite").partitionBy("kind").parquet(f"{target}/batch={batch_id}")
        if batch_id > 1:  # the batch before may have to be repeated from the states it began with
            remove_folder(spark, f"{target}/batch={batch_id - 2}/kind=state")

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_replayed(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """All rows that ``replay_stream`` made; ``schema`` is that of its key and results."""
    names = [part.split()[0].strip("`") for part in schema.split(",")]
    return spark.read.schema(f"{schema}, kind string, batch bigint").parquet(target).filter("kind = 'row'").select(*names)
