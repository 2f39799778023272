import gc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rastermill.operators import tiles

EDGE = 512


def given(n):
    """A batch of full-size tiles as a task reads it: all its columns lie in one piece of memory."""
    data = [np.full(EDGE * EDGE, k, "uint16").tobytes() if k % 5 else None for k in range(n)]
    made = pa.record_batch({"sha": pa.array([f"s{k}" for k in range(n)]), "data": pa.array(data, pa.binary())})
    return pa.ipc.open_stream(pa.BufferReader(_stream(made))).read_next_batch()


def _stream(batch):
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue()


class Chunks:
    """Stands for a table, to get at what a task runs."""

    def __init__(self, df):
        self.schema, self.sparkSession = df.schema, df.sparkSession

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_a_task_decodes_few_full_size_tiles_at_a_time(spark):
    run = tiles.decode_tile(Chunks(spark.createDataFrame([], "sha string, data binary")), "uint16", "float")
    batch_bytes = 40 * EDGE * EDGE * 2
    held = []

    def batches():
        for _ in range(2):
            gc.collect()
            held.append(pa.total_allocated_bytes())
            yield given(40)

    found, out = [], None
    for out in run(batches()):
        assert out.num_rows * EDGE * EDGE * 2 <= 3 * tiles.SLICE
        found += zip(out.column("sha").to_pylist(), [None if not p.is_valid else (len(p.values), p.values[0].as_py()) for p in out.column("pixels")])
    assert found == [(f"s{k}", (EDGE * EDGE, float(k)) if k % 5 else None) for k in range(40)] * 2
    # when the second batch is asked for, the first is gone
    assert held[1] - held[0] < batch_bytes / 2


@pytest.mark.parametrize("most", [1, 100, 1 << 22])
def test_slices_change_nothing(spark, monkeypatch, most):
    monkeypatch.setattr(tiles, "SLICE", most)
    rows = [(k, [*range(k % 7)] if k % 4 else None) for k in range(1, 50)]
    df = spark.createDataFrame(rows, "id int, pixels array<int>").filter(F.col("pixels").isNotNull())
    encoded = tiles.encode_tile(df)
    assert {r.id: bytes(r.data) for r in encoded.collect()} == {k: np.array(p, "uint16").tobytes() for k, p in rows if p is not None}
    again = tiles.decode_tile(encoded.unionByName(spark.createDataFrame([(99, None)], "id int, data binary")), "uint16", "int")
    assert {r.id: r.pixels for r in again.collect()} == {k: p for k, p in rows if p is not None} | {99: None}
    assert tiles.decode_tile(encoded.limit(0), "uint16").collect() == []


def test_batches_of_full_size_tiles_are_small(spark):
    """Of 64 chunks of 512 KB in one partition no more than about 8 MB come to Python at once, unless the session says otherwise."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    chunks = spark.range(64, numPartitions=1).select("id", F.expr(f"unhex(repeat('0100', {EDGE * EDGE}))").alias("data"))

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch({"n": pa.array([batch.num_rows], pa.int64())})

    spark.conf.unset(key)
    try:
        tiles.decode_tile(chunks, "uint16", "float")
        assert max(r.n for r in chunks.mapInArrow(sizes, "n bigint").collect()) <= 18
        spark.conf.set(key, "16m")
        tiles.decode_tile(chunks, "uint16", "float")
        assert spark.conf.get(key) == "16m"
    finally:
        spark.conf.unset(key)
