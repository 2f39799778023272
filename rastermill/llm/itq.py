"""Near-duplicate vectors by learned binary codes and multi-index Hamming tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rastermill.llm.frames import dealt_pairs, linked_groups, meetings, merge_labels, whole_tasks
from rastermill.session import pin

BITS, BLOCKS = 64, 8
TABLES = list(combinations(range(BLOCKS), 2))
SAMPLE = 4096


def learn_rotation(sample: np.ndarray, rounds: int = 50, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """``(mean, projection)`` of unit vectors: principal axes, rotated so that signs lie close to the values.

    Vectors with fewer than 64 numbers are first spread over 64 random axes.
    """
    r = np.random.default_rng(seed)
    mean = sample.mean(0) if len(sample) else np.zeros(sample.shape[1])
    centred = sample - mean
    if sample.shape[1] >= BITS:
        axes = np.linalg.eigh(centred.T @ centred + 1e-9 * np.eye(sample.shape[1]))[1][:, ::-1][:, :BITS]
    else:
        axes = r.normal(size=(sample.shape[1], BITS)) / np.sqrt(BITS)
    values = centred @ axes
    turn = np.linalg.qr(r.normal(size=(BITS, BITS)))[0]
    for _ in range(rounds if len(sample) else 0):
        u, _, w = np.linalg.svd(values.T @ np.where(values @ turn >= 0, 1.0, -1.0))
        turn = u @ w
    return mean, axes @ turn


def codes(unit: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """64 sign bits of each unit vector."""
    return np.packbits((unit - mean) @ projection >= 0, axis=1).view(">u8").ravel().astype(np.uint64)


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as doubles, zero where one can't be compared, and which can."""
    rows = column.to_pylist()
    right = np.array([r is not None and len(r) == size and None not in r for r in rows], bool)
    out = np.zeros((len(rows), size))
    if right.any():
        out[right] = np.array([r for r, ok in zip(rows, right) if ok], np.float64)
    right &= np.isfinite(out).all(1)
    out[~right] = 0
    return out, right & (np.abs(out).max(1, initial=0) > 0)


def _unit(matrix: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither overflow nor vanish
    scaled = matrix / np.maximum(np.abs(matrix).max(1, keepdims=True, initial=0), np.finfo(float).tiny)
    return scaled / np.maximum(np.sqrt((scaled * scaled).sum(1, keepdims=True)), 1e-300)


def _by_size(whole: pa.Table) -> Iterator[pa.Table]:
    sizes = whole.column("size").to_numpy()
    for size in np.unique(sizes):
        yield whole.filter(pa.array(sizes == size))


def near_duplicate_vectors(
    tiles: DataFrame, id: str = "id", vector: str = "pixels", label: str = "band", least: float = 0.98, radius: int = 16, most: int = 1024
) -> DataFrame:
    """``(id, n_links, component_id, kept)`` per tile: tiles of one band whose pixel vectors have cosine ``least`` or more.

    Equal vectors of a band are one class. For each length of vectors, of which
    there are few, a rotation for balanced sign codes is learned on at most
    ``SAMPLE`` classes, those with the smallest hashes; every class gets a 64-bit
    code. Vectors of different lengths have no cosine and never meet. Codes
    are filed by every pair of their eight bytes, so codes that agree in two
    bytes meet (any with up to six differing bits, most with more). Pairs within
    ``radius`` bits are compared by cosine in double precision, in the first table
    they share only, so links are counted once. Crowded buckets are dealt into
    parts of ``most`` classes. Links leave a task as sums and a forest, never as pairs.

    Links are approximate in one direction: none is false, and few are missed
    (recall is tested). ``component_id`` is the smallest id reachable, itself
    included; ids may be of any type that has an order. Vectors that are null, zero, or hold
    null or non-finite numbers link with nothing, as do rows without a label or
    id. Repeated rows count like other rows; rows of one id are one node. Other
    columns are ignored, whatever their names. An empty table gives an empty result.
    """
    value = F.col(vector).cast("array<double>")
    rows = tiles.select(F.col(id).alias("_id"), F.col(label).cast("string").alias("_label"), value.alias("_vector"))
    rows = rows.withColumn("k1", F.xxhash64("_label", "_vector")).withColumn("k2", F.xxhash64(F.lit(1), "_vector", "_label"))
    valid = rows.filter("_id IS NOT NULL AND _label IS NOT NULL AND _vector IS NOT NULL")
    classes = pin(valid.groupBy("k1", "k2", "_label").agg(F.min("_id").alias("_id"), F.count(F.lit(1)).alias("n"), F.first("_vector").alias("_vector")))
    size = F.size("_vector")
    lengths = {r.size: r.n for r in classes.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n")).filter("size > 0").collect()}
    smallest = Window.partitionBy("size").orderBy("k1", "k2")
    shares = F.create_map(*[F.lit(x) for k, n in lengths.items() for x in (k, int(min(1.0, 2 * SAMPLE / n) * 2**53))]).cast("map<int,bigint>")
    drawn = classes.select("k1", "k2", "_vector", size.alias("size")).filter(F.shiftrightunsigned("k1", 11) < F.element_at(shares, F.col("size")))
    drawn = drawn.withColumn("nth", F.row_number().over(smallest)).filter(F.col("nth") <= SAMPLE).orderBy("size", "nth")
    samples: dict[int, list] = {k: [] for k in lengths}
    for r in drawn.select("size", "_vector").collect() if lengths else []:
        samples[r.size].append(r._vector)
    learned = {}
    for k, sample in samples.items():
        matrix, right = _matrix(pa.array(sample, pa.list_(pa.float64())), k)
        # a single class meets no other, and needs no code
        learned[k] = learn_rotation(_unit(matrix[right])) if lengths[k] > 1 else (np.zeros(k), np.zeros((k, BITS)))

    kind = classes.schema["_id"].dataType.simpleString()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([-1 if v is None else v for v in batch.column("_vector").value_lengths().to_pylist()], np.int64)
            for k in np.unique(sizes):
                if int(k) not in learned:
                    continue
                part = batch.take(pa.array(np.flatnonzero(sizes == k)))
                matrix, right = _matrix(part.column("_vector"), int(k))
                unit = _unit(matrix[right])
                out = [part.column(c).take(pa.array(np.flatnonzero(right))) for c in ("k1", "k2", "_label", "_id", "n")]
                code = codes(unit, *learned[int(k)]).view(np.int64) if len(unit) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*out, pa.array(np.full(len(unit), k, np.int32)), pa.array(code), pa.array([u.tobytes() for u in unit], pa.binary())],
                    names=["k1", "k2", "_label", "_id", "n", "size", "code", "unit"],
                )

    filed = pin(classes.mapInArrow(coded, f"k1 bigint, k2 bigint, _label string, _id {kind}, n bigint, size int, code bigint, unit binary"))
    byte = lambda b: F.shiftrightunsigned("code", 8 * (BLOCKS - 1 - b)).bitwiseAND(255)
    tables = F.array(*(F.struct(F.lit(t).alias("t"), (byte(a) * 256 + byte(b)).alias("bucket")) for t, (a, b) in enumerate(TABLES)))
    entries = filed.select("k1", "k2", "_label", "size", F.explode(tables).alias("e")).select("k1", "k2", "_label", "size", "e.*")
    bucket = ["_label", "size", "t", "bucket"]
    counts = pin(entries.groupBy(*bucket).agg(F.count(F.lit(1)).alias("m")).filter("m > 1"))
    dealt = dealt_pairs(entries.join(counts, bucket), bucket, "m", F.col("k2"), most)
    units = filed.select("k1", "k2", "_id", "n", "size", "code", "unit")
    tasks = dealt.select("task", "side", "t", "k1", "k2").join(units, ["k1", "k2"]).repartition("task").sortWithinPartitions("task")
    pairs = np.array(TABLES)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (same for whole in whole_tasks(batches) for same in _by_size(whole)):
            task, side, table, k1, k2, n, code = (part.column(c).to_numpy() for c in ("task", "side", "t", "k1", "k2", "n", "code"))
            ids, size = part.column("_id").combine_chunks(), part.column("size")[0].as_py()
            unit = np.frombuffer(b"".join(part.column("unit").to_pylist()), np.float64).reshape(len(task), size)
            code = code.astype(np.int64).view(np.uint64)
            first, second = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            names = np.unique(task)
            ranges = [np.searchsorted(task[s], names, edge) for s in (first, second) for edge in ("left", "right")]
            links, labels = np.zeros(len(task), np.int64), np.arange(len(task))
            for _, a, b in meetings(*ranges):
                a, b = first[a], second[b]
                apart = code[a] ^ code[b]
                near = ((side[a] != 2) | (a < b)) & (np.bitwise_count(apart) <= radius)
                a, b, apart = a[near], b[near], apart[near]
                same = apart[:, None] >> np.arange(56, -8, -8, dtype=np.uint64) & np.uint64(255) == 0
                order = np.cumsum(same, axis=1)
                lead = pairs[table[a]]
                at = np.arange(len(a))
                mine = same[at, lead[:, 0]] & same[at, lead[:, 1]] & (order[at, lead[:, 0]] == 1) & (order[at, lead[:, 1]] == 2)
                a, b = a[mine], b[mine]
                close = np.einsum("ij,ij->i", unit[a], unit[b]) >= least
                a, b = a[close], b[close]
                np.add.at(links, a, n[b])
                np.add.at(links, b, n[a])
                labels = merge_labels(labels, a, b)
            on = np.flatnonzero(links)
            out = [pa.array(k1[on]), pa.array(k2[on]), pa.array(links[on]), ids.take(pa.array(on)), ids.take(pa.array(labels[on]))]
            yield pa.RecordBatch.from_arrays(out, names=["k1", "k2", "links", "u", "v"])

    found = pin(tasks.mapInArrow(compare, f"k1 bigint, k2 bigint, links bigint, u {kind}, v {kind}"))
    linked = found.groupBy("k1", "k2").agg(F.sum("links").alias("links"))
    groups = linked_groups(found.select("u", "v"))
    known = filed.select("k1", "k2", "n", F.col("_id").alias("_class")).join(linked, ["k1", "k2"], "left")
    known = pin(known.join(groups, F.col("_class") == F.col("node"), "left").select(
        "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "_class").alias("component_id")
    ))
    # rows without an id, a label or a vector have hashes too, but are in no class
    keyed = rows.select("_id", F.when(F.col("_id").isNotNull(), F.col("k1")).alias("k1"), "k2")
    return keyed.join(known, ["k1", "k2"], "left").select(
        F.col("_id").alias(id), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "_id").alias("component_id"),
        F.col("_id").eqNullSafe(F.coalesce("component_id", "_id")).alias("kept"),
    )
