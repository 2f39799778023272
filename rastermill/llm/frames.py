"""Plan shapes that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastermill.session import pin

BLANKS = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def linked_groups(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(u, v)``; the root is the smallest node reachable.

    Alternating star steps: each node hands its larger neighbours to its
    smallest one, then its smaller neighbours, until every node points at its
    root. Minima combine before the shuffle and are written down before they
    are joined, so adaptive execution can split the joins at a crowded root.
    """
    pairs = pin(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _fingerprint(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = pin(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = pin(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = pin(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = pin(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _fingerprint(pairs)
        if state == before:
            break
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _fingerprint(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def dealt_pairs(rows: DataFrame, keys: list[str], count: str, part: Column, most: int) -> DataFrame:
    """Deal every key's rows into parts of about ``most`` rows and every pair of parts to a task of its own.

    Adds ``task`` and ``side``: 2 marks a row of a task that meets its own
    part, 0 and 1 the two parts of a task that lets them meet each other. Any
    two rows of a key meet in exactly one task, and no task holds more than
    two parts, however crowded the key is. ``count`` is the key's row count,
    ``part`` a hash of the row.
    """
    parts = F.ceil(F.col(count) / F.lit(most)).cast("int")
    own = F.pmod(part, F.col("_parts")).cast("int")
    met = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    return (
        rows.withColumn("_parts", parts).withColumn("_own", own).withColumn("_met", met)
        .withColumn("task", F.xxhash64(*keys, F.least("_own", "_met"), F.greatest("_own", "_met")))
        .withColumn("side", F.when(F.col("_own") == F.col("_met"), 2).when(F.col("_own") < F.col("_met"), 0).otherwise(1).cast("int"))
        .drop("_parts", "_own", "_met", count)
    )


def whole_tasks(batches: Iterator[pa.RecordBatch], key: str = "task") -> Iterator[pa.Table]:
    """Batches sorted by ``key`` as tables that never cut a key's rows apart."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def merge_labels(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest-label components after adding the links ``u[k]``-``v[k]``; ``labels`` point at roots."""
    while True:
        a, b = labels[u], labels[v]
        apart = a != b
        if not apart.any():
            return labels
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels = jumped


def meetings(a_from: np.ndarray, a_to: np.ndarray, b_from: np.ndarray, b_to: np.ndarray, most: int = 1 << 20) -> Iterator[tuple]:
    """Index pairs ``(k, a, b)`` of all ranges ``k``, in slices of about ``most`` pairs."""
    a_size, b_size = a_to - a_from, b_to - b_from
    # a range with more pairs than a slice holds is cut along its first side
    rows = np.maximum(most // np.maximum(b_size, 1), 1)
    cuts = -(-a_size // rows)
    k = np.repeat(np.arange(len(a_from)), cuts)
    nth = np.arange(len(k)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    lo = a_from[k] + nth * rows[k]
    hi = np.minimum(lo + rows[k], a_to[k])
    pairs = (hi - lo) * b_size[k]
    slices = np.cumsum(pairs) // most
    for s in np.unique(slices):
        at = np.flatnonzero((slices == s) & (pairs > 0))
        if not len(at):
            continue
        n = pairs[at]
        entry = np.repeat(np.arange(len(at)), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = b_size[k[at]][entry]
        yield k[at][entry], lo[at][entry] + inner // wide, b_from[k[at]][entry] + inner % wide


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str, rows: int = 500) -> DataFrame:
    """``mapInArrow`` over slices of at most ``rows`` rows, so that long texts are never all unpacked at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                out = fn(batch.slice(start, rows))
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


def map_tasks(df: DataFrame, fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over rows sorted by ``task``, whose rows ``fn`` gets together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_tasks(batches):
            yield from fn(part)

    return df.mapInArrow(run, schema)


def spread_join(left: DataFrame, lookup: DataFrame, keys: list[str], spread: str, salts: int = 64) -> DataFrame:
    """Inner join with a lookup of few keys, each of which may own a large share of ``left``: its rows are spread by ``spread``."""
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"]).drop("_salt")


def text_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes per row, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.large_binary()).to_pylist()]
