"""How far the nodes of a collection differ in the wording of their items, by bitmaps of terms per count."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rastermill.llm.frames import dealt_pairs, map_tasks, spread_join, text_bytes
from rastermill.session import pin

SCALE = 10**9
SEGMENT = 1024  # terms of a segment, about
NODES = 64  # nodes of a collection that one task pairs with as many others
FEW = 16  # a count that so many terms of a segment or fewer have is kept as a list
HELD = 200_000  # distinct terms a task holds before it hands its counts on

# every byte that is no letter and not above 0x7F becomes a blank, A-Z become small
_TERMS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
_PAIRS = "_c string, a int, b int, value bigint"


def terms_of(text: bytes) -> list[bytes]:
    """Runs of letters and characters above 0x7F, A-Z in small letters."""
    return text.translate(_TERMS).split()


def node_divergence(
    items: DataFrame, collection: str = "collection", node: str = "node_id", text: str = "description", least: int = 10, top: int = 10
) -> DataFrame:
    """``(collection, node, part, item, value, rank)``: divergence between nodes, and the terms that mark each node.

    A collection keeps the V terms that at least ``least`` of its items hold. Every node of the collection, and the
    collection as a whole, gives a kept term that occurs ``count`` times there ``p = 1 + floor(10^9 (count + 2) / (N + 2 V))``,
    N being its sum of counts. Two shares differ by ``floor((p - q)^2 / (p + q))``, all in whole numbers.

    * part ``pair``: ``item`` is each other node of the collection, ``value`` the sum over all kept terms.
    * part ``term``: ``item`` is each term that the node has and whose p is above the collection's; ``top`` ranks.

    The kept terms are cut into segments. A segment holds, for each node and count, the set of its terms with that count,
    as a bitmap, or as a list where few terms share the count. For two nodes, the sizes of the meets of their bitmaps
    are the cells of their joint table; terms that a node lacks come out as the complement. Cells times differences add up
    over the segments. Nodes are dealt into blocks of ``NODES``, so no task depends on how many there are.

    Null texts, collections and nodes count as empty strings. A node without terms has pairs too, a collection without kept terms
    pairs of value 0, one with a single node no pair. Repeated rows count again. Other columns are ignored, whatever
    their names. An empty table gives an empty result. Counts are exact up to 64 bits.
    """
    named = lambda c, to: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to)
    rows = items.select(named(collection, "_c"), named(node, "_s"), named(text, "_t"))
    counted = rows.mapInArrow(_count, "_c string, _s string, term string, n bigint, items bigint")
    counts = pin(counted.groupBy("_c", "_s", "term").agg(F.sum("n").alias("n"), F.sum("items").alias("items")))
    terms = pin(counts.groupBy("_c", "term").agg(F.sum("n").alias("total"), F.sum("items").alias("items")).filter(F.col("items") >= least).drop("items"))
    whole = terms.groupBy("_c").agg(F.count(F.lit(1)).alias("kept"), (F.sum("total") + 2 * F.count(F.lit(1))).alias("all_d"))
    filed = spread_join(terms, whole.select("_c", "kept"), ["_c"], "term")
    filed = filed.withColumn("segment", F.pmod(F.xxhash64("term"), F.ceil(F.col("kept") / SEGMENT)).cast("int")).drop("kept")
    place = Window.partitionBy("_c", "segment")
    filed = filed.withColumn("bit", F.row_number().over(place.orderBy("term")) - 1).withColumn("size", F.count(F.lit(1)).over(place).cast("int"))
    cells = pin(counts.drop("items").join(filed, ["_c", "term"]))

    sums = cells.groupBy("_c", "_s").agg(F.sum("n").alias("n"))
    nodes = rows.select("_c", "_s").distinct().join(sums, ["_c", "_s"], "left").join(whole, "_c", "left")
    by_name = Window.partitionBy("_c")
    nodes = pin(nodes.select(
        "_c", "_s", (F.coalesce("n", F.lit(0)) + 2 * F.coalesce("kept", F.lit(0))).alias("d"), "all_d",
        (F.row_number().over(by_name.orderBy("_s")) - 1).alias("k"), F.count(F.lit(1)).over(by_name).alias("of"),
    ))
    known = spread_join(cells, nodes, ["_c", "_s"], "term")

    share = lambda count, d: F.expr(f"1 + cast({SCALE} as decimal(20,0)) * ({count} + 2) div {d}")
    marks = known.withColumn("p", share("n", "d")).withColumn("q", share("total", "all_d")).filter("p > q")
    marks = marks.withColumn("value", F.expr("(p - q) * (p - q) div (p + q)")).select("_c", "_s", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    ranked = Window.partitionBy("_c", "_s").orderBy(F.col("value").desc(), "item")
    marks = marks.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)

    # every node stands in every segment of its collection, with its terms or without
    segments = cells.select("_c", "segment", "size").distinct()
    grid = spread_join(segments, nodes, ["_c"], "segment").select("_c", "segment", "size", "k", "of", "d", F.lit(-1).alias("bit"), F.lit(0).cast("bigint").alias("n"))
    bare = nodes.filter("all_d IS NULL").select("_c", F.lit(0).alias("segment"), F.lit(0).alias("size"), "k", "of", "d", F.lit(-1).alias("bit"), F.lit(0).cast("bigint").alias("n"))
    entries = known.select("_c", "segment", "size", "k", "of", "d", "bit", "n").unionByName(grid).unionByName(bare)
    entries = entries.withColumn("task", F.xxhash64("_c", "segment", "k")).repartition("_c", "segment").sortWithinPartitions("task", "n", "bit")
    maps = map_tasks(entries, _bitmaps, "_c string, segment int, size int, k int, of bigint, p0 bigint, dense array<bigint>, maps binary, bits array<int>, few array<bigint>")
    dealt = dealt_pairs(pin(maps), ["_c", "segment"], "of", F.col("k"), NODES)
    tasks = dealt.repartition("task").sortWithinPartitions("task")
    found = map_tasks(tasks, _pairs, _PAIRS).groupBy("_c", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    found = found.select("_c", ways.alias("w"), "value").select("_c", "w.*", "value")
    name = lambda k, to: nodes.select("_c", F.col("k").alias(k), F.col("_s").alias(to))
    pairs = found.join(name("a", "_s"), ["_c", "a"]).join(name("b", "item"), ["_c", "b"])
    pairs = pairs.select("_c", "_s", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    return pairs.unionByName(marks).select(F.col("_c").alias(collection), F.col("_s").alias(node), "part", "item", "value", "rank")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each term and items that hold it, by collection and node."""
    counts: dict[tuple, tuple[Counter, Counter]] = {}
    held = 0
    for batch in batches:
        for c, s, t in zip(batch.column("_c").to_pylist(), batch.column("_s").to_pylist(), text_bytes(batch, "_t")):
            times, items = counts.setdefault((c, s), (Counter(), Counter()))
            found, before = terms_of(t), len(times)
            times.update(found)
            items.update(set(found))
            held += len(times) - before
            if held > HELD:
                yield _counted(counts)
                counts, held = {}, 0
    yield _counted(counts)


def _counted(counts: dict[tuple, tuple[Counter, Counter]]) -> pa.RecordBatch:
    rows = [(c, s, t.decode(), n, items[t]) for (c, s), (times, items) in counts.items() for t, n in times.items()]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(col, kind) for col, kind in zip(zip(*rows) if rows else [()] * 5, kinds)], names=["_c", "_s", "term", "n", "items"]
    )


def _bitmaps(part: pa.Table) -> Iterator[pa.RecordBatch]:
    """A row per node of a segment: bitmaps of the counts many terms share, and lists of the others, counts given as shares."""
    task, bit, n = (part.column(c).to_numpy() for c in ("task", "bit", "n"))
    starts = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
    out = []
    for lo, hi in zip(starts, [*starts[1:], len(task)]):
        c, segment, size, k, of, d = (part.column(x)[int(lo)].as_py() for x in ("_c", "segment", "size", "k", "of", "d"))
        share = lambda count, d=d: 1 + SCALE * (int(count) + 2) // d if d else 1
        # the node's own row, of bit -1 and count 0, comes first
        levels, first, many = np.unique(n[lo + 1 : hi], return_index=True, return_counts=True)
        words = -(-size // 64)
        dense, maps, bits, few = [], [], [], []
        for level, at, m in zip(levels, first, many):
            terms = bit[lo + 1 + at : lo + 1 + at + m]
            if m > FEW:
                flags = np.zeros(words * 64, bool)
                flags[terms] = True
                dense.append(share(level))
                maps.append(np.packbits(flags).tobytes())
            else:
                bits += terms.tolist()
                few += [share(level)] * int(m)
        out.append((c, segment, size, k, of, share(0), dense, b"".join(maps), bits, few))
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
    names = ["_c", "segment", "size", "k", "of", "p0", "dense", "maps", "bits", "few"]
    yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*out), kinds)], names=names)


def differ(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class _Block:
    """Some nodes of a segment: their bitmaps below one another, and the terms of rare counts."""

    def __init__(self, rows: list[dict], size: int):
        words = -(-size // 64)
        self.k = [r["k"] for r in rows]
        self.p0 = np.array([r["p0"] for r in rows], np.int64)
        self.p = np.repeat(self.p0[:, None], size, 1)  # share of each term of a rare count, else that of count 0
        self.few = np.zeros((len(rows), size), bool)
        maps, shares, starts = [], [], []
        for i, r in enumerate(rows):
            self.few[i, r["bits"]] = True
            self.p[i, r["bits"]] = r["few"]
            rare = np.zeros(words * 64, bool)
            rare[r["bits"]] = True
            starts.append(len(shares))
            maps += [r["maps"], np.packbits(rare).tobytes()]
            shares += [*r["dense"], 1]  # the last map of a node holds its rare terms, whose shares differ
        self.starts = np.array([*starts, len(shares)])
        self.maps = np.frombuffer(b"".join(maps), np.uint64).reshape(len(shares), words)
        self.shares = np.array(shares, np.int64)
        for i, (lo, hi) in enumerate(zip(self.starts[:-1], self.starts[1:] - 1)):
            for level in range(lo, hi):
                self.p[i, np.unpackbits(self.maps[level].view(np.uint8))[:size].astype(bool)] = self.shares[level]
        self.sizes = np.bitwise_count(self.maps).sum(1, dtype=np.int64)
        self.where, self.bit = np.nonzero(self.few)

    def against(self, i: int, other: _Block, size: int) -> np.ndarray:
        """Divergence of node ``i`` from every node of ``other``."""
        lo, hi = self.starts[i], self.starts[i + 1]
        # cells of the joint table: sizes of the meets, a row per count of node i, a column per count of each other node
        joint = np.stack([np.bitwise_count(other.maps & m).sum(1, dtype=np.int64) for m in self.maps[lo:hi]])
        by_node = np.add.reduceat(joint, other.starts[:-1], axis=1)
        p, p0 = self.shares[lo:hi], self.p0[i]
        cost = differ(p[:, None], other.shares[None, :]) * joint
        cost[-1] = 0
        cost[:, other.starts[1:] - 1] = 0
        total = np.add.reduceat(cost.sum(0), other.starts[:-1])
        # terms that one of the two lacks, and terms that both lack
        total += (differ(p[:-1, None], other.p0[None, :]) * (self.sizes[lo : hi - 1, None] - by_node[:-1])).sum(0)
        lacks = other.sizes - joint.sum(0)
        mine = differ(p0, other.shares) * lacks
        mine[other.starts[1:] - 1] = 0
        total += np.add.reduceat(mine, other.starts[:-1])
        total += differ(p0, other.p0) * (size - self.sizes[lo:hi].sum() - np.add.reduceat(lacks, other.starts[:-1]))
        # terms of a rare count on either side, one by one
        rare = np.flatnonzero(self.few[i])
        total += differ(self.p[i, rare][None, :], other.p[:, rare]).sum(1)
        new = ~self.few[i, other.bit]
        where, bit = other.where[new], other.bit[new]
        np.add.at(total, where, differ(self.p[i, bit], other.p[where, bit]))
        return total


def _pairs(part: pa.Table) -> Iterator[pa.RecordBatch]:
    task = part.column("task").to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
    for lo, hi in zip(starts, [*starts[1:], len(task)]):
        rows = part.slice(int(lo), int(hi - lo)).to_pylist()
        size = rows[0]["size"]
        sides = [_Block([r for r in rows if r["side"] in kinds], size) for kinds in ((0, 2), (1, 2))]
        a, b, value = [], [], []
        for i, k in enumerate(sides[0].k):
            if not sides[1].k:
                break
            total = sides[0].against(i, sides[1], size)
            for other, v in zip(sides[1].k, total.tolist()):
                if rows[0]["side"] != 2 or k < other:
                    a.append(min(k, other))
                    b.append(max(k, other))
                    value.append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array([rows[0]["_c"]] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(value, pa.int64())],
            names=["_c", "a", "b", "value"],
        )
