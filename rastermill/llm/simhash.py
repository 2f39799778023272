"""Near-duplicate texts by bit fingerprints and a self-join of binary tries."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastermill.llm.frames import BLANKS, dealt_pairs, linked_groups, map_rows, meetings, merge_labels, text_bytes, whole_tasks
from rastermill.session import pin

SEED = 42
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SLICE = 1 << 16  # shingles counted at once, whatever the length of the text


def fingerprint(text: bytes, shingle: int) -> int:
    """Majority bits of the XXH64 hashes of all word shingles, as a signed 64-bit number."""
    return int.from_bytes(majority(text, shingle, 1), "big", signed=True)


def _more(hashes: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th hash word that follows from each 64-bit hash, by multiplying and folding."""
    h = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def _shingles(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 hashes of all word shingles in order, a slice at a time; a text of fewer words is one shingle."""
    words = text.translate(_FOLD).split()
    if not words:
        return
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate([[0], gaps + 1])
    ends = np.append(gaps, len(joined))
    last = max(len(words) - shingle + 1, 1)
    starts, ends = starts[:last], ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_digest
    for at in range(0, last, _SLICE):
        spans = zip(starts[at : at + _SLICE].tolist(), ends[at : at + _SLICE].tolist())
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in spans])
        yield np.frombuffer(hashes, ">u8").astype(np.uint64)


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The distinct hashes of all word shingles, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *_shingles(text, shingle)]))


def majority(text: bytes, shingle: int, width: int) -> bytes:
    """Majority bits of ``width`` 64-bit hash words of all word shingles; the first word is XXH64."""
    return _majority(_shingles(text, shingle), width)


def _majority(slices: Iterable[np.ndarray], width: int) -> bytes:
    total, counts = 0, np.zeros((width, 64), np.int64)
    for own in slices:
        total += len(own)
        for k in range(width):
            bits = (_more(own, k) if k else own).astype(">u8").view(np.uint8).reshape(-1, 8)
            counts[k] += np.unpackbits(bits, axis=1).sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > total).tobytes()


def fingerprints(items: DataFrame, text: str = "description", shingle: int = 5, out: str = "fingerprint") -> DataFrame:
    """Add the 64-bit fingerprint of each row's whole ``text``; an empty or null text has fingerprint 0."""
    rest = [f for f in items.schema.fields if f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), f"`{out}` bigint"])
    names = [f.name for f in rest]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([fingerprint(t, shingle) for t in text_bytes(batch, text)], pa.int64())
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), found], names=[*names, out])

    return map_rows(items, run, schema)


def _blocks(errors: int) -> list[tuple[int, int]]:
    """``errors + 1`` runs of bits (first bit, width) that cover 64 bits."""
    edges = [round(64 * k / (errors + 1)) for k in range(errors + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _walk(task: np.ndarray, side: np.ndarray, bits: np.ndarray, depth: int, errors: int) -> np.ndarray:
    """Walk pairs of trie nodes of every task at once; a smallest-row label per row.

    Rows are sorted by (task, bits), so a trie node is a range of rows. A pair
    of nodes goes down bit by bit, adding one error where the branches differ,
    and is given up once it has more than ``errors``. Pairs with few leaves are
    compared leaf by leaf. Only the labels of linked rows are kept, so a dense
    group costs as many rows as it has, not as many as its pairs.
    """
    labels = np.arange(len(task))
    first, second = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    a_bits, b_bits = bits[first], bits[second]
    tasks = np.unique(task)
    a_lo, a_hi = np.searchsorted(task[first], tasks), np.searchsorted(task[first], tasks, "right")
    b_lo, b_hi = np.searchsorted(task[second], tasks), np.searchsorted(task[second], tasks, "right")
    twin = side[np.searchsorted(task, tasks)] == 2
    missed = np.zeros(len(tasks), np.int64)
    while len(a_lo):
        few = ((a_hi - a_lo) * (b_hi - b_lo) <= 256) | (depth >= 64)
        for k, a, b in meetings(a_lo[few], a_hi[few], b_lo[few], b_hi[few]):
            near = np.bitwise_count(a_bits[a] ^ b_bits[b]) <= errors
            near &= ~twin[few][k] | (first[a] < second[b])
            labels = merge_labels(labels, first[a[near]], second[b[near]])
        on = ~few
        a_lo, a_hi, b_lo, b_hi, twin, missed = (x[on] for x in (a_lo, a_hi, b_lo, b_hi, twin, missed))
        if not len(a_lo):
            break
        bit = np.uint64(63 - depth)
        a_ones = np.concatenate([[0], np.cumsum((a_bits >> bit) & np.uint64(1))]).astype(np.int64)
        b_ones = np.concatenate([[0], np.cumsum((b_bits >> bit) & np.uint64(1))]).astype(np.int64)
        a_cut, b_cut = a_hi - (a_ones[a_hi] - a_ones[a_lo]), b_hi - (b_ones[b_hi] - b_ones[b_lo])
        none = np.zeros(len(twin), bool)
        branches = [
            (a_lo, a_cut, b_lo, b_cut, twin, missed),
            (a_cut, a_hi, b_cut, b_hi, twin, missed),
            (a_lo, a_cut, b_cut, b_hi, none, missed + 1),
            # in a pair of a node with itself this branch mirrors the one above
            tuple(x[~twin] for x in (a_cut, a_hi, b_lo, b_cut, none, missed + 1)),
        ]
        a_lo, a_hi, b_lo, b_hi, twin, missed = (np.concatenate(x) for x in zip(*branches))
        keep = (a_lo < a_hi) & (b_lo < b_hi) & (missed <= errors)
        a_lo, a_hi, b_lo, b_hi, twin, missed = (x[keep] for x in (a_lo, a_hi, b_lo, b_hi, twin, missed))
        depth += 1
    return labels


def near_fingerprints(prints: DataFrame, errors: int = 4, leaves: int = 2048) -> DataFrame:
    """Links ``(u, v)`` that join all distinct ``fingerprint`` values within ``errors`` differing bits.

    The links form a forest inside every task: whatever is within the error
    budget is connected, directly or over others that are. Two values within
    the budget agree in at least one of ``errors + 1`` blocks of bits, so each
    value enters one trie per block, rotated so that the block leads, and the
    join starts at the pairs of equal leading nodes. A node with more than
    ``leaves`` values is dealt into parts, and every pair of parts is a task.
    """
    blocks = _blocks(errors)
    value = F.col("fingerprint")
    turns = [F.shiftleft(value, a).bitwiseOR(F.shiftrightunsigned(value, 64 - a)) if a else value for a, _ in blocks]
    tries = F.array(*(
        F.struct(F.lit(k).alias("turn"), bits.alias("bits"), F.shiftrightunsigned(bits, 64 - width).alias("node"))
        for k, (bits, (_, width)) in enumerate(zip(turns, blocks))
    ))
    rows = prints.select("fingerprint", F.explode(tries).alias("t")).select("fingerprint", "t.*")
    # at most 2^13 leading nodes per block, whatever the input
    sizes = F.broadcast(rows.groupBy("turn", "node").agg(F.count(F.lit(1)).alias("n")))
    dealt = dealt_pairs(rows.join(sizes, ["turn", "node"]), ["turn", "node"], "n", F.xxhash64("fingerprint", F.lit(SEED)), leaves)
    # unsigned order of the bits is the order of the trie's leaves
    sorted_rows = dealt.select("task", "side", "bits", "fingerprint").repartition("task").sortWithinPartitions(
        "task", F.col("bits").bitwiseXOR(F.lit(-(2**63)))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_tasks(batches):
            task, side, bits, value = (table.column(c).to_numpy() for c in ("task", "side", "bits", "fingerprint"))
            labels = _walk(task, side, bits.astype(np.int64).view(np.uint64), min(w for _, w in blocks), errors)
            moved = np.flatnonzero(labels != np.arange(len(labels)))
            yield pa.RecordBatch.from_arrays([pa.array(value[moved]), pa.array(value[labels[moved]])], names=["u", "v"])

    return sorted_rows.mapInArrow(run, "u bigint, v bigint")


def near_duplicate_groups(
    items: DataFrame, id: str = "id", text: str = "description", shingle: int = 5, errors: int = 4, leaves: int = 2048
) -> DataFrame:
    """``(id, fingerprint, component_id)`` per catalogue row, grouping descriptions that are nearly alike.

    Fingerprints of ``shingle``-word runs link at ``errors`` or fewer differing
    bits; ``component_id`` is the smallest ``id`` reachable over links. Rows with
    equal fingerprints are one node of the join, so a text that owns a third of
    the rows is compared once.

    Null and empty texts have fingerprint 0 and are linked like any other. Null
    ids stay in the result and are never a ``component_id`` unless the whole group
    has none. Repeated rows stay repeated. Other columns are ignored, whatever
    their names. An empty table gives an empty result.
    """
    source = items.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("_text"))
    prints = pin(fingerprints(source, "_text", shingle))
    values = pin(prints.groupBy("fingerprint").agg(F.min("_id").alias("_first")))
    groups = linked_groups(near_fingerprints(values, errors, leaves))
    return _named(prints, values, groups).select(F.col("_id").alias(id), "fingerprint", "component_id")


WIDE = 4  # words of a wide fingerprint
BANDS, BAND = 20, 5  # tables, and smallest hashes that lead a text to its node in one
_TURNS = np.random.default_rng(SEED).integers(1, 2**63, (2, BANDS * BAND, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_LONG = 512  # shingles that weigh as much as a row when tasks are dealt
_FEW = 4096  # pairs compared before groups are looked at again


def similar_errors(similarity: float, slack: float = 3.5) -> int:
    """Differing bits of wide fingerprints to allow for texts whose shingle sets have this Jaccard similarity.

    The share of differing bits is the angle between the shingle vectors over
    pi; ``slack`` standard deviations are added, so that hardly any such pair is missed.
    """
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(64 * WIDE * share + slack * np.sqrt(64 * WIDE * share * (1 - share)))


def band_marks(shingles: np.ndarray) -> np.ndarray:
    """A 32-bit mark per table, of the smallest of the shingles' hashes under ``BAND`` orders."""
    least = np.full(BANDS * BAND, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 4096):
        least = np.minimum(least, ((shingles[at : at + 4096] ^ _TURNS[0]) * _TURNS[1]).min(1))
    marks = np.zeros(BANDS, np.uint64)
    for k in range(BAND):
        marks = _more(marks ^ least[k::BAND], k + 1)
    return (marks >> np.uint64(32)).astype(np.uint32).view(np.int32)


def similar_text_groups(
    items: DataFrame, id: str = "id", text: str = "description", shingle: int = 5, similarity: float = 0.8, leaves: int = 2048,
    walked: int | None = None,
) -> DataFrame:
    """``(id, component_id)`` per catalogue row, grouping descriptions whose shingle sets have Jaccard ``similarity`` or more.

    With ``walked``, texts whose 64-bit fingerprints differ in so many bits or fewer are linked too, found by the walk of tries
    of ``near_fingerprints``; a fingerprint is the first word of the wide one, over distinct shingles. What follows is about the other links.

    Texts of one shingle set are one node. Candidates are pairs that share a node
    in one of ``BANDS`` tables (the smallest hashes of their shingles under
    ``BAND`` orders; two texts of similarity 0.8 share one with a chance of 99.96
    in 100) and whose fingerprints of ``WIDE`` words over distinct shingles differ
    in ``similar_errors`` bits at most. There is no walk of tries here: a table's
    nodes are as many as the texts need, so unlike texts do not meet, however
    many there are. Candidates are linked if their whole shingle sets (64-bit
    hashes) are as similar as wanted, so no link is false. Each pair is compared
    in the first table it shares, unless links of its task join it already; sets
    are sent only to tasks where their text has a candidate. ``component_id`` and
    edge cases are those of ``near_duplicate_groups``.
    """
    errors = similar_errors(similarity)
    source = items.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("_text")).withColumn("_row", F.xxhash64("_text"))

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, shingle) for t in text_bytes(batch, "_text")]
        columns = {
            "_id": batch.column("_id"), "_row": batch.column("_row"), "fingerprint": pa.array([_set_hash(x) for x in sets], pa.int64()),
            "bits": pa.array([_majority([x], WIDE) for x in sets], pa.binary()), "marks": pa.array([band_marks(x) for x in sets], pa.list_(pa.int32())),
            "size": pa.array([len(x) for x in sets], pa.int64()),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kind = source.schema["_id"].dataType.simpleString()
    prints = map_rows(source, hashed, f"_id {kind}, _row bigint, fingerprint bigint, bits binary, marks array<int>, size bigint")
    prints = pin(prints)
    values = pin(prints.groupBy("fingerprint").agg(
        F.min("_id").alias("_first"), F.first("_row").alias("_row"), F.first("bits").alias("bits"), F.first("marks").alias("marks"), F.first("size").alias("size")
    ))
    entries = values.select("fingerprint", "size", F.posexplode("marks").alias("turn", "mark"))
    node = ["turn", "mark"]
    weight = F.greatest(F.col("n"), F.floor(F.col("shingles") / _LONG))
    counts = entries.groupBy(*node).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles")).filter("n > 1")
    counts = pin(counts.select(*node, weight.alias("n")))
    met = entries.select("fingerprint", *node).join(counts, node)
    dealt = dealt_pairs(met, node, "n", F.xxhash64("fingerprint", F.lit(SEED)), leaves).select("task", "side", "turn", "fingerprint")
    rows = dealt.join(values.select("fingerprint", "bits", "marks", "size"), "fingerprint")

    def candidates(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        task, side, turn, size = (table.column(c).to_numpy() for c in ("task", "side", "turn", "size"))
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(-1, WIDE)
        marks = table.column("marks").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        first, second = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        names = np.unique(task)
        ranges = [np.searchsorted(task[s], names, edge) for s in (first, second) for edge in ("left", "right")]
        for _, a, b in meetings(*ranges, most=1 << 18):
            a, b = first[a], second[b]
            on = (side[a] != 2) | (a < b)
            on &= np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b])
            a, b = a[on], b[on]
            apart = sum(np.bitwise_count(bits[a, k] ^ bits[b, k]).astype(np.int16) for k in range(WIDE))
            a, b = a[apart <= errors], b[apart <= errors]
            mine = np.argmax(marks[a] == marks[b], axis=1) == turn[a]
            yield a[mine], b[mine]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_tasks(batches):
            near = np.zeros(table.num_rows, bool)
            for a, b in candidates(table):
                near[a] = near[b] = True
            yield from table.select(["task", "side", "turn", "fingerprint"]).filter(pa.array(near)).combine_chunks().to_batches()

    sorted_rows = rows.repartition("task").sortWithinPartitions("task")
    near = pin(sorted_rows.mapInArrow(meet, "task bigint, side int, turn int, fingerprint bigint"))
    wanted = near.select("fingerprint").distinct().join(values.select("fingerprint", "_row"), "fingerprint")
    # a text per class, to be hashed once more: kept sets would take more room than the texts
    texts = source.select("_row", "_text").join(wanted, "_row").groupBy("fingerprint").agg(F.first("_text").alias("_text"))

    def listed(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, shingle).tobytes() for t in text_bytes(batch, "_text")]
        return pa.RecordBatch.from_arrays([batch.column("fingerprint"), pa.array(sets, pa.binary())], names=["fingerprint", "shingles"])

    sets = pin(map_rows(texts, listed, "fingerprint bigint, shingles binary"))
    compared = near.join(values.select("fingerprint", "bits", "marks", "size"), "fingerprint").join(sets, "fingerprint")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_tasks(batches):
            value, raw = table.column("fingerprint").to_numpy(), table.column("shingles").to_pylist()
            labels, held = np.arange(len(value)), {}

            def shingles(k: int) -> set:
                if k not in held:
                    held[k] = set(np.frombuffer(raw[k], np.uint64).tolist())
                return held[k]

            for pairs in candidates(table):
                for at in range(0, len(pairs[0]), _FEW):
                    a, b = (x[at : at + _FEW] for x in pairs)
                    apart = labels[a] != labels[b]
                    a, b = a[apart], b[apart]
                    both = np.array([len(shingles(x) & shingles(y)) for x, y in zip(a.tolist(), b.tolist())], np.int64)
                    either = np.array([len(shingles(x)) + len(shingles(y)) for x, y in zip(a.tolist(), b.tolist())], np.int64) - both
                    like = both >= similarity * either
                    labels = merge_labels(labels, a[like], b[like])
            moved = np.flatnonzero(labels != np.arange(len(labels)))
            yield pa.RecordBatch.from_arrays([pa.array(value[moved]), pa.array(value[labels[moved]])], names=["u", "v"])

    tasks = compared.repartition("task").sortWithinPartitions("task")
    links = tasks.mapInArrow(link, "u bigint, v bigint")
    if walked is not None:
        links = links.unionByName(_walked_links(values.select("fingerprint", "bits"), walked, leaves))
    groups = linked_groups(links)
    return _named(prints.select("_id", "fingerprint"), values.select("fingerprint", "_first"), groups).select(F.col("_id").alias(id), "component_id")


def _walked_links(values: DataFrame, errors: int, leaves: int) -> DataFrame:
    """Links of texts whose 64-bit words, the first of ``bits``, lie within ``errors`` bits: a walk of tries over distinct words."""
    word = F.conv(F.hex(F.substring("bits", 1, 8)), 16, -10).cast("bigint")
    worded = pin(values.select("fingerprint", word.alias("word")))
    # of texts with one word the first stands for all
    first = pin(worded.groupBy("word").agg(F.min("fingerprint").alias("v")))
    alike = worded.join(first, "word").select(F.col("fingerprint").alias("u"), "v")
    near = near_fingerprints(first.select(F.col("word").alias("fingerprint")), errors, leaves)
    ends = [first.select(F.col("word").alias(end), F.col("v").alias(f"_{end}")) for end in ("u", "v")]
    near = near.join(ends[0], "u").join(ends[1], "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
    return near.unionByName(alike.filter("u <> v"))


def _set_hash(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _named(prints: DataFrame, values: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of ``prints`` with the smallest id of their group."""
    tagged = values.join(groups.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn(
        "root", F.coalesce("root", "fingerprint")
    )
    tagged = pin(tagged)
    first = pin(tagged.groupBy("root").agg(F.min("_first").alias("component_id")))
    named = pin(tagged.join(first, "root").select("fingerprint", "component_id"))
    return prints.join(named, "fingerprint")
