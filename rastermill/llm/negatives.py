"""Hard negatives for band tiles: alike by whole-number scores, but of another band."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastermill.session import pin

GROUP = 8  # components of a table of subset sums
HELD = 1 << 18  # found rows a task keeps before it sorts out the best
TABLES = 1 << 23  # bytes of subset sums that are used together
WAVE = 1 << 19  # components of the anchors that travel together
ROWS = 1 << 13  # tiles of a task


def bit_planes(whole: np.ndarray) -> tuple[int, bytes]:
    """Two's complement of whole numbers as bit planes, lowest first: how many, and a byte per plane and eight numbers."""
    low, high = (int(whole.min()), int(whole.max())) if len(whole) else (0, 0)
    planes = 1 + max(high.bit_length(), (-low - 1).bit_length() if low < 0 else 0)
    bits = (whole[None, :] >> np.arange(planes)[:, None]) & 1
    return planes, np.packbits(bits.astype(bool), axis=1, bitorder="little").tobytes()


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """``[group, byte, anchor]``: the sum of the anchor's components at the bits of the byte, for each eight components."""
    n, size = anchors.shape
    groups = -(-size // GROUP)
    padded = np.zeros((n, groups * GROUP), np.int64)
    padded[:, :size] = anchors
    parts = padded.reshape(n, groups, GROUP).transpose(1, 2, 0)
    sums = np.zeros((groups, 1, n), np.int64)
    for k in range(GROUP):  # each component doubles the table
        sums = np.concatenate([sums, sums + parts[:, k : k + 1]], axis=1)
    return sums


def scores(sums: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
    """``[tile, anchor]``: inner products from ``bytes_[plane, tile, group]``, highest plane (the sign) first by shift and add."""
    total = np.zeros((bytes_.shape[1], sums.shape[2]), sums.dtype)
    part = np.empty_like(total)
    for plane in range(len(bytes_) - 1, -1, -1):
        total <<= 1
        for g in range(sums.shape[0]):
            np.take(sums[g], bytes_[plane, :, g], axis=0, out=part)
            if plane == len(bytes_) - 1:
                total -= part
            else:
                total += part
    return total


class _Block:
    """Anchors of one vector length whose tables fit together."""

    def __init__(self, at: np.ndarray, anchors: np.ndarray):
        self.at, self.sums = at, subset_sums(anchors)
        self.reach = int(np.abs(anchors).sum(1).max(initial=0))
        self.narrow = self.sums.astype(np.int32) if self.reach < 2**31 else None

    def scores(self, bytes_: np.ndarray) -> np.ndarray:
        bound = self.reach << len(bytes_)
        if bound >= 2**63:
            raise ValueError("scores of these vectors do not fit 64-bit whole numbers")
        return scores(self.narrow if bound < 2**31 else self.sums, bytes_)


def _blocks(vectors: list[np.ndarray], at: np.ndarray) -> list[tuple[int, _Block]]:
    out = []
    sizes = np.array([len(vectors[i]) for i in at], np.int64)
    for size in np.unique(sizes):
        own = at[sizes == size]
        step = max(1, TABLES // (max(1, -(-int(size) // GROUP)) * 256 * 4))
        for lo in range(0, len(own), step):
            part = own[lo : lo + step]
            out.append((int(size), _Block(part, np.array([vectors[i] for i in part], np.int64).reshape(len(part), int(size)))))
    return out


class _Best:
    """The ``most`` best rows of each slot, by score and then by id; rows come in the order of their ids."""

    def __init__(self, slots: int, most: int, lowest: np.ndarray, kind: pa.DataType):
        self.most, self.kind, self.lowest = most, kind, lowest.copy()
        self.empty = pa.table({"slot": pa.array([], pa.int32()), "score": pa.array([], pa.int64()), "id": pa.array([], kind)})
        self.held, self.new = self.empty, []
        self.waiting = 0

    def add(self, slot: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        if len(slot):
            self.new.append(pa.table({"slot": pa.array(slot, pa.int32()), "score": pa.array(score, pa.int64()), "id": ids}))
            self.waiting += len(slot)
            if self.waiting > HELD:
                self.settle()

    def settle(self) -> pa.Table:
        if self.new:
            rows = pa.concat_tables([self.held, *self.new]).sort_by([("slot", "ascending"), ("score", "descending"), ("id", "ascending")])
            slot = rows.column("slot").to_numpy()
            nth = np.arange(len(slot)) - np.searchsorted(slot, slot)
            self.held, self.new, self.waiting = rows.take(pa.array(np.flatnonzero(nth < self.most))), [], 0
            full = nth == self.most - 1
            # a later row has a larger id, so it must have a higher score than the last of a full slot
            self.lowest[slot[full]] = np.maximum(self.lowest[slot[full]], rows.column("score").to_numpy()[full] + 1)
        return self.held


def _chunks(batch: pa.RecordBatch, rows: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(size, rows, planes)`` for slices of rows that agree in length and number of planes, in order within each kind."""
    size, planes = (batch.column(c).to_numpy() for c in ("size", "planes"))
    kinds = size.astype(np.int64) << 8 | planes
    for kind in np.unique(kinds):
        at = np.flatnonzero(kinds == kind)
        groups = -(-int(kind >> 8) // GROUP)
        for lo in range(0, len(at), rows):
            part = at[lo : lo + rows]
            data = np.frombuffer(b"".join(batch.column("bits").take(pa.array(part)).to_pylist()), np.uint8)
            yield int(kind >> 8), part, np.ascontiguousarray(data.reshape(len(part), int(kind & 255), groups).transpose(1, 0, 2))


def hard_negatives(
    tiles: DataFrame, anchor: Column, id: str = "id", vector: str = "pixels", label: str = "band",
    scale: float = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for every tile where ``anchor`` holds.

    Each component x of ``vector`` becomes ``floor(scale x)``; a tile's score is its whole-number inner product with the
    anchor. Higher scores come first, of equal ones the smaller id. The positives of an anchor are its first ``positives``
    other tiles of the same band. For each of them, the first ``negatives`` tiles of other bands are returned whose score
    is from ``low`` to ``high`` percent of the positive's. Fewer are returned where there are fewer.

    Every tile is kept as packed bit planes of its components. For an anchor, tables hold the sum of every subset of eight
    neighbouring components, so a byte of a plane finds its share of the score, and planes add up by shifts. Scores are
    exact, and no pair is left out. Anchors go to the tasks in waves of ``WAVE`` components; tiles stay where they are.
    Tasks return the best tiles of each anchor they have seen, and only these meet. A band or a tile that owns a third of
    all rows changes nothing in that.

    Tiles without id, label or vector, or with null or non-finite components, take no part. Vectors of different lengths have
    no score with each other; empty vectors all score 0. Rows equal in id, label and vector count once; of other rows with
    one id, none is a partner of another. Other columns are ignored, whatever their names. An empty table, or one without
    anchors, gives an empty result. Scores beyond 64 bits are an error.
    """
    kind = tiles.schema[id].dataType
    text = kind.simpleString()
    value = F.col(vector).cast("array<double>")
    rows = tiles.select(F.col(id).alias("_id"), F.col(label).cast("string").alias("_label"), value.alias("_vector"), F.coalesce(anchor, F.lit(False)).alias("_anchor"))
    wrong = F.exists("_vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("_id").isNotNull() & F.col("_label").isNotNull() & F.col("_vector").isNotNull()).filter(~wrong)
    rows = rows.groupBy("_id", "_label", "_vector").agg(F.max("_anchor").alias("_anchor"))
    coded = "_id {0}, _label string, _anchor boolean, size int, planes int, bits binary, whole array<bigint>".format(text)
    filed = pin(rows.mapInArrow(lambda batches: _planes(batches, scale), coded))
    total, anchors, reach = filed.agg(F.count(F.lit(1)), F.count_if("_anchor"), F.sum(F.when(F.col("_anchor"), F.col("size") + 1))).first()
    parts = max(1, -(-total // ROWS))
    # in the order of ids, so that of equal scores those found first stay
    filed = pin(filed.repartition(parts, F.xxhash64("_id", "bits")).sortWithinPartitions("_id"))
    waves = max(1, -(-(reach or 0) // WAVE))
    place = F.pmod(F.xxhash64("whole", "_id"), F.lit(waves))
    found = None
    for wave in range(waves if anchors else 0):
        own = filed.filter("_anchor").filter(place == wave).select("_id", "_label", "whole").collect()  # bounded by WAVE
        if own:
            part = _wave(filed, own, kind, text, positives, negatives, low, high)
            found = part if found is None else found.unionByName(part)
    schema = f"anchor_id {text}, positive_id {text}, rank int, negative_id {text}, positive_score bigint, negative_score bigint"
    return tiles.sparkSession.createDataFrame([], schema) if found is None else found


def _planes(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, planes, bits, whole = [], [], [], []
        for v, is_anchor in zip(batch.column("_vector"), batch.column("_anchor").to_pylist()):
            x = np.floor(scale * v.values.to_numpy(zero_copy_only=False)) if len(v.values) else np.zeros(0)
            if len(x) and np.abs(x).max() >= 2**53:
                raise ValueError("scores of these vectors do not fit 64-bit whole numbers")
            x = x.astype(np.int64)
            n, packed = bit_planes(x)
            size.append(len(x))
            planes.append(n)
            bits.append(packed)
            whole.append(x if is_anchor else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("_label"), batch.column("_anchor"), pa.array(size, pa.int32()), pa.array(planes, pa.int32()),
             pa.array(bits, pa.binary()), pa.array(whole, pa.list_(pa.int64()))],
            names=["_id", "_label", "_anchor", "size", "planes", "bits", "whole"],
        )


def _wave(filed: DataFrame, own: list, kind, text: str, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """Positives, then negatives, of some anchors against all tiles."""
    context = filed.sparkSession.sparkContext
    arrow = filed.select("_id").limit(0).toArrow().schema.field(0).type
    own = sorted(own, key=lambda r: (r._label, r._id, list(r.whole)))
    shared = context.broadcast(([r._id for r in own], [r._label for r in own], [np.array(r.whole, np.int64) for r in own]))
    narrow = filed.select("_id", "_label", "size", "planes", "bits")
    schema = f"slot int, score bigint, _id {text}"

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors = shared.value
        ids, names = pa.array(ids, arrow), np.array(labels, object)
        blocks = {name: _blocks(vectors, np.flatnonzero(names == name)) for name in set(labels)}
        best = _Best(len(labels), positives, np.full(len(labels), np.iinfo(np.int64).min), arrow)
        for batch in batches:
            here = batch.column("_label").to_pylist()
            order = np.array(here, object)
            for name in set(here) & set(blocks):
                at = np.flatnonzero(order == name)
                part = batch.take(pa.array(at))
                for size, rows, planes in _chunks(part, 256):
                    for _, block in (b for b in blocks[name] if b[0] == size):
                        found = block.scores(planes)
                        tile, slot = np.nonzero(found >= best.lowest[block.at])
                        score, slot = found[tile, slot].astype(np.int64), block.at[slot]
                        tile_ids = part.column("_id").take(pa.array(rows[tile]))
                        other = pa.compute.not_equal(tile_ids, ids.take(pa.array(slot))).to_numpy(zero_copy_only=False)
                        best.add(slot[other], score[other], tile_ids.filter(pa.array(other)))
        yield from best.settle().rename_columns(["slot", "score", "_id"]).combine_chunks().to_batches()

    first = Window.partitionBy("slot").orderBy(F.col("score").desc(), "_id")
    ranked = narrow.mapInArrow(near, schema).withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= positives)
    pairs = sorted(ranked.collect(), key=lambda r: (r.slot, r.nth))  # at most ``positives`` for each anchor of the wave
    wanted = context.broadcast(([r.slot for r in pairs], [r.score for r in pairs]))

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, labels, vectors = shared.value
        of, score = (np.array(x, np.int64) for x in wanted.value)
        names, codes = np.unique(np.array(labels, object), return_inverse=True)
        known = {name: k for k, name in enumerate(names)}
        # the whole scores from ``low`` to ``high`` percent
        least = np.array([-((-low * int(s)) // 100) for s in score], np.int64)
        most = np.array([high * int(s) // 100 for s in score], np.int64)
        blocks = []
        for size, block in _blocks(vectors, np.arange(len(labels))):
            slots = [np.flatnonzero(of == a) for a in block.at]
            deep = max(map(len, slots), default=0)
            # the pairs of each anchor of the block, one per layer
            layers = [np.array([s[j] if j < len(s) else -1 for s in slots]) for j in range(deep)]
            blocks.append((size, block, layers))
        best = _Best(len(of), negatives, least, arrow)
        for batch in batches:
            here = np.array([known.get(x, -1) for x in batch.column("_label").to_pylist()], np.int64)
            for size, rows, planes in _chunks(batch, 256):
                for _, block, layers in (b for b in blocks if b[0] == size):
                    found = block.scores(planes)
                    other = here[rows][:, None] != codes[block.at][None, :]
                    for layer in layers:
                        on = np.flatnonzero(layer >= 0)
                        pair = layer[on]
                        sub = found[:, on] if len(on) < len(layer) else found
                        mask = (sub >= best.lowest[pair]) & (sub <= most[pair]) & other[:, on]
                        tile, slot = np.nonzero(mask)
                        best.add(pair[slot], sub[tile, slot].astype(np.int64), batch.column("_id").take(pa.array(rows[tile])))
        yield from best.settle().rename_columns(["slot", "score", "_id"]).combine_chunks().to_batches()

    ranks = narrow.mapInArrow(apart, schema).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= negatives)
    named = [(k, own[r.slot]._id, r._id, r.score) for k, r in enumerate(pairs)]
    names = filed.sparkSession.createDataFrame(named, f"slot int, anchor_id {text}, positive_id {text}, positive_score bigint")
    out = ranks.join(F.broadcast(names), "slot")  # as many rows as the wave has positives
    return out.select("anchor_id", "positive_id", "rank", F.col("_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
