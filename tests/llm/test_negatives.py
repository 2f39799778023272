import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastermill.llm import negatives


def brute(rows, is_anchor, positives=5, most=10):
    """Rows are (id, vector, band); all arithmetic in Python's whole numbers."""
    whole = {}
    for i, v, band in rows:
        if i is not None and band is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole[i, band, tuple(math.floor(256 * x) for x in v), tuple(v)] = None
    rows = list(whole)
    out = set()
    for a, band, v, _ in (r for r in rows if is_anchor(r[0])):
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), i, b) for i, b, w, _ in rows if len(w) == len(v)))
        best = [(i, -s) for s, i, b in scored if b == band and i != a][:positives]
        for p, ps in best:
            found = [(i, -s) for s, i, b in scored if b != band and 30 * ps <= -100 * s <= 90 * ps][:most]
            out |= {(a, p, rank, i, ps, s) for rank, (i, s) in enumerate(found, 1)}
    return out


def made(spark, rows, kind="bigint", anchor=None, **options):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], f"id {kind}, pixels array<double>, band string, _id string, slot int, score string")
    found = [tuple(r) for r in negatives.hard_negatives(df, F.col("id") % 10 == 0 if anchor is None else anchor, **options).collect()]
    assert len(found) == len(set(found))
    return set(found)


def drawn(n, size, seed, bands=3):
    r = random.Random(seed)
    centre = [r.gauss(0, 1) for _ in range(size)]
    return [(k, [c * 0.6 + r.gauss(0, 0.5) for c in centre], f"B0{r.randrange(bands)}") for k in range(n)]


def test_scores_from_bit_planes():
    r = np.random.default_rng(0)
    for size in (0, 1, 7, 8, 9, 64, 100):
        anchors = r.integers(-300, 300, (5, size))
        for width in (1, 2, 300, 2**20):
            tiles = r.integers(-width, width, (11, size))
            planes = max(negatives.bit_planes(t)[0] for t in tiles)
            bits = [(t[None, :] >> np.arange(planes)[:, None]) & 1 for t in tiles]
            packed = np.stack([np.packbits(b.astype(bool), axis=1, bitorder="little") for b in bits]).transpose(1, 0, 2)
            assert (negatives.scores(negatives.subset_sums(anchors), packed) == tiles @ anchors.T).all()


@pytest.mark.parametrize("numbers", [[0], [-1], [1], [-256, 255], [127, -128], [128], [-129], [2**40, -(2**40)]])
def test_planes_hold_every_number(numbers):
    planes, data = negatives.bit_planes(np.array(numbers, np.int64))
    bits = np.unpackbits(np.frombuffer(data, np.uint8).reshape(planes, -1), axis=1, bitorder="little")[:, : len(numbers)].astype(np.int64)
    weights = [*(1 << k for k in range(planes - 1)), -(1 << (planes - 1))]
    assert (bits.T @ np.array(weights)).tolist() == numbers


@pytest.mark.parametrize("seed, wave, held", [(1, 1 << 19, 1 << 18), (2, 60, 50)])
def test_equals_brute_force(spark, monkeypatch, seed, wave, held):
    for name, value in (("WAVE", wave), ("HELD", held), ("ROWS", 64), ("TABLES", 1 << 14)):
        monkeypatch.setattr(negatives, name, value)
    rows = drawn(300, 12, seed)
    rows += [(1000, rows[0][1], "B00"), (1010, rows[10][1], None), (1020, None, "B01"), (None, rows[3][1], "B01")]
    rows += [(1030, [*rows[5][1][:-1], None], "B00"), (1040, [float("nan")] * 12, "B00"), (1050, [float("inf")] * 12, "B01")]
    rows += [(1100 + k, [0.5 - k / 9] * 5, f"B0{k % 2}") for k in range(12)] + [(1200, [], "B00"), (1201, [], "B00"), (1202, [], "B01")]
    found = made(spark, rows)
    assert found == brute(rows, lambda i: i % 10 == 0) and len(found) > 200


def test_many_equal_tiles_and_ties(spark, monkeypatch):
    monkeypatch.setattr(negatives, "HELD", 100)
    rows = drawn(200, 8, 5, bands=2)
    same = rows[7][1]
    rows += [(k, same, "B00" if k % 3 else "B01") for k in range(300, 700)]
    rows += rows[:50]  # repeated rows count once
    assert made(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_text_ids_and_long_vectors(spark):
    rows = [(f"S2_T32_{k:03d}", v, b) for k, v, b in drawn(60, 3000, 6)]
    anchor = F.col("id").endswith("0")
    assert made(spark, rows, "string", anchor) == brute(rows, lambda i: i.endswith("0"))


def test_empty_and_no_anchors(spark):
    assert made(spark, []) == set()
    assert made(spark, drawn(20, 4, 1), anchor=F.lit(False)) == set()
    assert made(spark, drawn(20, 4, 1), anchor=F.lit(None).cast("boolean")) == set()


def test_scores_that_do_not_fit_are_an_error(spark):
    with pytest.raises(Exception, match="64-bit"):
        made(spark, [(0, [1e30], "B00"), (1, [1.0], "B00")])
