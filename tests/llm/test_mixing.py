import random

import pytest

from rastermill.llm import mixing


def slow_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda c: (c is None, (c or "").encode()))
    w = {c: weights[k % len(weights)] for k, c in enumerate(names)}
    target, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        total = sum(w[c] for c in free)
        over = {c for c in free if left * w[c] / total > most * sizes[c]}
        if not over:
            return target | {c: left * w[c] / total for c in free}
        target |= {c: float(most * sizes[c]) for c in over}
        left -= sum(most * sizes[c] for c in over)
        free -= over
    return target


@pytest.fixture
def catalogue():
    r = random.Random(3)
    rows = [(k, r.choice(["s2", "s1", "s1", "s1", "landsat", "Émile", "z", None]), int(r.paretovariate(1.1) * 40)) for k in range(3000)]
    return rows + [(3000, "tiny", 5), (3001, "empty", 0), (3002, "s2", None), (None, "s2", 40), (7, rows[7][1], rows[7][2])]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "id bigint, collection string, size bigint, _mass string, target int")


def test_mix(spark, catalogue):
    got = mixing.mix_collections(frame(spark, catalogue)).collect()
    assert sorted(((r.id, r.collection, r.size) for r in got), key=repr) == sorted(((i, c, s or 0) for i, c, s in catalogue), key=repr)
    sizes, taken, largest = {}, {}, {}
    for r in got:
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        sizes[r.collection] = sizes.get(r.collection, 0) + r.size
        taken[r.collection] = taken.get(r.collection, 0) + r.taken
        largest[r.collection] = max(largest.get(r.collection, 0), r.size)
    targets = slow_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.collection] and r.target == pytest.approx(targets[r.collection], rel=1e-9)
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))
    for c in sizes:  # within half an item, the one that is rounded last: a small one, unless an item outweighs the others
        assert abs(taken[c] - targets[c]) <= largest[c] / 2
        if 10 * largest[c] <= targets[c]:
            assert abs(taken[c] - targets[c]) <= 0.005 * targets[c]
    again = mixing.mix_collections(frame(spark, catalogue[::-1]).repartition(5)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_rounding_has_no_bias(spark):
    rows = [(k, "a" if k < 150 else "b", 10 + k % 7) for k in range(200)]
    total = [0] * 200
    for seed in range(12):
        for r in mixing.mix_collections(frame(spark, rows), seed=1000 * seed).collect():
            total[r.id] += r.copies
            due = r.target / r.source_size
            assert int(due) <= r.copies <= int(due) + 1
    assert sum(total[:150]) / 12 / 150 == pytest.approx(sum(r[2] for r in rows) / 3 / sum(r[2] for r in rows[:150]), rel=0.03)


def test_large_items_and_repeated_rows(spark):
    """One item as large as all others, and rows alike in everything: a group holds no more than its share of them."""
    r = random.Random(5)
    rows = [(k, "a", 1 + r.randrange(30)) for k in range(900)] + [(900, "a", 14_000)]
    rows += [(None, "b", 7)] * 700 + [(k, "b", 1 + k % 90) for k in range(1000, 1300)] + [(2000 + k, "c", n) for k, n in enumerate((900, 300, 200, 150, 90, 40, 20, 9))]
    got = mixing.mix_collections(frame(spark, rows)).collect()
    assert len(got) == len(rows) and sum(x.id is None for x in got) == 700
    for c, near in (("a", 5), ("b", 5), ("c", 60)):
        own = [x for x in got if x.collection == c]
        assert abs(sum(x.taken for x in own) - own[0].target) <= near
    alike = [x.copies for x in got if x.id is None]
    assert max(alike) - min(alike) <= 1


def test_empty_table(spark):
    assert mixing.mix_collections(frame(spark, [])).collect() == []


def test_word_count(spark):
    texts = [("a b\tc\x0b\x0cd e",), ("",), (None,), (" \r\n",)]
    assert [r[0] for r in spark.createDataFrame(texts, "t string").select(mixing.word_count("t")).collect()] == [4, 0, 0, 0]
