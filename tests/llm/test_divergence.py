import random
import re
from collections import Counter, defaultdict

import pytest

from rastermill.llm import divergence


def brute(rows, least, top):
    texts = [(c or "", n or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for c, n, t in rows]
    found = defaultdict(Counter)
    for c, _, terms in texts:
        found[c].update(set(terms))
    kept = {c: {t for t, n in terms.items() if n >= least} for c, terms in found.items()}
    counts, whole = defaultdict(Counter), defaultdict(Counter)
    for c, n, terms in texts:
        own = Counter(t for t in terms if t in kept[c])
        counts[c, n].update(own)
        whole[c].update(own)

    def share(counter, c):
        total = sum(counter.values()) + 2 * len(kept[c])
        return {t: 1 + 10**9 * (counter[t] + 2) // total for t in kept[c]}

    out = set()
    for c, n in counts:
        p = share(counts[c, n], c)
        parts = {"pair": [], "term": []}
        for other in counts:
            if other[0] == c and other[1] != n:
                q = share(counts[other], c)
                parts["pair"].append((other[1], sum((p[t] - q[t]) ** 2 // (p[t] + q[t]) for t in p)))
        q = share(whole[c], c)
        parts["term"] = [(t, (p[t] - q[t]) ** 2 // (p[t] + q[t])) for t in p if counts[c, n][t] and p[t] > q[t]]
        for part, values in parts.items():
            ranked = sorted(values, key=lambda x: (-x[1], x[0].encode()))
            for rank, (item, value) in enumerate(ranked if part == "pair" else ranked[:top], 1):
                out.add((c, n, part, item, value, rank))
    return out


def made(spark, rows, least=10, top=10):
    df = spark.createDataFrame(
        [(*r, "x", 1, "y") for r in rows], "collection string, node_id string, description string, _c string, task int, term string"
    )
    found = [tuple(r) for r in divergence.node_divergence(df, least=least, top=top).collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("seed, segment, few, nodes", [(1, 1024, 16, 64), (2, 8, 1, 2), (3, 16, 0, 3)])
def test_equals_brute_force(spark, prose, monkeypatch, seed, segment, few, nodes):
    for name, value in (("SEGMENT", segment), ("FEW", few), ("NODES", nodes)):
        monkeypatch.setattr(divergence, name, value)
    r = random.Random(seed)
    rows = [(r.choice(["s2", "s2", "s1"]), f"n{min(r.randrange(9), r.randrange(9))}", prose(seed * 1000 + k, r.randrange(1, 60))) for k in range(120)]
    rows += [("s2", "n9", ""), ("s2", None, "Ärger über ÄRGER tile_band tile-BAND 7x"), (None, "n1", None), ("", "n2", "alone"), ("one", "n1", "lonely node")]
    assert made(spark, rows, 3, 4) == brute(rows, 3, 4)


def test_dense_counts_and_many_ties(spark):
    rows = [("s2", f"n{k % 5}", " ".join(f"t{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(k % 5, 300))) for k in range(60)]
    assert made(spark, rows, 10, 10) == brute(rows, 10, 10)


def test_repeated_rows_and_a_very_long_text(spark):
    rows = [("s2", "a", "cloud mask " * 100_000), *[("s2", "b", "cloud Mask orbit")] * 40, *[("s2", "c", "orbit")] * 3]
    assert made(spark, rows, 2, 10) == brute(rows, 2, 10)


def test_empty_table_and_no_kept_terms(spark):
    assert made(spark, [("s2", "a", "x")][:0]) == set()
    assert made(spark, [("s2", "a", "rare"), ("s2", "b", "words")]) == {("s2", "a", "pair", "b", 0, 1), ("s2", "b", "pair", "a", 0, 1)}
