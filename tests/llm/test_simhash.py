import random
import re

import numpy as np
import pytest
import xxhash

from rastermill.llm import frames, simhash
from tests.llm.conftest import components


def slow_fingerprint(text, k):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    runs = [" ".join(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if runs and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", " \t", "One", "a b c", "a b c d", "É a\x0bB C É d e f g A B C D a b c d"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode(), 4) % 2**64 == slow_fingerprint(text, 4)


def test_fingerprint_of_a_very_long_text(prose):
    text = prose(1, 70_000)
    assert simhash.fingerprint(text.encode(), 4) % 2**64 == slow_fingerprint(text, 4)


def test_spark_hash_is_the_same(spark):
    assert spark.sql("SELECT xxhash64('tile band')").first()[0] % 2**64 == xxhash.xxh64_intdigest(b"tile band", 42)


@pytest.mark.parametrize("leaves", [8, 2048])
def test_links_against_all_pairs(spark, leaves):
    r = random.Random(5)
    values = {0, 2**64 - 1}
    for _ in range(60):
        v = r.getrandbits(64)
        for _ in range(r.choice([1, 2, 8])):
            values.add(v)
            v ^= sum(1 << b for b in r.sample(range(64), r.choice([1, 3, 4, 5, 6])))
    hot = r.getrandbits(64)  # a crowded node: many values that share the leading bits
    values |= {hot ^ r.getrandbits(40) for _ in range(60)} | {hot ^ (1 << b) for b in range(64)}
    values = sorted(values)
    pairs = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 4]
    expected = components(len(values), pairs)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    links = simhash.near_fingerprints(spark.createDataFrame([(v,) for v in signed], "fingerprint bigint"), 4, leaves).collect()
    place = {v: k for k, v in enumerate(signed)}
    assert all((values[place[x.u]] ^ values[place[x.v]]).bit_count() for x in links)
    assert components(len(values), [(place[x.u], place[x.v]) for x in links]) == expected


def test_groups(spark, items, prose):
    base = prose(3, 120)
    near = base.replace(base.split()[60], "other", 1)
    rows = [(9, base), (4, near), (7, prose(8, 90)), (2, None), (1, ""), (None, base), (7, prose(8, 90)), (5, "Few words"), (None, None), (11, prose(9, 70))]
    got = simhash.near_duplicate_groups(items(rows), shingle=4).collect()
    prints = [slow_fingerprint(t, 4) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    part = components(len(rows), links)
    smallest = [min((rows[j][0] for j in range(len(rows)) if part[j] == p and rows[j][0] is not None), default=None) for p in part]
    expected = [(rows[i][0], prints[i], smallest[i]) for i in range(len(rows))]
    assert sorted(((r.id, r.fingerprint % 2**64, r.component_id) for r in got), key=repr) == sorted(expected, key=repr)


def test_empty_table(items):
    assert simhash.near_duplicate_groups(items([])).collect() == []


def test_chain_and_crowded_root(spark):
    chain = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)]
    got = {r.node: r.root for r in frames.linked_groups(spark.createDataFrame(chain, "u bigint, v bigint")).collect()}
    assert all(got[k] == 0 for k in range(201)) and all(got[1000 + k] == 1000 for k in range(300))


def test_meetings_cover_all_pairs():
    lo, hi, b_lo, b_hi = (np.array(x) for x in ([0, 3, 9], [3, 9, 9], [5, 0, 1], [6, 7, 4]))
    seen = [(int(k), int(a), int(b)) for s in frames.meetings(lo, hi, b_lo, b_hi, 5) for k, a, b in zip(*s)]
    assert sorted(seen) == [(k, a, b) for k in range(3) for a in range(lo[k], hi[k]) for b in range(b_lo[k], b_hi[k])]
