import hashlib
import re

import pytest

from rastermill.llm import polyhash


def slow(text):
    return tuple(
        sum(b * pow(polyhash.BASES[k], len(text) - 1 - i, polyhash.PRIMES[k]) for i, b in enumerate(text)) % polyhash.PRIMES[k] for k in (0, 1)
    ) + (len(text),)


@pytest.mark.parametrize("size", [0, 1, 4095, 4096, 4097, 13000])
def test_fingerprint_is_the_polynomial(size):
    text = hashlib.shake_128(b"%d" % size).digest(size)
    assert polyhash.fingerprint(text) == slow(text)
    for cut in (0, size // 3, size):
        assert polyhash.combine(polyhash.fingerprint(text[:cut]), polyhash.fingerprint(text[cut:])) == polyhash.fingerprint(text)


def test_leading_zero_bytes_count():
    assert polyhash.fingerprint(b"\0a") != polyhash.fingerprint(b"a")


def expected(rows):
    normal = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    out = []
    for (i, t), n in zip(rows, normal):
        group = [(-len(b or ""), a is None, a or 0, k) for k, (a, b) in enumerate(rows) if normal[k] == n]
        keep = rows[min(group)[3]][0]
        out.append((i, keep, len(group), hashlib.sha256(n.encode()).hexdigest()))
    return out


def plain(df):
    return [(r.id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()]


def rows_with_everything(prose):
    long = prose(2, 60_000)
    return [
        (5, '{"id": 1}'), (3, '{"id":1}'), (8, '{"id":\t1 }'), (None, '{ "id": 1 }'), (1, None), (2, ""), (9, " \n"), (4, " "), (7, long),
        (6, long + " "), (10, long + "x"), (11, "único"), (12, "único"), (12, "único"), (None, None),
    ]


def test_against_brute_force(items, prose):
    rows = rows_with_everything(prose)
    assert sorted(plain(polyhash.exact_duplicates(items(rows, "json"))), key=repr) == sorted(expected(rows), key=repr)


def test_exactly_one_row_of_a_group_stays(items, prose):
    got = polyhash.exact_duplicates(items(rows_with_everything(prose), "json")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.text_sha256, []).append(r.kept)
    assert all(sum(g) == 1 for g in groups.values())


def test_collisions_never_merge_texts(items, prose):
    """With a fingerprint that everything shares, the comparison of the texts alone decides."""
    rows = rows_with_everything(prose)
    got = polyhash.exact_duplicates(items(rows, "json"), hasher=lambda t: (1, 1, 7)).collect()
    assert sorted(((r.id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == sorted(expected(rows), key=repr)


def test_empty_table(items):
    assert polyhash.exact_duplicates(items([], "json")).collect() == []
