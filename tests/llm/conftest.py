import random

import pytest

SYLLABLES = ["tile", "band", "scene", "cloud", "orbit", "pixel", "chunk", "grid", "mask", "path", "row", "swath"]


@pytest.fixture
def prose():
    """``prose(seed, n)``: n words that look like catalogue descriptions."""

    def make(seed: int, n: int) -> str:
        r = random.Random(seed)
        words = ["".join(r.choices(SYLLABLES, k=r.randint(1, 3))) for _ in range(n)]
        return " ".join(w + ("." if r.random() < 0.12 else "") for w in words)

    return make


@pytest.fixture
def items(spark):
    """``items(rows, text)``: catalogue rows ``(id, text)`` beside columns whose names the operators use themselves."""

    def make(rows, text="description", extra="string"):
        schema = f"id bigint, {text} string, _id {extra}, _row {extra}, task {extra}, u {extra}, fingerprint {extra}, collection string"
        return spark.createDataFrame([(*r[:2], None, "x", "y", None, "z", r[2] if len(r) > 2 else None) for r in rows], schema)

    return make


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
