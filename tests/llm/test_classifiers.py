import random

import numpy as np
import pytest

from rastermill.llm import bytecnn, labelled, logcounts

RUDE = ["scumble", "idiotic", "loserish"]


@pytest.fixture
def marked(prose):
    """Texts with ``quality`` (0: shouted or full of bars) and ``toxic`` (1: holds a rude word)."""
    r, rows = random.Random(8), []
    for k in range(500):
        text, good, toxic = prose(k, r.randint(10, 120)), int(k % 4 > 0), int(k % 5 == 0)
        if toxic:
            words = text.split()
            words.insert(r.randrange(len(words)), r.choice(RUDE))
            text = " ".join(words)
        if not good:
            text = "!! ".join(text.upper().split()) if k % 8 else " | ".join(text.split())
        rows.append((k, text, good, toxic))
    return rows


def frames(spark, rows):
    items = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _, _ in rows], "id bigint, text string, _text string, score double")
    return items, spark.createDataFrame([(i, q, t) for i, _, q, t in rows] + [(None, 1, None), (3, None, None)], "id bigint, quality int, toxic int")


def accuracy(got, rows, column):
    truth = {r[0]: r[column] for r in rows if r[0] % 3 == 1}
    return np.mean([(r.score >= 0.5) == truth[r.id] for r in got if r.id in truth])


def test_quality_on_held_out_rows(spark, marked):
    items, labels = frames(spark, marked)
    net = bytecnn.fit_quality(items, labels.filter("id % 3 <> 1"), text="text", per_class=200)
    got = bytecnn.quality_scores(items, net, "text").collect()
    assert len(got) == len(marked) and got[0].asDict().keys() >= {"id", "text", "_text", "score"}
    assert accuracy(got, marked, 2) >= 0.97


def test_toxicity_on_held_out_rows(spark, marked):
    items, labels = frames(spark, marked)
    model = logcounts.fit_toxicity(items, labels.filter("id % 3 <> 1"), text="text", per_class=400)
    assert accuracy(logcounts.toxicity_scores(items, model, "text").collect(), marked, 3) >= 0.97


def odd(spark):
    rows = [(1, None), (2, ""), (None, "a"), (4, "Ω" * 400_000), (4, "Ω" * 400_000), (5, " \n")]
    return spark.createDataFrame(rows, "id bigint, text string")


def test_odd_texts_have_scores(spark, marked):
    sample = [(t.encode(), q) for _, t, q, _ in marked[:40]]
    net, model = bytecnn.fit(sample, epochs=1), logcounts.fit(sample, rounds=5)
    for got in (bytecnn.quality_scores(odd(spark), net, "text").collect(), logcounts.toxicity_scores(odd(spark), model, "text").collect()):
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
        scores = {r.id: r.score for r in got}
        assert scores[1] == scores[2]


def test_without_labels_or_rows(spark):
    items = odd(spark)
    labels = spark.createDataFrame([], "id bigint, quality int, toxic int")
    net = bytecnn.fit_quality(items, labels, text="text")
    assert all(r.score > 0.5 for r in bytecnn.quality_scores(items, net, "text").collect())
    model = logcounts.fit_toxicity(items, labels, text="text")
    assert all(r.score < 0.5 for r in logcounts.toxicity_scores(items, model, "text").collect())
    assert bytecnn.quality_scores(items.limit(0), net, "text").collect() == []
    assert logcounts.toxicity_scores(items.limit(0), model, "text").collect() == []


def test_network_sees_the_whole_text(marked):
    """Blocks and batches don't matter, and every byte takes part."""
    net = bytecnn.fit([(t.encode(), q) for _, t, q, _ in marked[:60]], epochs=2)
    tables = bytecnn._tables(net)
    texts = [t.encode() * k for k, (_, t, _, _) in enumerate(marked[:6])]
    alone = [bytecnn.probabilities([t], net, tables)[0] for t in texts]
    assert np.allclose(bytecnn.probabilities(texts, net, tables), alone)
    places = [np.zeros(bytecnn.FILTERS)]
    padded = bytes(bytecnn.WIDTH) + texts[3]
    for at in range(0, len(padded) + 1, bytecnn.STRIDE):
        window = np.frombuffer(padded[at : at + bytecnn.WIDTH].ljust(bytecnn.WIDTH, b"\0"), np.uint8)
        places.append(sum(tables[j][b] for j, b in enumerate(window)) + net.bias)
    data, steps = bytecnn._padded([texts[3]])
    assert np.allclose(bytecnn._responses(data, tables, net.bias)[0].max(0), np.max(places, axis=0), atol=1e-5)


def test_gradient(marked):
    texts = [t.encode() for _, t, _, _ in marked[:6]]
    y, weight = np.array([q for _, _, q, _ in marked[:6]], float), np.ones(6)
    r = np.random.default_rng(1)
    net = bytecnn.fit([(t, int(k % 2)) for k, t in enumerate(texts)], epochs=1)._replace(weights=r.normal(size=2 * bytecnn.FILTERS))

    def loss(n):
        p = np.clip(bytecnn.probabilities(texts, n, bytecnn._tables(n)), 1e-12, 1 - 1e-12)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean() + 0.5e-4 * (n.weights**2).sum()

    grads = bytecnn._gradient(texts, y, weight, net)
    for name, place in (("weights", (3,)), ("weights", (15,)), ("bias", (2,)), ("filters", (1, 2, 3)), ("embed", (ord("e"), 1))):
        step, up, down = 1e-3, getattr(net, name).copy(), getattr(net, name).copy()
        up[place] += step
        down[place] -= step
        slope = (loss(net._replace(**{name: up})) - loss(net._replace(**{name: down}))) / (2 * step)
        assert grads[net._fields.index(name)][place] == pytest.approx(slope, rel=0.05, abs=2e-3)


def test_features_of_long_texts(monkeypatch, prose):
    text = prose(4, 3000).encode()
    whole = logcounts.features(text)
    monkeypatch.setattr(logcounts, "BLOCK", 700)
    assert (logcounts.features(text) == whole).all()


def test_sample_is_bounded_and_ignores_partitions(spark, marked):
    items, labels = frames(spark, marked)
    one = labelled.labelled_sample(items, labels, "id", "text", "quality", 30, 300)
    two = labelled.labelled_sample(items.repartition(7), labels, "id", "text", "quality", 30, 300)
    assert sorted(one) == sorted(two) and sum(c for _, c in one) <= 30 and len(one) <= 60 and all(len(t.decode()) <= 300 for t, _ in one)
