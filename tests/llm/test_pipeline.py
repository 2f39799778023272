import re

import pytest

import corpus_pipeline
from rastermill.llm import mixing, simhash, stages
from tests.llm.conftest import components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture
def documents(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")

    return make


@pytest.fixture
def corpus(prose):
    rows = [(k, prose(k, 150), f"s{k % 4}") for k in range(60)]
    words = rows[7][1].split()
    for n, i in enumerate((70, 71, 72)):  # near copies: one word in fifty differs
        changed = list(words)
        changed[40 + 30 * n] = "changed"
        rows.append((i, " ".join(changed), "s1"))
    rows += [(80, rows[3][1].replace(" ", "  ", 1), "s0"), (81, rows[3][1], "s2"), (82, None, None), (83, "", "s1"), (None, prose(200, 90), "s1")]
    return rows


def test_stages(spark, documents, corpus, tmp_path):
    spark.createDataFrame([(k, 1, 0) for k in range(0, 60, 2)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    documents(corpus).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = stages.good_quality(spark, docs, str(tmp_path))
    assert kept.columns == COLUMNS and kept.count() == len(corpus)

    exact = stages.one_of_equal_texts(spark, docs, str(tmp_path))
    assert exact.columns == COLUMNS
    ids = sorted((r.doc_id for r in exact.collect()), key=repr)
    assert ids == sorted([i for i, _, _ in corpus if i not in (3, 81, 83)], key=repr)  # the longer one stays; of two empty ones the first

    near = stages.one_of_near_texts(spark, exact, str(tmp_path))
    assert near.columns == COLUMNS
    assert sorted((r.doc_id for r in near.collect()), key=repr) == [i for i in ids if i not in (70, 71, 72)]

    mix = stages.mixed(spark, near, str(tmp_path))
    assert mix.columns == COLUMNS
    decided = mixing.mix_collections(near.select("doc_id", "source", mixing.word_count("text").alias("size")), id="doc_id", collection="source", size="size")
    assert mix.count() == pytest.approx(decided.agg({"copies": "sum"}).first()[0], abs=8)

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and {r.doc_id for r in out} <= {i for i, _, _ in corpus} and all(r.n_tokens == len(r.ids) == len(r.decoded.split()) for r in out)


def test_repeated_and_missing_rows(spark, documents, prose):
    docs = documents([(1, prose(1, 50), "a")] * 5 + [(None, None, None)] * 3)
    assert stages.one_of_equal_texts(spark, docs, "").count() == 2
    assert stages.one_of_near_texts(spark, docs, "").count() == 2
    assert stages.mixed(spark, docs, "").count() % 5 == 0
    empty = docs.limit(0)
    for stage in (stages.one_of_equal_texts, stages.one_of_near_texts, stages.mixed, stages.encoded):
        assert stage(spark, empty, "").count() == 0


def test_near_texts_under_one_or_no_id(spark, documents, prose):
    unlike = [prose(300 + k, 120) for k in range(9)]
    near = unlike[0].replace(unlike[0].split()[60], "changed", 1)
    rows = [*((None, t, "a") for t in unlike[:4]), *((5, t, "a") for t in unlike[4:8]), (6, unlike[8], "a"), (7, near, "a"), (7, unlike[8], "a")]
    kept = stages.one_of_near_texts(spark, documents(rows), "").collect()
    # the near copy has an id, so it stays for the text without one
    expected = [*((None, t) for t in unlike[1:4]), *((5, t) for t in unlike[4:8]), (6, unlike[8]), (7, near)]
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted(expected, key=repr)


def test_similar_texts_against_all_pairs(items, prose):
    rows = []
    for k in range(40):
        words = prose(k, 140).split()
        rows.append((len(rows), " ".join(words)))
        for n in range(k % 4):
            changed = list(words)
            for at in range(n + 1):
                changed[13 + 41 * at] = f"other{n}{at}"
            rows.append((len(rows), " ".join(changed)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (re.findall(r"\S+", t.lower()) for _, t in rows)]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = {r.id: r.component_id for r in simhash.similar_text_groups(items(rows)).collect()}
    part = components(len(rows), links)
    assert sum(got[k] == part[k] for k in range(len(rows))) >= 0.97 * len(rows)


def _jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def test_similar_texts_at_the_threshold(items, prose):
    """Pairs a little below the similarity stay apart, pairs a little above it are joined."""
    rows, similarity = [], []
    for k in range(160):
        words = prose(1000 + k, 150).split()
        changed = list(words)
        for at in range(3 + k % 5 if k % 2 else 3):
            changed[9 + 17 * at] = f"other{at}"
        texts = [" ".join(words), " ".join(changed)]
        similarity.append(_jaccard(*texts))
        rows += [(2 * k + n, t) for n, t in enumerate(texts)]
    # shingles count once, however often a text repeats them
    rows += [(1000, prose(1, 40)), (1001, " ".join([prose(1, 40), *[" ".join(prose(1, 40).split()[:30])] * 6]))]
    similarity_last = _jaccard(rows[-2][1], rows[-1][1])
    got = {r.id: r.component_id for r in simhash.similar_text_groups(items(rows)).collect()}
    joined = [got[2 * k] == got[2 * k + 1] for k in range(160)]
    assert sum(0.6 <= j < 0.8 for j in similarity) >= 30 and sum(0.8 <= j < 0.85 for j in similarity) >= 30
    assert not any(on for on, j in zip(joined, similarity) if j < 0.8)
    assert sum(on for on, j in zip(joined, similarity) if j >= 0.8) >= 0.99 * sum(j >= 0.8 for j in similarity)
    assert similarity_last >= 0.8 and got[1000] == got[1001]


def test_near_texts_come_through_the_walk_of_tries(spark, documents, prose, monkeypatch):
    """Texts whose fingerprints lie within four bits are linked by the walk, those beyond it by their shingle sets."""
    rows, links = [], []
    words, masks = prose(1, 400).split(), []
    for n in range(12):
        changed = list(words)
        for at in range(n):
            changed[7 + 31 * at] = f"other{at}"
        rows.append((n, " ".join(changed), "a"))
    rows += [(100 + k, prose(500 + k, 80), "a") for k in range(30)]
    sets = [simhash.shingle_set(t.encode(), 5) for _, t, _ in rows]
    prints = [int.from_bytes(simhash._majority([s], 1), "big") for s in sets]
    for a in range(len(rows)):
        for b in range(a):
            apart = (prints[a] ^ prints[b]).bit_count()
            alike = len(set(sets[a].tolist()) & set(sets[b].tolist())) / len({*sets[a].tolist(), *sets[b].tolist()})
            links += [(a, b)] * (apart <= 4)
            masks.append((apart, alike))
    assert any(apart <= 4 for apart, _ in masks) and any(apart > 4 and alike >= 0.8 for apart, alike in masks)
    walks = []
    real = simhash.near_fingerprints
    monkeypatch.setattr(simhash, "near_fingerprints", lambda prints, errors, leaves: walks.append(errors) or real(prints, errors, leaves))
    kept = {r.doc_id for r in stages.one_of_near_texts(spark, documents(rows), "").collect()}
    assert walks == [4] and kept == {0, *range(100, 130)}
    # links of the walk alone
    values = spark.createDataFrame([(k, simhash._majority([s], simhash.WIDE)) for k, s in enumerate(sets)], "fingerprint bigint, bits binary")
    found = simhash._walked_links(values, 4, 2048)
    part = components(len(rows), [(r.u, r.v) for r in found.collect()])
    assert part == components(len(rows), links) and max(part.count(x) for x in part) > 1
