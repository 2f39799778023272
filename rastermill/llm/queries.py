"""The corpus operators over the given tables: thin steps from columns to the operators and back."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastermill.llm import bytecnn, divergence, itq, language, logcounts, markov, mixing, negatives, polyhash, simhash, spans, token_counts, transducer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", mixing.word_count("text").alias("size"))
    mixed = mixing.mix_collections(docs, (1, 2, 3), 3, id="doc_id", collection="source", size="size")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


@query
def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    groups = simhash.near_duplicate_groups(docs, id="doc_id", text="text", shingle=4, errors=4)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return polyhash.exact_duplicates(docs, id="doc_id", text="text").drop("row_hash")


ORACLES["op7_exact_dedup"] = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS normal
  FROM documents
), ranked AS (
  SELECT doc_id, sha256(normal) AS text_sha256, count(*) OVER (PARTITION BY normal) AS group_size,
         first_value(doc_id) OVER (PARTITION BY normal ORDER BY points DESC, doc_id) AS keep_id
  FROM rows
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked
"""


@query
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), id="doc_id", text="text")


@query
def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs, path = table(spark, folder, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")
    decoded = transducer.encode(docs, path, id="doc_id", text="text", decoded="decoded")
    return decoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def held_out(id: str, folds: int, fold: int):
    return F.pmod(F.crc32(F.col(id).cast("string").cast("binary")), F.lit(folds)) == fold


@query
def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").filter(~held_out("doc_id", 3, 1))
    scored = bytecnn.quality_scores(docs, bytecnn.fit_quality(docs, labels, id="doc_id", text="text"), text="text")
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").filter(~held_out("doc_id", 5, 0))
    scored = logcounts.toxicity_scores(docs, logcounts.fit_toxicity(docs, labels, id="doc_id", text="text"), text="text")
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = markov.find_secrets(docs, id="doc_id", text="text")
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans")
    )


@query
def op2_sentence_spans(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return spans.remove_repeated_passages(docs, id="doc_id", text="text")


@query
def op4_itq(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    return itq.near_duplicate_vectors(vectors, id="vec_id", vector="embedding", label="label", least=0.98)


@query
def op11_divergence(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("lang", "source", "text")
    return divergence.node_divergence(docs, collection="lang", node="source", text="text", least=10, top=10)


ORACLES["op11_divergence"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS nth, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), words AS (
  SELECT nth, lang, source, unnest(regexp_extract_all(text, '[a-z\x{80}-\x{10FFFF}]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT nth) >= 10
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
  SELECT g.lang, g.source, coalesce(s.n, 0) AS n, coalesce(k.v, 0) AS v, coalesce(k.n, 0) AS whole
  FROM (SELECT DISTINCT lang, source FROM docs) AS g LEFT JOIN (SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL) AS s USING (lang, source)
       LEFT JOIN (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang) AS k USING (lang)
), shares AS (
  SELECT lang, g.source, term, coalesce(c.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (g.n + 2 * g.v)::HUGEINT AS p, 1 + 1000000000::HUGEINT * (k.n + 2) // (g.whole + 2 * g.v)::HUGEINT AS q
  FROM groups AS g JOIN kept AS k USING (lang) LEFT JOIN counts AS c USING (lang, source, term)
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares AS a JOIN shares AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN sums AS s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), marks AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM shares WHERE n > 0 AND p > q
), parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM marks
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER ranked AS INTEGER) AS rank
FROM parts WINDOW ranked AS (PARTITION BY lang, source, part ORDER BY value DESC, item)
QUALIFY part = 'pair' OR rank <= 10
"""


@query
def op12_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END").alias("label")
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", label)
    return negatives.hard_negatives(
        vectors, F.col("vec_id") % 100 == 0, id="vec_id", vector="embedding", label="label", scale=256, positives=5, negatives=10, low=30, high=90
    )


ORACLES["op12_negatives"] = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM rows AS a JOIN rows AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER ranked AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM positives AS p JOIN scored AS s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW ranked AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY rank <= 10
"""


@query
def op13_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = language.text_probability(docs, ~held_out("doc_id", 5, 1), id="doc_id", text="text")
    return scored.select("doc_id", held_out("doc_id", 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
