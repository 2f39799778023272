"""Pipeline stages: what the operators decide, applied to a table of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rastermill.llm import bytecnn, mixing, polyhash, simhash, transducer

LABEL_FOLDS, LABEL_HELD_OUT = 3, 1


def held_out(id: str, folds: int, fold: int) -> Column:
    return F.pmod(F.crc32(F.col(id).cast("string").cast("binary")), F.lit(folds)) == fold


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network takes for good; it learns from ``labels`` outside the held-out third."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out("doc_id", LABEL_FOLDS, LABEL_HELD_OUT))
    network = bytecnn.fit_quality(docs.select("doc_id", "text"), labels, id="doc_id", text="text")
    return bytecnn.quality_scores(docs, network, text="text", out="_score").filter("_score >= 0.5").drop("_score")


def _only_first(docs: DataFrame, keys: list[str]) -> DataFrame:
    """One of the rows with the same keys; the ranks are cut off before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(*keys)
    return docs.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")


def one_of_equal_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose texts are equal but for blanks, the one with most code points, then the smallest doc_id."""
    found = polyhash.exact_duplicates(docs.select("doc_id", "text"), id="doc_id", text="text").filter("kept")
    kept = found.select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_row")).distinct()
    hashed = docs.withColumn("_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = hashed.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_row"))).drop("_id", "_row")
    return _only_first(joined, ["doc_id", "_hash"]).drop("_hash")


def one_of_near_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document first by doc_id.

    Documents are linked by the walk of tries that ``op3_simhash`` runs (64-bit fingerprints of five-word shingles that differ in
    four bits or fewer), and beside it, because changed words move more bits than that, by shingle sets of similarity 0.8 or more.

    Documents are told apart by doc_id and text, so those that share a doc_id or have none are lost only to a similar
    text. Documents without a doc_id stay only in groups where none has one.
    """
    hashed = docs.withColumn("_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    # a row with nulls would come first
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("_hash").alias("hash"))
    groups = simhash.similar_text_groups(hashed.select(key.alias("key"), "text"), id="key", text="text", shingle=5, similarity=0.8, walked=4)
    first = groups.filter(F.col("key").eqNullSafe(F.col("component_id"))).select(F.col("key.doc_id").alias("_id"), F.col("key.hash").alias("_row")).distinct()
    joined = hashed.join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_row"))).drop("_id", "_row")
    return _only_first(joined, ["doc_id", "_hash"]).drop("_hash")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it; those taken not at all go.

    Documents without a doc_id are told apart by their text; rows alike in both take the larger number of copies.
    """
    key = F.struct("doc_id", F.xxhash64("text").alias("hash"))
    sizes = docs.select(key.alias("id"), "source", mixing.word_count("text").alias("size"))
    copies = mixing.mix_collections(sizes, (1, 2, 3), 3, id="id", collection="source", size="size")
    times = copies.groupBy("id").agg(F.max("copies").alias("_copies")).filter("_copies > 0")
    times = times.select(F.col("id.doc_id").alias("_id"), F.col("id.hash").alias("_row"), "_copies")
    joined = docs.join(times, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_row")))
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), "_copies")).alias("_nth")).drop("_nth")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, decoded, n_tokens``: the training rows, and the text the ids stand for."""
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = transducer.encode(docs.select("doc_id", "text"), path, id="doc_id", text="text", decoded="decoded")
    return coded.withColumn("n_tokens", F.size("ids").cast("bigint"))
