"""Exact duplicates by composable polynomial fingerprints and a chunkwise comparison of the texts."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastermill.llm.frames import BLANKS, map_rows, text_bytes
from rastermill.session import pin

# Two primes below 2^31 and a base for each. A chunk's sum of byte * power stays
# below 2^53, so double-precision products of whole numbers are exact.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 69069069)
CHUNK = 4096
PIECE = 1 << 16  # characters compared at once


def _powers(base: int, prime: int) -> np.ndarray:
    powers = [1]
    for _ in range(CHUNK - 1):
        powers.append(powers[-1] * base % prime)
    return np.array(powers[::-1], np.float64)


_TABLE = np.stack([_powers(b, p) for b, p in zip(BASES, PRIMES)], axis=1)


def combine(left: tuple[int, int, int], right: tuple[int, int, int]) -> tuple[int, int, int]:
    """Fingerprint ``(h1, h2, length)`` of two texts in a row: the left one is shifted by the length of the right one."""
    a, b = (
        (left[k] * pow(BASES[k], right[2], PRIMES[k]) + right[k]) % PRIMES[k] for k in (0, 1)
    )
    return a, b, left[2] + right[2]


def chunk_hashes(text: bytes) -> np.ndarray:
    """Hashes of the chunks of ``text``, all at once; the first chunk is filled up with zero bytes in front."""
    short = -len(text) % CHUNK
    data = np.zeros(len(text) + short, np.uint8)
    data[short:] = np.frombuffer(text, np.uint8)
    chunks = data.reshape(-1, CHUNK)
    # blocks bound the memory of the widened bytes
    sums = [chunks[k : k + 256].astype(np.float64) @ _TABLE for k in range(0, len(chunks), 256)]
    return np.concatenate(sums).astype(np.int64) % np.array(PRIMES)


def fingerprint(text: bytes) -> tuple[int, int, int]:
    """``(h1, h2, length)`` of ``text``: chunk hashes combined pairwise by length-shifted arithmetic.

    Leading zero bytes leave a polynomial as it is, so the first chunk may be
    filled up; the length tells texts with leading zero bytes apart.
    """
    if not text:
        return 0, 0, 0
    hashes, width = chunk_hashes(text), CHUNK
    primes = np.array(PRIMES)
    while len(hashes) > 1:
        if len(hashes) % 2:  # an empty chunk in front changes nothing
            hashes = np.concatenate([np.zeros((1, 2), np.int64), hashes])
        shift = np.array([pow(b, width, p) for b, p in zip(BASES, PRIMES)])
        hashes = (hashes[0::2] * shift % primes + hashes[1::2]) % primes
        width *= 2
    return int(hashes[0, 0]), int(hashes[0, 1]), len(text)


def _narrow(items: DataFrame, hasher) -> DataFrame:
    """Per row: id, row hash, code points of the text, fingerprint and SHA-256 of the text without blanks."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.translate(None, BLANKS) for t in text_bytes(batch, "_text")]
        found = [hasher(t) for t in texts]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("_id"), batch.column("_row"), batch.column("_points"),
                pa.array([(a << 31) ^ b for a, b, _ in found], pa.int64()), pa.array([n for _, _, n in found], pa.int64()),
                pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
            ],
            names=["_id", "_row", "_points", "print", "length", "sha"],
        )

    kind = items.schema["_id"].dataType.simpleString()
    return map_rows(items, run, f"_id {kind}, _row bigint, _points bigint, print bigint, length bigint, sha binary")


def _normal(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def exact_duplicates(items: DataFrame, id: str = "id", text: str = "json", hasher=fingerprint) -> DataFrame:
    """Group STAC documents that are equal but for blanks, and name the row of each group that stays.

    Returns one row per input row: ``id``, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256`` (of the text without the characters ``[\\x20\\x09-\\x0D]``) and
    ``row_hash`` (XXH64 of the text as it is). The row with the most code points
    stays, then the smallest id (a null id last).

    Texts with one fingerprint are compared piece by piece: the smallest and the
    largest content of a piece are combined before the shuffle, so a text that a
    third of the rows share travels once per task. Where a piece differs, the
    texts themselves are the group key, so a hash collision never merges texts.

    Null counts as an empty text; empty texts are equal to each other. Of rows
    with the same id and text exactly one is kept. Other columns are ignored,
    whatever their names. An empty table gives an empty result.
    """
    source = items.select(F.col(id).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    source = source.withColumn("_row", F.xxhash64("_text"))
    rows = pin(_narrow(source.withColumn("_points", F.char_length("_text").cast("bigint")), hasher).withColumn("_n", F.monotonically_increasing_id()))
    key = ["print", "length"]
    groups = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("group_size"), F.min(_order()).alias("_keep"))
    groups = pin(groups)

    shared = pin(groups.filter("group_size > 1 AND length > 0").select(*key))
    members = pin(rows.join(shared, key).select("_id", "_row", *key).distinct())
    texts = source.withColumnRenamed("_id", "_i").withColumnRenamed("_row", "_r")
    compared = texts.join(members, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_r") == F.col("_row"))).select(*key, _normal(F.col("_text")).alias("_normal"))
    at = F.explode(F.sequence(F.lit(0), F.greatest((F.char_length("_normal") - 1).cast("int"), F.lit(0)), F.lit(PIECE)))
    pieces = compared.withColumn("_at", at).select(*key, "_at", F.expr(f"substring(_normal, _at + 1, {PIECE})").alias("_piece"))
    differing = pieces.groupBy(*key, "_at").agg(F.min("_piece").alias("_a"), F.max("_piece").alias("_b")).filter("_a <> _b")
    differing = pin(differing.select(*key).distinct())

    if differing.isEmpty():
        grouped = rows.join(groups, key)
    else:
        grouped = _by_text(rows, groups, differing, texts, key)
    return grouped.select(
        F.col("_id").alias(id), F.col("_keep._id").alias("keep_id"), "group_size", (F.col("_n") == F.col("_keep._n")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), F.col("_row").alias("row_hash"),
    )


def _order() -> Column:
    """Most code points first, then the smallest id, a null id last."""
    return F.struct((-F.col("_points")).alias("_points"), F.col("_id").isNull().alias("_none"), "_id", "_row", "_n")


def _by_text(rows: DataFrame, groups: DataFrame, differing: DataFrame, texts: DataFrame, key: list[str]) -> DataFrame:
    """Groups as they are where all texts agree, groups by whole text where a fingerprint is shared by different texts."""
    clear = rows.join(groups, key).join(differing, key, "left_anti")
    mixed = pin(rows.join(differing, key, "left_semi"))
    content = texts.select("_i", "_r", _normal(F.col("_text")).alias("_normal")).distinct()
    mixed = pin(mixed.join(content, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_r") == F.col("_row"))).drop("_i", "_r"))
    split = mixed.groupBy("_normal").agg(F.count(F.lit(1)).alias("group_size"), F.min(_order()).alias("_keep"))
    return clear.unionByName(mixed.join(pin(split), "_normal").drop("_normal"))
