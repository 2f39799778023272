"""Removal of passages that repeat across texts, by sliding runs of several sentences."""

from __future__ import annotations

import re
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastermill.llm.frames import map_rows
from rastermill.plans.ordered import global_row_number
from rastermill.session import shared_folder

# behind the blanks that follow a sentence mark with its closing quotes and brackets, and behind line ends
_END = re.compile(r"""\n|[.!?]["'»”’)\]}]*[ \t]+(?=\S)""")
_WORD = re.compile(r"\S+")
_BASE = 0x9E3779B97F4A7C15
_LONG = 12  # words of a sentence beyond which it is cut
_NEAR = 4  # words on either side that a cut inside a clause is the least of


def sentences(text: str) -> list[str]:
    """Cut behind sentence marks and line ends; the parts make up the text again."""
    edges = [0, *[m.end() for m in _END.finditer(text)], len(text)]
    return [text[a:b] for a, b in zip(edges, edges[1:]) if a < b]


def n_sentences(text: str) -> int:
    """How many parts ``sentences`` cuts; a line end is the only cut that can be the text's end."""
    return len(_END.findall(text)) + (text != "" and not text.endswith("\n"))


def word_hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash per word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def clause_starts(sizes: list[int], hashes: np.ndarray) -> np.ndarray:
    """Numbers of the words that sentences, or parts of long ones, begin with; ``sizes`` are words per sentence.

    Sentences of more than 12 words are cut behind words that are one of the
    three before again, or whose hash is less than those of the four on either
    side: cuts hang on near words only, so a passage has the same ones wherever
    it begins and ends.
    """
    n = len(hashes)
    size = np.array([k for k in sizes if k], np.int64)
    first = np.cumsum(size) - size
    wide = np.concatenate([np.zeros(_NEAR, np.uint64), hashes, np.zeros(_NEAR, np.uint64)])
    least, again = np.ones(n, bool), np.zeros(n, bool)
    for k in range(1, _NEAR + 1):
        before = wide[_NEAR - k : n + _NEAR - k]
        least &= (hashes < before) & (hashes < wide[_NEAR + k : n + _NEAR + k])
        if k < _NEAR:
            again |= hashes == before
    cuts = 1 + np.flatnonzero((least | again) & np.repeat(size > _LONG, size))
    return np.union1d(first, cuts[cuts < n])


def sentence_runs(starts: np.ndarray, n: int, several: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """``(from, to)`` in words: the shortest runs that begin or end at each sentence or part, of ``several`` of them and ``least`` words."""
    edges = np.append(starts, n)
    count = len(starts)
    at = np.arange(count + 1)
    ahead = np.maximum(at + several, np.searchsorted(edges, edges + least))
    back = np.minimum(at - several, np.searchsorted(edges, edges - least, "right") - 1)
    a = np.concatenate([at[ahead <= count], back[back >= 0]])
    b = np.concatenate([ahead[ahead <= count], at[back >= 0]])
    pairs = np.unique(a * (count + 1) + b)
    return edges[pairs // (count + 1)], edges[pairs % (count + 1)]


def run_hashes(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of words from ``a`` to ``b``: differences of prefix sums, moved to one place."""
    up = np.multiply.accumulate(np.full(len(hashes), _BASE, np.uint64))
    down = np.multiply.accumulate(np.full(len(hashes), pow(_BASE, -1, 1 << 64), np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(hashes * up)])
    found = (sums[b] - sums[a]) * down[a]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        found = (found ^ (found >> np.uint64(shift))) * np.uint64(factor)
    return (found ^ (found >> np.uint64(31))).view(np.int64)


def text_runs(text: str, several: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(code, from, to)`` of all runs of a text, by place."""
    parts = [part.split() for part in sentences(text.lower())]
    hashes = word_hashes(list(chain.from_iterable(parts)))
    if len(hashes) < least:
        return (np.zeros(0, np.int64),) * 3
    a, b = sentence_runs(clause_starts([len(part) for part in parts], hashes), len(hashes), several, least)
    return run_hashes(hashes, a, b), a, b


def remove_repeated_passages(items: DataFrame, id: str = "id", text: str = "description", several: int = 3, least: int = 25) -> DataFrame:
    """``(id, text, n_sentences, n_removed)``: collection descriptions without passages that stand elsewhere before.

    Every shortest run of ``several`` consecutive sentences with ``least`` words
    or more is hashed (one that begins and one that ends at each sentence) and
    joined over all texts, without regard to case and blanks. Of equal runs the
    first stays, by id (null last), then place; the sentences that the others
    cover go with the blanks behind them. Of a sentence of more than 12 words
    each part counts as one (see ``clause_starts``), so that passages that begin
    and end inside sentences, or have few of them, are found too; their edges, up
    to the first and from the last whole part, stay, as do shorter repeats
    (a licence line, a title). ``n_removed`` counts sentences of which no word is left.

    The runs of a text, each once, are written to the shared folder; those that
    occur again are chosen by counts that combine before the shuffle. A text
    with such runs hashes its own once more to place them.

    A null or empty text stays as it is. Rows with one id and text are one
    document with one result, a row each. Other columns are ignored, whatever
    their names. An empty table gives an empty result.
    """
    spark = items.sparkSession
    source = items.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("_text")).withColumn("_key", F.xxhash64("_id", "_text"))
    kind = source.schema["_id"].dataType.simpleString()

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, codes, times = ([np.zeros(0, np.int64)] for _ in range(3))
        for key, value in zip(batch.column("_key").to_pylist(), batch.column("_text")):
            code, n = np.unique(text_runs(value.as_py() or "", several, least)[0], return_counts=True)
            keys.append(np.full(len(code), key, np.int64))
            codes.append(code)
            times.append(np.minimum(n, 2))
        columns = [pa.array(np.concatenate(x)) for x in (keys, codes, times)]
        return pa.RecordBatch.from_arrays([*columns[:2], columns[2].cast(pa.int32())], names=["_key", "code", "times"])

    folder = f"{shared_folder(spark, 'spans')}/runs-{uuid.uuid4().hex}"
    map_rows(source, hashed, "_key bigint, code bigint, times int").write.parquet(folder)
    runs = spark.read.parquet(folder)
    often = runs.groupBy("code").agg(F.sum("times").alias("n")).filter("n > 1").select("code")
    # documents in order get numbers, so that the first one of a run combines before the shuffle
    ranked = source.select("_id", "_key").distinct()
    ranked = global_row_number(ranked, [F.col("_id").asc_nulls_last(), F.col("_key").asc()], "_nth").select("_key", "_nth")
    # rows with one id and text are one document
    folder = f"{shared_folder(spark, 'spans')}/repeated-{uuid.uuid4().hex}"
    runs.join(often, "code").join(ranked, "_key").select("code", "_nth", "_key", "times").distinct().write.parquet(folder)
    repeated = spark.read.parquet(folder)
    first = repeated.groupBy("code").agg(F.min("_nth").alias("_first"))
    again = repeated.join(first, "code").filter("_nth <> _first OR times > 1").select("_key", "code", (F.col("_nth") == F.col("_first")).alias("own"))
    covered = again.groupBy("_key").agg(F.collect_list(F.struct("code", "own")).alias("_runs"))
    joined = source.join(covered, "_key", "left").select("_id", "_text", "_runs")

    def cleaned(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, total, removed = [], [], []
        for value, found in zip(batch.column("_text"), batch.column("_runs")):
            value = value.as_py()
            if not found.is_valid:
                texts.append(value)
                total.append(n_sentences(value or ""))
                removed.append(0)
                continue
            parts = sentences(value)
            total.append(len(parts))
            codes, own = (found.values.field(name).to_numpy(zero_copy_only=False) for name in ("code", "own"))
            code, a, b = text_runs(value, several, least)
            gone = np.isin(code, codes)
            once, at = np.unique(code, return_index=True)  # the first place of each
            gone[at[np.isin(once, codes[own])]] = False
            begins = [m.start() for m in _WORD.finditer(value)]
            change = np.zeros(len(begins) + 1, np.int64)
            np.add.at(change, a[gone], 1)
            np.add.at(change, b[gone], -1)
            stays = np.cumsum(change)[:-1] == 0
            edges = [*begins, len(value)]
            texts.append(value[: begins[0]] + "".join(value[x:y] for x, y, s in zip(edges, edges[1:], stays.tolist()) if s))
            first = np.searchsorted(begins, np.cumsum([0, *map(len, parts)]))
            left = np.concatenate([[0], np.cumsum(stays)])[first]
            removed.append(int(((np.diff(left) == 0) & (np.diff(first) > 0)).sum()))
        columns = [batch.column("_id"), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["_id", "_out", "n_sentences", "n_removed"])

    done = map_rows(joined, cleaned, f"_id {kind}, _out string, n_sentences bigint, n_removed bigint")
    return done.select(F.col("_id").alias(id), F.col("_out").alias(text), "n_sentences", "n_removed")
