"""Token counts of whole texts, counting every distinct pre-token once."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastermill.llm.words import frequent_words

FREQUENT = 1 << 18
_SPACE = "▁"


def _processor(path: str) -> sentencepiece.SentencePieceProcessor:
    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [pieces.id_to_piece(k) for k in range(pieces.get_piece_size())]
    if any(_SPACE in n.lstrip(_SPACE) or "\n" in n for n in names):
        raise ValueError("pieces of this model reach over blanks or line ends, so its texts can't be cut there")
    return pieces


def pre_tokens(text: str) -> list[str]:
    """Cut ``text`` where no piece can reach over: before a run of blanks and at both sides of a line end."""
    return _CUT.findall(_SPACE + text.replace(" ", _SPACE)) if text else []


_CUT = re.compile(f"{_SPACE}+[^{_SPACE}\n]*|\n|[^{_SPACE}\n]+")


def piece_counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function that counts the pieces of pre-tokens, each as it stands inside a text."""
    pieces = _processor(path)
    # a leading line end keeps the model from putting its own blank before the pre-token
    lead = len(pieces.encode("\n"))
    return lambda tokens: [len(ids) - lead for ids in pieces.encode(["\n" + t for t in tokens], num_threads=1)]


def count_tokens(items: DataFrame, path: str, id: str = "id", text: str = "json", limit: int = 4096, frequent: int = FREQUENT) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of each STAC document under the sentencepiece model at ``path``.

    The pieces of each distinct pre-token are counted once. The counts of the
    ``frequent`` most frequent pre-tokens, a bounded table, go to the tasks that
    split the texts. The other pre-tokens, none of them crowded, are brought
    together with their frequencies per document, counted where they meet, and
    summed per document. No ids are made per text.

    A null or empty text has no tokens. Very long pre-tokens are counted as a
    whole. Null ids and repeated rows keep a row each. Other columns are ignored,
    whatever their names. An empty table gives an empty result.
    """
    source = items.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("_text"))
    words = frequent_words(source, "_text", lambda: pre_tokens, frequent)
    known = dict(zip(words, piece_counter(path)(words)))
    shared = items.sparkSession.sparkContext.broadcast(known)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per text with what the frequent pre-tokens make, and a row per other pre-token of the text."""
        known = shared.value
        for batch in batches:
            ids, keys, texts = batch.column("_id"), batch.column("_key"), batch.column("_text")
            for start in range(0, batch.num_rows, 200):
                at, named, word, times, size = [], [], [], [], []
                for k in range(start, min(start + 200, batch.num_rows)):
                    value, sure = texts[k].as_py() or "", 0
                    for token, n in Counter(pre_tokens(value)).items():
                        pieces = known.get(token)
                        if pieces is None:
                            at.append(k)
                            named.append(None)
                            word.append(token)
                            times.append(n)
                            size.append(None)
                        else:
                            sure += n * pieces
                    at.append(k)
                    named.append(k)
                    # no pre-token is a line end and more, so this one meets nothing and is spread evenly
                    word.append(f"\n{keys[k].as_py()}")
                    times.append(sure)
                    size.append(len(value.encode()))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(named, pa.int64())), keys.take(pa.array(at, pa.int64())), pa.array(word, pa.string()),
                     pa.array(times, pa.int64()), pa.array(size, pa.int64())],
                    names=["_id", "_key", "word", "times", "size"],
                )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by word: the pieces of each word are counted once, its rows weighted with them."""
        pieces, last, weight = piece_counter(path), None, 0
        for batch in batches:
            words = batch.column("word").to_pylist()
            new = [w for w, before in zip(words, [last, *words]) if w != before]
            weights = iter([1 if w[0] == "\n" and w != "\n" else n for w, n in zip(new, pieces(new))])
            total = []
            for w, n in zip(words, batch.column("times").to_pylist()):
                if w != last:
                    last, weight = w, next(weights)
                total.append(n * weight)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_key"), batch.column("size"), pa.array(total, pa.int64())], names=["_id", "_key", "size", "total"]
            )

    kind = items.schema[id].dataType.simpleString()
    parts = source.withColumn("_key", F.xxhash64("_id", "_text")).mapInArrow(split, f"_id {kind}, _key bigint, word string, times bigint, size bigint")
    met = parts.repartition("word").sortWithinPartitions("word").mapInArrow(count, f"_id {kind}, _key bigint, size bigint, total bigint")
    summed = met.groupBy("_key").agg(
        F.max("_id").alias("_id"), F.count("size").alias("rows"), F.max("size").alias("n_bytes"), F.sum("total").alias("total")
    )
    # rows with one id and text were added up
    return summed.select(
        F.col("_id").alias(id), "n_bytes", F.expr("total div rows").alias("n_tokens"),
        F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("_nth"),
    ).select(id, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
