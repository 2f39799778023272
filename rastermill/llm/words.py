"""The most frequent words of a corpus, as a table of bounded size."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastermill.session import pin

HELD = 200_000  # distinct words a task holds before it hands its counts on


def frequent_words(items: DataFrame, text: str, splitter: Callable[[], Callable[[str], list[str]]], most: int, letters: int = 64) -> list[str]:
    """At most ``most`` words of at most ``letters`` characters, the most frequent of all texts.

    ``splitter()`` is called once per task and returns the function that splits.
    Every text is counted; a word that a task meets once is no candidate of that
    task. Words of like frequency are taken or left together, so what comes to
    the driver is bounded by ``most`` and not by the number of partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = splitter(), Counter()
        for batch in batches:
            for value in batch.column(text):
                counts.update(split(value.as_py() or ""))
                if len(counts) > HELD:
                    yield _counted(counts, letters)
                    counts = Counter()
        yield _counted(counts, letters)

    counts = items.select(text).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = pin(counts.withColumn("class", F.floor(F.log2("n") * 8).cast("int")))
    room, lowest = most, None
    for r in sorted(counts.groupBy("class").count().collect(), reverse=True):  # eight classes for each doubling of n
        room -= r["count"]
        if room < 0:
            break
        lowest = r["class"]
    return [] if lowest is None else [r.word for r in counts.filter(F.col("class") >= lowest).select("word").collect()]


def _counted(counts: Counter, letters: int) -> pa.RecordBatch:
    often = [(w, n) for w, n in counts.items() if n > 1 and len(w) <= letters]
    return pa.RecordBatch.from_arrays(
        [pa.array([w for w, _ in often], pa.string()), pa.array([n for _, n in often], pa.int64())], names=["word", "n"]
    )
