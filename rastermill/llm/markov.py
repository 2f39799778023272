"""Secrets in log texts: fixed patterns, and character Markov models of random strings and ordinary identifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
# fixed patterns of the contract; the keyword's letters match in either case, the rest as written
ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
IDENTIFIER = re.compile(r"[A-Za-z0-9+/_=-]{4,}")

_CLASS = np.zeros(128, np.int64)  # letters in either case, digits and marks apart; 0 stands for anything else
for _k, _c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-.", 1):
    _CLASS[ord(_c)] = _k
SYMBOLS = int(_CLASS.max()) + 1


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the fixed patterns, by start, then kind as listed."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda s: (s[0], s[2]))]


def _steps(words: list[str]) -> np.ndarray:
    """Transition counts of the characters of ``words``; each word starts at symbol 0."""
    joined = _CLASS[np.frombuffer("\n".join(["", *words]).encode("ascii"), np.uint8)] if words else np.zeros(1, np.int64)
    return np.bincount(joined[:-1] * SYMBOLS + joined[1:], minlength=SYMBOLS * SYMBOLS)


def _outside(text: str, spans: list[tuple[int, int, str]], pattern: re.Pattern) -> list[re.Match]:
    """Matches of ``pattern`` that touch none of ``spans``, in one sweep over both."""
    found, at = [], 0
    for m in pattern.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            at += 1
        found.append((m, at))
    ends = np.maximum.accumulate([0, *(b for _, b, _ in spans)])  # the furthest end among the first spans
    return [m for m, k in found if ends[k] <= m.start()]


def _samples(text: str) -> tuple[list[str], list[str]]:
    """Random strings and ordinary identifiers of a text, labelled by the fixed patterns."""
    spans = base_spans(text)
    random = [m[1] for m in ASSIGN.finditer(text) if len(m[1]) >= 16 and any(c.isdigit() for c in m[1])] + [text[a:b] for a, b, k in spans if k == "access"]
    return random, [m[0] for m in _outside(text, spans, IDENTIFIER)] if spans else IDENTIFIER.findall(text)


def train(entries: DataFrame, text: str = "detail", prior: float = 0.5) -> np.ndarray:
    """Log-likelihood ratio of every transition, random strings against ordinary identifiers.

    The samples are labelled by the fixed patterns: values of assignments and
    access keys are random strings, runs of letters, digits and marks outside of
    any match are ordinary identifiers. Transitions of all texts are counted in the tasks and added up;
    what reaches the driver is one table per model, whatever the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, SYMBOLS * SYMBOLS), np.int64)
        for batch in batches:
            for value in batch.column(0):
                for k, words in enumerate(_samples(value.as_py() or "")):
                    counts[k] += _steps(words)
        model, step = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(model), pa.array(step), pa.array(counts[model, step])], names=["model", "step", "n"])

    rows = entries.select(F.col(text).cast("string").alias("_text")).mapInArrow(run, "model bigint, step bigint, n bigint")
    counts = np.full((2, SYMBOLS, SYMBOLS), prior)
    for r in rows.groupBy("model", "step").agg(F.sum("n").alias("n")).collect():  # at most 2 * SYMBOLS^2 rows
        counts[r.model].flat[r.step] += r.n
    logs = np.log(counts / counts.sum(axis=2, keepdims=True))
    return logs[0] - logs[1]


def ratios(words: list[str], model: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of every word, the sum over its characters: above 0 it looks random, longer ones weigh more."""
    if not words:
        return np.zeros(0)
    symbols = _CLASS[np.frombuffer("\n".join(["", *words]).encode("ascii"), np.uint8)]
    steps = np.where(symbols[1:] == 0, 0.0, model[symbols[:-1], symbols[1:]])
    return np.add.reduceat(steps, np.cumsum([0, *(len(w) + 1 for w in words[:-1])]))


def secret_spans(text: str, model: np.ndarray, least: float) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns, and of other strings that look random, ordered by start and kind."""
    spans = base_spans(text)
    others = _outside(text, spans, CANDIDATE)
    random = [(m.start(), m.end(), "random") for m, r in zip(others, ratios([m[0] for m in others], model)) if r >= least]
    return sorted(spans + random, key=lambda s: (s[0], KINDS.index(s[2])))


def find_secrets(entries: DataFrame, id: str = "id", text: str = "detail", least: float = 10.0, model: np.ndarray | None = None) -> DataFrame:
    """``(id, spans)`` per audit entry: secrets in its ``detail``, as ``array<struct<kind,start,end>>`` in code points.

    ``assign``, ``access`` and ``hex`` are the fixed patterns. ``random`` marks
    other runs of 12 or more letters, digits and marks whose log-likelihood ratio
    under the two Markov models, added up over their characters, is ``least`` or
    more (natural logarithm; 10 stands for odds of 22 000 to one, since nearly
    all runs are ordinary). Nothing else decides. The models are trained on all of ``entries`` unless one is given.

    A null or empty text has no spans. Null ids and repeated rows keep a row each.
    Other columns are ignored, whatever their names. An empty table gives an
    empty result.
    """
    model = train(entries, text) if model is None else model
    source = entries.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [
                [{"kind": k, "start": a, "end": b} for a, b, k in secret_spans(value.as_py() or "", model, least)] for value in batch.column("_text")
            ]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(found, kind)], names=["_id", "spans"])

    schema = f"_id {source.schema['_id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return source.mapInArrow(run, schema).withColumnRenamed("_id", id)
