"""Toxicity of texts by a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rastermill.llm.frames import map_rows, text_bytes
from rastermill.llm.labelled import labelled_sample

SIZES = (4, 5, 6)  # bytes of an n-gram, blanks included
BITS = 18
BLOCK = 1 << 20
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\n\t\r\x0b\x0c", b"abcdefghijklmnopqrstuvwxyz     ")


def features(text: bytes) -> np.ndarray:
    """Distinct hashed n-grams of the whole text, small letters, a blank before and after."""
    data = np.frombuffer(b" " + text.translate(_FOLD) + b" ", np.uint8)
    seen = []
    for start in range(0, len(data), BLOCK):
        part = data[start : start + BLOCK + max(SIZES) - 1].astype(np.uint64)
        found = []
        for n in SIZES:
            if len(part) >= n:
                code = np.zeros(len(part) - n + 1, np.uint64)
                for j in range(n):
                    code = code << np.uint64(8) | part[j : j + len(code)]
                code = (code ^ np.uint64(n << 56)) * np.uint64(0x9E3779B97F4A7C15)
                found.append((code >> np.uint64(64 - BITS)).astype(np.int32))
        seen.append(_distinct(np.concatenate(found)) if found else np.zeros(0, np.int32))
    return seen[0] if len(seen) == 1 else _distinct(np.concatenate(seen))


def _distinct(codes: np.ndarray) -> np.ndarray:
    codes = np.sort(codes)
    return codes[np.concatenate([[True], codes[1:] != codes[:-1]])] if len(codes) else codes


class Model:
    """``weights[feature]`` is the learned weight times the log-count ratio."""

    def __init__(self, weights: np.ndarray, offset: float):
        self.weights, self.offset = weights, offset

    def probability(self, text: bytes) -> float:
        margin = float(self.weights[features(text)].sum(dtype=np.float64)) + self.offset
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def fit(sample: list[tuple[bytes, int]], smooth: float = 1.0, least: float = 0.7, penalty: float = 1e-5, rounds: int = 400) -> Model:
    """Logistic regression on features scaled by their log-count ratio, classes weighted alike; momentum descent.

    Features in fewer than four texts, or with a ratio below ``least`` either way, have no weight.
    """
    y = np.array([c for _, c in sample], np.float64)
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(1 << BITS, np.float32), 4.0 if len(y) and y[0] else -4.0)
    rows = [features(t) for t, _ in sample]
    count, sizes = len(rows), np.array([len(f) for f in rows])
    cols, doc = np.concatenate(rows), np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    del rows[:]
    with_one = np.bincount(cols, y[doc], 1 << BITS)
    total = np.bincount(cols, minlength=1 << BITS)
    p = (with_one + smooth) / (y.sum() + 2 * smooth)
    q = (total - with_one + smooth) / ((1 - y).sum() + 2 * smooth)
    ratio = np.log(p / q)
    ratio[(total < 4) | (np.abs(ratio) < least)] = 0
    keep = ratio[cols] != 0
    cols, doc = cols[keep], doc[keep]
    value = ratio[cols]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    w, offset = np.zeros(1 << BITS), 0.0
    norms = np.bincount(doc, value * value, count)
    # the offset is a feature as large as a row, else it would lag behind; no direction overshoots at this rate
    one = np.sqrt(norms.mean() + 1)
    rate = 4.0 / (norms.max() + one * one)
    speed, speed_offset = np.zeros(1 << BITS), 0.0
    for _ in range(rounds):
        ahead, ahead_offset = w + 0.95 * speed, offset + 0.95 * speed_offset
        margin = np.bincount(doc, ahead[cols] * value, count) + one * ahead_offset
        slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) * weight
        grad = np.bincount(cols, slope[doc] * value, 1 << BITS) + penalty * ahead
        speed = 0.95 * speed - rate * grad
        speed_offset = 0.95 * speed_offset - rate * one * slope.sum()
        w, offset = w + speed, offset + speed_offset
    offset *= one
    return Model((w * ratio).astype(np.float32), float(offset))


def fit_toxicity(
    entries: DataFrame, labels: DataFrame, id: str = "id", text: str = "detail", label: str = "toxic", per_class: int = 1000, letters: int = 12_000
) -> Model:
    """Fit on at most ``per_class`` labelled texts of each class, of at most ``letters`` characters each."""
    return fit(labelled_sample(entries, labels, id, text, label, per_class, letters))


def toxicity_scores(entries: DataFrame, model: Model, text: str = "detail", out: str = "score") -> DataFrame:
    """Add the probability that each audit entry's whole ``text`` is toxic.

    A feature is present or not, however often it occurs, so a long text is not
    diluted. A null text counts as empty, and an empty text has a score too. All
    rows and columns stay as they are; a column named ``out`` is replaced. An
    empty table gives an empty result.
    """
    kept = [f for f in entries.schema.fields if f.name != out]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{out}` double"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = pa.array([model.probability(t) for t in text_bytes(batch, text)], pa.float64())
        return pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), score], names=[*(f.name for f in kept), out])

    return map_rows(entries, run, schema)
