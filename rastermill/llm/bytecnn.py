"""Quality of texts by a convolutional network over bytes."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastermill.llm.frames import map_rows, text_bytes
from rastermill.llm.labelled import labelled_sample

WIDTH = 6  # bytes under a filter
STRIDE = 2  # bytes from one place of a filter to the next
STEP = 128  # bytes from one chunk to the next; a chunk is two steps long
FILTERS = 12
EMBED = 8
BLOCK = 256  # steps computed at once


class Network(NamedTuple):
    embed: np.ndarray  # byte -> EMBED
    filters: np.ndarray  # (WIDTH, EMBED, FILTERS)
    bias: np.ndarray  # FILTERS
    weights: np.ndarray  # 2 * FILTERS: largest and mean response over chunks
    offset: float


def _padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each filled up with zero bytes to whole steps, and the steps of each.

    Zero bytes go before a text too, so that no filter at the end of one text sees the next.
    """
    steps = np.array([(len(t) + 2 * WIDTH) // STEP + 1 for t in texts], np.int64)
    data = b"".join(bytes(WIDTH) + t + bytes(n * STEP - len(t) - WIDTH) for t, n in zip(texts, steps.tolist()))
    return np.frombuffer(data + bytes(WIDTH), np.uint8), steps


def _responses(data: np.ndarray, tables: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest filter response within every step, and where it is; ``tables[j][byte]`` is byte's part at place ``j``."""
    count = (len(data) - WIDTH) // STEP
    top, where = np.empty((count, FILTERS), np.float32), np.empty((count, FILTERS), np.int64)
    for k in range(0, count, BLOCK):
        n = min(BLOCK, count - k)
        part = data[k * STEP : (k + n) * STEP + WIDTH]
        total = tables[0][part[: n * STEP : STRIDE]]
        for j in range(1, WIDTH):
            total += tables[j][part[j : j + n * STEP : STRIDE]]
        total = total.reshape(n, STEP // STRIDE, FILTERS)
        top[k : k + n] = total.max(1)
        where[k : k + n] = total.argmax(1)
    return np.maximum(top + bias, 0), where


def _tables(net: Network) -> np.ndarray:
    return np.einsum("be,jef->jbf", net.embed, net.filters).astype(np.float32)


def _chunks(top: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of two steps each that overlap by one: their responses, and the range of chunks of every text."""
    after = np.arange(1, len(top) + 1)
    ends = np.cumsum(steps)
    after[ends - 1] = ends - 1  # a text's last chunk is its last step
    return np.maximum(top, top[after]), ends - steps, after


def _features(chunks: np.ndarray, starts: np.ndarray, steps: np.ndarray) -> np.ndarray:
    return np.hstack([np.maximum.reduceat(chunks, starts), np.add.reduceat(chunks, starts) / steps[:, None]])


def probabilities(texts: list[bytes], net: Network, tables: np.ndarray) -> np.ndarray:
    """Probability of class 1 of each whole text."""
    if not texts:
        return np.zeros(0)
    data, steps = _padded(texts)
    chunks, starts, _ = _chunks(_responses(data, tables, net.bias)[0], steps)
    return 1 / (1 + np.exp(-np.clip(_features(chunks, starts, steps) @ net.weights + net.offset, -30, 30)))


def fit(sample: list[tuple[bytes, int]], epochs: int = 8, rate: float = 0.01, seed: int = 3, favour: float = 2.0) -> Network:
    """Train on ``(text, class)`` by Adam; one class or none gives a constant network.

    The two classes weigh alike, but for ``favour``: to take a good text for a bad one costs that much more.
    """
    r = np.random.default_rng(seed)
    net = Network(
        r.normal(0, 0.5, (256, EMBED)), r.normal(0, 0.3, (WIDTH, EMBED, FILTERS)), np.zeros(FILTERS), r.normal(0, 0.1, 2 * FILTERS), 0.0
    )
    y = np.array([c for _, c in sample], np.float64)
    if not 0 < y.sum() < len(y):
        return net._replace(weights=np.zeros(2 * FILTERS), offset=4.0 if not len(y) or y[0] else -4.0)
    balance = np.where(y == 1, favour / (1 + favour) / y.mean(), 1 / (1 + favour) / (1 - y.mean()))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in map(np.asarray, net)]
    turn = 0
    for _ in range(epochs):
        order = r.permutation(len(sample))
        for at in range(0, len(order), 32):
            batch = order[at : at + 32]
            grads = _gradient([sample[k][0] for k in batch], y[batch], balance[batch], net)
            turn += 1
            new = []
            for p, g, (m, v) in zip(net, grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                new.append(p - rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8))
            net = Network(*new)
    return net._replace(offset=float(net.offset))


def _gradient(texts: list[bytes], y: np.ndarray, weight: np.ndarray, net: Network) -> list[np.ndarray]:
    """Gradient of the weighted log loss; of each maximum only the place that has it takes part."""
    data, steps = _padded(texts)
    top, where = _responses(data, _tables(net), net.bias)
    chunks, starts, after = _chunks(top, steps)
    features = _features(chunks, starts, steps)
    p = 1 / (1 + np.exp(-np.clip(features @ net.weights + net.offset, -30, 30)))
    slope = (p - y) * weight / len(y)
    g_weights, g_offset = features.T @ slope + 1e-4 * net.weights, slope.sum()
    doc = np.repeat(np.arange(len(texts)), steps)
    peak = chunks >= np.maximum.reduceat(chunks, starts)[doc]
    shared = np.add.reduceat(peak, starts)[doc]
    back = slope[doc][:, None] * (net.weights[:FILTERS] * peak / shared + net.weights[FILTERS:] / steps[doc][:, None])
    g_top = np.where(top >= top[after], back, 0)  # the first of two steps if it has the chunk's maximum
    np.add.at(g_top, after, np.where(top < top[after], back, 0))
    g_top *= top > 0
    step, filt = np.nonzero(g_top)
    g = g_top[step, filt]
    place = step * STEP + where[step, filt] * STRIDE
    g_embed, g_filters = np.zeros_like(net.embed), np.zeros_like(net.filters)
    for j in range(WIDTH):
        byte = data[place + j]
        np.add.at(g_embed, byte, g[:, None] * net.filters[j].T[filt])
        np.add.at(g_filters[j].T, filt, g[:, None] * net.embed[byte])
    return [g_embed, g_filters, g_top.sum(0), g_weights, g_offset]


def fit_quality(
    items: DataFrame, labels: DataFrame, id: str = "id", text: str = "description", label: str = "quality", per_class: int = 1500, letters: int = 12_000
) -> Network:
    """Fit on at most ``per_class`` labelled texts of each class, of at most ``letters`` characters each."""
    return fit(labelled_sample(items, labels, id, text, label, per_class, letters))


def quality_scores(items: DataFrame, net: Network, text: str = "description", out: str = "score") -> DataFrame:
    """Add the probability that each collection's whole ``text`` is of good quality.

    Learned filters pass over all bytes of the text; the largest response within
    each of the overlapping chunks is kept, the largest and the mean over the
    chunks are combined into one probability. Long texts are computed in blocks.

    A null text counts as empty, and an empty text has a score too. All rows and
    columns stay as they are; a column named ``out`` is replaced. An empty table
    gives an empty result.
    """
    tables = _tables(net)
    kept = [f for f in items.schema.fields if f.name != out]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{out}` double"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = probabilities(text_bytes(batch, text), net, tables)
        return pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(score)], names=[*(f.name for f in kept), out])

    return map_rows(items, run, schema, rows=50)
