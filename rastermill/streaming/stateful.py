"""Per-key state machines. The state of a key is small, whatever the number of its rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rastermill.operators.flow import BURST, BURST_S, EXEMPT_PATHS, MAX_CONSECUTIVE_FAILS, MINUTE_S, REQUESTS_PER_MINUTE, admit
from rastermill.streaming.replay import replay_stream
from rastermill.streaming.run import timed

WATERMARK = "10 minutes"
RATE_SCHEMA = "client bigint, seq bigint, admitted boolean"
BREAKER_SCHEMA = "account_id bigint, seq bigint"


def st_rate_limit(
    stream: DataFrame, target: str, checkpoint: str, rpm: int = REQUESTS_PER_MINUTE, burst: int = BURST,
    minute_s: int = MINUTE_S, burst_s: int = BURST_S, available_now: bool = False,
) -> StreamingQuery:
    """(client, seq, admitted) per request, in ``target``; read them by ``read_replayed`` with ``RATE_SCHEMA``.

    The state of a client is at most ``rpm`` admitted times; it fades once they are older than the wider window.
    Requests count at their own time, also those that come late.
    """
    minute_us, burst_us = minute_s * 1_000_000, burst_s * 1_000_000

    def decide(admitted: list[int], rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return {"seq": rows["seq"], "admitted": admit(rows["us"], admitted, rpm, burst, minute_us, burst_us)}

    limited = stream.filter(~F.col("path").isin(*EXEMPT_PATHS)).select("client", "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return replay_stream(
        limited, target, checkpoint, "client", ["us", "seq"], ["seq"], decide, {"seq": "bigint", "admitted": "boolean"},
        newest="us", span=max(minute_us, burst_us), available_now=available_now,
    )


def st_fail_breaker(stream: DataFrame, target: str, checkpoint: str, limit: int = MAX_CONSECUTIVE_FAILS, available_now: bool = False) -> StreamingQuery:
    """(account_id, seq) of the failure that disables an account: the ``limit``-th in a row, once per account; ``BREAKER_SCHEMA``."""

    def watch(state: list[int], rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        run, disabled = state or (0, 0)
        failed = rows["success"] == 0
        nth = np.arange(1, len(failed) + 1)
        # failures since the last success, counted on from the rows before
        since = nth - np.maximum.accumulate(np.where(failed, 0, nth))
        since = since + np.where(np.maximum.accumulate(~failed), 0, run)
        tripped = np.flatnonzero(failed & (since >= limit))[: 1 - disabled]
        state[:] = [int(since[-1]), int(disabled or len(tripped) > 0)]
        return {"seq": rows["seq"][tripped]}

    rows = stream.select("account_id", "seq", "success")
    return replay_stream(rows, target, checkpoint, "account_id", ["seq"], ["success"], watch, {"seq": "bigint"}, available_now=available_now)


def _joined(spans: list[tuple[int, int, bool]], ttl: int) -> list[tuple[int, int, bool]]:
    """Spans of (first beat, last beat, told), where none is alive when the next begins."""
    out: list[tuple[int, int, bool]] = []
    for start, last, told in sorted(spans):
        if out and start - out[-1][1] < ttl:
            before = out[-1]
            out[-1] = (before[0], max(before[1], last), before[2] or told)
        else:
            out.append((start, last, told))
    return out


def st_liveness_changes(stream: DataFrame, ttl_s: int = 300, watermark: str = WATERMARK) -> DataFrame:
    """(node_id, at, alive): a node is back at its first heartbeat, and gone when a timer runs out ``ttl_s`` seconds after its last.

    A change is told once the watermark has passed it, so heartbeats that come out of order, but in time, are all weighed
    first; later ones are dropped. The state holds the node's spans of life that are not settled: their number is bounded by the
    watermark's delay over ``ttl_s``, whatever the number of heartbeats.
    """
    ttl = ttl_s * 1_000_000

    def follow(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spans = [(int(a), int(b), bool(c)) for a, b, c in zip(*state.get)] if state.exists else []
        for chunk in chunks:
            us = np.sort(chunk["us"].to_numpy())
            if len(us):
                gaps = np.flatnonzero(np.diff(us) >= ttl)
                fresh = zip(us[[0, *(gaps + 1)]].tolist(), us[[*gaps, len(us) - 1]].tolist())
                spans = _joined([*spans, *((a, b, False) for a, b in fresh)], ttl)
        now, kept, told = state.getCurrentWatermarkMs() * 1000, [], []
        for start, last, known in spans:
            if not known and start <= now:
                told.append((start, True))
            if last + ttl <= now:
                told.append((last + ttl, False))
            else:
                kept.append((start, last, known or start <= now))
        if kept:
            state.update(tuple(list(x) for x in zip(*kept)))
            due = min(last + ttl if known else start for start, last, known in kept)
            state.setTimeoutTimestamp(max(due // 1000, now // 1000 + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"node_id": [key[0]] * len(told), "us": [t for t, _ in told], "alive": [a for _, a in told]}).astype(
            {"us": "int64", "alive": "bool"}
        )

    kind = stream.schema["node_id"].dataType.simpleString()
    beats = timed(stream, watermark).select("node_id", "ts", F.unix_micros("ts").alias("us")).groupBy("node_id")
    changes = beats.applyInPandasWithState(
        follow, f"node_id {kind}, us bigint, alive boolean", "starts array<bigint>, lasts array<bigint>, told array<boolean>", "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    return changes.select("node_id", F.timestamp_micros("us").alias("at"), "alive")
