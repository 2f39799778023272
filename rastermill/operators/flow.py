"""Request rates, admission, account health and bandwidth shares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rastermill.functions.numbers import floor_div
from rastermill.functions.times import micros, moment
from rastermill.plans.ordered import carried_max, trailing_counts
from rastermill.plans.pick import first_per_key

# Limiter defaults, paths never limited, failure limit.
REQUESTS_PER_MINUTE = 120
BURST = 20
MINUTE_S = 60
BURST_S = 2
EXEMPT_PATHS = ("/", "/health")
MAX_CONSECUTIVE_FAILS = 5

# Share of the base rate per nice level.
NICE_MULTIPLIERS = {
    -10: 4.0, -9: 3.5, -8: 3.0, -7: 2.5, -6: 2.0, -5: 1.75, -4: 1.5, -3: 1.25, -2: 1.1, -1: 1.05,
    0: 1.0, 1: 0.95, 2: 0.9, 3: 0.85, 4: 0.8, 5: 0.7, 6: 0.6, 7: 0.5, 8: 0.4, 9: 0.3,
    10: 0.25, 11: 0.22, 12: 0.20, 13: 0.18, 14: 0.16, 15: 0.14, 16: 0.13, 17: 0.12, 18: 0.11, 19: 0.10,
}


def _limited(requests: DataFrame) -> DataFrame:
    return requests.filter(~F.col("path").isin(*EXEMPT_PATHS))


def rate_window_counts(requests: DataFrame, minute_s: int = MINUTE_S, burst_s: int = BURST_S) -> DataFrame:
    """Requests of the same client in the trailing minute and burst window, this one included."""
    timed = _limited(requests).withColumn("_us", micros("ts"))
    return trailing_counts(timed, "client", "_us", (minute_s, burst_s), ("in_minute", "in_burst")).drop("_us")


def _crowded(histogram: DataFrame, cell: str, limit: int) -> DataFrame:
    """Cells that, together with the cell before, hold more than ``limit`` requests."""
    counted_for = F.explode(F.array(F.col(cell), F.col(cell) + 1)).alias(cell)
    pairs = histogram.select("_who", counted_for, "_n").groupBy("_who", cell).agg(F.sum("_n").alias("_n"))
    return pairs.filter(F.col("_n") > limit).select("_who", cell)


def rate_admission(
    requests: DataFrame, rpm: int = REQUESTS_PER_MINUTE, burst: int = BURST, minute_s: int = MINUTE_S, burst_s: int = BURST_S
) -> DataFrame:
    """Admit or reject each request, where rejected requests do not count.

    Admission depends on order, but only under load. Time is cut into cells as
    long as the windows; if a cell and the one before hold no more requests
    than the limits allow, everything in it is admitted whatever came earlier.
    The cells come from two counts that combine on the map side. Only runs of
    crowded cells are replayed in order, each with the quiet cell in front of
    it, whose requests are exactly what the limiter remembers at that point.
    Requests of one instant are replayed as their number and told apart by
    ``seq``, which is unique.
    """
    long_us, short_us = minute_s * 1_000_000, burst_s * 1_000_000
    who = F.coalesce(F.col("client").cast("string"), F.lit("unknown"))
    timed = _limited(requests).withColumn("_us", micros("ts")).withColumn("_who", who)
    timed = timed.withColumn("_cell", floor_div("_us", long_us))

    histogram = timed.groupBy("_who", "_cell", floor_div("_us", short_us).alias("_short")).agg(F.count(F.lit(1)).alias("_n"))
    bursts = _crowded(histogram, "_short", burst)
    first_us = F.col("_short") * F.lit(short_us)
    touched = F.explode(F.array_distinct(F.array(floor_div(first_us, long_us), floor_div(first_us + (short_us - 1), long_us))))
    hot = _crowded(histogram, "_cell", rpm).unionByName(bursts.select("_who", touched.alias("_cell"))).distinct()
    # neighbouring cells share cell number minus position; a client has one row per crowded cell here
    position = F.row_number().over(Window.partitionBy("_who").orderBy("_cell"))
    runs = hot.withColumn("_run", F.col("_cell") - position)
    before = runs.groupBy("_who", "_run").agg((F.min("_cell") - 1).alias("_cell"))
    replayed_cells = runs.select("_who", "_cell", "_run").unionByName(before.select("_who", "_cell", "_run"))

    # Python sees one row per instant with requests in a replayed cell, whatever their number and columns
    instants = timed.groupBy("_who", "_cell", "_us").agg(F.count(F.lit(1)).alias("_n")).join(replayed_cells, ["_who", "_cell"])
    ordered = instants.select("_who", "_run", "_us", "_n").repartition("_who", "_run").sortWithinPartitions("_who", "_run", "_us")
    decided = ordered.mapInPandas(
        _replayer(rpm, burst, long_us, short_us), "_who string, _us bigint, _n bigint, _admitted bigint"
    )
    # of an instant admitted in part, the first requests are; at most ``limit`` of them are looked at
    limit = min(rpm, burst)
    divided = decided.filter("_admitted > 0 AND _admitted < _n").select("_who", "_us", "_admitted")
    place = F.row_number().over(Window.partitionBy("_who", "_us").orderBy("seq"))
    ranked = timed.select("_who", "_us", "seq").join(divided, ["_who", "_us"]).withColumn("_place", place).filter(F.col("_place") <= limit)
    last = ranked.filter("_place = _admitted").select("_who", "_us", F.col("seq").alias("_last"))
    verdicts = decided.join(last, ["_who", "_us"], "left")
    admitted = F.when(F.col("_n").isNull() | (F.col("_admitted") >= F.col("_n")), True).otherwise(F.coalesce(F.col("seq") <= F.col("_last"), F.lit(False)))
    return timed.join(verdicts, ["_who", "_us"], "left").select(*requests.columns, admitted.alias("admitted"))


def admit(times: np.ndarray, admitted: list[int], rpm: int, burst: int, minute_us: int, burst_us: int) -> np.ndarray:
    """Verdicts for sorted request ``times`` of a client.

    ``admitted`` holds the latest admitted times, at most the larger limit of
    them, and is updated in place. After an admission the next one is the first
    request late enough for both windows, found by binary search, so a flood of
    rejected requests costs nothing.
    """
    verdicts = np.zeros(len(times), dtype=bool)
    keep = max(rpm, burst)
    at = 0
    while at < len(times) and min(rpm, burst) > 0:
        for limit, span in ((rpm, minute_us), (burst, burst_us)):
            if len(admitted) >= limit:
                at = max(at, int(np.searchsorted(times, admitted[-limit] + span, side="right")))
        if at < len(times):
            verdicts[at] = True
            admitted.append(int(times[at]))
            if len(admitted) > 1 and admitted[-2] > admitted[-1]:  # a late row of a stream
                admitted.sort()
            del admitted[:-keep]
            at += 1
    return verdicts


def _replayer(rpm: int, burst: int, minute_us: int, burst_us: int):
    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows arrive sorted by run and time and a run may span batches; the
        # state is one run's latest admitted times, whatever its length.
        current, admitted = None, []
        for pdf in batches:
            if pdf.empty:
                continue
            whos, runs = pdf["_who"].to_numpy(), pdf["_run"].to_numpy()
            # no instant admits more requests than the smaller limit
            copies = np.clip(pdf["_n"].to_numpy(), 1, max(1, min(rpm, burst)))
            starts = np.cumsum(copies) - copies
            times = np.repeat(pdf["_us"].to_numpy(), copies)
            borders = np.flatnonzero((whos[1:] != whos[:-1]) | (runs[1:] != runs[:-1])) + 1
            verdicts = []
            for first, last in zip([0, *borders], [*borders, len(pdf)]):
                if (whos[first], runs[first]) != current:
                    current, admitted = (whos[first], runs[first]), []
                end = starts[last] if last < len(pdf) else len(times)
                verdicts.append(admit(times[starts[first] : end], admitted, rpm, burst, minute_us, burst_us))
            counts = np.add.reduceat(np.concatenate(verdicts), starts, dtype=np.int64)
            yield pdf[["_who", "_us", "_n"]].assign(_admitted=counts)

    return replay


def fail_streaks(
    log: DataFrame, limit: int = MAX_CONSECUTIVE_FAILS, slice_rows: int = 1_000_000, resets: DataFrame | None = None
) -> DataFrame:
    """Longest run of failures per account; ``limit`` in a row make it unhealthy until it is reset.

    A run is named by the last success before it. An account's history is cut
    into slices of ``slice_rows`` sequence numbers so a busy account spreads.
    ``resets`` (account_id, seq) names what an administrator reset: log rows up
    to an account's last reset no longer count, and it is healthy after it.
    """
    if resets is not None:
        last = resets.groupBy("account_id").agg(F.max("seq").alias("_reset"))
        told = log.select("account_id", "seq", "success").join(last, "account_id", "left")
        counted = told.filter(F.col("_reset").isNull() | (F.col("seq") > F.col("_reset"))).drop("_reset")
        streaks = fail_streaks(counted, limit, slice_rows)
        quiet = last.join(streaks, "account_id", "left_anti")
        return streaks.unionByName(quiet.select("account_id", F.lit(0).cast("bigint").alias("longest"), F.lit(True).alias("healthy")))
    sliced = log.select("account_id", "seq", "success").withColumn("_slice", floor_div("seq", slice_rows))
    succeeded = F.when(F.col("success"), F.col("seq"))
    named = carried_max(sliced, ["account_id"], "_slice", ["seq"], succeeded, "_run")
    runs = named.groupBy("account_id", "_run").agg(F.count_if(~F.col("success")).alias("n"))
    return runs.groupBy("account_id").agg(F.max("n").alias("longest")).withColumn("healthy", F.col("longest") < limit)


def account_health(log: DataFrame) -> DataFrame:
    return log.groupBy("account_id").agg(
        F.count_if(F.col("success")).alias("success_count"),
        F.count_if(~F.col("success")).alias("fail_count"),
        F.coalesce(F.sum(F.when(F.col("success"), F.col("bytes"))), F.lit(0)).alias("total_bytes"),
        F.max("ts").alias("last_used"),
    )


def account_downloads(log: DataFrame, now: str, hours: float = 24, account: int | None = None) -> DataFrame:
    """Log rows of the window, newest first."""
    rows = log.filter(F.col("ts") > moment(now, hours))
    if account is not None:
        rows = rows.filter(F.col("account_id") == account)
    return rows.orderBy(F.col("ts").desc(), F.col("seq").desc())


def account_select(
    accounts: DataFrame, log: DataFrame, now: str, limit: int = MAX_CONSECUTIVE_FAILS, resets: DataFrame | None = None
) -> DataFrame:
    """Per provider the usable account that was used least recently.

    ``accounts``: account_id, provider, enabled, max_requests_hour,
    max_bytes (0 = no quota). Use so far comes from the log; ``resets`` as in ``fail_streaks``.
    """
    use = log.groupBy("account_id").agg(
        F.count_if(F.col("ts") > moment(now, 1)).alias("_hour"),
        F.coalesce(F.sum(F.when(F.col("success"), F.col("bytes"))), F.lit(0)).alias("_bytes"),
        F.max("ts").alias("last_used"),
    )
    health = fail_streaks(log, limit, resets=resets).select("account_id", "healthy")
    usable = (
        accounts.filter("enabled").join(use, "account_id", "left").join(health, "account_id", "left")
        .filter(F.coalesce("healthy", F.lit(True)))
        .filter(F.coalesce("_hour", F.lit(0)) < F.col("max_requests_hour"))
        .filter((F.col("max_bytes") == 0) | (F.coalesce("_bytes", F.lit(0)) < F.col("max_bytes")))
    )
    # never used comes first: false sorts before true
    return first_per_key(
        usable.select("provider", "account_id", "last_used"), ["provider"], F.col("last_used").isNotNull(), F.col("last_used"), F.col("account_id")
    )


def scheduled_mbps(hour: Column, schedule: dict[int, float], max_mbps: float = 0) -> Column:
    """Limit in force at an hour; null means unlimited.

    The latest scheduled hour at or before it decides; before the first one the
    hour-0 entry, else the global limit.
    """
    per_hour = []
    for h in range(24):
        earlier = [k for k in sorted(schedule) if k <= h]
        value = schedule[earlier[-1]] if earlier else max_mbps
        per_hour.append(F.lit(float(value)) if value else F.lit(None).cast("double"))
    return F.element_at(F.array(*per_hour), hour + 1)


def schedule_asof(rows: DataFrame, schedule: dict[int, float], max_mbps: float = 0) -> DataFrame:
    """Add the bandwidth limit in force at the hour of ``ts``."""
    return rows.withColumn("mbps", scheduled_mbps(F.hour("ts"), schedule, max_mbps))


def effective_rate(streams: DataFrame, base: float) -> DataFrame:
    """Rate of each stream: base share of its nice level over the streams at least as urgent.

    Streams are counted per level (31 levels at most) and the running counts
    are joined back, so no global window over the streams is needed.
    """
    own = F.greatest(F.lit(-10), F.least(F.lit(19), F.col("nice"))).cast("int")
    # levels past 19 never count for anyone, so they get a slot of their own
    slot = F.greatest(F.lit(-10), F.least(F.lit(20), F.col("nice"))).cast("int")
    per_level = streams.groupBy(slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_n"))
    levels = streams.sparkSession.range(-10, 20).select(F.col("id").cast("int").alias("_own"))
    upto = Window.orderBy("_own").rowsBetween(Window.unboundedPreceding, 0)
    active = (
        levels.join(per_level, F.col("_own") == F.col("_slot"), "left")
        .select("_own", F.greatest(F.lit(1), F.coalesce(F.sum("_n").over(upto), F.lit(0))).alias("active"))
    )
    shares = F.create_map(*[F.lit(x) for kv in NICE_MULTIPLIERS.items() for x in kv])
    rate = F.lit(float(base)) * F.element_at(shares, F.col("_own")) / F.col("active")
    # 30 rows by construction
    return streams.withColumn("_own", own).join(F.broadcast(active), "_own").withColumn("rate", rate).drop("_own")
