"""Rates, admission and accounts against step-by-step replays."""

import random

import pytest
from pyspark.sql import functions as F

from rastermill.operators import flow

START = 1_704_067_200  # 2024-01-01


def requests(spark, rows):
    """rows: (client, microseconds after start, path)"""
    data = [(k, c, START * 1_000_000 + t, p) for k, (c, t, p) in enumerate(rows)]
    return spark.createDataFrame(data, "seq bigint, client bigint, us bigint, path string").select(
        "seq", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), "client", "path"
    )


def replay(rows, rpm, burst, minute_s, burst_s):
    """The limiter one request at a time."""
    seen, verdicts = {}, {}
    for seq, (client, t, path) in sorted(enumerate(rows), key=lambda r: (r[1][1], r[0])):
        if path in ("/", "/health"):
            continue
        times = [x for x in seen.get(client, []) if x >= t - minute_s * 1_000_000]
        ok = len(times) < rpm and sum(x >= t - burst_s * 1_000_000 for x in times) < burst
        seen[client] = [*times, t] if ok else times
        verdicts[seq] = ok
    return verdicts


def traffic(seed, n, span_s, clients=4):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        client = 0 if rng.random() < 0.4 else rng.randrange(clients)  # one busy client
        t = rng.randrange(0, span_s * 1_000_000, rng.choice([1, 250_000, 1_000_000]))
        rows.append((client, t, "/health" if rng.random() < 0.05 else "/stac/search"))
    return rows


@pytest.mark.parametrize(
    "seed, n, span_s, rpm, burst, minute_s, burst_s",
    [(1, 600, 300, 20, 5, 60, 2), (2, 900, 4000, 12, 3, 60, 7), (3, 500, 100, 120, 20, 60, 2), (4, 400, 60, 1, 1, 10, 2), (5, 300, 50, 3, 9, 5, 8)],
)
def test_admission_equals_replay(spark, seed, n, span_s, rpm, burst, minute_s, burst_s):
    rows = traffic(seed, n, span_s)
    got = {r.seq: r.admitted for r in flow.rate_admission(requests(spark, rows), rpm, burst, minute_s, burst_s).collect()}
    assert got == replay(rows, rpm, burst, minute_s, burst_s)


def test_admission_across_python_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = traffic(8, 500, 200)
        got = {r.seq: r.admitted for r in flow.rate_admission(requests(spark, rows), 15, 4).collect()}
        assert got == replay(rows, 15, 4, 60, 2)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_admission_without_client_name(spark):
    rows = [(None, k * 1000, "/x") for k in range(30)]
    got = [r.admitted for r in flow.rate_admission(requests(spark, rows)).orderBy("seq").collect()]
    assert got == [True] * 20 + [False] * 10


def test_quiet_traffic_needs_no_replay(spark):
    rows = [(k % 3, k * 5_000_000, "/x") for k in range(200)]
    assert all(r.admitted for r in flow.rate_admission(requests(spark, rows)).collect())


def test_window_counts(spark):
    rows = traffic(12, 300, 200)
    got = {r.seq: (r.in_minute, r.in_burst) for r in flow.rate_window_counts(requests(spark, rows)).collect()}
    kept = {k: r for k, r in enumerate(rows) if r[2] != "/health"}
    assert set(got) == set(kept)
    for k, (client, t, _) in kept.items():
        near = [t2 for c2, t2, _ in kept.values() if c2 == client and t2 <= t]
        assert got[k] == (sum(t - x <= 60_000_000 for x in near), sum(t - x <= 2_000_000 for x in near))


def account_log(spark, outcomes):
    rows = [(seq, a, ok, 10) for seq, (a, ok) in enumerate(outcomes)]
    return spark.createDataFrame(rows, "seq bigint, account_id bigint, success boolean, bytes bigint").withColumn(
        "ts", F.timestamp_seconds(F.lit(START) + F.col("seq")).cast("timestamp_ntz")
    )


@pytest.mark.parametrize("slice_rows", [1, 4, 10_000])
def test_fail_streaks(spark, slice_rows):
    rng = random.Random(7)
    outcomes = [(rng.randrange(3), rng.random() < 0.35) for _ in range(200)] + [(9, True), (8, False)]
    best, run = {}, {}
    for a, ok in outcomes:
        run[a] = 0 if ok else run.get(a, 0) + 1
        best[a] = max(best.get(a, 0), run[a])
    got = {r.account_id: (r.longest, r.healthy) for r in flow.fail_streaks(account_log(spark, outcomes), 5, slice_rows).collect()}
    assert got == {a: (n, n < 5) for a, n in best.items()}


def test_a_reset_makes_an_account_healthy_again(spark):
    log = spark.createDataFrame([(a, s, False) for a in (1, 2, 3) for s in range(6)], "account_id int, seq bigint, success boolean")
    resets = spark.createDataFrame([(1, 3), (2, 5)], "account_id int, seq bigint")
    got = {r.account_id: (r.longest, r.healthy) for r in flow.fail_streaks(log, 5, resets=resets).collect()}
    assert got == {1: (2, True), 2: (0, True), 3: (6, False)}


def test_account_select(spark):
    log = account_log(spark, [(1, True), (2, True), (3, False), (3, False), (4, True), (4, True)])
    accounts = spark.createDataFrame(
        [(1, "p", True, 9, 0), (2, "p", True, 9, 0), (3, "p", True, 9, 0), (4, "q", True, 2, 0), (5, "q", True, 1, 0), (6, "r", False, 9, 0), (7, "s", True, 9, 10), (1, "t", True, 9, 10)],
        "account_id bigint, provider string, enabled boolean, max_requests_hour int, max_bytes bigint",
    )
    got = {r.provider: r.account_id for r in flow.account_select(accounts, log, "2024-01-01 00:30:00", limit=2).collect()}
    assert got == {"p": 1, "q": 5, "s": 7}  # 3 is unhealthy, 4 busy, 6 disabled, 1 at its quota for t


@pytest.mark.parametrize(
    "schedule, limit, expected",
    [({0: 100, 8: 50, 18: 75, 22: 100}, 0, {0: 100, 7: 100, 8: 50, 17: 50, 18: 75, 23: 100}), ({8: 50}, 30, {0: 30, 7: 30, 8: 50}), ({8: 50}, 0, {3: None, 9: 50}), ({8: 0}, 30, {3: 30, 9: None}), ({}, 0, {5: None})],
)
def test_schedule(spark, schedule, limit, expected):
    df = spark.range(24).select(F.timestamp_seconds(F.lit(START) + F.col("id") * 3600).cast("timestamp_ntz").alias("ts"), F.col("id").alias("h"))
    got = {r.h: r.mbps for r in flow.schedule_asof(df, schedule, limit).collect()}
    assert {h: got[h] for h in expected} == expected


def test_effective_rate(spark):
    nices = [-30, -10, 0, 0, 5, 19, 40]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(nices)], "id int, nice int")
    for r in flow.effective_rate(df, 1000).collect():
        own = max(-10, min(19, r.nice))
        active = max(1, sum(n <= own for n in nices))
        assert r.active == active and r.rate == pytest.approx(1000 * flow.NICE_MULTIPLIERS[own] / active)


def test_functions_travel_without_the_package(tmp_path):
    """Executors need not have the package: task functions are pickled by value."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    payload = cloudpickle.dumps(flow._replayer(1, 1, 60, 2))
    code = "import pickle, sys; f = pickle.loads(sys.stdin.buffer.read()); print(callable(f), 'rastermill' in sys.modules)"
    done = subprocess.run([sys.executable, "-I", "-c", code], input=payload, capture_output=True, cwd=tmp_path, check=True)
    assert done.stdout.split() == [b"True", b"False"]
