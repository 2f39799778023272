"""Rate, admission and account queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rastermill.fixtures import NOW, Inputs
from rastermill.operators import flow
from rastermill.registry import query


@query("rate_window_counts",
    """SELECT seq, ts, client, path, count(*) OVER (PARTITION BY client ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS in_minute,
              count(*) OVER (PARTITION BY client ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_burst
       FROM requests WHERE path NOT IN ('/', '/health')""", ("requests",))
def _(i: Inputs):
    return flow.rate_window_counts(i.requests, minute_s=86400, burst_s=3600)


@query("rate_window_counts_default",
    """SELECT seq, ts, client, path, count(*) OVER (PARTITION BY client ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS in_minute,
              count(*) OVER (PARTITION BY client ORDER BY ts RANGE BETWEEN INTERVAL 2 SECOND PRECEDING AND CURRENT ROW) AS in_burst
       FROM requests WHERE path NOT IN ('/', '/health')""", ("requests",))
def _(i: Inputs):
    return flow.rate_window_counts(i.requests)


# one step per request of every client at once; the state is the list of admitted times
REPLAY = """RECURSIVE r AS (SELECT seq, ts, client, path, epoch_us(ts) AS us, row_number() OVER (PARTITION BY client ORDER BY ts, seq) AS rn
       FROM requests WHERE path NOT IN ('/', '/health')),
   step AS (SELECT client, seq, rn, [us] AS adm, TRUE AS admitted FROM r WHERE rn = 1
     UNION ALL SELECT client, seq, rn, CASE WHEN ok THEN list_append(kept, us) ELSE kept END, ok FROM (
       SELECT client, seq, rn, us, kept, len(kept) < 20 AND len(list_filter(kept, lambda t: t >= us - 3600000000)) < 4 AS ok FROM (
         SELECT r.client, r.seq, r.rn, r.us, list_filter(step.adm, lambda t: t >= r.us - 86400000000) AS kept
         FROM step JOIN r ON r.client = step.client AND r.rn = step.rn + 1)))"""
REPLAY_TABLES = ("requests",)


@query("rate_admission", f"WITH {REPLAY} SELECT r.seq, r.ts, r.client, r.path, admitted FROM step JOIN r ON r.client = step.client AND r.rn = step.rn", REPLAY_TABLES)
def _(i: Inputs):
    return flow.rate_admission(i.requests, rpm=20, burst=4, minute_s=86400, burst_s=3600)


@query("rate_admission_default", "SELECT seq, ts, client, path, TRUE AS admitted FROM requests WHERE path NOT IN ('/', '/health')", ("requests",))
def _(i: Inputs):
    return flow.rate_admission(i.requests)


STREAKS = """marked AS (SELECT *, sum(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY account_id ORDER BY seq) AS isl FROM account_log),
   runs AS (SELECT account_id, isl, count(*) FILTER (NOT success) AS n FROM marked GROUP BY 1, 2),
   streaks AS (SELECT account_id, max(n) AS longest, max(n) < 5 AS healthy FROM runs GROUP BY 1)"""


@query("fail_streaks", f"WITH {STREAKS} SELECT * FROM streaks", ("account_log",))
def _(i: Inputs):
    return flow.fail_streaks(i.account_log, slice_rows=1000)


RESET_STREAKS = """resets AS (SELECT account_id, max(seq) AS at FROM account_log WHERE account_id % 2 = 0 AND seq % 50 = 0 GROUP BY 1),
   counted AS (SELECT l.* FROM account_log l LEFT JOIN resets r ON l.account_id = r.account_id WHERE r.at IS NULL OR seq > r.at),
   marked AS (SELECT *, sum(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY account_id ORDER BY seq) AS isl FROM counted),
   runs AS (SELECT account_id, isl, count(*) FILTER (NOT success) AS n FROM marked GROUP BY 1, 2)"""


@query("fail_streaks_reset",
    f"""WITH {RESET_STREAKS} SELECT account_id, max(n) AS longest, max(n) < 2 AS healthy FROM runs GROUP BY 1
        UNION ALL SELECT account_id, 0, TRUE FROM resets WHERE account_id NOT IN (SELECT account_id FROM runs)""", ("account_log",))
def _(i: Inputs):
    resets = i.account_log.filter("account_id % 2 = 0 AND seq % 50 = 0").select("account_id", "seq")
    return flow.fail_streaks(i.account_log, limit=2, slice_rows=1000, resets=resets)


@query("account_health",
    """SELECT account_id, count(*) FILTER (success) AS success_count, count(*) FILTER (NOT success) AS fail_count,
              CAST(coalesce(sum(bytes) FILTER (success), 0) AS BIGINT) AS total_bytes, max(ts) AS last_used FROM account_log GROUP BY 1""", ("account_log",))
def _(i: Inputs):
    return flow.account_health(i.account_log)


@query("account_downloads", "SELECT * FROM account_log WHERE ts > TIMESTAMP '2024-01-30' AND account_id = 3", ("account_log",))
def _(i: Inputs):
    return flow.account_downloads(i.account_log, NOW, 24, 3)


@query("account_select",
    f"""WITH {STREAKS}, acc AS (SELECT DISTINCT user_id % 25 AS account_id, CASE user_id % 25 % 3 WHEN 0 THEN 'cdse' WHEN 1 THEN 'element84' ELSE 'wekeo' END AS provider,
               user_id % 25 % 6 <> 5 AS enabled, user_id % 25 % 4 AS max_requests_hour, CASE WHEN user_id % 25 % 2 = 0 THEN 0 ELSE 100000000 END AS max_bytes FROM events),
        u AS (SELECT account_id, count(*) FILTER (ts > TIMESTAMP '2024-01-30 22:00:00') AS h, coalesce(sum(bytes) FILTER (success), 0) AS b, max(ts) AS last_used FROM account_log GROUP BY 1),
        ok AS (SELECT provider, acc.account_id, last_used FROM acc JOIN u ON acc.account_id = u.account_id JOIN streaks s ON s.account_id = acc.account_id
               WHERE enabled AND healthy AND h < max_requests_hour AND (max_bytes = 0 OR b < max_bytes))
        SELECT provider, account_id, last_used FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY last_used, account_id) AS rn FROM ok) WHERE rn = 1""",
    ("account_log",))
def _(i: Inputs):
    a = F.col("account_id")
    accounts = i.account_log.select("account_id").distinct().select(
        "account_id", F.when(a % 3 == 0, "cdse").when(a % 3 == 1, "element84").otherwise("wekeo").alias("provider"),
        (a % 6 != 5).alias("enabled"), (a % 4).alias("max_requests_hour"), F.when(a % 2 == 0, 0).otherwise(100_000_000).alias("max_bytes"),
    )
    return flow.account_select(accounts, i.account_log, "2024-01-30 23:00:00")


@query("schedule_asof",
    """SELECT event_id, CAST(CASE WHEN hour(ts) >= 22 THEN 100 WHEN hour(ts) >= 18 THEN 75 WHEN hour(ts) >= 12 THEN NULL WHEN hour(ts) >= 8 THEN 50 ELSE 30 END AS DOUBLE) AS mbps
       FROM events""")
def _(i: Inputs):
    return flow.schedule_asof(i.events.select("event_id", "ts"), {8: 50, 12: 0, 18: 75, 22: 100}, 30).select("event_id", "mbps")


@query("effective_rate",
    """WITH m(level, mult) AS (VALUES (-10,4.0::DOUBLE),(-9,3.5),(-8,3.0),(-7,2.5),(-6,2.0),(-5,1.75),(-4,1.5),(-3,1.25),(-2,1.1),(-1,1.05),(0,1.0),(1,0.95),(2,0.9),
           (3,0.85),(4,0.8),(5,0.7),(6,0.6),(7,0.5),(8,0.4),(9,0.3),(10,0.25),(11,0.22),(12,0.20),(13,0.18),(14,0.16),(15,0.14),(16,0.13),(17,0.12),(18,0.11),(19,0.10)),
       s AS (SELECT event_id, nice * 2 AS nice, greatest(-10, least(19, nice * 2)) AS own FROM bandwidth_log),
       lv AS (SELECT level, greatest(1, (SELECT count(*) FROM s WHERE s.nice <= level)) AS active FROM m)
       SELECT event_id, nice, active, 12500000.0::DOUBLE * mult / active AS rate FROM s JOIN m ON m.level = own JOIN lv ON lv.level = own""", ("bandwidth_log",))
def _(i: Inputs):
    streams = i.bandwidth_log.select("event_id", (F.col("nice") * 2).alias("nice"))
    return flow.effective_rate(streams, 12_500_000)
