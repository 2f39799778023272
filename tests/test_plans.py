"""Shared plan shapes against brute force, and what their plans look like under skew."""

import random

import pytest
from pyspark.sql import functions as F

from rastermill.functions.numbers import floor_div
from rastermill.operators import chunks
from rastermill.plans.gridjoin import overlap_join
from rastermill.plans.lookup import lookup_join
from rastermill.plans.ordered import carried_max, global_row_number, running_sum, trailing_counts
from rastermill.plans.pick import first_per_key, last_per_key


def test_floor_div(spark):
    df = spark.createDataFrame([(-7,), (-6,), (0,), (5,), (6,)], "v bigint")
    assert [r[0] for r in df.select(floor_div("v", 3)).collect()] == [-3, -2, 0, 1, 2]


def test_first_and_last_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), ("b", 5, "z")], "k string, o int, v string")
    assert sorted(map(tuple, first_per_key(df, ["k"], "o").collect())) == [("a", 1, None), ("b", 5, "z")]
    assert sorted(map(tuple, last_per_key(df, ["k"], "o").collect())) == [("a", 2, "x"), ("b", 5, "z")]


@pytest.mark.parametrize("partitions", [1, 7])
def test_running_sum_with_tied_leading_order(spark, partitions):
    rng = random.Random(3)
    # a third of all rows share one leading value
    rows = [(0 if k % 3 == 0 else rng.randrange(50), k, rng.randrange(100)) for k in range(3000)]
    df = spark.createDataFrame(rows, "t int, id int, v bigint").repartition(5)
    got = {r.id: r.total for r in running_sum(df, [F.col("t"), F.col("id")], "v", "total", partitions).collect()}
    total, expected = 0, {}
    for t, i, v in sorted(rows):
        total += v
        expected[i] = total
    assert got == expected


def test_global_row_number(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v"))
    got = global_row_number(df, [F.col("v").desc()], "n", 6).collect()
    assert all(r.n == 1000 - r.v for r in got)


def test_carried_max(spark):
    rng = random.Random(5)
    rows = [(k % 3 // 2, k, rng.random() < 0.2) for k in range(600)]
    df = spark.createDataFrame(rows, "a int, seq int, ok boolean").withColumn("s", floor_div(F.col("seq").cast("bigint"), 50))
    got = {r.seq: r.run for r in carried_max(df, ["a"], "s", ["seq"], F.when(F.col("ok"), F.col("seq")), "run").collect()}
    last = {}
    for a, seq, ok in sorted(rows, key=lambda r: r[1]):
        assert got[seq] == last.get(a)
        if ok:
            last[a] = seq


def test_trailing_counts(spark):
    rng = random.Random(9)
    rows = [(0 if rng.random() < 0.5 else rng.randrange(3), rng.randrange(0, 200_000_000, 500_000)) for _ in range(800)]
    df = spark.createDataFrame([(k, c, t) for k, (c, t) in enumerate(rows)], "id int, c int, us bigint")
    got = {r.id: (r.long, r.short) for r in trailing_counts(df, "c", "us", (10, 2), ("long", "short")).collect()}
    assert len(got) == len(rows)
    for k, (c, t) in enumerate(rows):
        for index, w in enumerate((10, 2)):
            assert got[k][index] == sum(1 for c2, t2 in rows if c2 == c and t - w * 1_000_000 <= t2 <= t)


def test_trailing_counts_do_not_add_up_windows_row_by_row(spark):
    """A frame of values is added up anew for each row, so a crowded key would cost the square of its instants."""
    df = spark.range(100).select(F.lit(1).alias("c"), (F.col("id") * 1000).alias("us"))
    counted = trailing_counts(df, "c", "us", (10, 2), ("long", "short"))
    assert "RangeFrame" not in counted._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.long, r.short) for r in counted.collect()} == {(k, k) for k in range(1, 101)}


def test_trailing_counts_with_null_keys_and_instants_before_1970(spark):
    rows = [(None, -3_000_000), (None, -1_000_000), (None, -1_000_000), (None, 1_000_000), (5, 0), (5, None)]
    df = spark.createDataFrame(rows, "c int, us bigint")
    got = sorted((r.c or 0, r.us, r.long, r.short) for r in trailing_counts(df, "c", "us", (4, 2), ("long", "short")).collect())
    assert got == [(0, -3_000_000, 1, 1), (0, -1_000_000, 3, 3), (0, -1_000_000, 3, 3), (0, 1_000_000, 4, 3), (5, 0, 1, 1)]


@pytest.mark.parametrize("cell", [1.0, 0.25, 40.0])
def test_overlap_join_equals_brute_force(spark, cell):
    rng = random.Random(11)

    def box(big):
        size = rng.choice([0.0, 0.5, 1.0, 7.0, 64.0, 300.0] if big else [0.0, 0.2, 1.0, 3.0])
        w, s = round(rng.uniform(-180, 180), 1), round(rng.uniform(-90, 90), 1)
        return w, s, w + size, s + size / 2

    # a third of the boxes sit on one spot
    areas = [(k, *(box(True) if k % 3 else (10.0, 10.0, 12.0, 12.0))) for k in range(120)]
    items = [(k, *(box(k % 10 == 1) if k % 3 else (11.0, 11.0, 12.0, 12.0))) for k in range(300)]
    a = spark.createDataFrame(areas, "a int, aw double, as double, ae double, an double")
    i = spark.createDataFrame(items, "i int, iw double, is double, ie double, in double")
    got = [(r.a, r.i) for r in overlap_join(a, i, cell).collect()]
    expected = {(x[0], y[0]) for x in areas for y in items if y[3] >= x[1] and y[1] <= x[3] and y[4] >= x[2] and y[2] <= x[4]}
    assert len(got) == len(set(got)) and set(got) == expected


def test_hot_hash_is_split_by_adaptive_execution(spark, tmp_path):
    """A third of the references share one hash: the join splits that partition and stays complete."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        refs = spark.range(0, 60_000, 1, 12).select(
            F.col("id").alias("item_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("sha")
        )
        path = str(tmp_path / "store")
        refs.select("sha").distinct().filter("sha < '8'").write.parquet(path)
        store = spark.read.parquet(path)
        lacking = chunks.missing_chunks(refs, store)
        rows = lacking.select("sha").collect()
        assert len(rows) == refs.filter("sha >= '8'").count()
        lacking.collect()
        assert "skew=true" in lacking._jdf.queryExecution().executedPlan().toString()
        # the same for a lookup that was grouped by the key
        grouped = store.groupBy("sha").agg(F.count(F.lit(1)).alias("n"))
        found = lookup_join(refs, grouped, "sha")
        assert len(found.collect()) == 60_000
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_lookup_join_keeps_crowded_and_null_keys(spark):
    left = spark.range(9000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.col("id")).cast("bigint").alias("k")
    )
    lookup = spark.range(0, 9000, 5).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).unionByName(
        spark.createDataFrame([(7, 14)], "k bigint, v bigint")
    )
    got = sorted(map(tuple, lookup_join(left, lookup, "k").select("id", "v").collect()))
    known = set(range(0, 9000, 5)) | {7}

    def value(i):
        k = 7 if i % 3 == 0 else i if i % 3 == 1 else None
        return 2 * k if k in known else None

    assert got == [(i, value(i)) for i in range(9000)]


def test_boxes_in_metres_touch_four_cells_at_most(spark):
    from rastermill.plans import gridjoin

    boxes = spark.createDataFrame([(0.0, 0.0, 109_800.0, 109_800.0), (499_980.0, 5_190_240.0, 609_780.0, 5_300_040.0)], "iw double, `is` double, ie double, `in` double")
    home = gridjoin._home(F.greatest(F.col("ie") - F.col("iw"), F.col("in") - F.col("is")), 1.0)
    filed = gridjoin._cells(boxes.withColumn("_g", home), "i", 1.0)
    assert max(r["count"] for r in filed.groupBy("iw").count().collect()) <= 4
