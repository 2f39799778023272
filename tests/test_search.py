"""Catalogue search on small hand-made items."""

import pytest
from pyspark.sql import functions as F

from rastermill.functions.text import band_from_filename, band_from_item_id, human_bytes, scene_key, sensor_label
from rastermill.operators import bands, coverage, search

ITEM = "id string, collection string, bbox_west double, bbox_south double, bbox_east double, bbox_north double, datetime string"


def items(spark, *rows):
    return spark.createDataFrame(list(rows), ITEM)


def ids(df, column="id"):
    return sorted(r[0] for r in df.select(column).collect())


def test_collection_found(spark):
    df = items(spark, ("tile-001", "sentinel-2", 11.0, 47.0, 12.0, 48.0, "2024-07-01T00:00:00Z"))
    assert ids(search.search_items(df, ["sentinel-2"])) == ["tile-001"]
    assert ids(search.search_items(df, ["landsat"])) == []
    assert ids(search.search_items(df, [])) == ["tile-001"]


def test_bbox_alps_not_brazil(spark):
    df = items(spark, ("alps", "c", 11.0, 47.0, 12.0, 48.0, ""), ("brazil", "c", -51.0, -16.0, -49.0, -14.0, ""))
    assert ids(search.search_items(df, bbox=[10.0, 46.0, 13.0, 49.0])) == ["alps"]
    assert ids(search.search_items(df, bbox=[10.0, 46.0])) == ["alps", "brazil"]


def test_touching_boxes(spark):
    df = items(
        spark, ("copenhagen", "c", 12.0, 55.0, 13.0, 56.0, ""), ("tokyo", "c", 139.0, 35.0, 140.0, 36.0, ""), ("edge", "c", 14.0, 54.0, 15.0, 55.0, "")
    )
    box = [11.0, 54.0, 14.0, 57.0]
    assert ids(search.search_bbox(df, box)) == ["copenhagen", "edge"]
    assert ids(search.search_bbox_strict(df, box)) == ["copenhagen"]


@pytest.mark.parametrize(
    "expression, expected",
    [
        ("2024-06-01/2024-08-31", ["july"]),
        ("../2024-02-01", ["jan", "undated"]),
        ("2024-02-01/..", ["july"]),
        ("/", ["jan", "july", "undated"]),
        ("2024-01-15", ["jan"]),
        (None, ["jan", "july", "undated"]),
        ("a/b/c", []),
    ],
)
def test_datetime(spark, expression, expected):
    df = items(
        spark, ("july", "c", 0.0, 0.0, 1.0, 1.0, "2024-07-15"), ("jan", "c", 0.0, 0.0, 1.0, 1.0, "2024-01-15"), ("undated", "c", 0.0, 0.0, 1.0, 1.0, "")
    )
    assert ids(search.search_datetime(df, expression)) == expected


def test_newest_first_and_limit(spark):
    df = items(spark, *[(f"i{k}", "c", 0.0, 0.0, 1.0, 1.0, f"2024-01-{k:02d}") for k in range(1, 11)])
    assert [r.id for r in search.search_items(df, limit=3).collect()] == ["i10", "i9", "i8"]


def test_filter_reaches_the_scan(spark, tmp_path):
    items(spark, ("a", "x", 0.0, 0.0, 1.0, 1.0, "2024")).write.parquet(str(tmp_path / "items"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    stored = spark.read.parquet(str(tmp_path / "items"))
    found = search.search_items(stored, ["x"], [0.0, 0.0, 1.0, 1.0], "2024/..", limit=100).select("id", "datetime")
    plan = found._jdf.queryExecution().executedPlan().toString()
    for needed in ("GreaterThanOrEqual(bbox_east", "LessThanOrEqual(bbox_west", "GreaterThanOrEqual(datetime", "TakeOrderedAndProject"):
        assert needed in plan


def test_fallback_steps(spark):
    df = items(
        spark, ("near", "c", 0.0, 0.0, 1.0, 1.0, "2024-01-05T10:00:00Z"), ("far", "c", 50.0, 50.0, 51.0, 51.0, "2024-01-06T10:00:00Z"),
        ("old", "c", 50.0, 50.0, 51.0, 51.0, "2020-01-06T10:00:00Z"), ("other", "d", 0.0, 0.0, 1.0, 1.0, "2024-01-05T10:00:00Z"),
    )
    requests = spark.createDataFrame(
        [(1, "c", 0.0, 0.0, 2.0, 2.0, "2024-01-01", "2024-01-31"), (2, "c", -9.0, -9.0, -8.0, -8.0, "2024-01-01", "2024-01-06"),
         (3, "c", -9.0, -9.0, -8.0, -8.0, "2030-01-01", "2030-02-01"), (4, "none", 0.0, 0.0, 1.0, 1.0, "2024-01-01", "2024-02-01")],
        "request_id bigint, collection string, west double, south double, east double, north double, date_from string, date_to string",
    )
    got = {tuple(r) for r in search.search_fallback(requests, df, limit=500).collect()}
    assert got == {(1, "near", 0), (2, "near", 1), (2, "far", 1), (3, "near", 2), (3, "far", 2), (3, "old", 2)}
    ends = requests.filter("request_id = 1").withColumns({"date_from": F.lit(None).cast("string"), "date_to": F.lit("..")})
    assert [tuple(r) for r in search.search_fallback(ends, df, limit=500).collect()] == [(1, "near", 0)]
    limited = {tuple(r) for r in search.search_fallback(requests, df, limit=1).collect()}
    assert limited == {(1, "near", 0), (2, "far", 1), (3, "far", 2)}


def test_seed_nodes(spark):
    nodes = spark.createDataFrame([("n1", "http://a", 5, 100), ("n2", None, 0, 100), ("n3", "http://c", 5, -900)], "node_id string, url string, item_count int, last_seen_s bigint")
    assert ids(search.seed_nodes(nodes, 200), "node_id") == ["n1"]
    assert ids(search.alive_nodes(nodes, 400), "node_id") == []
    assert ids(search.alive_peers(nodes, 400), "node_id") == ["n1", "n2"]


def test_coverage_counts_each_footprint_once(spark):
    rows = [("a", "s2", 300000.0, 4000000.0, 409800.0, 4109800.0, 1), ("b", "s2", 300100.0, 4000000.0, 409900.0, 4109800.0, 2), ("c", "s2", 600000.0, 4000000.0, 709800.0, 4109800.0, 3)]
    df = spark.createDataFrame(rows, "id string, collection string, bbox_west double, bbox_south double, bbox_east double, bbox_north double, seq int")
    row = coverage.coverage_by_collection(df).first()
    assert (row["items"], row["tiles"], row["area_km2"]) == (3, 2, round(2 * 109800**2 / 1e6))


def test_coverage_in_degrees(spark):
    df = spark.createDataFrame(
        [("c", 10.0, 0.0, 11.0, 1.0, 1), ("c", 12.0, 0.0, 13.0, 1.0, 2)], "collection string, bbox_west double, bbox_south double, bbox_east double, bbox_north double, seq int"
    )
    assert coverage.coverage_by_collection(df).first()["tiles"] == 1
    aware = coverage.coverage_by_collection(df, degrees_aware=True).first()
    assert aware["tiles"] == 2 and 24000 < aware["area_km2"] < 25000


def test_km2_skips_bad_text(spark):
    df = spark.createDataFrame([("400000,5000000,410000,5020000",), ("a,b,c,d",), ("1,2,3",), ("",)], "query_bbox string")
    row = coverage.km2_queried(df).first()
    assert (row.total_requests, row.total_km2) == (3, 200)


def test_band_names(spark):
    names = [("T32_B8A_20m.jp2", 1, ["B8A"]), ("x_TCI.jp2", 3, ["B04", "B03", "B02"]), ("LC_SR_B5.TIF", 1, ["SR_B5"]), ("stack.tif", 2, ["B01", "B02"]), ("b02_stack.tif", 11, [f"B{k:02d}" for k in range(1, 12)])]
    df = spark.createDataFrame(names, "name string, n int, expected array<string>")
    for row in df.select("expected", band_from_filename("name", "n").alias("got")).collect():
        assert row.got == row.expected


def test_band_from_item_id(spark):
    cases = {"S2_B04_10m": "B04", "S2_B08": "B08", "S2_TCI": "TCI", "A_B04_C_B8A_20m": "B04_C_B8A", "plain": None}
    df = spark.createDataFrame([(k, v, None) for k, v in cases.items()], "id string, expected string, names array<string>")
    for row in df.select("expected", band_from_item_id("id").alias("got")).collect():
        assert row.got == row.expected
    declared = spark.createDataFrame([("S2_B04", ["B11"]), ("S2_B04", ["B1", "B2"]), ("S2_B04", None)], "id string, names array<string>")
    assert [r[0] for r in declared.select(band_from_item_id("id", "names")).collect()] == ["B11", "B04", "B04"]


def test_text_helpers(spark):
    df = spark.createDataFrame([("S2_T32TPT_20240709_B04", 0), ("T32TPT", 1023), ("x20240709", 1536)], "id string, n bigint")
    assert [r[0] for r in df.select(scene_key("id")).collect()] == ["T32TPT_20240709", None, None]
    assert [r[0] for r in df.select(human_bytes("n")).collect()] == ["0.0 B", "1023.0 B", "1.5 KB"]
    labels = spark.createDataFrame([("sentinel-2-l2a_derived",), ("landsat-c2-l2",), ("modis",)], "c string")
    assert [r[0] for r in labels.select(sensor_label("c")).collect()] == ["Sentinel-2 L2A", "Landsat C2-L2", "modis"]


def test_needed_bands(spark):
    df = spark.createDataFrame([(1, ["b8a", "B04"]), (2, ["x"]), (3, ["B8A", "B08", "B04"])], "item_id int, bands array<string>")
    got = {(r.item_id, r.role, r.band) for r in bands.resolve_needed_bands(df, "ndvi").collect()}
    assert got == {(1, 0, "b8a"), (1, 1, "B04"), (2, None, "x"), (3, 0, "B08"), (3, 1, "B04")}
    everything = bands.resolve_needed_bands(df, "band_math")
    assert everything.count() == 6 and everything.filter(F.col("role").isNotNull()).count() == 0


def test_product_bands_keys(spark):
    df = spark.createDataFrame([("B02",), ("B8A",), ("XYZ",)], "band string")
    assert [r[0] for r in df.select(bands.asset_key("band")).collect()] == ["blue", "nir08", "xyz"]


def test_product_search_by_collection_without_a_limit(spark):
    products = spark.createDataFrame(
        [(k, "SENTINEL-1" if k % 2 else "SENTINEL-2", "2024-01-01", 5.0) for k in range(30)], "product_id int, collection string, date string, cloud_cover double"
    )
    known = spark.createDataFrame([(1,)], "product_id int")
    got = sorted(r.product_id for r in search.product_search(products, known, collection="sentinel-1-grd").collect())
    assert got == list(range(3, 30, 2))


def test_fallback_compares_items_of_a_period_only(spark):
    """Boxes are compared with those of the years asked for, so the pairs looked at do not grow with the length of the archive."""
    rows = [(f"i{y}-{k}", "c", 0.0, 0.0, 1.0, 1.0, f"{y}-06-0{k}T00:00:00Z") for y in range(1990, 2020) for k in (1, 2)]
    items = spark.createDataFrame(rows, "id string, collection string, bbox_west double, bbox_south double, bbox_east double, bbox_north double, datetime string")
    asked = [(1, "2001-06-02", "2002-06-01"), (2, None, "1990-06-01"), (3, "2019-06-02", ".."), (4, "1985", "1986"), (5, "2005-06-01T00:00:00Z", "2005-06-01T00:00:00Z")]
    requests = spark.createDataFrame([(r, "c", 0.0, 0.0, 1.0, 1.0, a, b) for r, a, b in asked], "request_id int, collection string, west double, south double, east double, north double, date_from string, date_to string")
    found = search.search_fallback(requests, items, limit=1)
    expected = {(1, "i2001-2", 0), (1, "i2002-1", 0), (2, "i1990-1", 0), (3, "i2019-2", 0), (4, "i2019-2", 2), (5, "i2005-1", 0)}
    assert {tuple(r) for r in found.collect()} == expected
    seen = []
    real, search.batch_bbox_search = search.batch_bbox_search, lambda *a, **b: seen.append(real(*a, **b)) or seen[-1]
    try:
        search.search_fallback(requests, items, limit=1)
    finally:
        search.batch_bbox_search = real
    # of 60 items each, 4, 2, 2, 0 and 2 are of the years asked for
    assert seen[0].count() == 10
