"""Requests answered from stored chunks, tile windows, product listings and folders of days."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastermill.operators import indices, search, tiles
from rastermill.plans.cube import cube_query_store
from rastermill.sources import readers, sinks
from rastermill.sources.folders import folder_names

ITEM = (
    "id string, collection string, datetime string, bbox_west double, bbox_south double, bbox_east double, bbox_north double, "
    "width int, height int, tile_size int, dtype string, band_names array<string>, chunk_hashes map<string,array<string>>"
)
REQUEST = "request_id bigint, collection string, west double, south double, east double, north double, date_from string, date_to string"


class Archive:
    """Rasters cut into chunks as an ingest does it."""

    def __init__(self):
        self.items, self.chunks, self.pixels = [], {}, {}

    def add(self, id, bands, arrays, day="2024-07-01", collection="s2", tile=4, box=(0, 0, 10, 10), dtype="uint16", lost=()):
        h, w = arrays[0].shape
        spots = [(y, x) for y in range(0, h, tile) for x in range(0, w, tile)]

        def put(data, keep=True):
            sha = hashlib.sha256(data).hexdigest()
            if keep:
                self.chunks[sha] = data
            return sha

        cut = lambda a, y, x: a[y : y + tile, x : x + tile].astype(dtype).tobytes()
        kept = lambda k: k not in lost
        if len(bands) == 1:
            hashes = {bands[0]: [put(cut(arrays[0], y, x), kept(k)) for k, (y, x) in enumerate(spots)]}
        else:
            hashes = {"*": [put(b"".join(cut(a, y, x) for a in arrays), kept(k)) for k, (y, x) in enumerate(spots)]}
        self.items.append((id, collection, f"{day}T10:00:00Z", *map(float, box), w, h, tile, dtype, list(bands), hashes))

    def frames(self, spark):
        return spark.createDataFrame(self.items, ITEM), spark.createDataFrame([(s, bytearray(d)) for s, d in self.chunks.items()], "sha string, data binary")


def ask(spark, *requests):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(requests, 1)], REQUEST)


def rasters(answers):
    """(request, band) -> array, put together from tiles."""
    out = {}
    for r in answers.collect():
        a = out.setdefault((r.request_id, r.band), np.full((r.height, r.width), np.nan))
        a[r.y_off : r.y_off + r.h, r.x_off : r.x_off + r.w] = np.array(r.pixels).reshape(r.h, r.w)
    return out


def ndvi(n, r):
    n, r = n.astype(np.float32), r.astype(np.float32)
    with np.errstate(divide="ignore", invalid="ignore"):
        v = np.where(n + r == 0, np.float32(0), (n - r) / (n + r))
    return np.nan_to_num(v.astype(np.float32), nan=0.0, posinf=1.0, neginf=-1.0)


def nearest(a, h, w):
    return a[np.ix_((2 * np.arange(h) + 1) * a.shape[0] // (2 * h), (2 * np.arange(w) + 1) * a.shape[1] // (2 * w))]


BOX, MISS, JULY = (1.0, 1.0, 2.0, 2.0), (50.0, 50.0, 51.0, 51.0), ("2024-07-01", "2024-07-31")


@pytest.fixture
def rng():
    return np.random.default_rng(5)


def test_index_from_the_store(spark, rng):
    draw = lambda h, w: rng.integers(0, 4000, (h, w))
    store = Archive()
    fine, coarse, red, late = draw(10, 9), draw(5, 5), draw(5, 4), draw(10, 9)
    fine[0, 0] = red[0, 0] = 0
    store.add("S2_T32_B08", ["B08"], [fine])
    store.add("S2_T32_B08_20m", ["B08"], [coarse], day="2024-07-03")  # newer, but not as wide
    store.add("S2_T32_B04", ["B04"], [red], lost=[1])
    store.add("S2_T99_B04", ["B04"], [late], day="2024-08-20")
    items, chunks = store.frames(spark)
    requests = ask(spark, ("s2", *BOX, *JULY), ("s2", *MISS, *JULY), ("s2", *MISS, "2030-01-01", None), ("none", *BOX, None, None))
    answers = cube_query_store(requests, items, chunks, "ndvi", tile_size=4)
    got = rasters(answers)
    held = red.copy()
    held[4:, :4] = 0  # the lost chunk of the red band
    expected = ndvi(fine, nearest(held, 10, 9))
    assert set(got) == {(1, "ndvi"), (2, "ndvi"), (3, "ndvi")}
    np.testing.assert_allclose(got[1, "ndvi"], expected, rtol=1e-6)
    np.testing.assert_allclose(got[2, "ndvi"], expected, rtol=1e-6)
    # nothing in the period: everything counts, and the later red band is wider
    np.testing.assert_allclose(got[3, "ndvi"], ndvi(fine, late), rtol=1e-6)
    # the place on earth is that of the first item found among the chosen ones
    assert {(r.request_id, r.item_id) for r in answers.collect()} == {(1, "S2_T32_B04"), (2, "S2_T32_B04"), (3, "S2_T99_B04")}


def test_stand_ins_bands_of_one_item_and_missing_bands(spark, rng):
    draw = lambda: rng.integers(0, 4000, (6, 6))
    store = Archive()
    a, b, c, d = draw(), draw(), draw(), draw()
    store.add("T32_B8A", ["B01"], [a], collection="alias")  # known by its id, filed under a generic name
    store.add("T32_B04", ["B04"], [b], collection="alias")
    store.add("scene-1", ["B04", "B08"], [a, b], collection="many", day="2024-07-02")
    store.add("scene-2", ["B08", "B11"], [c, d], collection="many", day="2024-07-01")
    store.add("T32_B04", ["B04"], [b], collection="alone")
    items, chunks = store.frames(spark)
    requests = ask(spark, *((name, *BOX, *JULY) for name in ("alias", "many", "alone")))
    items = items.withColumn("band_names", F.when(F.col("id") == "T32_B8A", F.array().cast("array<string>")).otherwise(F.col("band_names")))
    got = rasters(cube_query_store(requests, items, chunks, "ndvi", ["B8A"], tile_size=4))
    assert set(got) == {(1, "ndvi"), (2, "ndvi")}
    np.testing.assert_allclose(got[2, "ndvi"], ndvi(c, a), rtol=1e-6)  # later items of a silent request win
    bands = rasters(cube_query_store(requests, items, chunks, None, tile_size=4))
    assert {k for k in bands if k[0] == 2} == {(2, "B04"), (2, "B08"), (2, "B11")}
    assert (bands[2, "B08"] == c).all() and (bands[2, "B04"] == a).all() and (bands[3, "B04"] == b).all()
    only = rasters(cube_query_store(requests, items, chunks, None, ["B11"], tile_size=4))
    assert set(only) == {(2, "B11")}


def test_other_tile_sizes_and_shared_items(spark, rng):
    draw = lambda: rng.integers(0, 4000, (10, 10))
    store = Archive()
    n, r = draw(), draw()
    store.add("T_B08", ["B08"], [n], tile=3)
    store.add("T_B04", ["B04"], [r], tile=4)
    items, chunks = store.frames(spark)
    got = rasters(cube_query_store(ask(spark, *[("s2", *BOX, *JULY)] * 3), items, chunks, "ndvi", tile_size=4))
    assert len(got) == 3
    for raster in got.values():
        np.testing.assert_allclose(raster, ndvi(n, r), rtol=1e-6)
    with pytest.raises(ValueError, match="ndvi"):
        cube_query_store(ask(spark, ("s2", *BOX, *JULY)), items, chunks, "evi")


def test_no_requests_and_no_items(spark):
    store = Archive()
    store.add("T_B08", ["B08"], [np.ones((4, 4))])
    items, chunks = store.frames(spark)
    assert cube_query_store(ask(spark, ("s2", *BOX, *JULY)).limit(0), items, chunks, "ndvi").count() == 0
    assert cube_query_store(ask(spark, ("s2", *BOX, *JULY)), items.limit(0), chunks, "ndvi").count() == 0


@pytest.mark.parametrize("operation", ["ndwi", "ndsi", "evi", "cloud_mask"])
def test_tile_formulas_equal_the_pixel_ones(spark, rng, operation):
    roles = indices.FORMULAS[operation][0]
    names = {"nir": "B08", "red": "B04", "green": "B03", "blue": "B02", "swir": "B11", "scl": "SCL"}
    values = {role: rng.integers(0, 12, 30).tolist() for role in roles}
    rows = [(1, role, values[role]) for role in roles] + [(2, roles[0], values[roles[0]])] * (len(roles) > 1)
    df = spark.createDataFrame(rows, "key int, role string, pixels array<int>")
    paired = indices.pair_tiles(df, ["key"], roles)
    found = indices.tile_index(paired, operation, ["key"]).collect()
    cube = spark.createDataFrame(list(zip(range(30), *(values[r] for r in roles))), ["x", *(names[r] for r in roles)])
    expected = [r[1] for r in indices.apply_op(cube, operation).orderBy("x").collect()]
    assert [r.key for r in found] == [1] and found[0].pixels == pytest.approx(expected)


def test_tile_band_math(spark):
    df = spark.createDataFrame([(1, [1, 2, 0], [4, 0, 0])], "key int, B04 array<int>, B08 array<int>")
    found = indices.tile_index(df, "band_math", ["key"], "(B08 - B04) / B04", ["B04", "B08"]).first()
    assert found.pixels == [3.0, -1.0, 0.0]
    with pytest.raises(ValueError, match="no tile formula"):
        indices.tile_index(df, "nothing", ["key"])


def test_clip_equals_the_pixel_filter(spark, rng):
    items = spark.createDataFrame([("a", 10, 7, 0.0, 0.0, 10.0, 7.0), ("far", 4, 4, 50.0, 50.0, 54.0, 54.0)],
                                  "item_id string, width int, height int, bbox_west double, bbox_south double, bbox_east double, bbox_north double")
    rows = [("a", y, x, min(3, 7 - y), min(4, 10 - x), rng.integers(0, 99, min(3, 7 - y) * min(4, 10 - x)).tolist()) for y in (0, 3, 6) for x in (0, 4, 8)]
    df = spark.createDataFrame([*rows, ("far", 0, 0, 4, 4, list(range(16)))], "item_id string, y_off int, x_off int, h int, w int, pixels array<int>")
    for box in ([2.5, 1.0, 8.5, 4.5], [0.0, 0.0, 10.0, 7.0], [4.6, 2.6, 5.4, 3.4], [20.0, 20.0, 30.0, 30.0]):
        spread = lambda d: {tuple(r) for r in tiles.explode_pixels(d, ["item_id"]).collect()}
        located = tiles.geo_transform(tiles.explode_pixels(df, ["item_id"]), items)
        expected = {tuple(r) for r in search.filter_spatial(located, box).select("item_id", "y", "x", "value").collect()}
        assert spread(tiles.clip_tiles(df, items, box)) == expected


def test_whole_tiles_pass_a_retiling_uncut(spark):
    planes = spark.createDataFrame(
        [("k", "uint8", y, x, h, w, 6, 6, bytearray(range(10 * k, 10 * k + h * w))) for k, (y, x, h, w) in enumerate([(0, 0, 4, 4), (0, 4, 4, 2), (4, 0, 2, 3), (4, 3, 2, 3)])],
        "key string, dtype string, y_off int, x_off int, h int, w int, _height int, _width int, data binary",
    )
    out = {(r.tile_row, r.tile_col): bytes(r.data) for r in tiles.retile_bytes(planes, ["key", "dtype"], "dtype", 4).collect()}
    assert out[0, 0] == bytes(range(16)) and out[0, 1] == bytes(range(10, 18))
    assert out[1, 0] == bytes([20, 21, 22, 30, 23, 24, 25, 33]) and out[1, 1] == bytes([31, 32, 34, 35])


def test_listings_share_a_schema(spark):
    polygon = {"type": "Polygon", "coordinates": [[[1, 2], [5, 2], [5, 8.5], [1, 8], [1, 2]]]}
    upstream = [
        {"Id": "a", "Name": "A", "GeoFootprint": polygon, "Attributes": [{"Name": "productType", "Value": "S2MSI2A"}, {"Name": "platformShortName", "Value": "Sentinel-2"}]},
        {"Id": "b", "GeoFootprint": None}, {"Id": "c", "GeoFootprint": {"type": "Point", "coordinates": [1, 2]}},
    ]
    found = {r.id: r for r in readers.decode_products(spark.createDataFrame([(json.dumps(x),) for x in upstream], "value string")).collect()}
    assert (found["a"].west, found["a"].south, found["a"].east, found["a"].north) == (1, 2, 5, 8.5)
    assert (found["a"].product_type, found["a"].collection) == ("S2MSI2A", "SENTINEL-2") and found["b"].west is found["c"].north is None
    features = [
        {"id": "x", "collection": "sentinel-2-l2a", "bbox": [1, 2, 3, 4], "properties": {"datetime": "2024-07-01T00:00:00Z", "eo:cloud_cover": 7}, "assets": {"red": {"href": "u", "type": "t"}}},
        {"id": "y", "collection": "other", "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 1]]], [[[-3, 4], [2, 9]]]]}},
    ]
    stac = readers.decode_stac_products(spark.createDataFrame([(json.dumps(x),) for x in features], "value string"), search.UPSTREAM_COLLECTIONS)
    rows = {r.id: r for r in stac.collect()}
    assert (rows["x"].collection, rows["x"].cloud_cover, rows["x"].west) == ("SENTINEL-2", 7, 1)
    assert (rows["y"].collection, rows["y"].cloud_cover, rows["y"].date) == ("OTHER", -1, "")
    assert (rows["y"].west, rows["y"].south, rows["y"].east, rows["y"].north) == (-3, 0, 2, 9)
    assert [tuple(r) for r in readers.product_assets(stac, ["B04", "B08"]).collect()] == [("x", "B04", "u")]


def test_retention_leaves_kept_days_alone(spark, tmp_path):
    path = str(tmp_path / "log")
    log = spark.range(40).select("id", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(id * 6 AS INT))").alias("ts"))
    log.withColumn("day", F.to_date("ts").cast("string")).repartition("day").write.partitionBy("day").parquet(path)
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "log").rglob("*.parquet")}
    for _ in range(2):
        sinks.sink_retention(spark, path, "2024-01-11 12:00:00", retain_days=5)
        assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(22, 40))
    assert folder_names(spark, path) == [f"day=2024-01-{d:02d}" for d in range(6, 11)]
    kept = {f: t for f, t in files.items() if f.exists() and "day=2024-01-06" not in str(f)}
    assert len({f.parent for f in kept}) == 4 and all(f.stat().st_mtime_ns == t for f, t in kept.items())
    sinks.sink_retention(spark, path, "2024-03-01 00:00:00", retain_days=5)
    assert folder_names(spark, path) == []


def test_index_of_a_tile_works_each_pixel_out_once(spark):
    """The gaps are filled from the values, not from the formula written out for each case."""
    nan, inf = float("nan"), float("inf")
    a = [8.0, 1.0, 0.0, nan, inf, -inf, 3e38, None, -3e38, 5.0]
    b = [2.0, -1.0, 0.0, 1.0, 1.0, 1.0, -2.9999e38, 1.0, 2.9999e38, None]
    df = spark.createDataFrame([(1, a, b)], "key int, nir array<float>, red array<float>")
    found = indices.tile_index(df, "ndvi", ["key"])
    pixels = spark.createDataFrame(list(zip(range(10), a, b)), "x int, n float, r float")
    expected = [r[0] for r in pixels.orderBy("x").select(indices.gateway_difference(F.col("n"), F.col("r"))).collect()]
    assert found.first().pixels == expected and expected[:4] == [pytest.approx(0.6), 0.0, 0.0, 0.0] and expected[7] is None
    assert found._jdf.queryExecution().optimizedPlan().toString().count(" / ") == 1
