"""Raster operators against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rastermill.operators import indices, tiles
from rastermill.plans import cube as plans
from rastermill.session import pin

KEYS = ["item_id", "band"]


def whole(spark, arrays, item="r"):
    rows = [(item, b, 0, 0, a.shape[0], a.shape[1], [int(v) for v in a.ravel()]) for b, a in arrays.items()]
    return spark.createDataFrame(rows, "item_id string, band string, y_off int, x_off int, h int, w int, pixels array<int>")


def image(df, value="value", shape=None):
    rows = df.collect()
    out = np.zeros(shape or (max(r.y for r in rows) + 1, max(r.x for r in rows) + 1))
    for r in rows:
        out[r.y, r.x] = r[value]
    return out


@pytest.mark.parametrize("shape, size", [((2, 3), 2), ((5, 5), 2), ((7, 4), 3), ((4, 4), 4), ((3, 9), 16)])
def test_retile_cuts_like_numpy(spark, shape, size):
    a = np.arange(shape[0] * shape[1]).reshape(shape)
    got = {(r.tile_row, r.tile_col): r for r in tiles.retile(whole(spark, {"B": a}), KEYS, size).collect()}
    assert len(got) == -(-shape[0] // size) * -(-shape[1] // size)
    for (row, col), r in got.items():
        part = a[row * size : (row + 1) * size, col * size : (col + 1) * size]
        assert (r.h, r.w) == part.shape and r.pixels == part.ravel().tolist() and (r.y_off, r.x_off) == (row * size, col * size)
    grid = tiles.tile_grid(spark.createDataFrame([("r", shape[1], shape[0])], "item_id string, width int, height int"), size).collect()
    assert {(g.tile_row, g.tile_col): (g.h, g.w) for g in grid} == {k: (r.h, r.w) for k, r in got.items()}
    back = tiles.retile(tiles.retile(whole(spark, {"B": a}), KEYS, size), KEYS, 100)
    assert back.first().pixels == a.ravel().tolist()


def archive(spark, arrays, size, layout, dtype="uint16"):
    small = tiles.retile(whole(spark, arrays), KEYS, size)
    h, w = next(iter(arrays.values())).shape
    cols = -(-w // size)
    if layout == tiles.BAND_LEVEL:
        chunks, lists = tiles.hash_tiles(tiles.encode_tile(small, dtype), KEYS, cols)
        items = lists.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("band", "hashes"))).alias("chunk_hashes"))
    else:
        stacked = tiles.stack_bands(small, ["item_id"]).drop("bands")
        chunks, lists = tiles.hash_tiles(tiles.encode_tile(stacked, dtype), ["item_id"], cols)
        items = lists.select("item_id", F.create_map(F.lit("*"), F.col("hashes")).alias("chunk_hashes"))
    meta = {"width": w, "height": h, "tile_size": size, "dtype": dtype}
    items = items.withColumns({k: F.lit(v) for k, v in meta.items()})
    return items.withColumn("band_names", F.array(*[F.lit(b) for b in sorted(arrays)])), chunks


@pytest.mark.parametrize("layout", [tiles.BAND_LEVEL, tiles.SPATIAL])
@pytest.mark.parametrize("dtype", ["uint8", "uint16", "float32"])
def test_round_trip(spark, layout, dtype):
    rng = np.random.default_rng(1)
    arrays = {b: rng.integers(0, 250, (5, 7)) for b in ("B02", "B04", "B08")}
    items, chunks = archive(spark, arrays, 3, layout, dtype)
    rebuilt = tiles.explode_pixels(tiles.reconstruct(items, chunks), KEYS)
    for b, a in arrays.items():
        assert np.array_equal(image(rebuilt.filter(F.col("band") == b)), a)
    only = tiles.reconstruct(items, chunks, ["B08"])
    assert {r.band for r in only.select("band").collect()} == {"B08"}


@pytest.mark.parametrize("layout", [tiles.BAND_LEVEL, tiles.SPATIAL])
def test_missing_chunk_gives_zeros(spark, layout):
    arrays = {"B04": np.arange(1, 26).reshape(5, 5), "B08": np.arange(101, 126).reshape(5, 5)}
    items, chunks = archive(spark, arrays, 2, layout)
    hashes = items.select(F.explode("chunk_hashes").alias("b", "h")).filter("b IN ('*', 'B04')").select(F.get("h", F.lit(4)).alias("sha"))
    rebuilt = tiles.explode_pixels(tiles.reconstruct(items, chunks.join(hashes, "sha", "left_anti"), ["B04"]), KEYS)
    expected = arrays["B04"].copy()
    expected[2:4, 2:4] = 0
    assert np.array_equal(image(rebuilt), expected)


def test_chunk_bytes_are_numpy_bytes(spark):
    import hashlib

    a, b = np.arange(6).reshape(2, 3), np.arange(6, 12).reshape(2, 3)
    _, chunks = archive(spark, {"B02": a, "B04": b}, 8, tiles.SPATIAL, "int16")
    row = chunks.first()
    raw = np.stack([a, b]).astype("int16").tobytes()
    assert bytes(row.data) == raw and row.sha == hashlib.sha256(raw).hexdigest()


def pixel_cube(spark, **bands):
    names = list(bands)
    rows = [(0, k, *[float(bands[n][k]) for n in names]) for k in range(len(bands[names[0]]))]
    return spark.createDataFrame(rows, "y int, x int, " + ", ".join(f"{n} float" for n in names))


def values(df, column):
    return np.array([r[column] for r in df.orderBy("x").collect()], dtype=np.float32)


def random_bands(n=400, seed=2):
    rng = np.random.default_rng(seed)
    return {b: np.where(rng.random(n) < 0.2, 0, rng.integers(0, 10000, n)).astype(np.float32) for b in ("B02", "B03", "B04", "B08", "B11")}


def test_indices_match_numpy_float32(spark):
    b = random_bands()
    cube = pixel_cube(spark, **b)
    blue, green, red, nir, swir = (b[k] for k in ("B02", "B03", "B04", "B08", "B11"))
    with np.errstate(all="ignore"):
        nd = lambda p, q: np.where(p + q == 0, np.float32(0), (p - q) / (p + q))
        den = nir + np.float32(6) * red - np.float32(7.5) * blue + np.float32(1)
        evi = np.clip(np.where(den == 0, np.float32(0), np.float32(2.5) * (nir - red) / den), -1, 1)
    assert np.array_equal(values(indices.ndvi(cube), "ndvi"), nd(nir, red))
    assert np.array_equal(values(indices.ndwi(cube), "ndwi"), nd(green, nir))
    assert np.array_equal(values(indices.ndsi(cube), "ndsi"), nd(green, swir))
    assert np.array_equal(values(indices.evi(cube), "evi"), evi)
    rgb = indices.true_color(cube)
    assert np.array_equal(values(rgb, "red"), red) and np.array_equal(values(rgb, "blue"), blue)


def test_evi_zero_denominator(spark):
    cube = pixel_cube(spark, B08=[6.5], B04=[0.0], B02=[1.0])
    assert values(indices.evi(cube), "evi").tolist() == [0.0]


def test_cloud_mask_classes(spark):
    cube = pixel_cube(spark, SCL=[7, 8, 9, 10, 11])
    assert values(indices.cloud_mask(cube), "cloud_mask").tolist() == [1, 0, 0, 0, 1]


def test_band_aliases_and_target_band(spark):
    cube = pixel_cube(spark, B8A=[3.0], red=[1.0])
    assert values(indices.ndvi(cube), "ndvi").tolist() == [0.5]
    assert values(indices.ndvi(cube, nir="B08", red="B04"), "ndvi").tolist() == [0.5]
    kept = indices.ndvi(cube, target_band="veg")
    assert kept.columns == ["y", "x", "B8A", "red", "veg"]
    with pytest.raises(KeyError):
        indices.ndwi(cube)


@pytest.mark.parametrize(
    "expression",
    ["B08 - B04", "(B08 - B04) / (B08 + B04)", "B08 / B04", "-B04 ** 2 + 1.5", "np.where(B08 > B04, B08, B04 * 2)", "1 / (B08 / B04)",
     "np.sqrt(B04 - 5000)", "np.log(B04)", "np.clip(B08, 100, 5000)", "np.maximum(B08, B04) - np.minimum(B08, B04)", "np.abs(B04 - B08)",
     "np.where((B08 > 3000) & (B04 < 5000), B02, -1.0)", "np.where(B08 / B04 > 1, 1.0, 0.0)", "np.where(B04 / B04 != B04, 2.0, 1.0)"],
)
def test_band_math_matches_numpy(spark, expression):
    b = {k: v for k, v in random_bands(200).items() if k in ("B02", "B04", "B08")}
    with np.errstate(all="ignore"):
        expected = np.nan_to_num(eval(expression, {"np": np}, dict(b)), nan=0, posinf=0, neginf=0).astype(np.float32)  # noqa: S307
    got = values(indices.band_math(pixel_cube(spark, **b), expression), "result")
    assert np.allclose(got, expected, rtol=2e-6, atol=0)


@pytest.mark.parametrize("bad", ["", "1 + 2", "__import__('os')", "B04.real", "B99 + 1", "np.load(B04)", "[B04 for x in B08]", "lambda: B04"])
def test_band_math_refuses(spark, bad):
    with pytest.raises((ValueError, SyntaxError)):
        indices.band_math(pixel_cube(spark, B04=[1.0], B08=[2.0]), bad)


@pytest.mark.parametrize("src, dst", [((2, 3), (4, 6)), ((3, 2), (7, 5)), ((5, 5), (3, 2)), ((4, 4), (4, 4)), ((1, 1), (3, 3))])
def test_resample_nearest(spark, src, dst):
    a = np.arange(src[0] * src[1]).reshape(src)
    pixels = tiles.explode_pixels(whole(spark, {"B": a}), KEYS)
    rows = ((np.arange(dst[0]) + 0.5) * src[0] / dst[0]).astype(int)
    cols = ((np.arange(dst[1]) + 0.5) * src[1] / dst[1]).astype(int)
    got = tiles.resample_nearest(pixels, *src, *dst)
    assert got.count() == dst[0] * dst[1]
    assert np.array_equal(image(got, shape=dst), a[np.ix_(rows, cols)])


def test_pairing_takes_the_latest(spark):
    rows = [("s", "B04", [1, 1], 0), ("s", "B04", [2, 2], 1), ("s", "B08", [4, 6], 0), ("t", "B04", [9, 9], 0)]
    df = spark.createDataFrame(rows, "scene string, band string, pixels array<int>, pos int")
    paired = indices.pair_bands(df, ["scene"], ["B04", "B08"], order="pos")
    cube = indices.cube_from_tiles(paired, ["scene"], ["B04", "B08"], width=2)
    got = sorted(map(tuple, cube.collect()))
    assert got == [("s", 0, 0, 2, 4), ("s", 0, 1, 2, 6), ("t", 0, 0, 9, None), ("t", 0, 1, 9, None)]


def test_geo_transform(spark):
    items = spark.createDataFrame([("r", 4, 2, 10.0, 40.0, 14.0, 44.0)], "item_id string, width int, height int, bbox_west double, bbox_south double, bbox_east double, bbox_north double")
    pixels = spark.createDataFrame([("r", 0, 0), ("r", 1, 3)], "item_id string, y int, x int")
    assert sorted((r.lon, r.lat) for r in tiles.geo_transform(pixels, items).collect()) == [(10.5, 43.0), (13.5, 41.0)]


def test_numpy_hook(spark):
    a = np.arange(6).reshape(2, 3)
    df = tiles.tile_pixels_by(whole(spark, {"B": a}), lambda p: p.T * 0.5, T.DoubleType())
    assert df.first().pixels == (a.T * 0.5).ravel().tolist()


def test_registered_operation(spark):
    indices.register_op("ratio", lambda b: [(b["B08"] / F.lit(2)).alias("half")], ["B08"])
    assert indices.apply_op(pixel_cube(spark, B08=[4.0]), "ratio").first().half == 2.0
    with pytest.raises(ValueError):
        indices.apply_op(pixel_cube(spark, B08=[4.0]), "nope")


def test_migration(spark):
    a, b, late = (np.arange(k, k + 25).reshape(5, 5) for k in (1, 100, 1000))
    coarse = np.arange(4).reshape(2, 2)

    def legacy(item, band, array, seq, layout=tiles.BAND_LEVEL, dtype="uint16"):
        items, chunks = archive(spark, {band: array}, 2, layout, dtype)
        return items.withColumns({"item_id": F.lit(item), "chunk_format": F.lit(layout), "seq": F.lit(seq)}), chunks

    parts = [
        legacy("S2_T32TPT_20240709_B04", "B04", a, 0), legacy("S2_T32TPT_20240709_B08", "B08", b, 1, tiles.LEGACY, "uint8"), legacy("S2_T32TPT_20240709_B04x", "B04", late, 2),
        legacy("S2_T32TPT_20240709_B11", "B11", coarse, 3), legacy("alone", "B02", a, 4), legacy("done", "B02", a, 5, tiles.SPATIAL),
    ]
    items, chunks = parts[0]
    for more_items, more_chunks in parts[1:]:
        items, chunks = items.unionByName(more_items), chunks.unionByName(more_chunks)
    items, chunks = pin(items), pin(chunks.dropDuplicates(["sha"]))
    after, fresh, moves = tiles.migrate_tiles(items, chunks, 3)
    after, fresh = pin(after), pin(fresh)
    assert {r.item_id for r in after.collect()} == {"T32TPT_20240709_5x5", "S2_T32TPT_20240709_B11", "alone", "done"}
    assert {r.item_id: r.dtype for r in after.collect()}["T32TPT_20240709_5x5"] == "uint16"
    assert {r.new_id for r in moves.collect()} == {"T32TPT_20240709_5x5", "S2_T32TPT_20240709_B11", "alone"}
    store = chunks.select("sha", "data").unionByName(fresh.select("sha", "data"))
    rebuilt = tiles.explode_pixels(tiles.reconstruct(after, store), KEYS)
    pick = lambda i, band: image(rebuilt.filter((F.col("item_id") == i) & (F.col("band") == band)))
    assert np.array_equal(pick("T32TPT_20240709_5x5", "B04"), late) and np.array_equal(pick("T32TPT_20240709_5x5", "B08"), b)
    assert np.array_equal(pick("alone", "B02"), a) and np.array_equal(pick("S2_T32TPT_20240709_B11", "B11"), coarse)
    again, nothing, _ = tiles.migrate_tiles(after, store, 3)
    assert nothing.count() == 0 and again.count() == 4


def test_graph_requirements(spark):
    graph = """{"f": {"process_id": "filter_temporal", "arguments": {"extent": ["1999", "2000"]}},
      "l": {"process_id": "load_collection", "arguments": {"id": "s2", "spatial_extent": {"west": 1, "ymin": 2}, "temporal_extent": ["2024-01-01", "2024-02-01"]}},
      "n": {"process_id": "ndvi", "arguments": {"red": "B03"}}, "n2": {"process_id": "ndvi", "arguments": {"nir": "B8A"}}}"""
    df = spark.createDataFrame([(1, graph), (2, '{"x": {"process_id": "save_result", "arguments": {}}}')], "graph_id int, graph string")
    rows = plans.graph_requirements(df).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.collection, r.west, r.south, r.east, r.north) == ("s2", 1.0, 2.0, 180.0, 90.0)
    assert (r.date_from, r.date_to, r.bands, r.operation, r.red, r.nir, r.format) == ("2024-01-01", "2024-02-01", [], "ndvi", "B03", "B8A", "GTiff")


def test_best_item_per_band(spark):
    df = spark.createDataFrame([("a_B04", "c", 10, 1), ("b_B04", "c", 20, 2), ("d_B04", "c", 20, 3), ("plain", "c", 99, 4)], "id string, collection string, width int, seq int")
    assert [r.id for r in plans.best_item_per_band(df).collect()] == ["b_B04"]


@pytest.mark.parametrize("coarse, fine, size", [((4, 4), (8, 8), 4), ((3, 5), (7, 11), 4), ((2, 2), (12, 12), 5), ((5, 4), (5, 9), 3)])
def test_finest_grid_is_nearest_neighbour(spark, coarse, fine, size):
    a, b = (np.arange(s[0] * s[1]).reshape(s) for s in (coarse, fine))
    shaped = [
        tiles.retile(whole(spark, {name: v}), KEYS, size).withColumns({"width": F.lit(v.shape[1]), "height": F.lit(v.shape[0])})
        for name, v in (("C", a), ("F", b))
    ]
    aligned = pin(tiles.to_finest_grid(shaped[0].unionByName(shaped[1]), ["item_id"], size))
    lines = (2 * np.arange(fine[0]) + 1) * coarse[0] // (2 * fine[0])
    columns = (2 * np.arange(fine[1]) + 1) * coarse[1] // (2 * fine[1])
    for name, want in (("C", a[np.ix_(lines, columns)]), ("F", b)):
        mine = aligned.filter(F.col("band") == name)
        assert np.array_equal(image(tiles.explode_pixels(mine, KEYS), shape=fine), want)
        grid = tiles.tile_grid(spark.createDataFrame([("r", fine[1], fine[0])], "item_id string, width int, height int"), size).collect()
        assert {(r.tile_row, r.tile_col): (r.h, r.w) for r in mine.collect()} == {(g.tile_row, g.tile_col): (g.h, g.w) for g in grid}
        assert mine.count() == len(grid)


def test_process_items_aligns_the_winning_bands(spark):
    rows = [
        ("old", "B03", 0, 0, 4, 4, 4, 4, list(range(16))), ("new", "B03", 0, 0, 2, 2, 2, 2, [1, 2, 3, 4]), ("new", "B11", 0, 0, 2, 2, 2, 2, [1, 1, 1, 1]),
    ]
    band_tiles = spark.createDataFrame(rows, "item_id string, band string, y_off int, x_off int, h int, w int, width int, height int, pixels array<int>")
    offers = [("q", "old", 0, ["B03"]), ("q", "new", 1, ["B03", "B11"])]
    requests = spark.createDataFrame(offers, "request_id string, item_id string, position int, bands array<string>")
    got = {(r.y, r.x): r.ndsi for r in plans.process_items(requests, band_tiles, "ndsi").collect()}
    assert got == {k: pytest.approx((v - 1) / (v + 1)) for k, v in {(0, 0): 1, (0, 1): 2, (1, 0): 3, (1, 1): 4}.items()}
