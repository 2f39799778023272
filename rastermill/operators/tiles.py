"""Cutting rasters into tiles, tile bytes and hashes, and rebuilding rasters.

A tile row is ``(keys…, tile_row, tile_col, y_off, x_off, h, w, pixels)`` with
``pixels`` row-major. Shuffles move tiles or single tile lines, never pixels;
pixels are spread out only for element-wise work, which needs no shuffle. Every
list built by a group is bounded by the tile size or by the tiles of one item.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rastermill.functions.geo import pixel_centre, pixel_middle
from rastermill.functions.text import scene_key
from rastermill.plans.pick import first_per_key, last_per_key
from rastermill.session import pin, small_batches
from rastermill.sources.sinks import content_hash

# Default tile edge and chunk layouts.
TILE_SIZE = 512
SLICE = 1 << 22  # bytes of tiles that a task turns into numbers or back at a time
SPATIAL, BAND_LEVEL, LEGACY = "spatial-tile", "band-level", "legacy"
ALL_BANDS = "*"

ELEMENTS = {
    "double": (T.DoubleType(), "float64", pa.float64()),
    "float": (T.FloatType(), "float32", pa.float32()),
    "int": (T.IntegerType(), "int32", pa.int32()),
}


def _div(a: Column | str, b: Column | int) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    return F.floor(a / b).cast("int")


def tile_grid(rasters: DataFrame, tile_size: int = TILE_SIZE) -> DataFrame:
    """Tiles of each raster (``width``, ``height``), row by row, clipped at the edges."""
    rows, cols = F.ceil(F.col("height") / tile_size).cast("int"), F.ceil(F.col("width") / tile_size).cast("int")
    grid = rasters.withColumn("_cols", cols).withColumn("tile_row", F.explode(F.sequence(F.lit(0), rows - 1)))
    grid = grid.withColumn("tile_col", F.explode(F.sequence(F.lit(0), F.col("_cols") - 1)))
    return grid.withColumns(
        {
            "tile_idx": F.col("tile_row") * F.col("_cols") + F.col("tile_col"),
            "y_off": F.col("tile_row") * tile_size,
            "x_off": F.col("tile_col") * tile_size,
            "h": F.least(F.lit(tile_size), F.col("height") - F.col("tile_row") * tile_size),
            "w": F.least(F.lit(tile_size), F.col("width") - F.col("tile_col") * tile_size),
        }
    ).drop("_cols")


def _placed(tiles: DataFrame, tile_size: int) -> DataFrame:
    return tiles.withColumns({"y_off": F.col("tile_row") * tile_size, "x_off": F.col("tile_col") * tile_size})


def tile_raster(pixels: DataFrame, keys: list[str], tile_size: int = TILE_SIZE) -> DataFrame:
    """Tiles from single pixels (``y``, ``x``, ``value``); a repeated pixel must be settled before."""
    at = pixels.withColumns({"tile_row": _div("y", tile_size), "tile_col": _div("x", tile_size)})
    listed = F.array_sort(F.collect_list(F.struct("y", "x", "value")))
    tiles = at.groupBy(*keys, "tile_row", "tile_col").agg(
        F.transform(listed, lambda p: p["value"]).alias("pixels"),
        (F.max("y") - F.min("y") + 1).alias("h"),
        (F.max("x") - F.min("x") + 1).alias("w"),
    )
    return _placed(tiles, tile_size)


def retile(tiles: DataFrame, keys: list[str], tile_size: int = TILE_SIZE) -> DataFrame:
    """Tiles of another size from tiles of any size (a whole raster is one big tile).

    Tile lines are cut at the new borders and regrouped, so a shuffled row is
    one line fragment and a group holds at most ``tile_size`` lines.
    """
    lines = tiles.withColumn("_r", F.explode(F.sequence(F.lit(0), F.col("h") - 1)))
    first, last = _div("x_off", tile_size), _div(F.col("x_off") + F.col("w") - 1, tile_size)
    lines = lines.withColumn("tile_col", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("x_off"), F.col("tile_col") * tile_size)
    stop = F.least(F.col("x_off") + F.col("w"), (F.col("tile_col") + 1) * tile_size)
    fragments = lines.select(
        *keys,
        "tile_col",
        (F.col("y_off") + F.col("_r")).cast("int").alias("_y"),
        start.alias("_x"),
        F.slice("pixels", F.col("_r") * F.col("w") + start - F.col("x_off") + 1, stop - start).alias("_v"),
    ).withColumn("tile_row", _div("_y", tile_size))
    ordered = F.array_sort(F.collect_list(F.struct("_y", "_x", "_v")))
    joined = fragments.groupBy(*keys, "tile_row", "tile_col").agg(
        F.flatten(F.transform(ordered, lambda s: s["_v"])).alias("pixels"),
        (F.max("_y") - F.min("_y") + 1).cast("int").alias("h"),
        (F.max(F.col("_x") + F.size("_v")) - F.min("_x")).cast("int").alias("w"),
    )
    return _placed(joined, tile_size)


def stack_bands(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """One row per tile position with all bands' pixels in band-name order."""
    ordered = F.array_sort(F.collect_list(F.struct("band", "pixels")))
    return tiles.groupBy(*keys, "tile_row", "tile_col", "y_off", "x_off", "h", "w").agg(
        F.flatten(F.transform(ordered, lambda s: s["pixels"])).alias("pixels"),
        F.transform(ordered, lambda s: s["band"]).alias("bands"),
    )


def explode_pixels(tiles: DataFrame, keys: list[str], value: str = "pixels", out: str = "value") -> DataFrame:
    """(keys…, y, x, value) for every pixel of every tile."""
    spread = tiles.select(*keys, "y_off", "x_off", "w", F.posexplode(value).alias("_p", out))
    y, x = F.col("y_off") + _div("_p", F.col("w")), F.col("x_off") + F.col("_p") % F.col("w")
    return spread.select(*keys, y.cast("int").alias("y"), x.cast("int").alias("x"), out)


def _slices(batches: Iterator[pa.RecordBatch], column: str, change: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ``change`` makes of about ``SLICE`` bytes of ``column`` at a time, a row at least; a batch is given up before the next is read."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        if pa.types.is_list(values.type):
            sizes = pc.multiply(pc.list_value_length(values), values.type.value_type.bit_width // 8).to_pylist()
        else:
            sizes = pc.binary_length(values).to_pylist()
        start, n = 0, 0
        for k, size in enumerate(sizes):
            n += size or 0
            if n > SLICE or k == len(sizes) - 1:
                yield change(batch.slice(start, k + 1 - start))
                start, n = k + 1, 0
        del batch, values


def _copied(batch: pa.RecordBatch, names: list[str]) -> list[pa.Array]:
    """Columns that keep nothing else of their batch in memory."""
    rows = pa.array(range(batch.num_rows), pa.int64())
    return [batch.column(batch.schema.get_field_index(n)).take(rows) for n in names]


def encode_tile(tiles: DataFrame, dtype: str | None = "uint16") -> DataFrame:
    """Replace ``pixels`` by their bytes (column ``data``).

    The numpy type is ``dtype`` or, when that is None, the row's ``dtype`` column.
    """
    kept = [f for f in tiles.schema.fields if f.name != "pixels"]
    schema = T.StructType([*kept, T.StructField("data", T.BinaryType())])
    names = [f.name for f in kept]

    def encoded(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(batch.schema.get_field_index("pixels"))
        values = lists.flatten().to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(int)
        types = [dtype] * len(lists) if dtype else batch.column(batch.schema.get_field_index("dtype")).to_pylist()
        data = [values[a:b].astype(kind).tobytes() for a, b, kind in zip(ends[:-1], ends[1:], types)]
        return pa.RecordBatch.from_arrays([*_copied(batch, names), pa.array(data, pa.binary())], [*names, "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _slices(batches, "pixels", encoded)

    small_batches(tiles.sparkSession)
    return tiles.select(*names, "pixels").mapInArrow(run, schema)


def decode_tile(chunks: DataFrame, dtype: str | None = None, element: str = "double") -> DataFrame:
    """Replace ``data`` by its values (column ``pixels``).

    The numpy type of the bytes is ``dtype`` or, when that is None, the row's
    ``dtype`` column. ``element`` is the Spark type of the values: doubles hold
    every pixel type, ``int`` or ``float`` halve what later shuffles move when
    the archive's types allow it. Missing bytes stay a null list. A task unpacks ``SLICE`` bytes at a time, so
    beside the Arrow batch that came in it holds the numbers of a few full-size tiles, not of all.
    """
    kept = [f for f in chunks.schema.fields if f.name != "data"]
    schema = T.StructType([*kept, T.StructField("pixels", T.ArrayType(ELEMENTS[element][0]))])
    numpy_type, arrow_type = ELEMENTS[element][1:]
    names = [f.name for f in kept]

    def decoded(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = batch.column(batch.schema.get_field_index("data"))
        types = [dtype] * len(data) if dtype else batch.column(batch.schema.get_field_index("dtype")).to_pylist()
        values = [
            None if raw is None else np.frombuffer(raw, kind).astype(numpy_type) for raw, kind in zip(data.to_pylist(), types)
        ]
        return pa.RecordBatch.from_arrays([*_copied(batch, names), pa.array(values, pa.list_(arrow_type))], [*names, "pixels"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _slices(batches, "data", decoded)

    small_batches(chunks.sparkSession)
    return chunks.select(*names, "data").mapInArrow(run, schema)


def tile_pixels_by(tiles: DataFrame, function: Callable, element: T.DataType) -> DataFrame:
    """Hook for a user's numpy function on tiles: ``function(array) -> array`` of ``element`` values, run per tile."""
    names = [f.name for f in tiles.schema.fields if f.name != "pixels"]
    kept = [f for f in tiles.schema.fields if f.name != "pixels"]
    out = T.StructType([*kept, T.StructField("pixels", T.ArrayType(element))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [
                np.asarray(function(np.asarray(p).reshape(h, w))).ravel() for p, h, w in zip(pdf["pixels"], pdf["h"], pdf["w"])
            ]
            yield pdf[names].assign(pixels=done)

    return tiles.mapInPandas(run, out)


def hash_tiles(encoded: DataFrame, keys: list[str], columns: int | Column) -> tuple[DataFrame, DataFrame]:
    """Chunks (sha, data, bytes) of encoded tiles, and per key the hash list in tile order.

    ``columns`` is the number of tile columns of the raster. A hash list is
    part of its item's row, so it is bounded by the tiles of one raster.
    """
    hashed = encoded.withColumn("sha", content_hash())
    width = F.lit(columns) if isinstance(columns, int) else columns
    numbered = hashed.withColumn("_idx", F.col("tile_row") * width + F.col("tile_col"))
    ordered = F.array_sort(F.collect_list(F.struct("_idx", "sha")))
    lists = numbered.select(*keys, "_idx", "sha").groupBy(*keys).agg(F.transform(ordered, lambda s: s["sha"]).alias("hashes"))
    chunks = hashed.select("sha", "data", F.octet_length("data").cast("bigint").alias("bytes")).dropDuplicates(["sha"])
    return chunks, lists


def build_item(rasters: DataFrame, tile_size: int = TILE_SIZE) -> DataFrame:
    """Catalogue items from raster metadata and hash lists.

    ``rasters``: item_id, collection, datetime, crs, bbox_west…north, width,
    height, band_names, dtype, source_file, hashes.
    """
    corners = [("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"), ("west", "south")]
    ring = F.array(*[F.array(F.col(f"bbox_{x}"), F.col(f"bbox_{y}")) for x, y in corners])
    properties = F.struct(
        "datetime", "crs", "width", "height", F.size("band_names").alias("bands"), "band_names", "dtype",
        F.lit(tile_size).alias("tile_size"),
        F.ceil(F.col("width") / tile_size).cast("int").alias("tile_cols"),
        F.ceil(F.col("height") / tile_size).cast("int").alias("tile_rows"),
        "source_file", F.lit(SPATIAL).alias("chunk_format"),
    )
    return rasters.select(
        F.col("item_id").alias("id"),
        "collection",
        F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))).alias("geometry"),
        "bbox_west", "bbox_south", "bbox_east", "bbox_north",
        "datetime",
        properties.alias("properties"),
        F.create_map(
            F.lit("data"),
            F.struct(
                F.lit("/chunks").alias("href"),
                F.lit("application/octet-stream").alias("type"),
                F.lit("Spatial-tiled raster data (all bands per tile)").alias("title"),
                F.size("hashes").alias("chunk_count"),
                F.col("band_names").alias("bands_available"),
            ),
        ).alias("assets"),
        F.create_map(F.lit(ALL_BANDS), F.col("hashes")).alias("chunk_hashes"),
    )


def _placed_chunks(items: DataFrame, bands: list[str] | None, carry: tuple[str, ...]) -> DataFrame:
    """One row per wanted chunk reference with its place in the raster."""
    if bands is not None:
        items = items.withColumn("wanted_bands", F.array(*[F.lit(b) for b in bands]))
    picked = ["wanted_bands"] if "wanted_bands" in items.columns else []
    kept = ["item_id", *carry, "dtype", "band_names", *picked]
    lists = items.select(*kept, "width", "height", "tile_size", F.explode("chunk_hashes").alias("_band", "_hashes"))
    if picked:
        lists = lists.filter((F.col("_band") == ALL_BANDS) | F.array_contains("wanted_bands", F.col("_band")))
    refs = lists.select(*kept, "width", "height", "tile_size", "_band", F.posexplode("_hashes").alias("_idx", "sha"))
    size, cols = F.col("tile_size"), F.ceil(F.col("width") / F.col("tile_size")).cast("int")
    row, col = _div("_idx", cols), F.col("_idx") % cols
    return refs.select(
        *kept, "_band", "sha",
        row.alias("tile_row"), col.alias("tile_col"), (row * size).alias("y_off"), (col * size).alias("x_off"),
        F.least(size, F.col("height") - row * size).alias("h"), F.least(size, F.col("width") - col * size).alias("w"),
        F.col("width").alias("_width"), F.col("height").alias("_height"),
    )


def reconstruct(
    items: DataFrame, chunks: DataFrame, bands: list[str] | None = None, carry: tuple[str, ...] = (), element: str = "double"
) -> DataFrame:
    """Band tiles of each item from its hash lists; a missing chunk gives zeros.

    ``items``: item_id, width, height, tile_size, dtype, band_names and
    ``chunk_hashes`` (band -> hashes, or ``*`` -> hashes of all-band tiles).
    With per-band hashes the band filter comes before the chunk join, so only
    the wanted bands' bytes are read. The bands wanted may differ per item: a
    column ``wanted_bands`` does what ``bands`` does for all. ``carry`` names
    item columns to keep beside each tile.
    """
    placed = _placed_chunks(items, bands, carry)
    wanted = "wanted_bands" in placed.columns
    decoded = decode_tile(placed.join(chunks.select("sha", "data"), "sha", "left"), element=element)
    area = F.col("h") * F.col("w")
    per_band = F.when(
        F.col("_band") == ALL_BANDS,
        F.transform(
            "band_names", lambda b, i: F.struct(b.alias("band"), F.slice("pixels", i * area + 1, area).alias("pixels"))
        ),
    ).otherwise(F.array(F.struct(F.col("_band").alias("band"), F.col("pixels"))))
    if wanted:
        per_band = F.filter(per_band, lambda b: F.array_contains("wanted_bands", b["band"]))
    zeros = F.array_repeat(F.lit(0).cast(element), area)
    tiles = decoded.withColumn("_b", F.explode(per_band))
    return tiles.select(
        "item_id", *carry, F.col("_b.band").alias("band"), "tile_row", "tile_col", "y_off", "x_off", "h", "w",
        F.coalesce("_b.pixels", zeros).alias("pixels"),
    )


def shape_check(bands: DataFrame) -> DataFrame:
    """Bands (scene, band, h, w, seq) whose shape differs from their scene's first band."""
    lead = first_per_key(bands.select("scene", "seq", "h", "w"), ["scene"], "seq")
    lead = lead.select("scene", F.col("h").alias("_h"), F.col("w").alias("_w"))
    return bands.join(lead, "scene").filter((F.col("h") != F.col("_h")) | (F.col("w") != F.col("_w"))).select("scene", "band", "h", "w")


def geo_transform(pixels: DataFrame, items: DataFrame, key: str = "item_id") -> DataFrame:
    """Add the centre coordinates of each pixel from its item's box and shape."""
    box = items.select(key, "width", "height", "bbox_west", "bbox_south", "bbox_east", "bbox_north")
    lon = pixel_centre(F.col("bbox_west"), F.col("bbox_east"), F.col("width"), F.col("x"))
    lat = pixel_middle(F.col("bbox_north"), F.col("bbox_south"), F.col("height"), F.col("y"))
    located = pixels.join(box, key).withColumns({"lon": lon, "lat": lat})
    return located.drop("width", "height", "bbox_west", "bbox_south", "bbox_east", "bbox_north")


def clip_tiles(tiles: DataFrame, items: DataFrame, bbox: list[float], key: str = "item_id", value: str = "pixels") -> DataFrame:
    """The part of each tile whose pixel centres lie in the box, ends included; tiles outside it go as they are.

    A centre's longitude depends on its column alone and its latitude on its line, so the box is a window of columns and lines: it
    is found from the tile's edges, and the rows inside are sliced. Pixels outside are never made.
    """
    west, south, east, north = bbox
    box = items.select(key, "width", "height", "bbox_west", "bbox_south", "bbox_east", "bbox_north")
    lon = lambda x: pixel_centre(F.col("bbox_west"), F.col("bbox_east"), F.col("width"), x)
    lat = lambda y: pixel_middle(F.col("bbox_north"), F.col("bbox_south"), F.col("height"), y)
    columns = F.filter(F.sequence("x_off", F.col("x_off") + F.col("w") - 1), lambda x: lon(x).between(west, east))
    lines = F.filter(F.sequence("y_off", F.col("y_off") + F.col("h") - 1), lambda y: lat(y).between(south, north))
    # items outside the box are left out before any tile is met
    near = box.filter((F.col("bbox_east") >= west) & (F.col("bbox_west") <= east) & (F.col("bbox_north") >= south) & (F.col("bbox_south") <= north))
    cut = tiles.join(near, key).withColumns({"_x": columns, "_y": lines}).filter((F.size("_x") > 0) & (F.size("_y") > 0))
    first = F.get("_x", F.lit(0)) - F.col("x_off")
    rows = F.transform("_y", lambda y: F.slice(value, ((y - F.col("y_off")) * F.col("w") + first + 1).cast("int"), F.size("_x")))
    window = {
        value: F.flatten(rows), "y_off": F.get("_y", F.lit(0)).cast("int"), "x_off": F.get("_x", F.lit(0)).cast("int"),
        "h": F.size("_y"), "w": F.size("_x"),
    }
    # under other names first, as the slices are cut by the tile's old edges
    made = cut.select("*", *[c.alias(f"_new_{name}") for name, c in window.items()])
    return made.select(*[F.col(f"_new_{c}").alias(c) if c in window else c for c in tiles.columns])


def tile_axes(tiles: DataFrame, items: DataFrame, key: str = "item_id") -> DataFrame:
    """Tiles with the longitudes of their columns (``lons``) and the latitudes of their lines (``lats``), instead of a pair per pixel."""
    box = items.select(key, "width", "height", "bbox_west", "bbox_south", "bbox_east", "bbox_north")
    lons = F.transform(F.sequence("x_off", F.col("x_off") + F.col("w") - 1), lambda x: pixel_centre(F.col("bbox_west"), F.col("bbox_east"), F.col("width"), x))
    lats = F.transform(F.sequence("y_off", F.col("y_off") + F.col("h") - 1), lambda y: pixel_middle(F.col("bbox_north"), F.col("bbox_south"), F.col("height"), y))
    return tiles.join(box, key).select(*tiles.columns, lons.alias("lons"), lats.alias("lats"))


def resample_nearest(pixels: DataFrame, height: int, width: int, target_height: int, target_width: int) -> DataFrame:
    """Pixels of a ``height`` x ``width`` raster on a ``target`` grid, nearest neighbour.

    Target line i reads source line floor((i + 0.5) * src / dst). Each source
    pixel emits the targets that read it, in whole numbers: no join, no shuffle.
    """

    def targets(position: str, src: int, dst: int) -> Column:
        at = F.col(position).cast("bigint")

        def first_reader(p: Column) -> Column:  # smallest i with (2i + 1) * src >= 2 * dst * p
            return F.greatest(F.lit(0), -F.floor((F.lit(src) - 2 * dst * p) / F.lit(2 * src)))

        begin, end = first_reader(at), first_reader(at + 1)
        begin, end = begin.cast("int"), F.least(end, F.lit(dst)).cast("int")
        return F.when(end > begin, F.sequence(begin, end - 1)).otherwise(F.array().cast("array<int>"))

    rest = [c for c in pixels.columns if c not in ("y", "x")]
    lines = pixels.withColumn("_y", F.explode(targets("y", height, target_height)))
    return lines.withColumn("_x", F.explode(targets("x", width, target_width))).select(
        *[c for c in pixels.columns if c in rest], F.col("_y").alias("y"), F.col("_x").alias("x")
    ).select(*pixels.columns)


def to_finest_grid(tiles: DataFrame, keys: list[str], tile_size: int = TILE_SIZE, carry: tuple[str, ...] = ()) -> DataFrame:
    """Tiles of all bands of a key on the grid of its finest band, nearest neighbour.

    Tiles carry ``band`` and their raster's ``width`` and ``height``; the shape
    aimed at is the largest of either over the key's bands. Tiles of that shape
    pass as they are. A coarser tile yields its part of every target tile it
    reaches, as in ``resample_nearest``; only parts that do not fill their
    target tile (shapes that are no multiples) are joined by a shuffle of lines.
    ``carry`` names columns that stay with a tile and do not differ within a band.
    """
    shape = tiles.groupBy(*keys).agg(F.max("width").alias("_tw"), F.max("height").alias("_th"))
    placed = tiles.join(shape, keys)
    fits = (F.col("width") == F.col("_tw")) & (F.col("height") == F.col("_th"))
    kept = [*keys, "band", *carry]

    def reach(off: str, size: str, src: str, dst: str) -> tuple[Column, Column]:
        """Target positions that read a source position of the tile; position i reads floor((2i + 1) * src / (2 * dst))."""
        first = lambda p: F.greatest(F.lit(0), F.ceil((2 * F.col(dst) * p - F.col(src)) / (2 * F.col(src)))).cast("int")
        return first(F.col(off)), F.least(first(F.col(off) + F.col(size)), F.col(dst)).cast("int")

    coarse = placed.filter(~fits).drop("tile_row", "tile_col")
    for axis, off, size, src, dst, at in (("y", "y_off", "h", "height", "_th", "tile_row"), ("x", "x_off", "w", "width", "_tw", "tile_col")):
        begin, end = reach(off, size, src, dst)
        coarse = coarse.withColumns({"_b": begin, "_e": end}).filter("_e > _b")
        coarse = coarse.withColumn(at, F.explode(F.sequence(_div("_b", tile_size), _div(F.col("_e") - 1, tile_size))))
        start, stop = F.greatest("_b", F.col(at) * tile_size), F.least(F.col("_e"), (F.col(at) + 1) * tile_size)
        coarse = coarse.withColumns({f"_{axis}0": start, f"_{axis}1": stop})

    def read(at: Column, src: str, dst: str, off: str) -> Column:
        return (F.floor((2 * at + 1) * F.col(src) / (2 * F.col(dst))) - F.col(off)).cast("int")

    columns = F.transform(F.sequence("_x0", F.col("_x1") - 1), lambda x: read(x, "width", "_tw", "x_off"))
    lines = F.transform(F.sequence("_y0", F.col("_y1") - 1), lambda y: read(y, "height", "_th", "y_off"))
    parts = coarse.withColumns({"_columns": columns, "_lines": lines}).withColumn(
        "_pixels", F.flatten(F.transform("_lines", lambda y: F.transform("_columns", lambda x: F.get("pixels", y * F.col("w") + x))))
    )
    parts = parts.select(
        *kept, "tile_row", "tile_col", F.col("_y0").alias("y_off"), F.col("_x0").alias("x_off"),
        (F.col("_y1") - F.col("_y0")).alias("h"), (F.col("_x1") - F.col("_x0")).alias("w"), F.col("_pixels").alias("pixels"),
        (
            (F.col("_y1") - F.col("_y0") == F.least(F.lit(tile_size), F.col("_th") - F.col("tile_row") * tile_size))
            & (F.col("_x1") - F.col("_x0") == F.least(F.lit(tile_size), F.col("_tw") - F.col("tile_col") * tile_size))
        ).alias("_fills"),
    )
    out = [*kept, "tile_row", "tile_col", "y_off", "x_off", "h", "w", "pixels"]
    as_they_are = placed.filter(fits).withColumns({"tile_row": _div("y_off", tile_size), "tile_col": _div("x_off", tile_size)})
    joined = retile(parts.filter(~F.col("_fills")).drop("tile_row", "tile_col", "_fills"), kept, tile_size)
    return as_they_are.select(*out).unionByName(parts.filter("_fills").select(*out)).unionByName(joined.select(*out))


# Bytes per pixel of the numpy types rasters come in.
PIXEL_BYTES = {
    "uint8": 1, "int8": 1, "uint16": 2, "int16": 2, "uint32": 4, "int32": 4, "float32": 4, "uint64": 8, "int64": 8, "float64": 8,
}


def _pixel_bytes(dtype: str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in PIXEL_BYTES.items() for x in kv]), F.col(dtype))


@F.pandas_udf(T.StringType())
def common_type(types: pd.Series) -> pd.Series:
    """Numpy type that holds all the given types (one list per raster, not per pixel)."""
    return types.apply(lambda names: str(np.result_type(*names)))


def band_bytes(items: DataFrame, chunks: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Bytes of each wanted band's tiles, without decoding; a missing chunk gives null ``data``."""
    joined = _placed_chunks(items, None, carry).join(chunks.select("sha", "data"), "sha", "left")
    area = F.col("h") * F.col("w") * _pixel_bytes("dtype")
    planes = F.transform("band_names", lambda b, i: F.struct(b.alias("band"), (i * area).alias("from")))
    planes = F.when(F.col("_band") == ALL_BANDS, planes).otherwise(
        F.array(F.struct(F.col("_band").alias("band"), F.lit(0).alias("from")))
    )
    planes = F.filter(planes, lambda p: F.array_contains("wanted_bands", p["band"]))
    cut = joined.withColumn("_p", F.explode(planes))
    return cut.select(
        "item_id", *carry, "dtype", F.col("_p.band").alias("band"), "y_off", "x_off", "h", "w", "_width", "_height",
        F.substring("data", F.col("_p.from") + 1, area).alias("data"),
    )


def convert_bytes(planes: DataFrame, target: str) -> DataFrame:
    """Bytes of every plane in the type named by column ``target``; planes already in it are passed on as they are."""
    columns = [c for c in planes.columns if c != "dtype"]
    differs = (F.col("dtype") != F.col(target)) & F.col("data").isNotNull()
    recoded = encode_tile(decode_tile(planes.filter(differs)).withColumn("dtype", F.col(target)), None)
    zeros = F.unhex(F.repeat(F.lit("00"), F.col("h") * F.col("w") * _pixel_bytes(target)))
    same = planes.filter(~differs).withColumn("data", F.coalesce("data", zeros))
    return same.select(*columns).unionByName(recoded.select(*columns))


def retile_bytes(planes: DataFrame, keys: list[str], dtype: str, tile_size: int = TILE_SIZE) -> DataFrame:
    """Like ``retile`` on raw single-band bytes: lines are cut and joined as bytes, no pixel is decoded.

    A plane that is a tile of the new grid already, by the raster's ``_width`` and ``_height``, passes whole; only others are cut to lines.
    """
    at = planes.withColumns({"tile_row": _div("y_off", tile_size), "tile_col": _div("x_off", tile_size)})
    fits = (
        (F.col("y_off") == F.col("tile_row") * tile_size) & (F.col("x_off") == F.col("tile_col") * tile_size)
        & (F.col("h") == F.least(F.lit(tile_size), F.col("_height") - F.col("y_off")))
        & (F.col("w") == F.least(F.lit(tile_size), F.col("_width") - F.col("x_off")))
    )
    whole = at.filter(fits).select(*keys, "tile_row", "tile_col", "data")
    lines = at.filter(~fits).drop("tile_row", "tile_col").withColumn("_r", F.explode(F.sequence(F.lit(0), F.col("h") - 1)))
    first, last = _div("x_off", tile_size), _div(F.col("x_off") + F.col("w") - 1, tile_size)
    lines = lines.withColumn("tile_col", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("x_off"), F.col("tile_col") * tile_size)
    stop = F.least(F.col("x_off") + F.col("w"), (F.col("tile_col") + 1) * tile_size)
    size = _pixel_bytes(dtype)
    fragments = lines.select(
        *keys, "tile_col", (F.col("y_off") + F.col("_r")).cast("int").alias("_y"), start.alias("_x"),
        F.substring("data", (F.col("_r") * F.col("w") + start - F.col("x_off")) * size + 1, (stop - start) * size).alias("_v"),
    ).withColumn("tile_row", _div("_y", tile_size))
    joined = fragments.groupBy(*keys, "tile_row", "tile_col").agg(F.expr("listagg(_v) WITHIN GROUP (ORDER BY _y, _x)").alias("data"))
    return whole.unionByName(joined)


def migrate_tiles(items: DataFrame, chunks: DataFrame, tile_size: int = TILE_SIZE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merge band items of a scene into all-band tiles.

    Items not yet in the all-band layout are grouped by scene and resolution;
    where two items carry the same band the later one (``seq``) wins, and bands
    of different pixel types meet in a type that holds them all. Returns the
    items after the change, the chunks to add, and the moves (item_id, new_id).
    A group of one keeps its id; a scene with several resolutions gets the
    resolution in its new ids. Tiles are cut and stacked as bytes.
    """
    todo = items.filter(F.col("chunk_format") != SPATIAL)
    scene = scene_key("item_id")
    shape = F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"))
    todo = todo.withColumn("_scene", F.coalesce(scene, F.col("item_id"))).withColumn("_shape", shape)
    groups = todo.groupBy("_scene", "_shape").agg(
        F.count(F.lit(1)).alias("_n"), F.min("item_id").alias("_only"), F.collect_set("dtype").alias("_types")
    )
    shapes = groups.groupBy("_scene").agg(F.count(F.lit(1)).alias("_shapes"))
    new_id = F.when(F.col("_n") == 1, F.col("_only")).when(F.col("_shapes") > 1, F.concat_ws("_", "_scene", "_shape")).otherwise(F.col("_scene"))
    groups = groups.join(shapes, "_scene").select("_scene", "_shape", new_id.alias("new_id"), common_type("_types").alias("new_type"))
    named = todo.join(groups, ["_scene", "_shape"])

    # one winner per band, settled on item rows before any bytes are read
    winners = named.select("new_id", "item_id", "seq", F.explode("band_names").alias("band"))
    winners = last_per_key(winners, ["new_id", "band"], "seq").select("new_id", "item_id", "band")
    read = winners.groupBy("item_id").agg(F.collect_set("band").alias("wanted_bands"))
    # the decisions are item rows only; written once, they are read by every step below
    named = pin(named.join(read, "item_id", "left"))
    planes = band_bytes(named.filter(F.col("wanted_bands").isNotNull()), chunks, carry=("new_id", "new_type"))
    cut = retile_bytes(convert_bytes(planes, "new_type"), ["new_id", "new_type", "band"], "new_type", tile_size)
    stacked = cut.groupBy("new_id", "tile_row", "tile_col").agg(F.expr("listagg(data) WITHIN GROUP (ORDER BY band)").alias("data"))

    lead = first_per_key(named.drop("_scene", "_shape", "chunk_hashes", "band_names", "item_id", "wanted_bands"), ["new_id"], "seq")
    tiles = stacked.join(lead.select("new_id", "width"), "new_id")
    fresh, lists = hash_tiles(tiles, ["new_id"], F.ceil(F.col("width") / tile_size).cast("int"))
    fresh = fresh.join(chunks.select("sha"), "sha", "left_anti")
    names = named.select("new_id", F.explode("wanted_bands").alias("band"))
    names = names.groupBy("new_id").agg(F.sort_array(F.collect_set("band")).alias("band_names"))
    rebuilt = (
        lead.join(names, "new_id").join(lists, "new_id")
        .withColumns(
            {
                "item_id": F.col("new_id"),
                "dtype": F.col("new_type"),
                "chunk_format": F.lit(SPATIAL),
                "tile_size": F.lit(tile_size),
                "chunk_hashes": F.create_map(F.lit(ALL_BANDS), F.col("hashes")),
            }
        )
        .select(*items.columns)
    )
    after = items.filter(F.col("chunk_format") == SPATIAL).unionByName(rebuilt)
    return after, fresh, named.select("item_id", "new_id")
