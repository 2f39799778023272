"""From a request to an index: the catalogue, the tiles and the pixels in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rastermill.functions.text import band_from_item_id
from rastermill.operators import indices
from rastermill.operators.bands import OPERATION_BANDS, band_lookup, resolve_needed_bands
from rastermill.operators.search import WORLD, search_bbox, search_collections, search_datetime, search_fallback
from rastermill.operators.tiles import ALL_BANDS, TILE_SIZE, reconstruct, retile, to_finest_grid
from rastermill.plans.pick import last_per_key
from rastermill.session import pin

# Bands and format used when a graph does not name them.
DEFAULT_RED, DEFAULT_NIR, DEFAULT_FORMAT = "B04", "B08", "GTiff"

EXTENT = "west double, south double, east double, north double, xmin double, ymin double, xmax double, ymax double"
GRAPH_NODE = (
    "process_id string, arguments struct<id:string, bands:array<string>, "
    f"spatial_extent:struct<{EXTENT.replace(' double', ':double')}>, temporal_extent:array<string>, extent:string, "
    "red:string, nir:string, format:string>"
)


def cube_query(
    items: DataFrame, tiles: DataFrame, operation: str, bands: list[str] | None = None, key: str = "item_id",
    collections: list[str] | None = None, bbox: list[float] | None = None, datetime_range: str | None = None,
    tile_size: int = TILE_SIZE, **arguments,
) -> DataFrame:
    """load -> filter -> align -> pair bands -> operation, as one lazy plan.

    ``tiles``: key, band, y_off, x_off, w, pixels. The catalogue filter reaches
    the tile table as a semi-join, the band filter reaches its scan, and one
    shuffle of tile rows pairs the bands. Without ``bands`` each item's bands
    (its column ``bands``) decide which of them fills a role of the operation.

    Tiles that also carry h and their raster's ``width`` and ``height`` are
    brought to the item's finest grid of ``tile_size`` first. Of several tiles
    of one band and place the one with the highest ``seq``, if there is such a
    column, wins.
    """
    chosen = search_datetime(search_bbox(search_collections(items, collections), bbox), datetime_range)
    if bands is None:
        loaded, bands = _offered(tiles, chosen, key, operation)
    else:
        loaded = tiles.filter(F.col("band").isin(list(bands))).join(chosen.select(key), key, "left_semi")
    order = "seq" if "seq" in loaded.columns else None
    cube = _cube(loaded, key, bands, order, tile_size)
    if operation == "stack":
        return indices.stack_passthrough(cube, bands)
    return indices.apply_op(cube, operation, **arguments)


def process_items(
    requests: DataFrame, tiles: DataFrame, operation: str, bands: list[str] | None = None, tile_size: int = TILE_SIZE, **arguments
) -> DataFrame:
    """Run an operation for many requests at once.

    ``requests``: request_id, item_id, position and, if no ``bands`` are named,
    the ``bands`` each item offers. When several items of a request carry a
    band, the one with the highest position wins. Tiles are those of
    ``cube_query``; where they carry their raster's shape, the winners of a
    request are brought to the finest grid among them.
    """
    if bands is None:
        offered = requests.select("item_id", "bands").dropDuplicates(["item_id"])
        tiles, bands = _offered(tiles, offered, "item_id", operation)
    loaded = tiles.filter(F.col("band").isin(list(bands))).join(requests.select("request_id", "item_id", "position"), "item_id")
    if _has_shape(loaded):
        # the shape of an item that loses all its bands must not count
        last = loaded.groupBy("request_id", "band").agg(F.max("position").alias("position"))
        loaded = loaded.join(last, ["request_id", "band", "position"])
    cube = _cube(loaded, "request_id", bands, "position", tile_size)
    return indices.apply_op(cube, operation, **arguments)


def cube_query_store(
    requests: DataFrame, items: DataFrame, chunks: DataFrame, operation: str | None = None, bands: list[str] | None = None,
    nir: str = DEFAULT_NIR, red: str = DEFAULT_RED, limit: int = 500, tile_size: int = TILE_SIZE,
) -> DataFrame:
    """Requests answered from the stored chunks: search, best item of each band, tiles, common grid and index, as tiles.

    ``requests`` are those of ``search_fallback``. ``items`` are catalogue rows that also carry width, height, tile_size,
    dtype, band_names and chunk_hashes; ``chunks`` is the chunk table. Returns (request_id, band, tile_row, tile_col, y_off, x_off, h,
    w, pixels, width, height, item_id): tiles of the index, or of each band where no ``operation`` is given, on the request's
    finest grid. ``item_id`` is the item whose place on earth the result takes.

    Of the items found for a request each tells its band (its only declared one, else the end of its id), and the
    widest of a band is read, the first found of equals. Where no item tells a band, the first ten are read
    band by band, later ones winning. A vegetation index needs its two bands, or their stand-ins among ``bands``; requests that
    lack them get no row. All choices are made on narrow rows: each wanted chunk is read once, and only tiles move.
    """
    if operation not in (None, "ndvi"):
        raise ValueError("stored requests are answered with ndvi or with the bands themselves")
    needed = sorted({nir, red, *(bands or [])}) if operation == "ndvi" else list(bands or []) or None
    catalogue = items.withColumnRenamed("id", "item_id")
    facts = catalogue.select(
        "item_id", "datetime", "width", "height", F.get("band_names", F.lit(0)).alias("_own"), "band_names", band_from_item_id("item_id", "band_names").alias("_tells")
    )
    found = search_fallback(requests, items, limit).select("request_id", "item_id").join(facts, "item_id")
    wanted = lambda band: F.lit(True) if needed is None else band.isin(needed)

    # the best item of each band; the rank is applied before rows move
    told = found.filter(F.col("_tells").isNotNull()).withColumn("band", F.col("_tells"))
    in_order = [F.col("datetime").desc(), F.col("item_id")]
    per_band = Window.partitionBy("request_id", "band")
    best = told.withColumn("_n", F.row_number().over(per_band.orderBy(F.coalesce("width", F.lit(0)).desc(), *in_order))).filter("_n = 1")
    best = best.filter(wanted(F.col("band"))).select("request_id", "band", "item_id", F.col("_own").alias("_source"), "width", "height", "datetime")
    # items of many bands, where none tells its band
    silent = found.join(told.select("request_id").distinct(), "request_id", "left_anti")
    per_request = Window.partitionBy("request_id")
    first = silent.withColumn("_n", F.row_number().over(per_request.orderBy(*in_order))).filter("_n <= 10")
    spread = first.withColumn("band", F.explode("band_names")).filter(wanted(F.col("band")))
    spread = spread.withColumn("_m", F.row_number().over(per_band.orderBy(F.col("_n").desc()))).filter("_m = 1")
    chosen = best.unionByName(spread.select("request_id", "band", "item_id", F.col("band").alias("_source"), "width", "height", "datetime"))
    lead = F.row_number().over(per_request.orderBy(*in_order, "band"))
    reference = chosen.withColumn("_n", lead).filter("_n = 1").select("request_id", F.col("item_id").alias("_reference"))
    if operation == "ndvi":
        offered = chosen.groupBy(F.col("request_id").alias("item_id")).agg(F.collect_set("band").alias("bands"))  # of the needed ones
        roles = band_lookup(offered, [nir, red]).select(
            F.col("item_id").alias("request_id"), "band", F.explode(F.filter(F.array(
                F.when(F.col("target") == nir, F.lit("nir")), F.when(F.col("target") == red, F.lit("red"))), lambda r: r.isNotNull())).alias("role")
        )
        chosen = chosen.join(roles, ["request_id", "band"])
    else:
        chosen = chosen.withColumn("role", F.col("band"))
    chosen = pin(chosen.join(reference, "request_id"))  # a row per request and band, read by the two steps below

    read = chosen.groupBy("item_id").agg(F.collect_set("_source").alias("wanted_bands"))
    stored = catalogue.select("item_id", "width", "height", "tile_size", "dtype", "band_names", "chunk_hashes").join(read, "item_id")
    # an item's single band may be filed under another name than it is known by
    single = F.size("chunk_hashes") == 1
    only = F.element_at(F.map_keys("chunk_hashes"), 1)
    stored = stored.withColumn("wanted_bands", F.when(single & (only != ALL_BANDS), F.array(only)).otherwise(F.col("wanted_bands")))
    plain = (F.size("wanted_bands") == 1).alias("_one")
    tiles = reconstruct(stored, chunks, element="float" if operation else "double")
    by_item = tiles.join(stored.select("item_id", plain, "tile_size"), "item_id")
    tiles = by_item.join(chosen.withColumnRenamed("band", "_band"), "item_id").filter(F.col("_one") | (F.col("band") == F.col("_source")))
    tiles = tiles.drop("band", "_source", "_one", "datetime").withColumnRenamed("_band", "band")
    carry = ("role", "width", "height", "_reference")
    cut = retile(tiles.filter(F.col("tile_size") != tile_size), ["request_id", "band", *carry], tile_size)
    same = tiles.filter(F.col("tile_size") == tile_size).select(*cut.columns)
    grid = to_finest_grid(same.unionByName(cut), ["request_id"], tile_size, ("role", "_reference"))
    shape = chosen.groupBy("request_id").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    place = ["request_id", "tile_row", "tile_col", "y_off", "x_off", "h", "w", "_reference"]
    if operation == "ndvi":
        result = indices.tile_index(indices.pair_tiles(grid, place, ["nir", "red"]), "ndvi", place).withColumn("band", F.lit("ndvi"))
    else:
        result = grid
    return result.join(shape, "request_id").select(
        "request_id", "band", *place[1:-1], "pixels", "width", "height", F.col("_reference").alias("item_id")
    )


def _has_shape(tiles: DataFrame) -> bool:
    return {"width", "height", "h"} <= set(tiles.columns)


def _offered(tiles: DataFrame, items: DataFrame, key: str, operation: str) -> tuple[DataFrame, list[str]]:
    """Tiles of the bands that each item offers for the operation, named after the first choice for their role."""
    roles = OPERATION_BANDS.get(operation)
    if roles is None:
        raise ValueError(f"name the bands that {operation} works on")
    names = [choices[0] for choices in roles]
    picks = resolve_needed_bands(items.select(F.col(key).alias("item_id"), "bands"), operation).filter("role IS NOT NULL")
    picks = picks.select(F.col("item_id").alias(key), "band", F.get(F.array(*map(F.lit, names)), F.col("role")).alias("_name"))
    return tiles.join(picks, [key, "band"]).drop("band").withColumnRenamed("_name", "band"), names


def _cube(loaded: DataFrame, key: str, bands: list[str], order: str | None, tile_size: int) -> DataFrame:
    if _has_shape(loaded):
        loaded = to_finest_grid(loaded, [key], tile_size, (order,) if order else ())
    place = [c for c in ("y_off", "x_off", "w") if c in loaded.columns]
    return indices.cube_from_tiles(indices.pair_bands(loaded, [key, *place], bands, order=order), [key], bands)


def best_item_per_band(items: DataFrame) -> DataFrame:
    """Per collection and band the widest item, the first (``seq``) on ties."""
    named = items.withColumn("band", band_from_item_id("id")) if "band" not in items.columns else items
    known = named.filter(F.col("band").isNotNull())
    return last_per_key(known, ["collection", "band"], F.coalesce("width", F.lit(0)), -F.col("seq"))


def graph_requirements(graphs: DataFrame) -> DataFrame:
    """Data needs of many process graphs (graph_id, graph as JSON): one row per load_collection.

    Columns: graph_id, position, collection, west…north, date_from, date_to,
    bands, operation, red, nir, format. Filters change the load before them.
    """
    nodes = graphs.select("graph_id", F.posexplode(F.map_entries(F.from_json("graph", "map<string,string>"))).alias("position", "node"))
    nodes = nodes.select("graph_id", "position", F.from_json("node.value", GRAPH_NODE).alias("n")).select(
        "graph_id", "position", F.col("n.process_id").alias("process"), F.col("n.arguments").alias("args")
    )
    whole = Window.partitionBy("graph_id")
    upto = whole.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)

    def latest(argument: str, name: str, default: str):
        """Last non-empty value in the graph."""
        given = F.col(f"args.{argument}")
        value = F.when((F.col("process") == name) & (F.coalesce(given, F.lit("")) != ""), given)
        picked = F.max_by(value, F.when(value.isNotNull(), F.col("position"))).over(whole)
        return F.coalesce(picked, F.lit(default))

    is_load = F.col("process") == "load_collection"
    nodes = nodes.withColumns(
        {
            "load": F.max(F.when(is_load, F.col("position"))).over(upto),
            "operation": F.max(F.when(F.col("process") == "ndvi", F.lit("ndvi"))).over(whole),
            "red": latest("red", "ndvi", DEFAULT_RED),
            "nir": latest("nir", "ndvi", DEFAULT_NIR),
            "format": latest("format", "save_result", DEFAULT_FORMAT),
        }
    ).filter(F.col("load").isNotNull())

    corners = (("west", "xmin"), ("south", "ymin"), ("east", "xmax"), ("north", "ymax"))

    def box(extent, aliases: bool):
        def corner(name, alias, world):
            return F.coalesce(extent[name], extent[alias] if aliases else F.lit(None), F.lit(world)).alias(name)

        return F.struct(*[corner(*names, world) for names, world in zip(corners, WORLD)])

    # a filter's extent is a box or a period, so it is kept as text until its process is known
    loaded, filtered = F.col("args.spatial_extent"), F.col("args.extent")
    spatial = F.when(is_load & loaded.isNotNull(), box(loaded, True)).when(
        (F.col("process") == "filter_spatial") & filtered.isNotNull(), box(F.from_json(filtered, EXTENT), False)
    )
    temporal = F.when(is_load, F.col("args.temporal_extent")).when(
        (F.col("process") == "filter_temporal") & filtered.isNotNull(), F.from_json(filtered, "array<string>")
    )
    last_of = lambda value: F.max_by(value, F.when(value.isNotNull(), F.col("position")))
    empty = F.array().cast("array<string>")
    grouped = nodes.groupBy("graph_id", F.col("load").alias("position")).agg(
        F.max(F.when(is_load, F.coalesce("args.id", F.lit("")))).alias("collection"),
        last_of(spatial).alias("_s"),
        last_of(temporal).alias("_t"),
        F.coalesce(last_of(F.when(is_load, F.col("args.bands"))), empty).alias("bands"),
        *[F.first(c).alias(c) for c in ("operation", "red", "nir", "format")],
    )
    return grouped.select(
        "graph_id", "position", "collection", "_s.*", F.get("_t", F.lit(0)).alias("date_from"), F.get("_t", F.lit(1)).alias("date_to"),
        "bands", "operation", "red", "nir", "format",
    )


