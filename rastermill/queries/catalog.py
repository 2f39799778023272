"""Catalogue search, coverage, band naming and product queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rastermill.fixtures import NOW_SECONDS, Inputs
from rastermill.functions.text import band_from_filename, band_from_item_id, human_bytes, scene_key, sensor_label
from rastermill.functions.times import normalise_end
from rastermill.operators import bands, coverage, search
from rastermill.registry import query
from rastermill.sources import sinks
from rastermill.sources.readers import decode_items, decode_products, decode_stac_products

ITEM_COLUMNS = ["id", "collection", "bbox_west", "bbox_south", "bbox_east", "bbox_north", "datetime", "width", "seq"]
ITEM_SQL = ", ".join(ITEM_COLUMNS)


@query(
    "src_items",
    """SELECT id, collection, bbox_west, bbox_south, bbox_east, bbox_north, datetime, CAST(strptime(datetime, '%Y-%m-%dT%H:%M:%SZ') AS TIMESTAMP) AS dt,
              width, ['B04'] AS band_names, CASE WHEN width = 1830 THEN '*' ELSE 'B04' END AS hash_band, sha256(id) AS sha FROM items""",
    ("items",),
)
def _(i: Inputs):
    properties = F.struct("datetime", F.col("width").alias("grid:width"), F.array(F.lit("B04")).alias("grid:band_names"))
    hashes = F.array(F.sha2("id", 256))
    rows = i.items.select(
        "id", "collection", "bbox_west", "bbox_south", "bbox_east", "bbox_north", "datetime", F.to_json(properties).alias("properties_json"),
        F.when(F.col("width") == 1830, F.to_json(hashes)).otherwise(F.to_json(F.create_map(F.lit("B04"), hashes))).alias("chunk_hashes_json"),
    )
    decoded = decode_items(rows)
    return decoded.select(
        "id", "collection", "bbox_west", "bbox_south", "bbox_east", "bbox_north", "datetime", F.col("dt").cast("timestamp_ntz").alias("dt"),
        "properties.width", "properties.band_names", F.get(F.map_keys("chunk_hashes"), F.lit(0)).alias("hash_band"),
        F.get(F.flatten(F.map_values("chunk_hashes")), F.lit(0)).alias("sha"),
    )


@query(
    "search_items",
    f"""SELECT {ITEM_SQL} FROM items WHERE collection IN ('sentinel-2-l2a','landsat-c2-l2')
        AND bbox_east >= -60 AND bbox_west <= 60 AND bbox_north >= -30 AND bbox_south <= 45
        AND datetime >= '1996-01-01' AND datetime <= '2000-12-31T23:59:59Z'
        ORDER BY datetime DESC, id LIMIT 100""",
    ("items",),
)
def _(i: Inputs):
    return search.search_items(
        i.items.select(*ITEM_COLUMNS), ["sentinel-2-l2a", "landsat-c2-l2"], [-60.0, -30.0, 60.0, 45.0],
        "1996-01-01/2000-12-31T23:59:59Z", 100,
    )


@query("search_collections", f"SELECT {ITEM_SQL} FROM items WHERE collection IN ('sentinel-1-grd')", ("items",))
def _(i: Inputs):
    return search.search_collections(i.items.select(*ITEM_COLUMNS), ["sentinel-1-grd"])


@query(
    "search_bbox",
    f"SELECT {ITEM_SQL} FROM items WHERE bbox_east >= 10 AND bbox_west <= 13 AND bbox_north >= 46 AND bbox_south <= 49",
    ("items",),
)
def _(i: Inputs):
    return search.search_bbox(i.items.select(*ITEM_COLUMNS), [10.0, 46.0, 13.0, 49.0])


@query(
    "search_bbox_strict",
    f"SELECT {ITEM_SQL} FROM items WHERE bbox_west < 13 AND bbox_east > 10 AND bbox_south < 49 AND bbox_north > 46",
    ("items",),
)
def _(i: Inputs):
    return search.search_bbox_strict(i.items.select(*ITEM_COLUMNS), [10.0, 46.0, 13.0, 49.0])


@query(
    "search_datetime",
    f"SELECT {ITEM_SQL} FROM items WHERE datetime >= '1997-03-01' AND datetime <= '1997-09-30T23:59:59'",
    ("items",),
)
def _(i: Inputs):
    return search.search_datetime(i.items.select(*ITEM_COLUMNS), "1997-03-01/1997-09-30T23:59:59")


@query(
    "normalise_end",
    "SELECT request_id, CASE WHEN length(date_to) = 10 THEN concat(date_to, 'T23:59:59') ELSE date_to END AS date_to FROM aois",
    ("aois",),
)
def _(i: Inputs):
    return i.aois.select("request_id", normalise_end("date_to").alias("date_to"))


@query("get_item", f"SELECT {ITEM_SQL} FROM items WHERE id = 'item-77'", ("items",))
def _(i: Inputs):
    return search.get_item(i.items.select(*ITEM_COLUMNS), "item-77")


@query("get_collection", "SELECT id FROM collections WHERE id = 'landsat-c2-l2'", ("collections",))
def _(i: Inputs):
    return search.get_collection(search.list_collections(i.collections), "landsat-c2-l2").select("id")


@query("list_collections", "SELECT id, title FROM collections", ("collections",))
def _(i: Inputs):
    return search.list_collections(i.collections)


@query("collections_of", "SELECT DISTINCT collection AS id FROM items", ("items",))
def _(i: Inputs):
    return search.collections_of(i.items)


@query("list_collection_items", "SELECT id, datetime FROM items WHERE collection = 'landsat-c2-l2'", ("items",))
def _(i: Inputs):
    return search.list_collection_items(i.items, "landsat-c2-l2").select("id", "datetime")


@query(
    "delete_item",
    "SELECT id, collection FROM items WHERE id NOT IN (SELECT concat('item-', CAST(l_orderkey AS STRING)) FROM lineitem WHERE l_quantity > 45)",
    ("items",),
)
def _(i: Inputs):
    doomed = i.lineitem.filter("l_quantity > 45").select(F.concat(F.lit("item-"), F.col("l_orderkey").cast("string")).alias("id"))
    return search.delete_item(i.items, doomed)[0].select("id", "collection")


@query(
    "delete_item_report",
    """SELECT id, bool_or(existed) AS existed FROM (
         SELECT concat('item-', CAST(c_custkey * 25 AS STRING)) AS id,
                EXISTS (SELECT 1 FROM items WHERE items.id = concat('item-', CAST(c_custkey * 25 AS STRING))) AS existed
         FROM customer) GROUP BY id""",
    ("items",),
)
def _(i: Inputs):
    doomed = i.customer.select(F.concat(F.lit("item-"), (F.col("c_custkey") * 25).cast("string")).alias("id"))
    return search.delete_item(i.items, doomed)[1]


@query(
    "latest_items",
    f"SELECT {ITEM_SQL} FROM items ORDER BY datetime DESC, id LIMIT 25",
    ("items",),
)
def _(i: Inputs):
    return search.latest_items(i.items.select(*ITEM_COLUMNS), 25)


@query(
    "bbox_aliases",
    """SELECT c_custkey AS request_id,
              CASE WHEN c_custkey % 3 = 0 THEN -180.0::DOUBLE WHEN c_custkey % 3 = 1 THEN c_nationkey::DOUBLE ELSE -c_nationkey::DOUBLE END AS west,
              -90.0::DOUBLE AS south, coalesce(CASE WHEN c_custkey % 2 = 0 THEN 50.0::DOUBLE END, 180.0::DOUBLE) AS east, 90.0::DOUBLE AS north
       FROM customer""",
)
def _(i: Inputs):
    key, nation, none = F.col("c_custkey"), F.col("c_nationkey").cast("double"), F.lit(None).cast("double")
    requests = i.customer.select(
        key.alias("request_id"),
        F.when(key % 3 == 1, nation).alias("west"), F.when(key % 3 == 2, -nation).alias("xmin"),
        none.alias("south"), none.alias("ymin"), none.alias("east"), F.when(key % 2 == 0, F.lit(50.0)).alias("xmax"),
        none.alias("north"), none.alias("ymax"),
    )
    return search.bbox_aliases(requests)


@query(
    "collection_map",
    """SELECT id, CASE collection WHEN 'sentinel-1-grd' THEN 'SENTINEL-1' ELSE 'SENTINEL-2' END AS upstream FROM items""",
    ("items",),
)
def _(i: Inputs):
    return search.collection_map(i.items).select("id", "upstream")


@query(
    "alive_nodes",
    f"SELECT node_id, last_seen_s FROM nodes WHERE {NOW_SECONDS} - last_seen_s < 300",
    ("nodes",),
)
def _(i: Inputs):
    return search.alive_nodes(i.nodes, NOW_SECONDS).select("node_id", "last_seen_s")


@query(
    "alive_peers",
    f"SELECT node_id, last_seen_s FROM (SELECT node_id, last_seen_s - node_id % 3 * 100 AS last_seen_s FROM nodes) WHERE {NOW_SECONDS} - last_seen_s < 600",
    ("nodes",),
)
def _(i: Inputs):
    peers = i.nodes.select("node_id", (F.col("last_seen_s") - F.col("node_id") % 3 * 100).alias("last_seen_s"))
    return search.alive_peers(peers, NOW_SECONDS)


def _nodes_with_collections(i: Inputs):
    held = i.node_collections.groupBy("node_id").agg(F.sort_array(F.collect_set("collection")).alias("collections"))
    return i.nodes.join(held, "node_id")


@query(
    "nodes_for_collection",
    f"""SELECT node_id, node_name FROM nodes WHERE {NOW_SECONDS} - last_seen_s < 300
        AND node_id IN (SELECT node_id FROM node_collections WHERE collection = 'sentinel-2-l2a')""",
    ("nodes", "node_collections"),
)
def _(i: Inputs):
    nodes = _nodes_with_collections(i)
    return search.nodes_for_collection(nodes, "sentinel-2-l2a", NOW_SECONDS).select("node_id", "node_name")


@query(
    "seed_nodes",
    f"SELECT node_id, url, item_count FROM nodes WHERE {NOW_SECONDS} - last_seen_s < 300 AND url IS NOT NULL AND item_count > 0",
    ("nodes",),
)
def _(i: Inputs):
    return search.seed_nodes(i.nodes, NOW_SECONDS).select("node_id", "url", "item_count")


@query(
    "product_search",
    """SELECT product_id, date, cloud_cover FROM products
       WHERE product_type = 'ECONOMY' AND west + 1 >= -100 AND west <= 100 AND south + 1 >= -50 AND south <= 60
         AND date >= '2024-02-01T00:00:00.000Z' AND date <= '2024-08-31T23:59:59.999Z' AND cloud_cover <= 70
         AND product_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)
       ORDER BY date DESC, product_id LIMIT 10""",
    ("products",),
)
def _(i: Inputs):
    products = i.products.withColumns({"east": F.col("west") + 1, "north": F.col("south") + 1})
    known = i.lineitem.filter("l_quantity = 50").select(F.col("l_partkey").alias("product_id"))
    found = search.product_search(
        products, known, "ECONOMY", [-100.0, -50.0, 100.0, 60.0], "2024-02-01", "2024-08-31", 70.0, 10
    )
    return found.select("product_id", "date", "cloud_cover")


@query(
    "src_products",
    "SELECT product_id AS id, concat('P', CAST(product_id AS STRING)) AS name, date, round_even(CAST(product_id AS DOUBLE) * 1000000 / 1024 / 1024, 1) AS size_mb, CASE WHEN product_id % 5 <> 0 THEN cloud_cover END AS cloud_cover FROM products",
    ("products",),
)
def _(i: Inputs):
    attribute = lambda name, value: F.struct(F.lit(name).alias("Name"), value.cast("string").alias("Value"))
    with_cloud = F.array(attribute("orbit", F.col("product_id")), attribute("cloudCover", F.col("cloud_cover")))
    listing = i.products.select(
        F.to_json(
            F.struct(
                F.col("product_id").cast("string").alias("Id"),
                F.concat(F.lit("P"), F.col("product_id").cast("string")).alias("Name"),
                F.struct(F.col("date").alias("Start")).alias("ContentDate"),
                (F.col("product_id") * 1000000).alias("ContentLength"),
                F.when(F.col("product_id") % 5 != 0, with_cloud).otherwise(F.slice(with_cloud, 1, 1)).alias("Attributes"),
            )
        ).alias("value")
    )
    return decode_products(listing).select(F.col("id").cast("bigint").alias("id"), "name", "date", "size_mb", "cloud_cover")


LISTED = """SELECT product_id, product_type, date, cloud_cover, west, south, west + 1 AS east, south + 1 AS north,
                   CASE product_id % 3 WHEN 0 THEN 'SENTINEL-1' WHEN 1 THEN 'SENTINEL-2' ELSE 'SENTINEL-3' END AS collection FROM products"""


@query(
    "product_chain",
    f"""WITH listed AS ({LISTED}),
        both_lists AS (SELECT CAST(product_id AS VARCHAR) AS product_id, date, cloud_cover, west, collection FROM listed WHERE product_id % 4 <> 0 AND product_id % 5 <> 0
                 UNION ALL SELECT concat('S2_', CAST(product_id AS VARCHAR)), date, CASE WHEN product_id % 8 = 0 THEN -1 ELSE cloud_cover END, west, 'SENTINEL-2' FROM listed WHERE product_id % 4 = 0)
        SELECT product_id, date, cloud_cover, collection FROM both_lists
        WHERE collection = 'SENTINEL-2' AND west + 1 >= -100 AND west <= 100 AND date >= '2024-02-01T00:00:00.000Z' AND date <= '2024-08-31T23:59:59.999Z' AND cloud_cover <= 70""",
    ("products",),
)
def _(i: Inputs):
    """Both listings as their services send them, read into one table and searched."""
    listed = i.products.withColumns({"east": F.col("west") + 1, "north": F.col("south") + 1})
    corners = F.array(*[F.array(x, y) for x, y in (("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"), ("west", "south"))])
    polygon = F.struct(F.lit("Polygon").alias("type"), F.array(corners).alias("coordinates"))
    several = F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(corners)).alias("coordinates"))
    attribute = lambda name, value: F.struct(F.lit(name).alias("Name"), value.cast("string").alias("Value"))
    mission = F.concat(F.lit("Sentinel-"), F.col("product_id") % 3 + 1)
    facts = F.array(attribute("productType", F.col("product_type")), attribute("platformShortName", mission), attribute("cloudCover", F.col("cloud_cover")))
    upstream = listed.filter("product_id % 4 <> 0").select(F.to_json(F.struct(
        F.col("product_id").cast("string").alias("Id"), F.struct(F.col("date").alias("Start")).alias("ContentDate"), polygon.alias("GeoFootprint"),
        F.when(F.col("product_id") % 5 != 0, facts).otherwise(F.slice(facts, 1, 2)).alias("Attributes"),
    )).alias("value"))
    box = F.array("west", "south", "east", "north")
    cover = F.when(F.col("product_id") % 8 != 0, F.col("cloud_cover")).alias("eo:cloud_cover")
    archive = listed.filter("product_id % 4 = 0").select(F.to_json(F.struct(
        F.concat(F.lit("S2_"), F.col("product_id")).alias("id"), F.lit("sentinel-2-l2a").alias("collection"), several.alias("geometry"),
        F.when(F.col("product_id") % 16 != 0, box).alias("bbox"), F.struct(F.col("date").alias("datetime"), cover).alias("properties"),
    )).alias("value"))
    products = decode_products(upstream).unionByName(decode_stac_products(archive, search.UPSTREAM_COLLECTIONS).drop("assets"))
    known = products.select("product_id").limit(0)
    found = search.product_search(products, known, None, [-100.0, -90.0, 100.0, 90.0], "2024-02-01", "2024-08-31", 70.0, None, "sentinel-2-l2a")
    return found.select("product_id", "date", "cloud_cover", "collection")


@query(
    "batch_bbox_search",
    """SELECT request_id, id AS item_id FROM aois JOIN items
       ON bbox_east >= west AND bbox_west <= east AND bbox_north >= south AND bbox_south <= north""",
    ("aois", "items"),
)
def _(i: Inputs):
    return search.batch_bbox_search(i.aois, i.items).select("request_id", "item_id")


@query(
    "search_fallback",
    """WITH want AS (SELECT *, concat(date_to, 'T23:59:59') AS until FROM aois),
       s0 AS (SELECT request_id, id AS item_id, 0 AS step FROM want w JOIN items i ON i.collection = w.collection
              AND bbox_east >= west AND bbox_west <= east AND bbox_north >= south AND bbox_south <= north
              AND datetime >= date_from AND datetime <= until),
       open1 AS (SELECT * FROM want WHERE request_id NOT IN (SELECT request_id FROM s0)),
       s1 AS (SELECT request_id, item_id, step FROM (
                SELECT request_id, id AS item_id, 1 AS step,
                       row_number() OVER (PARTITION BY request_id ORDER BY datetime DESC, id) AS rn
                FROM open1 w JOIN items i ON i.collection = w.collection AND datetime >= date_from AND datetime <= until)
              WHERE rn <= 500),
       open2 AS (SELECT * FROM open1 WHERE request_id NOT IN (SELECT request_id FROM s1)),
       ranked AS (SELECT collection, id, row_number() OVER (PARTITION BY collection ORDER BY datetime DESC, id) AS rn FROM items),
       s2 AS (SELECT request_id, id AS item_id, 2 AS step FROM open2 w JOIN ranked r ON r.collection = w.collection AND rn <= 500)
       SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2""",
    ("aois", "items"),
)
def _(i: Inputs):
    return search.search_fallback(i.aois, i.items, limit=500)


METRES = "west_m AS w, south_m AS s, west_m + 109800 AS e, south_m + 109800 AS n"


def _metric_items(i: Inputs):
    return i.items.selectExpr(
        "id", "collection", "seq", "west_m AS bbox_west", "south_m AS bbox_south",
        "west_m + 109800 + 300 * (seq % 2) AS bbox_east", "south_m + 109800 AS bbox_north",
    )


METRIC_CTE = """metric AS (SELECT id, collection, seq, west_m AS w, south_m AS s, west_m + 109800 + 300 * (seq % 2) AS e, south_m + 109800 AS n FROM items),
       keyed AS (SELECT collection, round_even(w,-3) AS kw, round_even(s,-3) AS ks, round_even(e,-3) AS ke, round_even(n,-3) AS kn,
                        count(*) AS items, arg_min(abs((e-w)*(n-s))/1e6, seq) AS area FROM metric GROUP BY 1,2,3,4,5),
       cov AS (SELECT collection, CAST(sum(items) AS BIGINT) AS items, count(*) AS tiles, CAST(round_even(sum(area), 0) AS BIGINT) AS area_km2
               FROM keyed GROUP BY collection)"""


@query("coverage_by_collection", f"WITH {METRIC_CTE} SELECT * FROM cov", ("items",))
def _(i: Inputs):
    return coverage.coverage_by_collection(_metric_items(i))


@query(
    "sensors_only",
    f"WITH {METRIC_CTE} SELECT *, CAST(sum(area_km2) OVER () AS BIGINT) AS total_area_km2 FROM cov WHERE collection NOT LIKE '%\\_derived%' ESCAPE '\\'",
    ("items",),
)
def _(i: Inputs):
    return coverage.sensors_only(coverage.coverage_by_collection(_metric_items(i)))


@query("item_count", "SELECT count(*) AS n FROM items", ("items",))
def _(i: Inputs):
    return coverage.item_count(i.items)


@query("item_count_by_collection", "SELECT collection, count(*) AS n FROM items GROUP BY collection", ("items",))
def _(i: Inputs):
    return coverage.item_count(i.items, by_collection=True)


@query(
    "catalog_summary",
    f"""WITH {METRIC_CTE} SELECT (SELECT string_agg(id, ',' ORDER BY id) FROM collections) AS collections,
           (SELECT count(*) FROM items) AS item_count, CAST(sum(area_km2) AS BIGINT) AS total_area_km2,
           string_agg(concat(collection, ':', CAST(items AS VARCHAR), ':', CAST(tiles AS VARCHAR), ':', CAST(area_km2 AS VARCHAR)), ',' ORDER BY collection) AS coverage FROM cov""",
    ("items", "collections"),
)
def _(i: Inputs):
    summary = coverage.catalog_summary(_metric_items(i), i.collections)
    covered = F.transform("coverage", lambda c: F.concat_ws(":", c["collection"], c["items"], c["tiles"], c["area_km2"]))
    return summary.select(F.array_join("collections", ",").alias("collections"), "item_count", "total_area_km2", F.array_join(covered, ",").alias("coverage"))


@query(
    "km2_queried",
    """WITH boxes AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 400000.0 ELSE c_nationkey * 10.0 - 120 END AS w,
                          CASE WHEN c_custkey % 7 = 0 THEN 5000000.0 ELSE c_custkey % 60 END AS s,
                          CASE WHEN c_custkey % 7 = 0 THEN 410000.0 ELSE c_nationkey * 10.0 - 118.5 END AS e,
                          CASE WHEN c_custkey % 7 = 0 THEN 5020000.0 ELSE c_custkey % 60 + 2 END AS n,
                          c_custkey % 13 = 5 AS bad, c_custkey % 17 = 3 AS blank FROM customer)
       SELECT count(*) AS total_requests, CAST(round_even(sum(CASE WHEN bad THEN 0
                WHEN abs(w) > 1000 OR abs(e) > 1000 THEN abs((e-w)*(n-s))/1e6
                ELSE abs((e-w)*(111.32::DOUBLE*cos(radians((n+s)/2)))*(n-s)*111.32::DOUBLE) END), 0) AS BIGINT) AS total_km2
       FROM boxes WHERE NOT blank""",
)
def _(i: Inputs):
    k = F.col("c_custkey")
    west = F.when(k % 7 == 0, F.lit(400000.0)).otherwise(F.col("c_nationkey") * 10.0 - 120)
    south = F.when(k % 7 == 0, F.lit(5000000.0)).otherwise((k % 60).cast("double"))
    east = F.when(k % 7 == 0, F.lit(410000.0)).otherwise(F.col("c_nationkey") * 10.0 - 118.5)
    north = F.when(k % 7 == 0, F.lit(5020000.0)).otherwise((k % 60).cast("double") + 2)
    text = F.concat_ws(",", *[c.cast("string") for c in (west, south, east, north)])
    text = F.when(k % 17 == 3, F.lit("")).when(k % 13 == 5, F.concat(text, F.lit(",oops"))).otherwise(text)
    return coverage.km2_queried(i.customer.select(text.alias("query_bbox")))


@query(
    "band_from_filename",
    """WITH f AS (SELECT seq, CASE seq % 6 WHEN 0 THEN concat('T32_', seq, '_B8A_20m.jp2') WHEN 1 THEN concat('T32_', seq, '_tci.jp2')
                       WHEN 2 THEN concat('LC08_', seq, '_SR_B5.TIF') WHEN 3 THEN concat('s2_scl_', seq, '.tif')
                       ELSE concat('stack_', seq, '.tif') END AS name,
                    CASE seq % 6 WHEN 1 THEN 3 WHEN 4 THEN 4 WHEN 5 THEN 12 ELSE 1 END AS n FROM items)
       SELECT seq, CASE seq % 6 WHEN 0 THEN ['B8A'] WHEN 1 THEN ['B04','B03','B02'] WHEN 2 THEN ['SR_B5'] WHEN 3 THEN ['SCL']
                   WHEN 4 THEN ['B01','B02','B03','B04']
                   ELSE ['B01','B02','B03','B04','B05','B06','B07','B08','B09','B10','B11','B12'] END AS bands FROM f""",
    ("items",),
)
def _(i: Inputs):
    kind, seq = F.col("seq") % 6, F.col("seq").cast("string")
    name = (
        F.when(kind == 0, F.concat(F.lit("T32_"), seq, F.lit("_B8A_20m.jp2")))
        .when(kind == 1, F.concat(F.lit("T32_"), seq, F.lit("_tci.jp2")))
        .when(kind == 2, F.concat(F.lit("LC08_"), seq, F.lit("_SR_B5.TIF")))
        .when(kind == 3, F.concat(F.lit("s2_scl_"), seq, F.lit(".tif")))
        .otherwise(F.concat(F.lit("stack_"), seq, F.lit(".tif")))
    )
    n = F.when(kind == 1, 3).when(kind == 4, 4).when(kind == 5, 12).otherwise(1)
    return i.items.select("seq", band_from_filename(name, n).alias("bands"))


_IDS = """SELECT seq, CASE seq % 7 WHEN 0 THEN concat('S2C_T32TPT_', CAST(20240100 + seq % 28 AS STRING), '_B04_10m')
              WHEN 1 THEN concat('S2C_T33UUB_', CAST(20240100 + seq % 28 AS STRING), '_B08')
              WHEN 2 THEN concat('S2A_T32TPT_', CAST(20240100 + seq % 28 AS STRING), '_TCI_10m')
              WHEN 3 THEN 'A_B04_C_B8A_20m' WHEN 4 THEN concat('plain-', CAST(seq AS STRING))
              WHEN 5 THEN 'L_T32TPT_1234' ELSE concat('x_', CAST(20240100 + seq % 28 AS STRING), '_b04') END AS id FROM {items}"""


def _scene_ids(i: Inputs):
    return i.spark.sql(_IDS, items=i.items)


_IDS_CTE = "ids AS (" + _IDS.replace("{items}", "items") + ")"


@query(
    "band_from_item_id",
    f"""WITH {_IDS_CTE} SELECT seq, id, CASE seq % 7 WHEN 0 THEN 'B04' WHEN 1 THEN 'B08' WHEN 2 THEN 'TCI' WHEN 3 THEN 'B04_C_B8A' END AS band FROM ids""",
    ("items",),
)
def _(i: Inputs):
    return _scene_ids(i).select("seq", "id", band_from_item_id("id").alias("band"))


@query(
    "scene_key",
    rf"""WITH {_IDS_CTE} SELECT seq, CASE WHEN regexp_matches(id, 'T\d{{2}}[A-Z]{{3}}') AND regexp_matches(id, '\d{{8}}')
          THEN concat(regexp_extract(id, 'T\d{{2}}[A-Z]{{3}}'), '_', regexp_extract(id, '\d{{8}}')) END AS scene FROM ids""",
    ("items",),
)
def _(i: Inputs):
    return _scene_ids(i).select("seq", scene_key("id").alias("scene"))


@query(
    "sensor_label",
    """SELECT id, CASE collection WHEN 'sentinel-1-grd' THEN 'Sentinel-1 GRD' WHEN 'landsat-c2-l2' THEN 'Landsat C2-L2'
              ELSE 'Sentinel-2 L2A' END AS label FROM items""",
    ("items",),
)
def _(i: Inputs):
    return i.items.select("id", sensor_label("collection").alias("label"))


@query(
    "human_bytes",
    """SELECT seq, CASE WHEN b < 1024 THEN printf('%.1f B', b) WHEN b < 1048576 THEN printf('%.1f KB', b/1024)
              WHEN b < 1073741824 THEN printf('%.1f MB', b/1048576) WHEN b < 1099511627776 THEN printf('%.1f GB', b/1073741824)
              WHEN b < 1125899906842624 THEN printf('%.1f TB', b/1099511627776) ELSE printf('%.1f PB', b/1125899906842624) END AS shown
       FROM (SELECT seq, CAST(seq * seq AS DOUBLE) * seq AS b FROM items)""",
    ("items",),
)
def _(i: Inputs):
    cubed = F.col("seq").cast("double") * F.col("seq") * F.col("seq")
    return i.items.select("seq", human_bytes(cubed).alias("shown"))


# items offer different bands, some with provider names
_OFFERS = """SELECT seq AS item_id, CASE seq % 4 WHEN 0 THEN 'B02,B03,B04,B08,SCL' WHEN 1 THEN 'b02,b03,b04,b8a'
                WHEN 2 THEN 'red,nir,green' ELSE 'B8A,B04,B11,B03' END AS offered FROM {items}"""


def _offers(i: Inputs):
    return i.spark.sql(_OFFERS, items=i.items).select("item_id", F.split("offered", ",").alias("bands"))


@query(
    "resolve_needed_bands",
    f"""WITH o AS ({_OFFERS.replace('{items}', 'items')}),
        need(role, names) AS (VALUES (0, ['B08','B8A']), (1, ['B04']), (2, ['B02'])),
        offer AS (SELECT item_id, offered, unnest(string_split(offered, ',')) AS band, generate_subscripts(string_split(offered, ','), 1) AS pos FROM o),
        hit AS (SELECT item_id, role, band, CASE WHEN list_contains(names, band) THEN 0 ELSE 1 END AS loose,
                       list_position(names, upper(band)) AS rank, pos FROM offer, need WHERE list_contains(names, upper(band)))
        SELECT item_id, role, band FROM (SELECT *, row_number() OVER (PARTITION BY item_id, role ORDER BY loose, rank, pos) AS rn FROM hit) WHERE rn = 1
        UNION ALL SELECT item_id, NULL, band FROM offer WHERE item_id NOT IN (SELECT item_id FROM hit)""",
    ("items",),
)
def _(i: Inputs):
    return bands.resolve_needed_bands(_offers(i), "evi")


@query(
    "band_lookup",
    f"""WITH o AS ({_OFFERS.replace('{items}', 'items')}),
        offer AS (SELECT item_id, unnest(string_split(offered, ',')) AS band, generate_subscripts(string_split(offered, ','), 1) AS pos FROM o),
        want(target, alts) AS (VALUES ('B08', ['B8A','nir','NIR']), ('B04', ['red','RED']), ('SCL', [])),
        hit AS (SELECT item_id, target, band, CASE WHEN band = target THEN 0 WHEN upper(band) = target THEN 1 ELSE 1 + list_position(alts, band) END AS rank, pos
                FROM offer, want WHERE upper(band) = target OR list_contains(alts, band))
        SELECT item_id, target, band FROM (SELECT *, row_number() OVER (PARTITION BY item_id, target ORDER BY rank, pos) AS rn FROM hit) WHERE rn = 1""",
    ("items",),
)
def _(i: Inputs):
    return bands.band_lookup(_offers(i), ["B08", "B04", "SCL"])


@query(
    "band_common_names",
    """SELECT scene, band, CASE band WHEN 'B02' THEN 'blue' WHEN 'B03' THEN 'green' WHEN 'B04' THEN 'red' WHEN 'B08' THEN 'nir'
              WHEN 'B8A' THEN 'nir08' WHEN 'B11' THEN 'swir16' WHEN 'SCL' THEN 'scl' WHEN 'B12' THEN 'swir22' END AS common_name,
              count(*) AS pixels FROM pixels GROUP BY ALL""",
    ("pixels",),
)
def _(i: Inputs):
    tiles = i.tiles.withColumn("collection", F.lit("sentinel-2-l2a"))
    named = bands.band_common_names(tiles)
    return named.groupBy("scene", "band", "common_name").agg(F.sum(F.size("pixels").cast("bigint")).alias("pixels"))


@query(
    "filter_bands",
    "SELECT scene, band, count(*) AS pixels, CAST(sum(dn) AS BIGINT) AS total FROM pixels WHERE band IN ('B04','B08') GROUP BY scene, band",
    ("pixels",),
)
def _(i: Inputs):
    kept = bands.filter_bands(i.tiles, ["B04", "B08"])
    total = F.aggregate("pixels", F.lit(0).cast("bigint"), lambda acc, v: acc + v)
    return kept.groupBy("scene", "band").agg(F.sum(F.size("pixels").cast("bigint")).alias("pixels"), F.sum(total).alias("total"))


@query(
    "dedup_first",
    "SELECT c_name AS id, min(c_custkey) AS seq FROM (SELECT c_mktsegment AS c_name, c_custkey FROM customer UNION ALL SELECT concat('S', c_nationkey), c_custkey FROM customer) GROUP BY c_name",
)
def _(i: Inputs):
    by_segment = i.customer.select(F.col("c_mktsegment").alias("id"), F.col("c_custkey").alias("seq"))
    by_nation = i.customer.select(F.concat(F.lit("S"), F.col("c_nationkey").cast("string")).alias("id"), F.col("c_custkey").alias("seq"))
    return search.dedup_first(by_segment.unionByName(by_nation), "id", "seq")


@query(
    "sink_items_upsert",
    f"""SELECT id, CASE WHEN width = 1830 THEN 'reprocessed' ELSE collection END AS collection, datetime FROM items
        UNION ALL SELECT concat('new-', CAST(c_custkey AS STRING)), 'fresh', '2024-01-01T00:00:00Z' FROM customer""",
    ("items",),
)
def _(i: Inputs):
    stored = i.items.select("id", "collection", "datetime").withColumn("version", F.lit(0).cast("bigint"))
    changed = i.items.filter("width = 1830")
    updates = changed.select("id", F.lit("draft").alias("collection"), "datetime", F.lit(1).cast("bigint").alias("version"))
    updates = updates.unionByName(
        changed.select("id", F.lit("reprocessed").alias("collection"), "datetime", F.lit(2).cast("bigint").alias("version"))
    ).unionByName(
        i.customer.select(
            F.concat(F.lit("new-"), F.col("c_custkey").cast("string")).alias("id"), F.lit("fresh").alias("collection"),
            F.lit("2024-01-01T00:00:00Z").alias("datetime"), F.lit(1).cast("bigint").alias("version"),
        )
    )
    items, _ = sinks.sink_items_upsert(stored, updates)
    return items.drop("version")


@query("sink_items_upsert_collections", "SELECT id FROM collections UNION SELECT 'fresh'", ("collections",))
def _(i: Inputs):
    stored = i.items.select("id", "collection").withColumn("version", F.lit(0).cast("bigint"))
    updates = i.customer.select(
        F.concat(F.lit("new-"), F.col("c_custkey").cast("string")).alias("id"), F.lit("fresh").alias("collection"), F.lit(1).cast("bigint").alias("version")
    )
    return sinks.sink_items_upsert(stored, updates, i.collections)[1]
