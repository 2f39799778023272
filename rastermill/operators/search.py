"""Catalogue search, look-ups and product selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rastermill.functions.times import moment, normalise_end
from rastermill.plans.gridjoin import overlap_join
from rastermill.plans.lookup import salted_join
from rastermill.plans.ordered import running_sum
from rastermill.plans.pick import first_per_key
from rastermill.session import pin

# Logical collection -> upstream collection, and the fall-back.
UPSTREAM_COLLECTIONS = {
    "sentinel-2-l2a": "SENTINEL-2",
    "sentinel-2-l1c": "SENTINEL-2",
    "sentinel-1-grd": "SENTINEL-1",
    "sentinel-3-lst": "SENTINEL-3",
    "sentinel-3-olci": "SENTINEL-3",
    "sentinel-5p": "SENTINEL-5P",
}
UPSTREAM_DEFAULT = "SENTINEL-2"
WORLD = (-180.0, -90.0, 180.0, 90.0)


def search_collections(items: DataFrame, ids: list[str] | None) -> DataFrame:
    return items.filter(F.col("collection").isin(list(ids))) if ids else items


def search_bbox(items: DataFrame, bbox: list[float] | None) -> DataFrame:
    """Boxes that overlap or touch; anything but four numbers means no filter."""
    if not bbox or len(bbox) != 4:
        return items
    w, s, e, n = bbox
    return items.filter(
        (F.col("bbox_east") >= w) & (F.col("bbox_west") <= e) & (F.col("bbox_north") >= s) & (F.col("bbox_south") <= n)
    )


def search_bbox_strict(items: DataFrame, bbox: list[float]) -> DataFrame:
    """Boxes that share more than an edge."""
    w, s, e, n = bbox
    return items.filter(
        (F.col("bbox_west") < e) & (F.col("bbox_east") > w) & (F.col("bbox_south") < n) & (F.col("bbox_north") > s)
    )


def search_datetime(items: DataFrame, expression: str | None) -> DataFrame:
    """``start/end`` with ``..`` or nothing for an open end, else an exact time. Compared as text."""
    if not expression:
        return items
    parts = expression.split("/")
    if len(parts) != 2:
        return items.filter(F.col("datetime") == expression)
    start, end = parts
    if start and start != "..":
        items = items.filter(F.col("datetime") >= start)
    if end and end != "..":
        items = items.filter(F.col("datetime") <= end)
    return items


def latest_items(items: DataFrame, n: int) -> DataFrame:
    return items.orderBy(F.col("datetime").desc(), F.col("id")).limit(n)


def search_items(
    items: DataFrame,
    collections: list[str] | None = None,
    bbox: list[float] | None = None,
    datetime_range: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Matching items; with ``limit`` only the newest."""
    found = search_datetime(search_bbox(search_collections(items, collections), bbox), datetime_range)
    return found if limit is None else latest_items(found, limit)


def get_item(items: DataFrame, item_id: str) -> DataFrame:
    return items.filter(F.col("id") == item_id)


def get_collection(collections: DataFrame, collection_id: str) -> DataFrame:
    return collections.filter(F.col("id") == collection_id)


def list_collections(collections: DataFrame) -> DataFrame:
    """The collections table, whether or not a collection has items."""
    known = [c for c in ("id", "title", "description", "extent", "license") if c in collections.columns]
    return collections.select(*known)


def collections_of(items: DataFrame) -> DataFrame:
    """Ids of the collections that ``items`` name, for a catalogue without a collections table."""
    return items.select(F.col("collection").alias("id")).distinct()


def list_collection_items(items: DataFrame, collection_id: str) -> DataFrame:
    return items.filter(F.col("collection") == collection_id)


def delete_item(items: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remaining items, and per requested id whether it existed."""
    kept = items.join(ids.select("id"), "id", "left_anti")
    report = ids.select("id").distinct().join(
        items.select("id").withColumn("existed", F.lit(True)), "id", "left"
    ).withColumn("existed", F.coalesce("existed", F.lit(False)))
    return kept, report


def filter_spatial(cube: DataFrame, bbox: list[float]) -> DataFrame:
    """Pixels whose centre (lon, lat) lies in the box, ends included."""
    w, s, e, n = bbox
    return cube.filter(F.col("lon").between(w, e) & F.col("lat").between(s, n))


def filter_temporal(cube: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if start and start != "..":
        cube = cube.filter(F.col("datetime") >= start)
    if end and end != "..":
        cube = cube.filter(F.col("datetime") <= (end + "T23:59:59" if len(end) == 10 else end))
    return cube


def bbox_aliases(requests: DataFrame) -> DataFrame:
    """``xmin``-style corners stand in for missing compass corners, the world for missing boxes."""
    names = (("west", "xmin"), ("south", "ymin"), ("east", "xmax"), ("north", "ymax"))
    filled = {name: F.coalesce(name, alias, F.lit(world)) for (name, alias), world in zip(names, WORLD)}
    return requests.withColumns(filled).drop(*[alias for _, alias in names])


def collection_map(requests: DataFrame) -> DataFrame:
    pairs = [F.lit(text) for pair in UPSTREAM_COLLECTIONS.items() for text in pair]
    upstream = F.element_at(F.create_map(*pairs), F.lower("collection"))
    return requests.withColumn("upstream", F.coalesce(upstream, F.lit(UPSTREAM_DEFAULT)))


def alive_nodes(nodes: DataFrame, now_s: int, ttl_s: int = 300) -> DataFrame:
    """Nodes heard from less than ``ttl_s`` seconds ago (peers use 600)."""
    return nodes.filter(F.lit(now_s) - F.col("last_seen_s") < ttl_s)


def alive_peers(peers: DataFrame, now_s: int) -> DataFrame:
    return alive_nodes(peers, now_s, 600)


def nodes_for_collection(nodes: DataFrame, collection: str, now_s: int) -> DataFrame:
    return alive_nodes(nodes, now_s).filter(F.array_contains("collections", collection))


def seed_nodes(nodes: DataFrame, now_s: int) -> DataFrame:
    return alive_nodes(nodes, now_s).filter(F.col("url").isNotNull() & (F.col("url") != "") & (F.col("item_count") > 0))


def product_search(
    products: DataFrame,
    known: DataFrame,
    product_type: str | None = None,
    bbox: list[float] | None = None,
    start_date: str | None = None,
    end_date: str | None = None,
    cloud_cover: float | None = 30.0,
    limit: int | None = None,
    collection: str | None = None,
) -> DataFrame:
    """Matching products that are not in ``known`` (column ``product_id``); with ``limit`` only the newest.

    ``collection`` is a logical collection; products carry the upstream one it maps to.
    """
    found = products
    if collection:
        found = found.filter(F.col("collection") == UPSTREAM_COLLECTIONS.get(collection.lower(), UPSTREAM_DEFAULT))
    if product_type:
        found = found.filter(F.col("product_type") == product_type)
    if bbox:
        w, s, e, n = bbox
        found = found.filter(
            (F.col("east") >= w) & (F.col("west") <= e) & (F.col("north") >= s) & (F.col("south") <= n)
        )
    if start_date:
        found = found.filter(F.col("date") >= start_date + "T00:00:00.000Z")
    if end_date:
        found = found.filter(F.col("date") <= end_date + "T23:59:59.999Z")
    if cloud_cover is not None:
        found = found.filter(F.col("cloud_cover") <= cloud_cover)
    found = found.join(known.select("product_id"), "product_id", "left_anti")
    return found if limit is None else found.orderBy(F.col("date").desc(), "product_id").limit(limit)


def batch_bbox_search(
    requests: DataFrame, items: DataFrame, cell_deg: float = 1.0, same_collection: bool = False, carry: tuple[str, ...] = (),
    same: tuple[str, ...] = (),
) -> DataFrame:
    """All (request, item) pairs whose boxes overlap; with ``same_collection`` they must also agree on it, and on the columns ``same``.

    ``carry`` names item columns to keep beside each pair.
    """
    also_on = (("collection",) if same_collection else ()) + same
    extra = [c for c in ("date_from", "date_to") if c in requests.columns]
    areas = requests.select(
        "request_id", *also_on, *extra, F.col("west").alias("aw"), F.col("south").alias("as"),
        F.col("east").alias("ae"), F.col("north").alias("an"),
    )
    boxes = items.select(
        F.col("id").alias("item_id"), "datetime", *also_on, *carry, F.col("bbox_west").alias("iw"), F.col("bbox_south").alias("is"),
        F.col("bbox_east").alias("ie"), F.col("bbox_north").alias("in"),
    )
    pairs = overlap_join(areas, boxes, cell_deg, also_on)
    return pairs.select("request_id", "item_id", "datetime", *extra, *carry)


def open_period(requests: DataFrame) -> DataFrame:
    """Fill open ends (null, empty or ``..``) of date_from and date_to; a date-only end covers its day."""

    def given(name: str):
        return F.when(~F.col(name).isin("", ".."), F.col(name))

    return requests.withColumns(
        {
            "date_from": F.coalesce(given("date_from"), F.lit("")),
            "date_to": F.coalesce(normalise_end(given("date_to")), F.lit("9999-12-31T23:59:59.999999Z")),
        }
    )


def search_fallback(requests: DataFrame, items: DataFrame, limit: int) -> DataFrame:
    """Per request (request_id, item_id, step): step 0 box and period, 1 period only, 2 collection only.

    A later step is used only when the earlier one finds nothing; steps 1 and 2 return the newest ``limit`` items.

    Items are put into one order, newest first within their collection, together with a mark where each open request's period
    ends. Counting items along that order gives an item its place and a request the place its list starts at: the
    item there tells whether the period holds any, and the list is looked up by blocks of ``limit`` places, two a request.
    """
    requests = open_period(requests)
    in_period = (F.col("datetime") >= F.col("date_from")) & (F.col("datetime") <= F.col("date_to"))
    # a request looks into the years of its period only: texts in order have their beginnings in order
    year = lambda name: F.substring(name, 1, 4)
    years = items.select(F.collect_set(year("datetime"))).scalar()
    own_years = F.filter("_years", lambda y: (y >= year("date_from")) & (y <= year("date_to")))
    by_year = requests.withColumn("_years", years).withColumn("_year", F.explode(own_years)).drop("_years")
    near = batch_bbox_search(by_year, items.withColumn("_year", year("datetime")), same_collection=True, same=("_year",))
    exact = pin(near.filter(in_period).select("request_id", "item_id"))
    # one row per answered request, combined on the map side: a request may match most items
    open_requests = requests.join(exact.filter("item_id IS NOT NULL").select("request_id").distinct(), "request_id", "left_anti")

    listed = items.select("collection", "datetime", F.col("id").alias("item_id"), F.lit(1).cast("bigint").alias("_item"))
    marks = open_requests.select("collection", F.col("date_to").alias("datetime"), F.lit(0).cast("bigint").alias("_item"), "request_id", "date_from")
    rows = listed.unionByName(marks, allowMissingColumns=True).filter(F.col("collection").isNotNull())
    # a mark stands before the items of its own instant, which are in its period
    order = [F.col("collection"), F.col("datetime").desc(), F.col("_item"), F.col("item_id"), F.col("request_id")]
    placed = pin(running_sum(rows, order, "_item", "_place"))
    known = placed.filter(F.col("_item") == 1).select("collection", "datetime", "item_id", (F.col("_place") - 1).alias("_place"))
    asked = placed.filter(F.col("_item") == 0).select("request_id", "collection", "date_from", F.col("_place").alias("_from"))

    newest = known.select(F.col("collection").alias("_c"), F.col("datetime").alias("_newest"), F.col("_place").alias("_from"))
    asked = asked.join(newest, "_from", "left")
    found = F.coalesce((F.col("_c") == F.col("collection")) & (F.col("_newest") >= F.col("date_from")), F.lit(False))
    asked = asked.select("request_id", "collection", "date_from", "_from", found.alias("_found"))

    block = F.floor(F.col("_place") / limit).alias("_block")
    two = F.explode(F.array(F.floor(F.col("_from") / limit), F.floor(F.col("_from") / limit) + 1)).alias("_block")
    lists = asked.filter("_found").select("request_id", "collection", "date_from", "_from", two)
    by_period = lists.join(known.select("*", block), ["collection", "_block"]).filter(
        (F.col("_place") >= F.col("_from")) & (F.col("_place") < F.col("_from") + limit) & (F.col("datetime") >= F.col("date_from"))
    )
    by_period = by_period.select("request_id", "item_id", F.lit(1).alias("step"))

    # the newest items of each collection: the limit is applied before rows move; at most ``limit`` ids a row
    first = Window.partitionBy("collection").orderBy("_place")
    ranked = known.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= limit)
    ids = ranked.groupBy("collection").agg(F.collect_list("item_id").alias("ids"))
    anything = salted_join(asked.filter(~F.col("_found")), ids, "collection", "request_id").select(
        "request_id", F.explode("ids").alias("item_id"), F.lit(2).alias("step")
    )
    return exact.withColumn("step", F.lit(0)).unionByName(by_period).unionByName(anything)


def recent_window(log: DataFrame, now: str, hours: float) -> DataFrame:
    """Log rows later than ``hours`` before ``now``."""
    return log.filter(F.col("ts") > moment(now, hours))


def dedup_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    return first_per_key(rows, [key], order)
