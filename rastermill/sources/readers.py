"""Readers that turn stored or exchanged documents into typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastermill.operators.bands import asset_key

PROPERTIES = {
    "datetime": "string", "crs": "string", "width": "int", "height": "int", "bands": "int", "band_names": "array<string>",
    "dtype": "string", "tile_size": "int", "tile_cols": "int", "tile_rows": "int", "source_file": "string", "chunk_format": "string",
}
AUDIT = "ts string, action string, detail string, ip string, ok boolean, _bad string"
# Names of the attributes that tell a product's type and mission, and the cloud cover of a product that tells none.
TYPE_ATTRIBUTE, MISSION_ATTRIBUTE, NO_COVER = "productType", "platformShortName", -1.0
BOX = ("west", "south", "east", "north")
STAC_PRODUCT = (
    "id string, collection string, bbox array<double>, geometry string, assets map<string,struct<href:string>>, "
    "properties struct<datetime:string,`eo:cloud_cover`:double>"
)
PRODUCT = (
    "struct<Id:string,Name:string,ContentDate:struct<Start:string>,ContentLength:bigint,Online:boolean,"
    "GeoFootprint:string,Attributes:array<struct<Name:string,Value:string>>>"
)


def chunk_hashes(json: str | Column) -> Column:
    """Hash lists per band from JSON; a plain list becomes ``{'*': [...]}``."""
    col = F.col(json) if isinstance(json, str) else json
    listed = F.from_json(col, "array<string>")
    return F.when(F.startswith(F.ltrim(col), F.lit("[")), F.create_map(F.lit("*"), listed)).otherwise(
        F.from_json(col, "map<string,array<string>>")
    )


def _properties(json: Column, prefix: str) -> tuple[Column, Column]:
    """Typed properties, with or without ``prefix`` before their names, and the others as name -> variant."""
    named = F.from_json(json, "map<string,string>")
    fields = []
    for name, kind in PROPERTIES.items():
        text = F.coalesce(named[prefix + name], named[name])
        fields.append((F.from_json(text, kind) if kind.startswith("array") else text.try_cast(kind)).alias(name))
    known = [*PROPERTIES, *(prefix + name for name in PROPERTIES), "chunk_hashes", prefix + "chunk_hashes"]
    others = F.map_filter(F.from_json(json, "map<string,variant>"), lambda k, _: ~k.isin(*known))
    return F.when(json.isNotNull(), F.struct(*fields)), others


def decode_items(rows: DataFrame, prefix: str = "grid:") -> DataFrame:
    """Catalogue rows with JSON text columns as typed rows; unlisted properties are kept in ``other_properties``."""
    properties, others = _properties(F.col("properties_json"), prefix)
    return rows.withColumns(
        {
            "properties": properties,
            "other_properties": others,
            "chunk_hashes": chunk_hashes("chunk_hashes_json"),
            "dt": F.try_to_timestamp("datetime"),
        }
    ).drop("properties_json", "chunk_hashes_json")


def src_items(spark: SparkSession, path: str, prefix: str = "grid:") -> DataFrame:
    return decode_items(spark.read.parquet(path), prefix)


def decode_stac(features: DataFrame, prefix: str = "grid:") -> DataFrame:
    """STAC Feature JSON (column ``value``) as item rows; hashes may sit on top or in the properties.

    ``geometry`` and ``assets`` stay JSON text; ``other_properties`` holds what ``properties`` has no field for.
    """
    # nested objects typed as string keep their JSON text
    hashes = "chunk_hashes string" + f", `{prefix}chunk_hashes` string" * bool(prefix)
    top = F.from_json(
        F.col("value"), f"id string, collection string, bbox array<double>, properties string, geometry string, assets string, {hashes}"
    )

    def held(found: str) -> Column:
        return F.coalesce(F.col(f"{found}.`{prefix}chunk_hashes`"), F.col(f"{found}.chunk_hashes"))

    opened = features.select(top.alias("t")).withColumn("i", F.from_json("t.properties", hashes))
    properties, others = _properties(F.col("t.properties"), prefix)
    parsed = opened.select(
        "t.id", "t.collection", "t.bbox", "t.geometry", "t.assets", held("t").alias("chunk_hashes"), held("i").alias("inner"),
        properties.alias("p"), others.alias("other_properties"),
    )
    corners = [F.get("bbox", F.lit(k)).alias(f"bbox_{name}") for k, name in enumerate(("west", "south", "east", "north"))]
    return parsed.select(
        "id", "collection", *corners, F.coalesce("p.datetime", F.lit("")).alias("datetime"), F.col("p").alias("properties"),
        F.coalesce(chunk_hashes(F.coalesce("chunk_hashes", "inner")), F.create_map().cast("map<string,array<string>>")).alias("chunk_hashes"),
        "geometry", "assets", "other_properties",
    )


def src_stac_json(spark: SparkSession, path: str, prefix: str = "grid:") -> DataFrame:
    return decode_stac(spark.read.text(path), prefix)


def src_raw_tiles(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Bytes of the wanted hashes; hashes that are not stored give no row."""
    return chunks.join(wanted.select("sha").distinct(), "sha", "left_semi")


def read_chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """A folder of files named by their hash, as chunk rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.filter(F.length(name) == 64).select(
        name.alias("sha"), F.col("content").alias("data"), F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime")
    )


def decode_products(listing: DataFrame) -> DataFrame:
    """Upstream product JSON (column ``value``): facts from the attribute list, the box from the footprint, as ``product_search`` reads them."""
    p = F.from_json("value", PRODUCT)

    def attribute(name: str) -> Column:
        return F.get(F.filter(p["Attributes"], lambda a: a["Name"] == name), F.lit(0))["Value"]

    box = footprint_box(p["GeoFootprint"])
    return listing.select(
        p["Id"].alias("id"),
        p["Id"].alias("product_id"),
        p["Name"].alias("name"),
        F.coalesce(p["ContentDate"]["Start"], F.lit("")).alias("date"),
        F.bround(F.coalesce(p["ContentLength"], F.lit(0)) / 1024 / 1024, 1).alias("size_mb"),
        attribute("cloudCover").cast("double").alias("cloud_cover"),
        F.coalesce(p["Online"], F.lit(True)).alias("online"),
        attribute(TYPE_ATTRIBUTE).alias("product_type"),
        F.upper(attribute(MISSION_ATTRIBUTE)).alias("collection"),
        *[box[c].alias(c) for c in BOX],
    )


def footprint_box(footprint: Column) -> Column:
    """Struct (west, south, east, north) around a GeoJSON polygon or multi-polygon given as text; null where it is neither."""
    kind = F.get_json_object(footprint, "$.type")
    at = F.get_json_object(footprint, "$.coordinates")
    rings = F.when(kind == "Polygon", F.from_json(at, "array<array<array<double>>>")).when(
        kind == "MultiPolygon", F.flatten(F.from_json(at, "array<array<array<array<double>>>>"))
    )
    points = F.flatten(rings)
    x = F.transform(points, lambda p: F.get(p, F.lit(0)))
    y = F.transform(points, lambda p: F.get(p, F.lit(1)))
    return F.when(F.size(points) > 0, F.struct(F.array_min(x).alias("west"), F.array_min(y).alias("south"), F.array_max(x).alias("east"), F.array_max(y).alias("north")))


def decode_stac_products(features: DataFrame, missions: dict[str, str] | None = None) -> DataFrame:
    """STAC Features of an open archive (column ``value``) in the columns of ``decode_products``, with ``assets`` (key -> address).

    ``missions`` names the upstream collection of a STAC collection. The box is the feature's own, else that of its footprint. A
    feature that tells no cloud cover has -1; its size and type are not known.
    """
    f = F.from_json("value", STAC_PRODUCT)
    names = F.create_map(*[F.lit(x) for kv in (missions or {}).items() for x in kv]).cast("map<string,string>")
    shape = footprint_box(f["geometry"])
    box = [F.coalesce(F.when(F.size(f["bbox"]) == 4, F.get(f["bbox"], F.lit(k))), shape[c]).alias(c) for k, c in enumerate(BOX)]
    return features.select(
        f["id"].alias("id"), f["id"].alias("product_id"), f["id"].alias("name"), F.coalesce(f["properties"]["datetime"], F.lit("")).alias("date"),
        F.lit(None).cast("double").alias("size_mb"), F.coalesce(f["properties"]["eo:cloud_cover"], F.lit(NO_COVER)).alias("cloud_cover"), F.lit(True).alias("online"),
        F.lit(None).cast("string").alias("product_type"), F.coalesce(F.element_at(names, F.lower(f["collection"])), F.upper(f["collection"])).alias("collection"),
        *box, F.transform_values(f["assets"], lambda _, a: a["href"]).alias("assets"),
    )


def product_assets(products: DataFrame, bands: list[str]) -> DataFrame:
    """(product_id, band, href) of each wanted band that a product of the open archive offers."""
    wanted = products.select("product_id", "assets", F.explode(F.array(*map(F.lit, bands))).alias("band"))
    return wanted.select("product_id", "band", F.element_at("assets", asset_key("band")).alias("href")).filter("href IS NOT NULL")


def src_products(spark: SparkSession, path: str, stac: bool = False, missions: dict[str, str] | None = None) -> DataFrame:
    """A product listing, one JSON document a line: of the upstream catalogue, or with ``stac`` of the open archive."""
    lines = spark.read.text(path)
    return decode_stac_products(lines, missions) if stac else decode_products(lines)


def decode_audit(lines: DataFrame) -> DataFrame:
    """Audit lines (column ``value``); lines that are not JSON are left out."""
    entry = F.from_json("value", AUDIT, {"columnNameOfCorruptRecord": "_bad"})
    return lines.select(entry.alias("e")).filter(F.col("e._bad").isNull()).select("e.ts", "e.action", "e.detail", "e.ip", "e.ok")


def src_audit(spark: SparkSession, path: str, limit: int = 50) -> DataFrame:
    """The newest ``limit`` audit entries."""
    return tail_audit(decode_audit(spark.read.text(path)), limit)


def tail_audit(entries: DataFrame, limit: int = 50) -> DataFrame:
    return entries.orderBy(F.col("ts").desc(), "action", "detail").limit(limit)
