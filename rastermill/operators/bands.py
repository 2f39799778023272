"""Choosing bands by name, alias and operation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The bands each operation loads, by role, first choice first.
OPERATION_BANDS = {
    "ndvi": [["B08", "B8A"], ["B04"]],
    "ndwi": [["B03"], ["B08", "B8A"]],
    "ndsi": [["B03"], ["B11"]],
    "evi": [["B08", "B8A"], ["B04"], ["B02"]],
    "cloud_mask": [["SCL"]],
    "true_color": [["B04"], ["B03"], ["B02"]],
    "band_math": None,
}

# Names an index accepts for a role, first choice first.
ROLE_NAMES = {
    "nir": ["B08", "B8A", "nir", "NIR", "B05"],
    "red": ["B04", "red", "RED", "B03"],
    "green": ["B03", "green", "GREEN", "B02"],
    "ndsi_green": ["B03", "green", "GREEN"],
    "swir": ["B11", "swir16", "SWIR1", "B06"],
    "evi_nir": ["B08", "B8A", "nir"],
    "evi_red": ["B04", "red"],
    "evi_blue": ["B02", "blue"],
    "rgb_red": ["B04", "red", "RED"],
    "rgb_green": ["B03", "green", "GREEN"],
    "rgb_blue": ["B02", "blue", "BLUE"],
    "scl": ["SCL", "scl", "scene_classification"],
}

# Stand-ins tried when a requested band is absent.
BAND_STAND_INS = {"B08": ["B8A", "nir", "NIR"], "B04": ["red", "RED"]}

# Common names per collection.
COMMON_NAMES = {
    "sentinel-2-l2a": {
        "B01": "coastal", "B02": "blue", "B03": "green", "B04": "red", "B05": "rededge", "B06": "rededge",
        "B07": "rededge", "B08": "nir", "B8A": "nir08", "B09": "nir09", "B11": "swir16", "B12": "swir22", "SCL": "scl",
    },
    "sentinel-2-l1c": {
        "B01": "coastal", "B02": "blue", "B03": "green", "B04": "red", "B05": "rededge", "B06": "rededge",
        "B07": "rededge", "B08": "nir", "B8A": "nir08", "B09": "nir09", "B10": "cirrus", "B11": "swir16", "B12": "swir22",
    },
}

# Asset keys of the open STAC archive per Sentinel-2 band.
ASSET_KEYS = {
    "B01": "coastal", "B02": "blue", "B03": "green", "B04": "red", "B05": "rededge1", "B06": "rededge2",
    "B07": "rededge3", "B08": "nir", "B8A": "nir08", "B09": "nir09", "B11": "swir16", "B12": "swir22", "SCL": "scl",
}


def _first_match(available: Column, names: list[str]) -> Column:
    """First of ``names`` present in the array ``available`` exactly, else ignoring case."""
    wanted = F.array(*[F.lit(n) for n in names])
    exact = F.get(F.filter(wanted, lambda n: F.array_contains(available, n)), F.lit(0))
    loose = F.flatten(F.transform(wanted, lambda n: F.filter(available, lambda b: F.upper(b) == F.upper(n))))
    return F.coalesce(exact, F.get(loose, F.lit(0)))


def resolve_needed_bands(items: DataFrame, operation: str) -> DataFrame:
    """(item_id, role, band) to load per item; every band with a null role when nothing fits.

    ``items`` has ``item_id`` and ``bands`` (array of names). The choice is
    made inside each row, so nothing is shuffled.
    """
    groups = OPERATION_BANDS.get(operation)
    everything = F.transform("bands", lambda b: F.struct(F.lit(None).cast("int").alias("role"), b.alias("band")))
    if groups is None:
        chosen = everything
    else:
        picks = F.array(
            *[
                F.struct(F.lit(role).alias("role"), _first_match(F.col("bands"), names).alias("band"))
                for role, names in enumerate(groups)
            ]
        )
        picks = F.filter(picks, lambda p: p["band"].isNotNull())
        chosen = F.when(F.size(picks) > 0, picks).otherwise(everything)
    return items.select("item_id", F.inline(chosen))


def band_lookup(items: DataFrame, targets: list[str]) -> DataFrame:
    """(item_id, target, band): exact name, then any case, then a stand-in."""
    found = F.array(
        *[
            F.struct(
                F.lit(t).alias("target"),
                F.coalesce(
                    _first_match(F.col("bands"), [t]),
                    F.get(
                        F.filter(
                            F.array(*[F.lit(a) for a in BAND_STAND_INS.get(t, [])]).cast("array<string>"),
                            lambda a: F.array_contains("bands", a),
                        ),
                        F.lit(0),
                    ),
                ).alias("band"),
            )
            for t in targets
        ]
    )
    return items.select("item_id", F.inline(F.filter(found, lambda f: f["band"].isNotNull())))


def _nested_map(table: dict[str, dict[str, str]]) -> Column:
    def flat(d):
        return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])

    return F.create_map(*[x for key, inner in table.items() for x in (F.lit(key), flat(inner))])


def band_common_names(cube: DataFrame) -> DataFrame:
    """Add ``common_name`` for the row's collection and band (null when it has none)."""
    per_collection = F.element_at(_nested_map(COMMON_NAMES), F.lower("collection"))
    return cube.withColumn("common_name", F.element_at(per_collection, F.col("band")))


def asset_key(band: str | Column) -> Column:
    col = F.col(band) if isinstance(band, str) else band
    keys = F.create_map(*[F.lit(x) for kv in ASSET_KEYS.items() for x in kv])
    return F.coalesce(F.element_at(keys, col), F.lower(col))


def filter_bands(cube: DataFrame, bands: list[str]) -> DataFrame:
    """Keep named bands; on a table partitioned by band this prunes files."""
    return cube.filter(F.col("band").isin(list(bands)))
