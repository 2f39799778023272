"""Band names, scene keys and display texts derived from strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band names, their search order and the name patterns used in archives.
S2_BANDS = ["B01", "B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B09", "B11", "B12", "SCL"]
TCI_BANDS = ["B04", "B03", "B02"]
LANDSAT_BANDS = ["SR_B1", "SR_B2", "SR_B3", "SR_B4", "SR_B5", "SR_B6", "SR_B7"]
BAND_AT_END = r"_(B\w+?)(?:_\d+m)?$"
TCI_AT_END = r"_(TCI)(?:_\d+m)?$"
MGRS_TILE = r"(T\d{2}[A-Z]{3})"
DATE_DIGITS = r"(\d{8})"
SIZE_UNITS = ["B", "KB", "MB", "GB", "TB", "PB", "EB"]


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _group(column: str | Column, pattern: str) -> Column:
    """First capture group, null when the pattern does not occur."""
    return F.nullif(F.regexp_extract(column, pattern, 1), F.lit(""))


def band_from_filename(name: str | Column, n_bands: str | Column) -> Column:
    """Band names of a raster file, from its name or numbered when the name says nothing."""
    col = F.col(name) if isinstance(name, str) else name
    n = F.col(n_bands) if isinstance(n_bands, str) else n_bands
    upper = F.upper(col)
    inside = F.filter(_strings(S2_BANDS), lambda b: F.contains(upper, b))
    landsat = F.filter(_strings(LANDSAT_BANDS), lambda b: F.contains(upper, b))
    numbered = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("B"), F.when(i < 10, F.lpad(i.cast("string"), 2, "0")).otherwise(i.cast("string"))))
    numbered = F.when(n < 1, F.array().cast("array<string>")).otherwise(numbered)
    return (
        F.when((n == 1) & (F.size(inside) > 0), F.slice(inside, 1, 1))
        .when((n == 3) & F.contains(upper, F.lit("TCI")), _strings(TCI_BANDS))
        .when((n == 1) & (F.size(landsat) > 0), F.slice(landsat, 1, 1))
        .otherwise(numbered)
    )


def band_from_item_id(item_id: str | Column, band_names: str | Column | None = None) -> Column:
    """Band of a single-band item: its only declared band, else the end of its id."""
    named = F.coalesce(_group(item_id, BAND_AT_END), _group(item_id, TCI_AT_END))
    if band_names is None:
        return named
    declared = F.col(band_names) if isinstance(band_names, str) else band_names
    return F.coalesce(F.when(F.size(declared) == 1, F.get(declared, F.lit(0))), named)


def scene_key(item_id: str | Column) -> Column:
    """Tile and date of a scene as ``T32TPT_20240709``; null when either is absent."""
    tile, date = _group(item_id, MGRS_TILE), _group(item_id, DATE_DIGITS)
    return F.when(tile.isNotNull() & date.isNotNull(), F.concat_ws("_", tile, date))


def human_bytes(size: str | Column) -> Column:
    """Byte count in steps of 1024 with one decimal."""
    col = (F.col(size) if isinstance(size, str) else size).cast("double")
    pick = F.lit(None).cast("string")
    for power in range(len(SIZE_UNITS) - 1, -1, -1):
        shown = F.format_string(f"%.1f {SIZE_UNITS[power]}", F.bround(col / F.lit(float(1024**power)), 1))
        last = power == len(SIZE_UNITS) - 1
        pick = shown if last else F.when(col < F.lit(float(1024 ** (power + 1))), shown).otherwise(pick)
    return pick


def sensor_label(collection: str | Column) -> Column:
    """Display name of a collection, e.g. ``sentinel-2-l2a`` as ``Sentinel-2 L2A``."""
    col = F.col(collection) if isinstance(collection, str) else collection
    base = F.regexp_replace(col, "_derived$", "")
    sentinel, landsat = r"(?i)^(.*?)sentinel-(\d+)-(.+)", r"(?i)^(.*?)landsat-(.+)"

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(base, pattern, group)

    return (
        F.when(
            part(sentinel, 3) != "",
            F.concat(part(sentinel, 1), F.lit("Sentinel-"), part(sentinel, 2), F.lit(" "), F.upper(part(sentinel, 3))),
        )
        .when(part(landsat, 2) != "", F.concat(part(landsat, 1), F.lit("Landsat "), F.upper(part(landsat, 2))))
        .otherwise(base)
    )
