"""Spectral indices and band math on a pixel cube.

A cube has one row per pixel, key columns and one column per band. Everything
here is a column expression, so it stays inside generated code and needs no
shuffle. Arithmetic is done in float32 steps, as the indices are defined.
"""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastermill.operators.bands import BAND_STAND_INS, ROLE_NAMES

KEYS = ("request_id", "item_id", "scene", "datetime", "tile_row", "tile_col", "y", "x", "lon", "lat")

# Weights of the enhanced vegetation index, cloud classes.
EVI_GAIN, EVI_RED, EVI_BLUE, EVI_OFFSET = 2.5, 6.0, 7.5, 1.0
CLOUD_CLASSES = (8, 9, 10)


def pair_bands(tiles: DataFrame, keys: list[str], bands: list[str], value: str = "pixels", order: str | None = None) -> DataFrame:
    """One row per key with a column per band; the row with the highest ``order`` wins a band.

    Works on tiles (``value`` is the pixel list, one row moves per tile) and on
    single pixels. A key meets at most one row per band after map-side combine.
    """
    picks = []
    for band in bands:
        mine = F.col("band") == band
        if order:
            picks.append(F.max_by(F.when(mine, F.col(value)), F.when(mine, F.col(order))).alias(band))
        else:
            picks.append(F.first(F.when(mine, F.col(value)), ignorenulls=True).alias(band))
    return tiles.filter(F.col("band").isin(list(bands))).groupBy(*keys).agg(*picks)


def cube_from_tiles(wide: DataFrame, keys: list[str], bands: list[str], width: int | str = "w") -> DataFrame:
    """Pixel cube from paired tiles: every pixel position becomes a row."""
    w = F.lit(width) if isinstance(width, int) else F.col(width)
    have = set(wide.columns)
    y0 = F.col("y_off") if "y_off" in have else F.lit(0)
    x0 = F.col("x_off") if "x_off" in have else F.lit(0)
    # a band the key lacks becomes null pixels, it does not drop the others
    zipped = F.arrays_zip(*[F.coalesce(F.col(b), F.array().cast(wide.schema[b].dataType)).alias(b) for b in bands])
    spread = wide.select(*keys, y0.alias("_y0"), x0.alias("_x0"), w.alias("_w"), F.posexplode(zipped).alias("_p", "_v"))
    return spread.select(
        *keys,
        (F.col("_y0") + F.floor(F.col("_p") / F.col("_w"))).cast("int").alias("y"),
        (F.col("_x0") + F.col("_p") % F.col("_w")).cast("int").alias("x"),
        *[F.col("_v")[b].alias(b) for b in bands],
    )


def find_band(cube: DataFrame, names: list[str]) -> Column:
    """First of ``names`` that the cube has, as float."""
    for name in names:
        if name in cube.columns:
            return F.col(name).cast("float")
    raise KeyError(f"need one of {names}, have {cube.columns}")


def find_band_loose(cube: DataFrame, target: str) -> Column:
    """The band of that name, in any case, or a stand-in."""
    for name in [target, *[c for c in cube.columns if c.upper() == target.upper()], *BAND_STAND_INS.get(target, [])]:
        if name in cube.columns:
            return F.col(name).cast("float")
    raise KeyError(f"band {target!r} not found, have {cube.columns}")


def _float(value: float) -> Column:
    return F.lit(value).cast("float")


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), 0 where the sum is 0."""
    return F.when(a + b == 0, _float(0.0)).otherwise(((a - b) / (a + b)).cast("float"))


def _result(cube: DataFrame, value: Column, name: str, target_band: str | None = None) -> DataFrame:
    if target_band:
        return cube.withColumn(target_band, value)
    return cube.select(*[k for k in KEYS if k in cube.columns], value.alias(name))


def vegetation_enhanced(n: Column, r: Column, b: Column) -> Column:
    below = n + _float(EVI_RED) * r - _float(EVI_BLUE) * b + _float(EVI_OFFSET)
    ratio = ((_float(EVI_GAIN) * (n - r)) / below).cast("float")
    return F.when(below == 0, _float(0.0)).otherwise(F.least(F.greatest(ratio, _float(-1.0)), _float(1.0)))


def clear_sky(scl: Column, classes: tuple[int, ...] = CLOUD_CLASSES) -> Column:
    return (~scl.cast("int").isin(*classes)).cast("float")


def without_gaps(v: Column) -> Column:
    """nan becomes 0, an infinite value 1 or -1."""
    inf = float("inf")
    # most values are finite, and nan is more than any number
    return F.when(F.abs(v) < F.lit(inf), v).when(F.isnan(v), _float(0.0)).when(v == F.lit(inf), _float(1.0)).when(v == F.lit(-inf), _float(-1.0))


def gateway_difference(a: Column, b: Column) -> Column:
    """Normalised difference without gaps, as result rasters carry it."""
    return without_gaps(normalized_difference(a, b))


def ndvi(cube: DataFrame, nir: str | None = None, red: str | None = None, target_band: str | None = None) -> DataFrame:
    """Vegetation index; with ``target_band`` it is added to the cube instead of replacing the bands."""
    n = find_band_loose(cube, nir) if nir else find_band(cube, ROLE_NAMES["nir"])
    r = find_band_loose(cube, red) if red else find_band(cube, ROLE_NAMES["red"])
    return _result(cube, normalized_difference(n, r), "ndvi", target_band)


def ndvi_gateway(cube: DataFrame, nir: str | None = None, red: str | None = None) -> DataFrame:
    """Vegetation index without gaps, as result rasters carry it: nan becomes 0, an infinite value 1 or -1."""
    return ndvi(cube, nir, red).withColumn("ndvi", without_gaps(F.col("ndvi")))


def ndwi(cube: DataFrame) -> DataFrame:
    value = normalized_difference(find_band(cube, ROLE_NAMES["green"]), find_band(cube, ROLE_NAMES["nir"]))
    return _result(cube, value, "ndwi")


def ndsi(cube: DataFrame) -> DataFrame:
    value = normalized_difference(find_band(cube, ROLE_NAMES["ndsi_green"]), find_band(cube, ROLE_NAMES["swir"]))
    return _result(cube, value, "ndsi")


def evi(cube: DataFrame) -> DataFrame:
    value = vegetation_enhanced(*(find_band(cube, ROLE_NAMES[f"evi_{role}"]) for role in ("nir", "red", "blue")))
    return _result(cube, value, "evi")


def cloud_mask(cube: DataFrame, classes: tuple[int, ...] = CLOUD_CLASSES) -> DataFrame:
    """1 where the scene class is clear, 0 where it is a cloud class."""
    return _result(cube, clear_sky(find_band(cube, ROLE_NAMES["scl"]), classes), "cloud_mask")


def true_color(cube: DataFrame) -> DataFrame:
    colours = {c: find_band(cube, ROLE_NAMES[f"rgb_{c}"]) for c in ("red", "green", "blue")}
    return cube.select(*[k for k in KEYS if k in cube.columns], *[v.alias(c) for c, v in colours.items()])


def stack_passthrough(cube: DataFrame, bands: list[str]) -> DataFrame:
    return cube.select(*[k for k in KEYS if k in cube.columns], *bands)


def apply_masked(cube: DataFrame, value: str, mask: str) -> DataFrame:
    """Keep ``value`` where ``mask`` is 1, null elsewhere."""
    return cube.withColumn(value, F.when(F.col(mask) == 1, F.col(value)))


def zonal_stats(cube: DataFrame, value: str, by: list[str]) -> DataFrame:
    v = F.col(value).cast("double")
    return cube.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max")
    )


# ---------------------------------------------------------------- band math


def _ieee_divide(a: Column, b: Column) -> Column:
    """Float division that yields inf and nan instead of failing on zero."""
    inf = F.lit(float("inf"))
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, inf).otherwise(-inf)
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b)).cast("float")


def _compare(test: Callable[[Column, Column], Column], on_nan: bool = False):
    def apply(a: Column, b: Column) -> Column:
        unordered = F.isnan(a) | F.isnan(b)
        return F.when(unordered, F.lit(on_nan)).otherwise(test(a, b))

    return apply


_BINARY = {
    ast.Add: lambda a, b: (a + b).cast("float"),
    ast.Sub: lambda a, b: (a - b).cast("float"),
    ast.Mult: lambda a, b: (a * b).cast("float"),
    ast.Div: _ieee_divide,
    ast.Pow: lambda a, b: F.pow(a, b).cast("float"),
}
_COMPARE = {
    ast.Gt: _compare(lambda a, b: a > b),
    ast.GtE: _compare(lambda a, b: a >= b),
    ast.Lt: _compare(lambda a, b: a < b),
    ast.LtE: _compare(lambda a, b: a <= b),
    ast.Eq: _compare(lambda a, b: a == b),
    ast.NotEq: _compare(lambda a, b: a != b, on_nan=True),
}
_LOGIC = {ast.BitAnd: lambda a, b: a & b, ast.BitOr: lambda a, b: a | b}


def _nan_through(pick: Callable[[Column, Column], Column]):
    return lambda a, b: F.when(F.isnan(a) | F.isnan(b), F.lit(float("nan"))).otherwise(pick(a, b)).cast("float")


_FUNCTIONS = {
    "abs": lambda a: F.abs(a),
    "sqrt": lambda a: F.when(a < 0, F.lit(float("nan"))).otherwise(F.sqrt(a)).cast("float"),
    "exp": lambda a: F.exp(a).cast("float"),
    "log": lambda a: F.when(a == 0, F.lit(float("-inf"))).when(a < 0, F.lit(float("nan"))).otherwise(F.log(a)).cast("float"),
    "log10": lambda a: F.when(a == 0, F.lit(float("-inf"))).when(a < 0, F.lit(float("nan"))).otherwise(F.log10(a)).cast("float"),
    "sin": lambda a: F.sin(a).cast("float"),
    "cos": lambda a: F.cos(a).cast("float"),
    "tan": lambda a: F.tan(a).cast("float"),
    "floor": lambda a: F.floor(a).cast("float"),
    "ceil": lambda a: F.ceil(a).cast("float"),
    "minimum": _nan_through(lambda a, b: F.least(a, b)),
    "maximum": _nan_through(lambda a, b: F.greatest(a, b)),
    "where": lambda test, a, b: F.when(test, a).otherwise(b),
    "clip": lambda a, low, high: F.when(F.isnan(a), a).otherwise(F.least(F.greatest(a, low), high)),
    "isnan": lambda a: F.isnan(a),
    "nan_to_num": lambda a: F.when(F.isnan(a), _float(0.0)).otherwise(a),
}


def band_expression(expression: str, bands: list[str], column: Callable[[str], Column] = F.col) -> Column:
    """Column for an expression over band names, numbers, operators and ``np.`` functions.

    Only listed syntax is accepted; anything else raises ValueError. ``column`` gives a band's values by its name.
    """
    if not expression:
        raise ValueError("band_math needs an expression")
    tree = ast.parse(expression, mode="eval").body
    used: set[str] = set()

    def build(node: ast.AST) -> Column:
        match node:
            case ast.Constant(value=bool()):
                raise ValueError("truth values are not band numbers")
            case ast.Constant(value=int() | float() as number):
                return _float(float(number))
            case ast.Name(id=name) if name in bands:
                used.add(name)
                return column(name).cast("float")
            case ast.UnaryOp(op=ast.USub(), operand=inner):
                return -build(inner)
            case ast.UnaryOp(op=ast.UAdd(), operand=inner):
                return build(inner)
            case ast.UnaryOp(op=ast.Invert(), operand=inner):
                return ~build(inner)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                return _BINARY[type(op)](build(a), build(b))
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _LOGIC:
                return _LOGIC[type(op)](build(a), build(b))
            case ast.Compare(left=a, ops=[op], comparators=[b]) if type(op) in _COMPARE:
                return _COMPARE[type(op)](build(a), build(b))
            case ast.Call(func=ast.Attribute(value=ast.Name(id="np"), attr=name), args=args, keywords=[]) if name in _FUNCTIONS:
                return _FUNCTIONS[name](*[build(a) for a in args])
            case _:
                raise ValueError(f"not allowed in band math: {ast.unparse(node)}")

    column = build(tree)
    if not used:
        raise ValueError("the expression must use a band, a single number is no raster")
    return column


def band_math(cube: DataFrame, expression: str) -> DataFrame:
    """Evaluate an expression per pixel; nan and infinities become 0."""
    bands = [c for c in cube.columns if c not in KEYS]
    return _result(cube, _finite(band_expression(expression, bands).cast("float")), "result")


def _finite(value: Column) -> Column:
    finite = F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), _float(0.0)).otherwise(value)
    return F.coalesce(finite, _float(0.0))


# ---------------------------------------------------------------- whole tiles


# Formulas over pixel values by role, for tiles of paired bands.
FORMULAS: dict[str, tuple[list[str], Callable[..., Column]]] = {
    "ndvi": (["nir", "red"], normalized_difference),
    "ndwi": (["green", "nir"], normalized_difference),
    "ndsi": (["green", "swir"], normalized_difference),
    "evi": (["nir", "red", "blue"], vegetation_enhanced),
    "cloud_mask": (["scl"], clear_sky),
}
# What becomes of a formula's values in a second pass, so that they are worked out once and not for every case looked at.
SECOND_PASS: dict[str, Callable[[Column], Column]] = {"ndvi": without_gaps}


def pair_tiles(tiles: DataFrame, keys: list[str], roles: list[str], value: str = "pixels") -> DataFrame:
    """A row per key with the tile of each role (column ``role``), where all roles are there; a role has one tile per key.

    Tiles move once and are sorted by their narrow key; the tile lists themselves are neither compared nor merged.
    """
    names = F.array(*map(F.lit, sorted(roles)))
    numbered = tiles.filter(F.col("role").isin(roles)).withColumn("_nth", F.array_position(names, F.col("role")))
    by_role = Window.partitionBy(*keys).orderBy("_nth")
    entry = F.struct("role", value)
    chain = [entry if not k else F.lead(entry, k).over(by_role) for k in range(len(roles))]
    row = numbered.select(*keys, "_nth", *[c.alias(f"_r{k}") for k, c in enumerate(chain)]).filter("_nth = 1")
    for k, role in enumerate(sorted(roles)):
        row = row.filter(F.col(f"_r{k}.role") == role)
    return row.select(*keys, *[F.col(f"_r{k}.{value}").alias(role) for k, role in enumerate(sorted(roles))])


def tile_index(paired: DataFrame, operation: str, keys: list[str], expression: str | None = None, bands: list[str] | None = None) -> DataFrame:
    """Result tiles (``keys``, ``pixels``) from tiles paired by role (by band for ``band_math``): arrays in, arrays out.

    Pixels meet by their position in the tile, inside the row; nothing is spread out or moved.
    """
    if operation == "band_math":
        names = sorted(bands or [])
        formula = lambda *v: _finite(band_expression(expression, names, dict(zip(names, v)).__getitem__).cast("float"))
    elif operation in FORMULAS:
        names, formula = FORMULAS[operation]
    else:
        raise ValueError(f"no tile formula for {operation!r}, have {sorted([*FORMULAS, 'band_math'])}")
    as_float = lambda c: c.cast("float")
    if len(names) == 1:
        pixels = F.transform(names[0], lambda a: formula(as_float(a)))
    elif len(names) == 2:
        pixels = F.zip_with(names[0], names[1], lambda a, b: formula(as_float(a), as_float(b)))
    else:
        pixels = F.transform(F.arrays_zip(*names), lambda v: formula(*[as_float(v[n]) for n in names]))
    if operation in SECOND_PASS:
        pixels = F.transform(pixels, SECOND_PASS[operation])
    return paired.select(*keys, pixels.alias("pixels"))


# ---------------------------------------------------------------- registry

OPERATIONS: dict[str, Callable[..., DataFrame]] = {
    "ndvi": ndvi, "ndwi": ndwi, "ndsi": ndsi, "evi": evi, "cloud_mask": cloud_mask, "true_color": true_color, "band_math": band_math,
}


def register_op(name: str, function: Callable[[dict[str, Column]], list[Column]], required_bands: list[str]) -> None:
    """Add an operation: ``function`` gets the bands by name and returns named columns."""

    def run(cube: DataFrame) -> DataFrame:
        columns = function({b: find_band_loose(cube, b) for b in required_bands})
        return cube.select(*[k for k in KEYS if k in cube.columns], *columns)

    OPERATIONS[name] = run


def apply_op(cube: DataFrame, name: str, **arguments) -> DataFrame:
    if name not in OPERATIONS:
        raise ValueError(f"unknown operation {name!r}, have {sorted(OPERATIONS)}")
    return OPERATIONS[name](cube, **arguments)
