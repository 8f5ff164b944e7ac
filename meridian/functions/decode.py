"""Column builders that decode stored values: packing, missing values, grid coordinates, table cells, request limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS_HPA = (1000, 975, 950, 925, 900, 875, 850, 825, 800, 775, 750, 700, 650, 600, 550, 500, 450, 400, 350, 300, 250, 225, 200, 175, 150, 125, 100, 70, 50, 30, 20, 10, 7, 5, 3, 2, 1)  # fixed values
# Long names of the request's variables and their names in files.
SHORT_NAMES = {
    "temperature": "t", "u_component_of_wind": "u", "v_component_of_wind": "v", "vertical_velocity": "w", "specific_humidity": "q", "relative_humidity": "r", "geopotential": "z", "divergence": "d", "vorticity": "vo",
    "ozone_mass_mixing_ratio": "o3", "fraction_of_cloud_cover": "cc", "specific_cloud_ice_water_content": "ciwc", "specific_cloud_liquid_water_content": "clwc", "specific_rain_water_content": "crwc", "specific_snow_water_content": "cswc", "potential_vorticity": "pv",
}
# Codes of shape types.
SHAPE_TYPES = {0: "Null", 1: "Point", 3: "PolyLine", 5: "Polygon", 8: "MultiPoint", 11: "PointZ", 13: "PolyLineZ", 15: "PolygonZ", 18: "MultiPointZ", 21: "PointM", 23: "PolyLineM", 25: "PolygonM", 28: "MultiPointM", 31: "MultiPatch"}


def missing(mask: str = "nan") -> Column:
    return F.lit(float("nan")) if mask == "nan" else F.lit(None).cast("double")


def unpack(raw: Column, scale: float = 1.0, offset: float = 0.0, fill=None, mask: str = "nan") -> Column:
    """raw * scale + offset; raw values equal to the fill are missing."""
    value = raw.cast("double") * F.lit(float(scale)) + F.lit(float(offset))
    return value if fill is None else F.when(raw == F.lit(fill), missing(mask)).otherwise(value)


def no_data(value: Column, sentinel, mask: str = "nan") -> Column:
    return F.when(value == F.lit(sentinel), missing(mask)).otherwise(value.cast("double"))


def blank_to_missing(text: Column, mask: str = "nan") -> Column:
    """Blank cells are missing, numbers parse, anything else is an error."""
    return F.when(F.trim(text) == "", missing(mask)).otherwise(F.trim(text).cast("double"))


def number_or_missing(text: Column, mask: str = "nan") -> Column:
    """What does not parse is missing."""
    return F.coalesce(F.trim(text).try_cast("double"), missing(mask))


def centre_x(col: Column, x0: float, dx: float, i0: float = 0.0) -> Column:
    return F.lit(float(x0)) + (col - F.lit(float(i0)) + 0.5) * F.lit(float(dx))


def centre_y(row: Column, y0: float, dy: float, j0: float = 0.0) -> Column:
    return F.lit(float(y0)) - (row - F.lit(float(j0)) + 0.5) * F.lit(float(dy))


def is_live(flag: Column) -> Column:
    """A record is deleted only if its flag is an asterisk."""
    return F.coalesce(flag, F.lit("")) != "*"


def compact_date(date: Column) -> Column:
    return F.date_format(date, "yyyyMMdd")


def shape_type_name(code: Column) -> Column:
    pairs = [F.lit(x) for kv in SHAPE_TYPES.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), code.cast("int")), F.lit("Unknown"))


def short_name(long_name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SHORT_NAMES.items() for x in kv]), long_name)


def level_hpa(index: Column) -> Column:
    """Pressure of a level index from 1, rounded half to even; an index out of range is an error."""
    i = F.bround(index.cast("double"), 0).cast("int")
    ok = i.between(1, len(LEVELS_HPA))
    return F.when(ok, F.get(F.array(*[F.lit(x) for x in LEVELS_HPA]), i - 1)).otherwise(F.raise_error(F.concat(F.lit("level index out of range: "), index.cast("string"))).cast("int"))


def request_area(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    """[north, west, south, east] in whole degrees, outward by one degree; the corners may come in either order."""
    north, south = F.ceil(F.greatest(lat_a, lat_b) + 1), F.floor(F.least(lat_a, lat_b) - 1)
    west, east = F.floor(F.least(lon_a, lon_b) - 1), F.ceil(F.greatest(lon_a, lon_b) + 1)
    return F.array(*[x.cast("int") for x in (north, west, south, east)])


def close_to(a: Column, b: Column, atol: float = 1e-6, rtol: float = 1e-9) -> Column:
    """Equal within tolerance; missing equals missing only."""
    na, nb = a.isNull() | F.isnan(a), b.isNull() | F.isnan(b)
    return F.coalesce(F.when(na | nb, na & nb).otherwise(F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)), F.lit(False))


def difference(a: Column, b: Column) -> list[Column]:
    """Aggregates over two versions of an array: `most`, the largest difference of cells present in both, and `same_mask`, whether the same cells are missing."""
    na, nb = a.isNull() | F.isnan(a), b.isNull() | F.isnan(b)
    return [F.max(F.when(~na & ~nb, F.abs(a - b))).alias("most"), F.bool_and(na == nb).alias("same_mask")]


def affine_centre(row: Column, col: Column, a: float, b: float, c: float) -> Column:
    """One coordinate of a cell's centre under an affine map (with rotation): a * (col + 0.5) + b * (row + 0.5) + c."""
    return F.lit(float(a)) * (col + 0.5) + F.lit(float(b)) * (row + 0.5) + F.lit(float(c))
