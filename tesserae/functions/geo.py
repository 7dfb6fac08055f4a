"""Georeferencing: EPSG kinds, the fixed key directory, and the affine transform as a matrix.

Which codes are geographic and which projected is data of the EPSG registry. It is a
parameter here: a table of closed ranges (kind, lo, hi), made from any list of codes by
`ranges`. Without one, KNOWN covers the systems most imagery uses.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UNDEFINED, PROJECTED, GEOGRAPHIC = 0, 1, 2
AREA, POINT = 1, 2

# Fixed values of the EPSG registry: (kind, first code, last code).
KNOWN = [
    (GEOGRAPHIC, 4171, 4171),  # RGF93
    (GEOGRAPHIC, 4258, 4258),  # ETRS89
    (GEOGRAPHIC, 4267, 4267),  # NAD27
    (GEOGRAPHIC, 4269, 4269),  # NAD83
    (GEOGRAPHIC, 4283, 4283),  # GDA94
    (GEOGRAPHIC, 4326, 4326),  # WGS 84
    (GEOGRAPHIC, 4674, 4674),  # SIRGAS 2000
    (GEOGRAPHIC, 7844, 7844),  # GDA2020
    (PROJECTED, 2154, 2154),  # RGF93 / Lambert-93
    (PROJECTED, 3031, 3031),  # WGS 84 / Antarctic Polar Stereographic
    (PROJECTED, 3034, 3035),  # ETRS89 / LCC and LAEA Europe
    (PROJECTED, 3395, 3395),  # WGS 84 / World Mercator
    (PROJECTED, 3413, 3413),  # WGS 84 / NSIDC Polar Stereographic North
    (PROJECTED, 3857, 3857),  # WGS 84 / Pseudo-Mercator
    (PROJECTED, 4037, 4038),  # WGS 84 / TMzn35N and TMzn36N
    (PROJECTED, 5070, 5070),  # NAD83 / Conus Albers
    (PROJECTED, 25828, 25837),  # ETRS89 / UTM 28N to 37N
    (PROJECTED, 26901, 26923),  # NAD83 / UTM 1N to 23N
    (PROJECTED, 27700, 27700),  # OSGB36 / British National Grid
    (PROJECTED, 28348, 28358),  # GDA94 / MGA 48 to 58
    (PROJECTED, 31978, 31985),  # SIRGAS 2000 / UTM 18S to 25S
    (PROJECTED, 32601, 32660),  # WGS 84 / UTM north
    (PROJECTED, 32701, 32760),  # WGS 84 / UTM south
]

Ranges = list[tuple[int, int, int]]


def ranges_table(spark: SparkSession, known: Ranges = KNOWN) -> DataFrame:
    return spark.createDataFrame(known, "kind int, lo int, hi int")


def ranges(codes: DataFrame, kind: str = "kind", code: str = "code") -> DataFrame:
    """Closed ranges (kind, lo, hi) of runs of consecutive codes."""
    distinct = codes.select(F.col(kind).alias("kind"), F.col(code).cast("bigint").alias("code")).where("code IS NOT NULL").distinct()
    island = F.col("code") - F.row_number().over(Window.partitionBy("kind").orderBy("code"))
    return distinct.withColumn("island", island).groupBy("kind", "island").agg(F.min("code").alias("lo"), F.max("code").alias("hi")).drop("island")


def model_type(epsg: int, known: Ranges = KNOWN) -> int:
    return next((kind for kind, lo, hi in known if lo <= epsg <= hi), UNDEFINED)


def with_model_type(df: DataFrame, epsg: str, known: DataFrame) -> DataFrame:
    """Adds `model`: 0 undefined, 1 projected, 2 geographic. The ranges are registry data; at most 100,000 are taken."""
    if known.limit(100_001).count() > 100_000:
        raise ValueError("a table of codes has at most 100,000 ranges")
    k = F.broadcast(known.select(F.col("kind").alias("__kind"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi")))
    out = df.join(k, (F.col(epsg) >= F.col("__lo")) & (F.col(epsg) <= F.col("__hi")), "left")
    return out.withColumn("model", F.coalesce("__kind", F.lit(UNDEFINED))).drop("__kind", "__lo", "__hi")


def geokeys(epsg: int, point: bool = False, known: Ranges = KNOWN) -> list[int]:
    """The 16 numbers of the key directory; a code that is in no range is an error."""
    model = model_type(epsg, known) if epsg else UNDEFINED
    if epsg and model == UNDEFINED:
        raise ValueError(f"EPSG:{epsg} is not in the table of codes")
    return [1, 1, 0, 3, 1024, 0, 1, model, 1025, 0, 1, POINT if point else AREA, 3072 if model == PROJECTED else 2048, 0, 1, epsg]


def geokeys_column(epsg: Column, model: Column, point: Column) -> Column:
    key = F.when(model == PROJECTED, 3072).otherwise(2048)
    parts = [1, 1, 0, 3, 1024, 0, 1, model, 1025, 0, 1, F.when(point, POINT).otherwise(AREA), key, 0, 1, epsg]
    return F.array(*[(p if isinstance(p, Column) else F.lit(p)).cast("int") for p in parts])


def crs_code(value) -> int:
    """An EPSG code from a number, "EPSG:n", digits, or an object with to_epsg()."""
    if isinstance(value, bool):
        raise TypeError("a CRS is a code, not a bool")
    if value is None:
        return 0
    if isinstance(value, int):
        return value
    if isinstance(value, str):
        found = re.fullmatch(r"\s*(?:epsg:)?\s*([0-9]+)\s*", value, re.IGNORECASE)
        if found:
            return int(found[1])
        raise ValueError(f"{value!r} names no EPSG code")
    if hasattr(value, "to_epsg"):
        code = value.to_epsg()
        if code is None:
            raise ValueError("the CRS has no EPSG code")
        return int(code)
    raise TypeError(f"a CRS is a code, a string or has to_epsg(), got {type(value).__name__}")


def crs_code_column(text: Column) -> Column:
    """The code of "EPSG:n" or digits, else null."""
    return F.regexp_extract(F.lower(text), r"^\s*(?:epsg:)?\s*([0-9]+)\s*$", 1).try_cast("int")


def matrix(transform) -> list[float]:
    """Affine coefficients (x_res, row_rot, x_origin, col_rot, y_res, y_origin, ...) as a 4 x 4 matrix, row by row."""
    if transform is None:
        a, b, c, d, e, f = 1.0, 0.0, 0.0, 0.0, 1.0, 0.0
    else:
        values = [float(v) for v in transform]
        if len(values) < 6:
            raise ValueError("a transform has six coefficients")
        a, b, c, d, e, f = values[:6]
    return [a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def matrix_column(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> Column:
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(a, b, zero, c, d, e, zero, f, zero, zero, zero, zero, zero, zero, zero, one)
