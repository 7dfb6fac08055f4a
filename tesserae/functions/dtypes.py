"""Sample types: codes, names, widths, how they look in Spark and how their bytes are read."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..errors import UnsupportedError

# Code, name, sample format, bits, Spark type of a decoded sample.
TABLE = """
1 uint8 1 8 smallint
2 int8 2 8 tinyint
3 uint16 1 16 int
4 int16 2 16 smallint
5 uint32 1 32 bigint
6 int32 2 32 int
7 uint64 1 64 decimal(20,0)
8 int64 2 64 bigint
9 float16 3 16 float
10 float32 3 32 float
11 float64 3 64 double
12 cint16 5 32 struct<re:smallint,im:smallint>
13 cint32 5 64 struct<re:int,im:int>
14 cfloat16 6 32 struct<re:float,im:float>
15 cfloat32 6 64 struct<re:float,im:float>
16 cfloat64 6 128 struct<re:double,im:double>
17 float8_e4m3fn 100 8 float
18 float8_e5m2 101 8 float
19 bfloat16 102 16 float
20 uint4 1 4 tinyint
21 int4 2 4 tinyint
22 uint2 1 2 tinyint
23 int2 2 2 tinyint
24 binary 1 1 tinyint
25 float8_e8m0 103 8 float
26 float6_e2m3 104 6 float
27 float6_e3m2 105 6 float
28 float4_e2m1 106 4 float
"""

# Exponent bits, mantissa bits, bias of the small floats without infinities (but E5M2).
SMALL_FLOATS = {"float8_e4m3fn": (4, 3, 7), "float8_e5m2": (5, 2, 15), "float6_e2m3": (2, 3, 1), "float6_e3m2": (3, 2, 3), "float4_e2m1": (2, 1, 1)}


@dataclass(frozen=True)
class DType:
    code: int
    name: str
    sample_format: int
    bits: int
    spark: str

    @property
    def size(self) -> int:
        """Bytes of a decoded sample; samples of less than a byte take one."""
        return max(1, self.bits // 8)

    @property
    def numpy(self) -> np.dtype:
        """How decoded bytes are viewed before `values` turns them into numbers."""
        if self.sample_format in (1, 2) and self.bits >= 8:
            return np.dtype(f"<{'ui'[self.sample_format - 1]}{self.size}")
        if self.sample_format == 3 or self.sample_format == 6 and self.bits > 32:
            return np.dtype(f"<{'f' if self.sample_format == 3 else 'c'}{self.size}")
        if self.sample_format == 5:
            part = f"<i{self.size // 2}"
            return np.dtype([("re", part), ("im", part)])
        if self.name == "cfloat16":
            return np.dtype([("re", "<f2"), ("im", "<f2")])
        return np.dtype("<u2") if self.name == "bfloat16" else np.dtype("u1") if self.sample_format != 2 else np.dtype("i1")

    def values(self, raw: bytes | np.ndarray) -> np.ndarray:
        """Numbers of decoded bytes, as an array whose items fit the Spark type."""
        a = np.frombuffer(raw, self.numpy) if isinstance(raw, (bytes, bytearray, memoryview)) else raw
        if self.name == "bfloat16":
            return (a.astype(np.uint32) << 16).view(np.float32)
        if self.name in SMALL_FLOATS or self.name == "float8_e8m0":
            return small_float_values(self.name)[a]
        if self.sample_format == 6 and self.bits > 32:
            part = f"f{self.size // 2}"
            out = np.empty(a.shape, [("re", part), ("im", part)])
            out["re"], out["im"] = a.real, a.imag
            return out
        return a.astype(np.float32) if self.name == "float16" else a


@lru_cache
def small_float_values(name: str) -> np.ndarray:
    """All values of a small float type by bit pattern."""
    if name == "float8_e8m0":
        out = np.ldexp(np.float64(1), np.arange(256) - 127)
        out[255] = np.nan
        return out.astype(np.float32)
    e, m, bias = SMALL_FLOATS[name]
    code = np.arange(1 << (e + m + 1))
    exponent, mantissa = code >> m & (1 << e) - 1, code & (1 << m) - 1
    size = np.where(exponent, np.ldexp(1 + mantissa / (1 << m), exponent - bias), np.ldexp(mantissa / (1 << m), 1 - bias))
    if name == "float8_e5m2":
        size = np.where(exponent == 31, np.where(mantissa, np.nan, np.inf), size)
    if name == "float8_e4m3fn":
        size = np.where((exponent == 15) & (mantissa == 7), np.nan, size)
    return np.where(code >> (e + m), -size, size).astype(np.float32)


ALL = [DType(int(c), n, int(f), int(b), s) for c, n, f, b, s in (line.split() for line in TABLE.strip().splitlines())]
BY_NAME = {d.name: d for d in ALL}
BY_CODE = {d.code: d for d in ALL}
BY_SAMPLE = {(d.sample_format, d.bits): d for d in ALL}
#: numpy types that name a sample type of their own.
FROM_NUMPY = {np.dtype(n): BY_NAME[n] for n in ("uint8", "int8", "uint16", "int16", "uint32", "int32", "uint64", "int64", "float16", "float32", "float64")} | {np.dtype("complex64"): BY_NAME["cfloat32"], np.dtype("complex128"): BY_NAME["cfloat64"]}


def dtype(value) -> DType:
    """By name, code, DType or numpy type."""
    if isinstance(value, DType):
        return value
    if isinstance(value, str) and value in BY_NAME:
        return BY_NAME[value]
    if isinstance(value, int) and not isinstance(value, bool):
        if value in BY_CODE:
            return BY_CODE[value]
        raise UnsupportedError(f"no sample type has code {value}")
    try:
        return FROM_NUMPY[np.dtype(value).newbyteorder("=")]
    except (KeyError, TypeError):
        raise TypeError(f"{value!r} is no sample type") from None


def numpy_dtype(value) -> np.dtype:
    """The numpy type of a sample type that has one."""
    d = dtype(value)
    for n, own in FROM_NUMPY.items():
        if own is d:
            return n
    raise UnsupportedError(f"numpy has no type for {d.name}")


def table(spark: SparkSession) -> DataFrame:
    """The 28 sample types as rows."""
    return spark.createDataFrame([(d.code, d.name, d.sample_format, d.bits, d.size) for d in ALL], "code int, name string, sample_format int, bits int, bytes int")
