"""Headers: a 28-byte record and the frames' byte counts, bit-packed. All of it is also available as columns."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import FormatError
from ..functions import dtypes
from ..functions.grid import HEADER_BYTES, MAX_FRAMES, MAX_LISTED, UNITS, Grid, base_offset, div
from ..ship import ship

# The record's layout, its first number, its version.
RECORD = struct.Struct("<IHIIHHHBBBIB")
MAGIC, VERSION = 0x45564F4C, 1
BIT_WIDTHS = (1, 2, 4, 6, 8, 16, 32, 64, 128)

#: What can be wrong with a header, by number.
PROBLEMS = (
    "shorter than a header",
    "does not start with the magic number",
    "has a version that is not supported",
    "has an invalid number of bits per sample",
    "has an invalid sample format",
    "has a frame unit that is neither tile nor cell",
    "has invalid dimensions",
    "has another size than its frame count asks for",
    "has a frame count that overflows 32 bits",
    "has a frame size that overflows",
    "lists more frames than the safety limit",
    "has a frame of no bytes",
    "has offsets that overflow",
    "has a count width above 32 bits",
    "does not pack its byte counts canonically",
    "has a byte count that does not fit 32 bits",
)
(TOO_SHORT, BAD_MAGIC, BAD_VERSION, BAD_BITS, BAD_FORMAT, BAD_UNIT, BAD_SIZE, BAD_LENGTH, FRAME_OVERFLOW, SIZE_OVERFLOW, TOO_MANY, EMPTY_FRAME, OFFSET_OVERFLOW, BAD_WIDTH, NOT_CANONICAL, COUNT_OVERFLOW) = range(16)


class HeaderError(FormatError):
    def __init__(self, problem: int):
        super().__init__(f"the header {PROBLEMS[problem]}")
        self.problem = problem


def pack_counts(counts: np.ndarray) -> tuple[int, int, bytes]:
    """The least count, the bits per residual, and the residuals packed from the lowest bit on."""
    counts = np.asarray(counts, np.int64)
    if not len(counts) or counts.min() < 1:
        raise HeaderError(EMPTY_FRAME)
    if counts.max() > MAX_FRAMES:
        raise HeaderError(COUNT_OVERFLOW)
    least = int(counts.min())
    bits = int(counts.max() - least).bit_length()
    if not bits:
        return least, 0, b""
    spread = (counts - least).astype("<u4").view(np.uint8).reshape(-1, 4)
    return least, bits, np.packbits(np.unpackbits(spread, axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes()


#: Counts that are unpacked at a time, a multiple of eight.
CHUNK = 1 << 16


def unpack_counts(least: int, bits: int, packed: bytes, frames: int) -> np.ndarray:
    out = np.full(frames, least, np.int64)
    for a in range(0, frames if bits else 0, CHUNK):
        n = min(CHUNK, frames - a)
        wide = np.zeros((n, 32), np.uint8)
        wide[:, :bits] = np.unpackbits(np.frombuffer(packed, np.uint8, (n * bits + 7) // 8, a * bits // 8), count=n * bits, bitorder="little").reshape(n, bits)
        out[a : a + n] += np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()
    return out


@dataclass(frozen=True)
class Header:
    """A parsed header. Frames of equal size need no list: count and offset follow by arithmetic."""

    grid: Grid
    count_min: int
    count_bits: int
    counts: np.ndarray | None

    def count(self, i):
        return np.full(np.shape(i), self.count_min, np.int64) if self.counts is None else self.counts[i]

    def starts(self) -> np.ndarray | None:
        """Where each frame starts after the base, if sizes differ."""
        return None if self.counts is None else np.cumsum(self.counts) - self.counts

    def offset(self, i, starts: np.ndarray | None = None):
        if self.counts is None:
            return self.grid.base + np.asarray(i, np.int64) * self.count_min
        return self.grid.base + (self.starts() if starts is None else starts)[i]

    @property
    def end(self) -> int:
        return self.grid.base + (self.grid.frames * self.count_min if self.counts is None else int(self.counts.sum()))


def encode_header(grid: Grid, counts) -> bytes:
    if len(counts) != grid.frames:
        raise ValueError(f"the grid has {grid.frames} frames, but {len(counts)} counts are given")
    least, bits, packed = pack_counts(counts)
    unit = 0 if grid.bands == 1 else UNITS.index(grid.unit)
    return RECORD.pack(MAGIC, VERSION, grid.width, grid.height, grid.tile_width, grid.tile_length, grid.bands, grid.kind.bits, grid.kind.sample_format, unit, least, bits) + packed


def parse_header(blob: bytes, empty: bool = False, most: int | None = MAX_LISTED) -> Header:
    """The header that a blob holds; nothing is expanded before its size is known to be sound.

    A container's frames have bytes, and an index from elsewhere lists `most` frames of unequal size. Rows of a table as
    frames may have none (empty), and may be any number (most=None).
    """
    if len(blob) < HEADER_BYTES:
        raise HeaderError(TOO_SHORT)
    magic, version, width, height, tw, tl, bands, bits, form, unit, least, count_bits = RECORD.unpack_from(blob)
    if magic != MAGIC:
        raise HeaderError(BAD_MAGIC)
    if version != VERSION:
        raise HeaderError(BAD_VERSION)
    if bits not in BIT_WIDTHS:
        raise HeaderError(BAD_BITS)
    if (form, bits) not in dtypes.BY_SAMPLE:
        raise HeaderError(BAD_FORMAT)
    if unit > 1:
        raise HeaderError(BAD_UNIT)
    if not (width and height and tw and tl and bands) or max(width, height) >= 1 << 31:
        raise HeaderError(BAD_SIZE)
    kind = dtypes.BY_SAMPLE[form, bits]
    frames = -(-width // tw) * -(-height // tl) * (bands if unit == 0 else 1)
    if frames > MAX_FRAMES:
        raise HeaderError(FRAME_OVERFLOW)
    if tw * tl * kind.size * (1 if unit == 0 else bands) >= 1 << 63:
        raise HeaderError(SIZE_OVERFLOW)
    if count_bits > 32:
        raise HeaderError(BAD_WIDTH)
    if len(blob) != HEADER_BYTES + (frames * count_bits + 7) // 8:
        raise HeaderError(BAD_LENGTH)
    if count_bits and most is not None and frames > most:
        raise HeaderError(TOO_MANY)
    if not least and not empty:
        raise HeaderError(EMPTY_FRAME)
    grid = Grid(bands, height, width, tw, tl, UNITS[unit], kind)
    if not count_bits:
        if grid.base + frames * least >= 1 << 63:
            raise HeaderError(OFFSET_OVERFLOW)
        return Header(grid, least, 0, None)
    counts = unpack_counts(least, count_bits, blob[HEADER_BYTES:], frames)
    if counts.max() > MAX_FRAMES:
        raise HeaderError(COUNT_OVERFLOW)
    spare = frames * count_bits % 8
    if counts.min() != least or int(counts.max() - least).bit_length() != count_bits or spare and blob[-1] >> spare:
        raise HeaderError(NOT_CANONICAL)
    return Header(grid, least, count_bits, counts)


class HeaderView:
    """A header's facts for people and for JSON."""

    def __init__(self, blob: bytes):
        self.header = parse_header(bytes(blob))

    @classmethod
    def from_path(cls, path) -> HeaderView:
        from ..sources.container import index_file

        return cls(index_file(path))

    @property
    def shape(self) -> tuple[int, int, int]:
        g = self.header.grid
        return g.bands, g.height, g.width

    @property
    def dtype(self) -> np.dtype:
        return dtypes.numpy_dtype(self.header.grid.kind)

    @property
    def frame_unit(self) -> str:
        return self.header.grid.unit

    @property
    def frames(self) -> int:
        return self.header.grid.frames

    def to_dict(self) -> dict:
        g = self.header.grid
        return {
            "shape": list(self.shape), "bands": g.bands, "height": g.height, "width": g.width, "dtype": g.kind.name, "tile": [g.tile_width, g.tile_length],
            "tiles_across": g.across, "tiles_down": g.down, "frame_unit": g.unit, "frames": g.frames, "base_frame_offset": g.base, "codec": "tagged",
        }

    def __repr__(self) -> str:
        return "<HeaderView " + " ".join(f"{k}={v}" for k, v in self.to_dict().items()) + ">"


FIELDS = "bands int, height bigint, width bigint, tile_width int, tile_length int, unit int, dtype string, bits int, sample_format int, tiles_across bigint, tiles_down bigint, frames bigint, count_min bigint, count_bits int, base_frame_offset bigint, data_end bigint"
PARSED = f"struct<ok:boolean,problem:int,message:string,{FIELDS.replace(' ', ':').replace(',:', ',')}>"


def parsed(headers: DataFrame, header: str = "header", strict: bool = False, empty: bool = False, most: int | None = MAX_LISTED) -> DataFrame:
    """Adds the struct `parsed`: the header's fields, or what is wrong with it (strict: an error at run time); empty, most: as for `parse_header`."""
    ship(headers.sparkSession)
    names = headers.columns
    keys = [f.split()[0] for f in FIELDS.split(", ")]

    def one(blob) -> dict:
        try:
            h = parse_header(bytes(blob or b""), empty, most)
        except HeaderError as e:
            if strict:
                raise
            return {"ok": False, "problem": e.problem, "message": str(e)}
        g = h.grid
        values = (g.bands, g.height, g.width, g.tile_width, g.tile_length, UNITS.index(g.unit), g.kind.name, g.kind.bits, g.kind.sample_format, g.across, g.down, g.frames, h.count_min, h.count_bits, g.base, h.end)
        return {"ok": True} | dict(zip(keys, values, strict=True))

    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    struct = pa.struct([("ok", pa.bool_()), ("problem", pa.int32()), ("message", pa.string()), *((f.split()[0], kinds[f.split()[1]]) for f in FIELDS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            facts = pa.array([one(v) for v in batch.column(header).to_pylist()], struct)
            yield pa.RecordBatch.from_arrays([*batch.columns, facts], [*names, "parsed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in headers.schema) + f", parsed {PARSED}"
    return headers.mapInArrow(run, schema)


# ---- the same as columns ------------------------------------------------------------


def count_plan(frames: DataFrame, by: list[str], count: str = "byte_count") -> DataFrame:
    """Per image: number of frames, least count, and bits per residual."""
    out = frames.groupBy(*by).agg(F.count(F.lit(1)).alias("frames"), F.min(count).alias("count_min"), F.max(count).alias("count_max"))
    gap = F.col("count_max") - F.col("count_min")
    return out.withColumn("count_bits", F.when(gap == 0, F.lit(0)).otherwise(F.length(F.bin(gap))).cast("int")).drop("count_max")


def packed_groups(frames: DataFrame, plan: DataFrame, by: list[str], index: str = "frame_index", count: str = "byte_count") -> DataFrame:
    """The packed residuals of each eight frames, which fill whole bytes: (by, part, values), a number per byte."""
    joined = frames.join(plan, by).where("count_bits > 0")
    eight = joined.groupBy(*by, "count_bits", div(F.col(index), 8).alias("part")).agg(F.sort_array(F.collect_list(F.struct(F.col(index).alias("i"), (F.col(count) - F.col("count_min")).alias("rest")))).alias("rests"))
    size = "(size(rests) * count_bits + 7) div 8"
    bit = "coalesce((shiftright(get(rests, cast((8 * j + u) div count_bits as int)).rest, cast((8 * j + u) % count_bits as int)) & 1), 0L)"
    values = F.expr(f"transform(sequence(0L, {size} - 1), j -> cast(aggregate(sequence(0, 7), 0L, (sum, u) -> sum + shiftleft({bit}, u)) as int))")
    return eight.select(*by, "count_bits", "part", values.alias("values"))


def packed_bytes(frames: DataFrame, plan: DataFrame, by: list[str], index: str = "frame_index", count: str = "byte_count") -> DataFrame:
    """The packed residuals, one row per byte: (by, pos, value)."""
    groups = packed_groups(frames, plan, by, index, count)
    return groups.select(*by, "count_bits", "part", F.posexplode("values").alias("j", "value")).select(*by, (F.col("part") * F.col("count_bits") + F.col("j")).cast("bigint").alias("pos"), "value")


def packed_hex(frames: DataFrame, plan: DataFrame, by: list[str], index: str = "frame_index", count: str = "byte_count") -> DataFrame:
    """Per image the packed residuals as hex: (by, packed). Images of equal frames have none."""
    text = F.array_join(F.transform("values", lambda v: F.lpad(F.hex(v.cast("bigint")), 2, "0")), "")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["text"]), "")
    # Runs of parts are joined first: an image is gathered as a few long strings instead of very many short ones.
    parts = packed_groups(frames, plan, by, index, count).select(*by, div(F.col("part"), 4096).alias("run"), F.struct("part", text.alias("text")).alias("s"))
    runs = parts.groupBy(*by, "run").agg(joined.alias("text")).select(*by, F.struct("run", "text").alias("s"))
    return runs.groupBy(*by).agg(joined.alias("packed"))


def little_endian_hex(value: Column, size: int) -> Column:
    """A number's bytes from the lowest on, as hex."""
    return F.concat(*[F.lpad(F.hex((F.floor(value / F.lit(256**k)) % 256).cast("bigint")), 2, "0") for k in range(size)])


def record_hex(bands: Column, height: Column, width: Column, tile_width: Column, tile_length: Column, bits: Column, sample_format: Column, unit: Column, count_min: Column, count_bits: Column) -> Column:
    """The 28-byte record as hex."""
    sizes = ((F.lit(MAGIC).cast("bigint"), 4), (F.lit(VERSION), 2), (width, 4), (height, 4), (tile_width, 2), (tile_length, 2), (bands, 2), (bits, 1), (sample_format, 1), (unit, 1), (count_min, 4), (count_bits, 1))
    return F.concat(*[little_endian_hex(v.cast("bigint"), n) for v, n in sizes])


def offsets(frames: DataFrame, base: Column, by: list[str], index: str = "frame_index", count: str = "byte_count") -> DataFrame:
    """Adds `offset`: the base plus all counts before. One image is one task; many images spread."""
    w = Window.partitionBy(*by).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumn("offset", base + F.coalesce(F.sum(count).over(w), F.lit(0)))


def constant_offset(base: Column, index: Column, count_min: Column) -> Column:
    """The offset where all frames have the same size."""
    return base + index * count_min


def too_many(frames: Column, count_bits: Column) -> Column:
    """True if an index of unequal frames would pass the safety limit."""
    return (count_bits > 0) & (frames > MAX_LISTED)


def canonical(counts: DataFrame, by: list[str], count_min: str = "count_min", count_bits: str = "count_bits", residual: str = "residual") -> DataFrame:
    """Per image `canonical`: the least residual is 0 and the largest needs all the bits."""
    out = counts.groupBy(*by, count_min, count_bits).agg(F.min(residual).alias("lo"), F.max(residual).alias("hi"))
    need = F.when(F.col("hi") == 0, F.lit(0)).otherwise(F.length(F.bin("hi")))
    return out.select(*by, ((F.col("lo") == 0) & (need == F.col(count_bits))).alias("canonical"))


def base_of(grid: Grid) -> int:
    return base_offset(grid.bands, grid.frames)
