"""Grid arithmetic, once for Python numbers and once for columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .dtypes import DType, dtype

UNITS = ("tile", "cell")
HEADER_BYTES, IFD_BYTES, FIRST_IFD = 28, 236, 16
MAX_FRAMES = (1 << 32) - 1
#: Frames of unequal size that one index may list: 64 MiB at 12 bytes each.
MAX_LISTED = (64 << 20) // 12


def base_offset(bands: int, frames: int) -> int:
    """Where frame data starts: the lead, and each value list that does not fit its entry."""
    return FIRST_IFD + IFD_BYTES + 160 + (4 * bands if bands >= 5 else 0) + (8 * frames if frames >= 2 else 0) + (4 * frames if frames >= 3 else 0)


@dataclass(frozen=True)
class Grid:
    """An image's shape, how it is cut, and its sample type."""

    bands: int
    height: int
    width: int
    tile_width: int
    tile_length: int
    unit: str = "tile"
    kind: DType | str = "uint16"

    def __post_init__(self):
        object.__setattr__(self, "kind", dtype(self.kind))
        if self.unit not in UNITS:
            raise ValueError(f"unit must be one of {UNITS}, got {self.unit!r}")
        if min(self.bands, self.height, self.width) < 1:
            raise ValueError("bands, height and width must be at least 1")
        if not (1 <= self.tile_width <= 65535 and 1 <= self.tile_length <= 65535):
            raise ValueError("tile sizes must be 1 to 65535")
        if self.bands > 65535 or max(self.height, self.width) > (1 << 31) - 1:
            raise ValueError("the image is too large")
        if self.frames > MAX_FRAMES:
            raise ValueError("the frame count overflows 32 bits")

    @property
    def across(self) -> int:
        return -(-self.width // self.tile_width)

    @property
    def down(self) -> int:
        return -(-self.height // self.tile_length)

    @property
    def per_position(self) -> int:
        return self.bands if self.unit == "tile" else 1

    @property
    def frames(self) -> int:
        return self.across * self.down * self.per_position

    @property
    def base(self) -> int:
        return base_offset(self.bands, self.frames)

    @property
    def cells(self) -> list[str]:
        return [f"{r}.{c}" for r in range(self.down) for c in range(self.across)]

    def frame_shape(self, row: int, col: int) -> tuple[int, ...]:
        h, w = min(self.tile_length, self.height - row * self.tile_length), min(self.tile_width, self.width - col * self.tile_width)
        return (h, w) if self.unit == "tile" else (self.bands, h, w)

    def index(self, spark: SparkSession, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, bands: list[int] | None = None) -> DataFrame:
        """The frames within row, column and band bounds, made by arithmetic on a range: no row for any other."""
        r0, r1 = rows or (0, self.down)
        c0, c1 = cols or (0, self.across)
        wanted = sorted(set(bands)) if bands is not None and self.unit == "tile" else None
        per = len(wanted) if wanted is not None else self.per_position
        i = F.col("id")
        out = spark.range((r1 - r0) * (c1 - c0) * per).select(
            (F.lit(r0) + F.floor(i / (per * (c1 - c0)))).cast("int").alias("row"),
            (F.lit(c0) + F.floor(i / per) % (c1 - c0)).cast("int").alias("col"),
            (i % per).cast("int").alias("band"),
        )
        if self.unit == "cell":
            out = out.withColumn("band", F.lit(None).cast("int"))
        elif wanted is not None and wanted != list(range(per)):
            out = out.withColumn("band", F.element_at(F.array(*map(F.lit, wanted)), F.col("band") + 1))
        return out.select(frame_index(F.col("row"), F.col("col"), F.coalesce("band", F.lit(0)), self.across, self.per_position).alias("frame_index"), "row", "col", "band",
                          edge(F.col("row"), self.tile_length, self.height).alias("h"), edge(F.col("col"), self.tile_width, self.width).alias("w"))


def ceil_div(a: Column, b: Column | int) -> Column:
    return F.ceil(a / (b if isinstance(b, Column) else F.lit(b))).cast("bigint")


def div(a: Column, b: Column | int) -> Column:
    return F.floor(a / (b if isinstance(b, Column) else F.lit(b))).cast("bigint")


def frame_index(row: Column, col: Column, band: Column, across: Column | int, per_position: Column | int) -> Column:
    """Position in wire order: grid positions row by row, bands innermost."""
    return ((row * across + col) * per_position + band).cast("bigint")


def frame_position(index: Column, across: Column | int, per_position: Column | int) -> tuple[Column, Column, Column]:
    """Row, column and band of a frame index."""
    spot = div(index, per_position)
    return div(spot, across).cast("int"), (spot % across).cast("int"), (index % per_position).cast("int")


def edge(at: Column, tile: Column | int, total: Column | int) -> Column:
    """Height or width of a frame: clipped at the image's edge, never padded."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(lit(tile), lit(total) - at * lit(tile)).cast("int")


def label(row: Column, col: Column, band: Column | None = None) -> Column:
    return F.concat_ws(".", *[c.cast("string") for c in ([] if band is None else [band]) + [row, col]])


def base_offset_column(bands: Column, frames: Column) -> Column:
    lead = F.lit(FIRST_IFD + IFD_BYTES + 160).cast("bigint")
    return lead + F.when(bands >= 5, 4 * bands).otherwise(0) + F.when(frames >= 2, 8 * frames).otherwise(0) + F.when(frames >= 3, 4 * frames).otherwise(0)


def canonical_unit(unit: Column, bands: Column) -> Column:
    """With one band the two units are the same file: it is written as tiles."""
    return F.when(bands == 1, F.lit(0)).otherwise(unit)


def human(n: Column) -> Column:
    """Bytes for people: whole below 1024, else one decimal (ties to even) and a unit."""
    sized = lambda k, u: F.format_string(f"%.1f {u}", F.bround(n / F.lit(1024.0**k), 1))
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024**2, sized(1, "KB")).when(n < 1024**3, sized(2, "MB")).when(n < 1024**4, sized(3, "GB")).otherwise(sized(4, "TB"))


def human_bytes(n: int) -> str:
    if n < 1024:
        return f"{n} B"
    power = next((k for k in (1, 2, 3) if n < 1024 ** (k + 1)), 4)
    return f"{n / 1024**power:.1f} {' KMGT'[power]}B"


def validity(df: DataFrame, bands: str = "bands", height: str = "height", width: str = "width", tile: str = "tile", unit: str = "unit", transform: str | None = None, crs: str | None = None) -> DataFrame:
    """Adds `problem`: why a grid cannot be written, or null."""
    b, y, x, t, u = (F.col(c) for c in (bands, height, width, tile, unit))
    frames = ceil_div(x, t) * ceil_div(y, t) * F.when(u == 0, b).otherwise(F.lit(1))
    problem = F.when((b < 1) | (y < 1) | (x < 1), "dimensions").when((t < 1) | (t > 65535), "tile size").when(~u.isin(0, 1), "unit").when(frames > MAX_FRAMES, "frame count")
    if transform and crs:
        problem = problem.when(F.col(transform).isNull() != F.col(crs).isNull(), "transform and crs go together")
    return df.withColumn("problem", problem)
