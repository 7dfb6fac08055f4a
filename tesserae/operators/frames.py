"""An image cut into frames: a DataFrame with a grid, and what people do with it."""

from __future__ import annotations

import html
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, dtypes
from ..functions.grid import Grid, div, human_bytes, label
from ..ship import ship
from .read import to_spark

OWN = ("data", "compressed", "cell", "tile", "row", "col", "band")
PREVIEW_ALL, PREVIEW_ENDS, MOST_BINS = 11, 5, 24


def frames(array: np.ndarray, tile_size: int = 512, unit: str = "tile", spark: SparkSession | None = None) -> FrameTable:
    """Cuts an array (bands, height, width) into frames."""
    return FrameTable.from_array(array, tile_size, unit, spark)


class FrameTable:
    """Frames in wire order: columns frame_index, row, col, band, h, w, data, payload, and attached ones."""

    def __init__(self, df: DataFrame, grid: Grid, extras: tuple[str, ...] = ()):
        self.grid, self.extras = grid, extras
        self.df = df if "payload" in df.columns else df.withColumn("payload", F.lit(None).cast("binary"))

    # ---- making ---------------------------------------------------------------------

    @classmethod
    def from_array(cls, array: np.ndarray, tile_size: int = 512, unit: str = "tile", spark: SparkSession | None = None) -> FrameTable:
        array = np.asarray(array)
        if array.ndim != 3:
            raise ValueError(f"an image has three axes (bands, height, width), not {array.ndim}")
        if array.dtype.kind in "bOSUV":
            raise TypeError(f"{array.dtype} is no sample type")
        grid = Grid(*array.shape, tile_size, tile_size, unit, dtypes.dtype(array.dtype))
        spark = spark or SparkSession.builder.getOrCreate()
        rows = {"frame_index": [], "row": [], "col": [], "band": [], "h": [], "w": []}
        parts, ends = [], [0]
        for i in range(grid.frames):
            spot, band = divmod(i, grid.per_position)
            r, c = divmod(spot, grid.across)
            cutout = array[band if unit == "tile" else slice(None), r * tile_size : (r + 1) * tile_size, c * tile_size : (c + 1) * tile_size]
            for k, v in zip(rows, (i, r, c, band if unit == "tile" else None, cutout.shape[-2], cutout.shape[-1]), strict=True):
                rows[k].append(v)
            parts.append(to_spark(grid.kind.values(np.ascontiguousarray(cutout).ravel()), grid.kind))
            ends.append(ends[-1] + cutout.size)
        table = pa.table({k: pa.array(v, pa.int64() if k == "frame_index" else pa.int32()) for k, v in rows.items()} | {"data": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(parts))})
        return cls(spark.createDataFrame(table), grid)

    @classmethod
    def from_pixels(cls, pixels: DataFrame, grid: Grid) -> FrameTable:
        """From rows (b, y, x, v), distributed."""
        from .pixels import cut

        return cls(cut(pixels, grid), grid)

    def problems(self) -> DataFrame:
        """What keeps the frames from being a whole image: missing, repeated, misplaced or misshapen ones."""
        want = self.grid.index(self.df.sparkSession).select("frame_index", F.col("row").alias("r"), F.col("col").alias("c"), F.col("h").alias("hh"), F.col("w").alias("ww"))
        have = self.df.groupBy("frame_index").agg(F.count(F.lit(1)).alias("times"), F.first("row").alias("row"), F.first("col").alias("col"), F.first("h").alias("h"), F.first("w").alias("w"), F.first(F.size("data")).alias("samples"))
        planes = self.grid.bands if self.grid.unit == "cell" else 1
        why = (
            F.when(F.col("times").isNull(), "missing").when(F.col("r").isNull(), "beyond the grid").when(F.col("times") > 1, "repeated")
            .when((F.col("row") != F.col("r")) | (F.col("col") != F.col("c")), "misplaced")
            .when((F.col("h") != F.col("hh")) | (F.col("w") != F.col("ww")) | (F.col("samples") != F.col("hh") * F.col("ww") * planes), "wrong shape")
        )
        return want.join(have, "frame_index", "full").select("frame_index", why.alias("problem")).where("problem IS NOT NULL")

    def check(self) -> FrameTable:
        found = self.problems().orderBy("frame_index").first()
        if found:
            raise ValueError(f"frame {found.frame_index}: {found.problem}")
        return self

    # ---- shape ----------------------------------------------------------------------

    @property
    def tiles_across(self) -> int:
        return self.grid.across

    @property
    def tiles_down(self) -> int:
        return self.grid.down

    @property
    def cells(self) -> list[str]:
        return self.grid.cells

    @property
    def columns(self) -> list[str]:
        own = ["tile", "cell", "band"] if self.grid.unit == "tile" else ["cell"]
        return [*own, "row", "col", "data", "compressed", *self.extras]

    def __len__(self) -> int:
        return self.grid.frames

    # ---- access ---------------------------------------------------------------------

    def column(self, name: str) -> Column:
        tile = self.grid.unit == "tile"
        known = {"data": F.col("data"), "compressed": F.col("payload"), "row": F.col("row"), "col": F.col("col"), "cell": label(F.col("row"), F.col("col"))}
        if tile:
            known |= {"band": F.col("band"), "tile": label(F.col("row"), F.col("col"), F.col("band"))}
        if name in self.extras:
            return F.col(name)
        if name not in known:
            raise KeyError(name)
        return known[name]

    def select(self, *names: str) -> DataFrame:
        """Columns by name, with the frame index."""
        return self.df.select("frame_index", *(self.column(n).alias(n) for n in names))

    def frame(self, i: int) -> DataFrame:
        """One frame; its row and column follow from its index, so that only one partition's worth is looked at."""
        if isinstance(i, bool) or not isinstance(i, (int, np.integer)):
            raise TypeError(f"a frame is named by a number, not {type(i).__name__}")
        if not -len(self) <= i < len(self):
            raise IndexError(f"frame {i} of {len(self)}")
        return self.df.where(F.col("frame_index") == int(i) % len(self))

    def __getitem__(self, key):
        if isinstance(key, str):
            return [r[0] for r in self.df.select(self.column(key).alias("v"), "frame_index").orderBy("frame_index").drop("frame_index").toLocalIterator()]
        return Frame(self.frame(key).first(), self)

    def __iter__(self) -> Iterator[Frame]:
        return (Frame(r, self) for r in self.df.orderBy("frame_index").toLocalIterator())

    # ---- payloads -------------------------------------------------------------------

    def compress(self, recipe: str = "zlib") -> FrameTable:
        """Every frame with a payload, by a codec of `functions.codec`."""
        codec.parse(recipe)
        ship(self.df.sparkSession)
        kind, names = self.grid.kind, [c for c in self.df.columns if c != "payload"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data = batch.column("data")
                payloads = [codec.encode(_raw(data[i].values, kind), kind, recipe) for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(payloads, pa.binary())], [*names, "payload"])

        kinds = {f.name: f.dataType.simpleString() for f in self.df.schema}
        return FrameTable(self.df.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", payload binary"), self.grid, self.extras)

    def with_payloads(self, payloads: DataFrame | Iterable[bytes | None]) -> FrameTable:
        """Payloads from rows (frame_index, payload), or from a list with one for each frame; None takes one away."""
        if not isinstance(payloads, DataFrame):
            items = list(payloads)
            if len(items) != len(self):
                raise ValueError(f"{len(self)} payloads are expected, not {len(items)}")
            for p in items:
                if p is not None and not isinstance(p, (bytes, bytearray, memoryview)):
                    raise TypeError(f"a payload is bytes, not {type(p).__name__}")
                if p is not None and not len(p):
                    raise ValueError("a payload cannot be empty")
            payloads = self.df.sparkSession.createDataFrame([(i, None if p is None else bytearray(p)) for i, p in enumerate(items)], "frame_index bigint, payload binary")
        return FrameTable(self.df.drop("payload").join(payloads, "frame_index", "left"), self.grid, self.extras)

    def with_payload(self, i: int, payload: bytes | None) -> FrameTable:
        self.frame(i)
        if payload is not None and not len(payload):
            raise ValueError("a payload cannot be empty")
        new = F.lit(None if payload is None else bytearray(payload)).cast("binary")
        return FrameTable(self.df.withColumn("payload", F.when(F.col("frame_index") == i % len(self), new).otherwise(F.col("payload"))), self.grid, self.extras)

    def attach(self, name: str, values: DataFrame | Iterable) -> FrameTable:
        """A column from rows keyed by frame_index or by (row, col), with the value named `name`; or from a list
        with one value for each frame, or one for each grid position."""
        if not name.isidentifier():
            raise ValueError(f"{name!r} is no column name")
        if name in OWN or name in self.df.columns:
            raise ValueError(f"{name!r} is taken")
        if not isinstance(values, DataFrame):
            items = list(values)
            per = self.grid.per_position
            if len(items) not in (len(self), len(self) // per):
                raise ValueError(f"{len(self)} or {len(self) // per} values are expected, not {len(items)}")
            spread = 1 if len(items) == len(self) else per
            values = self.df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(items)], ["spot", name])
            joined = self.df.withColumn("spot", div(F.col("frame_index"), spread)).join(values, "spot", "left").drop("spot")
        else:
            keys = ["frame_index"] if "frame_index" in values.columns else ["row", "col"]
            joined = self.df.join(values.select(*keys, name), keys, "left")
        return FrameTable(joined, self.grid, (*self.extras, name))

    # ---- numbers --------------------------------------------------------------------

    def progress(self) -> DataFrame:
        """One row: frames, done, nbytes, raw bytes of what is done, and their ratio."""
        planes = self.grid.bands if self.grid.unit == "cell" else 1
        has, raw = F.col("payload").isNotNull(), F.col("h") * F.col("w") * F.lit(planes * self.grid.kind.size)
        out = self.df.agg(F.count(F.lit(1)).alias("frames"), F.count_if(has).alias("done"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).cast("bigint").alias("nbytes"), F.coalesce(F.sum(F.when(has, raw)), F.lit(0)).cast("bigint").alias("raw_bytes"))
        return out.withColumn("ratio", F.when(F.col("nbytes") > 0, F.col("raw_bytes") / F.col("nbytes")))

    @property
    def done(self) -> int:
        return self.progress().first().done

    @property
    def nbytes(self) -> int:
        return self.progress().first().nbytes

    def listing(self) -> DataFrame:
        """What to_pandas returns, as rows."""
        own = ["tile", "cell", "band", "row", "col"] if self.grid.unit == "tile" else ["cell", "row", "col"]
        return self.df.select("frame_index", *(self.column(n).alias(n) for n in own), F.octet_length("payload").cast("double").alias("bytes"), *self.extras)

    def to_pandas(self):
        return self.listing().orderBy("frame_index").drop("frame_index").toPandas()

    def completion(self, bins: int = MOST_BINS) -> DataFrame:
        """(y, x, state): the grid in at most `bins` steps each way; 0 nothing, 1 something, 2 everything is done."""
        step = max(1, -(-max(self.grid.across, self.grid.down) // bins))
        done = F.count_if(F.col("payload").isNotNull())
        state = F.when(done == F.count(F.lit(1)), 2).when(done == 0, 0).otherwise(1)
        return self.df.groupBy(div(F.col("row"), step).cast("int").alias("y"), div(F.col("col"), step).cast("int").alias("x")).agg(state.alias("state"))

    def preview(self) -> DataFrame:
        """All frames if they are few, else the first and last five."""
        n = len(self)
        i = F.col("frame_index")
        return self.listing() if n <= PREVIEW_ALL else self.listing().where((i < PREVIEW_ENDS) | (i >= n - PREVIEW_ENDS))

    def _rows(self) -> tuple[list[str], list[list[str] | None]]:
        shown = self.preview().orderBy("frame_index").collect()
        names = [c for c in (["tile", "cell"] if self.grid.unit == "tile" else ["cell"])] + ["shape", "bytes"]
        rows: list[list[str] | None] = []
        for r in shown:
            shape = "×".join(map(str, reversed(self.grid.frame_shape(r.row, r.col))))
            rows.append([str(r.frame_index), *(r[c] for c in names[:-2]), shape, "·" if r.bytes is None else human_bytes(int(r.bytes))])
        if len(self) > PREVIEW_ALL:
            rows.insert(PREVIEW_ENDS, None)
        return names, rows

    def _facts(self) -> list[tuple[str, str]]:
        g, p = self.grid, self.progress().first()
        out = [("dtype", g.kind.name), ("tile", f"{g.tile_width} × {g.tile_length}"), ("grid", f"{g.across} × {g.down}" + (f" × {g.bands}" if g.unit == "tile" else "")), ("frames", f"{len(self):,}")]
        return out + ([("bytes", f"{human_bytes(p.nbytes)} ({p.ratio:.1f}×)")] if p.done else [])

    def __repr__(self) -> str:
        names, rows = self._rows()
        lines = [["", *names], *([["…"] * (len(names) + 1) if r is None else r for r in rows])]
        widths = [max(len(line[k]) for line in lines) for k in range(len(names) + 1)]
        facts = self._facts()
        pad = max(len(k) for k, _ in facts)
        title = f"<FrameTable ({self.grid.bands}, {self.grid.height}, {self.grid.width})>"
        return "\n".join([title, *("  ".join(c.rjust(w) for c, w in zip(line, widths, strict=True)).rstrip() for line in lines), "", *(f"  {k.ljust(pad)} : {v}" for k, v in facts)])

    def _repr_html_(self) -> str:
        names, rows = self._rows()
        cells = lambda line, tag: "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in line)
        body = "".join(f"<tr>{cells(['⋮'] * (len(names) + 1) if r is None else r, 'td')}</tr>" for r in rows)
        facts = "".join(f"<tr><th>{html.escape(k)}</th><td>{html.escape(v)}</td></tr>" for k, v in self._facts())
        states = {(s.y, s.x): s.state for s in self.completion().collect()}
        marks = "".join("<tr>" + "".join(f"<td>{'○◐●'[states[y, x]]}</td>" for x in sorted({k[1] for k in states})) + "</tr>" for y in sorted({k[0] for k in states}))
        return f"<div><table>{facts}</table><table>{marks}</table><table><tr>{cells(['', *names], 'th')}</tr>{body}</table></div>"


def _raw(values: pa.Array, kind) -> np.ndarray:
    """Samples as Spark has them, back in the type's own bytes."""
    if kind.name == "uint64":
        return values.cast(pa.uint64()).to_numpy(zero_copy_only=False).astype("<u8")
    if kind.name in ("cfloat32", "cfloat64"):
        part = f"f{kind.size // 2}"
        return (np.asarray(values.field("re")).astype(part) + 1j * np.asarray(values.field("im")).astype(part)).astype(kind.numpy)
    if kind.numpy.names:
        out = np.empty(len(values), kind.numpy)
        for f in ("re", "im"):
            out[f] = np.asarray(values.field(f))
        return out
    a = np.asarray(values)
    if kind.name == "bfloat16":
        return (a.astype("<f4").view("<u4") >> 16).astype("<u2")
    if kind.name in dtypes.SMALL_FLOATS or kind.name == "float8_e8m0":
        known = np.asarray(dtypes.small_float_values(kind.name), np.float32).view(np.uint32)
        bits, first = np.unique(known, return_index=True)
        given = np.ascontiguousarray(a.astype(np.float32)).view(np.uint32)
        at = np.minimum(np.searchsorted(bits, given), len(bits) - 1)
        if (bits[at] != given).any():
            raise ValueError(f"a sample is no {kind.name}")
        return first[at].astype(np.uint8)
    return a.astype(kind.numpy)


class Frame:
    """One frame, as it was when it was asked for."""

    def __init__(self, row: Row, table: FrameTable):
        self._row, self._table = row, table

    def __getattr__(self, name: str):
        row, table = self._row, self._table
        if name in ("index", "row", "col"):
            return row["frame_index" if name == "index" else name]
        if name == "cell":
            return f"{row['row']}.{row['col']}"
        if name in ("band", "tile") and table.grid.unit == "tile":
            return row["band"] if name == "band" else f"{row['band']}.{row['row']}.{row['col']}"
        if name == "shape":
            return table.grid.frame_shape(row["row"], row["col"])
        if name == "data":
            return np.array(row["data"]).reshape(self.shape)
        if name == "compressed":
            return None if row["payload"] is None else bytes(row["payload"])
        if name == "extras":
            return {k: row[k] for k in table.extras}
        raise AttributeError(name)
