"""Reads: these images, these bands, this window, in this axis order."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import RequestError, UnsupportedError
from ..functions import codec
from ..functions.grid import UNITS, Grid
from ..plans import layout as layouts
from ..plans.selection import Request, among, ordered, pick
from ..ship import ship
from ..sources import frames_source
from ..threads import get_parallelism
from .header import parse_header

#: Decoded bytes and frames that one task reads, about.
TASK_BYTES, TASK_FRAMES = 256 << 20, 1 << 20
FRAMEWORKS = ("numpy", "torch", "jax", "tensorflow", "tf", None)


def to_spark(values: np.ndarray, kind) -> pa.Array:
    """A decoded frame's samples as one Arrow list item."""
    if kind.name == "uint64":
        return pa.array(np.ascontiguousarray(values).astype(np.uint64)).cast(pa.decimal128(20, 0))
    if values.dtype.names:
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(values[f].astype(np.float32) if values[f].dtype == np.float16 else values[f])) for f in ("re", "im")], ["re", "im"])
    arrow = {"smallint": pa.int16(), "tinyint": pa.int8(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}[kind.spark]
    return pa.array(np.ascontiguousarray(values)).cast(arrow)


def decoded(frames: DataFrame, grid: Grid) -> DataFrame:
    """Frames with `data` in place of `payload`; sizes are what the grid says, not what payloads claim."""
    ship(frames.sparkSession)
    kind = grid.kind
    names = [c for c in frames.columns if c not in ("payload", "h", "w")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # A frame's samples are as many as its shape says; a batch of frames holds a bounded number of bytes.
            shapes = [int(np.prod(grid.frame_shape(r, c))) * max(kind.size, 4) for r, c in zip(whole.column("row").to_pylist(), whole.column("col").to_pylist(), strict=True)]
            for start, stop in frames_source.by_bytes(shapes):
                yield opened(whole.slice(start, stop - start))

    def opened(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists, h, w, lengths = [], [], [], [0]
        for row, col, payload in zip(*(batch.column(c).to_pylist() for c in ("row", "col", "payload")), strict=True):
            shape = grid.frame_shape(row, col)
            values = kind.values(codec.decode(payload, kind, int(np.prod(shape))))
            lists.append(to_spark(values, kind))
            lengths.append(lengths[-1] + len(values))
            h.append(shape[-2])
            w.append(shape[-1])
        data = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.concat_arrays(lists))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(h, pa.int32()), pa.array(w, pa.int32()), data], [*names, "h", "w", "data"])

    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    return frames.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + f", h int, w int, data array<{kind.spark}>")


def grid_of(images: DataFrame) -> tuple[Grid, int]:
    """The grid that all images share, and how many there are; an image that differs is an error.

    Headers that are alike up to their counts are one row, so what reaches the driver is one row per kind of image.
    """
    record = F.substring("header", 1, 23)
    rows = images.groupBy(record.alias("record")).agg(F.count(F.lit(1)).alias("images"), F.min("n").alias("n"), F.min_by("header", "n").alias("header")).orderBy("n").limit(3).collect()
    if not rows:
        raise ValueError("there are no images")
    first = parse_header(bytes(rows[0].header)).grid
    for r in rows[1:]:
        if why := frames_source.fits(first, parse_header(bytes(r.header)).grid):
            raise RequestError(f"image {r.n}: {why}")
    return first, images.count()


class Prepared(NamedTuple):
    """A checked read: what is selected, how the result is laid out, and the frames with their payloads."""

    grid: Grid
    chosen: list[int] | range | None
    picked: int
    request: Request
    pattern: str
    plan: layouts.Layout
    units: list[Grid]
    loaded: DataFrame

    def of(self, g: Grid) -> DataFrame:
        """The frames of one unit."""
        return self.loaded if len(self.units) < 2 else self.loaded.where(F.col("band").isNull() if g.unit == "cell" else F.col("band").isNotNull())


def prepare(images: DataFrame, n=None, b=None, y=None, x=None, pattern: str | None = None, strict: bool = True) -> Prepared:
    missing = {"header"} - set(images.columns)
    if missing or not {"path", "content"} & set(images.columns):
        raise ValueError("a catalog has a header, and a path or content")
    single = "n" not in images.columns
    if single:
        if n is not None:
            raise ValueError("n selects from a list of images")
        images = images.withColumn("n", F.lit(0).cast("bigint"))
    grid, total = grid_of(images)
    if single and total > 1:
        raise ValueError("several images need numbers n")
    chosen = pick(n, "n", total)
    request = Request.of(grid, b, y, x)
    if strict and grid.kind.bits < 8 and (request.y, request.x) != ((0, grid.height), (0, grid.width)):
        raise RequestError(f"{grid.kind.name} is read by whole images only")
    picked = len(chosen) if chosen is not None else total
    pattern = pattern if pattern is not None else layouts.default_pattern(picked)
    plan = layouts.compile_layout(pattern, picked, *request.extent)
    images = among(images, "n", chosen)
    frames = frames_source.planned(images, b, y, x)
    # Frames of all images are one bag of work, dealt evenly before their payloads are read, into tasks of a bounded size.
    count, samples = frames_source.wanted(images, b, y, x)
    tasks = max(get_parallelism(images.sparkSession), -(-samples * max(grid.kind.size, 4) // TASK_BYTES), -(-count // TASK_FRAMES))
    frames = frames.repartition(max(1, min(tasks, count)), "n", "frame_index")
    # The unit may differ between images that are stacked; it decides what a frame holds.
    kinds = [r[0][0] for r in images.select(F.substring("header", 23, 1)).distinct().collect()]
    units = [Grid(grid.bands, grid.height, grid.width, grid.tile_width, grid.tile_length, UNITS[k], grid.kind) for k in sorted(kinds)]
    return Prepared(grid, chosen, picked, request, pattern, plan, units, frames_source.payloads(frames))


def read(images: DataFrame, *, n=None, b=None, y=None, x=None, pattern: str | None = None, output: str = "pixels", strict: bool = True) -> DataFrame:
    """Reads from a catalog: rows with `header` and `path` or `content`, and `n`, the image's number from 0 (none: one image).

    n, b: None, (start, stop) or a list whose order and repeats hold. y, x: None or (start, stop).
    pattern: axis order of the result, by default "b y x", or "n b y x" if several images are selected.
    output: "pixels" (n, b, y, x, pos, v), "frames" (decoded frames that intersect), or "tensor" (one row: shape, data).
    strict: types of less than a byte are read whole images at a time, as their frames cannot be cut elsewhere.
    """
    from .pixels import place, position

    if output not in ("pixels", "frames", "tensor"):
        raise ValueError(f"output must be pixels, frames or tensor, not {output!r}")
    r = prepare(images, n, b, y, x, pattern, strict)
    opened = [(g, decoded(r.of(g), g)) for g in r.units]
    if output == "frames":
        return reduce(DataFrame.unionByName, [data for _, data in opened])
    pixels = reduce(DataFrame.unionByName, [place(data.withColumnRenamed("n", "image"), Request(g, r.request.bands, r.request.y, r.request.x), ["image"]) for g, data in opened])
    pixels = ordered(pixels, "image", r.chosen, "n").drop("image")
    pixels = pixels.select("n", "b", "y", "x", position(r.plan, F.col("n")).alias("pos"), "v")
    return pixels if output == "pixels" else tensor(pixels, r.plan)


def cropped(frames: DataFrame, request: Request) -> DataFrame:
    """What a request takes of each frame as raw samples: (n, band, y, x, h, w, raw), places counted from its origin."""
    grid, kind = request.grid, request.grid.kind
    (y0, y1), (x0, x1) = request.y, request.x
    some = np.array(sorted(set(request.all_bands)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, band, row, col, payload in zip(*(batch.column(c).to_pylist() for c in ("n", "band", "row", "col", "payload")), strict=True):
                shape = grid.frame_shape(row, col)
                data = codec.decode(payload, kind, int(np.prod(shape))).reshape(shape)
                top, left = row * grid.tile_length - y0, col * grid.tile_width - x0
                data = data[..., max(0, -top) : y1 - y0 - top, max(0, -left) : x1 - x0 - left]
                data = data[some] if grid.unit == "cell" else data
                rows.append((n, band, max(0, top), max(0, left), data.shape[-2], data.shape[-1], data.tobytes()))
                if sum(len(r[-1]) for r in rows) > frames_source.BATCH_BYTES:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["n", "band", "y", "x", "h", "w", "raw"])

    return frames.mapInArrow(run, "n long, band int, y long, x long, h long, w long, raw binary")


def dense(images: DataFrame, *, n=None, b=None, y=None, x=None, pattern: str | None = None, strict: bool = True) -> np.ndarray:
    """A read as an array on the driver, put together from frames that executors have opened and cut."""
    r = prepare(images, n, b, y, x, pattern, strict)
    kind = r.grid.kind
    numbers = r.chosen if r.chosen is not None else range(r.picked)
    where: dict[int, list[int]] = {}
    for i, number in enumerate(numbers):
        where.setdefault(number, []).append(i)
    bands = list(r.request.all_bands)
    some = sorted(set(bands))
    out = np.empty((r.picked, *r.request.extent), kind.numpy)
    for g in r.units:
        for row in cropped(r.of(g), Request(g, r.request.bands, r.request.y, r.request.x)).toLocalIterator(prefetchPartitions=True):
            data = np.frombuffer(row.raw, kind.numpy).reshape(-1, row.h, row.w)
            for j, band in enumerate(bands):
                if row.band is None or row.band == band:
                    plane = data[some.index(band) if row.band is None else 0]
                    for i in where[row.n]:
                        out[i, j, row.y : row.y + row.h, row.x : row.x + row.w] = plane
    axes = "".join(layouts.groups(r.pattern))
    order = [layouts.AXES.index(a) for a in axes]
    if "n" not in axes:
        out, order = out[0], [k - 1 for k in order]
    return np.ascontiguousarray(out.transpose(order)).reshape(r.plan.shape)


def tensor(pixels: DataFrame, plan: layouts.Layout, most: int = 1 << 27) -> DataFrame:
    """One row: shape, and data in the layout's order. For results that fit one row; `most` samples at most."""
    if plan.size > most:
        raise RequestError(f"the result has {plan.size} samples; a row holds {most}")
    data = F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"])
    return pixels.agg(data.alias("data")).select(F.array(*[F.lit(s).cast("bigint") for s in plan.shape]).alias("shape"), "data")


def export(row, kind, framework: str | None = "numpy"):
    """A tensor row as a framework's array."""
    if framework not in FRAMEWORKS:
        raise ValueError(f"framework must be one of {FRAMEWORKS}")
    if framework is None:
        return row
    values = [v["re"] + 1j * v["im"] for v in row["data"]] if kind.sample_format in (5, 6) else row["data"]
    # 64-bit unsigned numbers come as decimals.
    array = np.array([int(v) for v in values], np.uint64) if kind.name == "uint64" else np.array(values)
    if kind.sample_format in (1, 2) and kind.bits >= 8:
        array = array.astype(kind.numpy)
    elif kind.sample_format == 3:
        array = array.astype(kind.numpy)
    return framed(array.reshape(row["shape"]), framework)


def framed(array: np.ndarray, framework: str):
    """An array as a framework's own."""
    if framework not in FRAMEWORKS:
        raise ValueError(f"framework must be one of {FRAMEWORKS}")
    try:
        if framework == "torch":
            import torch

            return torch.from_numpy(array)
        if framework == "jax":
            import jax.numpy

            return jax.numpy.asarray(array)
        if framework in ("tensorflow", "tf"):
            import tensorflow

            return tensorflow.constant(array)
    except ImportError:
        raise UnsupportedError(f"{framework} is not installed") from None
    return array


def to_numpy(images: DataFrame, framework: str | None = "numpy", **selection):
    """A read as an array on the driver."""
    first = images.withColumn("n", F.lit(0)) if "n" not in images.columns else images
    kind = grid_of(first)[0].kind
    if kind.sample_format == 5:
        raise UnsupportedError(f"numpy has no type for {kind.name}")
    if framework is not None and (kind.sample_format in (1, 2) and kind.bits >= 8 or kind.sample_format == 3):
        return framed(dense(images, **selection), framework)
    return export(read(images, output="tensor", **selection).first(), kind, framework)


def into(images: DataFrame, out: np.ndarray, **selection) -> np.ndarray:
    """Reads into a given array of the right size and type."""
    got = to_numpy(images, **selection)
    if out.size != got.size or out.dtype != got.dtype:
        raise ValueError(f"the array must have {got.size} samples of {got.dtype}")
    out.reshape(-1)[:] = got.reshape(-1)
    return out


def ranges(images: DataFrame, b=None, y=None, x=None) -> DataFrame:
    """Byte ranges that a request needs, without opening anything: (n, ordinal of the band, frame_index, offset, length).

    In frame order for each requested band, repeats kept, neighbours not joined; of a cell one range per position.
    """
    grid, _ = grid_of(images)
    request = Request.of(grid, b, y, x)
    found = frames_source.planned(images.select("n", "header"), b, y, x)
    if grid.unit == "cell":
        return found.select("n", F.lit(0).alias("ordinal"), "frame_index", "offset", "length")
    return ordered(found, "band", request.bands, "ordinal").select("n", "ordinal", "frame_index", "offset", "length")
