"""Scans: headers of container files, and frame payloads read late and by position.

Python sources are read whole, so there are two: the index never touches payloads, and
payloads are read only for the frames that a plan has left.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import FormatError
from ..functions.grid import MAX_LISTED, Grid
from ..operators.header import parse_header
from ..ship import ship
from .container import Reader, index

INDEX_SCHEMA = "path string, header binary, transform array<double>, epsg int, pixel_is_point boolean"
INDEX_ARROW = pa.schema([("path", pa.string()), ("header", pa.binary()), ("transform", pa.list_(pa.float64())), ("epsg", pa.int32()), ("pixel_is_point", pa.bool_())])


def _indexed(path: str, source) -> pa.RecordBatch:
    with Reader(source) as read:
        header, where = index(read)
    values = [path, header, None if where.transform is None else list(where.transform), where.epsg, where.point]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, INDEX_ARROW, strict=True)], schema=INDEX_ARROW)


class ContainerIndex(DataSource):
    """spark.read.format("container_index").load(folder): one row per container in the folder or below it, payloads unread."""

    @classmethod
    def name(cls) -> str:
        return "container_index"

    def schema(self) -> str:
        return INDEX_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return IndexReader(self.options["path"], self.options.get("suffix", ".frames"))


class IndexReader(DataSourceReader):
    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path, suffix

    def partitions(self) -> list[InputPartition]:
        if os.path.isdir(self.path):
            files = sorted(os.path.join(top, name) for top, _, names in os.walk(self.path) for name in names if name.endswith(self.suffix))
        else:
            files = [self.path]
        step = max(32, -(-len(files) // 1000))
        return [InputPartition(files[i : i + step]) for i in range(0, len(files), step)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for path in partition.value:
            yield _indexed(path, path)


def register(spark: SparkSession) -> None:
    """Makes the formats "container_index" and "containers" known to a session."""
    from .writer import ContainerSink

    ship(spark)
    spark.dataSource.register(ContainerIndex)
    spark.dataSource.register(ContainerSink)


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Containers of a folder that all executors share: path, header and georeferencing. Give them numbers n from 0 to read them as a stack."""
    register(spark)
    return spark.read.format("container_index").load(folder)


def catalog_from_bytes(spark: SparkSession, path: str) -> DataFrame:
    """The same for any store that Spark reads: whole files as rows with `content`."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.frames").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = _indexed(p, content)
                yield pa.RecordBatch.from_arrays([*found.columns, pa.array([content], pa.binary())], [*found.schema.names, "content"])

    return files.mapInArrow(run, INDEX_SCHEMA + ", content binary")


def truncated(images: DataFrame, size: str = "size", data_end: str = "data_end") -> DataFrame:
    """The images whose data ends beyond their file, whatever a query asks of them."""
    return images.where(F.col(data_end) > F.col(size))


def substring(content, offset, length):
    """Bytes of a content column by position."""
    return F.substring(content, (offset + 1).cast("int"), length.cast("int"))


#: Frames that one batch of a plan lists, and bytes of payloads that one batch holds, at most (a larger payload stands alone).
BATCH_FRAMES, BATCH_BYTES = 1 << 16, 16 << 20


def by_bytes(sizes: list[int], most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows of at most `most` bytes together, or of one row."""
    at, total = 0, 0
    for i, size in enumerate(sizes):
        if i > at and total + size > most:
            yield at, i
            at, total = i, 0
        total += size
    if at < len(sizes):
        yield at, len(sizes)


def wanted(images: DataFrame, b=None, y=None, x=None) -> tuple[int, int]:
    """How many frames a request needs of all images, and how many samples those hold at most; two sums reach the driver."""
    from ..plans.selection import Request

    ship(images.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frames, samples = 0, 0
            for blob in batch.column(0).to_pylist():
                g = parse_header(bytes(blob)).grid
                r = Request.of(g, b, y, x)
                spots = (r.rows[1] - r.rows[0]) * (r.cols[1] - r.cols[0])
                n = spots * (len(set(r.all_bands)) if g.unit == "tile" else 1)
                frames += n
                samples += n * g.tile_length * g.tile_width * (1 if g.unit == "tile" else g.bands)
            yield pa.RecordBatch.from_arrays([pa.array([frames], pa.int64()), pa.array([float(samples)])], ["frames", "samples"])

    row = images.select("header").mapInArrow(run, "frames long, samples double").agg(F.sum("frames"), F.sum("samples")).first()
    return row[0] or 0, int(row[1] or 0)


def planned(images: DataFrame, b=None, y=None, x=None, empty: bool = False, most: int | None = MAX_LISTED) -> DataFrame:
    """The frames that a request needs of each image: (n, frame_index, row, col, band, offset, length), payloads unread.

    images: n and header, and whatever the payload reader needs; empty, most: as for `parse_header`. Headers are parsed and
    pruned in one step, so frames outside the window never become rows; an image's frames
    come in batches, so that memory does not grow with their number.
    """
    from ..plans.selection import Request

    ship(images.sparkSession)
    names = [c for c in images.columns if c != "header"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, blob in enumerate(batch.column("header").to_pylist()):
                h = parse_header(bytes(blob), empty, most)
                g, end = h.grid, h.end
                r = Request.of(g, b, y, x)
                (r0, r1), (c0, c1) = r.rows, r.cols
                among = np.array(sorted(set(r.all_bands))) if g.unit == "tile" else np.zeros(1, np.int64)
                starts = h.starts()
                total, across = (r1 - r0) * (c1 - c0) * len(among), c1 - c0
                own = [batch.column(c).slice(i, 1) for c in names]  # without the header, which may be large
                step = max(1, min(BATCH_FRAMES, BATCH_BYTES // max(1, sum(v.nbytes for v in own))))
                for a in range(0, total, step):
                    k = np.arange(a, min(a + step, total))
                    spot, band = k // len(among), among[k % len(among)]
                    row, col = r0 + spot // across, c0 + spot % across
                    at = (row * g.across + col) * g.per_position + band
                    bands = pa.array(band, pa.int32()) if g.unit == "tile" else pa.nulls(len(k), pa.int32())
                    first = pa.array(np.zeros(len(k), np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [*(v.take(first) for v in own), pa.array(at, pa.int64()), pa.array(row, pa.int32()), pa.array(col, pa.int32()), bands, pa.array(h.offset(at, starts), pa.int64()), pa.array(h.count(at), pa.int64()), pa.array(np.full(len(k), end), pa.int64())],
                        [*names, "frame_index", "row", "col", "band", "offset", "length", "data_end"],
                    )

    kinds = {f.name: f.dataType.simpleString() for f in images.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", frame_index bigint, row int, col int, band int, offset bigint, length bigint, data_end bigint"
    return images.mapInArrow(run, schema)


def payloads(frames: DataFrame) -> DataFrame:
    """Adds `payload` to planned frames, from `content` where there is some, else from the file at `path`."""
    ship(frames.sparkSession)
    names = [c for c in frames.columns if c != "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in by_bytes(whole.column("length").to_pylist()):
                yield loaded(whole.slice(a, b - a))

    def loaded(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        content = batch.column("content").to_pylist() if "content" in batch.schema.names else [None] * n
        path = batch.column("path").to_pylist() if "path" in batch.schema.names else [None] * n
        out, source, now = [], None, None
        for p, c, o, size, end in zip(path, content, *(batch.column(k).to_pylist() for k in ("offset", "length", "data_end")), strict=True):
            key = c if c is not None else p
            if key is not now:
                if source:
                    source.close()
                source, now = Reader(key), key
            if end > source.size:
                raise FormatError(f"{p or 'the content'} is cut short: it has {source.size} of {end} bytes")
            out.append(source.at(o, size))
        if source:
            source.close()
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.binary())], [*names, "payload"])

    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    return frames.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", payload binary")


def fits(grid: Grid, other: Grid) -> str | None:
    """What two images that are to be stacked differ in, if anything; the frame unit may differ."""
    for what, a, b in (("size", (grid.height, grid.width), (other.height, other.width)), ("tile size", (grid.tile_length, grid.tile_width), (other.tile_length, other.tile_width)), ("band count", grid.bands, other.bands), ("sample type", grid.kind, other.kind)):
        if a != b:
            return f"{what} differs: {a} and {b}"
    return None
