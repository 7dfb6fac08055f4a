"""Writing containers: one from a frame table, or many from a DataFrame of frames."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..errors import FormatError
from ..functions import geo
from ..functions.grid import Grid
from ..ship import ship
from .container import FrameWriter, Geo, write_file
from .scratch import remove, spark_folder


def write(path, table, *, transform=None, crs=None, pixel_is_point: bool = False, known: geo.Ranges = geo.KNOWN):
    """Writes a frame table whose frames all have payloads; returns (path, header).

    Frames are made once, into the shared folder, and come from there to the driver one partition at a time, straight
    into the file; to write many images on executors, use `write_images`.
    """
    spark = table.df.sparkSession
    kept = f"{spark_folder(spark)}/frames-{uuid.uuid4().hex}"
    rows = table.df.select("frame_index", "payload")
    rows.write.option("compression", "none").parquet(kept)
    try:
        rows = spark.read.schema(rows.schema).parquet(kept)
        if rows.where("payload IS NULL").limit(1).count():
            raise ValueError("some frames have no payload yet")
        payloads = (bytes(r.payload) for r in rows.orderBy("frame_index").toLocalIterator(prefetchPartitions=True))
        return path, write_file(path, table.grid, payloads, None, Geo.of(transform, crs, pixel_is_point), known)
    finally:
        remove(spark, kept)


def write_frames(path, payloads: list[bytes], grid: Grid, *, transform=None, crs=None, pixel_is_point: bool = False, known: geo.Ranges = geo.KNOWN) -> bytes:
    """Writes payloads in frame order; returns the header."""
    return write_file(path, grid, payloads, None, Geo.of(transform, crs, pixel_is_point), known)


class _Images:
    """Containers from rows that come sorted by image and frame index; one frame is held at a time."""

    def __init__(self, folder: str, grid: Grid, place: Geo = Geo()):
        self.folder, self.grid, self.place = folder, grid, place
        self.image, self.out = None, None

    def add(self, n: int, i: int, payload: bytes | None) -> tuple | None:
        """Takes a frame; returns (n, path, header) of an image that is thereby complete."""
        done = self.close() if n != self.image else None
        if self.out is None:
            os.makedirs(self.folder, exist_ok=True)
            self.image, self.out = n, FrameWriter(os.path.join(self.folder, f"{n}.frames"), self.grid, self.place)
        if i != len(self.out.counts) or payload is None or i >= self.grid.frames:
            self.out.drop()
            raise FormatError(f"image {n} does not have each of its {self.grid.frames} frames once: {i} comes where {len(self.out.counts)} is due, or has no payload")
        self.out.add(payload)
        return done

    def close(self) -> tuple | None:
        if self.out is None:
            return None
        out, self.out = self.out, None
        if len(out.counts) != self.grid.frames:
            out.drop()
            raise FormatError(f"image {self.image} does not have each of its {self.grid.frames} frames once: it has {len(out.counts)}")
        return self.image, out.path, out.finish()


def write_images(frames: DataFrame, folder: str, grid: Grid, image: str = "n", **where) -> DataFrame:
    """Writes one container per image into a folder that all executors share: rows (n, path, header).

    frames: image, frame_index and payload. Images are dealt to tasks, which write them frame by frame.
    """
    ship(frames.sparkSession)
    place = Geo.of(**where)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        images = _Images(folder, grid, place)
        done = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                done.append(images.add(*row))
        done.append(images.close())
        done = [d for d in done if d]
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.binary())], ["n", "path", "header"])

    rows = frames.selectExpr(f"cast({image} as bigint) as n", "cast(frame_index as bigint) as frame_index", "payload")
    return rows.repartition("n").sortWithinPartitions("n", "frame_index").mapInArrow(run, "n bigint, path string, header binary")


class ContainerSink(DataSource):
    """df.write.format("containers"): rows (n, frame_index, payload), dealt and sorted by n and frame_index.

    Options: path (a shared folder) and the grid's bands, height, width, tile_width, tile_length, unit, dtype.
    """

    @classmethod
    def name(cls) -> str:
        return "containers"

    def schema(self) -> str:
        return "n bigint, frame_index bigint, payload binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ContainerWriter(dict(self.options))


class ContainerWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        o = {k.lower(): v for k, v in options.items()}
        self.folder = o["path"]
        self.grid = Grid(*(int(o[k]) for k in ("bands", "height", "width", "tile_width", "tile_length")), o.get("unit", "tile"), o.get("dtype", "uint16"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        images = _Images(self.folder, self.grid)
        for batch in iterator:
            for row in zip(*(batch.column(c).to_pylist() for c in ("n", "frame_index", "payload")), strict=True):
                images.add(*row)
        images.close()
        return WriterCommitMessage()
