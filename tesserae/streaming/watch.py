"""New container files as a stream. An addition of this engine: images arrive, their headers become rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FormatError
from ..operators.header import parse_header
from ..ship import ship
from ..sources.container import Reader, index

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def watch(spark: SparkSession, folder: str, suffix: str = ".frames") -> DataFrame:
    """A stream of (path, header, frames, problem): each file of a folder once, as it appears.

    Files that break the format come with what is wrong and no header, so that one bad file stops nothing.
    """
    ship(spark)
    files = spark.readStream.schema(FILES).format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    header = index(Reader(content))[0]
                    rows.append((path, header, parse_header(header).grid.frames, None))
                except FormatError as e:
                    rows.append((path, None, None, str(e)))
            kinds = (pa.string(), pa.binary(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["path", "header", "frames", "problem"])

    return files.select(F.col("path"), F.col("content")).mapInArrow(run, "path string, header binary, frames bigint, problem string")
