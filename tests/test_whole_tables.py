"""Queries against their SQL on tables whose frames are very many, empty, or do not fill the grid."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tesserae.functions.grid import Grid
from tesserae.operators import header as H
from tesserae.queries import QUERIES, SQL
from tesserae.sources import frames_source

from .test_queries import plain


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got = QUERIES[name](spark, str(folder))
    picked = ", ".join(f'"{c}"' for c in sorted(got.columns))
    rows = sorted((tuple(map(plain, r)) for r in got.select(*sorted(got.columns)).collect()), key=str)
    assert rows == sorted((tuple(map(plain, r)) for r in con.sql(f"SELECT {picked} FROM ({SQL[name]})").fetchall()), key=str)
    return rows


class Captured:
    """Images whose plan runs here, so that its memory can be seen."""

    def __init__(self, spark):
        self.sparkSession, self.columns, self.schema = spark, ["n", "header"], spark.createDataFrame([], "n bigint, header binary").schema

    def mapInArrow(self, run, schema):
        return run


def test_a_plan_of_many_frames_does_not_repeat_the_header(spark):
    counts = np.random.default_rng(0).integers(1, 1 << 17, 16_000)
    blob = H.encode_header(Grid(1, 1, len(counts), 1, 1, "tile", "uint8"), counts)
    batch = pa.RecordBatch.from_arrays([pa.array([7], pa.int64()), pa.array([blob], pa.binary())], ["n", "header"])
    before, most, found = pa.total_allocated_bytes(), 0, []
    for planned in frames_source.planned(Captured(spark))(iter([batch])):
        most = max(most, pa.total_allocated_bytes() - before)
        found += planned.column("length").to_pylist()
        assert set(planned.column("n").to_pylist()) == {7}
    assert found == counts.tolist()
    assert most < 64 << 20


def test_counts_in_chunks():
    counts = np.random.default_rng(1).integers(1, 1 << 13, 3 * H.CHUNK + 5)
    least, bits, packed = H.pack_counts(counts)
    assert np.array_equal(H.unpack_counts(least, bits, packed, len(counts)), counts)


def documents(folder, texts):
    pq.write_table(pa.table({"doc_id": range(len(texts)), "source": [f"src{i % 11}" for i in range(len(texts))], "text": texts}), folder / "documents.parquet")


@pytest.mark.parametrize("name", ["h4_parsed_headers", "r6_byte_ranges", "h6_counts_from_headers", "h12_header_facts", "s8_catalog", "s4_truncated_images"])
def test_empty_documents_are_frames(spark, tmp_path, name):
    documents(tmp_path, ["" if i % 7 == 3 else "ab\u00e9" * (i % 50) + "c" for i in range(300)])
    assert same_as_sql(spark, tmp_path, name)


def test_an_empty_frame_of_a_container_is_still_refused():
    blob = H.RECORD.pack(H.MAGIC, H.VERSION, 1, 1, 1, 1, 1, 8, 1, 0, 0, 0)
    assert H.parse_header(blob, empty=True).end == H.parse_header(blob, empty=True).grid.base
    with pytest.raises(H.HeaderError, match="a frame of no bytes"):
        H.parse_header(blob)


def test_more_frames_than_an_index_from_elsewhere_may_list():
    counts = np.arange(5_592_406) % 7 + 1
    blob = H.encode_header(Grid(1, 1, len(counts), 1, 1, "tile", "uint8"), counts)
    with pytest.raises(H.HeaderError, match="more frames than the safety limit"):
        H.parse_header(blob)
    assert np.array_equal(H.parse_header(blob, most=None).counts, counts)


@pytest.mark.parametrize("name", ["r1_read_a_window", "r9_cells_opened_once"])
@pytest.mark.parametrize("vectors", [406, 431, 450])
def test_vectors_that_end_within_a_row(spark, tmp_path, name, vectors):
    """A last row of 6 of 25, in a tile of its own or not, and whole rows, with a place in the middle that no vector has."""
    ids = [i for i in range(vectors) if i != 107]
    values = np.random.default_rng(2).normal(size=(len(ids), 64)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": ids, "embedding": pa.array(list(values), pa.list_(pa.float32())), "label": ids}), tmp_path / "embeddings.parquet")
    assert same_as_sql(spark, tmp_path, name)
