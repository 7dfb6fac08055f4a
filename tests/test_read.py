import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import tesserae
from tesserae.errors import RequestError, UnsupportedError
from tesserae.functions import dtypes
from tesserae.functions.grid import Grid
from tesserae.operators import header as H
from tesserae.operators import pixels as P
from tesserae.operators import read as R
from tesserae.plans.selection import Request, among, ordered, pick
from tesserae.sources import frames_source, writer

NORTH_UP = (30.0, 0.0, 500000.0, 0.0, -30.0, 8000000.0)


def stored(spark, folder, arrays, tile=32, unit="tile", recipe="zlib"):
    """A catalog of arrays written as containers."""
    rows = []
    for i, a in enumerate(arrays):
        table = tesserae.frames(a, tile, unit if isinstance(unit, str) else unit[i], spark).compress(recipe)
        path, header = tesserae.write(str(folder / f"{i}.frames"), table, transform=NORTH_UP, crs=32718)
        rows.append((i, path, bytearray(header)))
    return spark.createDataFrame(rows, "n bigint, path string, header binary")


@pytest.fixture(scope="module")
def scene(spark, tmp_path_factory):
    data = np.random.default_rng(0).integers(0, 3000, (3, 100, 130)).astype(np.uint16)
    return data, stored(spark, tmp_path_factory.mktemp("scene"), [data], 32, recipe="delta>zigzag>zlib").cache()


@pytest.mark.parametrize("selection", [{}, {"b": [1]}, {"b": (0, 2), "y": (30, 70), "x": (20, 90)}, {"b": [2, 0, 2], "y": (99, 100)}, {"x": (0, 1), "pattern": "x (y b)"}])
def test_window_equals_slice(scene, selection):
    data, images = scene
    b = selection.get("b")
    bands = list(range(3)) if b is None else list(range(*b)) if isinstance(b, tuple) else b
    want = data[bands, slice(*selection.get("y", (0, 100))), slice(*selection.get("x", (0, 130)))]
    if "pattern" in selection:
        want = want.transpose(2, 1, 0).reshape(want.shape[2], -1)
    got = R.to_numpy(images, **selection)
    assert got.dtype == np.uint16
    assert np.array_equal(got, want)


@pytest.mark.parametrize("bands", [[0], [4], [0, 4], [4, 3, 2, 1, 0], [2, 2], [0, 0, 3], [0, 1, 2, 3, 4]])
def test_cell_frames_deal_bands_in_order(spark, tmp_path, bands):
    data = np.random.default_rng(1).integers(0, 3000, (5, 50, 66)).astype(np.uint16)
    images = stored(spark, tmp_path, [data], 32, "cell")
    assert np.array_equal(R.to_numpy(images, b=bands, y=(10, 40), x=(20, 60)), data[bands, 10:40, 20:60])


def test_stack_with_mixed_units_and_repeats(spark, tmp_path):
    arrays = [np.random.default_rng(i).integers(0, 500, (4, 64, 40)).astype(np.int16) for i in range(3)]
    images = stored(spark, tmp_path, arrays, 32, ["tile", "cell", "tile"])
    cube = np.stack(arrays)
    assert np.array_equal(R.to_numpy(images, n=[2, 1, 1], b=[3, 0], y=(5, 50), pattern="n y x b"), cube[[2, 1, 1]][:, [3, 0], 5:50].transpose(0, 2, 3, 1))
    assert R.to_numpy(images, n=[1]).shape == (4, 64, 40)  # one selected image has no n axis
    assert R.to_numpy(images).shape == (3, 4, 64, 40)


def test_stack_must_share_a_grid(spark, tmp_path):
    images = stored(spark, tmp_path, [np.zeros((1, 8, 8), np.uint8), np.zeros((1, 8, 9), np.uint8)], 4)
    with pytest.raises(RequestError, match="image 1: size"):
        R.read(images)


def test_memory_source_and_truncation(spark, tmp_path):
    data = np.arange(2 * 20 * 20, dtype=np.uint16).reshape(2, 20, 20)
    row = stored(spark, tmp_path, [data], 8).first()
    content = open(row.path, "rb").read()
    whole = spark.createDataFrame([(0, bytearray(content), row.header)], "n bigint, content binary, header binary")
    assert np.array_equal(R.to_numpy(whole, y=(3, 9)), data[:, 3:9])
    short = spark.createDataFrame([(0, bytearray(content[:-1]), row.header)], "n bigint, content binary, header binary")
    with pytest.raises(Exception, match="cut short"):
        R.read(short, y=(0, 1), x=(0, 1)).count()


def test_planned_ranges_are_all_that_is_read(spark, scene, tmp_path):
    data, images = scene
    row = images.first()
    content = open(row.path, "rb").read()
    found = R.ranges(images, b=[0], y=(0, 32), x=(0, 32)).collect()
    sparse = bytearray(len(content))
    for r in found:
        sparse[r.offset : r.offset + r.length] = content[r.offset : r.offset + r.length]
    assert sum(r.length for r in found) < len(content) / 4
    holes = spark.createDataFrame([(0, sparse, row.header)], "n bigint, content binary, header binary")
    assert np.array_equal(R.to_numpy(holes, b=[0], y=(0, 32), x=(0, 32)), data[:1, :32, :32])


def test_ranges_keep_repeats_and_are_not_joined(spark, tmp_path):
    images = stored(spark, tmp_path, [np.zeros((2, 64, 64), np.uint16)], 16)
    assert R.ranges(images, b=[0], y=(10, 20), x=(10, 20)).count() == 4
    assert R.ranges(images, b=[1, 1], y=(10, 20), x=(10, 20)).count() == 8
    assert R.ranges(images).count() == 32


def test_catalogs(spark, tmp_path):
    stored(spark, tmp_path, [np.zeros((1, 8, 8), np.uint8), np.ones((1, 8, 8), np.uint8)], 4)
    for found in (frames_source.catalog(spark, str(tmp_path)), frames_source.catalog_from_bytes(spark, str(tmp_path))):
        rows = found.orderBy("path").collect()
        assert [r.epsg for r in rows] == [32718, 32718]
        assert tuple(rows[0].transform) == NORTH_UP


def test_argument_errors(scene):
    _, images = scene
    one = images.drop("n")
    for bad, error in (({"y": [0, 5]}, TypeError), ({"y": (5, 5)}, ValueError), ({"y": (0, 101)}, ValueError), ({"b": [-1]}, ValueError), ({"b": (0, 1, 2)}, ValueError), ({"b": 1}, TypeError), ({"pattern": "b y"}, ValueError), ({"n": [0]}, ValueError)):
        with pytest.raises(error):
            R.read(one, **bad)
    with pytest.raises(ValueError):
        R.to_numpy(one, framework="excel")


def test_sub_byte_types_are_read_whole(spark, tmp_path):
    from tesserae.functions import codec
    from tesserae.functions.grid import Grid
    from tesserae.sources.writer import write_frames

    grid = Grid(2, 4, 4, 4, 4, "tile", "uint4")
    data = np.arange(32, dtype=np.uint8).reshape(2, 4, 4) % 16
    header = write_frames(tmp_path / "a.frames", [codec.encode(p, grid.kind) for p in data], grid)
    images = spark.createDataFrame([(str(tmp_path / "a.frames"), bytearray(header))], "path string, header binary")
    assert np.array_equal(R.to_numpy(images, b=[1]), data[[1]])
    with pytest.raises(RequestError):
        R.read(images, y=(0, 2))
    assert R.read(images, y=(0, 2), strict=False).count() == 16


@pytest.mark.parametrize("name", ["uint8", "int8", "uint16", "int16", "uint32", "int32", "uint64", "int64", "float16", "float32", "float64", "complex64", "complex128"])
def test_every_numpy_type_survives(spark, tmp_path, name):
    rng = np.random.default_rng(3)
    data = rng.integers(0, 255, (1, 20, 20)).astype(name) if name[0] in "ui" else rng.standard_normal((1, 20, 20)).astype(name)
    if name[0] in "ui":
        data[0, 0, :2] = np.iinfo(name).min, np.iinfo(name).max
    images = stored(spark, tmp_path, [data], 16, recipe="delta>zigzag>zstd")
    assert np.array_equal(R.to_numpy(images), data)


def test_foreign_payloads_are_refused(spark, tmp_path):
    from tesserae.functions.grid import Grid
    from tesserae.sources.writer import write_frames

    header = write_frames(tmp_path / "a.frames", [b"\x01\x02\x03\x04\x05"], Grid(1, 4, 4, 4, 4))
    images = spark.createDataFrame([(str(tmp_path / "a.frames"), bytearray(header))], "path string, header binary")
    with pytest.raises(Exception, match="not available"):
        R.read(images).count()
    with pytest.raises(UnsupportedError):
        dtypes.numpy_dtype("uint4")


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.data())
def test_read_equals_numpy(spark, tmp_path_factory, data):
    draw = data.draw
    bands, height, width = draw(st.integers(1, 3)), draw(st.integers(1, 20)), draw(st.integers(1, 20))
    array = np.random.default_rng(draw(st.integers(0, 99))).integers(-99, 99, (bands, height, width)).astype(np.int32)
    images = stored(spark, tmp_path_factory.mktemp("any"), [array], draw(st.integers(1, 9)), draw(st.sampled_from(["tile", "cell"])))
    chosen = draw(st.lists(st.integers(0, bands - 1), min_size=1, max_size=4))
    y0, x0 = draw(st.integers(0, height - 1)), draw(st.integers(0, width - 1))
    y1, x1 = draw(st.integers(y0 + 1, height)), draw(st.integers(x0 + 1, width))
    order = draw(st.permutations("byx"))
    got = R.to_numpy(images, b=chosen, y=(y0, y1), x=(x0, x1), pattern=" ".join(order))
    assert np.array_equal(got, array[chosen, y0:y1, x0:x1].transpose(["byx".index(a) for a in order]))


def test_a_plan_of_many_frames_comes_in_batches(spark):
    """Ten million frames of equal size in a header of 28 bytes: no list of them is ever made."""
    grid = Grid(10, 8000, 8000, 8, 8, "tile", "uint8")
    blob = H.RECORD.pack(H.MAGIC, H.VERSION, 8000, 8000, 8, 8, 10, 8, 1, 0, 20, 0)
    images = spark.createDataFrame([(0, "/nowhere", bytearray(blob))], "n bigint, path string, header binary")
    assert frames_source.wanted(images) == (grid.frames, grid.frames * 64)
    assert frames_source.wanted(images, [3, 3], (0, 9), (0, 8)) == (2, 128)
    found = frames_source.planned(images).selectExpr("count(*)", "sum(frame_index)", "max(offset)").first()
    assert tuple(found) == (10**7, 10**7 * (10**7 - 1) // 2, grid.base + (10**7 - 1) * 20)


def test_batches_are_bounded_by_bytes():
    assert list(frames_source.by_bytes([5, 5, 5, 30, 1, 1], 10)) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(frames_source.by_bytes([])) == []


def test_a_range_is_not_spelled_out(spark):
    assert pick((2, 10**9), "n", 10**9) == range(2, 10**9)
    rows = spark.range(20).withColumnRenamed("id", "n")
    assert sorted(r.n for r in among(rows, "n", range(3, 6)).collect()) == [3, 4, 5]
    assert sorted(r.n for r in among(rows, "n", [*range(0, 1000, 7)]).collect()) == [0, 7, 14]
    assert sorted((r.n, r.at) for r in ordered(rows, "n", range(3, 6), "at").collect()) == [(3, 0), (4, 1), (5, 2)]


def test_a_frame_of_another_length_is_an_error(spark):
    grid = Grid(3, 8, 8, 8, 8, "cell", "int32")
    frames = spark.createDataFrame([(0, 0, 0, 8, 8, None, [1] * 64)], "frame_index bigint, row int, col int, h int, w int, band int, data array<int>")
    with pytest.raises(Exception, match="wrong number of samples"):
        P.place(frames, Request.of(grid)).collect()


def test_an_unfinished_image_leaves_no_file(spark, tmp_path):
    grid = Grid(1, 4, 8, 4, 4, "tile", "uint8")
    rows = spark.createDataFrame([(0, 0, bytearray(b"abc"))], "n bigint, frame_index bigint, payload binary")
    with pytest.raises(Exception, match="frames once"):
        writer.write_images(rows, str(tmp_path), grid).collect()
    assert not list(tmp_path.iterdir())
