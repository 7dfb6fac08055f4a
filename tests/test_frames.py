import numpy as np
import pytest

import tesserae
from tesserae.functions import codec, dtypes
from tesserae.functions.grid import Grid, human_bytes
from tesserae.plans import layout
from tesserae.sources.frames_source import register
from tesserae.sources.writer import write_images
from tesserae.streaming.watch import watch


@pytest.fixture(scope="module")
def scene(spark):
    return np.arange(2 * 40 * 70, dtype=np.uint16).reshape(2, 40, 70)


def test_edges_are_clipped(spark):
    t = tesserae.frames(np.zeros((3, 257, 256), np.uint16), 128, spark=spark)
    assert len(t) == 18
    assert {(r.h, r.w) for r in t.df.select("h", "w").collect()} == {(128, 128), (1, 128)}
    assert len(tesserae.frames(np.zeros((3, 257, 256), np.uint16), 128, "cell", spark)) == 6


def test_rows_columns_and_frames(spark, scene):
    t = tesserae.frames(scene, 16, spark=spark)
    assert (t.tiles_across, t.tiles_down, len(t.cells)) == (5, 3, 15)
    assert t["row"][:3] == [0, 0, 0]
    assert t["tile"][1] == "1.0.0"
    assert t[-1].index == 29
    assert np.array_equal(t[2].data, scene[0, :16, 16:32])
    assert [f.index for f in t] == list(range(30))
    for bad, error in ((30, IndexError), ("nope", KeyError), (1.5, TypeError)):
        with pytest.raises(error):
            t[bad]
    cell = tesserae.frames(scene, 16, "cell", spark)
    assert cell[0].data.shape == (2, 16, 16)
    with pytest.raises(AttributeError):
        cell[0].band
    with pytest.raises(KeyError):
        cell["band"]


def test_payloads_and_extras(spark, scene):
    t = tesserae.frames(scene, 16, spark=spark)
    assert (t.done, t.nbytes) == (0, 0)
    t = t.with_payloads([bytes([i]) * (7 + 3 * i) for i in range(30)]).with_payload(3, None)
    assert t.done == 29
    assert t[4].compressed == bytes([4]) * 19
    with pytest.raises(ValueError):
        t.with_payloads([b"x"])
    with pytest.raises(ValueError):
        t.with_payload(0, b"")
    with pytest.raises(TypeError):
        t.with_payloads(["x"] * 30)
    t = t.attach("cloud", range(15)).attach("score", range(30))
    assert t["cloud"][:4] == [0, 0, 1, 1]
    assert t[5].extras == {"cloud": 2, "score": 5}
    for name in ("row", "not a name", "cloud"):
        with pytest.raises(ValueError):
            t.attach(name, range(30))
    with pytest.raises(ValueError):
        t.attach("short", [1])
    frame = t.to_pandas()
    assert list(frame.columns) == ["tile", "cell", "band", "row", "col", "bytes", "cloud", "score"]
    assert frame.bytes.isna().sum() == 1
    assert "…" in repr(t) and "30" in repr(t)
    assert "<table>" in t._repr_html_()
    with pytest.raises(ValueError, match="payload"):
        tesserae.write("/tmp/never", t)


def test_frame_problems(spark, scene):
    t = tesserae.frames(scene, 16, spark=spark).check()
    broken = tesserae.FrameTable(t.df.where("frame_index <> 4"), t.grid)
    with pytest.raises(ValueError, match="frame 4: missing"):
        broken.check()


@pytest.mark.parametrize("array", [np.zeros((4, 4)), np.zeros((1, 4, 4), bool), np.zeros((1, 4, 4), "S3"), np.zeros((0, 4, 4))])
def test_arrays_that_are_no_images(spark, array):
    with pytest.raises((TypeError, ValueError)):
        tesserae.frames(array, 2, spark=spark)


def test_grid_limits():
    for bad in ((0, 1, 1, 1, 1), (1, 1, 1, 0, 1), (1, 1, 1, 65536, 1), (1, 1 << 31, 1, 1, 1), (65535, 1 << 30, 1 << 30, 1, 1)):
        with pytest.raises(ValueError):
            Grid(*bad)
    with pytest.raises(ValueError):
        Grid(1, 1, 1, 1, 1, "strip")
    assert human_bytes(1023) == "1023 B"
    assert human_bytes(1536) == "1.5 KB"


@pytest.mark.parametrize("name", [d.name for d in dtypes.ALL])
def test_codecs_keep_every_type(name):
    kind = dtypes.BY_NAME[name]
    raw = np.random.default_rng(5).integers(0, 256, 64 * kind.size).astype(np.uint8)
    if kind.bits < 8:
        raw &= (1 << kind.bits) - 1
    a = np.frombuffer(raw.tobytes(), kind.numpy)
    for recipe in ("raw", "zlib", "delta>zigzag>zstd", "zigzag>zlib", "delta>raw"):
        assert codec.decode(codec.encode(a, kind, recipe), kind, 64).tobytes() == a.tobytes()
    with pytest.raises(ValueError):
        codec.decode(codec.encode(a, kind, "zlib"), kind, 63)


def test_small_floats_by_their_definitions():
    value = lambda n, code: float(dtypes.small_float_values(n)[code])
    assert [value("float4_e2m1", i) for i in range(8)] == [0, 0.5, 1, 1.5, 2, 3, 4, 6]
    assert value("float8_e4m3fn", 0x7E) == 448 and np.isnan(value("float8_e4m3fn", 0x7F))
    assert value("float8_e5m2", 0x7B) == 57344 and value("float8_e5m2", 0x7C) == float("inf") and np.isnan(value("float8_e5m2", 0x7D))
    assert value("float6_e2m3", 0x1F) == 7.5 and value("float6_e3m2", 0x1F) == 28
    assert value("float8_e8m0", 0) == 2.0**-127 and np.isnan(value("float8_e8m0", 255))
    assert str(value("float8_e5m2", 0x80)) == "-0.0"


@pytest.mark.parametrize(("pattern", "shape"), [("b y x", (2, 3, 4)), ("y x b", (3, 4, 2)), ("b (y x)", (2, 12)), ("(b y x)", (24,)), ("x(yb)", (4, 6)), ("n b y x", (1, 2, 3, 4))])
def test_layouts(pattern, shape):
    assert layout.compile_layout(pattern, 1, 2, 3, 4).shape == shape


@pytest.mark.parametrize("pattern", ["", "b y", "b y x x", "b y z x", "((b y) x)", "(b y x", "b) y x", "() b y x"])
def test_layouts_that_are_refused(pattern):
    with pytest.raises(ValueError):
        layout.compile_layout(pattern, 1, 2, 3, 4)


def test_layout_sizes():
    with pytest.raises(ValueError, match="n in the pattern"):
        layout.compile_layout("b y x", 2, 2, 3, 4)
    with pytest.raises(ValueError, match="overflow"):
        layout.compile_layout("b y x", 1, 1 << 31, 1 << 31, 1 << 31)
    with pytest.raises(ValueError):
        layout.compile_layout("b y x", 1, 0, 3, 4)


def test_many_images_through_the_sinks(spark, tmp_path):
    arrays = {n: np.random.default_rng(n).integers(0, 99, (2, 20, 20)).astype(np.uint16) for n in range(5)}
    rows = None
    for n, a in arrays.items():
        t = tesserae.frames(a, 8, spark=spark).compress("zlib")
        part = t.df.selectExpr(f"cast({n} as bigint) as n", "frame_index", "payload")
        rows = part if rows is None else rows.unionByName(part)
    (tmp_path / "a").mkdir()
    images = write_images(rows, str(tmp_path / "a"), t.grid)
    from tesserae.operators.read import to_numpy

    assert np.array_equal(to_numpy(images.cache()), np.stack(list(arrays.values())))
    register(spark)
    dealt = rows.repartition(2, "n").sortWithinPartitions("n", "frame_index")
    g = t.grid
    dealt.write.format("containers").mode("append").options(bands=g.bands, height=g.height, width=g.width, tile_width=8, tile_length=8, dtype="uint16").save(str(tmp_path / "b"))
    for n in range(5):
        assert (tmp_path / "a" / f"{n}.frames").read_bytes() == (tmp_path / "b" / f"{n}.frames").read_bytes()
    # The same folder as a stream of new images.
    seen = []
    q = watch(spark, str(tmp_path / "b")).writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert sorted(r.frames for r in seen) == [18] * 5


def test_parallelism(monkeypatch):
    from tesserae import threads

    monkeypatch.setattr(threads, "_chosen", None)
    monkeypatch.setenv(threads.ENV, "7")
    assert threads.get_parallelism() == 7
    threads.set_parallelism(5000)
    assert threads.get_parallelism() == 1024
    threads.set_parallelism("ALL_CPUS")
    assert threads.get_parallelism() >= 1
    for bad, error in ((0, ValueError), ("x", TypeError), (True, TypeError)):
        with pytest.raises(error):
            threads.set_parallelism(bad)
