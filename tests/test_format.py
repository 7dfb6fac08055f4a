import hashlib
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.errors import FormatError
from tesserae.functions import geo
from tesserae.functions.grid import Grid, base_offset
from tesserae.operators import header as H
from tesserae.sources import container as C

NORTH_UP = (30.0, 0.0, 500000.0, 0.0, -30.0, 8000000.0)
ROTATED = (30.0, 5.0, 500000.0, 5.0, -30.0, 8000000.0)
PAYLOADS = [bytes([i % 251]) * (7 + 3 * i) for i in range(30)]
GRID = Grid(2, 40, 70, 16, 16)

# Digests of whole files.
DIGESTS = {
    "plain": ({}, "7a6818bd71b3fbb5579ce4c7e07833cd2509555d3cee179ea260697929ad6a11"),
    "north_up": ({"transform": NORTH_UP, "crs": 32718}, "5077418d91f271d316f91fb50859d3693332237e7239a5fb91cdfc314e9aa5e9"),
    "rotated": ({"transform": ROTATED, "crs": "EPSG:32718"}, "42afc0fb931b839e9c7f4e821cbd84960482f9d9d1236fd088b59d398948b124"),
    "point": ({"transform": NORTH_UP, "crs": "32718", "pixel_is_point": True}, "fbbac06cc59555cea0a3454a69b2c43d60d3d070978b29ebce98ce31ab8e4dc9"),
}


def write(path, grid=GRID, payloads=PAYLOADS, **where):
    return C.write_file(path, grid, payloads, [len(p) for p in payloads], C.Geo.of(**where))


@pytest.mark.parametrize("case", DIGESTS)
def test_files_byte_for_byte(tmp_path, case):
    where, digest = DIGESTS[case]
    header = write(tmp_path / "a", **where)
    data = (tmp_path / "a").read_bytes()
    assert hashlib.sha256(data).hexdigest() == digest
    blob, place = C.index(C.Reader(data), geo.KNOWN)
    assert blob == header == C.index_file(tmp_path / "a")
    assert place == C.Geo.of(**where)


def unpacked_bit_by_bit(least, bits, packed, n):
    """An unpacker of its own, so that the two can disagree."""
    number = int.from_bytes(packed, "little")
    return [least + (number >> (i * bits) & ((1 << bits) - 1)) for i in range(n)]


@given(st.integers(0, 32), st.integers(1, 96), st.integers(0, 9999))
@settings(deadline=None)
def test_counts_round_trip_at_every_width(bits, n, seed):
    rng = np.random.default_rng(seed)
    top = (1 << bits) - 1
    counts = rng.integers(1, 2 + min(top, (1 << 32) - 2), n) if bits else np.full(n, 7)
    least, width, packed = H.pack_counts(counts)
    assert width <= max(bits, 1)
    assert unpacked_bit_by_bit(least, width, packed, n) == counts.tolist()
    assert H.unpack_counts(least, width, packed, n).tolist() == counts.tolist()


def test_known_counts():
    assert H.pack_counts([10, 20, 30, 40]) == (10, 5, bytes((64, 81, 15)))
    h = H.parse_header(H.encode_header(Grid(1, 32, 32, 16, 16), [10, 20, 30, 40]))
    assert h.offset(np.arange(4)).tolist() == [460, 470, 490, 520]
    assert h.end == 560


@pytest.mark.parametrize(("bands", "height", "width", "tile", "frames"), [(1, 16, 16, 16, 1), (2, 40, 70, 16, 30), (4, 64, 64, 16, 64), (5, 64, 64, 16, 80), (13, 512, 512, 256, 52), (64, 256, 256, 256, 64)])
def test_base_offset_is_where_frames_start(bands, height, width, tile, frames):
    grid = Grid(bands, height, width, tile, tile)
    assert grid.frames == frames
    assert len(C.head(grid, [1] * frames)) == base_offset(bands, frames)


def blob(**changes):
    fields = dict(magic=H.MAGIC, version=1, width=32, length=32, tw=16, tl=16, bands=1, bits=16, form=1, unit=0, least=10, count_bits=5) | changes
    return H.RECORD.pack(*fields.values()) + bytes((64, 81, 15))


@pytest.mark.parametrize(("changes", "problem"), [
    ({"magic": 1}, H.BAD_MAGIC), ({"version": 2}, H.BAD_VERSION), ({"bits": 3}, H.BAD_BITS), ({"form": 9}, H.BAD_FORMAT), ({"form": 3, "bits": 8}, H.BAD_FORMAT), ({"unit": 2}, H.BAD_UNIT),
    ({"width": 0}, H.BAD_SIZE), ({"length": 1 << 31}, H.BAD_SIZE), ({"tw": 0}, H.BAD_SIZE), ({"bands": 0}, H.BAD_SIZE), ({"width": (1 << 31) - 1, "length": (1 << 31) - 1, "tw": 1, "tl": 1}, H.FRAME_OVERFLOW),
    ({"count_bits": 33}, H.BAD_WIDTH), ({"count_bits": 6, "bands": 2}, H.BAD_LENGTH), ({"bands": 2}, H.BAD_LENGTH), ({"least": 0}, H.EMPTY_FRAME),
])
def test_bad_headers(changes, problem):
    with pytest.raises(H.HeaderError) as e:
        H.parse_header(blob(**changes))
    assert e.value.problem == problem


def test_header_that_is_not_canonical():
    grid = Grid(1, 32, 32, 16, 16)
    good = H.encode_header(grid, [40, 41, 42, 47])
    assert good[27] == 3
    wide = H.RECORD.pack(*H.RECORD.unpack(good[:28])[:-1], 4) + bytes((0x10, 0x72))
    lower = H.RECORD.pack(*H.RECORD.unpack(good[:28])[:-2], 39, 4) + bytes((0x21, 0x83))
    spare = good[:-1] + bytes((good[-1] | 0x80,))
    for bad in (wide, lower, spare):
        with pytest.raises(H.HeaderError, match="canonically"):
            H.parse_header(bad)


def test_small_header_with_many_frames_is_not_expanded():
    head = H.RECORD.pack(H.MAGIC, 1, 65535, 65535, 3, 3, 1, 8, 1, 0, 9, 0)
    h = H.parse_header(head)
    assert h.grid.frames == 21845 * 21845
    assert h.counts is None
    assert h.offset(5) == h.grid.base + 45
    wide = H.RECORD.pack(H.MAGIC, 1, 5592406, 1, 1, 1, 1, 8, 1, 0, 9, 1) + bytes((5592406 + 7) // 8)
    with pytest.raises(H.HeaderError) as e:
        H.parse_header(wide)
    assert e.value.problem == H.TOO_MANY


@given(st.binary(max_size=80))
def test_any_bytes_parse_or_are_refused(data):
    for candidate in (data, blob()[:22] + data):
        try:
            H.parse_header(candidate)
        except FormatError:
            pass


@given(st.integers(0, 770), st.integers(0, 255))
@settings(max_examples=60, deadline=None)
def test_changed_containers_are_indexed_or_refused(tmp_path_factory, at, value):
    path = tmp_path_factory.mktemp("fuzz") / "a"
    write(path)
    data = bytearray(path.read_bytes())
    data[at] = value
    try:
        C.index(C.Reader(bytes(data)))
    except FormatError:
        pass


def entries(data):
    return [bytearray(data[24 + 20 * i : 44 + 20 * i]) for i in range(11)]


def with_entries(data, changed):
    return data[:24] + b"".join(changed) + data[24 + 220 :]


def broken(data, how):
    e = entries(data)
    if how == "order":
        e[0], e[1] = e[1], e[0]
    elif how == "type":
        struct.pack_into("<H", e[0], 2, C.SHORT)
    elif how == "placement":
        struct.pack_into("<Q", e[9], 12, struct.unpack_from("<Q", e[9], 12)[0] + 8)
    elif how == "forbidden":
        struct.pack_into("<H", e[9], 0, 33550)
    elif how == "count":
        return data[:16] + struct.pack("<Q", 12) + data[24:]
    elif how == "gap":
        return data + b"\0"
    elif how == "second":
        return data[:244] + struct.pack("<Q", 99) + data[252:]
    elif how == "order of bytes":
        return b"MM" + data[2:]
    return with_entries(data, e)


@pytest.mark.parametrize(("how", "why"), [("order", "order"), ("type", "type"), ("placement", "expected"), ("forbidden", "tag"), ("count", "tag"), ("gap", "end"), ("second", "second"), ("order of bytes", "little-endian")])
def test_conformance_rules(tmp_path, how, why):
    write(tmp_path / "a")
    with pytest.raises(FormatError, match=why):
        C.index(C.Reader(broken((tmp_path / "a").read_bytes(), how)))


def test_accepted_oddities(tmp_path):
    write(tmp_path / "a", Grid(1, 40, 40, 20, 20), [b"x" * 8] * 4)
    assert H.HeaderView.from_path(tmp_path / "a").to_dict()["tile"] == [20, 20]
    assert H.HeaderView(write(tmp_path / "b", Grid(1, 40, 40, 20, 20, "cell"), [b"x"] * 4)).frame_unit == "tile"


def test_failed_writes_leave_nothing(tmp_path):
    with pytest.raises(ValueError):
        C.write_file(tmp_path / "a", GRID, [b"x"] * 30, [2] * 30)
    assert not (tmp_path / "a").exists()
    with pytest.raises(ValueError, match="go together"):
        C.Geo.of(transform=NORTH_UP)


def test_crs_and_codes():
    assert [geo.crs_code(v) for v in (4326, "EPSG:4326", "epsg:4326", "4326")] == [4326] * 4
    with pytest.raises(TypeError):
        geo.crs_code(True)
    with pytest.raises(ValueError):
        geo.crs_code("WGS84")
    assert [geo.geokeys(c)[7::5] for c in (32718, 4326, 4037)] == [[1, 3072], [2, 2048], [1, 3072]]
    assert geo.geokeys(0, True)[7:13] == [0, 1025, 0, 1, 2, 2048]
    with pytest.raises(ValueError):
        geo.geokeys(999999)
