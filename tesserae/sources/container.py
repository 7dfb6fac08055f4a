"""The container file: a BigTIFF with one fixed directory, then the frames back to back."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

from ..errors import FormatError
from ..functions import dtypes, geo
from ..functions.grid import FIRST_IFD, MAX_FRAMES, UNITS, Grid, base_offset
from ..operators.header import encode_header

SHORT, LONG, DOUBLE, LONG8 = 3, 4, 12, 16
WIDTHS = {SHORT: 2, LONG: 4, DOUBLE: 8, LONG8: 8}
LETTERS = {SHORT: "H", LONG: "I", DOUBLE: "d", LONG8: "Q"}

# The tags of the directory, in order, with their types.
TAGS = {256: LONG, 257: LONG, 258: SHORT, 277: SHORT, 322: SHORT, 323: SHORT, 324: LONG8, 325: LONG, 339: SHORT, 34264: DOUBLE, 34735: SHORT}
NAMES = {256: "width", 257: "length", 258: "bits", 277: "bands", 322: "tile width", 323: "tile length", 324: "offsets", 325: "byte counts", 339: "sample format", 34264: "matrix", 34735: "geokeys"}
LEAD = struct.pack("<HHHHQ", 0x4949, 43, 8, 0, FIRST_IFD)


@dataclass(frozen=True)
class Geo:
    """Where an image lies: affine coefficients, EPSG code, and whether pixels are points. Without a CRS there is no transform."""

    transform: tuple[float, ...] | None = None
    epsg: int = 0
    point: bool = False

    @classmethod
    def of(cls, transform=None, crs=None, pixel_is_point: bool = False) -> Geo:
        if (transform is None) != (crs is None):
            raise ValueError("transform and crs go together")
        return cls(None if transform is None else tuple(transform)[:6], geo.crs_code(crs), pixel_is_point)


def head(grid: Grid, counts, where: Geo = Geo(), known: geo.Ranges = geo.KNOWN) -> bytes:
    """All bytes before the first frame."""
    counts = np.asarray(counts, np.int64)
    if len(counts) != grid.frames:
        raise ValueError(f"the grid has {grid.frames} frames, but {len(counts)} counts are given")
    base = base_offset(grid.bands, grid.frames)
    values = {
        256: [grid.width], 257: [grid.height], 258: [grid.kind.bits] * grid.bands, 277: [grid.bands], 322: [grid.tile_width], 323: [grid.tile_length],
        324: base + np.cumsum(counts) - counts, 325: counts, 339: [grid.kind.sample_format] * grid.bands, 34264: geo.matrix(where.transform), 34735: geo.geokeys(where.epsg, where.point, known),
    }
    entries, outside = [], []
    at = FIRST_IFD + 8 + 20 * len(TAGS) + 8
    for tag, kind in TAGS.items():
        raw = np.asarray(values[tag]).astype(f"<{'f8' if kind == DOUBLE else f'u{WIDTHS[kind]}'}").tobytes()
        if len(raw) <= 8:
            field = raw.ljust(8, b"\0")
        else:
            field = struct.pack("<Q", at)
            outside.append(raw)
            at += len(raw)
        entries.append(struct.pack("<HHQ", tag, kind, len(raw) // WIDTHS[kind]) + field)
    out = LEAD + struct.pack("<Q", len(TAGS)) + b"".join(entries) + struct.pack("<Q", 0) + b"".join(outside)
    assert len(out) == base
    return out


class FrameWriter:
    """Writes a container frame by frame, in frame order: where frames begin follows from the grid, so what stands
    before them is written last. A file that is not finished is removed."""

    def __init__(self, path, grid: Grid, where: Geo = Geo(), known: geo.Ranges = geo.KNOWN):
        one = grid.bands > 1 or grid.unit == "tile"
        self.grid = grid if one else Grid(grid.bands, grid.height, grid.width, grid.tile_width, grid.tile_length, "tile", grid.kind)
        self.path, self.where, self.known = path, where, known
        self.counts: list[int] = []
        self.file = open(path, "wb")
        self.file.seek(self.grid.base)

    def add(self, payload: bytes) -> None:
        self.file.write(payload)
        self.counts.append(len(payload))

    def finish(self) -> bytes:
        """Returns the header."""
        try:
            blob = encode_header(self.grid, self.counts)
            first = head(self.grid, self.counts, self.where, self.known)
            self.file.seek(0)
            self.file.write(first)
            self.file.close()
        except BaseException:
            self.drop()
            raise
        return blob

    def drop(self) -> None:
        self.file.close()
        if os.path.exists(self.path):
            os.unlink(self.path)


def write_file(path, grid: Grid, payloads: Iterable[bytes], counts=None, where: Geo = Geo(), known: geo.Ranges = geo.KNOWN) -> bytes:
    """Writes a container and returns its header; counts: sizes that the payloads must have. A file that cannot be finished is removed."""
    head(Grid(1, 1, 1, 1, 1), [1], where, known)  # what cannot be written is refused before a file is made
    out = FrameWriter(path, grid, where, known)
    try:
        for n, payload in enumerate(payloads):
            if counts is not None and (n >= len(counts) or len(payload) != counts[n]):
                raise ValueError(f"frame {n} has {len(payload)} bytes, which is not its size")
            out.add(payload)
    except BaseException:
        out.drop()
        raise
    return out.finish()


class Reader:
    """Bytes of a file or of memory, by position; what lies past the end is an error."""

    def __init__(self, source):
        self.file = None
        if isinstance(source, (bytes, bytearray, memoryview)):
            self.data, self.size = memoryview(source), len(source)
        else:
            try:
                self.file = open(source, "rb")
            except OSError as e:
                raise OSError(f"could not open {os.fspath(source)!r}: {e.strerror}") from None
            self.size = os.fstat(self.file.fileno()).st_size

    def at(self, offset: int, length: int) -> bytes:
        if offset < 0 or length < 0 or offset + length > self.size:
            raise FormatError(f"bytes {offset} to {offset + length} lie beyond the end at {self.size}")
        if self.file is None:
            return bytes(self.data[offset : offset + length])
        self.file.seek(offset)
        out = self.file.read(length)
        if len(out) != length:
            raise FormatError(f"bytes {offset} to {offset + length} lie beyond the end")
        return out

    def close(self) -> None:
        if self.file is not None:
            self.file.close()

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def _directory(read: Reader) -> dict[int, list]:
    """The directory's values by tag, after all rules about tags, types and places."""
    if read.at(0, 16) != LEAD:
        raise FormatError("no little-endian BigTIFF with its directory at byte 16")
    if struct.unpack("<Q", read.at(FIRST_IFD, 8))[0] != len(TAGS):
        raise FormatError(f"the directory must hold exactly {len(TAGS)} tags")
    raw = read.at(FIRST_IFD + 8, 20 * len(TAGS) + 8)
    found = [struct.unpack_from("<HHQ", raw, 20 * i) for i in range(len(TAGS))]
    if [t for t, *_ in found] != list(TAGS):
        known = sorted(t for t, *_ in found) == list(TAGS)
        raise FormatError("the tags are not in rising order" if known else "the directory holds another tag than allowed, or lacks one")
    if raw[-8:] != bytes(8):
        raise FormatError("there is a second directory")
    values, at = {}, FIRST_IFD + 8 + 20 * len(TAGS) + 8
    for i, (tag, kind, n) in enumerate(found):
        if kind != TAGS[tag]:
            raise FormatError(f"{NAMES[tag]} has the wrong type")
        size = n * WIDTHS[kind]
        field = raw[20 * i + 12 : 20 * i + 20]
        if size <= 8:
            data = field[:size]
            if any(field[size:]):
                raise FormatError(f"{NAMES[tag]} has stray bytes")
        else:
            place = struct.unpack("<Q", field)[0]
            if place != at:
                raise FormatError(f"{NAMES[tag]} is at {place}, expected at {at}")
            if at + size > read.size:
                raise FormatError(f"{NAMES[tag]} lies beyond the end")
            data = read.at(place, size)
            at += size
        values[tag] = np.frombuffer(data, f"<{'f8' if kind == DOUBLE else f'u{WIDTHS[kind]}'}")
    values["end"] = at
    return values


def index(read: Reader, known: geo.Ranges = geo.KNOWN) -> tuple[bytes, Geo]:
    """The header of an open container, rebuilt from its directory, and where the image lies.

    known: registry data. A code that it has must be of the kind that the file says; one that it lacks is an
    error too if a table is given, as KNOWN does not claim to be complete.
    """
    v = _directory(read)
    one = lambda tag: int(v[tag][0]) if len(v[tag]) == 1 else _fail(f"{NAMES[tag]} must be one number")
    width, height, bands, tw, tl = (one(t) for t in (256, 257, 277, 322, 323))
    if not (width and height and bands and tw and tl) or max(width, height) >= 1 << 31:
        if width and height and bands and tw and tl and -(-width // tw) * -(-height // tl) * bands > MAX_FRAMES:
            raise FormatError("the frame count overflows")
        raise FormatError("the image has invalid dimensions")
    for tag in (258, 339):
        if len(v[tag]) != bands or len(set(v[tag].tolist())) != 1:
            raise FormatError(f"{NAMES[tag]} must be the same for each of {bands} bands")
    kind = dtypes.BY_SAMPLE.get((int(v[339][0]), int(v[258][0]))) or _fail("sample format and bits are no valid pair")
    cells = -(-width // tw) * -(-height // tl)
    if cells * bands > MAX_FRAMES:
        raise FormatError("the frame count overflows")
    n = len(v[324])
    if n not in (cells, cells * bands) or len(v[325]) != n:
        raise FormatError("the number of frames fits neither tiles nor cells")
    grid = Grid(bands, height, width, tw, tl, UNITS[int(n != cells * bands)], kind)
    where = _place(v[34264], v[34735].tolist(), known)
    counts = v[325].astype(np.int64)
    if not counts.all():
        raise FormatError("a frame has no bytes")
    expected = base_offset(bands, n)
    if v["end"] != expected or int(v[324][0]) != expected:
        raise FormatError(f"there is padding before the frames: they start at {int(v[324][0])}, expected {expected}")
    if not np.array_equal(v[324].astype(np.int64), expected + np.cumsum(counts) - counts):
        raise FormatError("the frames are not one run in frame order")
    if expected + int(counts.sum()) != read.size:
        raise FormatError("the file does not end with the last frame")
    return encode_header(grid, counts), where


def _fail(why: str):
    raise FormatError(why)


def _place(matrix: np.ndarray, keys: list[int], known: geo.Ranges) -> Geo:
    if len(matrix) != 16 or len(keys) != 16:
        raise FormatError("matrix and geokeys have 16 values each")
    if keys[:7] != [1, 1, 0, 3, 1024, 0, 1] or keys[8:11] != [1025, 0, 1] or keys[13:15] != [0, 1]:
        raise FormatError("the geokeys have another form")
    model, raster, key, code = keys[7], keys[11], keys[12], keys[15]
    if raster not in (geo.AREA, geo.POINT):
        raise FormatError("the raster type is neither area nor point")
    if model == geo.UNDEFINED:
        if code or key not in (2048, 3072):
            raise FormatError("an undefined CRS has no code")
        return Geo(None, 0, raster == geo.POINT)
    if model not in (geo.PROJECTED, geo.GEOGRAPHIC) or key != (3072 if model == geo.PROJECTED else 2048):
        raise FormatError("model type and CRS key disagree")
    kind = geo.model_type(code, known)
    if kind != model and not (known is geo.KNOWN and kind == geo.UNDEFINED):
        raise FormatError(f"EPSG:{code} is not of the kind that the file says")
    m = matrix.tolist()
    return Geo((m[0], m[1], m[3], m[4], m[5], m[7]), code, raster == geo.POINT)


def index_file(path, known: geo.Ranges = geo.KNOWN) -> bytes:
    """The header of a container file; only the bytes before the frames are read."""
    with Reader(path) as read:
        return index(read, known)[0]
