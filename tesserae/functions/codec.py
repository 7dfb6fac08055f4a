"""Payload codecs by name. A payload names its codec in its first four bytes.

These are this project's own codecs: payloads of other writers are told apart by their
tag and refused.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np

from ..errors import FormatError, UnsupportedError
from .dtypes import DType

MAGIC = b"TS"
PREPARE = {"": 0, "delta": 1, "zigzag": 2, "delta>zigzag": 3}


def _zstd():
    try:
        import zstandard
    except ImportError:
        raise UnsupportedError("codec zstd needs the zstandard package") from None
    return zstandard


#: name: (number, compress, decompress to a known size)
CODECS: dict[str, tuple[int, Callable[[bytes], bytes], Callable[[bytes, int], bytes]]] = {
    "raw": (0, lambda b: b, lambda b, n: b),
    "zlib": (1, lambda b: zlib.compress(b, 6), lambda b, n: zlib.decompressobj().decompress(b, n + 1)),
    "zstd": (2, lambda b: _zstd().ZstdCompressor(level=3).compress(b), lambda b, n: _zstd().ZstdDecompressor().decompress(b, max_output_size=n + 1)),
}


def register(name: str, number: int, compress: Callable[[bytes], bytes], decompress: Callable[[bytes, int], bytes]) -> None:
    """Adds a codec. It must be registered wherever payloads are read, so in a module that workers import."""
    if not 0 <= number <= 255 or any(n == number and k != name for k, (n, *_) in CODECS.items()):
        raise ValueError(f"codec number {number} is taken or out of range")
    CODECS[name] = (number, compress, decompress)


def parse(recipe: str) -> tuple[int, str]:
    """("delta>zigzag>zlib") as the number of its preparation and its codec."""
    prepare, _, codec = recipe.rpartition(">")
    if codec not in CODECS:
        raise UnsupportedError(f"unknown codec {codec!r}; there are {sorted(CODECS)}")
    if prepare not in PREPARE:
        raise UnsupportedError(f"unknown preparation {prepare!r}; there are {sorted(PREPARE)}")
    return PREPARE[prepare], codec


def _integers(kind: DType) -> bool:
    return kind.sample_format in (1, 2) and kind.bits >= 8


def encode(data: np.ndarray, kind: DType, recipe: str = "zlib") -> bytes:
    """A frame's samples, in C order and little-endian, as a payload. Preparations apply to whole-byte integers only."""
    prepare, codec = parse(recipe)
    a = np.ascontiguousarray(data)
    if not _integers(kind):
        prepare = 0
    else:
        a = a.astype(kind.numpy, copy=False).ravel()
        if prepare & 1:
            a = np.diff(a, prepend=a.dtype.type(0))
        if prepare & 2:
            signed = a.view(f"<i{a.itemsize}")
            a = ((signed << 1) ^ (signed >> (8 * a.itemsize - 1))).view(kind.numpy)
    number, compress, _ = CODECS[codec]
    return MAGIC + bytes((prepare, number)) + compress(a.tobytes())


def decode(payload: bytes, kind: DType, samples: int) -> np.ndarray:
    """The samples of a payload, as many as the grid says; anything else is an error."""
    if len(payload) < 4 or payload[:2] != MAGIC:
        raise UnsupportedError("the payload was written by a codec that is not available here")
    prepare, number = payload[2], payload[3]
    codec = next((c for c in CODECS.values() if c[0] == number), None)
    if codec is None or prepare > 3:
        raise UnsupportedError(f"unknown codec number {number} or preparation {prepare}")
    size = samples * kind.size
    try:
        raw = codec[2](payload[4:], size)
    except UnsupportedError:
        raise
    except Exception as e:
        raise FormatError(f"the payload cannot be decoded: {e}") from None
    if len(raw) != size:
        raise FormatError(f"a frame decoded to {len(raw)} bytes instead of {size}")
    a = np.frombuffer(raw, kind.numpy)
    if prepare and not _integers(kind):
        raise FormatError("only integers are prepared")
    if prepare & 2:
        u = a.view(f"<u{a.itemsize}")
        a = ((u >> 1) ^ (0 - (u & 1))).view(kind.numpy)
    return np.cumsum(a, dtype=a.dtype) if prepare & 1 else a
