"""Many keys in one row: helpers for operators whose tasks exchange packed binary rows.

A block of documents sends its distinct keys, split by key range, to the parts; a part
answers each block in the order of the keys it sent. That makes blocks times parts rows,
as an ordinary shuffle makes segments of map times reduce tasks; with many blocks rows go
through a relay, which makes them as many as the power 1.5 of the blocks.
"""

from __future__ import annotations

import inspect
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

U64 = np.uint64


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Which of `parts` equal ranges of 64-bit values each key is in."""
    return ((keys >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)


def cut(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of runs in a sorted array."""
    if not len(part):
        return
    cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True):
        yield int(part[a]), int(a), int(b)


def rows_of(names: str, rows: list[tuple]) -> pa.Table:
    kinds = {"payload": pa.binary(), "step": pa.int32()}
    fields = names.split()
    return pa.table([pa.array([r[i] for r in rows], kinds.get(f, pa.int64())) for i, f in enumerate(fields)], names=fields)


def packed(*arrays: np.ndarray) -> bytes:
    raw = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True) if len(packed) > 8 else b""


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], ..., start[0] + size[0] - 1, start[1], ..."""
    total = int(size.sum())
    out = np.ones(total, np.int64)
    if total:
        at = np.concatenate(([0], np.cumsum(size)[:-1]))
        some = size > 0
        out[0] = start[some][0]
        out[at[some][1:]] = start[some][1:] - (start[some][:-1] + size[some][:-1] - 1)
        np.cumsum(out, out=out)
    return out


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys: differences, byte plane by byte plane."""
    steps = np.diff(keys, prepend=U64(0)).astype("<u8")
    return packed(steps.view(np.uint8).reshape(-1, 8).T)


def unpacked_keys(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(unpacked(raw), np.uint8, 8 * n).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=U64)


# ---- the relay ----------------------------------------------------------------------


def bundle(rows: list[tuple[int, int, bytes]]) -> bytes:
    """Rows (to, from, payload) as one payload."""
    head = np.array([(to, frm, len(payload)) for to, frm, payload in rows], "<i8")
    return len(rows).to_bytes(8, "little") + head.tobytes() + b"".join(payload for *_, payload in rows)


def unbundle(raw: bytes) -> list[tuple[int, int, bytes]]:
    n = int.from_bytes(raw[:8], "little")
    head = np.frombuffer(raw, "<i8", 3 * n, 8).reshape(n, 3)
    ends = 8 + 24 * n + np.cumsum(head[:, 2])
    return [(int(to), int(frm), raw[end - size : end]) for (to, frm, size), end in zip(head.tolist(), ends.tolist(), strict=True)]


class Relay:
    """How rows (to, from, payload) get from senders to receivers.

    Off, a row goes straight. On, a sender makes one row for each group of receivers; rows from a group of
    senders to a group of receivers meet in one task, which makes one row for each receiver. Groups are as
    large as the root of their number, so neither a sender nor a receiver has rows for all of the others.
    """

    def __init__(self, senders: int, receivers: int, on: bool):
        self.on = on
        self.size = {"block": max(1, math.isqrt(senders)), "part": max(1, math.isqrt(receivers))}

    def sending(self, run: Callable, to: str, frm: str) -> Callable:
        """A group's function whose rows (to, from, payload) go out by groups."""
        if not self.on:
            return run

        def grouped(made: pa.Table) -> pa.Table:
            rows: dict[tuple[int, int], list] = {}
            for row in zip(*(made.column(c).to_pylist() for c in (to, frm, "payload")), strict=True):
                rows.setdefault((row[0] // self.size[to], row[1] // self.size[frm]), []).append(row)
            return rows_of(f"{to} {frm} payload", [(*key, bundle(some)) for key, some in rows.items()])

        # Spark goes by the number of parameters.
        if len(inspect.signature(run).parameters) == 3:
            return lambda key, left, right: grouped(run(key, left, right))
        return lambda key, table: grouped(run(key, table))

    def receiving(self, run: Callable) -> Callable:
        """A group's function for which bundled rows are opened first."""
        return (lambda key, table: run(key, self.opened(table))) if self.on else run

    def opened(self, table: pa.Table) -> pa.Table:
        """Rows as they were sent; columns beside the three stay."""
        if not self.on or not table.num_rows:
            return table
        to, frm = ("part", "block") if table.schema.names.index("part") < table.schema.names.index("block") else ("block", "part")
        more = [c for c in table.schema.names if c not in (to, frm, "payload")]
        rows = [(*row, *extra) for payload, *extra in zip(*(table.column(c).to_pylist() for c in ("payload", *more)), strict=True) for row in unbundle(payload)]
        return rows_of(" ".join((to, frm, "payload", *more)), rows)

    def across(self, sent: DataFrame, to: str, frm: str) -> DataFrame:
        """What was sent, one row (or, through the relay, one bundle from each group of senders) for each receiver."""
        if not self.on:
            return sent

        def deal(key: tuple, table: pa.Table) -> pa.Table:
            rows: dict[int, list] = {}
            for payload in table.column("payload").to_pylist():
                for row in unbundle(payload):
                    rows.setdefault(row[0], []).append(row)
            return rows_of(f"{to} {frm} payload", [(receiver, key[1].as_py(), bundle(some)) for receiver, some in rows.items()])

        return sent.groupBy(to, frm).applyInArrow(deal, f"{to} long, {frm} long, payload binary")
