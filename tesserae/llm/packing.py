"""Packing token sequences by minimum bin slack.

Every document's ids plus a final end id are cut into full windows and one remainder.
Full windows are sequences of their own.  Remainders wait in a pool; whenever it holds
enough, windows are filled from it: the longest remainder opens a window, and a
subset-sum dynamic program over the multiset of waiting lengths (one bit per reachable
sum, kept in an integer) finds the set that leaves least slack; counts per length are
read back through the steps of the program.  Slack that no subset closes is closed by
cutting one waiting remainder.  What is left when a partition ends is cut at powers of
two, which need no padding either.

Packing is local to a partition, needs no shuffle and keeps a bounded pool in memory;
a sequence's id names its partition and its place there.

Cases: null and empty texts are the end id alone; longer documents than a window are cut
into several pieces; repeated rows are packed once each; of waiting remainders of one
length the last to come goes first, and of subsets that leave the same slack the one with
the longest pieces is taken; rows with a null id are packed like others; no rows give no
pieces; columns of other names pass unread.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import load
from .kit import bound_batches, enter

#: (document's ordinal, start, ids as bytes): what waits or is placed.
Piece = tuple[int, int, bytes]


def best_subset(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length to take so that their sum comes closest to the capacity from below."""
    reach, steps, limit = 1, [], (2 << capacity) - 1
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        steps.append((length, reach))
        left, part = counts[length], 1
        while left:  # multiplicities in binary parts
            part = min(part, left)
            reach |= reach << length * part & limit
            left -= part
            part *= 2
        if reach >> capacity:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        n = 0
        while not before >> total & 1:
            total -= length
            n += 1
        if n:
            taken[length] = n
    return taken


class Packer:
    """Packs one partition; `put` and `finish` return sequences, each a list of pieces."""

    def __init__(self, window: int, pool: int = 1024):
        self.window, self.limit = window, pool
        self.waiting: dict[int, list[Piece]] = defaultdict(list)
        self.size = self.tokens = 0

    def _wait(self, piece: Piece) -> None:
        self.waiting[len(piece[2]) // 4].append(piece)
        self.size += 1
        self.tokens += len(piece[2]) // 4

    def _take(self, length: int) -> Piece:
        pieces = self.waiting[length]
        piece = pieces.pop()
        if not pieces:
            del self.waiting[length]
        self.size -= 1
        self.tokens -= length
        return piece

    def put(self, doc: int, ids: bytes) -> list[list[Piece]]:
        step = self.window * 4
        full = len(ids) - len(ids) % step
        out = [[(doc, at // 4, ids[at : at + step])] for at in range(0, full, step)]
        if full < len(ids):
            self._wait((doc, full // 4, ids[full:]))
        while self.size > self.limit:
            out.append(self._fill(self.window))
        return out

    def _fill(self, capacity: int) -> list[Piece]:
        """One sequence of `capacity` tokens; at least so many must wait."""
        fits = [x for x in self.waiting if x <= capacity]
        sequence, left = [], capacity
        if fits:
            sequence.append(self._take(max(fits)))
            left -= max(fits)
        if left:
            for length, n in best_subset({x: len(p) for x, p in self.waiting.items() if x <= left}, left).items():
                sequence += [self._take(length) for _ in range(n)]
                left -= length * n
        while left:  # no subset closes the slack: cut the longest remainder
            length = max(self.waiting)
            doc, start, ids = self._take(length)
            n = min(left, length)
            sequence.append((doc, start, ids[: 4 * n]))
            if n < length:
                self._wait((doc, start + n, ids[4 * n :]))
            left -= n
        return sequence

    def finish(self) -> list[list[Piece]]:
        out = []
        while self.tokens:
            capacity = self.window if self.tokens >= self.window else 1 << (self.tokens.bit_length() - 1)
            out.append(self._fill(capacity))
        return out


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with `ids` (bytes) on request.

    Sequences hold `window` tokens, but for the last few of a partition, which hold a power of two.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    end = end_id.to_bytes(4, "little")
    names = ["__id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("tokens")
        bpe, packer = load(tokenizer), Packer(window)
        base, number = TaskContext.get().partitionId() << 40, 0
        known: dict[int, tuple] = {}  # ordinal: id, tokens, tokens not yet placed
        ordinal = 0

        def rows(sequences: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal number
            columns = [[] for _ in names]
            for sequence in sequences:
                at = 0
                for doc, start, ids in sequence:
                    key, total, left = known[doc]
                    n = len(ids) // 4
                    row = (key, start, n, zlib.crc32(ids), total, base + number, at, ids)
                    for c, v in zip(columns, row, strict=False):
                        c.append(v)
                    at += n
                    if left == n:
                        del known[doc]
                    else:
                        known[doc] = (key, total, left - n)
                number += 1
            types = [id_type, *[pa.int64()] * 6, *[pa.binary()] * with_ids]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        id_type = pa.int64()
        for batch in batches:
            id_type, sequences = batch.column(0).type, []
            for key, ids in zip(batch.column(0).to_pylist(), bpe.encode_batch([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids += end
                known[ordinal] = (key, len(ids) // 4, len(ids) // 4)
                sequences += packer.put(ordinal, ids)
                ordinal += 1
            if sequences:
                yield rows(sequences)
        if rest := packer.finish():
            yield rows(rest)

    picked = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    schema = f"__id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids binary" * with_ids
    return picked.mapInArrow(run, schema).withColumnRenamed("__id", doc_id)
