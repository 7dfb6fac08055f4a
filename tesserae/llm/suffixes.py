"""Removal of byte strings that an earlier document also holds, by suffix arrays.

A byte goes if it is covered by a string of ``width`` bytes that also starts in a
document with a smaller id.  Four steps, all on packed binary rows:

1. Documents are dealt into blocks by a hash of their id and text.  A block fingerprints its
   windows: of the k-grams inside a window of ``width`` bytes the one with the smallest
   hash is its *anchor*, so equal windows have equal anchors wherever they stand.
2. Anchors meet by hash.  Those that only one document has are dropped, which loses
   nothing: a window with such an anchor stands in no other document.
3. Runs of windows with the same shared anchor become short segments.  Each block sends
   each distinct segment once, with the smallest id of its documents, to the bucket of
   its anchor.  A bucket builds a suffix array over its segments: suffixes smaller than
   their successors are sorted directly, the rest are induced by one scan over byte
   buckets, and adjacent common prefixes of ``width`` or more bytes mark equal windows.
   The smallest id of each run of equal windows goes back to the blocks that sent them.
4. Each block marks the bytes that windows with a smaller first document cover.

Heavy repetition stays cheap: a block sends a repeated segment or anchor once however
many documents have it, so no task receives more than blocks times distinct strings.

Cases: null and empty texts and texts shorter than the window lose nothing; documents
that share an id (or are repeated rows) do not remove each other's bytes; rows with a
null id come after all others and do not remove each other's bytes; of documents that hold
a string, the smallest id keeps it, so there are no ties; no rows give no rows; columns of other
names pass unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kit import Rolling, as_long, block_count, bound_batches, column, enter, flat, hashes, mix, pieces, trim
from .packed import Relay, cut, packed, part_of, rows_of, spread, unpacked

U64 = np.uint64
WIDTH = 50
#: A bucket sorts this many ranges of anchors one after the other.
RANGES = 8
NO_ID = np.iinfo(np.int64).max


# ---- suffix array -------------------------------------------------------------------


def _words(text: np.ndarray, at: np.ndarray, skip: int) -> np.ndarray:
    """The eight bytes from at + skip on as big-endian numbers (text is padded)."""
    view = np.ndarray((len(text) - 7,), ">u8", text.data, strides=(1,))
    return view[at + skip].astype(U64)


def _direct_sort(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their next `depth` bytes: eight bytes first, then ties only, eight by eight."""
    key = _words(text, at, 0)
    order = np.argsort(key)
    at, key = at[order], key[order]
    group = np.cumsum(np.concatenate(([True], key[1:] != key[:-1]))) if len(at) else key  # rank of each so far
    for skip in range(8, depth, 8):
        tied = np.zeros(len(at), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        rows = np.flatnonzero(tied)
        if not len(rows):
            break
        key = _words(text, at[rows], skip)
        by_key = np.argsort(key)
        key = key[by_key]
        rank = np.empty(len(rows), np.int64)
        rank[by_key] = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))
        both = group[rows].astype(np.int64) * len(rows) + rank
        order = np.argsort(both)
        at[rows] = at[rows[order]]
        both = both[order]
        # Ranks keep their order if a split tie takes numbers inside it: renumber all.
        new = np.concatenate(([True], group[1:] != group[:-1]))
        new[rows[1:]] |= both[1:] != both[:-1]
        group = np.cumsum(new)
    return at


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted positions, in the order of their next `depth` bytes, by two-stage sorting.

    text: uint8, ending in `depth` + 8 zero bytes of padding, which are not wanted.
    """
    n = len(text)
    # A suffix is small if it is less than its successor: its byte is below the next differing byte.
    differs = np.flatnonzero(text[:-1] != text[1:])
    every = np.arange(n, dtype=np.int32)
    next_diff = np.full(n, n - 1, np.int32)
    next_diff[differs] = differs
    next_diff = np.minimum.accumulate(next_diff[::-1])[::-1]
    small = text[next_diff] < text[np.minimum(next_diff + 1, n - 1)]
    small[next_diff >= n - 1] = True
    # Inducing a suffix needs its successors down to the next small one.
    next_small = np.where(small, every, np.int32(n - 1))
    next_small = np.minimum.accumulate(next_small[::-1])[::-1]
    reach = np.zeros(n, np.int32)
    spots = np.flatnonzero(wanted).astype(np.int32)
    reach[spots] = next_small[spots]
    need = np.maximum.accumulate(reach) >= every
    need &= every >= (spots[0] if len(spots) else n)
    sorted_small = _direct_sort(text, np.flatnonzero(need & small).astype(np.int32), depth)
    large = need & ~small
    edges = np.searchsorted(text[sorted_small], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for byte in range(256):
        done = []
        wave = np.concatenate(waiting[byte]) if waiting[byte] else spots[:0]
        waiting[byte] = []
        while len(wave):  # large suffixes of this bucket, by the length of their run of this byte
            done.append(wave)
            before = wave[wave > 0] - 1
            wave = before[large[before] & (text[before] == byte)]
        done.append(sorted_small[edges[byte] : edges[byte + 1]])
        bucket = np.concatenate(done)
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[large[before] & (text[before] > byte)]
        if len(before):
            first = text[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            cuts = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
            for a, b in zip(cuts, [*cuts[1:], len(before)], strict=True):
                waiting[first[a]].append(before[a:b])
    order = np.concatenate(out) if out else spots
    return order[wanted[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it, up to `most` (the first: 0)."""
    out = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for skip in range(0, most, 8):
        if not len(alive):
            break
        gap = _words(text, order[alive], skip) ^ _words(text, order[alive - 1], skip)
        same = gap == 0
        part = gap[~same]
        zeros = np.zeros(len(part), np.int64)
        for k in range(1, 8):
            zeros += part < U64(1) << U64(64 - 8 * k)
        out[alive[~same]] = skip + zeros
        alive = alive[same]
        out[alive] = skip + 8
    return np.minimum(out, most)


# ---- windows and anchors ------------------------------------------------------------


def _sliding_min(h: np.ndarray, n: int) -> np.ndarray:
    size = 1
    while size * 2 <= n:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (n - size)], h[n - size :]) if n > size else h


class Block:
    """The documents of a block in the order of their ids, and their runs of windows with equal anchors."""

    def __init__(self, table: pa.Table, width: int):
        ids = table.column("__id").to_numpy(zero_copy_only=False) if not table.column("__id").null_count else table.column("__id").fill_null(NO_ID).to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order].astype(np.int64)
        data, offsets = flat(table.column("__text"))
        lengths = np.diff(offsets)[order]
        self.offsets = np.concatenate(([0], np.cumsum(lengths)))
        if len(order) and (order[1:] < order[:-1]).any():
            data = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in order])
        self.data, self.width = data, width
        self.order = order
        start, end, key = [], [], []
        for a, b in pieces(self.offsets):
            for x, part in zip(self._runs(self.data[self.offsets[a] : self.offsets[b]], self.offsets[a : b + 1] - self.offsets[a]), (start, end, key), strict=True):
                part.append(x + self.offsets[a] if part is not key else x)
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.start, self.end, self.key = join(start, np.int64), join(end, np.int64), join(key, U64)
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1

    def _runs(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Runs of windows: first window's start, last window's end, anchor."""
        width = self.width
        k = max(4, width // 2 - 1)
        windows = len(data) - width + 1
        if windows <= 0:
            none = np.zeros(0, np.int64)
            return none, none, none.astype(U64)
        least = _sliding_min(Rolling(data).windows(k), width - k + 1)
        whole = np.zeros(windows + 1, np.int32)  # windows that lie in one text
        ok = np.diff(offsets) >= width
        np.add.at(whole, offsets[:-1][ok], 1)
        np.add.at(whole, offsets[1:][ok] - width + 1, -1)
        inside = np.cumsum(whole[:-1]) > 0
        new = np.ones(windows, bool)
        new[1:] = least[1:] != least[:-1]
        new[offsets[:-1][ok]] = True
        new[1:] |= ~inside[:-1]
        begin = np.flatnonzero(new & inside)
        stop = np.ones(windows, bool)
        stop[:-1] = new[1:] | ~inside[1:]
        last = np.flatnonzero(stop & inside)
        # The least of many hashes is small; scrambled once more, anchors spread evenly over parts.
        return begin, last + width, mix(least[begin])


def _anchors(width: int, parts: int) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        enter("suffixes")
        trim()
        block = Block(table, width)
        order = np.argsort(block.key)
        keys, doc = block.key[order], block.ids[block.doc[order]]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        many = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first) if len(first) else np.zeros(0, bool)
        keys = keys[first]
        rows = [(p, key[0].as_py(), keys[a:b].astype("<u8").tobytes() + np.packbits(many[a:b]).tobytes() + (b - a).to_bytes(8, "little")) for p, a, b in cut(part_of(keys, parts))]
        return rows_of("part block payload", rows)

    return run


def _shared(key: tuple, table: pa.Table) -> pa.Table:
    """Of each block's anchors, those that two or more documents have, as bits in the order they came."""
    keys, many, counts = [], [], []
    for payload in table.column("payload").to_pylist():
        n = int.from_bytes(payload[-8:], "little")
        keys.append(np.frombuffer(payload, "<u8", n))
        many.append(np.unpackbits(np.frombuffer(payload, np.uint8, offset=8 * n)[:-8], count=n).astype(bool))
        counts.append(n)
    keys, many = np.concatenate(keys), np.concatenate(many)
    order = np.argsort(keys)
    keys = keys[order]
    same = keys[1:] == keys[:-1]
    many[order[1:]] |= same
    many[order[:-1]] |= same
    at, rows = 0, []
    for block, n in zip(table.column("block").to_pylist(), counts, strict=True):
        rows.append((block, key[0].as_py(), np.packbits(many[at : at + n]).tobytes()))
        at += n
    return rows_of("block part payload", rows)


def _equal(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each distinct substring, and which of these each one equals: by two hashes, 128 bits in all."""
    one, two = hashes(data, start, end, 1), hashes(data, start, end, 2)
    _, first, of = np.unique(one, return_index=True, return_inverse=True)
    if (two[first][of] != two).any():
        _, first, of = np.unique(np.stack((one, two), axis=1), axis=0, return_index=True, return_inverse=True)
    return first, of.reshape(-1)


class Segments:
    """A block's runs whose anchor is shared, and the distinct strings among them, by bucket."""

    def __init__(self, block: Block, shared: pa.Table, parts: int):
        keys = np.unique(block.key)
        bits = np.zeros(len(keys), bool)
        part = part_of(keys, parts)
        said = dict(zip(shared.column("part").to_pylist(), shared.column("payload").to_pylist(), strict=True))
        for p, a, b in cut(part):
            if p in said:
                bits[a:b] = np.unpackbits(np.frombuffer(said[p], np.uint8), count=b - a)
        self.rows = np.flatnonzero(bits[np.searchsorted(keys, block.key)]) if len(keys) else np.zeros(0, np.int64)
        first, self.of = _equal(block.data, block.start[self.rows], block.end[self.rows])
        fine = part_of(block.key[self.rows[first]], parts * RANGES)
        order = np.argsort(fine, kind="stable")  # distinct strings, bucket by bucket and range by range
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.of = place[self.of]
        self.first, self.part, self.range = self.rows[first][order], fine[order] // RANGES, fine[order] % RANGES
        self.size = block.end[self.first] - block.start[self.first]


def _segments(width: int, parts: int, relay: Relay) -> Callable:
    def run(key: tuple, docs: pa.Table, shared: pa.Table) -> pa.Table:
        enter("suffixes")
        trim()
        if not docs.num_rows:
            return rows_of("part block payload", [])
        block = Block(docs, width)
        segments = Segments(block, relay.opened(shared), parts)
        rows = []
        for p, a, b in cut(segments.part):
            start, size = block.start[segments.first[a:b]], segments.size[a:b]
            data = block.data[spread(start, size)]
            per = np.bincount(segments.range[a:b], minlength=RANGES)
            rows.append((p, key[0].as_py(), packed(per.astype("<i8"), size.astype("<i8"), block.ids[block.doc[segments.first[a:b]]].astype("<i8"), data)))
        return rows_of("part block payload", rows)

    return run


def first_holders(sizes: np.ndarray, ids: np.ndarray, data: np.ndarray, width: int) -> np.ndarray:
    """For each window of each string (strings stand back to back in data): the smallest id of a string that has it."""
    n = len(data)
    text = np.concatenate((data, np.zeros(width + 16, np.uint8)))
    ends = np.cumsum(sizes)
    windows = sizes - width + 1
    wanted = np.zeros(len(text), bool)
    spots = spread(ends - sizes, windows)
    wanted[spots] = True
    order = suffix_order(text, wanted, width)
    prefix = common_prefixes(text, order, width)
    first = np.flatnonzero(prefix < width)
    owner = np.zeros(n + 1, np.int64)
    owner[spots] = np.repeat(ids, windows)
    least = np.minimum.reduceat(owner[order], first) if len(first) else owner[:0]
    owner[order] = np.repeat(least, np.diff(np.concatenate((first, [len(order)]))))
    return owner[spots]


def _distinct(sent: list[tuple[np.ndarray, np.ndarray, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sizes, least ids and bytes of the distinct strings that blocks sent, and which of them each block's are."""
    distinct: dict[bytes, int] = {}
    least: list[int] = []
    mine = []
    for sizes, ids, raw in sent:
        at, own = 0, []
        for end, i in zip(np.cumsum(sizes).tolist(), ids.tolist(), strict=True):
            string = raw[at:end]
            at = end
            k = distinct.setdefault(string, len(least))
            if k == len(least):
                least.append(i)
            elif i < least[k]:
                least[k] = i
            own.append(k)
        mine.append(np.array(own, np.int64))
    return np.fromiter(map(len, distinct), np.int64, len(distinct)), np.array(least, np.int64), np.frombuffer(b"".join(distinct), np.uint8), mine


def _holders(width: int) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        enter("suffixes")
        trim()
        sent, found = [], []
        for payload in table.column("payload").to_pylist():
            raw = unpacked(payload)
            per = np.frombuffer(raw, "<i8", RANGES)
            n = int(per.sum())
            sizes, ids = np.frombuffer(raw, "<i8", n, 8 * RANGES), np.frombuffer(raw, "<i8", n, 8 * (RANGES + n))
            rows = np.concatenate(([0], np.cumsum(per)))
            at = np.concatenate(([0], np.cumsum(sizes)))[rows] + 8 * (RANGES + 2 * n)
            sent.append((sizes, ids, raw, rows, at))
            found.append([])
        for r in range(RANGES):
            sizes, least, data, mine = _distinct([(s[x[r] : x[r + 1]], i[x[r] : x[r + 1]], raw[at[r] : at[r + 1]]) for s, i, raw, x, at in sent])
            holders = first_holders(sizes, least, data, width)
            windows = sizes - width + 1
            starts = np.cumsum(windows) - windows
            for own, out in zip(mine, found, strict=True):
                out.append(holders[spread(starts[own], windows[own])].astype("<i8"))
        return rows_of("block part payload", [(block, key[0].as_py(), packed(*out)) for block, out in zip(table.column("block").to_pylist(), found, strict=True)])

    return run


def _covered(block: Block, segments: Segments, found: pa.Table) -> np.ndarray:
    """Which bytes of a block's data go."""
    said = dict(zip(found.column("part").to_pylist(), found.column("payload").to_pylist(), strict=True))
    width = block.width
    windows = segments.size - width + 1
    holders = np.concatenate([np.frombuffer(unpacked(said[p]), "<i8") for p, _, _ in cut(segments.part)]) if len(segments.part) else np.zeros(0, np.int64)
    starts = np.cumsum(windows) - windows
    cover = np.zeros(len(block.data) + 1, np.int32)
    step = 50_000
    for a in range(0, len(segments.rows), step):
        rows, of = segments.rows[a : a + step], segments.of[a : a + step]
        size = windows[of]
        gone = holders[spread(starts[of], size)] < np.repeat(block.ids[block.doc[rows]], size)
        at = spread(block.start[rows], size)[gone]
        if len(at):  # runs of neighbouring windows count as one
            edge = np.flatnonzero(np.diff(at) != 1)
            np.add.at(cover, at[np.concatenate(([0], edge + 1))], 1)
            np.add.at(cover, at[np.concatenate((edge, [len(at) - 1]))] + width, -1)
    np.cumsum(cover, out=cover)
    return cover[:-1] > 0


def _removed(docs: DataFrame, doc_id: str, text: str, width: int, block_bytes: int, relay_from: int, finish: Callable, schema: str, *more: str) -> DataFrame:
    """Runs the steps; finish(docs table, its block, covered bytes) makes a block's result. From `relay_from` blocks on rows go through a relay."""
    spark = docs.sparkSession
    bound_batches(spark)
    total = docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
    parts = block_count(spark, total, block_bytes)
    picked = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__text"), *more)
    # Dealt by text as well: rows without an id, or with the same, spread.
    dealt = picked.withColumn("block", F.pmod(F.xxhash64("__id", "__text"), F.lit(parts))).repartition(parts, "block")
    small = "part long, block long, payload binary"
    answer = "block long, part long, payload binary"
    relay = Relay(parts, parts, parts >= relay_from)
    anchors = relay.across(dealt.select("block", "__id", "__text").groupBy("block").applyInArrow(relay.sending(_anchors(width, parts), "part", "block"), small), "part", "block")
    shared = relay.across(anchors.groupBy("part").applyInArrow(relay.sending(relay.receiving(_shared), "block", "part"), answer), "block", "part")
    segments = dealt.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(relay.sending(_segments(width, parts, relay), "part", "block"), small)
    segments = relay.across(segments, "part", "block")
    holders = relay.across(segments.groupBy("part").applyInArrow(relay.sending(relay.receiving(_holders(width)), "block", "part"), answer), "block", "part")
    both = shared.withColumn("step", F.lit(0)).unionByName(holders.withColumn("step", F.lit(1)))

    def end(key: tuple, mine: pa.Table, said: pa.Table) -> pa.Table:
        enter("suffixes")
        trim()
        block = Block(mine, width)
        said = relay.opened(said)
        step = said.column("step").to_numpy()
        found = Segments(block, said.filter(pa.array(step == 0)), parts)
        return finish(mine, block, _covered(block, found, said.filter(pa.array(step == 1))))

    return dealt.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(end, schema)


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, block_bytes: int = 8 << 20, relay_from: int = 4096) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256 of the bytes that stay,
    and the removed runs as arrays of byte positions `starts` and `ends`."""

    def finish(mine: pa.Table, block: Block, gone: np.ndarray) -> pa.Table:
        n = len(block.ids)
        offsets = block.offsets
        before = np.concatenate(([0], np.cumsum(gone, dtype=np.int32)))
        edge = np.zeros(len(gone) + 1, bool)
        edge[offsets] = True
        opens = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate(([False], gone[:-1]))))
        closes = np.flatnonzero(gone & (edge[1:] | ~np.concatenate((gone[1:], [False])))) + 1
        place = np.searchsorted(opens, offsets)
        whole, keep = block.data, ~gone
        sha, starts, ends = [], [], []
        for i in range(n):
            a, b, x, y = offsets[i], offsets[i + 1], place[i], place[i + 1]
            sha.append(hashlib.sha256(whole[a:b] if x == y else whole[a:b][keep[a:b]]).hexdigest())
            starts.append(opens[x:y] - a)
            ends.append(closes[x:y] - a)
        ids = mine.column("__id").combine_chunks().take(pa.array(block.order)) if n else mine.column("__id")
        lists = pa.list_(pa.int64())
        return pa.table([ids, as_long(np.diff(offsets)), as_long(np.diff(before[offsets])), as_long(np.diff(place)), pa.array(sha, pa.string()), pa.array(starts, lists), pa.array(ends, lists)], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends"])

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"
    return _removed(docs, doc_id, text, width, block_bytes, relay_from, finish, schema).withColumnRenamed("id", doc_id)


def strip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, block_bytes: int = 8 << 20, relay_from: int = 4096) -> DataFrame:
    """The documents with repeated strings cut out of their texts; characters that a cut would split stay whole."""
    names = docs.columns
    others = [n for n in names if n not in (doc_id, text)]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def finish(mine: pa.Table, block: Block, gone: np.ndarray) -> pa.Table:
        follow = (block.data & 0xC0) == 0x80
        start = np.flatnonzero(~follow)
        if len(start):  # a character goes only if all its bytes do
            gone = np.repeat(np.minimum.reduceat(gone, start), np.diff(np.concatenate((start, [len(gone)]))))
        kept = np.concatenate(([0], np.cumsum(~gone, dtype=np.int32)))[block.offsets]
        data = block.data[~gone].tobytes()
        null = mine.column("__text").is_null().to_numpy()[block.order]
        texts = [None if z else data[a:b].decode("utf-8") for a, b, z in zip(kept[:-1], kept[1:], null, strict=True)]
        order = pa.array(block.order)
        return pa.table([mine.column("__id").take(order), pa.array(texts, pa.string()), *(mine.column(f"__{i}").take(order) for i in range(len(others)))], names=["__id", "__text", *(f"__{i}" for i in range(len(others)))])

    schema = "__id long, __text string" + "".join(f", __{i} {kinds[n]}" for i, n in enumerate(others))
    more = [column(n).alias(f"__{i}") for i, n in enumerate(others)]
    out = _removed(docs, doc_id, text, width, block_bytes, relay_from, finish, schema, *more)
    back = {doc_id: F.col("__id").cast(kinds[doc_id]), text: F.col("__text")} | {n: F.col(f"__{i}") for i, n in enumerate(others)}
    return out.select(*(back[n].alias(n) for n in names))
