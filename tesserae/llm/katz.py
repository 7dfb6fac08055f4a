"""Language-model scores by Katz backoff over word n-grams.

Counts are discounted by Good-Turing, and the freed probability goes to unseen words
in proportion to the next lower order. All backoff weights are normalised exactly: over
the known words and one unknown word, the probabilities after any history sum to one.

    p(w | h) = d(c(h, w)) * c(h, w) / (c(h) + 1/2)    if the n-gram was seen
             = alpha(h) * p(w | h')                   otherwise; h' is h without its first word
    p(w)     = scale * d(c(w)) * c(w) / N             if the word was seen, else the unknown word's share

The half count is kept for what was never seen, as there may be nothing to discount. A
history that was not seen backs off whole. Before a text stands one end token, so its
first tokens have shorter histories. alpha(h) = (1 - high) / (1 - low), where high and low
are what the words seen after h take of the two orders.

Words are 64-bit hashes, n-grams hashes of the hashes. Blocks of documents send each
distinct n-gram once with its count, split by hash into partitioned count tables; the
tables answer with totals, and mark one block as the owner of each n-gram. Owners sum,
per history, what the seen words take of either order; those sums, which other tables add
up, give alpha per history (only histories that held-out documents have can need one). Scores are evaluated from the lowest order up, each backing
off to the one before. A frequent word is one key per block, and no task holds all
n-grams of a history. Orders are counted one after the other, and each result is written
down, so that what was sent for it can go.

Cases: null and empty texts are one end token; any length is read whole; repeated rows
count as often as they stand; rows with a null id are training rows; without training
rows every word is the unknown one; no rows give no rows; columns of other names pass
unread; the sums that make alpha are added as integers (steps of 2**-36), so neither ties
nor the order of rows change a score.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kit import Words, as_long, block_count, bound_batches, enter, flat, forget, hashes, lower_ascii, mix, pieces, settle, trim
from .packed import Relay, bundle, cut, packed, packed_keys, part_of, rows_of, unpacked, unpacked_keys

U64 = np.uint64
END = U64(0x1B873593CC9E2D51)  # stands for the end token, and for what precedes a text
NAMES = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
DISCOUNTED = 5  # counts up to this one are discounted
FINE = 1 << 36  # sums are sent in steps of 1 / FINE
SMALL, ANSWER = "part long, block long, payload binary", "block long, part long, payload binary"


def planes(values: np.ndarray) -> np.ndarray:
    """Integers byte plane by byte plane: the high ones are zeros and pack well."""
    return values.astype("<i8").view(np.uint8).reshape(-1, 8).T


def unplaned(raw: bytes, n: int, at: int = 0) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T).view("<i8").ravel()


class Keys:
    """The distinct keys of a block in order, where each token's key is among them, how often training tokens have it,
    and whether any other token does."""

    def __init__(self, key: np.ndarray, trains: np.ndarray):
        order = np.argsort(key)
        ordered = key[order]
        first = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(key) else np.zeros(0, bool)
        self.keys = ordered[first]
        self.of = np.empty(len(key), np.int32)
        self.of[order] = np.cumsum(first, dtype=np.int32) - 1
        first = np.flatnonzero(first)
        self.count = np.add.reduceat(trains[order].astype(np.int64), first) if len(key) else np.zeros(0, np.int64)
        self.held = np.diff(np.concatenate((first, [len(key)]))) > self.count


class Tokens:
    """The tokens of a block's documents, and the n-grams that end with each."""

    def __init__(self, table: pa.Table):
        data, offsets = flat(table.column("__text"))
        found, counts = [], []
        for a, b in pieces(offsets):
            part = lower_ascii(data[offsets[a] : offsets[b]])
            words = Words(part, offsets[a : b + 1] - offsets[a])
            found.append(hashes(part, words.start, words.end))
            counts.append(words.count)
        count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.edges = np.concatenate(([0], np.cumsum(count + 1)))
        self.word = np.full(self.edges[-1], END, U64)
        inner = np.ones(self.edges[-1], bool)
        inner[self.edges[1:] - 1] = False
        if found:
            self.word[inner] = np.concatenate(found)
        self.trains = np.repeat(~table.column("__held").to_numpy(zero_copy_only=False).astype(bool), count + 1)

    def grams(self, order: int):
        """(m, tokens that have an n-gram of m words, hashes of those) for m up to `order`."""
        key = self.word
        yield 1, np.arange(len(key), dtype=np.int32), key
        place = np.arange(len(key)) - np.repeat(self.edges[:-1], np.diff(self.edges))
        for m in range(2, order + 1):
            # The second word of a text has two words and an end before the third, and so on.
            at = np.flatnonzero(place >= m - 2).astype(np.int32)
            before = np.full(len(key), END, U64)
            before[1:] = key[:-1]
            if m == 2:
                before[self.edges[:-1]] = END
            key = mix(before * U64(0x9E3779B97F4A7C15) + self.word)
            yield m, at, key[at]


def _counts(parts: int, lowest: int, order: int) -> Callable:
    """What a block has of the orders from `lowest` to `order`."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        enter("katz")
        trim()
        tokens = Tokens(table)
        rows = []
        for m, at, what in tokens.grams(order):
            if m >= lowest:
                found = Keys(what, tokens.trains[at])
                for p, a, b in cut(part_of(found.keys, parts)):
                    keys = packed_keys(found.keys[a:b])
                    rows.append((m * parts + p, key[0].as_py(), (b - a).to_bytes(8, "little") + len(keys).to_bytes(8, "little") + keys + packed(planes(found.count[a:b]), np.packbits(found.held[a:b]))))
        return rows_of("part block payload", rows)

    return run


def _totals(key: tuple, table: pa.Table) -> pa.Table:
    """For each block: totals of the keys it sent, whether it owns them, and whether held-out documents have them;
    as block -1 the counts of counts."""
    keys, counts, held = [], [], []
    for payload in table.column("payload").to_pylist():
        n, size = int.from_bytes(payload[:8], "little"), int.from_bytes(payload[8:16], "little")
        keys.append(unpacked_keys(payload[16 : 16 + size], n))
        raw = unpacked(payload[16 + size :])
        counts.append(unplaned(raw, n))
        held.append(np.unpackbits(np.frombuffer(raw, np.uint8, offset=8 * n), count=n).astype(bool))
    sizes = [len(k) for k in keys]
    keys, counts, held = np.concatenate(keys), np.concatenate(counts), np.concatenate(held)
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    total = np.add.reduceat(counts[order], first)
    spread = np.empty(len(keys), np.int64)
    times = np.diff(np.concatenate((first, [len(keys)])))
    spread[order] = np.repeat(total, times)
    held[order] = np.repeat(np.logical_or.reduceat(held[order], first), times)
    owns = np.zeros(len(keys), bool)
    owns[np.minimum.reduceat(order, first)] = True
    stats = np.bincount(np.minimum(total, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[: DISCOUNTED + 3]
    rows = [(-1, key[0].as_py(), np.concatenate((stats, [total.sum()])).astype("<i8").tobytes())]
    at = 0
    for block, n in zip(table.column("block").to_pylist(), sizes, strict=True):
        rows.append((block, key[0].as_py(), packed(planes(spread[at : at + n]), np.packbits(owns[at : at + n]), np.packbits(held[at : at + n]))))
        at += n
    return rows_of("block part payload", rows)


def discounts(of_count: np.ndarray) -> np.ndarray:
    """Good-Turing discounts of counts 0 .. DISCOUNTED + 1 (1 for the last, which stands for all above).

    of_count[r]: how many keys have count r. Where the counts of counts give no discount
    between 0 and 1, half a count is taken off.
    """
    k, out = DISCOUNTED, np.ones(DISCOUNTED + 2)
    ones = of_count[1]
    tail = (k + 1) * of_count[k + 1] / ones if ones else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * of_count[r + 1] / of_count[r] / r - tail) / (1 - tail) if of_count[r] and tail < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


class Model:
    """The corpus's counts of counts (a row per order from 1 on), and probabilities of seen n-grams."""

    def __init__(self, stats: np.ndarray):
        words = stats[0]
        self.n, self.v = int(words[-1]), int(words[1:-1].sum())
        self.d = [discounts(row[:-1]) for row in stats]
        small = np.arange(1, DISCOUNTED + 1)
        lost = float((words[small] * small * (1 - self.d[0][small])).sum())
        self.unknown = max(lost / self.n, 1 / (self.n + self.v + 1)) if self.n else 1.0
        self.scale = (1 - self.unknown) / (1 - lost / self.n) if self.n and lost < self.n else 0.0

    def word(self, count: np.ndarray) -> np.ndarray:
        known = self.scale * self.d[0][np.minimum(count, DISCOUNTED + 1)] * count / max(self.n, 1)
        return np.where(count > 0, known, self.unknown)

    def seen(self, m: int, count: np.ndarray, history: np.ndarray) -> np.ndarray:
        return self.d[m - 1][np.minimum(count, DISCOUNTED + 1)] * count / (history + 0.5)


class Order:
    """The n-grams of one order in a block: keys, totals, whether the block owns them, each token's key and history."""

    def __init__(self, m: int, at: np.ndarray, what: np.ndarray, said: dict[int, bytes], parts: int):
        found = Keys(what, np.zeros(len(what), bool))
        self.m, self.at, self.keys, self.of = m, at, found.keys, found.of
        n = len(self.keys)
        self.total, self.owns, self.held = np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, bool)
        for p, a, b in cut(part_of(self.keys, parts)):
            raw = unpacked(said[m * parts + p])
            self.total[a:b] = unplaned(raw, b - a)
            bits = np.frombuffer(raw, np.uint8, offset=8 * (b - a)).reshape(2, -1)
            self.owns[a:b], self.held[a:b] = (np.unpackbits(row, count=b - a).astype(bool) for row in bits)


class Counted:
    """A block's n-grams with the corpus's counts. `history` of an order: for each token in `at`, its history among the order below."""

    def __init__(self, table: pa.Table, said: dict[int, bytes], parts: int, order: int):
        tokens = Tokens(table)
        self.edges = tokens.edges
        self.orders = [Order(m, at, what, said, parts) for m, at, what in tokens.grams(order)]
        self.history: list[np.ndarray] = [np.zeros(0, np.int32)]
        for lower, upper in zip(self.orders[:-1], self.orders[1:], strict=True):
            of = np.zeros(len(tokens.word), np.int32)
            of[1:][lower.at[lower.at < len(of) - 1]] = lower.of[lower.at < len(of) - 1]
            if upper.m == 2 and len(self.edges) > 1:  # before a text stands the end token, which every text has
                of[self.edges[:-1]] = lower.of[self.edges[1:] - 1]
            self.history.append(of[upper.at])

    def lower(self, model: Model, m: int) -> np.ndarray:
        """For the tokens of order m: what a seen n-gram has of order m - 1."""
        below = self.orders[m - 2]
        where = np.searchsorted(below.at, self.orders[m - 1].at)
        count = below.total[below.of[where]]
        if m == 2:
            return model.word(count)
        return model.seen(m - 1, count, self.orders[m - 3].total[self.history[m - 2][where]])


def _said(table: pa.Table, step: int) -> dict[int, bytes]:
    mine = table.filter(pa.array(table.column("step").to_numpy() == step))
    return dict(zip(mine.column("part").to_pylist(), mine.column("payload").to_pylist(), strict=True))


def _model(said: pa.Table, order: int) -> Model:
    """From the counts of counts that every block is sent."""
    stats = np.zeros((order, DISCOUNTED + 4), np.int64)
    for m, r, n in json.loads(_said(said, 2)[-1]):
        stats[m - 1, r] = n
    return Model(stats)


def _sums(parts: int, order: int, relay: Relay) -> Callable:
    """Per history of a block: what the n-grams it owns take of the higher and of the lower order."""

    def run(key: tuple, docs: pa.Table, said: pa.Table) -> pa.Table:
        enter("katz")
        trim()
        if not docs.num_rows:
            return rows_of("part block payload", [])
        said = relay.opened(said)
        model, c = _model(said, order), Counted(docs, _said(said, 0), parts, order)
        rows = []
        for upper, below, history in zip(c.orders[1:], c.orders[:-1], c.history[1:], strict=True):
            token = np.zeros(len(upper.keys), np.int64)
            token[upper.of] = np.arange(len(upper.of))  # a token that has the n-gram
            mine = np.flatnonzero(upper.owns & (upper.total > 0))
            of, n = history[token[mine]], len(below.keys)
            fine = lambda p: np.rint(np.bincount(of, p, n) * FINE).astype(np.int64)  # noqa: B023, E731
            high, low = fine(model.seen(upper.m, upper.total[mine], below.total[of])), fine(c.lower(model, upper.m)[token[mine]])
            asks = np.zeros(n, bool)  # histories that this block has before an unseen word
            asks[history[upper.total[upper.of] == 0]] = True
            # Only before unseen words of held-out documents is alpha needed: other histories stay at home.
            send = np.flatnonzero((below.total > 0) & below.held & (asks | (high > 0)))
            for p, a, b in cut(part_of(below.keys[send], parts)):
                some = send[a:b]
                keys = packed_keys(below.keys[some])
                rest = packed(planes(high[some]), planes(low[some]), np.packbits(asks[some]))
                rows.append((upper.m * parts + p, key[0].as_py(), (b - a).to_bytes(8, "little") + len(keys).to_bytes(8, "little") + keys + rest))
        return rows_of("part block payload", rows)

    return run


def _weights(key: tuple, table: pa.Table) -> pa.Table:
    """For each block: alpha of the histories that it asks for, in the order of their keys."""
    keys, high, low, asks = [], [], [], []
    for payload in table.column("payload").to_pylist():
        n, size = int.from_bytes(payload[:8], "little"), int.from_bytes(payload[8:16], "little")
        keys.append(unpacked_keys(payload[16 : 16 + size], n))
        raw = unpacked(payload[16 + size :])
        high.append(unplaned(raw, n))
        low.append(unplaned(raw, n, 8 * n))
        asks.append(np.unpackbits(np.frombuffer(raw, np.uint8, offset=16 * n), count=n).astype(bool))
    sizes = [len(k) for k in keys]
    keys, high, low = (np.concatenate(x) for x in (keys, high, low))
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    lengths = np.diff(np.concatenate((first, [len(keys)])))
    alpha = np.empty(len(keys))
    alpha[order] = np.repeat((FINE - np.add.reduceat(high[order], first)) / (FINE - np.add.reduceat(low[order], first)), lengths)
    rows, at = [], 0
    for block, n, asked in zip(table.column("block").to_pylist(), sizes, asks, strict=True):
        rows.append((block, key[0].as_py(), packed(alpha[at : at + n][asked])))
        at += n
    return rows_of("block part payload", rows)


def _scores(parts: int, order: int, relay: Relay) -> Callable:
    def run(key: tuple, docs: pa.Table, said: pa.Table) -> pa.Table:
        enter("katz")
        trim()
        if not docs.num_rows:
            return pa.table([docs.column("__id"), *(pa.array([], t) for t in (pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2))], names=NAMES)
        said = relay.opened(said)
        model, c = _model(said, order), Counted(docs, _said(said, 0), parts, order)
        weights = _said(said, 1)
        words = c.orders[0]
        count = words.total[words.of]
        p = model.word(count)
        for upper, below, history in zip(c.orders[1:], c.orders[:-1], c.history[1:], strict=True):
            total = upper.total[upper.of]
            asks = np.zeros(len(below.keys), bool)
            asks[history[total == 0]] = True
            asked = np.flatnonzero(asks & (below.total > 0))
            alpha = np.ones(len(below.keys))  # a history that was not seen backs off whole
            for part, a, b in cut(part_of(below.keys[asked], parts)):
                alpha[asked[a:b]] = np.frombuffer(unpacked(weights[upper.m * parts + part]), "<f8", b - a)
            p[upper.at] = np.where(total > 0, model.seen(upper.m, total, below.total[history]), alpha[history] * p[upper.at])
        starts = c.edges[:-1]
        sums = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros(0)
        base = np.log10((count + 1) / (model.n + model.v + 1))
        columns = [as_long(np.diff(c.edges)), as_long(sums((count > 0).astype(np.int64))), as_long(np.full(len(starts), model.n)), pa.array(sums(base)), pa.array(sums(np.log10(p)))]
        return pa.table([docs.column("__id"), docs.column("__held"), *columns], names=NAMES)

    return run


def score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", order: int = 3, block_bytes: int = 8 << 20, relay_from: int = 4096) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score, both log10.

    held_out: a condition on docs; rows for which it is true are scored but not learnt from. order: words in the longest n-gram.
    relay_from: blocks from which on rows go through a relay.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = docs.sparkSession
    bound_batches(spark)
    total = docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
    blocks = block_count(spark, total, block_bytes)
    parts = max(blocks // 4, min(blocks, 32))  # of each order of counts
    picked = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"), F.coalesce(held_out, F.lit(False)).alias("__held"))
    # Dealt by text as well: rows without an id, or with the same, spread.
    dealt = picked.withColumn("block", F.pmod(F.xxhash64("__id", "__text"), F.lit(blocks))).repartition(blocks, "block")
    relay = Relay(blocks, (order + 1) * parts, blocks >= relay_from)
    counts = None
    for lowest, highest in [(1, 2), *((m, m) for m in range(3, order + 1))]:
        sent = relay.across(dealt.groupBy("block").applyInArrow(relay.sending(_counts(parts, lowest, highest), "part", "block"), SMALL), "part", "block")
        found = settle(relay.across(sent.groupBy("part").applyInArrow(relay.sending(relay.receiving(_totals), "block", "part"), ANSWER), "block", "part"))
        counts = found if counts is None else counts.unionByName(found)
    # Counts of counts are a few numbers; every block gets a copy beside its own answers.
    stats = counts.where("block = -1").mapInArrow(_unpack_stats(parts, relay), "order long, r int, n long").groupBy("order", "r").agg(F.sum("n").alias("n"))
    told = stats.agg(F.to_json(F.collect_list(F.array("order", F.col("r").cast("long"), "n"))).alias("payload"))
    told = told.mapInArrow(_told(relay), "payload binary").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(-1).cast("long").alias("part"), "payload", F.lit(2).alias("step"))
    said = counts.where("block >= 0").withColumn("step", F.lit(0)).unionByName(told)
    sums = relay.across(dealt.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(relay.sending(_sums(parts, order, relay), "part", "block"), SMALL), "part", "block")
    weights = settle(relay.across(sums.groupBy("part").applyInArrow(relay.sending(relay.receiving(_weights), "block", "part"), ANSWER), "block", "part")).withColumn("step", F.lit(1))
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    both = said.unionByName(weights)
    return dealt.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(_scores(parts, order, relay), schema).withColumnRenamed("id", doc_id)


def _told(relay: Relay) -> Callable:
    """The counts of counts as a block gets them: bundled if its other rows are."""

    def run(batches):
        for batch in batches:
            payloads = [text.encode() for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([bundle([(-1, -1, p)]) if relay.on else p for p in payloads], pa.binary())], ["payload"])

    return run


def _unpack_stats(parts: int, relay: Relay) -> Callable:
    def run(batches):
        for batch in batches:
            table = relay.opened(pa.Table.from_batches([batch]))
            rows = [(part // parts, r, n) for part, p in zip(table.column("part").to_pylist(), table.column("payload").to_pylist(), strict=True) for r, n in enumerate(np.frombuffer(p, "<i8").tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64()))], ["order", "r", "n"])

    return run
