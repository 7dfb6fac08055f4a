"""Near-duplicate documents by MinHash with one permutation.

A document's shingles are hashed once. The upper bits choose a bin, the least of the
rest is the bin's value; empty bins borrow from a bin that a two-universal probe
sequence finds (optimal densification), so every document has all bins. Rows of bins
make bands, and documents that agree in a band share a bucket.

Documents with equal shingle sets are one class first, so copies never meet pairwise.
In a bucket classes are joined to one centre only (a star), which bounds the candidates
by the buckets' sizes; every candidate is confirmed on the two full sets. First each
class is compared with the smallest of its centres, which links most of what belongs
together; then with those of its other centres that are still in another component.

A bucket that still holds several components after that may hide links between members
other than its centre (a passage that many documents share puts strangers in one
bucket). The members of all such buckets are joined exactly: shingles have one order,
rare ones first, and two sets that are similar enough share one of their first few
shingles (a prefix filter with positions), so no pair of a bucket is left out, and
strangers that differ in their rare shingles do not meet.

Cases: documents without words (null or empty texts too) have no shingles and are linked
with nothing; fewer words than a shingle make one shingle of all words; any length is
read whole; rows that share an id are one document, which is linked wherever one of its
texts is (n_shingles is each row's own); rows with a null id are left out of the links,
belong to no component (null) and are kept; no rows give no rows; columns of other names
pass unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .kit import Words, as_long, bound_batches, enter, flat, forget, hashes, lower_ascii, mix, pieces, settle, split_join

U64 = np.uint64
BINS, BANDS = 128, 32
#: Counters of how many documents have a shingle, which is all that the order of shingles needs.
SLOTS = 1 << 18


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of texts that stand back to back: 64-bit hashes and the text of each, in the order of texts."""
    words = Words(data, offsets)
    word = hashes(lower_ascii(data), words.start, words.end)
    n = len(word)
    chain = np.zeros(n, U64)
    left = words.first[1:][words.text] - np.arange(n)  # words from here to the text's end
    for i in range(size):
        here = left > i
        chain[here] *= U64(0x9E3779B97F4A7C15)
        chain[here] += word[np.flatnonzero(here) + i]
    whole = (left >= size) | (words.first[words.text] == np.arange(n)) & (left < size)
    text = words.text[whole]
    # The number of words is part of a short text's only shingle.
    found = mix(chain[whole] + np.minimum(left[whole], size).astype(U64) * U64(0xC2B2AE3D27D4EB4F))
    _, first = np.unique(mix(found + mix((text + 1).astype(U64))), return_index=True)
    first.sort()
    return found[first], text[first]


def signatures(found: np.ndarray, text: np.ndarray, n: int, bins: int = BINS) -> np.ndarray:
    """One value per text and bin; texts without shingles have zeros."""
    bits = bins.bit_length() - 1
    value = np.full(n * bins, np.iinfo(U64).max, U64)
    np.minimum.at(value, text * bins + (found >> U64(64 - bits)).astype(np.int64), found << U64(bits))
    value = value.reshape(n, bins)
    filled = value != np.iinfo(U64).max
    some = filled.any(axis=1)
    row, column = np.nonzero(~filled & some[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        probe = (mix(column.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(attempt)) >> U64(64 - bits)).astype(np.int64)
        hit = filled[row, probe]
        value[row[hit], column[hit]] = value[row[hit], probe[hit]]
        row, column = row[~hit], column[~hit]
    value[~some] = 0
    return value


def bands(value: np.ndarray, count: int = BANDS) -> np.ndarray:
    """A 64-bit key per text and band; the band's number is part of it."""
    n, bins = value.shape
    rows = value.reshape(n, count, bins // count)
    key = np.broadcast_to(mix(np.arange(1, count + 1).astype(U64)), (n, count)).copy()
    for i in range(rows.shape[2]):
        key *= U64(0x9E3779B97F4A7C15)
        key += rows[:, :, i]
        key = mix(key)
    return key


def _features(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """Per row: id, number of shingles, two sums that stand for the set, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("neardup")
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for a, b in pieces(offsets):
                n = b - a
                found, owner = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                count = np.bincount(owner, minlength=n)
                sums = []
                for salt in (1, 2):
                    total = np.concatenate((np.zeros(1, U64), np.cumsum(mix(found * U64(2 * salt + 1) + U64(salt)))))
                    ends = np.cumsum(count)
                    sums.append((total[ends] - total[ends - count]).view(np.int64))
                keys = bands(signatures(found, owner, n)).view(np.int64)
                ends = np.concatenate(([0], np.cumsum(np.where(count > 0, BANDS, 0))))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[count > 0].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), as_long(count), as_long(sums[0]), as_long(sums[1]), lists], ["id", "n", "s1", "s2", "keys"])

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, n long, s1 long, s2 long, keys array<long>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, set): the sorted shingle hashes of each row as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("neardup")
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for a, b in pieces(offsets):
                found, owner = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                cut = np.searchsorted(owner, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([np.sort(found[x:y]).tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["id", "set"])

    return docs.mapInArrow(run, "id long, set binary")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough. Each pair carries one set; the other joins it last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("neardup")
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both = np.concatenate((np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    two = one.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    return two.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _slot(shingle: np.ndarray) -> np.ndarray:
    return (shingle & U64(SLOTS - 1)).astype(np.int64)


def _rare_first(sets: DataFrame, percent: int) -> DataFrame:
    """(w, id, n, at, component): the shingles of each set that another of `percent` must share one of, rare ones first.

    Sets come with their components. How rare a shingle is, a counter tells that it may share with
    others: the order is the same for all sets, which is what counts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("neardup")
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                np.add.at(total, _slot(np.frombuffer(raw, "<u8")), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([as_long(some), as_long(total[some])], ["slot", "n"])

    counted = sets.select("set").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(SLOTS, np.int64)
    often[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("neardup")
        for batch in batches:
            ids, of, raw = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for i, x in enumerate(raw):
                w = np.frombuffer(x, "<u8")
                n = len(w)
                most = n - -(-percent * n // 100) + 1
                first = w[np.lexsort((w, often[_slot(w)]))[:most]]
                same = lambda v: as_long(np.full(len(first), v))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([as_long(first.view(np.int64)), same(ids[i]), same(n), as_long(np.arange(len(first))), same(of[i])], ["w", "id", "n", "at", "component"])

    return sets.select("id", "component", "set").mapInArrow(run, "w long, id long, n long, at long, component long")


def _left_over(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): every pair of different components that may be similar enough, by an exact prefix filter."""
    first = settle(_rare_first(sets, percent))
    # Of a shingle's list, its largest component is not compared with itself.
    per = first.groupBy("w", "component").agg(F.count(F.lit(1)).alias("m"))
    mixed = per.groupBy("w").agg(F.max(F.struct("m", "component")).alias("top"), F.count(F.lit(1)).alias("c")).where("c > 1").select("w", F.col("top.component").alias("top"))
    lists = settle(split_join(first, mixed, ["w"]))
    forget(first)
    # The smaller of two sets needs to be found by fewer of its shingles than the larger one is looked up by.
    few = F.expr(f"at < n - {2 * percent} * n div {100 + percent} + if({2 * percent} * n % {100 + percent} = 0, 1, 0)")
    one = lists.where(few).select("w", *[F.col(c).alias(f"{c}1") for c in ("id", "n", "at", "component", "top")])
    two = lists.select("w", *[F.col(c).alias(f"{c}2") for c in ("id", "n", "at", "component", "top")])
    # No larger overlap is possible than what follows the first common shingle.
    enough = f"least(n1 - at1, n2 - at2) * {100 + percent} >= {percent} * (n1 + n2)"
    smaller = "n1 < n2 OR n1 = n2 AND id1 < id2"
    h = F.xxhash64("w")
    meet = lambda x, y: x.withColumn("__h", h).join(y.withColumn("__h", h), ["w", "__h"])
    both = meet(one.where("component1 <> top1"), two).unionByName(meet(one.where("component1 = top1"), two.where("component2 <> top2")))
    on = both.where("component1 <> component2").where(smaller).where(enough)
    out = settle(on.select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")).distinct())
    forget(lists)
    return out


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id and kept (true for the smallest id of a component).

    Similar are documents with 100 * common >= percent * united shingles of `size` words.
    """
    bound_batches(docs.sparkSession)
    rows = settle(_features(docs, doc_id, text, size))
    some = rows.where("n > 0 AND id IS NOT NULL")
    # Classes of equal sets, named after their smallest id.
    classes = settle(some.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep")))
    heads = some.join(classes.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    # Narrow rows go through the two large shuffles.
    bucket = settle(heads.select("id", "n", F.explode("keys").alias("key")))
    shared = bucket.groupBy("key").agg(F.min(F.struct("id", "n")).alias("centre"), F.max("id").alias("z")).where("centre.id < z").select("key", "centre")
    members = settle(split_join(bucket, shared, ["key"]).select("key", "id", "n", F.col("centre.id").alias("a"), F.col("centre.n").alias("na")))
    forget(bucket)
    # No larger overlap is possible than the smaller set.
    near = f"a < id AND least(n, na) * 100 >= greatest(n, na) * {percent}"
    pairs = settle(members.where(near).select("a", F.col("id").alias("b")).distinct())
    wanted = settle(members.select("id").distinct())
    # The few ids go to the texts while they are few enough, else both are shuffled.
    few = wanted.count() * 8 <= broadcast_bytes
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    sets = settle(_sets(texts.join(F.broadcast(wanted) if few else wanted, "id", "left_semi"), size))
    first = settle(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    links = settle(_confirm(first, sets, percent))
    of = components(links)
    # Pairs whose ends are in one component need no look.
    named = lambda end: of.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    apart = split_join(split_join(pairs.join(first, ["a", "b"], "left_anti"), named("a"), ["a"], "left"), named("b"), ["b"], "left")
    apart = settle(apart.where("coalesce(of_a, a) <> coalesce(of_b, b)").select("a", "b"))
    if not apart.isEmpty():
        links = links.unionByName(settle(_confirm(apart, sets, percent)))
        of = components(links)
    tested = first.unionByName(apart)
    forget(pairs)
    placed = split_join(members.select("key", "id"), of.withColumnRenamed("node", "id"), ["id"], "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    rest = settle(split_join(placed, mixed, ["key"]).select("id", "component").distinct())
    forget(members)
    if not rest.isEmpty():
        more = settle(_left_over(sets.join(rest, "id"), percent).join(tested, ["a", "b"], "left_anti"))
        if not more.isEmpty():
            links = links.unionByName(settle(_confirm(more, sets, percent)))
            of = components(links)
        forget(more)
    forget(sets, rest, first, apart, wanted)
    named = classes.join(of.withColumnRenamed("node", "rep"), "rep", "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    out = split_join(rows.drop("keys"), named, ["n", "s1", "s2"], "left")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
