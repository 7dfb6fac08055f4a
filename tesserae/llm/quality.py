"""Quality rules with risk-controlled cutoffs.

Each rule measures a document and rejects it above a cutoff.  Cutoffs are not
guessed: labelled documents are a holdout, and a stratum's cutoffs are chosen as one
vector, for which an exact (Clopper-Pearson) upper bound on the share of good documents
that any of the rules rejects stays within ``max_false_rejection``.

Vectors are tested along a path from mild to strict, on which each rejects all that the
one before does, and testing stops at the first that fails (a fixed sequence, which needs
no correction); the error level is divided by the number of strata (Bonferroni).  With a
probability of ``1 - level`` the bounds of all strata hold together.  The path is fixed
before the test looks: a stratum with few labels moves all rules down their grids
together and tests on all of its labelled documents; one with many (FEW times what the
bound needs at least) lets one half of them choose the path, giving each rule the
strictest cutoff that rejects a certain share of good documents, and tests on the other.

A bound can hold only with enough labels: ``least_labels`` says how many.  Strata with
fewer are judged together as one pool, whose bound holds for the pool and not for each
of them; if the pool has too few as well, they reject nothing beyond the base rule.
``certified`` tells which it was: own, pool or none.

Cases: a null text counts as empty (no words, so it fails the base rule); a null
stratum is a stratum; repeated label rows of a document count once (the largest
label); labels of absent documents and null labels do not count; repeated document
rows are judged alike; a document at a cutoff is kept; no documents or no labels give no
cutoffs; columns of other names pass unread.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kit import Words, as_long, bound_batches, column, enter, flat, forget, hashes, mix, pieces, settle, split_join

U64 = np.uint64
WINDOW = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_stutters")
#: Rules: a name, numerator and denominator of the share that is rejected when it is too high.
RULES = (
    ("symbols", "n_symbols", "word_chars"),
    ("dup_lines", "n_dup_lines", "n_lines"),
    ("repeats", "n_repeat_words", "n_words"),
    ("long_words", "word_chars", "n_words"),
    ("stutters", "n_stutters", "n_words"),
)
#: Cutoffs from mild to strict, per rule.
STEPS = 24
#: A stratum with so many times the labels that a bound needs spends half of them on choosing the path.
FEW = 4
#: Shares of the limit that a rule may take on the half that chooses, one for each vector of a path.
SHARES = [0.02 * 1.2**i for i in range(22)]
GRID = {
    "symbols": [0.5 * 0.8**i for i in range(STEPS)],
    "dup_lines": [0.95 - 0.04 * i for i in range(STEPS)],
    "repeats": [0.95 - 0.04 * i for i in range(STEPS)],
    "long_words": [40 - 1.25 * i for i in range(STEPS)],
    "stutters": [0.95 - 0.04 * i for i in range(STEPS)],
}
#: What is known of a stratum: a path chosen by one half of its labels, and where on it a rule rejects; or its cutoffs.
_VECTORS = pa.list_(pa.list_(pa.int32()))
PLAN = pa.schema([("__key", pa.string()), ("path", _VECTORS), ("first", _VECTORS), ("__limits", pa.list_(pa.float64()))])


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text; the texts stand back to back in data."""
    n = len(offsets) - 1
    words = Words(data, offsets)
    sums = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))[offsets])
    out = {"n_words": words.count, "word_chars": sums(~words.space & ((data & 0xC0) != 0x80)), "n_symbols": sums(SYMBOLS[data])}
    # Lines: from a text's start or after a line feed, to the next line feed or the text's end.
    feeds = np.flatnonzero(data == 10)
    edges = np.sort(np.concatenate((offsets[:-1], feeds + 1)), kind="stable")
    text = np.searchsorted(offsets[1:], edges, "right")
    # A line that starts where the next text does belongs to the text that has the line feed; both are empty or the
    # later text's own line, so only lines that hold a word matter and those start strictly before their text's end.
    ends = np.minimum(np.concatenate((edges[1:], [len(data)])), offsets[np.minimum(text + 1, n)]) if n else edges
    ends = np.where((ends > edges) & (data[np.maximum(ends - 1, 0)] == 10), ends - 1, ends) if len(data) else ends
    has = np.searchsorted(words.start, ends) > np.searchsorted(words.start, edges)
    edges, ends, text = edges[has], ends[has], text[has]
    key = hashes(data, edges, ends)
    key += mix((text + 1).astype(U64))
    _, first = np.unique(mix(key), return_index=True)
    again = np.ones(len(edges), bool)
    again[first] = False
    out["n_lines"] = np.bincount(text, minlength=n)
    out["n_dup_lines"] = np.bincount(text[again], minlength=n)
    # Windows of eight words that a text holds twice or more cover words.
    word = hashes(data, words.start, words.end)
    # A word that stands right after itself stutters.
    again = np.flatnonzero((word[1:] == word[:-1]) & (words.text[1:] == words.text[:-1])) + 1
    out["n_stutters"] = np.bincount(words.text[again], minlength=n)
    repeated = np.zeros(n, np.int64)
    if (m := len(word) - WINDOW + 1) > 0:
        window = np.zeros(m, U64)
        for i in range(WINDOW):
            window *= U64(0x9E3779B97F4A7C15)
            window += word[i : i + m]
        inside = np.flatnonzero(words.text[:m] == words.text[WINDOW - 1 :])
        window = window[inside]
        window += mix((words.text[inside] + 1).astype(U64))
        window = mix(window)
        order = np.sort(window)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            at = np.minimum(np.searchsorted(twice, window), len(twice) - 1)
            hit = inside[twice[at] == window]
            cover = np.zeros(len(word) + 1, np.int32)
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + WINDOW, -1)
            repeated = np.bincount(words.text[np.cumsum(cover[:-1]) > 0], minlength=n)
    out["n_repeat_words"] = repeated
    return out


def _counts(batch: pa.RecordBatch, text: str) -> dict[str, np.ndarray]:
    data, offsets = flat(batch.column(text))
    parts = [measure(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in pieces(offsets)]
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (*BASE, *EXTRA)}


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """One row per document: its id, its stratum and the counts of BASE and EXTRA."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality")
        for batch in batches:
            counts = _counts(batch, "__text")
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__stratum"), *(as_long(counts[k]) for k in (*BASE, *EXTRA))], ["__id", "__stratum", *BASE, *EXTRA])

    kind = docs.schema[doc_id].dataType.simpleString()
    picked = docs.select(F.col(doc_id).alias("__id"), F.col(stratum).cast("string").alias("__stratum"), F.col(text).alias("__text"))
    schema = f"__id {kind}, __stratum string, " + ", ".join(f"{k} bigint" for k in (*BASE, *EXTRA))
    return picked.mapInArrow(run, schema).select(F.col("__id").alias(doc_id), F.col("__stratum").alias(stratum), *BASE, *EXTRA)


def tail(k: int, n: int, p: float) -> float:
    """Probability of at most k of n at rate p: a regularised incomplete beta function, by its continued fraction."""
    if k >= n or p <= 0:
        return 1.0
    if k < 0 or p >= 1:
        return 0.0
    a, b, x = n - k, k + 1, 1 - p
    if flip := x > (a + 1) / (a + b + 2):
        a, b, x = b, a, p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    d = 1 - (a + b) * x / (a + 1)
    c, d = 1.0, 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 1_000_000):
        change = 1.0
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            change = d * c
            out *= change
        if abs(change - 1) < 1e-14:
            break
    return 1 - front * out if flip else front * out


def upper_bound(k: int, n: int, level: float) -> float:
    """The largest rate for which k or fewer of n still have a probability of `level` (Clopper-Pearson)."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(k, n, mid) > level else (low, mid)
    return high


def least_labels(limit: float, level: float) -> int:
    """How many good documents show that less than `limit` are rejected, if none is."""
    return math.ceil(math.log(level) / math.log1p(-limit))


def share(rule: tuple[str, str, str]):
    """A rule's measure; without a denominator it is 0."""
    _, top, bottom = rule
    return F.when(F.col(bottom) > 0, F.col(top).cast("double") / F.col(bottom).cast("double")).otherwise(F.lit(0.0))


def base_failed():
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _key(stratum: str) -> Column:
    """A stratum as a key that is never null: the null stratum is one too."""
    return F.coalesce(F.concat(F.lit("="), column(stratum).cast("string")), F.lit(""))


def _meet(rows: DataFrame, table: DataFrame, how: str, broadcast_bytes: int) -> DataFrame:
    """Rows with those of a table that has one per __key; a small table is broadcast, with another the rows are
    exchanged, so that those of a hot stratum can be split."""
    wide = 16 + sum(8 * (len(RULES) * (STEPS + 4) if name == "first" else len(RULES)) for name in table.columns)
    few = (table.agg(F.sum(F.octet_length("__key") + wide)).first()[0] or 0) <= broadcast_bytes
    return rows.join(F.broadcast(table), "__key", how) if few else split_join(rows, table, ["__key"], how)


def _one_by_one(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _counted(tallies: list[dict] | None, *shape: int) -> np.ndarray:
    """Counts by their place: each tally has its n last."""
    out = np.zeros(shape, np.int64)
    for tally in tallies or ():
        *at, n = tally.values()
        out[tuple(at)] += n
    return out


def _path(rejected: np.ndarray, allowed: float) -> list[list[int]]:
    """The path that one half of the labels chooses: for each vector, how many steps of its grid each rule has gone
    (0: the rule is not used)."""
    return [[int(np.sum(of_rule <= s * allowed)) for of_rule in rejected] for s in SHARES]


def _limits(path: list[list[int]], rejects: np.ndarray, n: int, limit: float, level: float) -> list[float] | None:
    """The cutoffs of the last vector before the first that fails (infinite: the rule is not used), if the first holds.
    Vector j is the first to reject rejects[j] of the n good documents."""
    best = None
    for vector, rejected in zip(path, np.cumsum(rejects), strict=False):
        if tail(int(rejected), n, limit) > level:
            break
        best = vector
    return best and [GRID[name][v - 1] if v else math.inf for (name, *_), v in zip(RULES, best, strict=True)]


def cutoffs(counts: DataFrame, labels: DataFrame, doc_id: str = "doc_id", stratum: str = "lang", label: str = "quality", max_false_rejection: float = 0.02, level: float = 0.05, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """The strictest safe cutoffs: one row for each stratum that has some, with its __key, what its bound rests on
    (__certified: own or pool) and a cutoff for each of RULES (__limits; infinite for a rule without one).

    Strata may be any number: they stay rows of tables, and what reaches the driver is how many there are and the
    cutoffs of the pool.
    """
    spark = counts.sparkSession
    good = labels.where(column(doc_id).isNotNull()).groupBy(column(doc_id).alias("__id")).agg(F.max(column(label)).alias("__label")).where("__label = 1")
    held = counts.where(~base_failed()).join(good, counts[doc_id] == good["__id"], "left_semi")
    # How many steps a rule's cutoffs go until they reject the document (STEPS + 1: none does).
    steps = [F.lit(STEPS + 1) - reduce(lambda x, y: x + y, [(share(rule) > t).cast("int") for t in GRID[rule[0]]]) for rule in RULES]
    held = settle(held.select(_key(stratum).alias("__key"), F.pmod(F.xxhash64(column(doc_id), F.lit(7)), F.lit(2)).cast("int").alias("__half"), F.array(*steps).alias("__steps")))
    sizes = settle(held.groupBy("__key").agg(F.count(F.lit(1)).alias("__n")))
    each = level / max(1, sizes.count())
    need = least_labels(max_false_rejection, each)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For a large stratum the path that one half of its labels chooses; for others and the pool, the cutoffs."""
        enter("quality")
        for batch in batches:
            out = []
            for row in _one_by_one(batch):
                counted = _counted(row["tallies"], 2, len(RULES) + 1, STEPS + 2)
                n, path, limits = int(counted[:, 0].sum()), None, None
                if row["__key"] is not None and n >= FEW * need:
                    path = _path(np.cumsum(counted[0, :-1], axis=1)[:, 1:-1], max_false_rejection * int(counted[0, 0].sum()))
                else:  # vector j has gone j + 1 steps with every rule
                    limits = _limits([[i + 1] * len(RULES) for i in range(STEPS)], counted[:, -1].sum(axis=0)[1:], n, max_false_rejection, each)
                # The first vector that rejects a document: the first that has gone far enough for any rule.
                first = path and [[next((j for j, v in enumerate(path) if v[r] >= s), len(path)) for s in range(STEPS + 2)] for r in range(len(RULES))]
                out.append({"__key": row["__key"], "path": path, "first": first, "__limits": limits})
            yield pa.RecordBatch.from_pylist(out, PLAN)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cutoffs of a large stratum, from the other half of its labels."""
        enter("quality")
        for batch in batches:
            out = []
            for row in _one_by_one(batch):
                rejects = _counted(row["tallies"], len(row["path"]) + 1)
                out.append({"__key": row["__key"], "__limits": _limits(row["path"], rejects, int(rejects.sum()), max_false_rejection, each)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([PLAN.field("__key"), PLAN.field("__limits")]))

    # What each rule rejects after so many steps, and what the strictest does; strata with few labels have no key: the pool.
    named = _meet(held, sizes.where(F.col("__n") >= need).select("__key", F.lit(True).alias("own")), "left", broadcast_bytes)
    every = F.concat("__steps", F.array(F.array_min("__steps")))
    tallies = named.select(F.when(F.col("own"), F.col("__key")).alias("__key"), "__half", F.posexplode(every).alias("rule", "step"))
    tallies = tallies.groupBy("__key", "__half", "rule", "step").agg(F.count(F.lit(1)).alias("n")).groupBy("__key").agg(F.collect_list(F.struct("__half", "rule", "step", "n")).alias("tallies"))
    plans = settle(tallies.mapInArrow(plan, "__key string, path array<array<int>>, first array<array<int>>, __limits array<double>"))
    halved = plans.where("path IS NOT NULL")
    judged = _meet(held.where("__half = 1"), halved.select("__key", "first"), "inner", broadcast_bytes)
    at = F.array_min(F.transform(F.col("__steps"), lambda s, r: F.col("first")[r][s]))
    tallies = judged.groupBy("__key", at.alias("at")).agg(F.count(F.lit(1)).alias("n")).groupBy("__key").agg(F.collect_list(F.struct("at", "n")).alias("tallies"))
    tested = halved.select("__key", "path").join(tallies, "__key", "left").mapInArrow(test, "__key string, __limits array<double>")
    found = plans.where("path IS NULL AND __key IS NOT NULL").select("__key", "__limits").union(tested).select("__key", F.lit("own").alias("__certified"), "__limits")
    pool = plans.where("__key IS NULL AND __limits IS NOT NULL").first()
    if pool:
        found = found.union(sizes.where(F.col("__n") < need).select("__key", F.lit("pool"), F.array(*map(F.lit, pool["__limits"]))))
    found = settle(found.where("__limits IS NOT NULL"))
    forget(held, sizes, plans)
    return found


def _with_limits(rows: DataFrame, found: DataFrame, stratum: str, broadcast_bytes: int) -> DataFrame:
    """Rows with __certified and __limits of their stratum; those without cutoffs have infinite ones, which reject nothing."""
    told = _meet(rows.withColumn("__key", _key(stratum)), found, "left", broadcast_bytes)
    endless = F.array(*[F.lit(math.inf)] * len(RULES))
    return told.select(*map(column, rows.columns), F.coalesce("__certified", F.lit("none")).alias("__certified"), F.coalesce("__limits", endless).alias("__limits"))


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", broadcast_bytes: int = 8 << 20, **limits) -> DataFrame:
    """One row per document: id, stratum, counts, base_failed, certified and kept."""
    counts = settle(features(docs, doc_id, text, stratum))
    found = cutoffs(counts, labels, doc_id, stratum, broadcast_bytes=broadcast_bytes, **limits)
    high = reduce(lambda x, y: x | y, [share(rule) > F.col("__limits")[r] for r, rule in enumerate(RULES)])
    told = _with_limits(counts, found, stratum, broadcast_bytes)
    return told.select(*map(column, counts.columns), base_failed().alias("base_failed"), F.col("__certified").alias("certified"), (~base_failed() & ~high).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", broadcast_bytes: int = 8 << 20, **limits) -> DataFrame:
    """The documents that are kept, with all their columns: counts are taken twice, and texts are shuffled only if
    the strata with cutoffs are too many for a broadcast."""
    found = cutoffs(features(docs, doc_id, text, stratum), labels, doc_id, stratum, broadcast_bytes=broadcast_bytes, **limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality")
        for batch in batches:
            counts = _counts(batch, text)
            most = batch.column("__limits").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(RULES))
            failed = (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])
            for r, (_, top, bottom) in enumerate(RULES):
                rate = counts[top] / np.maximum(counts[bottom], 1) * (counts[bottom] > 0)
                failed |= rate > most[:, r]
            yield batch.select(docs_columns).filter(pa.array(~failed))

    docs_columns = docs.columns
    return _with_limits(docs, found, stratum, broadcast_bytes).drop("__certified").mapInArrow(run, docs.schema)
