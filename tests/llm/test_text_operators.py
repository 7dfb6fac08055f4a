"""Operators on texts against plain versions of the same."""

import bisect
import hashlib
import json
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesserae.llm import bpe, katz, kit, neardup, packed, packing, pii, quality, suffixes, tokens
from tesserae.llm.components import components

from .conftest import LOWER, make, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


# ---- 1 suffix arrays ----


def removed_plainly(rows, width):
    """Per row: removed flags. rows: (id, bytes); null ids come last and are all alike."""
    key = lambda i: (1 << 63) - 1 if i is None else i
    first = {}
    for i, b in rows:
        for p in range(len(b) - width + 1):
            s = b[p : p + width]
            first[s] = min(first.get(s, 1 << 63), key(i))
    out = []
    for i, b in rows:
        flags = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < key(i):
                flags[p : p + width] = b"\x01" * width
        out.append(flags)
    return out


@pytest.mark.parametrize("width", [50, 12])
def test_suffix_dedup(spark, texts, width):
    ids = [None if k in (8, 9) else 17 if k in (11, 12) else k * 3 % 101 for k in range(len(texts))]
    rows = [(i, (t or "").encode()) for i, t in zip(ids, texts, strict=True)]
    want = Counter()
    for (i, b), gone in zip(rows, removed_plainly(rows, width), strict=True):
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        want[i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()] += 1
    got = suffixes.spans(make(spark, texts, ids), width=width, block_bytes=20_000, relay_from=4096 if width == 50 else 1)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == want


def test_suffix_dedup_keeps_columns_and_characters(spark, docs, none):
    out = suffixes.strip(docs, width=12)
    assert out.columns == docs.columns
    assert out.count() == docs.count()
    assert out.where("text is null").count() == 1
    out.select(F.sum(F.length("text"))).first()
    assert suffixes.spans(none).count() == suffixes.strip(none).count() == 0


@given(st.lists(st.text("ab", min_size=4, max_size=40), min_size=1, max_size=12), st.integers(3, 9))
@settings(deadline=None, max_examples=80)
def test_suffix_array_orders_windows(strings, width):
    strings = [s for s in strings if len(s) >= width] or ["a" * width]
    data = np.frombuffer("".join(strings).encode(), np.uint8)
    text = np.concatenate((data, np.zeros(width + 16, np.uint8)))
    wanted = np.zeros(len(text), bool)
    at = 0
    for s in strings:
        wanted[at : at + len(s) - width + 1] = True
        at += len(s)
    order = suffixes.suffix_order(text, wanted, width)
    cut = [bytes(text[p : p + width]) for p in order]
    assert cut == sorted(cut)
    assert sorted(order) == np.flatnonzero(wanted).tolist()
    common = lambda a, b: next((k for k in range(width) if a[k] != b[k]), width)
    assert suffixes.common_prefixes(text, order, width).tolist() == [0, *(common(a, b) for a, b in zip(cut, cut[1:], strict=False))]


# ---- 2, 3, 4 tokens ----


def test_bpe_round_trip(docs, texts, none, tokenizer):
    got = {r.doc_id: r for r in tokens.round_trip(docs, PATH).collect()}
    for i, t in enumerate(texts):
        ids = ids_of(tokenizer, t)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = {r.doc_id: r.text for r in tokens.decode(tokens.encode(docs, PATH), PATH).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert tokens.round_trip(none, PATH).count() == 0


@given(st.lists(st.text(max_size=60), max_size=8))
@settings(deadline=None, max_examples=150)
def test_bpe_on_any_text(batch):
    reference = Tokenizer.from_file(PATH) if not hasattr(test_bpe_on_any_text, "t") else test_bpe_on_any_text.t
    test_bpe_on_any_text.t = reference
    batch = [t for t in batch if not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.load(PATH).encode_batch(batch)] == [ids_of(reference, t) for t in batch]


def test_bpe_forgets_without_harm(tokenizer):
    small = bpe.TrieBPE(PATH, max_words=20)
    rng = random.Random(1)
    for _ in range(30):
        text = prose(rng, 40)
        assert np.frombuffer(small.encode_batch([text])[0], "<u4").tolist() == ids_of(tokenizer, text)


def test_section_counts(docs, texts, none, tokenizer):
    rows = defaultdict(list)
    for r in tokens.section_counts(docs, PATH).collect():
        rows[r.doc_id].append(r)
    encoder = bpe.load(PATH)
    for i, t in enumerate(texts):
        t = t or ""
        mine = sorted(rows[i], key=lambda r: r.section)
        starts = [r.start for r in mine]
        assert "".join(t[r.start : r.end] for r in mine) == t
        assert all("\n" not in t[r.start : r.end - 1] for r in mine)
        n, crossing, at, raw = [0] * len(mine), [0] * len(mine), 0, t.encode()
        for k in ids_of(tokenizer, t):
            size = len(encoder.token_bytes[k])
            lead = at
            while lead and raw[lead] & 0xC0 == 0x80:
                lead -= 1
            s = bisect.bisect_right(starts, len(raw[:lead].decode())) - 1
            n[s] += 1
            crossing[s] += at + size > len(t[: mine[s].end].encode())
            at += size
        assert [r.n_tokens for r in mine] == n
        assert [r.n_crossing for r in mine] == crossing
    assert tokens.section_counts(none, PATH).count() == 0


def test_packing(docs, texts, none, tokenizer):
    rows = packing.pack(docs, PATH, window=64).collect()
    by_doc, by_sequence, waste = defaultdict(list), defaultdict(list), 0
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids, at = np.array([*ids_of(tokenizer, t), 0], "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
        waste += 0 if at & (at - 1) == 0 else 64 - at
    assert waste == 0
    assert packing.pack(none, PATH).count() == 0


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 3), max_size=6), st.integers(1, 60))
@settings(deadline=None)
def test_best_subset_leaves_least_slack(counts, capacity):
    sums = {0}
    for length, n in counts.items():
        sums |= {s + length * k for s in sums for k in range(n + 1)}
    taken = packing.best_subset(counts, capacity)
    assert all(0 < n <= counts[length] for length, n in taken.items())
    assert sum(length * n for length, n in taken.items()) == max(s for s in sums if s <= capacity)


# ---- 5 near-duplicates ----


def shingles_plainly(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def linked_plainly(sets, percent):
    name = {k: k for k in sets}

    def find(k):
        while name[k] != k:
            k = name[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                name[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(spark, texts, none, size):
    rng = random.Random(size)
    long = prose(rng, 120).split()
    family = [" ".join(long[: 120 - 2 * k] + [f"w{k}"] * k) for k in range(12)]  # a chain of near copies
    shared = prose(rng, 50)
    strangers = [f"{shared} {prose(rng, 70)}" for _ in range(25)]  # one passage, no links
    every = [*texts, *family, *strangers, *["The Same. text as Before " * 3] * 30, "the same. TEXT as before " * 3]
    ids = [k * 7 % 211 for k in range(len(every))]
    sets = {i: shingles_plainly(t, size) for i, t in zip(ids, every, strict=True)}
    want = linked_plainly(sets, 80)
    got = {r.doc_id: r for r in neardup.link(make(spark, every, ids), size=size).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in ids}
    if size == 4:
        assert neardup.link(none).count() == 0


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_inside_a_template_family(spark, size):
    """A linked pair shares its template only, and in each of its buckets are strangers of smaller ids on the same template."""
    rng = random.Random(size)
    templates = [prose(rng, 130) for _ in range(4)]
    strangers = [f"{t} {prose(rng, 40)}" for t in templates for _ in range(60)]
    every = [*strangers, *[f"{t} {prose(rng, 14)}" for t in templates for _ in range(2)]]
    sets = {i: shingles_plainly(t, size) for i, t in enumerate(every)}
    want = linked_plainly(sets, 80)
    assert sum(want[i] != i for i in sets) == 4
    got = {r.doc_id: r for r in neardup.link(make(spark, every), size=size).collect()}
    assert {i: (r.component_id, r.kept) for i, r in got.items()} == {i: (want[i], want[i] == i) for i in sets}


@pytest.mark.parametrize("strangers", [100, 1000])
def test_no_link_is_lost_among_strangers(spark, strangers):
    """Pairs just above the limit, with larger ids than many documents of the same template just below it."""
    for seed in (1, 2):
        rng = random.Random(seed)
        word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))  # noqa: B023, E731
        template = [word() for _ in range(200)]
        every = [template + [word() for _ in range(27)] for _ in range(strangers)]
        for _ in range(40):
            tail = [word() for _ in range(27)]
            every += [template + tail, template + tail[:5] + [word() for _ in range(22)]]
        sets = {i: {tuple(w[k : k + 4]) for k in range(len(w) - 3)} for i, w in enumerate(every)}
        alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])  # noqa: B023, E731
        assert alike(0, 1) < 0.8 < alike(strangers, strangers + 1)
        rows = neardup.link(make(spark, [" ".join(w) for w in every]), size=4).collect()
        assert {r.doc_id: r.component_id for r in rows} == {i: i if i < strangers else i - (i - strangers) % 2 for i in sets}


@pytest.mark.parametrize("common", [4, 8, 40])
def test_bands_miss_next_to_nothing(common):
    """Small sets borrow most of their bins: pairs of similarity 0.8 still share a band."""
    rng = np.random.default_rng(common)
    n, own = 4000, common // 8
    sizes = (common + own, common + (common // 4 - own))
    hit = 0
    for a in range(0, n, 500):
        found, owner = [], []
        for i in range(500):
            both = rng.integers(0, 1 << 64, common, dtype=np.uint64)
            for k, size in enumerate(sizes):
                found += [both, rng.integers(0, 1 << 64, size - common, dtype=np.uint64)]
                owner.append(np.full(size, 2 * i + k))
        keys = neardup.bands(neardup.signatures(np.concatenate(found), np.concatenate(owner), 1000))
        hit += int((keys[::2] == keys[1::2]).any(axis=1).sum())
    assert hit == n


def test_near_duplicates_without_ids_and_with_one_twice(spark):
    rng = random.Random(3)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = neardup.link(make(spark, [a, a, b, b, a], [None, 4, 4, 9, 2])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in rows if r.doc_id is not None) == [(2, 2, True), (4, 2, False), (4, 2, False), (9, 2, False)]
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]


def test_densified_bins_agree_where_sets_do():
    rng = np.random.default_rng(0)
    found = rng.integers(0, 1 << 63, 3, dtype=np.uint64) * np.uint64(2)
    value = neardup.signatures(np.concatenate((found, found)), np.repeat([0, 1], 3), 3)
    assert (value[0] == value[1]).all() and (value[0] > 0).all() and (value[2] == 0).all()


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=25))
@settings(deadline=None, max_examples=6)
def test_components(spark, edges):
    name = list(range(13))
    for _ in edges:
        for a, b in edges:
            name[a] = name[b] = min(name[a], name[b])
    want = {k: name[k] for e in edges for k in e if e[0] != e[1]}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == want


# ---- 7 quality ----


def measured_plainly(t):
    t = t or ""
    w, seen, again = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(covered)


def test_quality_counts(spark, docs, texts, none):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)] + [(2, None, 0), (None, 1, 0), (999, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = quality.judge(docs, labels).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = measured_plainly(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.kept and r.base_failed)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.kept}
    assert quality.judge(none, labels).count() == 0
    assert {r.kept for r in quality.judge(docs, labels.limit(0)).collect() if not r.base_failed} == {True}


@given(st.text("ab \n#é", max_size=80), st.text("ab \n", max_size=80))
@settings(deadline=None)
def test_quality_counts_of_neighbours(one, two):
    raw = [t.encode() for t in (one, "", two, one)]
    found = quality.measure(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for i, t in enumerate((one, "", two, one)):
        assert tuple(int(found[k][i]) for k in quality.BASE) == measured_plainly(t)


def test_upper_bound_is_exact():
    for k, n in ((0, 30), (2, 100), (7, 60)):
        p = quality.upper_bound(k, n, 0.05)
        assert math.isclose(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), 0.05, rel_tol=1e-6)
    assert quality.upper_bound(5, 5, 0.1) == 1


def test_tail_is_exact():
    for k, n in ((0, 30), (2, 100), (300, 17_000), (25, 1500)):
        for p in (0.01, 0.02, 0.1):
            plain = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
            assert math.isclose(quality.tail(k, n, p), plain, rel_tol=1e-8, abs_tol=1e-14)


@pytest.mark.parametrize(("n", "certified"), [(900, "own"), (220, "own"), (100, "none")])
def test_cutoffs_limit_false_rejection(spark, n, certified):
    """The base rule passes every document: only a cutoff can tell bad ones, full of symbols, from good ones with few."""
    rng = random.Random(n)
    symbols = lambda t, share: " ".join(w + "#" * (rng.random() < share) for w in t.split())
    good = [symbols(prose(rng, 60), rng.choice([0, 0, 0, 0.02])) for _ in range(n)]
    bad = [symbols(prose(rng, 60), 0.9) for _ in range(50)]
    docs = make(spark, good + bad).withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(i, int(i < n)) for i in range(n + 50)], "doc_id bigint, quality int")
    rows = {r.doc_id: r for r in quality.judge(docs, labels, max_false_rejection=0.02).collect()}
    assert not any(r.base_failed for r in rows.values())
    assert {r.certified for r in rows.values()} == {certified}
    assert sum(not rows[i].kept for i in range(n)) <= 0.02 * n
    assert {rows[i].kept for i in range(n, n + 50)} == {certified == "none"}


def test_small_strata_share_a_pool(spark):
    rng = random.Random(8)
    good = [prose(rng, 40) for _ in range(300)]
    bad = [" ".join(f"{w}#" for w in prose(rng, 40).split()) for _ in range(30)]
    lang = F.when(F.col("doc_id") % 3 == 2, F.lit(None)).otherwise(F.concat(F.lit("l"), (F.col("doc_id") % 3).cast("string")))
    docs = make(spark, good + bad).withColumn("lang", lang)
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(330)], "doc_id bigint, quality int")
    rows = quality.judge(docs, labels).collect()
    assert {r.certified for r in rows} == {"pool"} and {r.kept for r in rows if r.doc_id >= 300} == {False}
    assert sum(r.kept for r in rows) >= 294
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == {r.doc_id for r in rows if r.kept}

def test_strata_may_be_any_number(spark):
    """A stratum that halves its labels, one that does not, and 1,100 with one good document each, none of which is left out."""
    rng = random.Random(9)
    good = ["l0"] * 420 + ["l1"] * 130 + [f"s{i}" for i in range(1100)]
    bad = [*["l0", "l1"] * 10, *(f"s{i}" for i in range(1100))]
    texts = [prose(rng, 25) for _ in good] + [" ".join(f"{w}#" for w in prose(rng, 25).split()) for _ in bad]
    lang = dict(enumerate([*good, *bad]))
    docs = spark.createDataFrame([(i, t, lang[i]) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, int(i < len(good))) for i in lang], "doc_id bigint, quality int")
    rows = quality.judge(docs, labels, max_false_rejection=0.1).collect()
    assert Counter((r.lang[0], r.certified) for r in rows) == {("l", "own"): 570, ("s", "pool"): 2200}
    assert {r.kept for r in rows if r.doc_id >= len(good)} == {False}
    assert sum(r.kept for r in rows) >= 0.9 * len(good)
    assert {r.doc_id for r in quality.keep_good(docs, labels, max_false_rejection=0.1).collect()} == {r.doc_id for r in rows if r.kept}
    exchanged = {"max_false_rejection": 0.1, "broadcast_bytes": 0}
    assert sorted(quality.judge(docs, labels, **exchanged).collect()) == sorted(rows)
    assert {r.doc_id for r in quality.keep_good(docs, labels, **exchanged).collect()} == {r.doc_id for r in rows if r.kept}


# ---- 9 language model ----


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model(spark, texts, none, order):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    words = {i: [*WORD.findall((t or "").translate(LOWER)), None] for i, t in enumerate(texts)}
    count = [Counter() for _ in range(order + 1)]  # of n-grams, by their length; an end stands before each text
    for i, w in words.items():
        if not held[i]:
            line = [None, *w]
            count[1].update((x,) for x in w)
            for m in range(2, order + 1):
                count[m].update(tuple(line[k : k + m]) for k in range(len(line) - m + 1))
    n, v, k = sum(count[1].values()), len(count[1]), katz.DISCOUNTED
    of_counts = lambda c: np.array([Counter(min(x, k + 2) for x in c.values())[r] for r in range(k + 3)])
    d = [None, *(katz.discounts(of_counts(c)) for c in count[1:])]
    lost = sum(c * (1 - d[1][c]) for c in count[1].values() if c <= k)
    unknown = max(lost / n, 1 / (n + v + 1))
    after = defaultdict(list)
    for c in count[2:]:
        for gram in c:
            after[gram[:-1]].append(gram[-1])

    def seen(gram):
        m = len(gram)
        return d[m][min(count[m][gram], k + 1)] * count[m][gram] / (count[m - 1][gram[:-1]] + 0.5)

    alphas = {}

    def p(gram):
        if len(gram) == 1:
            return (1 - unknown) / (1 - lost / n) * d[1][min(count[1][gram], k + 1)] * count[1][gram] / n if count[1][gram] else unknown
        h = gram[:-1]
        if not count[len(h)][h]:
            return p(gram[1:])
        if count[len(gram)][gram]:
            return seen(gram)
        if h not in alphas:
            alphas[h] = (1 - sum(seen((*h, w)) for w in after[h])) / (1 - sum(p((*h[1:], w)) for w in after[h]))
        return alphas[h] * p(gram[1:])

    some = [h for h in [(None,), ("one",), ("no such word",), *list(after)[:10], *[h for h in after if len(h) == order - 1][:10]] if None not in h[1:]]
    for h in some:
        assert math.isclose(sum(p((*h, *w)) for w in count[1]) + p((*h, "\0")), 1, rel_tol=1e-9)
    got = katz.score(make(spark, texts), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, order=order, block_bytes=20_000, relay_from=1 if order == 4 else 4096).collect()
    assert len(got) == len(texts)
    for r in got:
        w = words[r.doc_id]
        line = [None, *w]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(count[1][x,] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((count[1][x,] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p(tuple(line[max(0, i + 1 - order) : i + 1]))) for i in range(1, len(line))), rel_tol=1e-8, abs_tol=1e-8)
    if order == 3:
        assert katz.score(none, F.lit(False)).count() == 0
        untrained = katz.score(make(spark, ["a b", None]), F.lit(True)).collect()
        assert {(r.n_known, r.score) for r in untrained} == {(0, 0.0)}
        twice = katz.score(make(spark, ["a b c"] * 3, [None, 4, 4]), F.lit(False)).collect()
        assert {(r.n_tokens, r.train_tokens) for r in twice} == {(4, 12)} and len({r.score for r in twice}) == 1


# ---- 10 personal data ----


def plainly(t):
    """The plain spans by the rules as they are written."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) < 256 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c in "0123456789"][::-1]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out)


PRIVATE = [
    ("mail joe.b@ex.com, or 10.0.0.1 and 300.1.1.1", "email:joe.b@ex.com ip:10.0.0.1"),
    ("jane [at] corp [dot] co [dot] uk!", "email:jane [at] corp [dot] co [dot] uk"),
    ("write to joe at example dot com now", "email:joe at example dot com"),
    ("look at the dot on it. We met at noon. dot", ""),
    ("card 4111 1111 1111 1111, not 4111 1111 1111 1112", "card:4111 1111 1111 1111"),
    ("four one one one one one one one one one one one one one one one", "card:four one one one one one one one one one one one one one one one"),
    ("call +1 (212) 555-8457", "phone:+1 (212) 555-8457"),
    ("plus one two one two five five five one two three four", "phone:plus one two one two five five five one two three four"),
    ("cinq cinq cinq un deux trois quatre cinq six sept huit", "phone:cinq cinq cinq un deux trois quatre cinq six sept huit"),
    ("un un un un un un un un un un un un", ""),
    ("јоhn@ехаmple.com", "email:јоhn@ехаmple.com"),
    ("bob＠ex．com or ４１１１ １１１１ １１１１ １１１１", "email:bob＠ex．com card:４１１１ １１１１ １１１１ １１１１"),
    ("1\u200b0.0.0.7", "ip:1\u200b0.0.0.7"),
    ("é" * 5 + " a@b.cd", "email:a@b.cd"),
    ("write joe @ example.com or KNREMB dot 18 AT mail7 DOT example DOT com", "email:joe @ example.com email:KNREMB dot 18 AT mail7 DOT example DOT com"),
    ("host 192[.]168[.]0[.]1, 10 dot 0 dot 0 dot 7 and 300[.]1[.]1[.]1", "ip:192[.]168[.]0[.]1 ip:10 dot 0 dot 0 dot 7"),
    ("one nine two dot one six eight dot zero dot one", "ip:one nine two dot one six eight dot zero dot one"),
    ("pay 4Ol2 8888 8888 I88l now", "card:4Ol2 8888 8888 I88l"),
    ("+1 (two one two) five five five - oh one nine nine", "phone:+1 (two one two) five five five - oh one nine nine"),
    ("Il lll oo Oo III ll OO", ""),
]


@pytest.mark.parametrize(("text", "want"), PRIVATE)
def test_disguises_map_back(text, want):
    base, spans = pii.find(text)
    assert set(base) <= set(spans)
    if text.startswith("1\u200b"):
        assert pii.told(base) == "ip:2:9" or ("ip", text) in [(pii.KINDS[k], text[a:b]) for a, k, b in spans]
    else:
        assert " ".join(f"{pii.KINDS[k]}:{text[a:b]}" for a, k, b in spans) == want


MIXED = [
    ("call five 5 five 0 one 2 three 4 six 7 now", "phone:five 5 five 0 one 2 three 4 six 7"),
    ("plus 1 five five 5 two three 4 six seven 8 9", "phone:plus 1 five five 5 two three 4 six seven 8 9"),
    ("+49 1 5 eins zwei 3 4 drei vier 5 6", "phone:+49 1 5 eins zwei 3 4 drei vier 5 6"),
    ("four 1 one 1 one 1 one 1 one 1 one 1 one 1 one 1", "card:four 1 one 1 one 1 one 1 one 1 one 1 one 1 one 1"),
    ("host 1 dot two dot 3 dot four", "ip:1 dot two dot 3 dot four"),
    ("one 1, then 10, 20, 30, 40, 50, 60 and so on", ""),
]


@pytest.mark.parametrize(("text", "want"), MIXED)
def test_words_mixed_with_digits(text, want):
    assert " ".join(f"{pii.KINDS[k]}:{text[a:b]}" for a, k, b in pii.find(text)[1]) == want


@given(st.text("0123456789 .@+-ab()", max_size=60))
@settings(deadline=None, max_examples=300)
def test_plain_spans(text):
    assert pii.plain(text) == plainly(text)
    base, spans = pii.find(text)
    assert base == plainly(text) and set(base) <= set(spans)


def test_personal_data(spark, docs, texts, none):
    extra = [t for t, _ in PRIVATE] + [None, ""]
    every = make(spark, [*texts, *extra])
    got = {r.doc_id: r for r in pii.digest(pii.detect(every)).collect()}
    for i, t in enumerate([*texts, *extra]):
        want = plainly(t or "")
        told = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert got[i].base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(k == j for _, k, _ in want) for j in range(4)]
        assert set(filter(None, told.split(","))) <= set(got[i].spans.split(","))
    masked = pii.mask(every)
    assert masked.columns == every.columns
    assert masked.where("text like '%joe%'").count() == 0
    assert pii.detect(none).count() == pii.mask(none).count() == 0


# ---- strings of a regular pattern, and very long ones ----


def thue_morse(n):
    """n bytes of the sequence whose prefix sums cancel modulo powers of two, and its complement."""
    bits = np.zeros(n, np.uint8)
    for i in range(1, n):
        bits[i] = bits[i // 2] ^ (i & 1)
    return (bits + 97).tobytes().decode(), (98 - bits).tobytes().decode()


def test_strings_of_a_pattern_stay_apart(spark):
    one, two = thue_morse(1024)
    data = np.frombuffer(f"{one}\n{two}\n{one} {two} {one}".encode(), np.uint8)
    found = quality.measure(data, np.array([0, len(data)]))
    assert (found["n_dup_lines"][0], found["n_stutters"][0]) == (0, 0)
    rng = random.Random(5)
    tail = prose(rng, 4)
    rows = neardup.link(make(spark, [f"{one} {tail}", f"{two} {tail}", f"{one} {tail}"]), size=4).collect()
    assert {r.doc_id: r.component_id for r in rows} == {0: 0, 1: 1, 2: 0}
    raw = [(i, t.encode()) for i, t in enumerate([one, two, f"x{one}", two[:200]])]
    want = {i: sum(gone) for (i, _), gone in zip(raw, removed_plainly(raw, 50), strict=True)}
    assert {r.doc_id: r.n_removed for r in suffixes.spans(make(spark, [t.decode() for _, t in raw])).collect()} == want
    scores = {r.doc_id: r.n_known for r in katz.score(make(spark, [one, two]), F.col("doc_id") == 1).collect()}
    assert scores == {0: 2, 1: 1}


@given(st.lists(st.binary(max_size=40), max_size=20), st.integers(0, 3))
@settings(deadline=None)
def test_hashes_follow_content(strings, seed):
    strings = [*strings, b"a" * 300, b"a" * 300, b"a" * 299, b"", b"a\0", b"a"]
    ends = np.cumsum([len(s) for s in strings])
    data = np.frombuffer(b"".join(strings), np.uint8)
    found = kit.hashes(data, ends - [len(s) for s in strings], ends, seed).tolist()
    assert len(set(found)) == len(set(strings))
    assert len({*zip(strings, found, strict=True)}) == len(set(strings))


@pytest.mark.parametrize("text", ["a" * 10**6, "1" * 10**6, "1 " * 10**6, "1." * 10**6, "a@" * 10**6, "a dot " * 10**5, "one two " * 10**5, "one" + " " * 10**6 + "x one two", "1O1 " * 10**5, "x at " * 10**5, "+1" * 10**6, "a [at] b " * 10**5])
def test_personal_data_in_long_runs(text):
    start = time.monotonic()
    pii.find(text)
    assert time.monotonic() - start < 30


def test_personal_data_odd_numbers_and_letters():
    assert pii.find("1" * 5000 + ".1.1.1") == ([], [])
    assert pii.told(pii.find("0" * 5000 + "1.1.1.255")[0]) == "ip:0:5009"
    assert pii.told(pii.find("call one two three four five \u017fix seven eight nine")[1]) == "phone:5:49"
    assert pii.told(pii.find("user@ma\u0131l.com")[1]) == "email:0:13"
    assert pii.told(pii.find("joe at example\ndot com")[1]) == "email:0:22"


def test_many_addresses_beside_a_disguised_one():
    text = "joe@example.com " * 100_000 + "bob at example dot com"
    start = time.monotonic()
    base, spans = pii.find(text)
    assert (len(base), len(spans)) == (100_000, 100_001) and time.monotonic() - start < 30


def test_views_map_to_the_source():
    view = pii.View("a\u200bb@x\uff0ecom one [dot] two").characters()
    assert view.text == "ab@x.com one [dot] two"
    again = view.rewrite(re.compile(r"\[dot\]"), re.compile(r"(\[dot\])"), lambda m: ".")
    assert again.text == "ab@x.com one . two"
    assert [again.range(i, i + 1) for i in (0, 1, 4, 13, 15)] == [(0, 1), (2, 3), (5, 6), (14, 19), (20, 21)]


def test_one_very_long_word(spark, tokenizer):
    rng = random.Random(4)
    long = ["".join(rng.choice("abcdefghij") for _ in range(300_000)), "1" * 300_000, "\n" * 300_000, " " * 300_000, "x" * 300_000 + "\n" + "x" * 300_000]
    docs = make(spark, long)
    for r in tokens.round_trip(docs, PATH).collect():
        want = ids_of(tokenizer, long[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    assert sum(r.n_tokens for r in tokens.section_counts(docs, PATH).where("doc_id = 0").collect()) == len(ids_of(tokenizer, long[0]))
    assert {r.doc_id: r.n_words for r in quality.judge(docs, spark.createDataFrame([], "doc_id bigint, quality int")).collect()} == {0: 1, 1: 1, 2: 0, 3: 0, 4: 2}
    assert {r.doc_id: r.n_shingles for r in neardup.link(docs).collect()} == {0: 1, 1: 1, 2: 0, 3: 0, 4: 1}
    assert {r.doc_id: r.n_tokens for r in katz.score(docs, F.lit(False)).collect()} == {0: 2, 1: 2, 2: 1, 3: 1, 4: 3}
    by_doc = defaultdict(int)
    for r in packing.pack(docs, PATH).collect():
        by_doc[r.doc_id] += r.length
    assert by_doc[0] == len(ids_of(tokenizer, long[0])) + 1


def test_other_tokenizer_files_are_refused(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [{"id": 1, "content": "x", "lstrip": True}]}):
        (tmp_path / "t.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match="tokenizer file"):
            bpe.TrieBPE(str(tmp_path / "t.json"))


def test_bundles_open_as_they_were():
    rows = [(3, -1, b""), (4, 7, b"abc"), (3, 8, b"x" * 1000)]
    assert packed.unbundle(packed.bundle(rows)) == rows and packed.unbundle(packed.bundle([])) == []
