"""Operators on vectors and URLs, the pipeline, and the queries on the sample tables."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tesserae.llm import urls, vectors
from tesserae.llm.components import components

from .conftest import LOWER, make, prose
from .test_text_operators import WORD, linked_plainly, measured_plainly, removed_plainly, shingles_plainly
from .test_text_operators import plainly as plain_spans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ODD = [None, [], [0.0] * 8, [None] * 8, [float("nan")] * 8, [float("inf")] + [1.0] * 7]


def vectors_linked_plainly(rows, threshold):
    """n_links and component of each (id, vector)."""
    unit = []
    for i, v in rows:
        ok = i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(v) if ok else None)
    n, name = len(rows), list(range(len(rows)))
    links = [0] * n

    def find(k):
        while name[k] != k:
            k = name[k]
        return k

    for a in range(n):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                name[max(x, y)] = min(x, y)
    groups = {}
    for k in range(n):
        groups.setdefault(find(k), []).append(rows[k][0])
    return [(links[k], rows[k][0] if unit[k] is None else min(groups[find(k)])) for k in range(n)]


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 8)).round(3)
    near = [base[0] + rng.normal(0, 0.02, 8) for _ in range(40)]  # more than a list holds
    rows = [*base, *near, base[1], base[1] * 2, -base[2]]
    rows = [(int(i) * 3 + 1, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    rows += [(1000 + i, v) for i, v in enumerate(ODD)] + [(None, rows[0][1]), (2000, [1.0, 2.0]), (2001, [2.0, 4.0]), (1, rows[0][1])]
    df = spark.createDataFrame([(i, v, 0, 0, 0) for i, v in rows], "vec_id bigint, embedding array<float>, label int, id int, m int").repartition(3)
    said = []
    got = vectors.link(df, k=4, said=said.append).collect()
    want = sorted(((i, n, c) for (i, _), (n, c) in zip(rows, vectors_linked_plainly(rows, 0.9), strict=True)), key=str)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == want
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)
    assert said and "audit" in said[0]
    assert vectors.link(df.limit(0)).count() == 0


def test_vectors_link_dense_groups(spark):
    """Lists full of a group's own members hide the links to another group."""
    rng = np.random.default_rng(5)
    d = 64
    axes = np.linalg.qr(rng.standard_normal((d, d)))[0]
    centres = [axes[0], 0.93 * axes[0] + (1 - 0.93**2) ** 0.5 * axes[1], axes[2]]
    rows = [c + rng.normal(0, 0.015, d) for c in centres for _ in range(60)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    want = [(i, n, c) for (i, _), (n, c) in zip(rows, vectors_linked_plainly(rows, 0.9), strict=True)]
    assert {c for _, _, c in want} == {0, 120}
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    nodes = vectors._nodes(df, "vec_id", "embedding").cache()
    lists = [(i, i // 60 * 60 + (i + step) % 60, i // 60 * 60 + (i + step) % 60, 0.97) for i in range(180) for step in range(1, 5)]
    near = vectors._best(spark.createDataFrame(lists, vectors.EDGES).withColumn("old", F.lit(False)), 4, False)  # none has room for another group
    edges = near.select("a", "b")
    edges, of = vectors._across(near, nodes, edges, components(edges), 0.9, 4, 1, 3)
    assert {(r.node, r.component) for r in of.collect()} == {(i, 0 if i < 120 else 120) for i in range(180)}
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.link(df, k=4, tables=1).collect())
    assert got == want


def test_audit_sees_small_groups(spark):
    """All links of one hot group found and none of the small ones."""
    rng = np.random.default_rng(6)
    hot = [rng.standard_normal(32)] * 40
    small = [c for c in rng.standard_normal((10, 32)) for _ in range(2)]
    rows = [(i, [float(x) for x in v + rng.normal(0, 0.02, 32)]) for i, v in enumerate([*hot, *small])]
    nodes = vectors._nodes(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), "vec_id", "embedding")
    of = spark.createDataFrame([(i, 0) for i in range(40)], "node bigint, component bigint")
    links = spark.createDataFrame([(i, 39, 39) for i in range(40)], "id bigint, others bigint, pairs bigint")
    assert vectors.audit(nodes, links, of, 0.9) == (pytest.approx(40 / 60), 0.0)


def test_urls(spark):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/")]
    cases = {
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "http://": ("", "", None, "allow"),
        "HTTP://A.Example.ORG/es/1?x": ("a.example.org", "/es/1", "example.org/es/", "block"), "x://example.org?q/es/": ("example.org", "", None, "allow"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"), "https://www.bad.com/p.html?utm=1#x": ("www.bad.com", "/p.html", None, "block"),
        "http://m.bad.com/p/": ("m.bad.com", "/p/", None, "block"), "http://bad.com/q": ("bad.com", "/q", None, "allow"), "http://u.com/" + "p" * 100_000: ("u.com", "/" + "p" * 100_000, None, "allow"), "a://b://c/d": ("b:", "//c/d", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "h", 0, True) for i, u in enumerate(cases)] + [(0, None, None, 1, None)], "page_id bigint, url string, html string, block int, listed boolean")
    listed = spark.createDataFrame([("http://bad.com/p",), ("http://bad.com/p",), (None,), ("junk",)], "url string")
    for bytes_allowed in (8 << 20, 0):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, rules, listed, broadcast_bytes=bytes_allowed).collect()}
        assert got == dict(enumerate(cases.values()))
    assert urls.judge(pages, rules, listed.limit(0)).where("listed").count() == 0
    assert urls.judge(pages.limit(0), rules, listed).count() == 0
    plan = urls.judge(pages, rules, listed)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pipeline(spark, docs, texts, tmp_path):
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    current = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, current, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        current, before = spark.read.parquet(str(tmp_path / name)), current
        if name != "packing":
            assert current.columns == docs.columns
            assert current.count() <= before.count()
    assert {r.doc_id for r in current.select("doc_id").distinct().collect()} == {r.doc_id for r in before.select("doc_id").collect()}
    same = corpus_pipeline.run(spark, str(tmp_path))
    assert same.count() == current.count()
    for empty in ("quality_rules", "near_duplicates", "repeated_passages", "personal_data", "packing"):
        assert dict(corpus_pipeline.STAGES)[empty](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_pipeline_equals_a_plain_version(spark, texts, tmp_path):
    """All five stages again, in plain Python (too few labels for any cutoff, so only the base rule rejects)."""
    every = [*texts, f"{prose(random.Random(99), 40)} mail joe@ex.com or +1 (212) 555-8457 please", *["so it goes and goes on " * 2 + t for t in (texts[21] or "", texts[22] or "")]]
    make(spark, every).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    left = {}
    for i, t in enumerate(every):
        n_words, _, _, _, repeated = measured_plainly(t)
        if n_words >= 20 and 100 * repeated <= 30 * n_words:
            left[i] = t
    component = linked_plainly({i: shingles_plainly(t, 5) for i, t in left.items()}, 80)
    left = {i: t for i, t in left.items() if component[i] == i}
    rows = [(i, t.encode()) for i, t in left.items()]
    for (i, raw), gone in zip(rows, removed_plainly(rows, 50), strict=True):
        at, kept = 0, []
        for c in raw.decode():
            size = len(c.encode())
            if not all(gone[at : at + size]):
                kept.append(c)
            at += size
        text = "".join(kept)
        for start, kind, end in reversed(plain_spans(text)):
            text = f"{text[:start]}<{('EMAIL', 'IP', 'CARD', 'PHONE')[kind]}>{text[end:]}"
        left[i] = text
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    got = {i: [x for _, part in sorted(p) for x in part] for i, p in pieces.items()}
    assert any("<EMAIL>" in t for t in left.values())
    assert got == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in left.items()}


def test_queries_run_and_match_their_sql(spark):
    from tesserae.llm import queries

    con = duckdb.connect()
    for name in ("pages", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    found = __spark_entry__.queries()
    for name, sql in queries.oracle_sql().items():
        got = found[name](spark, SF)
        columns = ", ".join(got.columns)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(con.sql(f"SELECT {columns} FROM ({sql})").fetchall(), key=str)
    assert {f"op{n}" for n in range(1, 11)} | {"pipeline"} <= {name.split("_")[0] for name in found}


@pytest.fixture(scope="module")
def rows():
    """The documents of the sample tables: texts by id."""
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall())


def answers(spark, name, key="doc_id"):
    return {r[key]: r for r in __spark_entry__.queries()[name](spark, SF).collect()}


def test_op1_equals_brute_force(spark, rows):
    got = answers(spark, "op1_suffix_dedup")
    raw = [(i, t.encode()) for i, t in rows.items()]
    for (i, b), gone in zip(raw, removed_plainly(raw, 50), strict=True):
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())


def test_op2_op3_op4_equal_the_tokenizer(spark, rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in rows.items()}
    got = answers(spark, "op3_bpe")
    for i, own in ids.items():
        decoded = tokenizer.decode(own, skip_special_tokens=False).encode()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest())
    counted = dict.fromkeys(ids, 0)
    for r in __spark_entry__.queries()["op2_token_counts"](spark, SF).collect():
        counted[r.doc_id] += r.n_tokens
    assert counted == {i: len(own) for i, own in ids.items()}
    by_doc, by_sequence, waste = {}, {}, 0
    for r in __spark_entry__.queries()["op4_packing"](spark, SF).collect():
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, own in ids.items():
        whole, at = np.array([*own, 0], "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(whole), zlib.crc32(whole[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(whole)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        waste += 0 if at & (at - 1) == 0 else 1024 - at
        assert at <= 1024
    assert waste <= 0.02 * sum(map(len, ids.values()))


def test_op5_equals_brute_force(spark, rows):
    got = answers(spark, "op5_minhash_dedup")
    sets = {i: shingles_plainly(t, 4) for i, t in rows.items()}
    want = linked_plainly(sets, 80)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in rows}


def test_op6_equals_brute_force(spark):
    vecs = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY 1").fetchall()
    want = {i: (n, c) for (i, _), (n, c) in zip(vecs, vectors_linked_plainly(vecs, 0.9), strict=True)}
    got = answers(spark, "op6_vector_dedup", "vec_id")
    found = sum(r.n_links for r in got.values())
    assert 0.9 * sum(n for n, _ in want.values()) <= found
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    assert np.mean([got[i].component_id == c for i, (_, c) in want.items()]) >= 0.9


def test_op7_base_equals_a_plain_version(spark, rows):
    got = answers(spark, "op7_quality_rules")
    for i, t in rows.items():
        want = measured_plainly(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)


def test_op9_base_equals_a_plain_version(spark, rows):
    got = answers(spark, "op9_lm_scores")
    words = {i: [*WORD.findall(t.translate(LOWER)), None] for i, t in rows.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in rows}
    count = Counter(w for i, line in words.items() if not held[i] for w in line)
    n, v = sum(count.values()), len(count)
    for i, line in words.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(line), sum(count[w] > 0 for w in line), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in line), rel=1e-9)
        assert r.score < 0
    # A model of whole phrases beats single words on what it has not seen.
    assert sum(got[i].score - got[i].base_score for i in rows if held[i]) > 0


def test_op10_base_equals_a_plain_version(spark, rows):
    got = answers(spark, "op10_pii")
    for i, t in rows.items():
        want = plain_spans(t)
        told = ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for a, k, b in want)
        assert got[i].base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(k == j for _, k, _ in want) for j in range(4)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_every_page_of_a_listed_site_is_listed(sf):
    """Whatever ending a table gives the sites."""
    from tesserae.llm import queries

    hosts = [h for (h,) in duckdb.sql(f"SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) FROM '/root/testdata/{sf}/pages.parquet'").fetchall()]
    bad = {h.removeprefix("www.").removeprefix("m.").removeprefix("blog.") for h in hosts if any(s in h for s in queries.LISTED_SITES)}
    assert bad <= set(queries.LISTED_HOSTS)


@pytest.mark.parametrize("missing", ["tesserae.llm", "corpus_pipeline"])
def test_entry_works_without_the_subpackage(missing):
    import subprocess
    import sys

    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 40 and out[1] == "False"
