"""Near-duplicate vectors by NN-descent.

Equal vectors are one class first. A neighbour graph over the classes starts from
random projections: in several tables vectors are sorted by the signs of projections
and then along a direction, and each is compared with the next few. Rounds of descent
then compare, around every vector, its neighbours and those it is a neighbour of with
each other, and keep the best of what each vector has seen, until next to nothing
changes. Edges at or above the threshold, confirmed in double precision, are links and
make components. A list that is full of links is saturated and may hide more. Inside a
component such lists are enlarged to the whole of it: its members are compared in blocks,
which yields every link and needs no list. For links to other components descent goes on
among the vectors with saturated lists, whose new lists hold the best vector of each
other component only, until it joins no more components.

Recall is audited on every run: a bounded number of vectors is compared with all
others, some drawn from all vectors and some from those outside the largest component.
The share of its links that was found is averaged over the vectors of each draw. While
it is too small, the search is repeated with twice the neighbours and tables; if that
does not help either, an error says so.

Cases: vectors that are null, empty or zero, or hold null or non-finite components, are
linked with nothing; vectors of different lengths are not linked; rows with a null id
are linked with nothing and belong to no component; repeated rows are vectors of their
own; of neighbours that are as near the one with the smaller id goes first; no rows give
no rows; columns of other names pass unread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .kit import as_long, bound_batches, enter, forget, settle, shuffle_parts, split_join

#: Vectors that the audit compares with all others.
AUDITED = 256
CHUNK = 256
NEAR = 4  # later vectors that each is compared with in a sorted table


def _normal(raw: list[bytes]) -> np.ndarray:
    """Vectors of one length as rows."""
    return np.frombuffer(b"".join(raw), "<f4").reshape(len(raw), -1)


def _nodes(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """Distinct usable vectors: id (the smallest), m (how many), x and v (normalised, as 64- and 32-bit floats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("vectors")
        for batch in batches:
            xs, vs = [], []
            for row in batch.column(2).to_pylist():
                x = np.array(row, np.float64)
                # Scaled first, so that neither squares nor sums overflow.
                top = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0.0
                if top > 0:
                    x = x / top
                    x /= np.sqrt((x * x).sum())
                    xs.append(x.astype("<f8").tobytes())
                    vs.append(x.astype("<f4").tobytes())
                else:
                    xs.append(None)
                    vs.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(xs, pa.binary()), pa.array(vs, pa.binary())], ["id", "m", "x", "v"])

    usable = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & ~F.exists(embedding, lambda c: c.isNull()))
    classes = usable.groupBy(F.col(embedding).alias("e")).agg(F.min(F.col(vec_id).cast("long")).alias("id"), F.count(F.lit(1)).alias("m"))
    return classes.select("id", "m", "e").mapInArrow(run, "id long, m long, x binary, v binary").where("x IS NOT NULL")


def _projected(nodes: DataFrame, tables: int, bits: int, seed: int) -> DataFrame:
    """Each vector once per table: the table, the signs of `bits` projections, one more projection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("vectors")
        for batch in batches:
            raw = batch.column(2).to_pylist()
            for size in sorted(set(map(len, raw))):
                rows = [i for i, r in enumerate(raw) if len(r) == size]
                v = _normal([raw[i] for i in rows])
                own = batch.take(pa.array(rows)).columns
                for t in range(tables):
                    p = v @ np.random.default_rng([seed, t, size]).standard_normal((v.shape[1], bits + 1)).astype("f4")
                    code = (p[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([as_long(np.full(len(rows), t)), as_long(code), pa.array(p[:, bits].astype("f8")), *own], ["t", "code", "along", "id", "c", "v"])

    return nodes.select("id", "c", "v").mapInArrow(run, "t long, code long, along double, id long, c long, v binary")


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares each vector of a sorted table with the next few that are of other components, and not of one twice in a row."""
    tail = None
    for batch in batches:
        if tail is not None:
            batch = pa.Table.from_batches([tail, batch]).combine_chunks().to_batches()[0]
        n = batch.num_rows
        if not n:
            continue
        t, ids, c, raw = batch.column(0).to_numpy(), batch.column(3).to_numpy(), batch.column(4).to_numpy(), batch.column(5).to_pylist()
        sizes = np.array([len(r) for r in raw])
        runs = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (t[1:] != t[:-1]))))
        run = np.repeat(np.arange(len(runs)), np.diff(np.concatenate((runs, [n]))))
        out = [[], [], []]
        for step in range(1, NEAR + 1):
            i = np.flatnonzero(run + step < len(runs))
            j = runs[run[i] + step]
            ok = (sizes[i] == sizes[j]) & (t[i] == t[j]) & (c[i] != c[j])
            i, j = i[ok], j[ok]
            for size in np.unique(sizes[i]):
                p, q = i[sizes[i] == size], j[sizes[i] == size]
                for part, values in zip(out, (p, q, np.einsum("ij,ij->i", _normal([raw[k] for k in p]), _normal([raw[k] for k in q]))), strict=True):
                    part.append(values)
        if out[0]:
            i, j, sim = (np.concatenate(x) for x in out)
            yield _edges(np.concatenate((ids[i], ids[j])), np.concatenate((ids[j], ids[i])), np.concatenate((c[j], c[i])), np.concatenate((sim, sim)))
        tail = batch.slice(max(0, n - CHUNK))


EDGES = "a long, b long, cb long, sim float"


def _edges(a: np.ndarray, b: np.ndarray, cb: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([as_long(a), as_long(b), as_long(cb), pa.array(sim.astype("f4"))], ["a", "b", "cb", "sim"])


def _best(edges: DataFrame, k: int, apart: bool) -> DataFrame:
    """The k best neighbours of each vector with the worst similarity that a better one must pass; `apart`: one of each component.

    Edges come with `old`, which tells that a list had them before.
    """
    once = edges.where("a <> b").groupBy("a", "b", "cb").agg(F.max("sim").alias("sim"), F.max("old").alias("old"))
    order = (F.desc("sim"), "b")
    if apart:
        once = once.withColumn("r", F.row_number().over(Window.partitionBy("a", "cb").orderBy(*order))).where("r = 1")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(*order))
    top = once.withColumn("r", rank).where(F.col("r") <= k)
    of = Window.partitionBy("a")
    worst = F.when(F.count(F.lit(1)).over(of) >= k, F.min("sim").over(of)).otherwise(F.lit(-2.0)).cast("float")
    return top.select("a", "b", "cb", "sim", "r", "old", worst.alias("worst"))


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Around each vector u (rows are sorted by it): compares its neighbours with each other and emits
    what is better than the worst that one of the two has so far."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        u = batch.column(0).to_numpy()
        done = int(np.searchsorted(u, u[-1])) if len(u) else 0
        rest = batch.slice(done)
        yield from _compare(batch.slice(0, done))
    if rest is not None:
        yield from _compare(rest)


def _compare(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if not batch.num_rows:
        return
    # A neighbour both ways comes twice.
    u, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    batch = batch.filter(pa.array(np.concatenate(([True], (u[1:] != u[:-1]) | (ids[1:] != ids[:-1])))))
    u, ids, c, worst, raw = *(batch.column(i).to_numpy() for i in range(4)), batch.column(4).to_pylist()
    starts = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
    counts = np.diff(np.concatenate((starts, [len(u)])))
    sizes = np.array([len(r) for r in raw])
    width = sizes.max() // 4
    v = _normal(raw) if (sizes == sizes[0]).all() else np.stack([np.pad(np.frombuffer(r, "<f4"), (0, width - len(r) // 4)) for r in raw])
    most, step = counts.max(), max(1, 4_000_000 // int(counts.max() * (counts.max() + width)))
    for at in range(0, len(starts), step):
        s, n = starts[at : at + step], counts[at : at + step]
        slot = s[:, None] + np.minimum(np.arange(most), n[:, None] - 1)
        real = np.arange(most) < n[:, None]
        block = v[slot]
        sim = np.matmul(block, block.transpose(0, 2, 1))
        # Each end of a pair hears of it if that improves its own list.
        good = (sim > np.where(real, worst[slot], np.inf)[:, :, None]) & real[:, :, None] & real[:, None, :]
        good &= (sizes[slot][:, :, None] == sizes[slot][:, None, :]) & (c[slot][:, :, None] != c[slot][:, None, :])
        g, i, j = np.nonzero(good)
        if len(g):
            p, q, x = slot[g, i], slot[g, j], sim[g, i, j]
            _, first = np.unique(np.stack((ids[p], ids[q])), axis=1, return_index=True)
            yield _edges(ids[p[first]], ids[q[first]], c[q[first]], x[first])


def graph(nodes: DataFrame, k: int, tables: int, rounds: int = 8, seed: int = 17, inside: DataFrame | None = None) -> DataFrame:
    """The neighbour graph of nodes (id, c, v): (a, b, cb, sim, r, old, worst), up to k rows for each a, of other c than its own.

    With the lists `inside` components (a, b) given, each list has one vector of any other component,
    and descent goes through both kinds of lists.
    """
    apart = inside is not None
    n = nodes.count()
    bits = max(1, min(40, n.bit_length() - 4))
    parts = shuffle_parts(nodes.sparkSession)
    spread = _projected(nodes, tables, bits, seed).repartitionByRange(parts, "t", "code", "along").sortWithinPartitions("t", "code", "along")
    best = settle(_best(spread.mapInArrow(_beside, EDGES).withColumn("old", F.lit(False)), k, apart))
    for _ in range(rounds):
        # Of those that a vector is a neighbour of, as many as it has neighbours; the rest meet elsewhere.
        order = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "b"))
        back = best.select(F.col("b").alias("u"), F.col("a").alias("b"), "sim").withColumn("r", order).where(F.col("r") <= k).select("u", "b")
        around = best.select(F.col("a").alias("u"), "b").unionByName(back).unionByName(nodes.select(F.col("id").alias("u"), F.col("id").alias("b")))
        if apart:
            around = around.unionByName(inside.select(F.col("a").alias("u"), "b"))
        vector = nodes.select(F.col("id").alias("b"), "c", "v").join(best.where("r = 1").select(F.col("a").alias("b"), "worst"), "b", "left")
        rows = split_join(around, vector, ["b"]).select("u", "b", "c", F.coalesce("worst", F.lit(-2.0)).cast("float").alias("worst"), "v")
        found = rows.repartition(parts, "u").sortWithinPartitions("u", "b").mapInArrow(_local, EDGES)
        every = best.select("a", "b", "cb", "sim").withColumn("old", F.lit(True)).unionByName(found.withColumn("old", F.lit(False)))
        before, best = best, settle(_best(every, k, apart))
        forget(before)
        if best.where("NOT old").count() <= n * k * (0.01 if apart else 0.001):
            break
    return best


def _confirmed(edges: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("vectors")
        for batch in batches:
            keep = [len(x) == len(y) and float(np.frombuffer(x, "<f8") @ np.frombuffer(y, "<f8")) >= threshold for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    near = edges.where(F.col("sim") >= threshold - 1e-3).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = split_join(split_join(near, nodes.select(F.col("id").alias("a"), F.col("x").alias("xa")), ["a"]), nodes.select(F.col("id").alias("b"), F.col("x").alias("xb")), ["b"])
    return both.select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long")


def _across(near: DataFrame, nodes: DataFrame, edges: DataFrame, of: DataFrame, threshold: float, k: int, tables: int, tries: int) -> tuple[DataFrame, DataFrame]:
    """Edges and components with the links that saturated lists of the graph `near` hide: those to other components."""
    full = near.where(F.col("r") == k).where(F.col("worst") >= threshold - 1e-3).select(F.col("a").alias("id"))
    for attempt in range(tries):
        labelled = full.join(of.select(F.col("node").alias("id"), F.col("component").alias("c")), "id")
        saturated = settle(labelled.join(nodes.select("id", "x", "v"), "id"))
        if saturated.agg(F.min("c") == F.max("c")).first()[0] in (None, True):
            break
        found = graph(saturated, k, tables, rounds=4, seed=101 + attempt, inside=near)
        more = settle(_confirmed(found, nodes, threshold))
        forget(saturated)
        if more.isEmpty():
            break
        edges = edges.unionByName(more)
        of = components(edges)
    return edges, of


def _blocks(members: DataFrame) -> DataFrame:
    """(component, chunk, chunks, rows): the members of each component in blocks of about CHUNK."""
    size = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    placed = split_join(members, size, ["component"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
    return settle(placed.groupBy("component", "chunk", "chunks").agg(F.collect_list(F.struct("id", "m", "x")).alias("rows")))


def _counts(members: DataFrame, threshold: float) -> DataFrame:
    """(id, others, pairs): the members of the same component that are linked with each, with multiplicity and without; in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("vectors")
        for batch in batches:
            ids, others, pairs = [], [], []
            for same, one, two in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                sizes = [np.array([len(r["x"]) for r in side]) for side in (one, two)]
                sim = np.zeros((len(one), len(two)))
                for size in np.unique(sizes[0]):
                    i, j = np.flatnonzero(sizes[0] == size), np.flatnonzero(sizes[1] == size)
                    if len(j):
                        a, b = (np.frombuffer(b"".join(side[k]["x"] for k in rows), "<f8").reshape(len(rows), -1) for side, rows in ((one, i), (two, j)))
                        sim[np.ix_(i, j)] = a @ b.T
                hit = sim >= threshold
                if same:
                    np.fill_diagonal(hit, False)
                ids.append([r["id"] for r in one])
                others.append(hit @ np.array([r["m"] for r in two], np.int64))
                pairs.append(hit.sum(axis=1))
                if not same:
                    ids.append([r["id"] for r in two])
                    others.append(hit.T @ np.array([r["m"] for r in one], np.int64))
                    pairs.append(hit.sum(axis=0))
            if ids:
                yield pa.RecordBatch.from_arrays([as_long(np.concatenate(ids)), as_long(np.concatenate(others)), as_long(np.concatenate(pairs))], ["id", "others", "pairs"])

    chunks = _blocks(members)
    # The blocks of a large component meet in as many places as the root of their number: each goes to one place
    # to be compared with all, and to all of them to be compared with those.
    places = F.ceil(F.sqrt("chunks"))
    one = chunks.withColumn("place", F.pmod("chunk", places)).drop("chunks")
    other = chunks.select("component", F.col("chunk").alias("chunk2"), F.col("rows").alias("rows2"), F.explode(F.sequence(F.lit(0).cast("long"), places - 1)).alias("place"))
    both = one.join(other, ["component", "place"]).where("chunk <= chunk2").select((F.col("chunk") == F.col("chunk2")).alias("same"), "rows", "rows2")
    return both.mapInArrow(run, "id long, others long, pairs long").groupBy("id").agg(F.sum("others").alias("others"), F.sum("pairs").alias("pairs"))


def audit(nodes: DataFrame, links: DataFrame, of: DataFrame, threshold: float, sample: int = AUDITED) -> tuple[float, float]:
    """Mean share of a vector's links that were found: over a sample of all vectors, and of those outside the largest component.

    Vectors are distinct here, each link counts once, and vectors without links do not count.
    """
    largest = of.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    inside = of.join(F.broadcast(largest), "component", "left_semi").select(F.col("node").alias("id"))
    draw = lambda ids: [r.id for r in ids.orderBy(F.xxhash64("id")).limit(sample).collect()]
    draws = draw(nodes.select("id")), draw(nodes.select("id").join(inside, "id", "left_anti"))
    chosen = nodes.where(F.col("id").isin(*{i for d in draws for i in d})).join(links, "id", "left").select("id", "x", F.coalesce("pairs", F.lit(0)).alias("pairs")).collect()
    by_size: dict[int, list] = {}
    for r in chosen:
        by_size.setdefault(len(r["x"]), []).append(r)
    queries = {size: (np.array([r["id"] for r in rows], np.int64), np.frombuffer(b"".join(bytes(r["x"]) for r in rows), "<f8").reshape(len(rows), -1)) for size, rows in by_size.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("vectors")
        for batch in batches:
            ids, raw = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for size, (of_query, q) in queries.items():
                rows = [i for i, x in enumerate(raw) if len(x) == size]
                if rows:
                    x = np.frombuffer(b"".join(raw[i] for i in rows), "<f8").reshape(len(rows), -1)
                    hit = (x @ q.T >= threshold) & (ids[rows][:, None] != of_query)
                    yield pa.RecordBatch.from_arrays([as_long(of_query), as_long(hit.sum(axis=0))], ["id", "n"])

    true = {r["id"]: r["n"] for r in nodes.select("id", "x").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    share = {r["id"]: min(1.0, r["pairs"] / true[r["id"]]) for r in chosen if true.get(r["id"])}
    means = [np.mean(x) if (x := [share[i] for i in d if i in share]) else 1.0 for d in draws]
    return float(means[0]), float(means[1])


def link(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.9, k: int = 10, tables: int = 6, recall: float = 0.95, tries: int = 3, said: Callable[[str], None] = lambda s: None) -> DataFrame:
    """One row per vector: id, n_links (other vectors linked directly), component_id (the smallest id reachable) and kept."""
    bound_batches(vectors.sparkSession)
    nodes = settle(_nodes(vectors, vec_id, embedding))
    for attempt in range(tries):
        near = graph(nodes.withColumn("c", F.col("id")), k << attempt, tables << attempt)
        edges = settle(_confirmed(near, nodes, threshold))
        edges, of = _across(near, nodes, edges, components(edges), threshold, k << attempt, tables << attempt, tries)
        links = settle(_counts(nodes.join(of.withColumnRenamed("node", "id"), "id").select("component", "id", "m", "x"), threshold))
        every, outside = audit(nodes, links, of, threshold)
        said(f"audit: {every:.3f} of a vector's links, {outside:.3f} outside the largest component")
        if min(every, outside) >= recall:
            break
    else:
        raise RuntimeError(f"the audit found {every:.3f} of a vector's links, {outside:.3f} outside the largest component, after {tries} tries")
    named = nodes.select("id", "m").join(links, "id", "left").join(of.withColumnRenamed("node", "id"), "id", "left")
    named = named.select(F.col("id").alias("rep"), (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("c"))
    # Each row finds its class by the vector itself.
    usable = F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & ~F.exists(embedding, lambda c: c.isNull())
    classes = vectors.where(usable).groupBy(F.col(embedding).alias("e")).agg(F.min(F.col(vec_id).cast("long")).alias("rep")).join(named, "rep")
    rows = vectors.select(F.col(vec_id).alias("__id"), F.when(usable, F.col(embedding)).alias("e"))
    out = rows.join(classes, "e", "left")
    component = F.when(F.col("__id").isNotNull(), F.coalesce("c", F.col("__id").cast("long")))
    return out.select(F.col("__id").alias(vec_id), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("__id"), F.lit(True)).alias("kept"))
