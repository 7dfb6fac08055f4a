"""URL filters: rules by host and path, and a list of canonical URLs behind a blocked Bloom filter.

Only DataFrame functions are used.  The filter has blocks of 256 bits, four words of 64;
a listed URL sets one bit in each word of one block, so a test reads one row.  Pages that
the filter passes are joined with the list itself, which removes false positives; all
others are never shuffled.  The filter is broadcast while its size, which follows from
the list's length, stays below ``broadcast_bytes``; beyond it is joined by block.

Cases: a null url or one without "://" has an empty host and path, fits no rule and is
never listed; empty urls likewise; urls of any length are judged whole; repeated pages
are judged alike; of rules of one length that fit, the first given decides; a URL listed
twice counts once; no pages give no rows; an empty list blocks nothing; null list entries do not count; columns
of other names pass unread.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_URL, BLOCK_BITS, ROW_BYTES = 12, 256, 64
#: (verdict, host, path) of a rule.
Rule = tuple[str, str, str]


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without a leading www. or m., path without .html and final slashes; null if there is no host."""
    bare = F.regexp_replace(host(url), r"^(www|m)\.", "")
    return F.when(host(url) != "", F.concat(bare, F.regexp_replace(path(url), r"(\.html|/+)$", "")))


def _choose(rules: list[Rule], pick) -> Column:
    """The longest rule that fits decides."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda r: ((F.col("host") == r[1]) | F.col("host").endswith("." + r[1])) & F.col("path").startswith(r[2])
    return reduce(lambda rest, r: F.when(fits(r), F.lit(pick(r))).otherwise(rest), reversed(ordered), F.lit(None).cast("string"))


def bloom(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """One row per block that has bits: its number and its four words."""
    h = f"xxhash64({key}, 1)"
    words = [f"bit_or(shiftleft(1L, cast(shiftright({h}, {6 * i}) & 63 as int))) AS w{i}" for i in range(4)]
    return keys.groupBy(F.expr(f"pmod(xxhash64({key}), {blocks}L)").alias("block")).agg(*map(F.expr, words))


def maybe_in(pages: DataFrame, key: str, filter_rows: DataFrame, blocks: int, small: bool) -> DataFrame:
    """Adds `maybe`: false if the key is surely not listed."""
    h = f"xxhash64({key}, 1)"
    test = " AND ".join(f"(w{i} & shiftleft(1L, cast(shiftright({h}, {6 * i}) & 63 as int))) != 0" for i in range(4))
    keyed = pages.withColumn("__block", F.expr(f"pmod(xxhash64({key}), {blocks}L)"))
    other = filter_rows.withColumnRenamed("block", "__block")
    joined = keyed.join(F.broadcast(other) if small else other, "__block", "left")
    return joined.withColumn("maybe", F.expr(f"coalesce({key} IS NOT NULL AND {test}, false)")).drop("__block", "w0", "w1", "w2", "w3")


def judge(pages: DataFrame, rules: list[Rule], listed: DataFrame, page_id: str = "page_id", url: str = "url", listed_url: str = "url", broadcast_bytes: int = 8 << 20) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, and `listed` (true if its canonical URL is on the list).

    A rule's verdict stands; without one a listed page is blocked and any other allowed.
    """
    names = listed.select(canonical(F.col(listed_url)).alias("__canonical")).where("__canonical IS NOT NULL").distinct()
    n = names.count()
    blocks = max(1, -(-n * BITS_PER_URL // BLOCK_BITS))
    parts = pages.select(F.col(page_id), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"), canonical(F.col(url)).alias("__canonical"))
    tested = maybe_in(parts, "__canonical", bloom(names, "__canonical", blocks), blocks, blocks * ROW_BYTES <= broadcast_bytes)
    hits = tested.where("maybe").join(names.withColumn("listed", F.lit(True)), "__canonical", "left")
    rest = tested.where("NOT maybe").withColumn("listed", F.lit(False))
    both = hits.select(page_id, "host", "path", F.coalesce("listed", F.lit(False)).alias("listed")).unionByName(rest.select(page_id, "host", "path", "listed"))
    return both.select(
        page_id, "host", "path", _choose(rules, lambda r: r[1] + r[2]).alias("rule"),
        F.coalesce(_choose(rules, lambda r: r[0]), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "listed",
    )
