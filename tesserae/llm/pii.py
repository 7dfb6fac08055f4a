"""Personal data, also where it is disguised.

Plain identifiers are found on the text itself.  For the rest a text is run through
small transducers that rewrite disguises (look-alike letters, digits of other scripts,
invisible characters, spelled digits, "name at host dot org") and note for every
character they emit which source characters it stands for.  Identifiers found in the
rewritten text are mapped back, so every span refers to the text as it was given.

Spans are in code points, the end exclusive.  Plain spans always stay; a disguised one
is added where it overlaps no span of its kind.

Cases: null and empty texts hold nothing; any length is read whole; repeated rows are
treated alike; of disguised spans of a kind that overlap the one that starts first stays;
no rows give no rows; columns of other names pass unread.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kit import bound_batches, enter, flat

KINDS = ("email", "ip", "card", "phone")
# The patterns of plain identifiers, written so that no run of characters is read more than a few times: an address is
# looked for around each at sign, a number starts where its digits do, and repeats that need no second thought are possessive.
LOCAL = "".join(map(chr, (*range(48, 58), *range(65, 91), *range(97, 123)))) + "._%+-"
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Words for the digits 0 to 9 in the four languages of the corpus.
DIGIT_WORDS = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
MORE_DIGITS = {"oh": "0", "zwo": "2", "fuenf": "5"}
PLUS_WORDS = ("plus", "más", "mas")
AT_WORDS = ("at", "arroba", "ät", "arobase", "chez")
DOT_WORDS = ("dot", "punkt", "punto", "point")
# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(
    zip(
        "АВЕКМНОРСТУХЅІЈаеорсухѕіјԁԛԝһӏ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιαρυ" + "ı‐‑‒–—−․。．＠﹫∙",
        "ABEKMHOPCTYXSIJaeopcyxsijdqwhl" + "ABEZHIKMNOPTYXovlapu" + "i------...@@.",
        strict=False,
    )
)
INVISIBLE = "­​‌‍⁠﻿"

_DIGIT = {w: str(i) for line in DIGIT_WORDS for i, w in enumerate(line.split())} | MORE_DIGITS
_DIGIT_ALT = "|".join(sorted(map(re.escape, _DIGIT), key=len, reverse=True))
#: White space in a disguise is at most this long, a label of an address 64 characters, an address 9 labels on either side.
_BLANK = r"[\x20\t\r\n]{0,8}"
_SPACES, _SOME = r"\s{0,8}", r"\s{1,8}"
_GAP = rf"(?:{_BLANK}(?:[,.;/()-]{{1,2}}{_BLANK})?)"
_DOTS = "|".join(DOT_WORDS)
_PLUS = "|".join(PLUS_WORDS)
#: Six or more words for digits or dots in a row, perhaps mixed with written digits and after a plus.
SPELLED = re.compile(rf"(?<!\w)(?:(?:{_PLUS}|\+){_GAP})?(?:{_DIGIT_ALT}|[0-9])(?:{_GAP}(?<!\w)(?:{_DIGIT_ALT}|{_DOTS}|[0-9]++)(?!\w)){{5,}}+", re.IGNORECASE)
#: Cheap sign of every match of SPELLED that is not of written digits only: a digit word beside a digit word,
#: a dot or a written digit, or a plus word before one.
SPELLED_SIGN = re.compile(rf"(?<!\w)(?:(?:{_DIGIT_ALT})[^\w]{{1,20}}(?:{_DIGIT_ALT}|{_DOTS}|[0-9])|(?:{_DOTS}|[0-9]++)[^\w]{{1,20}}(?:{_DIGIT_ALT})(?!\w)|(?:{_PLUS})[^\w]{{1,20}}[0-9])", re.IGNORECASE)
SPELLED_PART = re.compile(rf"({_PLUS})|({_DIGIT_ALT})|([0-9+])|({_DOTS})|(.)", re.IGNORECASE | re.DOTALL)
_WRAP = lambda words, sign: rf"(?:{_SPACES}[\[({{<]{_SPACES}(?:{'|'.join(words)}|{sign}){_SPACES}[\])}}>]{_SPACES})"
_BARE = lambda words: rf"(?:{_SOME}(?:{'|'.join(words)}){_SOME})"
_AT = rf"(?:{_WRAP(AT_WORDS, '@')}|{_BARE(AT_WORDS)}|{_SPACES}@{_SPACES})"
_DOT = rf"(?:{_WRAP(DOT_WORDS, '[.]')}|{_BARE(DOT_WORDS)})"
_NAME, _LABEL = "[A-Za-z0-9_%+-]{1,64}+", "[A-Za-z0-9-]{1,64}+"
#: A disguised address: at least one dot is spelled or wrapped, or the at sign is wrapped.
DISGUISED = re.compile(
    rf"(?<![A-Za-z0-9._%+-]){_NAME}(?:(?:\.|{_DOT}){_NAME}){{0,8}}"
    rf"(?:{_AT}{_LABEL}(?:\.{_LABEL}){{0,8}}{_DOT}{_LABEL}(?:(?:\.|{_DOT}){_LABEL}){{0,8}}|{_WRAP(AT_WORDS, '@')}{_LABEL}(?:\.{_LABEL}){{1,8}})",
    re.IGNORECASE,
)
#: An address of four numbers with disguised dots.
DISGUISED_IP = re.compile(rf"(?<![\w.])[0-9]{{1,3}}+(?:(?:\.|{_DOT})[0-9]{{1,3}}+){{3}}(?!\w)", re.IGNORECASE)
#: An address with blanks around its at sign.
SPACED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20{1,8}@\x20{0,8}|\x20{0,8}@\x20{1,8})[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
SPACED_PART = re.compile(r"(\x20*@\x20*)|(.)", re.DOTALL)
#: Digits among which letters stand for 0 and 1.
LETTERED = re.compile(r"(?<![A-Za-z0-9])\+?[0-9OoIl](?:[\x20().-]{0,2}[0-9OoIl]){8,}+(?![A-Za-z0-9])")
LETTERED_PART = re.compile("([Oo])|([Il])|(.)", re.DOTALL)
# Endings that a host must have if its address is spelled in bare words.
ENDINGS = "com org net edu gov mil int info biz io ai app dev de fr es it nl uk eu us ca ch at be pl pt se no dk fi jp cn in br mx au ru example test".split()
DISGUISED_PART = re.compile(rf"({_AT})|({_DOT})|(.)", re.IGNORECASE | re.DOTALL)
#: Cheap signs that DISGUISED may match: first words in lower case, then what stands around them.
SIGNS = (*DOT_WORDS, "[", "(", "{", "<")
SIGN = re.compile(rf"\s(?:{_DOTS})\s|[\[({{<]\s?(?:@|\.|{'|'.join((*AT_WORDS, *DOT_WORDS))})", re.IGNORECASE)
#: Letters that match others without regard to case, but that lower() leaves or splits.
_FOLDS = str.maketrans("ſıİK", "siik")

# What bytes tell of a text: 1 digits, 2 an at sign, 4 a plus sign, 8 characters past U+02FF, a dotless i or a soft hyphen.
_FLAG = np.zeros(256, np.uint8)
_FLAG[48:58] = 1
_FLAG[64] = 2
_FLAG[43] = 4
_FLAG[0xCC:] = 8
_FLAG[[0xAD, 0xC4]] = 8


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, leftmost and not overlapping."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(LOCAL))
        host = HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
        done = host.end() if host else at + 1
        at = text.find("@", done)


def _byte(digits: str) -> bool:
    """At most 255, whatever the number of zeros before it."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def plain(text: str, flags: int = 15) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the identifiers that stand in the open, leftmost and not overlapping within a kind."""
    found = []
    if flags & 2:
        found += [(a, 0, b) for a, b in emails(text)]
    if flags & 1:
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(_byte, m[0].split(".")))]
        for m in CARD.finditer(text):
            if 12 <= m.end() - m.start() < 2 * 19:
                digits = re.sub("[ -]", "", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if flags & 4:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(found)


class Plainer(dict):
    """What each character becomes: look-alikes Latin, digits and full-width forms ASCII; noted for the next time."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        if code > 0x2FF or c == "ı":
            c = LOOKALIKES.get(c) or (str(unicodedata.decimal(c)) if c.isdecimal() else c)
            if "！" <= c <= "～":
                c = chr(ord(c) - 0xFEE0)
            elif len(n := unicodedata.normalize("NFKC", c)) == 1 and n.isascii():
                c = n
        self[code] = c
        return c


PLAINER = Plainer()
HIDDEN = re.compile(f"[{INVISIBLE}]+")


class View:
    """A text, or a rewritten one that knows which characters of the text it was made from its own stand for.

    A rewritten text is made of pieces: characters copied one by one, or characters that all stand for one range.
    """

    def __init__(self, text: str, parent: View | None = None, at: list[int] | None = None, source: list[tuple[int, int]] | None = None):
        self.text = text
        self.parent, self.at, self.source = parent, at, source  # where pieces begin, and (start, end) or (start, -1) for copied ones

    def range(self, i: int, j: int) -> tuple[int, int]:
        """The source characters that characters i to j - 1 stand for."""
        if self.parent is None:
            return i, j
        p, q = bisect.bisect_right(self.at, i) - 1, bisect.bisect_right(self.at, j - 1) - 1
        (a, whole), (b, end) = self.source[p], self.source[q]
        return self.parent.range(a if whole >= 0 else a + i - self.at[p], end if end >= 0 else b + j - self.at[q])

    def characters(self) -> View:
        """Look-alikes become Latin, digits and full-width forms ASCII; invisible characters and marks on digits vanish."""
        if HIDDEN.search(self.text):
            view = self.rewrite(HIDDEN, HIDDEN, lambda m: "")
            return View(view.text.translate(PLAINER), self, view.at, view.source)
        return View(self.text.translate(PLAINER), self, [0], [(0, -1)])

    def rewrite(self, whole: re.Pattern, part: re.Pattern, as_text, holds=None) -> View:
        """Within each match of `whole` for which `holds`, each match of `part` becomes as_text(match); the rest is copied."""
        chars, at, source, size, done = [], [], [], 0, 0

        def put(text: str, start: int, end: int) -> None:
            nonlocal size
            if text:
                chars.append(text)
                at.append(size)
                source.append((start, end))
                size += len(text)

        for m in whole.finditer(self.text):
            if holds is not None and not holds(m):
                continue
            put(self.text[done : m.start()], done, -1)
            for p in part.finditer(self.text, m.start(), m.end()):
                put(as_text(p), p.start(), p.end())
            done = m.end()
        if not done:
            return self
        put(self.text[done:], done, -1)
        return View("".join(chars), self, at, source)

    def spans(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        out = []
        for a, kind, b in found:
            start, end = self.range(a, b)
            out.append((start, kind, end))
        return out


def _spelled(m: re.Match) -> str:
    word = m[0].translate(_FOLDS).lower()
    return "+" if m[1] else _DIGIT.get(word, "") if m[2] else word if m[3] else "." if m[4] else ""


def _is_spelled(m: re.Match) -> bool:
    """Written digits alone are a list of numbers."""
    return SPELLED_SIGN.search(m[0]) is not None


def _lettered(m: re.Match) -> str:
    return "0" if m[1] else "1" if m[2] else m[0]


def _mostly_digits(m: re.Match) -> bool:
    """Some letters, but at least twice as many digits."""
    digits, letters = sum(map(str.isdigit, m[0])), sum(map(str.isalpha, m[0]))
    return 0 < 2 * letters <= digits


def _is_address(m: re.Match) -> bool:
    """Bare words ("look at the dot") are an address only with a known ending."""
    return m[0].rstrip()[-1] in ")]}>" or any(c in m[0] for c in "[({<@") or re.split(r"[\s.]+", m[0].lower())[-1] in ENDINGS


def _address(m: re.Match) -> str:
    return "@" if m[1] else "." if m[2] else m[0]


def disguised(text: str, flags: int = 15) -> list[tuple[int, int, int]]:
    """(start, kind, end) of identifiers in the rewritten text, in source positions (plain ones are among them)."""
    view, changed = View(text), False
    if flags & 8:
        view = view.characters()
        changed = view.text != text
    found = []

    def rewritten(whole: re.Pattern, part: re.Pattern, as_text, holds=None) -> None:
        nonlocal view, changed
        before, view = view, view.rewrite(whole, part, as_text, holds)
        changed |= view is not before

    if SPELLED_SIGN.search(view.text):
        # A spelled run of 9 to 15 digits without a plus sign is a phone number, if it is no card number.
        for m in SPELLED.finditer(view.text):
            if not _is_spelled(m):
                continue
            digits = "".join(map(_spelled, SPELLED_PART.finditer(m[0])))
            if 9 <= len(digits) <= 15 and digits.isdigit() and len(set(digits)) > 2 and not (len(digits) >= 12 and luhn(digits)):
                found.append((m.start(), 3, m.end()))
        found = view.spans(found)
        rewritten(SPELLED, SPELLED_PART, _spelled, _is_spelled)
    if any(c.isdigit() for c in view.text) if flags & 8 or changed else flags & 1:
        rewritten(LETTERED, LETTERED_PART, _lettered, _mostly_digits)
    if " @" in view.text or "@ " in view.text:
        rewritten(SPACED, SPACED_PART, lambda m: "@" if m[1] else m[0])
    low = view.text.lower()
    if any(x in low for x in SIGNS) and SIGN.search(view.text):
        rewritten(DISGUISED_IP, DISGUISED_PART, _address)
        rewritten(DISGUISED, DISGUISED_PART, _address, _is_address)
    if not changed:
        return []
    few = lambda a, kind, b: kind >= 2 and len(set(filter(str.isdigit, view.text[a:b]))) < kind  # noqa: E731  a word said over and over is no number
    return sorted(view.spans([x for x in plain(view.text) if not few(*x)]) + found)


def find(text: str, flags: int = 15) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Plain spans, and all spans: (start, kind, end), sorted. Added are those that overlap none of their kind."""
    base = plain(text, flags)
    more = disguised(text, flags)
    if not more:
        return base, base
    spans = list(base)
    for kind in range(len(KINDS)):
        mine = [(a, b) for a, k, b in base if k == kind]
        at, done = 0, -1  # the first plain span that ends after what comes next starts; where the last added span ends
        for start, k, end in more:
            if k == kind:
                while at < len(mine) and mine[at][1] <= start:
                    at += 1
                if start >= done and (at == len(mine) or mine[at][0] >= end):
                    spans.append((start, kind, end))
                    done = end
    return base, sorted(spans)


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _flags(column: pa.Array) -> list[int]:
    data, offsets = flat(column)
    out = np.zeros(len(offsets) - 1, np.uint8)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        out[some] = np.bitwise_or.reduceat(_FLAG[data], offsets[some])
    return out.tolist()


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, plain spans and all spans as arrays of (kind, start, end)."""
    bound_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("pii")
        row = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]
        for batch in batches:
            both = [find(t or "", f) for t, f in zip(batch.column(1).to_pylist(), _flags(batch.column(1)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row(a) for a, _ in both], span), pa.array([row(b) for _, b in both], span)], ["__id", "plain", "spans"])

    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).mapInArrow(run, f"__id {kind}, plain {spans}, spans {spans}").withColumnRenamed("__id", doc_id)


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Counts of the plain spans by kind, a hash of them, and all spans as text."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: F.filter("plain", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(doc_id, *counts, F.sha2(text("plain"), 256).alias("base_sha256"), text("spans").alias("spans"), (F.size("spans") - F.size("plain")).cast("long").alias("n_added"))


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; the other columns stay."""
    bound_batches(docs.sparkSession)

    def hide(value: str | None, flags: int) -> str | None:
        if not value:
            return value
        out, at = [], 0
        for start, kind, end in find(value, flags)[1]:
            if start >= at:
                out += [value[at:start], f"<{KINDS[kind].upper()}>"]
            at = max(at, end)
        return "".join([*out, value[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("pii")
        for batch in batches:
            column = batch.column(text)
            hidden = pa.array([hide(t, f) for t, f in zip(column.to_pylist(), _flags(column), strict=True)], column.type)
            yield pa.RecordBatch.from_arrays([hidden if n == text else batch.column(n) for n in batch.schema.names], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)

