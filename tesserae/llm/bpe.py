"""Byte-level BPE over a prefix-sharing trie.

Greedy merge-order BPE has a useful property: the encoding of a prefix is fully
described by its *last* token.  If ``t`` is the last token of ``p`` then the
encoding of ``p`` is the encoding of ``p`` without ``t``, followed by ``t``.  So
every node of a trie of words needs one number, the last token of the prefix it
stands for, and that number follows from the states of its ancestors: of the
vocabulary entries that end the prefix, exactly one is *stable* next to the last
token of what precedes it (no merge with an earlier rank crosses the seam).

The distinct new words of a batch form a trie that is walked depth first: sorted
order is its pre-order, and two stacks hold the states of the open prefixes, so what
words share is solved once.  Reading an encoding means hopping up the open path by
token lengths.  The tokens that may end a prefix come from an automaton over the
vocabulary, one step a byte.

Solved words stay in the Python worker in two generations: once the young one holds
``max_words`` words it becomes the old one, whose words move back when they are met
again (a memory bound only: a word that was dropped is simply solved again).  Words of
more than LONG characters are solved whole, too, but not kept.

Cases: an empty text has no ids; a text or word of any length is encoded whole, in time
that grows with its length; words that occur again, in one text or another, have the same ids;
strings of special tokens are one id each.  Files with settings that this encoder does
not follow (a normalizer, another splitting, tokens that swallow blanks) are refused.
"""

from __future__ import annotations

import json
import re
import struct
from itertools import chain

import numpy as np
import regex

from .kit import DROPS
from .suffixes import common_prefixes

#: Pre-tokenizer pattern of the public byte-level BPE (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same pattern for texts without characters past U+00FF, with their classes spelled out: ``re`` is over twice as fast.
_L, _N, _S = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe", "\\t-\\r \\x85\\xa0"
LATIN_PATTERN = rf" ?[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"

_LOADED: dict[str, "TrieBPE"] = {}
DROPS.append(_LOADED.clear)


def _printable_bytes() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, others shift past 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Bytes of a shared prefix that are compared at once.
SEEN = 24
#: Longer words are not kept.
LONG = 1000
#: Two ids make one key; the innermost loop spells the number out.
ID_BITS = 20


def _refuse_others(spec: dict) -> None:
    """An error for a file whose settings would lead to other ids than this encoder's."""
    model, split, decoder = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
    plain = {
        "a BPE model": model.get("type", "BPE") == "BPE",
        "no normalizer": spec.get("normalizer") is None,
        "byte-level splitting without a prefix space": split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True),
        "a byte-level decoder": decoder.get("type") == "ByteLevel",
        "no dropout, affixes, byte fallback or ignored merges": not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
        "added tokens that stand for their own characters": not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")),
        f"ids below {1 << ID_BITS}": max([*model["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))]) < 1 << ID_BITS,
    }
    for what, holds in plain.items():
        if not holds:
            raise ValueError(f"the tokenizer file must have {what}")


def _shared_prefixes(words: list[bytes]) -> list[int]:
    """How many bytes each word shares with the one before it, up to SEEN."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    text = np.frombuffer(b"".join(words) + bytes(SEEN + 8), np.uint8)
    shared = common_prefixes(text, np.cumsum(sizes) - sizes, SEEN)
    shared[1:] = np.minimum(shared[1:], np.minimum(sizes[1:], sizes[:-1]))
    return shared.tolist()


class TrieBPE:
    """Encoder and decoder for one ``tokenizers`` JSON file with a byte-level BPE model."""

    def __init__(self, path: str, max_words: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _refuse_others(spec)
        alphabet = _printable_bytes()
        to_bytes = lambda s: bytes(alphabet[c] for c in s)
        vocab = {to_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        self.token_bytes: dict[int, bytes] = {i: t for t, i in vocab.items()}
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes |= {i: s.encode() for s, i in self.specials.items()}
        self.vocab = vocab
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            a, b = to_bytes(a), to_bytes(b)
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank[left, right] = r
            self.made.setdefault(whole, (r, left, right))
        self._automaton(vocab)
        self.lengths = {i: len(t) for t, i in vocab.items()}
        self.packed = [struct.pack("<I", i) for i in range(max(self.lengths) + 1)]
        self.words_of = regex.compile(PATTERN).findall
        self.latin_words_of = re.compile(LATIN_PATTERN).findall
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.stable: dict[int, bool] = {}
        self.max_words = max_words
        self.table: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _automaton(self, vocab: dict[bytes, int]) -> None:
        """For each state, the tokens that end there, longest first: what may be the last token of a prefix."""
        go: dict[int, int] = {}
        token = [-1]
        deep = [0]
        for t, i in vocab.items():
            at = 0
            for b in t:
                nxt = go.get(at << 8 | b)
                if nxt is None:
                    nxt = go[at << 8 | b] = len(token)
                    token.append(-1)
                    deep.append(deep[at] + 1)
                at = nxt
            token[at] = i
        fail, ends = [0] * len(token), [()] * len(token)
        for key, at in sorted(go.items(), key=lambda x: deep[x[1]]):
            up, b = key >> 8, key & 255
            if up:
                f = fail[up]
                while f and f << 8 | b not in go:
                    f = fail[f]
                fail[at] = go.get(f << 8 | b, 0)
            ends[at] = (((token[at], deep[at]),) if token[at] >= 0 else ()) + ends[fail[at]]
        self.go, self.fail, self.ends = go, fail, ends

    def _step(self, state: int, b: int) -> int:
        """The automaton's next state, noted for the next time."""
        at, go, fail = state, self.go, self.fail
        while at and at << 8 | b not in go:
            at = fail[at]
        go[state << 8 | b] = at = go.get(at << 8 | b, 0)
        return at

    def _is_stable(self, seam: int) -> bool:
        """True if two tokens stay apart: undo their merges, latest first, and see that no earlier merge joins the seam."""
        made, rank, none = self.made, self.rank, 1 << 60
        left, right, before = seam >> ID_BITS, seam & (1 << ID_BITS) - 1, none
        while True:
            if rank.get((left, right), none) < before:
                ok = False
                break
            ra, rb = made.get(left, (-1,))[0], made.get(right, (-1,))[0]
            if ra < 0 and rb < 0:
                ok = True
                break
            # Of two tokens, the one with the later merge was formed last.  A seam pair of the
            # same rank as the left token's merge comes after it, as it stands further right.
            if ra > rb:
                before, left = ra, made[left][2]
            else:
                before, right = rb + 1, made[right][1]
        if len(self.stable) > 500_000:
            self.stable.clear()
        self.stable[seam] = ok
        return ok

    def learn(self, words) -> None:
        """Insert distinct words in sorted order, which is a depth-first walk of their trie."""
        lengths, packed, table = self.lengths, self.packed, self.table
        go, ends, stable, is_stable = self.go, self.ends, self.stable, self._is_stable
        last, state, before = [-1], [0], b""  # of the open prefixes, by depth
        add, enter, find, known = last.append, state.append, go.get, stable.get
        texts = sorted(words)  # the order of code points is that of their UTF-8 bytes
        encoded = [t.encode() for t in texts]
        for text, word, same in zip(texts, encoded, _shared_prefixes(encoded), strict=True):
            size = len(word)
            if same == SEEN:
                while same < size and same < len(before) and word[same] == before[same]:
                    same += 1
            del last[same + 1 :], state[same + 1 :]
            at = state[same]
            for depth in range(same, size):
                b = word[depth]
                to = find(at << 8 | b)
                at = self._step(at, b) if to is None else to
                enter(at)
                for token, long in ends[at]:
                    if long > depth:
                        add(token)
                        break
                    seam = last[depth + 1 - long] << 20 | token
                    ok = known(seam)
                    if is_stable(seam) if ok is None else ok:
                        add(token)
                        break
            token = last[size]
            depth = size - lengths[token]
            if not depth:
                table[text] = packed[token]
            else:
                ids = [packed[token]]
                while depth:
                    token = last[depth]
                    depth -= lengths[token]
                    ids.append(packed[token])
                ids.reverse()
                table[text] = b"".join(ids)
            before = word

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text; the strings of special tokens stand alone."""
        if self.special_re is not None and any(s in text for s in self.specials):
            return list(chain.from_iterable([x] if x in self.specials else self.words_of(x) for x in self.special_re.split(text) if x))
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.words_of(text)
        return self.latin_words_of(text)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        new = set().union(*split)
        if len(self.table) > self.max_words:
            self.old, self.table = self.table, {}
        new.difference_update(self.table)
        if new:
            again = new & self.old.keys()
            self.table.update((w, self.old[w]) for w in again)
            new -= again
            for s in new & self.specials.keys():
                self.table[s] = struct.pack("<I", self.specials[s])
            self.learn(new - self.specials.keys())
        get = self.table.__getitem__
        out = [b"".join(map(get, words)) for words in split]
        for word in new:
            if len(word) > LONG:
                del self.table[word]
        return out

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


def load(path: str, max_words: int = 300_000) -> TrieBPE:
    """One encoder per file and Python worker."""
    if path not in _LOADED:
        _LOADED[path] = TrieBPE(path, max_words)
    return _LOADED[path]
