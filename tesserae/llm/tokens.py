"""Encoding, decoding and counting tokens of whole texts.

All operators encode each text once, as a whole, with the trie encoder of ``bpe``; the
tokenizer file's path is a parameter and is read in each Python worker.

Cases: null and empty texts have no tokens; any length is encoded whole; repeated rows
are treated alike; columns of other names pass unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import load
from .kit import as_long, bound_batches, enter, flat, pieces


def _picked(docs: DataFrame, doc_id: str, text: str, *more) -> tuple[DataFrame, str]:
    bound_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"), *more), docs.schema[doc_id].dataType.simpleString()


def encode(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id and `ids`, little-endian unsigned 32-bit integers as bytes."""
    picked, kind = _picked(docs, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("tokens")
        bpe = load(tokenizer)
        for batch in batches:
            ids = bpe.encode_batch([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["__id", "ids"])

    return picked.mapInArrow(run, f"__id {kind}, ids binary").withColumnRenamed("__id", doc_id)


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """Adds `text`, the decoded ids; bytes that form no character become U+FFFD. Null ids decode to an empty text."""
    bound_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("tokens")
        bpe = load(tokenizer)
        for batch in batches:
            texts = [bpe.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()).decode("utf-8", "replace") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    rest = encoded.drop("text")
    return rest.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema) + ", text string")


def round_trip(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: n_tokens, and hashes of its ids and of the text they decode to."""
    picked, kind = _picked(docs, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("tokens")
        bpe, sha = load(tokenizer), hashlib.sha256
        for batch in batches:
            ids = bpe.encode_batch([t or "" for t in batch.column(1).to_pylist()])
            decoded = (bpe.decode_bytes(np.frombuffer(x, "<u4").tolist()).decode("utf-8", "replace").encode() for x in ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), as_long([len(x) // 4 for x in ids]), pa.array([sha(x).hexdigest() for x in ids], pa.string()), pa.array([sha(x).hexdigest() for x in decoded], pa.string())],
                ["__id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return picked.mapInArrow(run, f"__id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("__id", doc_id)


def attribute(data: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section, and how many of them end beyond it.

    data: texts back to back; sizes: bytes of each token, over all texts; starts: sorted
    byte positions of sections, none of which crosses a text's edge. A token belongs to
    the section of its first character; one that begins inside a character belongs to
    the section where that character begins.
    """
    ends = np.cumsum(sizes)
    first = ends - sizes
    if len(data):
        lead = np.where((data & 0xC0) != 0x80, np.arange(len(data)), 0)
        first = np.maximum.accumulate(lead)[first] if len(first) else first
    section = np.searchsorted(starts, first, "right") - 1
    limit = np.concatenate((starts[1:], [len(data)]))
    counts = np.bincount(section, minlength=len(starts))
    crossing = np.bincount(section[ends > limit[section]], minlength=len(starts)) if len(section) else np.zeros(len(starts), np.int64)
    return counts, crossing


def section_counts(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line of each document (a line holds the line feed that ends it; an empty text is one empty line):
    id, section from 0, start and end in characters, n_tokens, and n_crossing, those of them that end in a later line.

    The document is encoded once, as a whole; token spans meet line spans in a sorted interval join.
    """
    picked, kind = _picked(docs, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("tokens")
        bpe = load(tokenizer)
        size = np.zeros(max(bpe.token_bytes) + 1, np.int64)
        size[list(bpe.token_bytes)] = [len(t) for t in bpe.token_bytes.values()]
        for batch in batches:
            column = batch.column(1)
            all_data, all_offsets = flat(column)
            for a, b in pieces(all_offsets):
                data, offsets = all_data[all_offsets[a] : all_offsets[b]], all_offsets[a : b + 1] - all_offsets[a]
                ids = np.frombuffer(b"".join(bpe.encode_batch([t or "" for t in column.slice(a, b - a).to_pylist()])), "<u4")
                feeds = np.flatnonzero(data == 10) + 1
                owner = np.searchsorted(offsets, feeds - 1, "right") - 1
                at = np.concatenate((offsets[:-1], feeds))
                doc = np.concatenate((np.arange(b - a), owner))
                order = np.lexsort((at, doc))
                at, doc = at[order], doc[order]
                keep = np.ones(len(at), bool)  # a final line feed opens no further line
                keep[1:] = ~((at[1:] == offsets[doc[1:] + 1]) & (doc[1:] == doc[:-1]))
                at, doc = at[keep], doc[keep]
                counts, crossing = attribute(data, offsets, size[ids], at)
                chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                ends = np.concatenate((at[1:], [len(data)]))
                base = chars[offsets[doc]]
                first = np.searchsorted(doc, np.arange(b - a))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc + a)), as_long(np.arange(len(doc)) - first[doc]), as_long(chars[at] - base), as_long(chars[ends] - base), as_long(counts), as_long(crossing)],
                    ["__id", "section", "start", "end", "n_tokens", "n_crossing"],
                )

    return picked.mapInArrow(run, f"__id {kind}, section bigint, start bigint, end bigint, n_tokens bigint, n_crossing bigint").withColumnRenamed("__id", doc_id)
