"""Encoding texts with a public byte-level BPE vocabulary.

Method: the ranks of all adjacent pairs of a piece are the leaves of a segment tree whose inner nodes hold the smaller child;
the root is the leftmost pair of lowest rank. Merging it changes three leaves, each in a logarithmic number of steps, until the
root holds no mergeable pair. A piece of n bytes costs O(n log n), also where a text is one very long piece.

The corpus is encoded by one pass of Arrow batches without a shuffle; each worker remembers the ids of short pieces, so the tree
runs once for a word and not once for each of its places.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import spread

#: Vocabulary as lines of base64 token and rank.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces of at most this many characters are remembered, up to so many per worker (about 40 MB).
REMEMBERED_CHARS, REMEMBERED_PIECES = 40, 100_000
#: Token ids of one output batch at most, besides those of its last text.
_BATCH_IDS = 2_000_000


def load_ranks(vocabulary: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines()) if token}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    leaves = 1 << (n - 1).bit_length()
    # A leaf holds rank * leaves + place, so that the minimum is the leftmost of the lowest rank.
    none = 1 << 62
    tree = [none] * (2 * leaves)
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[leaves + i] = r * leaves + i
    for i in range(leaves - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    end = list(range(1, n + 1))  # of the symbol that starts at i
    before = list(range(-1, n))  # start of the symbol left of the one that starts at i
    while (best := tree[1]) != none:
        i = best & (leaves - 1)
        j = end[i]  # the right symbol, which goes into the left one
        stop = end[i] = end[j]
        changed = [(j, none)]
        if stop < n:
            before[stop] = i
            r = get(piece[i : end[stop]])
            changed.append((i, none if r is None else r * leaves + i))
        else:
            changed.append((i, none))
        if (p := before[i]) >= 0:
            r = get(piece[p:stop])
            changed.append((p, none if r is None else r * leaves + p))
        for at, value in changed:
            at += leaves
            if tree[at] == value:
                continue
            tree[at] = value
            while at > 1:
                a, b = tree[at], tree[at ^ 1]
                at >>= 1
                least = a if a < b else b
                if tree[at] == least:
                    break
                tree[at] = least
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Encoder:
    """Text to ids, without special tokens: strings that spell one are ordinary text."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        import regex

        self._ranks = load_ranks(vocabulary)
        self._split = regex.compile(pattern).findall
        self._known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text``; none for an empty or null text."""
        ids: list[int] = []
        if not text:
            return ids
        known, extend = self._known, ids.extend
        for piece in self._split(text):
            found = known.get(piece)
            if found is None:
                found = merge(piece.encode(), self._ranks)
                if len(piece) <= REMEMBERED_CHARS and len(known) < REMEMBERED_PIECES:
                    known[piece] = found
            extend(found)
        return ids

    def count(self, text: str | None) -> int:
        return len(self.encode(text))


_ENCODERS: dict[tuple[int, int], Encoder] = {}


def _encoder(vocabulary: bytes) -> Encoder:
    """One encoder per worker process and vocabulary."""
    key = (len(vocabulary), hash(vocabulary))
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _shipped(spark: SparkSession, path: str):
    """The vocabulary, read by the driver and sent to each executor once: a file of fixed size, under 1 MB."""
    return spark.sparkContext.broadcast(read_vocabulary(path))


def encode_documents(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id bigint, ids array<int>)`` of every row, in no order.

    An empty and a null text have an empty list. Whole texts are encoded, however long. Rows with null or repeated doc_id
    are kept as they are. Other columns, of any name, aren't read.
    """
    shipped = _shipped(documents.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shipped.value).encode

        def batch(rows: list, ids: list, ends: list) -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), lists], names=["doc_id", "ids"])

        rows, ids, ends, total = [], [], [0], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                found = encode(text.as_py())
                rows.append(doc_id)
                ids.append(np.array(found, np.int32))
                total += len(found)
                ends.append(total)
                if total >= _BATCH_IDS:
                    yield batch(rows, ids, ends)
                    rows, ids, ends, total = [], [], [0], 0
        if rows:
            yield batch(rows, ids, ends)

    return spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id bigint, source string, tokens bigint)`` of every row; 0 tokens for an empty and a null text."""
    shipped = _shipped(documents.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _encoder(shipped.value).count
        for b in batches:
            n = pa.array([count(text.as_py()) for text in b.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], names=["doc_id", "source", "tokens"])

    return spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text")).mapInArrow(run, "doc_id bigint, source string, tokens bigint")
