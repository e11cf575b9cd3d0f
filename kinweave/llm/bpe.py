"""Encoding of a corpus with a public byte-level BPE vocabulary, vectorised over words.

Texts are split by the vocabulary's pattern; each distinct word of a batch is encoded once. Words are grouped by length into padded numpy
matrices of byte ids. In every round each row merges the occurrences of its minimum-rank pair, from the left; pair ranks come from a sorted
table of hashed pairs, looked up for whole matrices; finished rows are taken out and the others compacted. Merging all non-overlapping
occurrences of the minimum pair in one round equals merging them one by one from the left, because a pair made by a merge always ranks after it.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pattern that splits text before the merges; a fixed value of the public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Cells of a padded matrix; bounds the memory of a round.
MATRIX_CELLS = 2_000_000
#: Words kept between batches of a task; only a cache, cleared when full.
CACHE_WORDS = 200_000
NONE = np.int32(np.iinfo(np.int32).max)


class Vocabulary:
    """Ranks of a tiktoken file: single bytes to ids, and pairs of ids to the id (= rank) of their merge."""

    def __init__(self, data: bytes) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.size = max(ranks.values()) + 1
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            # every split of a token into two tokens is a pair that merges to it
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        pair = np.array(left, dtype=np.int64) * self.size + np.array(right, dtype=np.int64)
        bits = 1
        while (1 << bits) < 4 * len(pair):
            bits += 1
        self.bits = bits
        # Hash table of pairs in open addressing, filled in rounds: whoever loses a slot moves on by one.
        self.slots = np.full((1 << bits) + 256, -1, dtype=np.int64)
        self.ranks = np.full((1 << bits) + 256, NONE, dtype=np.int32)
        at, ids, steps = self.hash(pair), np.arange(len(pair)), 0
        while len(ids):
            free = self.slots[at] < 0
            winners = np.unique(at[free], return_index=True)[1]
            w = np.flatnonzero(free)[winners]
            self.slots[at[w]], self.ranks[at[w]] = pair[ids[w]], np.array(merged, dtype=np.int32)[ids[w]]
            stay = np.ones(len(ids), dtype=bool)
            stay[w] = False
            ids, at, steps = ids[stay], at[stay] + 1, steps + 1
        self.steps = steps

    def hash(self, pair: np.ndarray) -> np.ndarray:
        return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it doesn't merge; ids below 0 are padding."""
        pair = left.astype(np.int64) * self.size + right
        at = self.hash(pair)
        out = np.full(pair.shape, NONE, dtype=np.int32)
        todo = (left >= 0) & (right >= 0)
        found = self.slots[at] == pair
        hit = todo & found
        out[hit] = self.ranks[at[hit]]
        rest = np.flatnonzero((todo & ~found & (self.slots[at] >= 0)).ravel())
        p, a, flat = pair.ravel()[rest], at.ravel()[rest], out.reshape(-1)
        for _ in range(self.steps):
            if not len(rest):
                break
            a = a + 1
            s = self.slots[a]
            match = s == p
            flat[rest[match]] = self.ranks[a[match]]
            go = ~match & (s >= 0)
            rest, p, a = rest[go], p[go], a[go]
        return out


def merge_rows(ids: np.ndarray, vocab: Vocabulary) -> list[np.ndarray]:
    """ids: matrix of byte ids padded with -1 on the right. The ids of each row after all merges."""
    n, out = len(ids), [None] * len(ids)
    row_of = np.arange(n)
    length = (ids >= 0).sum(axis=1)
    while len(row_of):
        if ids.shape[1] < 2:
            for i, r in enumerate(row_of):
                out[r] = ids[i, : length[i]]
            break
        ranks = vocab.pair_ranks(ids[:, :-1], ids[:, 1:])
        least = ranks.min(axis=1)
        done = least == NONE
        if done.any():
            for i in np.flatnonzero(done):
                out[row_of[i]] = ids[i, : length[i]].copy()
            keep = ~done
            ids, ranks, least, row_of, length = ids[keep], ranks[keep], least[keep], row_of[keep], length[keep]
            if not len(row_of):
                break
        at = ranks == least[:, None]
        # In a run of overlapping occurrences every second one merges, from the left.
        place = np.arange(at.shape[1], dtype=np.int32)[None, :]
        last_miss = np.maximum.accumulate(np.where(at, np.int32(-1), place), axis=1)
        at &= (place - last_miss) % 2 == 1
        merged = np.pad(at, ((0, 0), (0, 1)))
        gone = np.pad(at, ((0, 0), (1, 0)))
        ids = np.where(merged, least[:, None], ids)
        alive = ~gone & (ids >= 0)
        length = alive.sum(axis=1)
        # Compaction: the ids left move to the front of their rows.
        fresh = np.full((len(ids), length.max()), -1, dtype=np.int32)
        fresh[np.arange(fresh.shape[1])[None, :] < length[:, None]] = ids[alive]
        ids = fresh
    return out


class Encoder:
    """Encodes texts; keeps the words of earlier batches in a bounded cache."""

    def __init__(self, data: bytes, pattern: str = PATTERN) -> None:
        import regex

        self.vocab, self.split = Vocabulary(data), regex.compile(pattern).findall
        self.known: dict[str, np.ndarray] = {}

    def learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > CACHE_WORDS:
            self.known = {}
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.array([len(b) for b in raw])
        # Buckets by length: the powers of the square root of 2, so padding stays under a third.
        buckets = np.ceil(2 * np.log2(np.maximum(sizes, 1))).astype(int)
        for b in np.unique(buckets):
            members = np.flatnonzero(buckets == b)
            width = sizes[members].max()
            step = max(1, MATRIX_CELLS // width)
            for s in range(0, len(members), step):
                part = members[s : s + step]
                ids = np.full((len(part), width), -1, dtype=np.int32)
                ids[np.arange(width)[None, :] < sizes[part][:, None]] = self.vocab.byte_ids[np.frombuffer(b"".join(raw[i] for i in part), dtype=np.uint8)]
                for i, r in zip(part, merge_rows(ids, self.vocab)):
                    self.known[words[i]] = r

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self.split(t) if t else [] for t in texts]
        need = {w for ws in split for w in ws} - self.known.keys()
        if len(self.known) + len(need) > CACHE_WORDS:
            need = {w for ws in split for w in ws}
        if need:
            self.learn(sorted(need))
        empty = np.zeros(0, dtype=np.int32)
        return [np.concatenate([self.known[w] for w in ws]) if ws else empty for ws in split]


_encoders: dict[bytes, Encoder] = {}


def encoder_of(data: bytes) -> Encoder:
    """One encoder per vocabulary. A plain dictionary: decorated functions would be sent to workers by name only."""
    if data not in _encoders:
        _encoders[data] = Encoder(data)
    return _encoders[data]


def decode_text(raw: bytes | None) -> str | None:
    return None if raw is None else bytes(raw).decode("utf-8", "replace")


def vocabulary_bytes(path: str | None = None) -> bytes:
    with open(path or os.path.join(TOKENIZERS, VOCABULARY), "rb") as f:
        return f.read()


def batches_of(batch: pa.RecordBatch, text: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``most`` bytes of text (or one row), so very long texts don't pile up."""
    sizes = np.array([0 if v is None else len(v) for v in batch.column(text).to_pylist()])
    start, total = 0, 0
    for i, s in enumerate(sizes):
        if i > start and total + s > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += s
    if start < len(sizes):
        yield batch.slice(start)


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, lengths_only: bool = False, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, ids) or, with ``lengths_only``, (doc_id, n_tokens), then the columns ``carry``: one row per row of ``docs``.

    Null and empty texts give an empty list (0 tokens). Strings of special tokens are ordinary text. Blanks and control characters are
    encoded like any others; bytes that are no UTF-8 are taken as U+FFFD. Repeated rows are encoded like others. The vocabulary (under 1 MB)
    is read on the driver at ``path`` and broadcast. Nothing is shuffled. Other columns of ``docs`` are not read.
    """
    spark, carry = docs.sparkSession, carry or []
    data = spark.sparkContext.broadcast(vocabulary_bytes(path))
    out = "n_tokens" if lengths_only else "ids"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(data.value)
        for whole in batches:
            for batch in batches_of(whole, 1):
                ids = enc.encode([decode_text(v) for v in batch.column(1).to_pylist()])
                sizes = np.array([len(x) for x in ids], dtype=np.int32)
                made = pa.array(sizes)
                if not lengths_only:
                    flat = np.concatenate(ids) if len(ids) else np.zeros(0, dtype=np.int32)
                    made = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), made, *batch.columns[2:]], names=["doc_id", out, *carry])

    kinds = {c: docs.schema[c].dataType.simpleString() for c in [key, *carry]}
    schema = f"doc_id {kinds[key]}, {out} " + ("int" if lengths_only else "array<int>") + "".join(f", `{c}` {kinds[c]}" for c in carry)
    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("text"), *carry).mapInArrow(run, schema)
