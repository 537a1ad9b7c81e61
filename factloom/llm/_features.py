"""Hashed n-gram features over byte buffers, and gathering them over a corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm._text import SpanHasher, chunks, is_space, mix64, text_buffers, words

_ODD = np.uint64(0x9E3779B97F4A7C15)


def byte_ngrams(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, packed bytes) of every n-gram (n <= 8) that stays within a row."""
    m = len(data) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    packed = np.zeros(m, np.uint64)
    for k in range(n):
        packed |= data[k : k + m].astype(np.uint64) << np.uint64(8 * k)
    inside = np.ones(m, bool)
    for cut in offs[1:-1]:
        inside[max(0, cut - n + 1) : cut] = False
    at = np.flatnonzero(inside)
    return at, packed[at]


def bucket(packed: np.ndarray, bits: int, salt: int = 0) -> np.ndarray:
    """Buckets of 64-bit keys by multiplicative hashing."""
    return ((packed + np.uint64(salt)) * _ODD >> np.uint64(64 - bits)).astype(np.int64)


#: Shapes of a word's first, last and inner characters, for shape n-grams.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1] = 1, 2, 3
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 6


def shape_ngrams(data: np.ndarray, offs: np.ndarray, n: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of n-grams of word shapes, repeats of a near word marked."""
    s, e, row = words(data, offs)
    if len(s) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = SpanHasher(data).spans(s, e)
    shape = _CLASS[data[s]].astype(np.uint64) * np.uint64(8) + _CLASS[data[e - 1]]
    same = np.zeros(len(s), np.uint64)
    for back in (1, 2):
        same[back:] |= ((h[back:] == h[:-back]) & (row[back:] == row[:-back])).astype(np.uint64) << np.uint64(back - 1)
    shape = shape * np.uint64(4) + same
    key = np.zeros(len(s) - n + 1, np.uint64)
    for k in range(n):
        key = key * np.uint64(512) + shape[k : len(s) - n + 1 + k]
    ok = row[n - 1 :] == row[: len(s) - n + 1]
    return row[: len(s) - n + 1][ok], key[ok]


def distinct_features(data: np.ndarray, offs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature): byte 4-grams and shape 3-grams hashed to ``bits``."""
    at, packed = byte_ngrams(data, offs, 4)
    row = np.searchsorted(offs, at, "right") - 1
    srow, skey = shape_ngrams(data, offs)
    rows = np.concatenate([row, srow])
    keys = np.concatenate([bucket(packed, bits), bucket(skey, bits, 1 << 40)])
    both = np.unique((rows << bits) | keys)
    return both >> bits, both & ((1 << bits) - 1)


def gather_counts(df: DataFrame, columns: dict[str, Column], count: Callable, names: list[str]) -> DataFrame:
    """(slot, ``names``...): sparse counts of every task summed over the corpus.

    ``count(batch) -> list of dense arrays``, one per name and of equal length,
    is added up within a task, so that a task sends each slot once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[np.ndarray] | None = None
        for batch in batches:
            if batch.num_rows:
                made = count(batch)
                total = made if total is None else [a + b for a, b in zip(total, made)]
        if total is not None:
            slot = np.flatnonzero(np.any([t != 0 for t in total], axis=0))
            for a in range(0, len(slot), 1 << 16):
                part = slot[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(t[part].astype(np.int64)) for t in total)], names=["slot", *names])

    schema = ", ".join(f"{n} bigint" for n in ["slot", *names])
    sparse = df.select(*[c.alias(n) for n, c in columns.items()]).mapInArrow(run, schema)
    return sparse.groupBy("slot").agg(*[F.sum(n).alias(n) for n in names])


def dense(counts: DataFrame, names: list[str], size: int) -> list[np.ndarray]:
    """The gathered counts as arrays of ``size`` (which bounds what is collected)."""
    table = counts.toArrow()
    slot = table.column("slot").to_numpy()
    out = []
    for n in names:
        a = np.zeros(size, np.int64)
        a[slot] = table.column(n).to_numpy()
        out.append(a)
    return out


def per_row_sum(values: np.ndarray, starts: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum, number) per row of values at sorted byte positions ``starts``."""
    edge = np.searchsorted(starts, offs)
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return sums[edge[1:]] - sums[edge[:-1]], np.diff(edge)


def pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of a string array in bounded chunks."""
    data, offs = text_buffers(texts)
    for a, b in chunks(offs):
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]


__all__ = ["byte_ngrams", "bucket", "shape_ngrams", "distinct_features", "gather_counts", "dense", "per_row_sum", "pieces", "is_space", "mix64"]
