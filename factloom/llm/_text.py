"""Shared vectorised text primitives for the Arrow-batch operators.

All operators of this package read texts as UTF-8 byte buffers straight from
Arrow and work on numpy arrays over those bytes, so that a Python worker never
loops over characters.  Texts are handled in chunks of bounded bytes (whole
documents only; a longer document is a chunk of its own).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_BYTES = 1 << 19
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.type != pa.large_string():
        arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offs = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about ``limit`` bytes; a long row stands alone."""
    n, a = len(offs) - 1, 0
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads the bits of a uint64 array."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 2 * CHUNK_BYTES)
            up, down = np.full(m, _P, np.uint64), np.full(m, _PINV, np.uint64)
            up[0] = down[0] = 1
            up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
            if m > 4 * CHUNK_BYTES:  # not kept: only one very long text needs it
                return up, down
            self.up, self.down = up, down
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd multiplier, and their inverses, mod 2**64."""
    return _POWERS.get(n)


class SpanHasher:
    """64-bit hashes of byte ranges in constant time each."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def spans(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix64((self.sums[e] - self.sums[s]) * self.down[s] + (e - s).astype(np.uint64))


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that do not cross a row: (start, end, row)."""
    n = len(mask)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    before = np.empty(n, bool)
    before[0], before[1:] = False, mask[:-1]
    cut = offs[(offs > 0) & (offs < n)]
    before[cut] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, mask[1:]
    after[cut - 1] = False
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as (start, end, row)."""
    return runs(~is_space(data), offs)


def map_batches(df: DataFrame, columns: dict[str, Column], fn: Callable, schema: str) -> DataFrame:
    """mapInArrow over chosen columns only; ``fn(batch) -> dict of arrays`` (or None)."""
    fields = T._parse_datatype_string(schema)
    names = [f.name for f in fields]
    kinds = [_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            out = fn(batch)
            if out is not None:
                yield pa.RecordBatch.from_arrays([_as_array(out[n], k) for n, k in zip(names, kinds)], names=names)

    return df.select(*[c.alias(n) for n, c in columns.items()]).mapInArrow(run, schema)


def _as_array(x, kind: pa.DataType) -> pa.Array:
    if isinstance(x, pa.Array):
        return x if x.type == kind else x.cast(kind)
    return pa.array(x, kind)


def _arrow_type(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(_arrow_type(t.elementType))
    return {
        "string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(),
        "float": pa.float32(), "boolean": pa.bool_(), "binary": pa.binary(),
    }[t.simpleString()]


def append_columns(df: DataFrame, text_col: str, fn: Callable, schema: str) -> DataFrame:
    """All columns of ``df`` with those of ``fn(text array) -> dict`` after them.

    A new column whose name is taken replaces the old one.  ``fn`` may return
    the text column itself, which replaces it.
    """
    added = T._parse_datatype_string(schema)
    new = {f.name: f.dataType for f in added}
    out = T.StructType([T.StructField(f.name, new.get(f.name, f.dataType)) for f in df.schema] + [T.StructField(n, k) for n, k in new.items() if n not in df.columns])
    kept = [c for c in df.columns if c not in new or c == text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            made = fn(batch.column(text_col))
            cols = [_as_array(made[f.name], _arrow_type(f.dataType)) if f.name in new else batch.column(f.name) for f in out]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in out])

    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, out)


def plain_text(name: str = "text") -> Column:
    """The text column as a non-null string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def small_enough(df: DataFrame, bound: int) -> bool:
    """Whether ``df`` has at most ``bound`` rows, looking at no more than that."""
    return df.limit(bound + 1).count() <= bound


def join_bounded(left: DataFrame, right: DataFrame, on: str, how: str, bound: int) -> DataFrame:
    """Broadcast ``right`` when a count proves it small, else an ordinary join."""
    return left.join(F.broadcast(right) if small_enough(right, bound) else right, on, how)
