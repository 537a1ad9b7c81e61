"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is split into three segments of 22, 21 and 21 bits, each
read as a word of the perfect binary Golay code of length 23.  A segment emits
the indices of all codewords within four bits of it (one or six); two words at
most two bits apart always share such a codeword, for the codeword nearest to a
word between them lies within four bits of both.  At most two differing bits
over three segments leave one segment equal and the segment after it at most
one bit apart (for some cyclic choice), so a key is a segment's exact value
with a codeword index of the next.  Keys are joined, and every candidate pair
verified by its Hamming distance, so that no link is missed or wrong.

Documents of equal fingerprint form a class first, so copies are counted and
never paired; links and components are found between classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm._text import map_batches
from factloom.llm.components import connected_components
from factloom.llm.durable import durable

MAX_BITS = 2
SHINGLE_WORDS = 3
SEED = 42
_SHIFTS, _WIDTHS = (42, 21, 0), (22, 21, 21)
_GENERATOR = 0b101011100011  # of the Golay code, degree 11


def _remainder(x: np.ndarray) -> np.ndarray:
    """Syndromes: remainders of 23-bit words by the generator polynomial."""
    x = x.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        x ^= ((x >> bit) & 1) * (_GENERATOR << (bit - 11))
    return x


def _patterns() -> np.ndarray:
    """[2048, 6]: per syndrome the error patterns of up to four bits, padded by the first."""
    from itertools import combinations

    rows: list[list[int]] = [[] for _ in range(2048)]
    errors = np.array([sum(1 << b for b in c) for w in range(5) for c in combinations(range(23), w)])
    for e, s in zip(errors.tolist(), _remainder(errors).tolist()):
        rows[s].append(e)
    # a syndrome of at most two errors has no pattern of four; one of three has five
    return np.array([(r + r[:1] * 6)[:6] for r in rows])


_TABLE: np.ndarray | None = None


def codeword_indices(segment: np.ndarray) -> np.ndarray:
    """[n, 6] indices (12 message bits) of the codewords within four bits of 23-bit words."""
    global _TABLE
    if _TABLE is None:
        _TABLE = _patterns()
    return (segment[:, None] ^ _TABLE[_remainder(segment)]) >> 11


def keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all distinct search keys of unsigned fingerprints."""
    segs = [((fingerprints >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in zip(_SHIFTS, _WIDTHS)]
    near = [codeword_indices(s) for s in segs]
    all_keys = np.concatenate([(np.int64(k) << 40) | (segs[k][:, None] << 12) | near[(k + 1) % 3] for k in range(3)], axis=1)
    all_keys.sort(axis=1)
    fresh = np.ones(all_keys.shape, bool)
    fresh[:, 1:] = all_keys[:, 1:] != all_keys[:, :-1]
    return np.nonzero(fresh)[0], all_keys[fresh]


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """The SimHash of one text; 0 without words or for null."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    k = min(shingle, len(parts))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(parts) - k + 1]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends[k - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, fp): h a hash of the text, fp the fingerprint's bits as a signed long."""

    def fn(batch: pa.RecordBatch) -> dict:
        fp = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
        return {"doc_id": batch.column("doc_id"), "h": batch.column("h"), "fp": fp.view(np.int64)}

    text = F.col(text_col).cast("string")
    columns = {"doc_id": F.col(id_col).cast("long"), "h": F.xxhash64(text), "text": text}
    return map_batches(df, columns, fn, "doc_id bigint, h bigint, fp bigint")


def class_links(classes: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of distinct ``fp`` at most MAX_BITS apart."""

    def fn(batch: pa.RecordBatch) -> dict:
        fp = batch.column("fp").to_numpy(zero_copy_only=False)
        row, key = keys(fp.view(np.uint64))
        return {"fp": fp[row], "key": key}

    keyed = map_batches(classes, {"fp": F.col("fp")}, fn, "fp bigint, key bigint")
    a, b = keyed.withColumnRenamed("fp", "a"), keyed.withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    return a.join(b, "key").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def _grouped(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h, fp, n_near, first): first is the least (no id, id, h) of the component."""
    docs = durable(fingerprints(df, id_col, text_col))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "h"))
    classes = docs.groupBy("fp").agg(F.count("*").alias("n"), first.alias("first"))
    links = durable(class_links(classes.select("fp")))
    roots = connected_components(links).withColumnRenamed("node", "fp")
    sizes = classes.select(F.col("fp").alias("other"), F.col("n").alias("m"))
    both = links.union(links.select("b", "a")).toDF("fp", "other")
    linked = both.join(sizes, "other").groupBy("fp").agg(F.sum("m").alias("around"))
    joined = classes.join(linked, "fp", "left").join(roots, "fp", "left")
    top = joined.where("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("top"))
    about = joined.join(top, "root", "left").select(
        "fp",
        (F.col("n") - 1 + F.coalesce("around", F.lit(0))).alias("n_near"),
        F.coalesce("top", "first").alias("first"),
    )
    return docs.join(about, "fp")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, n_near, component_id of every row.

    Null, empty and blank texts have fingerprint zero and link like others;
    repeated rows each keep their row and count as each other's neighbours; a
    null id stays null and names a component only if all its ids are null.
    An empty table gives no rows.  Other columns of ``df`` are not read.
    """
    return _grouped(df, id_col, text_col).select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("n_near").cast("long").alias("n_near"),
        F.col("first.doc_id").alias("component_id"),
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one document of each component: that of the smallest id.

    Ties in the id go to the smaller hash of the text, and of equal rows one
    stays; rows without an id come after all others.  All columns stay.
    """
    found = _grouped(df, id_col, text_col)
    is_first = (F.col("first.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("first.h") == F.col("h"))
    marked = durable(found.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), is_first.alias("__first")))
    gone = marked.where("NOT __first").select("__id", "__h").distinct()
    text = F.col(text_col).cast("string")
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__h"))
    kept = df.join(gone, same, "left_anti")
    repeated = marked.where("__first").groupBy("__id", "__h").count().where("count > 1")
    return kept.dropDuplicates([id_col, text_col]) if repeated.limit(1).count() else kept
