"""Quality rules: n-gram log-likelihood ratio of trusted target to raw corpus.

Byte n-grams are hashed into a fixed number of buckets.  One multinomial is
estimated from all documents labelled good, another from all documents; the
target is smoothed towards the raw one.  A document's score is the mean log
ratio of its n-grams, so it does not depend on length, and it is kept when the
score reaches a threshold: no sampling is involved, equal texts get equal
verdicts.  Documents that fail the base rules are never kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm._features import bucket, byte_ngrams, dense, gather_counts, per_row_sum, pieces
from factloom.llm._text import SpanHasher, append_columns, is_space, join_bounded, map_batches, mix64, runs, words

ORDER, BITS = 4, 18
#: Weight of the raw distribution in the smoothed target.
PRIOR = 0.02
#: Least mean log ratio (nats per n-gram) of a document that is kept.
THRESHOLD = -0.35
#: Labelled ids up to which the target set is broadcast; beyond, it is shuffled.
TARGET_BOUND = 2_000_000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _repeats(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How often each key occurs within its row."""
    if not len(key):
        return np.zeros(0, np.int64)
    _, inverse, n = np.unique(mix64(key + mix64(row.astype(np.uint64))), return_inverse=True, return_counts=True)
    return n[inverse]


def base_rules(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of the base rules for each row of a byte buffer."""
    n = len(offs) - 1
    s, e, row = words(data, offs)
    space = is_space(data)
    letters = np.concatenate([[0], np.cumsum(~space & ((data & 0xC0) != 0x80))])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    hasher = SpanHasher(data)
    marked = np.zeros(len(s), bool)
    if len(s) >= 3:
        h = hasher.spans(s, e)
        tri = mix64(h[:-2] * np.uint64(3) + mix64(h[1:-1] * np.uint64(5) + mix64(h[2:])))
        ok = np.flatnonzero(row[2:] == row[:-2])
        again = ok[_repeats(tri[ok], row[ok]) > 1]
        for k in range(3):
            marked[again + k] = True
    ls, le, lrow = runs(data != 10, offs)
    solid = np.concatenate([[0], np.cumsum(~space)])
    full = solid[le] > solid[ls]
    ls, le, lrow = ls[full], le[full], lrow[full]
    if len(ls):
        key = mix64(hasher.spans(ls, le) + mix64(lrow.astype(np.uint64)))
        _, first = np.unique(key, return_index=True)
        distinct = np.bincount(lrow[first], minlength=n)
    else:
        distinct = np.zeros(n, np.int64)
    n_words = np.bincount(row, minlength=n)
    n_repeat = np.bincount(row[marked], minlength=n)
    return {
        "n_words": n_words,
        "word_chars": letters[offs[1:]] - letters[offs[:-1]],
        "n_symbols": symbols[offs[1:]] - symbols[offs[:-1]],
        "n_dup_lines": np.bincount(lrow, minlength=n) - distinct,
        "n_repeat_words": n_repeat,
        "base_failed": (n_words < 50) | (100 * n_repeat > 50 * n_words),
    }


def _counts(batch: pa.RecordBatch) -> list[np.ndarray]:
    raw, target = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
    for a, _, data, offs in pieces(batch.column("text")):
        at, packed = byte_ngrams(data, offs, ORDER)
        slot = bucket(packed, BITS)
        raw += np.bincount(slot, minlength=1 << BITS)
        mine = good[a:][np.searchsorted(offs, at, "right") - 1]
        target += np.bincount(slot[mine], minlength=1 << BITS)
    return [raw, target]


def fit_ratio(docs: DataFrame, good: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Log ratio of every bucket from all ``docs``; ``good`` has the target's ids."""
    ids = good.select(F.col(id_col).cast("long").alias("__id")).where("__id IS NOT NULL").distinct().withColumn("__good", F.lit(True))
    marked = join_bounded(docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("text")), ids, "__id", "left", TARGET_BOUND)
    columns = {"text": F.col("text"), "good": F.coalesce("__good", F.lit(False))}
    raw, target = dense(gather_counts(marked, columns, _counts, ["raw", "target"]), ["raw", "target"], 1 << BITS)
    p = (raw + 1.0) / (raw.sum() + len(raw))
    q = (1 - PRIOR) * target / max(1, target.sum()) + PRIOR * p
    return np.log(q / p).astype(np.float32)


def _scores(data: np.ndarray, offs: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    at, packed = byte_ngrams(data, offs, ORDER)
    total, n = per_row_sum(ratio[bucket(packed, BITS)], at, offs)
    return total / np.maximum(1, n)


def judge(docs: DataFrame, good: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr.

    ``good`` holds the ids of the trusted target.  Null and empty texts have no
    words and fail; texts without an n-gram score 0.  Repeated rows are judged
    alike; an empty table gives no rows; an empty target keeps nothing's ratio
    above the prior, so all ratios are equal and the base rules decide.
    """
    ratio = fit_ratio(docs, good, id_col, text_col)
    if not np.isfinite(ratio).all() or np.ptp(ratio) == 0:
        ratio = np.zeros_like(ratio)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def fn(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {}
        for _, _, data, offs in pieces(batch.column("text")):
            for k, v in (base_rules(data, offs) | {"llr": _scores(data, offs, shared.value)}).items():
                out.setdefault(k, []).append(v)
        made = {k: np.concatenate(v) for k, v in out.items()}
        return {"doc_id": batch.column("doc_id"), "kept": ~made["base_failed"] & (made["llr"] >= threshold), **made}

    columns = {"doc_id": F.col(id_col).cast("long"), "text": F.col(text_col).cast("string")}
    schema = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, llr double"
    return map_batches(docs, columns, fn, schema)


def keep_good(docs: DataFrame, good: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that pass both the base rules and the ratio, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_ratio(docs, good, id_col, text_col))

    def fn(texts: pa.Array) -> dict:
        kept = [~base_rules(d, o)["base_failed"] & (_scores(d, o, shared.value) >= threshold) for _, _, d, o in pieces(texts)]
        return {"__kept": np.concatenate(kept)}

    return append_columns(docs, text_col, fn, "__kept boolean").where("__kept").drop("__kept")
