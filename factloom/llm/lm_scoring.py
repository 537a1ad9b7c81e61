"""LM scoring: cross-entropy difference of two matched n-gram models.

The target model is estimated from the documents labelled good, the background
model from all documents.  Both have the same order, smoothing and vocabulary
(the 256 bytes, so nothing is unknown).  Byte 5-grams are counted by the n-gram
itself in a table that grows with the corpus; their sums give the exact counts
of 1- and 3-grams and of all contexts.  A token's probability interpolates the
three orders.  A document's score is the mean over its tokens of background
loss minus target loss, in nats; higher means closer to the target.

Up to ``MODEL_BOUND`` distinct 5-grams the counts go to every task.  Beyond
that the counts stay a table, which is joined to the distinct 5-grams of each
group of texts (``GROUP_BYTES``); both ways are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm._features import bucket, pieces
from factloom.llm._text import join_bounded, map_batches, small_enough
from factloom.llm.durable import durable

ORDERS = (1, 3, 5)
MIX = (0.1, 0.35, 0.55)
TARGET_BOUND = 2_000_000
#: Distinct 5-grams whose counts are sent to every task; more are joined.
MODEL_BOUND = 2_000_000
#: Bytes of text that meet their part of a larger model in one group.
GROUP_BYTES = 16 << 20
#: Distinct 5-grams that a task holds before it sends them on.
HELD = 1 << 20
_NONE = np.uint64(1 << 63)


def _grams(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Each token's 5-gram, the token in the lowest byte and those before it above.

    Tokens near a row's start see zero bytes before them.  The low bytes are
    the shorter n-grams, and without the lowest one the contexts.
    """
    n = len(data)
    since = np.arange(n) - np.repeat(offs[:-1], np.diff(offs))
    out = data.astype(np.uint64)
    for k in range(1, max(ORDERS)):
        b = np.zeros(n, np.uint64)
        b[k:] = data[: n - k]
        b[since < k] = 0
        out |= b << np.uint64(8 * k)
    return out


def _summed(keys: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    """Distinct sorted keys and their summed counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return [keys[first], *(np.add.reduceat(c[order], first) if len(first) else np.zeros(0, np.int64) for c in counts)]


def _count(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Distinct 5-grams of a batch, their number in all rows and in good ones."""
    good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
    parts = [[np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]]
    for a, b, data, offs in pieces(batch.column("text")):
        grams, mine = _grams(data, offs), np.repeat(good[a:b], np.diff(offs))
        for side, some in ((False, grams[~mine]), (True, grams[mine])):
            keys, n = np.unique(some, return_counts=True)
            parts.append([keys, n, n if side else np.zeros(len(n), np.int64)])
    return _summed(*map(np.concatenate, zip(*parts)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task, each 5-gram once if no more than ``HELD`` are distinct."""

    def sent(made: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(made[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(m[a : a + (1 << 16)].astype(np.int64)) for m in made], names=["gram", "every", "target"])

    held: list[list[np.ndarray]] = []
    for batch in batches:
        if batch.num_rows:
            held.append(_count(batch))
            if len(held) > 1 and sum(len(h[0]) for h in held[1:]) > len(held[0][0]):
                held = [_summed(*map(np.concatenate, zip(*held)))]
            if len(held[0][0]) > HELD:
                yield from sent(held[0])
                held = held[1:]
    if held:
        yield from sent(_summed(*map(np.concatenate, zip(*held))))


class _Places:
    """Places of distinct keys, found in an open table that keeps the keys."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.at = np.full(1 << self.bits, _NONE), np.zeros(1 << self.bits, np.int32)
        left, slot = np.arange(len(keys)), bucket(keys, self.bits)
        while len(left):
            free = self.keys[slot] == _NONE
            self.keys[slot[free]] = keys[left[free]]
            mine = self.keys[slot] == keys[left]
            self.at[slot[mine]] = left[mine]
            left, slot = left[~mine], (slot[~mine] + 1) & ((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place, -1 where it is not held."""
        slot = bucket(keys, self.bits)
        there = self.keys[slot]
        out = np.where(there == keys, self.at[slot], -1)
        left = np.flatnonzero((there != keys) & (there != _NONE))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.at[slot[hit]]
            on = ~hit & (there != _NONE)
            left, slot = left[on], slot[on]
        return out


class _Gaps:
    """Loss gaps of known 5-grams."""

    def __init__(self, grams: np.ndarray, gaps: np.ndarray) -> None:
        self.places, self.gaps = _Places(grams), gaps

    def loss_gap(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return self.gaps[self.places.find(_grams(data, offs))]


class Models:
    """Both models; ``loss_gap`` gives background loss minus target loss per token."""

    def __init__(self, grams: np.ndarray, every: np.ndarray, target: np.ndarray) -> None:
        grams = grams.astype(np.uint64)
        #: for each order, (keys, counts of background and target) of its n-grams and of its contexts
        self.tables = []
        for order in ORDERS:
            for skip in (0, 1):
                keys, e, t = _summed((grams & np.uint64((1 << 8 * order) - 1)) >> np.uint64(8 * skip), every, target)
                self.tables.append((keys, np.stack([e, t], axis=-1).astype(np.float64)))
        grams = self.tables[-2][0]
        self.known = _Gaps(grams, self._gap(grams))

    def _gap(self, grams: np.ndarray) -> np.ndarray:
        p = np.full((len(grams), 2), 1e-6)
        for k, order in enumerate(ORDERS):
            n, of = (self._of(2 * k + skip, (grams & np.uint64((1 << 8 * order) - 1)) >> np.uint64(8 * skip)) for skip in (0, 1))
            p += MIX[k] * n / np.maximum(of, 1)
        return np.log(p[:, 1]) - np.log(p[:, 0])

    def _of(self, table: int, keys: np.ndarray) -> np.ndarray:
        held, counts = self.tables[table]
        if not len(held):
            return np.zeros((len(keys), 2))
        at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
        return np.where((held[at] == keys)[:, None], counts[at], 0)

    def loss_gap(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        grams = _grams(data, offs)
        at = self.known.places.find(grams)
        new = at < 0
        if not new.any():
            return self.known.gaps[at]
        out = np.zeros(len(grams))
        out[~new], out[new] = self.known.gaps[at[~new]], self._gap(grams[new])
        return out


def fit(docs: DataFrame, good: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """gram, every, target: exact counts of 5-grams in all ``docs`` and in those whose ids ``good`` holds."""
    ids = good.select(F.col(id_col).cast("long").alias("__id")).where("__id IS NOT NULL").distinct().withColumn("__good", F.lit(True))
    marked = join_bounded(docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("text")), ids, "__id", "left", TARGET_BOUND)
    sparse = marked.select("text", F.coalesce("__good", F.lit(False)).alias("good")).mapInArrow(_counted, "gram bigint, every bigint, target bigint")
    return durable(sparse.groupBy("gram").agg(F.sum("every").alias("every"), F.sum("target").alias("target")))


def _scores(ids: pa.Array, texts: pa.Array, models: Models | _Gaps) -> dict:
    n, s = [np.zeros(0, np.int64)], [np.zeros(0)]
    for _, _, data, offs in pieces(texts):
        total = np.concatenate([[0.0], np.cumsum(models.loss_gap(data, offs))])
        n.append(np.diff(offs))
        s.append((total[offs[1:]] - total[offs[:-1]]) / np.maximum(1, np.diff(offs)))
    return {"doc_id": ids, "n_tokens": np.concatenate(n), "score": np.concatenate(s)}


def _gap_table(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """(gram, gap) of the distinct ``grams``, by joins with the counts of each order."""
    p = [F.lit(1e-6), F.lit(1e-6)]
    out = grams
    for k, order in enumerate(ORDERS):
        for skip in (0, 1):
            key: Column = F.shiftrightunsigned(F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1)), 8 * skip)
            sums = counts.groupBy(key.alias(f"k{k}{skip}")).agg(F.sum("every").alias(f"e{k}{skip}"), F.sum("target").alias(f"t{k}{skip}"))
            # up to two bytes are at most 65536 rows
            out = out.withColumn(f"k{k}{skip}", key).join(F.broadcast(sums) if order - skip <= 2 else sums, f"k{k}{skip}", "left")
        for side, c in enumerate("et"):
            p[side] = p[side] + MIX[k] * F.coalesce(f"{c}{k}0", F.lit(0)) / F.greatest(F.coalesce(f"{c}{k}1", F.lit(0)), F.lit(1))
    return out.select("gram", (F.log(p[1]) - F.log(p[0])).alias("gap"))


def _joined_scores(texts: DataFrame, counts: DataFrame, group_bytes: int) -> DataFrame:
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    grouped = texts.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(size // group_bytes + 1)))

    def distinct(t: pa.Table) -> pa.Table:
        held = [np.zeros(0, np.uint64)]
        for _, _, data, offs in pieces(t.column("text")):
            held.append(np.unique(_grams(data, offs)))
        grams = np.unique(np.concatenate(held)).astype(np.int64)
        return pa.table({"part": pa.array(np.full(len(grams), t.column("part")[0].as_py())), "gram": pa.array(grams)})

    def scored(t: pa.Table, model: pa.Table) -> pa.Table:
        gaps = _Gaps(model.column("gram").to_numpy().astype(np.uint64), model.column("gap").to_numpy())
        t = t.combine_chunks()
        return pa.table(_scores(t.column("doc_id"), t.column("text"), gaps))

    needed = durable(grouped.groupBy("part").applyInArrow(distinct, "part bigint, gram bigint"))
    models = needed.join(_gap_table(needed.select("gram").distinct(), counts), "gram")
    return grouped.groupBy("part").cogroup(models.groupBy("part")).applyInArrow(scored, "doc_id bigint, n_tokens bigint, score double")


def score(docs: DataFrame, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = MODEL_BOUND, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_tokens, score of every row.

    Null and empty texts have no token and score 0; repeated rows score alike;
    an empty table gives no rows; without any target all scores are negative.
    """
    columns = {"doc_id": F.col(id_col).cast("long"), "text": F.col(text_col).cast("string")}
    if not small_enough(counts, bound):
        return _joined_scores(docs.select(*[c.alias(n) for n, c in columns.items()]), counts, group_bytes)
    table = counts.toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(Models(*(table.column(n).to_numpy() for n in ("gram", "every", "target"))))
    return map_batches(docs, columns, lambda batch: _scores(batch.column("doc_id"), batch.column("text"), shared.value), "doc_id bigint, n_tokens bigint, score double")
