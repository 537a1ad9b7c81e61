"""Quality classifier: Naive Bayes support vectors.

Features are indicators of hashed n-grams (byte 4-grams and 3-grams of word
shapes).  Each indicator is scaled by its log-count ratio between the classes,
rows are brought to unit length, and a linear hinge-loss model is fitted by
dual coordinate descent; a logistic curve turns margins into scores.

It is fitted on a bounded sample of the labelled rows (``SAMPLE_ROWS``, those
of the least hash of their id); every document is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm._features import distinct_features, pieces
from factloom.llm._text import map_batches

BITS = 18
#: Most labelled rows that the model is fitted on.
SAMPLE_ROWS = 4000
EPOCHS, COST, ALPHA, SEED = 12, 1.0, 1.0, 42


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32(id as text) mod ``modulus``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % modulus


@dataclass
class Model:
    weight: np.ndarray
    #: squared log-count ratios, for rows' lengths
    square: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        row, f = distinct_features(data, offs, BITS)
        n = len(offs) - 1
        total = np.bincount(row, self.weight[f], n)
        length = np.sqrt(np.bincount(row, self.square[f], n))
        margin = total / np.maximum(length, 1e-9) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def fit(rows: list[tuple[np.ndarray, int]]) -> Model:
    """A model from (distinct features, label 0 or 1); constant without both classes."""
    size = 1 << BITS
    y = np.array([1 if label else -1 for _, label in rows], np.float64)
    rate = float((y > 0).mean()) if len(y) else 0.5
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(size), np.zeros(size), 0.0, 0.0, float(np.log((rate + 0.01) / (1.01 - rate))))
    p, q = np.full(size, ALPHA), np.full(size, ALPHA)
    for (f, _), side in zip(rows, y):
        (p if side > 0 else q)[f] += 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    x = [(f, ratio[f] / max(np.sqrt((ratio[f] ** 2).sum()), 1e-9)) for f, _ in rows]
    cost = np.where(y > 0, COST * 0.5 / max(rate, 1e-3), COST * 0.5 / max(1 - rate, 1e-3))
    w, b, alpha, rng = np.zeros(size), 0.0, np.zeros(len(y)), np.random.default_rng(SEED)
    for _ in range(EPOCHS):  # each row has length 1, and 1 more for the bias
        for i in rng.permutation(len(y)):
            f, v = x[i]
            g = y[i] * (w[f] @ v + b) - 1
            new = min(max(alpha[i] - g / 2, 0.0), cost[i])
            if new != alpha[i]:
                d = (new - alpha[i]) * y[i]
                w[f] += d * v
                b += d
                alpha[i] = new
    m = np.array([w[f] @ v + b for f, v in x])
    slope, shift, t = 1.0, 0.0, (y > 0).astype(float)
    prior = t * (t.sum() + 1) / (t.sum() + 2) + (1 - t) / ((1 - t).sum() + 2)
    for _ in range(50):  # Platt's curve by Newton steps
        s = 1 / (1 + np.exp(-np.clip(slope * m + shift, -30, 30)))
        g1, g0, h = ((s - prior) * m).sum(), (s - prior).sum(), s * (1 - s) + 1e-9
        a11, a10, a00 = (h * m * m).sum() + 1e-3, (h * m).sum(), h.sum() + 1e-3
        det = a11 * a00 - a10 * a10
        slope, shift = slope - (a00 * g1 - a10 * g0) / det, shift - (a11 * g0 - a10 * g1) / det
    return Model(w * ratio, ratio**2, b, float(slope), float(shift))


def sampled(labels: DataFrame, label_col: str, id_col: str, modulus: int, held: int, rows: int) -> DataFrame:
    """(__id, __label) of at most ``rows`` training labels, the least by a hash of the id.

    Rows with null id or label are left out; an id with several labels counts
    once, by the greatest.
    """
    mine = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__label"))
    mine = mine.where("__id IS NOT NULL AND __label IS NOT NULL").where(remainder(F.col("__id"), modulus) != held)
    return mine.groupBy("__id").agg(F.max("__label").alias("__label")).orderBy(F.xxhash64("__id"), "__id").limit(rows)


def training_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text, label) of the sampled labels, whose number bounds what is broadcast."""
    some = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("text"))
    return some.join(F.broadcast(labels), "__id").select("text", F.col("__label").alias("label"))


def train(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> Model:
    def features(batch: pa.RecordBatch) -> dict:
        out: list[np.ndarray] = []
        for _, _, data, offs in pieces(batch.column("text")):
            row, f = distinct_features(data, offs, BITS)
            out += np.split(f.astype(np.int32), np.searchsorted(row, np.arange(1, len(offs) - 1)))
        return {"label": batch.column("label"), "features": out}

    texts = training_texts(docs, sampled(labels, label_col, id_col, modulus, held, rows), id_col, text_col)
    table = map_batches(texts, {"text": F.col("text"), "label": F.col("label")}, features, "label int, features array<int>").toArrow()
    made = [(f.values.to_numpy(), y) for f, y in zip(table.column("features"), table.column("label").to_pylist())]
    return fit(sorted(made, key=lambda r: (r[1], len(r[0]), r[0].tobytes())))  # whatever order they came in


def score(docs: DataFrame, model: Model, modulus: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null and empty texts have no feature and get the score of the bias alone;
    a null id is not held out; repeated rows are scored alike; an empty table
    gives no rows.  Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fn(batch: pa.RecordBatch) -> dict:
        parts = [shared.value.scores(d, o) for _, _, d, o in pieces(batch.column("text"))]
        s = np.concatenate(parts)
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": s, "predicted": (s >= 0.5).astype(np.int32)}

    columns = {
        "doc_id": F.col(id_col).cast("long"),
        "held_out": F.coalesce(remainder(F.col(id_col), modulus) == held, F.lit(False)),
        "text": F.col(text_col).cast("string"),
    }
    return map_batches(docs, columns, fn, "doc_id bigint, held_out boolean, score double, predicted int")
