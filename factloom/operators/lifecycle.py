"""Add, update, delete or pass over candidate facts, with pluggable models."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

LOW, HIGH = 0.30, 0.85


class Decider(Protocol):
    """Says what becomes of a candidate whose nearest fact is very like it."""

    def __call__(self, candidate: str, nearest: str) -> str: ...


class Embedder(Protocol):
    """Turns texts into vectors."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


def stub_decider(candidate: str, nearest: str) -> str:
    """An offline stub, no model: equal texts are passed over, longer ones update, others are passed over."""
    return "UPDATE" if len(candidate) > len(nearest) and nearest.lower() in candidate.lower() else "NOOP"


def hashing_embedder(texts: list[str], width: int = 64) -> np.ndarray:
    """An offline stub, no model: signed hashed words, scaled to length 1."""
    import zlib

    out = np.zeros((len(texts), width))
    for k, t in enumerate(texts):
        for w in (t or "").lower().split():
            h = zlib.crc32(w.encode())
            out[k, h % width] += 1 if h & 0x10000 else -1
    n = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, n, out=np.zeros_like(out), where=n > 0)


def embed(df: DataFrame, text_col: str, out: str = "vector", embedder: Embedder = hashing_embedder) -> DataFrame:
    """``df`` with a vector of each text, in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f[out] = list(embedder(f[text_col].fillna("").tolist()))
            yield f

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out)
    return df.select(*[f"`{c}`" for c in df.columns if c != out]).mapInPandas(run, f"{schema}, {out} array<double>")


def audn(candidates: DataFrame, key: str, order: str, text: str, decider: Decider = stub_decider, embedder: Embedder = hashing_embedder, mode: str = "sequential", cap: int = 20) -> DataFrame:
    """(key, order, action, target, confidence): each candidate sees those its key stored before it.

    The fold is sequential within a key and parallel across keys, so a key's
    candidates are one task's (a subject's facts of one run).  ``mode='batch'``
    keeps the other variant: at most ``cap`` candidates a key, and a delete is
    stored like an addition.
    """
    kinds = dict(candidates.dtypes)

    def fold(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(order)
        if mode == "batch":
            t = t.head(cap)
        vectors = embedder(t[text].fillna("").tolist())
        kept: list[int] = []
        rows = []
        for k, (o, candidate) in enumerate(zip(t[order], t[text])):
            s = vectors[kept] @ vectors[k] if kept else np.zeros(0)
            best = int(np.argmax(s)) if len(s) else -1
            top = float(s[best]) if len(s) else 0.0
            if top < LOW:
                action, confidence = "ADD", 0.8
            elif top > HIGH:
                action, confidence = decider(candidate, t[text].iloc[kept[best]]), 0.6
            else:
                action, confidence = "ADD", 0.6
            target = t[order].iloc[kept[best]] if action in ("UPDATE", "DELETE") else None
            if action == "UPDATE":
                kept[best] = k
            elif action == "DELETE" and mode == "sequential":
                kept.pop(best)
            elif action in ("ADD", "DELETE"):
                kept.append(k)
            rows.append((t[key].iloc[0], o, action, target, confidence))
        return pd.DataFrame(rows, columns=[key, order, "action", "target", "confidence"])

    return candidates.select(key, order, text).groupBy(key).applyInPandas(fold, f"{key} {kinds[key]}, {order} {kinds[order]}, action string, target {kinds[order]}, confidence double")


def with_retries(call, tries: int = 3, delay: float = 1.0, transient: tuple[type[Exception], ...] = (ConnectionError, TimeoutError)):
    """``call`` tried again after growing waits on transient failures."""
    import time

    for attempt in range(tries + 1):
        try:
            return call()
        except transient:
            if attempt == tries:
                raise
            time.sleep(delay * 2**attempt)
