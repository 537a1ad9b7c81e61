"""Benchmark decontamination by greedy string tiling.

Texts are cut into tokens (runs of letters and digits, lower-cased).  A seed is
a run of ``SEED_TOKENS`` tokens (all tokens of a shorter item).  Documents are
joined to benchmark items on shared seeds; a pair whose shared seeds could not
cover the threshold even if all were kept is dropped, which loses nothing, for
every tile is a chain of seeds.  For the other pairs the longest common runs of
unmarked tokens are found by Karp-Rabin over falling lengths and marked, the
longest first, until none of a seed's length is left.  The share of an item's
tokens that are marked is its coverage, whatever order the document has the
passages in; an item at ``COVERAGE`` or more contaminates the document.

The benchmark's seeds are broadcast while their number is within
``SEED_BOUND``; a larger benchmark is cut into blocks of items by hash, each
within the bound, and all documents are searched for each block in turn.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm._features import pieces
from factloom.llm._text import SpanHasher, append_columns, map_batches, mix64, powers, runs

SEED_TOKENS = 4
COVERAGE = 0.6
#: Most seeds (about as many as the benchmark's tokens) that one pass broadcasts.
SEED_BOUND = 4_000_000
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every token; punctuation, case and spacing do not matter."""
    from factloom.llm.toxicity import lower

    low = lower(data)
    s, e, row = runs(_TOKEN[low], offs)
    return SpanHasher(low).spans(s, e), row


def _seeds(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` tokens."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = mix64(out + h[k : k + m])
    return out


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiles (item start, document start, length) of two token lists.

    Lengths fall from the longest possible to ``least``; at each, runs of
    unmarked tokens are hashed on both sides (Karp-Rabin), verified, and marked
    where both sides are still free, in order of the item, then the document.
    """
    free_a, free_b = np.ones(len(item), bool), np.ones(len(doc), bool)
    roll_a, roll_b = _Rolling(item), _Rolling(doc)

    def shared(n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of unmarked runs of ``n`` whose hash the other side has too."""
        wa, wb = _free_windows(free_a, n), _free_windows(free_b, n)
        ha, hb = roll_a.windows(wa, n), roll_b.windows(wb, n)
        return wa[np.isin(ha, hb)], wb[np.isin(hb, ha)]

    out: list[tuple[int, int, int]] = []
    top = min(len(item), len(doc))
    while top >= least:
        lo, hi = least - 1, top  # the longest shared run: a shorter one is within it
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if len(shared(mid)[0]) else (lo, mid - 1)
        if lo < least:
            break
        wa, wb = shared(lo)
        where: dict[int, list[int]] = defaultdict(list)
        for j, h in zip(wb.tolist(), roll_b.windows(wb, lo).tolist()):
            where[h].append(j)
        for i, h in zip(wa.tolist(), roll_a.windows(wa, lo).tolist()):
            for j in where[h]:
                if free_a[i : i + lo].all() and free_b[j : j + lo].all() and (item[i : i + lo] == doc[j : j + lo]).all():
                    free_a[i : i + lo] = free_b[j : j + lo] = False
                    out.append((i, j, lo))
        top = lo - 1
    return out


class _Rolling:
    """Karp-Rabin hashes of runs of tokens in constant time each."""

    def __init__(self, h: np.ndarray) -> None:
        up, self.down = powers(len(h) + 1)
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[:-1], out=self.sums[1:])

    def windows(self, starts: np.ndarray, n: int) -> np.ndarray:
        return mix64((self.sums[starts + n] - self.sums[starts]) * self.down[starts])


def _free_windows(free: np.ndarray, n: int) -> np.ndarray:
    if n > len(free):
        return np.zeros(0, np.int64)
    sums = np.concatenate([[0], np.cumsum(free)])
    return np.flatnonzero(sums[n:] - sums[:-n] == n)


class Index:
    """Seeds of a block of benchmark items."""

    def __init__(self, ids: list, texts: list[str | None]) -> None:
        raw = [(t or "").encode() for t in texts]
        offs = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
        h, row = tokens(np.frombuffer(b"".join(raw), np.uint8), offs)
        cut = np.searchsorted(row, np.arange(len(ids) + 1))
        kept = [(i, h[a:b]) for i, a, b in zip(ids, cut, cut[1:]) if b > a]
        self.ids = [i for i, _ in kept]
        self.items = [x for _, x in kept]
        parts: dict[int, list[tuple[np.ndarray, int, np.ndarray]]] = defaultdict(list)
        for k, x in enumerate(self.items):
            n = min(SEED_TOKENS, len(x))
            s = _seeds(x, n)
            parts[n].append((s, k, np.arange(len(s))))
        #: seed length -> (sorted seeds, item, position in the item)
        self.by_length = {}
        for n, ps in parts.items():
            seed = np.concatenate([s for s, _, _ in ps])
            item = np.concatenate([np.full(len(s), k) for s, k, _ in ps])
            at = np.concatenate([p for _, _, p in ps])
            order = np.argsort(seed, kind="stable")
            sieve = np.zeros(1 << 22, bool)
            sieve[(seed & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
            self.by_length[n] = (seed[order], item[order], at[order], sieve)

    def search(self, data: np.ndarray, offs: np.ndarray, least: float) -> list[tuple[int, int, int, int, int]]:
        """(row, item, marked tokens, item tokens, tiles) of contaminating pairs."""
        h, row = tokens(data, offs)
        starts = np.searchsorted(row, np.arange(len(offs)))
        out = []
        for n, (seed, item, at, sieve) in self.by_length.items():
            s = _seeds(h, n)
            hit = np.flatnonzero(sieve[(s & np.uint64((1 << 22) - 1)).astype(np.int64)])
            hit = hit[row[hit] == row[hit + n - 1]]
            lo = np.searchsorted(seed, s[hit], "left")
            many = np.searchsorted(seed, s[hit], "right") - lo
            hit, lo, many = hit[many > 0], lo[many > 0], many[many > 0]
            if not len(hit):
                continue
            each = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            # an item's seeds, once a document: what they could cover at most
            place = np.unique(np.stack([np.repeat(row[hit], many), item[each], at[each]]), axis=1)
            edge = np.flatnonzero(np.any(place[:2, 1:] != place[:2, :-1], axis=0)) + 1
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), place.shape[1]]):
                r, k, x = int(place[0, a]), int(place[1, a]), self.items[place[1, a]]
                cover = np.zeros(len(x) + 1, np.int64)
                np.add.at(cover, place[2, a:b], 1)
                np.add.at(cover, place[2, a:b] + n, -1)
                if (np.cumsum(cover)[:-1] > 0).sum() < least * len(x):
                    continue
                found = tiles(x, self._near(h[starts[r] : starts[r + 1]], x, n), n)
                marked = sum(t[2] for t in found)
                if marked >= least * len(x):
                    out.append((r, k, marked, len(x), len(found)))
        return out

    @staticmethod
    def _near(doc: np.ndarray, item: np.ndarray, n: int) -> np.ndarray:
        """The document without tokens that no shared seed touches; a break stands for each gap.

        Tiles consist of seeds, so the tiling stays the same.
        """
        touched = np.zeros(len(doc) + 1, np.int64)
        hit = np.flatnonzero(np.isin(_seeds(doc, n), _seeds(item, n)))
        np.add.at(touched, hit, 1)
        np.add.at(touched, hit + n, -1)
        keep = np.cumsum(touched)[:-1] > 0
        first = keep.copy()
        first[1:] &= ~keep[:-1]
        out = doc[keep]
        return np.insert(out, np.flatnonzero(first[keep]), np.uint64(0))


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> list[DataFrame]:
    """The benchmark in blocks of items whose tokens stay within SEED_BOUND."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL").distinct()
    size = F.length("text") / 2 + 1
    total = items.agg(F.sum(size)).first()[0] or 0
    n = int(total // SEED_BOUND) + 1
    if n == 1:
        return [items]
    return [items.where(F.pmod(F.xxhash64("text"), F.lit(2 * n)) == k) for k in range(2 * n)]


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_marked, n_item, n_tiles, coverage) of every contaminating pair.

    Null, empty and token-free texts pair with nothing, as does an empty table;
    repeated documents or items each give their pairs (equal items of equal id
    count once); ids may be null.  Other columns are not read.
    """
    columns = {"doc_id": F.col(doc_id).cast("long"), "text": F.col(text_col).cast("string")}
    schema = "doc_id bigint, item_id bigint, n_marked bigint, n_item bigint, n_tiles bigint, coverage double"
    out = None
    for block in _blocks(benchmark, item_id, text_col):
        rows = sorted(((r.item_id, r.text) for r in block.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        index = docs.sparkSession.sparkContext.broadcast(Index([i for i, _ in rows], [t for _, t in rows]))

        def fn(batch: pa.RecordBatch, index=index) -> dict:
            ids, found = batch.column("doc_id").to_pylist(), []
            for a, _, data, offs in pieces(batch.column("text")):
                ix = index.value
                found += [(ids[a + r], ix.ids[k], m, n, t, m / n) for r, k, m, n, t in ix.search(data, offs, coverage)]
            cols = list(zip(*found)) or [[]] * 6
            return dict(zip(["doc_id", "item_id", "n_marked", "n_item", "n_tiles", "coverage"], map(list, cols)))

        part = map_batches(docs, columns, fn, schema)
        out = part if out is None else out.union(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that no benchmark item contaminates, all columns kept."""
    for block in _blocks(benchmark, item_id, "text"):
        rows = block.collect()
        index = docs.sparkSession.sparkContext.broadcast(Index([r.item_id for r in rows], [r.text for r in rows]))

        def fn(texts: pa.Array, index=index) -> dict:
            bad = np.zeros(len(texts), bool)
            for a, _, data, offs in pieces(texts):
                bad[[a + f[0] for f in index.value.search(data, offs, coverage)]] = True
            return {"__bad": bad}

        docs = append_columns(docs, text_col, fn, "__bad boolean").where("NOT __bad").drop("__bad")
    return docs
