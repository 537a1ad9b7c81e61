"""Exact k nearest neighbours and similarity pairs by blocks of matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that one pass broadcasts; a larger set is taken in blocks by hash.
QUERY_BOUND = 20_000
#: Rows of a block of the pair search, from few rows to many; two blocks are one task's.
BLOCK_ROWS, MOST_BLOCK_ROWS, BLOCKS = 4096, 32_768, 8
#: Rows by columns of the products that are held at once, in the search and in the statistics.
TILE, STRIP = 1024, 256
#: Products may differ from those of SQL by so much; what is nearer to the last kept is compared by SQL's own.
ERROR = 1e-9
#: Bins of the statistics' histogram.
BINS = 1 << 18


def raw(arr: pa.Array) -> np.ndarray:
    """Rows of an array column as doubles; nulls and those of other lengths are zero."""
    if len(arr) and not arr.null_count and pc.min_max(pc.list_value_length(arr)).as_py()["min"] == (width := pc.max(pc.list_value_length(arr)).as_py()):
        flat = arr.flatten()
        if not flat.null_count:
            return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(arr), width)
    rows = arr.to_pylist()
    width = max((len(r) for r in rows if r), default=0)
    m = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        if r and len(r) == width:
            m[k] = r
    return m


def lengths(m: np.ndarray) -> np.ndarray:
    """Lengths of rows, their squares added in order."""
    n = np.zeros(len(m))
    for c in range(m.shape[1]):
        n += m[:, c] * m[:, c]
    return np.sqrt(n)


def units(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.divide(m, n[:, None], out=np.zeros_like(m), where=n[:, None] > 0)


def matrix(arr: pa.Array) -> np.ndarray:
    """Rows of an array column as doubles of unit length; zero vectors and nulls stay zero."""
    m = raw(arr)
    return units(m, lengths(m))


def cosines(a: np.ndarray, an: np.ndarray, r: np.ndarray, b: np.ndarray, bn: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosines of rows r of a and c of b, added in order as SQL does: equal vectors have equal ones, whatever the block."""
    s = np.zeros(len(r))
    for k in range(a.shape[1]):
        s += a[r, k] * b[c, k]
    n = an[r] * bn[c]
    return np.divide(s, n, out=np.zeros_like(s), where=n > 0)


def _blocks(queries: DataFrame, q_id: str) -> list[DataFrame]:
    n = queries.count()
    blocks = n // QUERY_BOUND + 1
    return [queries] if blocks == 1 else [queries.where(F.pmod(F.xxhash64(q_id), F.lit(2 * blocks)) == b) for b in range(2 * blocks)]


def _merge(best_s: np.ndarray, best_i: np.ndarray, r: np.ndarray, i: np.ndarray, s: np.ndarray) -> None:
    """Takes items i with cosines s for the queries r into their best; ties by the item's id."""
    rows, k = np.unique(r), best_s.shape[1]
    rr, ii, ss = np.concatenate([np.repeat(rows, k), r]), np.concatenate([best_i[rows].ravel(), i]), np.concatenate([best_s[rows].ravel(), s])
    order = np.lexsort((ii, -ss, rr))
    take = order[np.searchsorted(rr[order], rows)[:, None] + np.arange(k)]
    best_s[rows], best_i[rows] = ss[take], ii[take]


def knn(queries: DataFrame, items: DataFrame, q_id: str, i_id: str, vector: str, k: int) -> DataFrame:
    """(q_id, i_id, similarity, rank) by cosine, ties by the item's id; all items are searched.

    A task holds one tile of products and the best k of each query.
    """
    found = None
    for block in _blocks(queries, q_id):
        rows = block.select(F.col(q_id).cast("long"), vector).toArrow()
        shared = items.sparkSession.sparkContext.broadcast((rows.column(0).to_numpy(), raw(rows.column(1).combine_chunks())))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q_ids, q = shared.value
            qn = lengths(q)
            u = units(q, qn)
            best_s, best_i = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64)
            for batch in batches:
                if not batch.num_rows or not len(q_ids):
                    continue
                item, x = batch.column(0).to_numpy(), raw(batch.column(1))
                if x.shape[1] != q.shape[1]:
                    continue
                xn = lengths(x)
                y = units(x, xn)
                for at in range(0, len(y), TILE):
                    for top in range(0, len(u), TILE):
                        s = u[top : top + TILE] @ y[at : at + TILE].T
                        least = best_s[top : top + TILE, -1] - ERROR
                        hit = np.flatnonzero(s >= least[:, None])
                        if len(hit) > 4 * k * len(s) and s.shape[1] > k:
                            least = np.maximum(least, np.partition(s, -k, axis=1)[:, -k] - ERROR)
                            hit = np.flatnonzero(s >= least[:, None])
                        if len(hit):
                            r, c = hit // s.shape[1] + top, hit % s.shape[1] + at
                            _merge(best_s, best_i, r, item[c], cosines(q, qn, r, x, xn, c))
            r, c = np.nonzero(best_s > -np.inf)
            for at in range(0, len(r), 1 << 16):
                rr, cc = r[at : at + (1 << 16)], c[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[rr]), pa.array(best_i[rr, cc]), pa.array(best_s[rr, cc])], names=["q", "i", "s"])

        part = items.select(F.col(i_id).cast("long"), vector).mapInArrow(run, "q long, i long, s double")
        found = part if found is None else found.union(part)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), F.asc("i")))).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(q_id), F.col("i").alias("item_" + i_id if i_id == q_id else i_id), F.col("s").alias("similarity"), "rank")


def _parts(n: int) -> int:
    """Blocks of n rows: small ones up to BLOCKS, then that many larger ones, then more of the largest."""
    return max(min(n // BLOCK_ROWS + 1, BLOCKS), n // MOST_BLOCK_ROWS + 1)


def _meetings(df: DataFrame, i_id: str, vector: str, parts: int | None = None, group: str | None = None) -> DataFrame:
    """(g, i, v, block, low, high): every two blocks of a group's rows, and each with itself, as one group (g, low, high).

    Only groups of more than one block go through the driver, which are few;
    rows without a group meet none.  With no ``group`` all rows are one.
    """
    rows = df.select(F.col(i_id).cast("long").alias("i"), F.col(vector).alias("v"), (F.lit(0) if group is None else F.col(group)).alias("g")).where("i IS NOT NULL AND g IS NOT NULL")
    if parts is None:
        of = {r.g: _parts(r.n) for r in rows.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= BLOCK_ROWS).collect()}
        given = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in of.items() for x in kv]), F.col("g")), F.lit(1)) if of else F.lit(1)
        tasks = sum(p * (p + 1) // 2 for p in of.values())
    else:
        given, tasks = F.lit(parts), parts * (parts + 1) // 2
    packed = rows.withColumn("parts", given).withColumn("block", F.pmod(F.xxhash64("i"), F.col("parts")).cast("int"))
    meets = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    spread = packed.select("g", "i", "v", "block", meets).select("g", "i", "v", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread.repartition(min(2000, max(least, tasks)), "g", "low", "high")


def _products(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids of rows, ids of columns, products) of a meeting by strips; within a block only those right of the diagonal's strips.

    Rows go by their ids, so that products are the same in every pass.
    """
    t = t.sort_by([("block", "ascending"), ("i", "ascending")])
    low, high = t.column("low")[0].as_py(), t.column("high")[0].as_py()
    ids, block = t.column("i").to_numpy(), t.column("block").to_numpy()
    x = matrix(t.column("v").combine_chunks())
    a, b = block == low, block == high
    ids_a, ids_b, x_a, x_b = ids[a], ids[b], x[a], x[b]
    for at in range(0, len(x_a), STRIP):
        for c in range(at // TILE * TILE if low == high else 0, len(x_b), TILE):
            yield ids_a[at : at + STRIP], ids_b[c : c + TILE], x_a[at : at + STRIP] @ x_b[c : c + TILE].T


def _values(t: pa.Table) -> Iterator[np.ndarray]:
    """The products of a meeting, each two rows of different ids once."""
    own = t.column("low")[0] == t.column("high")[0]
    for p, q, s in _products(t):
        yield s[p[:, None] < q] if own and len(p) and len(q) and p[-1] >= q[0] else s.ravel()


def pair_statistics(df: DataFrame, i_id: str, vector: str, thresholds: tuple[float, ...], parts: int | None = None, held: int = 1 << 23, group: str | None = None) -> dict:
    """n, mean, median, sd, least, most and the number at or above each threshold, of all pairs, or of those within each ``group``.

    Each two blocks send sums, extremes, counts and the bins of a histogram
    that hold any.  A middle value's bin is split again, by a pass each, until
    at most ``held`` values are left in it, which are gathered: the median is exact.
    """
    spread = _meetings(df, i_id, vector, parts, group).groupBy("g", "low", "high")
    kinds = "bin long, k long, total double, squares double, least double, most double, over array<long>"
    first = (-1.001, BINS / 2.002)

    def bins_of(s: np.ndarray, low: float, scale: float) -> np.ndarray:
        v = s - low
        v *= scale
        return v.astype(np.int64)

    def within(s: np.ndarray, levels: list[tuple[float, float, int]]) -> np.ndarray:
        """The values in each level's bin; a wider range first, which is cheap."""
        for low, scale, at in levels:
            s = s[(s >= low + (at - 1) / scale) & (s < low + (at + 2) / scale)]
            s = s[np.clip(bins_of(s, low, scale), 0, BINS - 1) == at]
        return s

    def summed(t: pa.Table) -> pa.Table:
        total, squares, least, most, over, bins = 0.0, 0.0, np.inf, -np.inf, np.zeros(len(thresholds), np.int64), np.zeros(BINS, np.int64)
        for s in _values(t):
            if len(s):
                total, squares, least, top = total + s.sum(), squares + np.dot(s, s), min(least, s.min()), s.max()
                most = max(most, top)
                over += [np.count_nonzero(s >= h) if top >= h else 0 for h in thresholds]
                n = np.bincount(bins_of(s, *first))
                bins[: len(n)] += n
        at = np.flatnonzero(bins)
        rest = [None] * max(0, len(at) - 1)
        one = lambda v, kind: pa.array([v, *rest][: len(at)], kind)
        real = pa.float64()
        return pa.table({"bin": pa.array(at), "k": pa.array(bins[at]), "total": one(float(total), real), "squares": one(float(squares), real), "least": one(float(least), real), "most": one(float(most), real), "over": one(over.tolist(), pa.list_(pa.int64()))})

    def split(levels: list[tuple[float, float, int]], low: float, scale: float):
        def run(t: pa.Table) -> pa.Table:
            bins = np.zeros(BINS, np.int64)
            for s in _values(t):
                bins += np.bincount(np.clip(bins_of(within(s, levels), low, scale), 0, BINS - 1), minlength=BINS)
            at = np.flatnonzero(bins)
            return pa.table({"bin": pa.array(at), "k": pa.array(bins[at])})

        return spread.applyInArrow(run, "bin long, k long").groupBy("bin").agg(F.sum("k").alias("k")).toArrow()

    def gathered(levels: list[tuple[float, float, int]]) -> tuple[np.ndarray, np.ndarray]:
        def run(t: pa.Table) -> pa.Table:
            s, k = np.unique(np.concatenate([np.zeros(0), *(within(s, levels) for s in _values(t))]), return_counts=True)
            return pa.table({"s": pa.array(s), "k": pa.array(k.astype(np.int64))})

        t = spread.applyInArrow(run, "s double, k long").groupBy("s").agg(F.sum("k").alias("k")).toArrow()
        s, k = t.column("s").to_numpy(), t.column("k").to_numpy()
        order = np.argsort(s)
        return s[order], np.cumsum(k[order])

    def ends(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        at, k = t.column("bin").to_numpy(), t.column("k").to_numpy()
        order = np.argsort(at)
        return at[order], np.cumsum(k[order])

    sums = [F.sum(c).alias(c) for c in ("k", "total", "squares")] + [F.min("least").alias("least"), F.max("most").alias("most"), F.array(*[F.sum(F.col("over")[k]) for k in range(len(thresholds))]).alias("over")]
    t = spread.applyInArrow(summed, kinds).groupBy("bin").agg(*sums).toArrow()
    if not t.num_rows:
        return {"n": 0, "mean": None, "median": None, "sd": None, "least": None, "most": None, "over": [0] * len(thresholds)}
    whole = ends(t)
    n, total, squares, least, most = (f(t.column(c)).as_py() for f, c in ((pc.sum, "k"), (pc.sum, "total"), (pc.sum, "squares"), (pc.min, "least"), (pc.max, "most")))
    over = [sum(o[k] or 0 for o in t.column("over").to_pylist() if o) for k in range(len(thresholds))]
    middle, have = [], None
    for rank in ((n - 1) // 2, n // 2):
        if have is None or rank >= have[0] + have[2][-1]:
            levels, (low, scale), (at, upto), below = [], first, whole, 0
            while True:
                p = int(np.searchsorted(upto, rank - below, "right"))
                inside = int(upto[p] - (upto[p - 1] if p else 0))
                below += int(upto[p - 1]) if p else 0
                levels.append((low, scale, int(at[p])))
                if inside <= held or scale > 1e9:  # bins of 1e-10 hold few different values
                    break
                low, scale = low + (int(at[p]) - 1) / scale, scale * BINS / 3
                at, upto = ends(split(levels, low, scale))
            have = (below, *gathered(levels))
        middle.append(float(have[1][np.searchsorted(have[2], rank - have[0], "right")]))
    mean = total / n
    return {"n": n, "mean": mean, "median": sum(middle) / 2, "sd": max(0.0, squares / n - mean * mean) ** 0.5, "least": least, "most": most, "over": over}


def similar_pairs(df: DataFrame, i_id: str, vector: str, threshold: float, parts: int | None = None) -> DataFrame:
    """(a, b, similarity), a < b, of all pairs at or above the threshold.

    Every two blocks of rows meet in one group and are compared by matrix
    products, strip by strip, so a group is bounded and only pairs that pass leave it.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        own = t.column("low")[0] == t.column("high")[0]
        for p, q, s in _products(t):
            r, c = np.nonzero(s >= threshold)
            a, b, s = p[r], q[c], s[r, c]
            ok = a < b if own else a != b
            if ok.any():
                yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b)[ok], "b": np.maximum(a, b)[ok], "similarity": s[ok]})

    return _meetings(df, i_id, vector, parts).groupBy("g", "low", "high").applyInArrow(compare, "a long, b long, similarity double")


def similar_counts(df: DataFrame, i_id: str, vector: str, thresholds: tuple[float, ...], parts: int | None = None, group: str | None = None) -> DataFrame:
    """(g, threshold, n): the pairs of all rows, or of those of each ``group``, at or above each threshold, where there are any; none is listed."""

    def count(t: pa.Table) -> pa.Table:
        n = np.zeros(len(thresholds), np.int64)
        for s in _values(t):
            n += [np.count_nonzero(s >= h) for h in thresholds]
        some = np.flatnonzero(n)
        g = pa.chunked_array([t.column("g").slice(0, 1).combine_chunks()] * len(some), t.column("g").type)
        return pa.table({"g": g, "threshold": pa.array(np.array(thresholds)[some]), "n": pa.array(n[some])})

    kind = "int" if group is None else df.schema[group].dataType.simpleString()
    spread = _meetings(df, i_id, vector, parts, group).groupBy("g", "low", "high")
    return spread.applyInArrow(count, f"g {kind}, threshold double, n long").groupBy("g", "threshold").agg(F.sum("n").alias("n"))
