"""Order-dependent folds, each over the rows or parts of one bounded group."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def packed_paragraphs(text: Column, budget: int, overlap: int = 0, mark: str = "\n\n") -> Column:
    """Paragraphs packed into chunks within a budget; a new chunk starts with the tail of the last.

    A text within the budget is one chunk, and a single longer paragraph is not split.
    """
    state = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("done"))

    def add(s: Column, p: Column) -> Column:
        grown = F.when(s["cur"] == "", p).otherwise(F.concat(s["cur"], F.lit(mark), p))
        over = (F.char_length(grown) > budget) & (s["cur"] != "")
        tail = F.concat(F.expr("''") if not overlap else F.substr(s["cur"], F.greatest(F.lit(1), F.char_length(s["cur"]) - overlap + 1)), F.lit(mark if overlap else ""), p)
        return F.struct(F.when(over, tail).otherwise(grown).alias("cur"), F.when(over, F.array_append(s["done"], s["cur"])).otherwise(s["done"]).alias("done"))

    parts = F.split(text, mark)
    chunks = F.aggregate(parts, state, add, lambda s: F.when(s["cur"] == "", s["done"]).otherwise(F.array_append(s["done"], s["cur"])))
    return F.when(F.char_length(text) <= budget, F.array(text)).otherwise(chunks)


def sentence_chunks(text: Column, size: int = 15, overlap: int = 2) -> Column:
    """Windows of ``size`` sentences, each starting ``overlap`` before the last one's end."""
    sentences = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")
    n, step = F.size(sentences), size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - overlap) / F.lit(float(step))).cast("int") - 1))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda k: F.array_join(F.slice(sentences, k * step + 1, F.lit(size)), " ")))


def greedy_distinct(df: DataFrame, group: str, order: Sequence[Column], id_col: str, words: Column, threshold: float, keep: int, first: int = 500) -> DataFrame:
    """(group, id, place) kept by a greedy walk: a row too like a kept one (Jaccard) is passed over.

    The walk mostly ends among the first candidates, so it is given the first
    ``first`` of each group; groups whose quota those leave open are walked
    again with eight times as many, until every group is full or exhausted.
    """
    from factloom.operators.durable import durable

    kind = dict(df.dtypes)
    ranked = df.select(F.col(group).alias("group"), F.col(id_col).alias("__id"), words.alias("__words"), F.struct(*order).alias("__order"))
    placed = ranked.withColumn("__place", F.row_number().over(Window.partitionBy("group").orderBy("__order")))
    sizes = ranked.groupBy("group").agg(F.count("*").alias("n_rows"))

    def walk(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("__place")
        kept: list[tuple] = []
        for i, w in zip(t["__id"], t["__words"]):
            w = set(w)
            if all(len(w & k) / max(1, len(w | k)) <= threshold for _, k in kept):
                kept.append((i, w))
                if len(kept) == keep:
                    break
        return pd.DataFrame({"group": t["group"].iloc[0], "id": [i for i, _ in kept], "place": range(1, len(kept) + 1)})

    found, todo = None, None
    while True:
        part = placed.where(F.col("__place") <= first)
        if todo is not None:
            part = part.join(todo, part["group"].eqNullSafe(todo["open"]), "left_semi")
        out = durable(part.groupBy("group").applyInPandas(walk, f"group {kind[group]}, id {kind[id_col]}, place int"))
        filled = out.groupBy(F.col("group").alias("g")).agg(F.count("*").alias("k"))
        left = sizes.where(F.col("n_rows") > first).join(filled, F.col("group").eqNullSafe(F.col("g"))).where(F.col("k") < keep)
        todo = durable(left.select(F.col("group").alias("open")))
        done = out.join(todo, out["group"].eqNullSafe(todo["open"]), "left_anti")
        found = done if found is None else found.union(done)
        if todo.isEmpty():
            return found.withColumnRenamed("group", group)
        first *= 8


def capped_by_topic(items: Column, most: int, slots: int) -> Column:
    """The first ``slots`` of an ordered array of (id, topic), at most ``most`` of one topic."""
    state = F.array().cast("array<struct<id:bigint,topic:string>>")

    def add(s: Column, x: Column) -> Column:
        same = F.size(F.filter(s, lambda k: k["topic"].eqNullSafe(x["topic"])))
        return F.when((F.size(s) < slots) & (same < most), F.array_append(s, x)).otherwise(s)

    return F.aggregate(items, state, add)


def supersession_cycles(df: DataFrame, id_col: str, next_col: str, depth: int = 8) -> DataFrame:
    """(id): rows whose chain of successors returns to themselves within ``depth`` steps."""
    from factloom.operators.durable import durable

    step = df.where(F.col(next_col).isNotNull()).select(F.col(id_col).alias("m"), F.col(next_col).alias("to"))
    reach = step.select(F.col("m").alias("i"), F.col("to").alias("j"))
    found = reach.where("i = j").select("i")
    for _ in range(depth - 1):
        # a chain that has come back to its start needs no further step
        reach = durable(reach.where("i <> j").join(step, F.col("j") == F.col("m")).select("i", F.col("to").alias("j")).distinct())
        if reach.isEmpty():
            break
        found = found.union(reach.where("i = j").select("i"))
    return found.distinct().withColumnRenamed("i", id_col)
