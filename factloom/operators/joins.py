"""Joins of the domain: neighbours, contexts, tier tables, best matches, kNN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.scalars import dot


def pair_counts(df: DataFrame, group: str, item: str) -> DataFrame:
    """(a, b, n): unordered pairs of distinct items by the groups they share.

    Pairs are the result here; groups are conversations, whose items are few.
    """
    one = df.select(group, item).distinct()
    a, b = one.withColumnRenamed(item, "a"), one.withColumnRenamed(item, "b")
    return a.join(b, group).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def neighbours(edges: DataFrame, seeds: DataFrame, a: str = "a", b: str = "b", seed: str = "seed") -> DataFrame:
    """(node): both sides' neighbours of the seeds in an undirected edge table."""
    left = edges.join(seeds, edges[a] == seeds[seed], "left_semi").select(F.col(b).alias("node"))
    right = edges.join(seeds, edges[b] == seeds[seed], "left_semi").select(F.col(a).alias("node"))
    return left.union(right).distinct()


def tier_lookup(df: DataFrame, messages: str, chars: str, by_messages: list[tuple], by_chars: list[tuple], floor: tuple[int, int]) -> DataFrame:
    """max_facts and input_budget from two inclusive tier tables; the larger max_facts wins, ties to messages."""

    def of(value: Column, tiers: list[tuple], k: int) -> Column:
        out = F.lit(None).cast("int")
        for low, high, *given in reversed(tiers):
            out = F.when(value.between(low, high), given[k]).otherwise(out)
        return out

    m, c = F.col(messages), F.col(chars)
    m_facts, m_budget = F.coalesce(of(m, by_messages, 0), F.lit(floor[0])), F.coalesce(of(m, by_messages, 1), F.lit(floor[1]))
    by_c = (c > 0) & (of(c, by_chars, 0) > m_facts)
    return df.withColumns({"max_facts": F.when(by_c, of(c, by_chars, 0)).otherwise(m_facts), "input_budget": F.when(by_c, of(c, by_chars, 1)).otherwise(m_budget)})


def around(df: DataFrame, group: str, order: str, hit: Column, k: int, out: str = "near") -> DataFrame:
    """Rows within ``k`` places of a hit in their group, by a window of flags rather than a join."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(-k, k)
    return df.withColumn(out, F.max(hit.cast("int")).over(w)).where(F.col(out) == 1).drop(out)


def unit(df: DataFrame, vector: str) -> DataFrame:
    """Vectors scaled to length 1; those without length stay zero."""
    n = F.sqrt(dot(vector, vector))
    return df.withColumn(vector, F.transform(vector, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))))


def top_matches(queries: DataFrame, items: DataFrame, q_id: str, i_id: str, vector: str, k: int) -> DataFrame:
    """(q_id, i_id, similarity, rank): the exact k nearest items of every query.

    Items are scored in Arrow batches against the queries, which are a stated
    set of bounded size (``QUERY_BOUND``; more are taken in blocks); every task
    sends at most k rows a query, so no pair table is ever shuffled.
    """
    from factloom.operators.knn import knn

    return knn(queries, items, q_id, i_id, vector, k)
