"""Filters, caps, orders and group counts over any DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_counts(df: DataFrame, key: str, default: str | None = None) -> DataFrame:
    """(key, n), most frequent first; nulls under ``default`` if given."""
    k = F.col(key) if default is None else F.coalesce(F.col(key), F.lit(default))
    return df.groupBy(k.alias(key)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(key))


def flag_counts(df: DataFrame, **conditions: Column | str) -> DataFrame:
    """One row with the number of rows that meet each condition, in one pass."""
    return df.agg(*[F.count_if(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in conditions.items()])


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of every group; a window limit bounds what each task sorts."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def ordered_choice(value: Column | str, order: Sequence[str]) -> Column:
    """A sort key: the place of a value in a list, others after all of it."""
    v = F.col(value) if isinstance(value, str) else value
    out = F.lit(len(order))
    for k in range(len(order) - 1, -1, -1):
        out = F.when(v == order[k], k).otherwise(out)
    return out


def bands(value: Column | str, edges: Sequence[tuple[float | None, float | None, str]], closed: bool) -> Column:
    """The label of the first band holding the value; half-open unless ``closed``; null in none."""
    v = F.col(value) if isinstance(value, str) else value
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(edges)):
        test = F.lit(True)
        if low is not None:
            test &= v >= low
        if high is not None:
            test &= (v <= high) if closed else (v < high)
        out = F.when(test, label).otherwise(out)
    return out


def band_histogram(df: DataFrame, value: str, edges: Sequence[tuple[float | None, float | None, str]], closed: bool) -> DataFrame:
    """(band, n) with a row for every band, empty ones too."""
    labels = df.sparkSession.createDataFrame([(k, e[2]) for k, e in enumerate(edges)], "place int, band string")
    counted = df.groupBy(bands(value, edges, closed).alias("band")).agg(F.count("*").alias("n"))
    return labels.join(counted, "band", "left").select("place", "band", F.coalesce("n", F.lit(0)).alias("n"))


def domain_cap(df: DataFrame, domains: dict[str, list[str]], text: str, id_col: str, order: Sequence[Column], percent: int) -> DataFrame:
    """Without the tail of each keyword domain that holds over ``percent`` of all rows."""
    from factloom.functions.scalars import contains_any

    total = df.agg(F.greatest(F.lit(1), F.floor(F.count("*") * percent / 100)).alias("most"))
    tags = F.array_compact(F.array(*[F.when(contains_any(text, ws), d) for d, ws in domains.items()]))
    tagged = df.withColumn("domain", F.explode(tags))
    ranked = tagged.withColumn("place", F.row_number().over(Window.partitionBy("domain").orderBy(*order)))
    gone = ranked.join(F.broadcast(total), F.col("place") > F.col("most")).select(id_col).distinct()
    return df.join(gone, id_col, "left_anti")


def within_budget(df: DataFrame, group: Sequence[str], order: Sequence[Column], size: Column, budget: int) -> DataFrame:
    """Rows of each group until their running size passes the budget; the one that crosses stays."""
    before = F.coalesce(F.sum(size).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("size_before", before).where(F.col("size_before") <= budget)


def chunk_numbers(df: DataFrame, order: Sequence[Column], size: int, chunk: str = "chunk") -> DataFrame:
    """Rows numbered in equal chunks of a total order, without one task sorting all of them.

    Rows are range-partitioned and sorted; each partition's offset is the count of
    those before it, gathered as one number per partition.
    """
    from factloom.operators.ranking import global_row_number

    return global_row_number(df, order, "__row").withColumn(chunk, F.floor((F.col("__row") - 1) / size).cast("long")).drop("__row")


def context_frame(df: DataFrame, group: Sequence[str], order: Sequence[Column], value: Column, k: int, out: str = "context") -> DataFrame:
    """Each row with the values of the k rows before and after it in its group."""
    return df.withColumn(out, F.collect_list(value).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(-k, k)))
