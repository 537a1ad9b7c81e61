"""Consensus over runs, leaf audits, tests and sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def agreement_curve(votes: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(n, mean_size, union, invariant, half, once) over the first n runs of (run, fact)."""
    upto = votes.join(F.broadcast(checkpoints), F.col("run") <= F.col("n"))
    v = upto.groupBy("n", "fact").agg(F.countDistinct("run").alias("v"), F.count("*").alias("c"))
    n = F.col("n")
    return v.groupBy("n").agg(
        (F.sum("c") / n).alias("mean_size"), F.count("*").alias("union"), F.count_if(F.col("v") == n).alias("invariant"),
        F.count_if(F.col("v") >= F.floor((n + 1) / 2)).alias("half"), F.count_if(F.col("v") == 1).alias("once"),
    )


def majority(votes: DataFrame, runs: int) -> DataFrame:
    """(fact, votes, verified): in more than half of the runs."""
    return votes.groupBy("fact").agg(F.countDistinct("run").alias("votes")).withColumn("verified", F.col("votes") * 2 > runs)


def validated_leaves(leaves: DataFrame, known: str = "ids", cited: str = "fact_ids", dispositions: str = "dispositions", legal: tuple[str, ...] = ("contributed", "redundant", "unused")) -> DataFrame:
    """Leaves with foreign ids stripped and what was wrong counted; dispositions must be legal and complete."""
    given = F.map_keys(dispositions)
    return leaves.withColumns({
        "n_foreign": F.size(F.array_except(cited, known)),
        cited: F.array_intersect(cited, known),
        "n_missing": F.size(F.array_except(known, given)),
        "n_illegal": F.size(F.filter(F.map_values(dispositions), lambda v: ~v.isin(*legal))),
    })


def merged_themes(themes: DataFrame) -> DataFrame:
    """(key, statement, fact_ids, n_leaves): themes of equal statement, letter case and blanks aside."""
    return themes.groupBy(F.lower(F.trim("statement")).alias("key")).agg(
        F.min_by("statement", "leaf").alias("statement"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("fact_ids")))).alias("fact_ids"), F.countDistinct("leaf").alias("n_leaves")
    )


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__r = 1").drop("__r")


def discordance(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """The 2x2 table of two outcomes, corrected chi-square and the exact two-sided binomial p."""
    one = lambda c: F.count_if(c)
    t = df.agg(one(a & b).alias("both"), one(a & ~b).alias("only_a"), one(~a & b).alias("only_b"), one(~a & ~b).alias("neither"))
    n, k = F.col("only_a") + F.col("only_b"), F.least("only_a", "only_b")
    gap = F.greatest(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(0))
    return t.withColumns({"chi2": F.when(n > 0, gap * gap / n).otherwise(0.0), "p": F.when(n > 0, F.least(F.lit(1.0), 2 * binomial_tail(n, k))).otherwise(1.0)})


def binomial_tail(n: Column, k: Column) -> Column:
    """P(X <= k) for X ~ Binomial(n, 1/2), by logarithms of the terms."""
    # log C(n, i) grows by log((n - i) / (i + 1))
    start = F.struct((-n * F.log(F.lit(2.0))).alias("t"), F.exp(-n * F.log(F.lit(2.0))).alias("s"))
    steps = F.when(k > 0, F.sequence(F.lit(0).cast("long"), (k - 1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, start, lambda s, i: F.struct((s["t"] + F.log((n - i) / (i + 1))).alias("t"), (s["s"] + F.exp(s["t"] + F.log((n - i) / (i + 1)))).alias("s")), lambda s: s["s"])


def sweep(pairs: DataFrame, thresholds: DataFrame, score: str) -> DataFrame:
    """(threshold, n, share): the yield of each threshold; every pair is scored once."""
    total = pairs.agg(F.count("*").alias("total"))
    found = pairs.join(F.broadcast(thresholds), F.col(score) >= F.col("threshold")).groupBy("threshold").agg(F.count("*").alias("n"))
    return thresholds.join(found, "threshold", "left").join(F.broadcast(total)).select("threshold", F.coalesce("n", F.lit(0)).alias("n"), F.try_divide(100.0 * F.coalesce("n", F.lit(0)), F.col("total")).alias("share"))
