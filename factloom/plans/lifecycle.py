"""Queries of embedding, the candidate lifecycle, clusters and merge trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators import lifecycle as L
from factloom.plans.registry import query
from factloom.sources.domain import active, table

#: Predicates whose facts may contradict each other.
TENSIONS = [("believes", "avoids"), ("values", "dislikes"), ("practices", "avoids"), ("enjoys", "dislikes"), ("aspires_to", "fears"), ("maintains", "struggles_with"), ("prefers", "avoids"), ("loves", "hates")]
#: Facts, on average, among which a control's other side is drawn.
CONTROL_GROUP = 1000


@query("audn_sequential")
def audn_sequential(spark: SparkSession, sf: str) -> DataFrame:
    """DUP-02 with the stub models."""
    return L.audn(active(spark, sf).select("conv_id", "fact_id", F.col("fact_text").alias("t")), "conv_id", "fact_id", "t")


@query("audn_batch")
def audn_batch(spark: SparkSession, sf: str) -> DataFrame:
    """DUP-03: the other variant, by name."""
    return L.audn(active(spark, sf).select("conv_id", "fact_id", F.col("fact_text").alias("t")), "conv_id", "fact_id", "t", mode="batch")


@query("embedded_messages")
def embedded_messages(spark: SparkSession, sf: str) -> DataFrame:
    """VEC-01, SNK-10: vectors of messages by the stub embedder."""
    m = table(spark, sf, "conversations").where(F.char_length("text") > 10)
    return L.embed(m.select("conv_id", "turn", "text"), "text").select("conv_id", "turn", F.size("vector").alias("width"))


@query("semantic_chunks")
def semantic_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-06: KMeans over vectors, then equal chunks in order of cluster and id."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from factloom.operators.relational import chunk_numbers

    e = table(spark, sf, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    k = max(2, min(40, e.count() // 20))
    labelled = KMeans(k=k, seed=42, maxIter=10).fit(e).transform(e).select("vec_id", F.col("prediction").alias("cluster"))
    return chunk_numbers(labelled, [F.asc("cluster"), F.asc("vec_id")], 60)


@query("merge_tree", "SELECT tier, count(*) AS n FROM (SELECT 0 AS tier, doc_id AS node FROM documents UNION ALL SELECT 1, doc_id // 4 FROM documents GROUP BY doc_id // 4 UNION ALL SELECT 2, doc_id // 16 FROM documents GROUP BY doc_id // 16) GROUP BY 1")
def merge_tree(spark: SparkSession, sf: str) -> DataFrame:
    """DST-03: tiers of a tree of fan-in four."""
    level = table(spark, sf, "documents").select(F.col("doc_id").alias("node"))
    out = level.select(F.lit(0).alias("tier"), "node")
    for tier in (1, 2):
        level = level.select(F.floor(F.col("node") / 4).alias("node")).distinct()
        out = out.unionByName(level.select(F.lit(tier).alias("tier"), "node"))
    return out.groupBy("tier").agg(F.count("*").alias("n"))


@query("hard_pairs")
def hard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """JN-21: near pairs of each predicate, a pair of each two predicates in tension, and a random control for each fact.

    As in the reference, the first five facts of a predicate (by time) meet the
    next two of it.  Choices are by seeded hash; a control is the next fact in
    one of many groups drawn by hash from the whole table.
    """
    a = active(spark, sf).where("fact_text IS NOT NULL").select("fact_id", "predicate", "created_at")
    place = F.row_number().over(Window.partitionBy("predicate").orderBy("created_at", "fact_id"))
    first = a.withColumn("i", place).where("i <= 7")
    x, y = first.select("predicate", F.col("fact_id").alias("a"), "i"), first.select("predicate", F.col("fact_id").alias("b"), F.col("i").alias("j"))
    same = x.join(y, "predicate").where("i <= 5 AND j > i AND j <= i + 2").select("a", "b", F.lit("same predicate").alias("kind"))
    sides = spark.createDataFrame([(k, side, p) for k, pair in enumerate(TENSIONS) for side, p in enumerate(pair)], "pair long, side int, predicate string")
    chance = F.struct(F.xxhash64("fact_id", "pair", "side", F.lit(5)), "fact_id")
    chosen = [F.min(F.when(F.col("side") == side, chance))["fact_id"].alias(name) for side, name in enumerate("ab")]
    tension = a.join(F.broadcast(sides), "predicate").groupBy("pair").agg(*chosen).where("a IS NOT NULL AND b IS NOT NULL").select("a", "b", F.lit("tension").alias("kind"))
    groups = a.count() // CONTROL_GROUP + 1
    drawn = a.select(F.col("fact_id").alias("a"), F.xxhash64("fact_id", F.lit(3)).alias("h")).withColumn("g", F.pmod("h", F.lit(groups)))
    by_chance = Window.partitionBy("g").orderBy(F.xxhash64("h", F.lit(11)), "a")
    nxt = F.coalesce(F.lead("a").over(by_chance), F.first("a").over(by_chance))
    control = drawn.select("a", nxt.alias("b"), F.lit("control").alias("kind")).where("a <> b")
    return same.unionByName(tension).unionByName(control)


@query("rendered_package")
def rendered_package(spark: SparkSession, sf: str) -> DataFrame:
    """DST-07: numbered lines of each category, within a budget."""
    from factloom.operators.relational import within_budget

    a = active(spark, sf).select("category", "fact_id", F.substring("fact_text", 1, 80).alias("line"))
    kept = within_budget(a, ["category"], [F.col("fact_id")], F.char_length("line"), 2000)
    return kept.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fact_id", "line"))), lambda x: x["line"]), "\n").alias("text"))
