"""Sinks: idempotent appends, replaced partitions, versions, ledgers and payloads.

Tables are Parquet folders.  A change rewrites the partitions it touches under
a new version folder and then moves the pointer, so a lost job leaves the last
version readable.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def insert_new(existing: DataFrame | None, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The rows of ``new`` to append: first of each key that is not stored yet."""
    if order is None:
        first = new.dropDuplicates([key])
    else:
        first = new.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__r = 1").drop("__r")
    return first if existing is None else first.join(existing.select(key), key, "left_anti")


def supersede(facts: DataFrame, changes: DataFrame, id_col: str = "fact_id") -> DataFrame:
    """Facts with ``superseded_by`` from (id, by); what is superseded already stays so."""
    by = changes.groupBy(id_col).agg(F.min("by").alias("__by"))
    return facts.join(by, id_col, "left").withColumn("superseded_by", F.coalesce("superseded_by", "__by")).drop("__by")


def merge_counts(existing: DataFrame, new: DataFrame, keys: list[str], count: str = "n", latest: str | None = None) -> DataFrame:
    """Upsert by sum of counts and latest time."""
    aggs = [F.sum(count).alias(count)] + ([F.max(latest).alias(latest)] if latest else [])
    return existing.unionByName(new).groupBy(*keys).agg(*aggs)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Writes rows over the partitions they belong to; other partitions stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_vectors(df: DataFrame, path: str, key: str) -> int:
    """Appends vectors whose key is not stored; how many."""
    spark = df.sparkSession
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)
    new = insert_new(spark.read.parquet(path) if there else None, df, key)
    from factloom.operators.durable import durable

    new = durable(new)
    new.write.mode("append").parquet(path)
    return new.count()


def reset(facts: DataFrame, protected: list[str]) -> DataFrame:
    """What outlives a reset: facts of protected sources, such as a user's corrections."""
    return facts.where(F.col("source").isin(protected))


def snapshot(spark: SparkSession, source: str, target: str, version: int) -> str:
    """A copy of a table in a folder of its own version."""
    path = f"{target}/v={version}"
    spark.read.parquet(source).write.mode("errorifexists").parquet(path)
    return path


def next_version(names: DataFrame, layer: str) -> tuple[int, int]:
    """(next version, next generation) from history names ``layer_vN_genM``; a new version starts generations anew."""
    v = F.regexp_extract("name", rf"^{layer}_v([0-9]+)_(?:gen|regen)[0-9]+", 1).try_cast("int")
    g = F.regexp_extract("name", rf"^{layer}_v[0-9]+_(?:gen|regen)([0-9]+)", 1).try_cast("int")
    top = names.select(F.struct(v.alias("v"), g.alias("g")).alias("x")).agg(F.max("x").alias("x")).first()["x"]
    if top is None or top["v"] is None:
        return 1, 1
    return top["v"] + 1, top["g"] + 1


def write_layers(layers: DataFrame, path: str) -> None:
    """(layer, version, text) as text with front matter, one folder a layer."""
    head = F.concat(F.lit("---\nversion: "), F.col("version").cast("string"), F.lit("\n---\n## Injectable Block\n"), "text")
    layers.select("layer", head.alias("value")).write.mode("overwrite").partitionBy("layer").text(path)


def append_ledger(df: DataFrame, path: str) -> None:
    """Appends rows to a ledger of JSON lines."""
    df.write.mode("append").json(path)


def contradiction_rows(judged: DataFrame, existing: DataFrame | None) -> DataFrame:
    """Insert-or-replace by the ordered pair; the newest judgment stays."""
    pair = judged.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})
    both = pair if existing is None else existing.unionByName(pair)
    return both.withColumn("__r", F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("judged_at")))).where("__r = 1").drop("__r")


def apply_judgments(facts: DataFrame, judged: DataFrame) -> DataFrame:
    """Judged pairs (older, newer) supersede the older: past, confidence to max(0.3 c, 0.1)."""
    j = judged.groupBy(F.col("older").alias("fact_id")).agg(F.min("newer").alias("__by"))
    hit = F.col("__by").isNotNull() & F.col("superseded_by").isNull()
    return facts.join(j, "fact_id", "left").withColumns({
        "temporal_state": F.when(hit, "past").otherwise(F.col("temporal_state")),
        "confidence": F.when(hit, F.greatest(0.3 * F.col("confidence"), F.lit(0.1))).otherwise(F.col("confidence")),
        "superseded_by": F.when(hit, F.col("__by").cast("string")).otherwise(F.col("superseded_by")),
    }).drop("__by")


def payload(layers: DataFrame, counts: DataFrame) -> str:
    """The publishing payload: layers and a distribution, as one small JSON text."""
    return json.dumps({"layers": {r.layer: r.text for r in layers.orderBy("layer").collect()}, "distribution": {r.category: r.n for r in counts.orderBy("category").collect()}}, ensure_ascii=False, sort_keys=True)
