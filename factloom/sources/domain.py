"""The domain relations over the provided tables, in Spark and as SQL views.

``facts`` stands documents in for extracted facts; ``provenance`` stands
vectors in for links between claims and facts.  ``VIEWS`` says the same in SQL,
for the queries' oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.vocabulary import CATEGORIES, PREDICATES

EPOCH, YEAR_S = 1704067200, 31536000
NOW = 1735689600
SUBJECTS = ["user", "my wife", "Rex (dog)", "Acme Inc", "best friend Tom", "me", "colleague Ann"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(values: list[str], n) -> F.Column:
    """The n-th of a short list (n counted from 0, cyclic)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, with the columns of the central fact table."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    i = F.col("doc_id")
    return d.join(l, "doc_id", "left").select(
        i.alias("fact_id"),
        F.col("text").alias("fact_text"),
        F.col("n_chars"),
        F.col("lang"),
        F.col("source"),
        _pick(SUBJECTS, i).alias("subject"),
        _pick(PREDICATES, i * 7).alias("predicate"),
        F.substring("text", 1, 24).alias("object_text"),
        _pick(CATEGORIES, i * 5 + F.col("n_chars")).alias("category"),
        F.when(F.col("quality") == 1, "identity").when(F.col("quality") == 0, "situational").otherwise("contextual").alias("tier"),
        F.when(F.col("toxic") == 1, "user_forget").alias("superseded_by"),
        _pick(["conviction", "position", "preference", "factual", "unclassified"], i * 3).alias("depth"),
        F.when(i % 9 < 6, "personal").otherwise("project").alias("scope"),
        _pick(["current", "past", "unknown", "current", "current", "future", "past"], i).alias("temporal_state"),
        _pick(["state", "event", "unclassified"], i).alias("fact_class"),
        ((i * 37 % 101) / 100.0).alias("confidence"),
        F.when(i % 17 != 0, (i * 13 % 41) / 4.0).alias("significance"),
        (i * 11 % 60).alias("recurrence"),
        F.when(i % 6 != 0, i * 5 % 7).alias("windowed"),
        (i % 97).alias("conv_id"),
        (F.lit(EPOCH) + i * 7919 % YEAR_S).alias("created_at"),
    )


def active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that nothing supersedes; the predicate goes before any join where Catalyst can push it."""
    return facts(spark, sf_dir).where("superseded_by IS NULL")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(layer, claim_id, fact_id, method, similarity, rank): links of claims to facts."""
    i = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        _pick(["ANCHORS", "CORE", "PREDICTIONS"], i % 20).alias("layer"),
        F.concat(_pick(["A", "C", "P"], i % 20), (i % 20).cast("string")).alias("claim_id"),
        F.when(i % 41 != 0, i * 7 % 1100).alias("fact_id"),
        F.when(i % 3 == 0, "cited").otherwise("vector").alias("method"),
        ((i * 29 % 71 + 30) / 101.0).alias("similarity"),
        (i % 10 + 1).alias("rank"),
    )


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_pick(values: list[str], n: str) -> str:
    return f"{_sql_list(values)}[CAST(({n}) % {len(values)} + 1 AS INTEGER)]"


FACTS = f"""facts AS (SELECT d.doc_id AS fact_id, d.text AS fact_text, d.n_chars, d.lang, d.source,
  {_sql_pick(SUBJECTS, "d.doc_id")} AS subject, {_sql_pick(PREDICATES, "d.doc_id * 7")} AS predicate, substr(d.text, 1, 24) AS object_text,
  {_sql_pick(CATEGORIES, "d.doc_id * 5 + d.n_chars")} AS category,
  CASE WHEN l.quality = 1 THEN 'identity' WHEN l.quality = 0 THEN 'situational' ELSE 'contextual' END AS tier,
  CASE WHEN l.toxic = 1 THEN 'user_forget' END AS superseded_by,
  {_sql_pick(["conviction", "position", "preference", "factual", "unclassified"], "d.doc_id * 3")} AS depth,
  CASE WHEN d.doc_id % 9 < 6 THEN 'personal' ELSE 'project' END AS scope,
  {_sql_pick(["current", "past", "unknown", "current", "current", "future", "past"], "d.doc_id")} AS temporal_state,
  {_sql_pick(["state", "event", "unclassified"], "d.doc_id")} AS fact_class,
  CAST(d.doc_id * 37 % 101 AS DOUBLE) / 100 AS confidence,
  CASE WHEN d.doc_id % 17 <> 0 THEN CAST(d.doc_id * 13 % 41 AS DOUBLE) / 4 END AS significance,
  d.doc_id * 11 % 60 AS recurrence, CASE WHEN d.doc_id % 6 <> 0 THEN d.doc_id * 5 % 7 END AS windowed,
  d.doc_id % 97 AS conv_id, {EPOCH} + d.doc_id * 7919 % {YEAR_S} AS created_at
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
ACTIVE = FACTS + ", active AS (SELECT * FROM facts WHERE superseded_by IS NULL)"
PROVENANCE = f"""provenance AS (SELECT {_sql_pick(["ANCHORS", "CORE", "PREDICTIONS"], "vec_id % 20")} AS layer,
  {_sql_pick(["A", "C", "P"], "vec_id % 20")} || CAST(vec_id % 20 AS VARCHAR) AS claim_id,
  CASE WHEN vec_id % 41 <> 0 THEN vec_id * 7 % 1100 END AS fact_id, CASE WHEN vec_id % 3 = 0 THEN 'cited' ELSE 'vector' END AS method,
  CAST(vec_id * 29 % 71 + 30 AS DOUBLE) / 101 AS similarity, vec_id % 10 + 1 AS rank FROM embeddings)"""
