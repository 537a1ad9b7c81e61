"""A token index for full-text search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def token_index(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term): each document's distinct lower-case terms."""
    terms = F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit("([a-z0-9]+)"), F.lit(1)))
    return df.select(id_col, F.explode(terms).alias("term"))


def match_all(index: DataFrame, terms: list[str], id_col: str) -> DataFrame:
    """Ids of the documents that hold every term."""
    wanted = sorted({t.lower() for t in terms})
    return index.where(F.col("term").isin(wanted)).groupBy(id_col).agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select(id_col)


#: Literal terms that one pass broadcasts; more are taken in blocks by hash.
TERM_BOUND = 10_000


def term_hits(df: DataFrame, text_col: str, terms: DataFrame) -> DataFrame:
    """(term, n): the texts that contain each term, terms without any left out."""
    n = terms.count()
    blocks = n // TERM_BOUND + 1
    parts = [terms] if blocks == 1 else [terms.where(F.pmod(F.xxhash64("term"), F.lit(2 * blocks)) == b) for b in range(2 * blocks)]
    out = None
    for part in parts:
        hits = df.select(text_col).join(F.broadcast(part), F.contains(F.col(text_col), F.col("term"))).groupBy("term").agg(F.count("*").alias("n"))
        out = hits if out is None else out.union(hits)
    return out
