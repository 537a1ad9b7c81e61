"""Claims and their evidence: parsing, checks and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_HEADER = r"^(?:\*\*|##\s*)([ACMP][0-9]+)\.?\s*([^*\n]*)"
_CITED = r"^\s*provenance:\s*\[([^\]]*)\]"


def claim_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, line, claim_id, name): each line with the last claim header at or above it."""
    lines = df.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    code = F.nullif(F.regexp_extract("line", _HEADER, 1), F.lit(""))
    name = F.when(code.isNotNull(), F.trim(F.regexp_extract("line", _HEADER, 2)))
    w = Window.partitionBy(id_col).orderBy("pos")
    return lines.withColumns({"claim_id": F.last(code, ignorenulls=True).over(w), "name": F.last(name, ignorenulls=True).over(w), "is_header": code.isNotNull()})


def cited_facts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, claim_id, rank, fact_id) of the provenance lines under each header."""
    listed = F.regexp_extract("line", _CITED, 1)
    found = claim_lines(df, id_col, text_col).where(F.col("claim_id").isNotNull() & (listed != ""))
    ids = F.filter(F.transform(F.split(listed, ","), lambda x: F.regexp_replace(F.trim(x), "^F-", "")), lambda x: x != "")
    return found.select(id_col, "claim_id", F.posexplode(ids).alias("p", "fact_id")).select(id_col, "claim_id", (F.col("p") + 1).alias("rank"), "fact_id")


def claims(df: DataFrame, id_col: str, text_col: str, least: int = 20) -> DataFrame:
    """(id, claim_id, name, statement): the lines of each claim that are no header or provenance."""
    body = claim_lines(df, id_col, text_col).where(F.col("claim_id").isNotNull() & ~F.col("is_header") & ~F.col("line").rlike(_CITED) & (F.trim("line") != ""))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: F.trim(x["line"])), " ")
    return body.groupBy(id_col, "claim_id", "name").agg(text.alias("statement")).where(F.char_length("statement") >= least)


def recurrent(windowed: Column, raw: Column, least: int = 3) -> Column:
    """Whether the windowed count, or where it is missing the raw one, is enough."""
    return F.coalesce(windowed, raw) >= least


def temporal_result(links: DataFrame) -> DataFrame:
    """(claim_id, result): 0 with any future fact, -1 where one (predicate, object) is both current and past, else 1."""
    per = links.groupBy("claim_id", "predicate", "object_text").agg(
        F.bool_or(F.col("temporal_state") == "current").alias("now"), F.bool_or(F.col("temporal_state") == "past").alias("then"), F.bool_or(F.col("temporal_state") == "future").alias("later")
    )
    both = F.bool_or(F.col("now") & F.col("then"))
    return per.groupBy("claim_id").agg(F.when(F.bool_or("later"), 0).when(both, -1).otherwise(1).alias("result"))


def contradiction_result(links: DataFrame, succession: DataFrame) -> DataFrame:
    """(claim_id, result): 0 where a cited fact is superseded by another of the claim, else 1."""
    own = links.where("fact_id IS NOT NULL").select("claim_id", "fact_id").distinct()
    nxt = own.join(succession.where("next IS NOT NULL"), "fact_id").select("claim_id", F.col("next").alias("fact_id"))
    bad = nxt.join(own, ["claim_id", "fact_id"], "left_semi").select("claim_id").distinct().withColumn("bad", F.lit(True))
    return own.select("claim_id").distinct().join(bad, "claim_id", "left").select("claim_id", F.when(F.col("bad"), 0).otherwise(1).alias("result"))


def entailment_label(best: Column) -> Column:
    """SUPPORTED from .7, UNSUPPORTED below .3, PARTIAL between, SKIPPED without a score."""
    return F.when(best.isNull(), "SKIPPED").when(best >= 0.7, "SUPPORTED").when(best < 0.3, "UNSUPPORTED").otherwise("PARTIAL")
