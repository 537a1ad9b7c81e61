"""The queries of this package, one for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import bpe, decontaminate, html_extract, lm_scoring, pii, quality_classifier, quality_rules, secret_scan, simhash_dedup, toxicity
from factloom.llm._text import read_table


def vocabulary() -> str:
    """The default vocabulary file; every operator takes its path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digests(read_table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return quality_classifier.score(docs, quality_classifier.train(docs, labels))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = read_table(spark, sf_dir, "labels").where("quality = 1")
    return quality_rules.judge(read_table(spark, sf_dir, "documents"), good)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(read_table(spark, sf_dir, "documents"), vocabulary())


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, good = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels").where("quality = 1")
    return lm_scoring.score(docs, lm_scoring.fit(docs, good))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pii.pii_digests(docs, pii.train(docs))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.train(docs, labels))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ours = [op1_secret_scan, op2_quality_classifier, op3_quality_rules, op4_bpe, op5_lm_scoring, op6_pii, op7_html_extraction, op8_decontamination, op9_toxicity, op10_simhash_dedup]
    return {f.__name__: f for f in ours}


def oracle_sql() -> dict[str, str]:
    return {}
