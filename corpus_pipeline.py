"""The corpus pipeline: toxicity, near-duplicates, benchmark leaks, PII, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents; all but the
last return the columns of documents.  Null and empty texts are clean and pass;
they are one group of near-duplicates; repeated rows are copies, of which one
stays; empty tables give empty tables; columns besides doc_id, text and n_chars
are handed on untouched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, decontaminate, pii, simhash_dedup, toxicity
from factloom.llm._text import read_table
from factloom.llm.durable import remove, shared_folder
from factloom.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the least id."""
    return simhash_dedup.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind, and n_chars follows the new text."""
    out = pii.redact(docs, pii.train(docs))
    if "n_chars" in out.columns:
        changed = F.when(F.col("text").isNotNull(), F.char_length("text").cast(out.schema["n_chars"].dataType))
        out = out.withColumn("n_chars", F.coalesce(changed, "n_chars"))
    return out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    return bpe.bpe_digests(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("pii", redact_pii),
    ("bpe", encode),
]

#: Trained models, SimHash and BPE cannot be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to and read from the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
