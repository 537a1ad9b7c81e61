"""Scalar functions, folds and operators on crafted rows."""

import math
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from factloom.functions import scalars as S
from factloom.operators import evaluation, folds, joins, lifecycle, relational
from factloom.operators.knn import knn, similar_pairs
from factloom.operators.ranking import global_row_number


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(x):
    return F.lit(x).cast("string") if x is None else F.lit(x)


@pytest.mark.parametrize(
    "f, raw, want",
    [
        (S.normalize_category, " Goals ", "goal"), (S.normalize_category, "job", "biography"), (S.normalize_category, None, "unknown"),
        (S.normalize_intent, "Used To", "historical"), (S.normalize_intent, None, "does"), (S.normalize_temporal, "no longer", "past"), (S.normalize_temporal, "", "unknown"),
        (S.normalize_fact_class, "habit", "state"), (S.normalize_fact_class, "x", "unclassified"), (S.normalize_tier, "T1", "identity"), (S.normalize_tier, "contextual", "untiered"),
        (S.normalize_predicate, "Works At", "works_at"), (S.normalize_predicate, "grew up in", "raised_in"), (S.normalize_predicate, "paints", "paints"), (S.normalize_predicate, None, "unknown"), (S.normalize_predicate, "", "unknown"),
        (S.normalize_subject, None, "user"), (S.normalize_subject, "My Wife", "spouse"), (S.normalize_subject, "friend Tom", "friend:tom"),
    ],
)
def test_normalizers(spark, f, raw, want):
    assert one(spark, f(lit(raw))) == want


def test_noise_is_replaced_and_joined(spark):
    text = "see " + "ACGT" * 20 + " " + "0a1b" * 10 + " end\n" + "1, 2, 3, " * 20
    assert one(spark, S.strip_noise(F.lit(text))) == "see [sequence] end\n[numbers]"


def test_citations(spark):
    assert one(spark, S.strip_citations(F.lit("He sails [F-0a1b2c3d] (A1, C2-C4)."))) == "He sails."
    assert one(spark, S.citation_codes(F.lit("(A1-A4) and M2, C2"))) == ["A1", "A2", "A3", "A4", "C2"]


def test_json_with_trailing_commas(spark):
    assert one(spark, S.tolerant_json(F.lit('so {"a": [1, 2,],} it')).cast("string")) == '{"a":[1,2]}'
    assert one(spark, S.tolerant_json(F.lit("none"))) is None


def test_similarity_of_distances(spark):
    d = F.lit(0.5477)
    assert round(one(spark, S.similarity_of(d, "cosine")), 4) == 0.4523
    assert round(one(spark, S.similarity_of(d, "l2")), 4) == 0.85
    assert one(spark, S.similarity_of(F.lit(0.0), "cosine")) == 1.0 and one(spark, S.similarity_of(F.lit(2.0), "cosine")) == 0.0
    with pytest.raises(ValueError):
        S.similarity_of(d, "manhattan")


def test_times(spark):
    df = spark.createDataFrame([("1704067200000",), ("1704067200",), ("2024-01-01T00:00:00Z",), ("soon",), (None,)], "raw string")
    assert [r.x for r in df.select(S.coerced_seconds("raw").alias("x")).collect()] == [1704067200.0] * 3 + [None, None]


def test_anonymise(spark):
    assert one(spark, S.anonymise(F.lit("Ann Miller met Miller; ann stays"), "Ann Miller")) == "USER met USER; ann stays"


def test_paragraphs_are_conserved(spark):
    text = "\n\n".join(f"paragraph {k} " + "x" * (k % 5 * 30) for k in range(40))
    chunks = one(spark, folds.packed_paragraphs(F.lit(text), 200))
    assert "\n\n".join(chunks) == text and all(len(c) <= 200 for c in chunks)
    lapped = one(spark, folds.packed_paragraphs(F.lit(text), 200, 20))
    assert all(b.startswith(a[-20:]) for a, b in zip(lapped, lapped[1:]))
    assert one(spark, folds.packed_paragraphs(F.lit("y" * 500), 200)) == ["y" * 500]


@pytest.mark.parametrize("n", [0, 1, 14, 15, 16, 28, 29, 41, 100])
def test_sentences(spark, n):
    text = " ".join(f"S{k}." for k in range(n))
    got = one(spark, folds.sentence_chunks(F.lit(text)))
    want = [" ".join(f"S{k}." for k in range(a, min(a + 15, n))) for a in range(0, max(1, n - 2) if n else 0, 13)]
    assert got == want


def test_greedy_walk(spark):
    rows = [("g", 1, 0.9, "a b c d"), ("g", 2, 0.8, "a b c e"), ("g", 3, 0.7, "x y"), ("g", 4, 0.6, "x y z w"), ("g", 5, 0.5, "")]
    df = spark.createDataFrame(rows, "g string, i long, s double, t string")
    got = folds.greedy_distinct(df, "g", [(-F.col("s")).alias("s"), F.col("i").alias("k")], "i", S.word_set("t"), 0.4, 3).orderBy("place").collect()
    assert [r.id for r in got] == [1, 3, 5]
    # a small first share must give what a plain walk of the whole group gives
    rows = [(k % 3 or None, k, f"w{k % 7} w{k % 11} w{k % 13}") for k in range(300)]
    want = []
    for g in (None, 1, 2):
        kept = []
        for _, i, t in (r for r in rows if r[0] == g):
            w = set(t.split())
            if len(kept) < 12 and all(len(w & k) / len(w | k) <= 0.2 for k in kept):
                kept.append(w)
                want.append((g, i, len(kept)))
    many = spark.createDataFrame(rows, "g long, i long, t string")
    for first in (2, 1000):
        got = folds.greedy_distinct(many, "g", [F.col("i").alias("k")], "i", S.word_set("t"), 0.2, 12, first).collect()
        assert sorted(map(str, want)) == sorted(str((r.g, r.id, r.place)) for r in got)


def test_bands_and_ties(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 2.0, 8.0, 10.0, None)], "v double")
    edges = [(float(k), float(k + 2), f"{k}") for k in range(0, 10, 2)]
    assert {r.band: r.n for r in relational.band_histogram(df, "v", edges, False).collect()} == {"0": 1, "2": 1, "4": 0, "6": 0, "8": 1}


def test_row_numbers_are_total(spark):
    df = spark.range(1000, numPartitions=7).select((F.col("id") * 7919 % 1000).alias("v"))
    assert [r.row for r in global_row_number(df, [F.asc("v")]).orderBy("v").collect()] == list(range(1, 1001))
    assert global_row_number(df.limit(0), [F.asc("v")]).count() == 0


def test_row_numbers_hold_when_columns_are_pruned(spark):
    """Adaptive plans merge partitions by their bytes, and so by the columns that are read."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst")}
    try:
        for k, v in zip(before, ("32", "64k", "false")):
            spark.conf.set(k, v)
        df = spark.range(20000, numPartitions=7).select((F.col("id") * 7919 % 20000).alias("v"), F.sha2(F.col("id").cast("string"), 512).alias("wide"))
        rows = global_row_number(df, [F.asc("v")]).where("length(wide) > 0").collect()
        assert len(rows) == 20000 and all(r.row == r.v + 1 for r in rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_tier_table_bounds(spark):
    rows = [(m, c) for m in (0, 1, 10, 11, 30, 31, 60, 61) for c in (0, 12000, 12001, 30000, 60000)]
    df = spark.createDataFrame(rows, "m long, c long")
    got = {(r.m, r.c): r.max_facts for r in joins.tier_lookup(df, "m", "c", [(0, 10, 5, 1), (11, 30, 10, 2), (31, 60, 20, 3)], [(12001, 30000, 12, 4), (30001, 60000, 25, 5)], (20, 9)).collect()}
    assert got[10, 0] == 5 and got[11, 12000] == 10 and got[11, 12001] == 12 and got[61, 30000] == 20 and got[61, 60000] == 25


def test_exact_binomial_p(spark):
    for a, b in [(0, 0), (3, 3), (9, 1), (0, 12), (40, 21)]:
        df = spark.createDataFrame([(True, False)] * a + [(False, True)] * b + [(True, True)], "a boolean, b boolean")
        p = evaluation.discordance(df, F.col("a"), F.col("b")).first().p
        n, k = a + b, min(a, b)
        want = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0
        assert abs(p - want) < 1e-9


def test_pairs_and_neighbours_by_brute_force(spark):
    import numpy as np

    r = np.random.default_rng(0)
    v = r.standard_normal((60, 5))
    v[7], v[8] = v[9], 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(60, None)], "i long, v array<double>")
    n = np.sqrt((v * v).sum(1))
    u = np.divide(v, n[:, None], out=np.zeros_like(v), where=n[:, None] > 0)
    want = {(i, j) for i, j in combinations(range(60), 2) if u[i] @ u[j] >= 0.7}
    assert {(x.a, x.b) for x in similar_pairs(df, "i", "v", 0.7, 3).collect()} == want
    got = knn(df.where("i < 5").withColumnRenamed("i", "q"), df.where("i >= 5 AND v IS NOT NULL"), "q", "i", "v", 3).collect()
    for q in range(5):
        s = sorted(range(5, 60), key=lambda i: (-(u[q] @ u[i]), i))[:3]
        assert [x.i for x in sorted((x for x in got if x.q == q), key=lambda x: x["rank"])] == s


def test_sequential_lifecycle_sees_what_it_stored(spark):
    rows = [("u", 1, "likes tea"), ("u", 2, "likes tea"), ("u", 3, "drives a red car"), ("v", 4, "likes tea")]
    df = spark.createDataFrame(rows, "k string, o long, t string")
    assert {(r.o, r.action) for r in lifecycle.audn(df, "k", "o", "t").collect()} == {(1, "ADD"), (2, "NOOP"), (3, "ADD"), (4, "ADD")}
    gone = lifecycle.audn(df, "k", "o", "t", decider=lambda a, b: "DELETE").collect()
    assert {(r.o, r.action, r.target) for r in gone if r.k == "u"} == {(1, "ADD", None), (2, "DELETE", 1), (3, "ADD", None)}


def test_retries():
    calls = []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return 7

    assert lifecycle.with_retries(call, delay=0) == 7 and len(calls) == 3
