"""Queries of provenance checks, distillation audits and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import evaluation as E
from factloom.operators import provenance as P
from factloom.operators import relational as R
from factloom.plans.registry import query
from factloom.sources.domain import ACTIVE, FACTS, PROVENANCE, active, facts, messages, provenance, table

_LAYER = r"concat('**A', doc_id % 5 + 1, '. FIRST ', doc_id, '**', chr(10), 'A statement that is long enough ', doc_id, chr(10), 'provenance: [F-', doc_id, ', F-', doc_id + 1, ']', chr(10), '## C', doc_id % 3 + 1, ' SECOND', chr(10), 'short', chr(10), 'provenance: [F-', doc_id + 2, ']')"


@query(
    "parsed_citations",
    "SELECT doc_id, 'A' || (doc_id % 5 + 1) AS claim_id, CAST(r AS INTEGER) AS rank, CAST(doc_id + r - 1 AS VARCHAR) AS fact_id FROM documents, (VALUES (1), (2)) v(r) UNION ALL SELECT doc_id, 'C' || (doc_id % 3 + 1), 1, CAST(doc_id + 2 AS VARCHAR) FROM documents",
)
def parsed_citations(spark: SparkSession, sf: str) -> DataFrame:
    """PRV-01, WIN-03, SRC-19: provenance lines under the current header."""
    return P.cited_facts(table(spark, sf, "documents").select("doc_id", F.expr(_LAYER).alias("layer")), "doc_id", "layer")


@query("parsed_claims", "SELECT doc_id, 'A' || (doc_id % 5 + 1) AS claim_id, 'FIRST ' || doc_id AS name, 'A statement that is long enough ' || doc_id AS statement FROM documents")
def parsed_claims(spark: SparkSession, sf: str) -> DataFrame:
    """PRV-02, PRV-03: claims of at least 20 characters."""
    return P.claims(table(spark, sf, "documents").select("doc_id", F.expr(_LAYER).alias("layer")), "doc_id", "layer")


_LINKS = f"{FACTS}, {PROVENANCE}, links AS (SELECT p.claim_id, p.layer, p.fact_id, f.fact_id AS found, f.category, f.predicate, f.object_text, f.temporal_state, f.recurrence, f.windowed, f.confidence FROM provenance p LEFT JOIN facts f ON p.fact_id = f.fact_id)"


def links(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf).select(F.col("fact_id").alias("found"), "category", "predicate", "object_text", "temporal_state", "recurrence", "windowed", "confidence")
    return provenance(spark, sf).select("claim_id", "layer", "fact_id").join(f, F.col("fact_id") == F.col("found"), "left")


@query("recurrence_check", f"WITH {_LINKS} SELECT claim_id, fact_id, coalesce(windowed, recurrence) >= 3 AS recurrent FROM links WHERE found IS NOT NULL")
def recurrence_check(spark: SparkSession, sf: str) -> DataFrame:
    """PRV-08."""
    return links(spark, sf).where("found IS NOT NULL").select("claim_id", "fact_id", P.recurrent(F.col("windowed"), F.col("recurrence")).alias("recurrent"))


@query("cross_domain_check", f"WITH {_LINKS} SELECT claim_id, count(DISTINCT category) >= 2 AS crosses, count(DISTINCT category) AS n FROM links GROUP BY 1")
def cross_domain_check(spark: SparkSession, sf: str) -> DataFrame:
    """PRV-09."""
    n = F.countDistinct("category")
    return links(spark, sf).groupBy("claim_id").agg((n >= 2).alias("crosses"), n.alias("n"))


_L2 = "l2 AS (SELECT claim_id || '-' || fact_id % 9 AS claim_id, predicate, category AS object_text, temporal_state FROM links WHERE found IS NOT NULL)"


@query(
    "temporal_check",
    f"""WITH {_LINKS}, {_L2}, p AS (SELECT claim_id, predicate, object_text, bool_or(temporal_state = 'current') AS n, bool_or(temporal_state = 'past') AS t, bool_or(temporal_state = 'future') AS l FROM l2 GROUP BY 1, 2, 3)
    SELECT claim_id, CAST(CASE WHEN bool_or(l) THEN 0 WHEN bool_or(n AND t) THEN -1 ELSE 1 END AS INTEGER) AS result FROM p GROUP BY 1""",
)
def temporal_check(spark: SparkSession, sf: str) -> DataFrame:
    """PRV-10."""
    l2 = links(spark, sf).where("found IS NOT NULL").select(F.concat("claim_id", F.lit("-"), (F.col("fact_id") % 9).cast("string")).alias("claim_id"), "predicate", F.col("category").alias("object_text"), "temporal_state")
    return P.temporal_result(l2)


@query(
    "contradiction_check",
    f"""WITH {PROVENANCE}, o AS (SELECT DISTINCT claim_id, fact_id FROM provenance WHERE fact_id IS NOT NULL) SELECT a.claim_id, CAST(CASE WHEN bool_or(b.fact_id IS NOT NULL) THEN 0 ELSE 1 END AS INTEGER) AS result
    FROM o a LEFT JOIN o b ON a.claim_id = b.claim_id AND b.fact_id = a.fact_id + 140 AND a.fact_id % 4 = 0 GROUP BY 1""",
)
def contradiction_check(spark: SparkSession, sf: str) -> DataFrame:
    """PRV-11."""
    succession = provenance(spark, sf).where("fact_id % 4 = 0").select("fact_id", (F.col("fact_id") + 140).alias("next")).distinct()
    return P.contradiction_result(provenance(spark, sf), succession)


@query("entailment_labels", f"WITH {PROVENANCE}, b AS (SELECT claim_id, max(CASE WHEN rank > 8 THEN similarity END) AS s FROM provenance GROUP BY 1) SELECT claim_id, CASE WHEN s IS NULL THEN 'SKIPPED' WHEN s >= 0.7 THEN 'SUPPORTED' WHEN s < 0.3 THEN 'UNSUPPORTED' ELSE 'PARTIAL' END AS label FROM b")
def entailment_labels(spark: SparkSession, sf: str) -> DataFrame:
    """PRV-12, from a score column; the scorer is pluggable."""
    best = provenance(spark, sf).groupBy("claim_id").agg(F.max(F.when(F.col("rank") > 8, F.col("similarity"))).alias("s"))
    return best.select("claim_id", P.entailment_label(F.col("s")).alias("label"))


@query(
    "expanded_questions",
    f"WITH {_LINKS} SELECT claim_id, fact_id, q AS question FROM links, (VALUES ('existence'), ('recurrence')) v(q) UNION ALL SELECT claim_id, NULL, q FROM (SELECT DISTINCT claim_id FROM links), (VALUES ('cross_domain'), ('temporal'), ('contradiction')) v(q)",
)
def expanded_questions(spark: SparkSession, sf: str) -> DataFrame:
    """PRV-06."""
    per_fact = provenance(spark, sf).select("claim_id", "fact_id", F.explode(F.array(F.lit("existence"), F.lit("recurrence"))).alias("question"))
    per_claim = provenance(spark, sf).select("claim_id").distinct().select("claim_id", F.lit(None).cast("long").alias("fact_id"), F.explode(F.array(F.lit("cross_domain"), F.lit("temporal"), F.lit("contradiction"))).alias("question"))
    return per_fact.unionByName(per_claim)


@query(
    "verification_rollup",
    f"""WITH {_LINKS}, r AS (SELECT 'existence' AS kind, CASE WHEN found IS NULL THEN 0 ELSE 1 END AS result FROM links UNION ALL SELECT 'recurrence', CASE WHEN coalesce(windowed, recurrence) IS NULL THEN -1 WHEN coalesce(windowed, recurrence) >= 3 THEN 1 ELSE 0 END FROM links)
    SELECT kind, count(*) FILTER (result = 1) AS passed, count(*) FILTER (result = 0) AS failed, count(*) FILTER (result = -1) AS warned FROM r GROUP BY 1""",
)
def verification_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-19, PRV-14."""
    l = links(spark, sf)
    rec = P.recurrent(F.col("windowed"), F.col("recurrence"))
    kinds = F.array(F.struct(F.lit("existence").alias("kind"), F.when(F.col("found").isNull(), 0).otherwise(1).alias("result")), F.struct(F.lit("recurrence").alias("kind"), F.when(rec.isNull(), -1).when(rec, 1).otherwise(0).alias("result")))
    r = l.select(F.explode(kinds).alias("x")).select("x.kind", "x.result")
    return r.groupBy("kind").agg(F.count_if(F.col("result") == 1).alias("passed"), F.count_if(F.col("result") == 0).alias("failed"), F.count_if(F.col("result") == -1).alias("warned"))


@query(
    "claim_summary",
    f"WITH {PROVENANCE} SELECT layer, claim_id, count(*) AS n, min(fact_id) AS first_fact, CAST(CASE substr(claim_id, 1, 1) WHEN 'A' THEN 0 WHEN 'M' THEN 1 WHEN 'C' THEN 2 ELSE 3 END AS INTEGER) AS place, CAST(substr(claim_id, 2) AS INTEGER) AS number FROM provenance GROUP BY 1, 2",
)
def claim_summary(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-17: ordered A, M, C, P, then by number."""
    c = provenance(spark, sf).groupBy("layer", "claim_id").agg(F.count("*").alias("n"), F.min("fact_id").alias("first_fact"))
    return c.withColumns({"place": R.ordered_choice(F.substring("claim_id", 1, 1), ["A", "M", "C"]), "number": F.substring("claim_id", 2, 9).cast("int")}).orderBy("place", "number")


@query("claim_trace", f"WITH {_LINKS} SELECT claim_id, string_agg(CAST(fact_id AS VARCHAR) || CASE WHEN found IS NULL THEN '?' ELSE ':' || predicate END, '; ' ORDER BY fact_id) AS trace FROM links WHERE fact_id IS NOT NULL GROUP BY 1")
def claim_trace(spark: SparkSession, sf: str) -> DataFrame:
    """PRV-15, API-03."""
    part = F.concat(F.col("fact_id").cast("string"), F.when(F.col("found").isNull(), "?").otherwise(F.concat(F.lit(":"), "predicate")))
    l = links(spark, sf).where("fact_id IS NOT NULL").withColumn("part", part)
    return l.groupBy("claim_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fact_id", "part"))), lambda x: x["part"]), "; ").alias("trace"))


@query("required_terms", "WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z][a-z]{7,}')) AS term FROM benchmark) SELECT term, count(d.doc_id) AS n_docs FROM t LEFT JOIN documents d ON contains(d.text, t.term) GROUP BY 1")
def required_terms(spark: SparkSession, sf: str) -> DataFrame:
    """PRV-17, JN-20: a stated set of terms looked up in all texts, the gaps with zero."""
    from factloom.operators.fulltext import term_hits

    terms = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{7,})"), F.lit(1))).alias("term")).distinct()
    hits = term_hits(table(spark, sf, "documents"), "text", terms)
    return terms.join(hits, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n_docs"))


# Distillation

_LEAVES = "leaves AS (SELECT doc_id AS leaf, [doc_id, doc_id + 1, doc_id + 2] AS ids, [doc_id, doc_id + 1, doc_id + doc_id % 5] AS fact_ids, doc_id % 4 AS d FROM documents)"


def leaves(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    verdict = F.when(i % 4 == 0, "kept").otherwise("redundant")
    m = F.when(i % 4 == 1, F.create_map(i, F.lit("contributed"))).otherwise(F.create_map(i, F.lit("contributed"), i + 1, F.lit("unused"), i + 2, verdict))
    return table(spark, sf, "documents").select(i.alias("leaf"), F.array(i, i + 1, i + 2).alias("ids"), F.array(i, i + 1, i + i % 5).alias("fact_ids"), m.alias("dispositions"))


@query("leaf_validation", f"WITH {_LEAVES} SELECT leaf, CAST(CASE WHEN leaf % 5 > 2 THEN 1 ELSE 0 END AS INTEGER) AS n_foreign, CAST(CASE WHEN d = 1 THEN 2 ELSE 0 END AS INTEGER) AS n_missing, CAST(CASE WHEN d = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_illegal FROM leaves")
def leaf_validation(spark: SparkSession, sf: str) -> DataFrame:
    """DST-01, DST-05, SET-05."""
    return E.validated_leaves(leaves(spark, sf)).select("leaf", "n_foreign", "n_missing", "n_illegal")


@query("disposition_counts", f"WITH {_LEAVES} SELECT verdict, count(*) AS n FROM (SELECT unnest(CASE WHEN d = 1 THEN ['contributed'] WHEN d = 0 THEN ['contributed', 'unused', 'kept'] ELSE ['contributed', 'unused', 'redundant'] END) AS verdict FROM leaves) GROUP BY 1")
def disposition_counts(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-25."""
    return leaves(spark, sf).select(F.explode("dispositions").alias("fact", "verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


@query("citation_audit", f"WITH {_LEAVES} SELECT leaf % 10 AS tier, count(*) * 3 AS attempted, CAST(sum(CASE WHEN leaf % 5 > 2 THEN 1 ELSE 0 END) AS BIGINT) AS fabricated, round(100.0 * (count(*) * 3 - sum(CASE WHEN leaf % 5 > 2 THEN 1 ELSE 0 END)) / greatest(1, count(*) * 3), 6) AS clean_pct FROM leaves GROUP BY 1")
def citation_audit(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-20, DST-08."""
    x = leaves(spark, sf).select((F.col("leaf") % 10).alias("tier"), F.size("fact_ids").alias("n"), F.size(F.filter("fact_ids", lambda f: ~F.array_contains("ids", f))).alias("bad"))
    n, bad = F.sum("n"), F.sum("bad")
    return x.groupBy("tier").agg(n.alias("attempted"), bad.alias("fabricated"), F.round(100.0 * (n - bad) / F.greatest(F.lit(1), n), 6).alias("clean_pct"))


_VOTES = "votes AS (SELECT doc_id % 12 + 1 AS run, doc_id * 7 % 40 AS fact FROM documents)"


def votes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select((F.col("doc_id") % 12 + 1).alias("run"), (F.col("doc_id") * 7 % 40).alias("fact"))


@query(
    "agreement_curve",
    f"""WITH {_VOTES}, v AS (SELECT n, fact, count(DISTINCT run) AS v, count(*) AS c FROM votes, (VALUES (4), (8), (12)) k(n) WHERE run <= n GROUP BY 1, 2)
    SELECT CAST(n AS BIGINT) AS n, round(sum(c) / n, 6) AS mean_size, count(*) AS "union", count(*) FILTER (v = n) AS invariant, count(*) FILTER (v >= (n + 1) // 2) AS half, count(*) FILTER (v = 1) AS once FROM v GROUP BY n""",
)
def agreement_curve(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-21, WIN-12."""
    k = spark.createDataFrame([(4,), (8,), (12,)], "n long")
    return E.agreement_curve(votes(spark, sf), k).withColumn("mean_size", F.round("mean_size", 6))


@query("majority_consensus", f"WITH {_VOTES} SELECT fact, count(DISTINCT run) AS votes, count(DISTINCT run) * 2 > 12 AS verified FROM votes GROUP BY 1")
def majority_consensus(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-22."""
    return E.majority(votes(spark, sf), 12)


@query("merged_themes", "SELECT lower(trim(source)) AS key, arg_min(source, doc_id) AS statement, CAST(count(DISTINCT doc_id % 3) AS INTEGER) AS n_facts, count(DISTINCT doc_id) AS n_leaves FROM documents GROUP BY 1")
def merged_themes(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-23."""
    t = table(spark, sf, "documents").select(F.col("doc_id").alias("leaf"), F.col("source").alias("statement"), F.array(F.col("doc_id") % 3).alias("fact_ids"))
    return E.merged_themes(t).select("key", "statement", F.size("fact_ids").alias("n_facts"), "n_leaves")


@query("singularities", "SELECT fact, min(doc_id) AS leaf FROM (SELECT doc_id, doc_id * 7 % 300 AS fact FROM documents) GROUP BY 1")
def singularities(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-24."""
    t = table(spark, sf, "documents").select(F.col("doc_id").alias("leaf"), (F.col("doc_id") * 7 % 300).alias("fact"))
    return E.first_seen(t, "fact", "leaf")


@query("verbatim_share", "SELECT lang, round(100.0 * count(*) FILTER (contains(text, substr(text, 5, 30)) AND doc_id % 3 > 0) / count(*), 6) AS exact_pct, count(*) FILTER (doc_id % 7 = 0) AS unresolved FROM documents GROUP BY 1")
def verbatim_share(spark: SparkSession, sf: str) -> DataFrame:
    """DST-06, with the unresolved counted too."""
    exact = F.contains(F.col("text"), F.substring("text", 5, 30)) & (F.col("doc_id") % 3 > 0)
    return table(spark, sf, "documents").groupBy("lang").agg(F.round(100.0 * F.count_if(exact) / F.count("*"), 6).alias("exact_pct"), F.count_if(F.col("doc_id") % 7 == 0).alias("unresolved"))


@query("experiment_grid", "SELECT layer, partition, CAST(seed AS INTEGER) AS seed FROM (VALUES ('anchors'), ('core'), ('predictions')) a(layer), (VALUES ('category'), ('predicate'), ('random')) b(partition), (VALUES (1), (2), (3)) c(seed) WHERE NOT (layer = 'core' AND seed = 2)")
def experiment_grid(spark: SparkSession, sf: str) -> DataFrame:
    """DST-09, EVL-08: a literal grid less the keys that are done."""
    rows = [(a, b, s) for a in ("anchors", "core", "predictions") for b in ("category", "predicate", "random") for s in (1, 2, 3)]
    done = spark.createDataFrame([("core", 2)], "layer string, seed int")
    return spark.createDataFrame(rows, "layer string, partition string, seed int").join(F.broadcast(done), ["layer", "seed"], "left_anti").select("layer", "partition", "seed")


@query("payload_gate", f"WITH {ACTIVE} SELECT category, CAST(sum(length(fact_text)) // 4 AS BIGINT) AS tokens, sum(length(fact_text)) // 4 > 50000 AS over FROM active GROUP BY 1")
def payload_gate(spark: SparkSession, sf: str) -> DataFrame:
    """DST-10, AGG-27."""
    t = F.floor(F.sum(F.char_length("fact_text")) / 4)
    return active(spark, sf).groupBy("category").agg(t.alias("tokens"), (t > 50000).alias("over"))


# Evaluation


@query(
    "mcnemar",
    """WITH o AS (SELECT doc_id % 3 = 0 AS a, doc_id % 5 = 0 AS b FROM documents WHERE doc_id < 200), t AS (SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b, count(*) FILTER (NOT a AND NOT b) AS neither FROM o)
    SELECT *, round(power(greatest(abs(only_a - only_b) - 1, 0), 2) / (only_a + only_b), 6) AS chi2 FROM t""",
)
def mcnemar(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-31; the exact p is tested against sums of combinations."""
    o = table(spark, sf, "documents").where("doc_id < 200")
    return E.discordance(o, F.col("doc_id") % 3 == 0, F.col("doc_id") % 5 == 0).withColumn("chi2", F.round("chi2", 6)).drop("p")


@query("dose_metrics", "WITH d AS (SELECT source, doc_id % 2 = 0 AS target, n_chars % 100 / 100.0 AS drift FROM documents), s AS (SELECT source, sum(CASE WHEN target THEN drift ELSE 0 END) AS t, sum(CASE WHEN target THEN 0 ELSE drift END) AS o FROM d GROUP BY 1) SELECT source, round(t + o, 6) AS total, round(t, 6) AS target, round(CASE WHEN o = 0 THEN 'inf'::DOUBLE ELSE t / o END, 6) AS specificity FROM s")
def dose_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-35."""
    drift = F.col("n_chars") % 100 / 100.0
    t, o = F.sum(F.when(F.col("doc_id") % 2 == 0, drift).otherwise(0.0)), F.sum(F.when(F.col("doc_id") % 2 == 0, 0.0).otherwise(drift))
    s = table(spark, sf, "documents").groupBy("source").agg(t.alias("t"), o.alias("o"))
    return s.select("source", F.round(F.col("t") + F.col("o"), 6).alias("total"), F.round("t", 6).alias("target"), F.round(F.when(F.col("o") == 0, float("inf")).otherwise(F.try_divide("t", "o")), 6).alias("specificity"))


@query("mcnemar_all")
def mcnemar_all(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-31 over all documents, with the exact p."""
    return E.discordance(table(spark, sf, "documents"), F.col("doc_id") % 3 == 0, F.col("doc_id") % 5 == 0)


@query(
    "temporal_drift",
    f"""WITH {ACTIVE}, s AS (SELECT predicate || ':' || lower(category) AS sig, bool_or(created_at < 1714435200) AS early, bool_or(created_at >= 1725000000) AS late FROM active GROUP BY 1)
    SELECT count(*) FILTER (early AND late) AS stable, count(*) FILTER (late AND NOT early) AS new, count(*) FILTER (early AND NOT late) AS dropped, round(count(*) FILTER (early AND late) / CAST(greatest(1, count(*) FILTER (early OR late)) AS DOUBLE), 3) AS stability FROM s""",
)
def temporal_drift(spark: SparkSession, sf: str) -> DataFrame:
    """EVL-03."""
    sig = F.concat("predicate", F.lit(":"), F.lower("category"))
    s = active(spark, sf).groupBy(sig.alias("sig")).agg(F.bool_or(F.col("created_at") < 1714435200).alias("e"), F.bool_or(F.col("created_at") >= 1725000000).alias("l"))
    both, either = F.count_if(F.expr("e AND l")), F.count_if(F.expr("e OR l"))
    return s.agg(both.alias("stable"), F.count_if(F.expr("l AND NOT e")).alias("new"), F.count_if(F.expr("e AND NOT l")).alias("dropped"), F.round(both / F.greatest(F.lit(1), either), 3).alias("stability"))


@query("new_vocabulary", "SELECT lang, count(*) FILTER (source IN ('src18', 'src19')) AS rows_with_new, round(100.0 * count(*) FILTER (source IN ('src18', 'src19')) / count(*), 6) AS share FROM documents GROUP BY 1")
def new_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """EVL-04: rows that carry keys the earlier vocabulary lacks."""
    known = spark.createDataFrame([(f"src{k}",) for k in range(18)], "source string")
    d = table(spark, sf, "documents").select("lang", "source")
    new = d.select("source").distinct().join(F.broadcast(known), "source", "left_anti").withColumn("is_new", F.lit(True))
    j = d.join(F.broadcast(new), "source", "left")
    n = F.count_if(F.coalesce("is_new", F.lit(False)))
    return j.groupBy("lang").agg(n.alias("rows_with_new"), F.round(100.0 * n / F.count("*"), 6).alias("share"))


@query("verdict_distribution", f"WITH {FACTS} SELECT scope, depth, count(*) AS n, round(avg(CASE WHEN superseded_by IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS false_rate FROM facts GROUP BY 1, 2")
def verdict_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """EVL-05, SRT-04."""
    bad = F.avg(F.when(F.col("superseded_by").isNotNull(), 1.0).otherwise(0.0))
    return facts(spark, sf).groupBy("scope", "depth").agg(F.count("*").alias("n"), F.round(bad, 6).alias("false_rate"))


@query("threshold_sweep", f"WITH {PROVENANCE} SELECT t.threshold, count(p.claim_id) AS n, round(100.0 * count(p.claim_id) / (SELECT count(*) FROM provenance), 6) AS share FROM (VALUES (CAST(0.4 AS DOUBLE)), (0.6), (0.8), (2.0)) t(threshold) LEFT JOIN provenance p ON p.similarity >= t.threshold GROUP BY 1")
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """EVL-02, EVL-06."""
    t = spark.createDataFrame([(0.4,), (0.6,), (0.8,), (2.0,)], "threshold double")
    return E.sweep(provenance(spark, sf), t, "similarity").withColumn("share", F.round("share", 6))


@query("rubric_means", "SELECT source AS condition, count(*) AS n, round(avg(doc_id % 3 + doc_id % 4 + doc_id % 5 + doc_id % 2), 6) AS mean_total, round(avg(doc_id % 3 + doc_id % 4), 6) AS p FROM documents WHERE doc_id % 11 <> 0 GROUP BY 1")
def rubric_means(spark: SparkSession, sf: str) -> DataFrame:
    """EVL-07: group sums per condition, parse errors excluded."""
    i = F.col("doc_id")
    s = table(spark, sf, "documents").where("doc_id % 11 <> 0").select(F.col("source").alias("condition"), (i % 3 + i % 4).alias("p"), (i % 5 + i % 2).alias("b"))
    return s.groupBy("condition").agg(F.count("*").alias("n"), F.round(F.avg(F.col("p") + F.col("b")), 6).alias("mean_total"), F.round(F.avg("p"), 6).alias("p"))


@query("brief_hit_rate", "SELECT lang, round(avg(CASE WHEN contains(lower(text), 'de') THEN 1.0 ELSE 0.0 END), 6) AS presence, round(avg(CASE WHEN contains(text, 'AKIA') THEN 0.0 ELSE 1.0 END), 6) AS absence, round(least(1.0, 500 / avg(length(text) // 4)), 6) AS efficiency FROM documents GROUP BY 1")
def brief_hit_rate(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-34."""
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    d = table(spark, sf, "documents")
    return d.groupBy("lang").agg(share(F.contains(F.lower("text"), F.lit("de"))).alias("presence"), share(~F.contains(F.col("text"), F.lit("AKIA"))).alias("absence"), F.round(F.least(F.lit(1.0), 500 / F.avg(F.floor(F.char_length("text") / 4))), 6).alias("efficiency"))


@query("next_version", "SELECT lang AS layer, max(CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER)) + 1 AS version FROM documents GROUP BY 1")
def next_version(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-11, WIN-14."""
    return table(spark, sf, "documents").groupBy(F.col("lang").alias("layer")).agg((F.max(F.regexp_extract("source", "([0-9]+)$", 1).cast("int")) + 1).alias("version"))


@query("anchor_substitution", f"WITH {PROVENANCE} SELECT p.claim_id, p.rank, coalesce(b.text, p.claim_id) AS text FROM provenance p LEFT JOIN benchmark b ON b.item_id = p.fact_id")
def anchor_substitution(spark: SparkSession, sf: str) -> DataFrame:
    """JN-19."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("fact_id"), "text")
    return provenance(spark, sf).join(b, "fact_id", "left").select("claim_id", "rank", F.coalesce("text", "claim_id").alias("text"))


@query("episode_boost", "SELECT conv_id, turn, round(0.5 * (turn % 10 / 10.0) + 0.3 * (conv_id % 7 / 7.0) + 0.2, 6) * CASE WHEN contains(lower(text), 'then') THEN 1.3 ELSE 0.7 END AS score FROM conversations")
def episode_boost(spark: SparkSession, sf: str) -> DataFrame:
    """MTH-04, MTH-06."""
    s = F.round(0.5 * (F.col("turn") % 10 / 10.0) + 0.3 * (F.col("conv_id") % 7 / 7.0) + 0.2, 6)
    return messages(spark, sf).select("conv_id", "turn", (s * F.when(F.contains(F.lower("text"), F.lit("then")), 1.3).otherwise(0.7)).alias("score"))


@query("pair_order", f"WITH {PROVENANCE} SELECT claim_id, fact_id, similarity FROM provenance WHERE fact_id IS NOT NULL ORDER BY CASE method WHEN 'cited' THEN 0 ELSE 1 END, similarity DESC, claim_id, fact_id LIMIT 40")
def pair_order(spark: SparkSession, sf: str) -> DataFrame:
    """SRT-05."""
    p = provenance(spark, sf).where("fact_id IS NOT NULL")
    return p.orderBy(F.when(F.col("method") == "cited", 0).otherwise(1), F.desc("similarity"), "claim_id", "fact_id").limit(40).select("claim_id", "fact_id", "similarity")


@query("subject_registry", f"WITH {FACTS} SELECT subject, count(*) AS n_facts, min(created_at) AS first_seen FROM facts GROUP BY 1")
def subject_registry(spark: SparkSession, sf: str) -> DataFrame:
    """API-06."""
    return facts(spark, sf).groupBy("subject").agg(F.count("*").alias("n_facts"), F.min("created_at").alias("first_seen"))

