"""Queries over facts: filters, orders, counts, bands, caps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import scalars as S
from factloom.functions import vocabulary as V
from factloom.operators import relational as R
from factloom.plans.registry import query
from factloom.sources.domain import ACTIVE, FACTS, NOW, active, facts

TIER_ORDER = ["identity", "situational", "context"]
DEPTH_ORDER = ["conviction", "position", "preference", "factual"]
_TIER_SQL = "CASE tier WHEN 'identity' THEN 0 WHEN 'situational' THEN 1 WHEN 'context' THEN 2 ELSE 3 END"
_DEPTH_SQL = "CASE depth WHEN 'conviction' THEN 0 WHEN 'position' THEN 1 WHEN 'preference' THEN 2 WHEN 'factual' THEN 3 ELSE 4 END"


def _in(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


@query(
    "top_facts_per_category",
    f"""WITH {ACTIVE}, ranked AS (SELECT category, fact_id, predicate, {_TIER_SQL} AS tier_place, recurrence,
    row_number() OVER (PARTITION BY category ORDER BY {_TIER_SQL}, recurrence DESC, fact_id) AS rank,
    count(*) OVER (PARTITION BY category, predicate) AS predicate_facts FROM active)
    SELECT category, CAST(rank AS INTEGER) AS rank, fact_id, predicate, CAST(tier_place AS INTEGER) AS tier_place, recurrence, predicate_facts FROM ranked WHERE rank <= 15""",
)
def top_facts_per_category(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-01, SRT-01, WIN-01, AGG-01: active facts, tier order, 15 per category, predicate counts."""
    counted = active(spark, sf).select("category", "fact_id", "predicate", R.ordered_choice("tier", TIER_ORDER).alias("tier_place"), "recurrence")
    top = R.top_per_group(counted, ["category"], [F.asc("tier_place"), F.desc("recurrence"), F.asc("fact_id")], 15)
    per = counted.groupBy("category", "predicate").agg(F.count("*").alias("predicate_facts"))
    return top.join(per, ["category", "predicate"]).select("category", "rank", "fact_id", "predicate", "tier_place", "recurrence", "predicate_facts")


for _key, _default in [("source", None), ("category", None), ("subject", None), ("tier", None), ("temporal_state", None), ("fact_class", None), ("predicate", None), ("depth", None), ("scope", None), ("superseded_by", "active")]:

    def _counts(spark: SparkSession, sf: str, key: str = _key, default: str | None = _default) -> DataFrame:
        """AGG-01."""
        return R.group_counts(facts(spark, sf), key, default)

    _expr = _key if _default is None else f"coalesce({_key}, '{_default}')"
    query(f"count_by_{_key}", f"WITH {FACTS} SELECT {_expr} AS {_key}, count(*) AS n FROM facts GROUP BY 1")(_counts)


@query(
    "tiered_facts_filter",
    f"WITH {ACTIVE} SELECT fact_id, predicate, confidence FROM active WHERE scope = 'personal' AND tier = 'identity' AND depth IN ('conviction', 'position')",
)
def tiered_facts_filter(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-02."""
    return active(spark, sf).where("scope = 'personal' AND tier = 'identity' AND depth IN ('conviction', 'position')").select("fact_id", "predicate", "confidence")


@query(
    "layer_routing",
    f"""WITH {ACTIVE} SELECT CASE WHEN predicate IN {_in(V.ANCHOR_PREDICATES)} THEN 'anchors' WHEN predicate IN {_in(V.PREDICTION_PREDICATES)} THEN 'predictions'
    WHEN predicate IN {_in(V.BIOGRAPHY_PREDICATES)} THEN 'biography' ELSE 'preference' END AS layer, count(*) AS n, count(DISTINCT predicate) AS n_predicates FROM active GROUP BY 1""",
)
def layer_routing(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-03, AGG-03."""
    return active(spark, sf).groupBy(S.routed_layer("predicate").alias("layer")).agg(F.count("*").alias("n"), F.countDistinct("predicate").alias("n_predicates"))


_WORDS = ["license", "password", "token = ", "idiot"]


@query("exclusion_filter", f"WITH {FACTS} SELECT fact_id FROM facts WHERE NOT ({' OR '.join(f'''contains(lower(fact_text), '{w}')''' for w in _WORDS)})")
def exclusion_filter(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-04, FLT-05, FLT-08: text without any of the literals."""
    return facts(spark, sf).where(~S.contains_any("fact_text", _WORDS)).select("fact_id")


@query("like_search", f"WITH {FACTS} SELECT fact_id FROM facts WHERE contains(lower(fact_text), '2.0') OR contains(lower(fact_text), '100%_sure') OR contains(lower(fact_text), 'by-nc')")
def like_search(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-09: LIKE whose wildcards are literal."""
    t = facts(spark, sf)
    return t.where(S.like_contains("fact_text", "2.0") | S.like_contains("fact_text", "100%_sure") | S.like_contains("fact_text", "By-NC")).select("fact_id")


@query(
    "fulltext_all_terms",
    """SELECT doc_id FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents)
    WHERE term IN ('the', 'of', 'is') GROUP BY doc_id HAVING count(DISTINCT term) = 3""",
)
def fulltext_all_terms(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-10, JN-02, SNK-21: AND of terms over a token index."""
    from factloom.operators.fulltext import match_all, token_index
    from factloom.sources.domain import table

    return match_all(token_index(table(spark, sf, "documents"), "doc_id", "text"), ["the", "of", "is"], "doc_id")


@query(
    "review_filter",
    f"WITH {ACTIVE} SELECT fact_id, tier, confidence FROM active WHERE tier = 'identity' AND confidence < 0.5 ORDER BY confidence DESC, fact_id LIMIT 20",
)
def review_filter(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-11: conditions composed as columns."""
    wanted = {"tier": "identity", "below": 0.5}
    where = F.lit(True)
    if wanted.get("tier"):
        where &= F.col("tier") == wanted["tier"]
    if wanted.get("below"):
        where &= F.col("confidence") < wanted["below"]
    return active(spark, sf).where(where).orderBy(F.desc("confidence"), "fact_id").limit(20).select("fact_id", "tier", "confidence")


@query("pruned_projection", f"WITH {FACTS} SELECT substr(md5(CAST(fact_id AS VARCHAR)), 1, 8) AS short_id, predicate, round(confidence, 2) AS confidence FROM facts")
def pruned_projection(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-17, HSH-01: superseded facts stay here."""
    return facts(spark, sf).select(F.substring(F.md5(F.col("fact_id").cast("string")), 1, 8).alias("short_id"), "predicate", F.round("confidence", 2).alias("confidence"))


@query("noncanonical_predicates", f"WITH {FACTS} SELECT source AS predicate, count(*) AS n FROM facts WHERE source NOT IN {_in(V.PREDICATES)} GROUP BY 1")
def noncanonical_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-16."""
    return facts(spark, sf).where(~F.col("source").isin(V.PREDICATES)).groupBy(F.col("source").alias("predicate")).agg(F.count("*").alias("n"))


@query(
    "status_counts",
    f"""WITH {FACTS} SELECT count(*) FILTER (superseded_by IS NULL) AS active, count(*) FILTER (superseded_by IS NOT NULL) AS superseded,
    count(*) FILTER (significance IS NOT NULL) AS scored, count(*) FILTER (predicate <> 'unknown') AS structured, count(DISTINCT source) AS sources, count(DISTINCT predicate) AS predicates FROM facts""",
)
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-02, AGG-03 in one pass."""
    one = lambda c: F.count_if(F.expr(c))
    return facts(spark, sf).agg(
        one("superseded_by IS NULL").alias("active"), one("superseded_by IS NOT NULL").alias("superseded"), one("significance IS NOT NULL").alias("scored"),
        one("predicate <> 'unknown'").alias("structured"), F.countDistinct("source").alias("sources"), F.countDistinct("predicate").alias("predicates"),
    )


_REC = [(0, 0, "0"), (1, 5, "1-5"), (6, 15, "6-15"), (16, 30, "16-30"), (31, 50, "31-50"), (51, None, "51+")]


def _bands_sql(value: str, edges: list, closed: bool, view: str) -> str:
    rows = ", ".join(f"({k}, '{e[2]}', CAST({'NULL' if e[0] is None else e[0]} AS DOUBLE), CAST({'NULL' if e[1] is None else e[1]} AS DOUBLE))" for k, e in enumerate(edges))
    op = "<=" if closed else "<"
    return f"""SELECT CAST(b.place AS INTEGER) AS place, b.band, count(f.fact_id) AS n FROM (VALUES {rows}) b(place, band, lo, hi)
    LEFT JOIN {view} f ON (b.lo IS NULL OR f.{value} >= b.lo) AND (b.hi IS NULL OR f.{value} {op} b.hi) AND f.{value} IS NOT NULL GROUP BY 1, 2"""


@query("recurrence_histogram", f"WITH {ACTIVE} " + _bands_sql("recurrence", _REC, True, "active"))
def recurrence_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-06."""
    return R.band_histogram(active(spark, sf), "recurrence", _REC, True)


_SCORE = [(float(k), float(k + 2), f"{k}-{k + 2}") for k in range(0, 10, 2)]


@query("significance_bands", f"WITH {ACTIVE} " + _bands_sql("significance", _SCORE, False, "active"))
def significance_bands(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-07: half-open; a score of exactly 10 falls in none."""
    return R.band_histogram(active(spark, sf), "significance", _SCORE, False)


@query(
    "confidence_bands",
    f"WITH {ACTIVE} SELECT count(*) FILTER (confidence >= 0.8) AS high, count(*) FILTER (confidence >= 0.5 AND confidence < 0.8) AS middle, count(*) FILTER (confidence < 0.5) AS low FROM active",
)
def confidence_bands(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-08."""
    return R.flag_counts(active(spark, sf), high="confidence >= 0.8", middle="confidence >= 0.5 AND confidence < 0.8", low="confidence < 0.5")


@query(
    "length_profile",
    f"WITH {ACTIVE} SELECT avg(length(fact_text)) AS avg_chars, count(*) FILTER (length(fact_text) < 200) AS short, count(*) FILTER (length(fact_text) > 2000) AS long FROM active",
)
def length_profile(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-10."""
    n = F.char_length("fact_text")
    return active(spark, sf).agg(F.avg(n).alias("avg_chars"), F.count_if(n < 200).alias("short"), F.count_if(n > 2000).alias("long"))


@query(
    "predicate_category_share",
    f"""WITH {ACTIVE} SELECT predicate, category, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY category), 1) AS share FROM active GROUP BY 1, 2""",
)
def predicate_category_share(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-11."""
    n = active(spark, sf).groupBy("predicate", "category").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("category")), 1))


@query(
    "signal_profile",
    f"""WITH {ACTIVE}, s AS (SELECT 100.0 * count(*) FILTER (predicate IN ('believes', 'values')) / count(*) AS conviction, 100.0 * count(*) FILTER (predicate IN ('builds', 'manages', 'practices')) / count(*) AS action,
    100.0 * count(*) FILTER (predicate IN ('conflicts_with', 'fears', 'struggles_with')) / count(*) AS tension FROM active)
    SELECT *, CASE WHEN tension < 5 THEN 'few tensions' WHEN action > conviction THEN 'led by action' ELSE 'led by conviction' END AS note FROM s""",
)
def signal_profile(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-12."""
    share = lambda *ps: 100.0 * F.count_if(F.col("predicate").isin(*ps)) / F.count("*")
    s = active(spark, sf).agg(
        share("believes", "values").alias("conviction"), share("builds", "manages", "practices").alias("action"), share("conflicts_with", "fears", "struggles_with").alias("tension")
    )
    return s.withColumn("note", F.when(F.col("tension") < 5, "few tensions").when(F.col("action") > F.col("conviction"), "led by action").otherwise("led by conviction"))


@query(
    "behavioural_gate",
    f"""WITH {ACTIVE}, c AS (SELECT count(*) FILTER (tier = 'identity') AS n_identity, count(*) FILTER (predicate IN ('avoids', 'practices')) AS n_behavioural FROM active)
    SELECT n_identity, n_behavioural, n_identity >= 20 AND (n_behavioural < 5 OR n_behavioural < 0.05 * n_identity) AS anomalous FROM c""",
)
def behavioural_gate(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-13."""
    c = R.flag_counts(active(spark, sf), n_identity="tier = 'identity'", n_behavioural="predicate IN ('avoids', 'practices')")
    return c.withColumn("anomalous", F.expr("n_identity >= 20 AND (n_behavioural < 5 OR n_behavioural < 0.05 * n_identity)"))


@query(
    "single_domain_test",
    f"""WITH {ACTIVE}, c AS (SELECT category, count(*) AS n FROM active GROUP BY 1) SELECT sum(n)::BIGINT AS total, max(n) AS largest, CASE WHEN sum(n) < 5 THEN 'thin' WHEN max(n) > 0.8 * sum(n) THEN 'single' ELSE 'mixed' END AS verdict FROM c""",
)
def single_domain_test(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-14."""
    c = active(spark, sf).groupBy("category").agg(F.count("*").alias("n")).agg(F.sum("n").alias("total"), F.max("n").alias("largest"))
    return c.withColumn("verdict", F.when(F.col("total") < 5, "thin").when(F.col("largest") > 0.8 * F.col("total"), "single").otherwise("mixed"))


@query(
    "modal_subject",
    f"""WITH {ACTIVE}, c AS (SELECT category, subject, count(*) AS n FROM active WHERE subject NOT IN ('me', 'user') GROUP BY 1, 2 HAVING count(*) >= 3)
    SELECT category, subject, n FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, subject) AS r FROM c) WHERE r = 1""",
)
def modal_subject(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-15: mode with support of three, pronouns aside."""
    c = active(spark, sf).where(~F.col("subject").isin("me", "user")).groupBy("category", "subject").agg(F.count("*").alias("n")).where("n >= 3")
    best = c.groupBy("category").agg(F.min(F.struct((-F.col("n")).alias("m"), "subject")).alias("b"))
    return best.select("category", "b.subject", (-F.col("b.m")).alias("n"))


@query(
    "entropy_profile",
    f"""WITH {ACTIVE}, c AS (SELECT category, predicate, count(*) AS n FROM active GROUP BY 1, 2), p AS (SELECT category, n, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY category) AS p FROM c)
    SELECT category, count(*) AS kinds, round(CASE WHEN count(*) > 1 THEN 1 + sum(p * log2(p)) / log2(count(*)) ELSE 1.0 END, 6) AS consistency, round(least(1.0, count(*) / 46.0), 6) AS breadth FROM p GROUP BY 1""",
)
def entropy_profile(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-16: consistency is one less the normalised Shannon entropy; saturating axes."""
    c = active(spark, sf).groupBy("category", "predicate").agg(F.count("*").alias("n"))
    p = c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("category")))
    k = F.count("*")
    score = F.when(k > 1, 1 + F.sum(F.col("p") * F.log2("p")) / F.log2(k.cast("double"))).otherwise(1.0)
    return p.groupBy("category").agg(k.alias("kinds"), F.round(score, 6).alias("consistency"), F.round(F.least(F.lit(1.0), k / 46.0), 6).alias("breadth"))


@query("fact_floor", f"WITH {ACTIVE} SELECT count(*) FILTER (tier = 'identity') >= 50 AS identity_ok, count(DISTINCT predicate) >= 15 AS predicates_ok, count(DISTINCT source) >= 5 AS sources_ok FROM active")
def fact_floor(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-33, API-07."""
    return active(spark, sf).agg(
        (F.count_if(F.col("tier") == "identity") >= 50).alias("identity_ok"), (F.countDistinct("predicate") >= 15).alias("predicates_ok"), (F.countDistinct("source") >= 5).alias("sources_ok")
    )


@query("date_range", f"WITH {FACTS} SELECT scope, strftime(make_timestamp(min(created_at) * 1000000), '%Y-%m-%d') AS first_day, strftime(make_timestamp(max(created_at) * 1000000), '%Y-%m') AS last_month FROM facts GROUP BY 1")
def date_range(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-29, DT-01."""
    day = lambda c, f: F.date_format(F.timestamp_seconds(c), f)
    return facts(spark, sf).groupBy("scope").agg(day(F.min("created_at"), "yyyy-MM-dd").alias("first_day"), day(F.max("created_at"), "yyyy-MM").alias("last_month"))


@query(
    "low_yield_guard",
    f"""WITH {FACTS} SELECT source, count(*) AS n_facts, CAST(sum(length(fact_text)) AS BIGINT) AS n_chars, count(*) < 2.2 * sum(length(fact_text)) / 10000.0 AS low_yield FROM facts GROUP BY 1""",
)
def low_yield_guard(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-32, AGG-04."""
    n = F.sum(F.char_length("fact_text"))
    return facts(spark, sf).groupBy("source").agg(F.count("*").alias("n_facts"), n.alias("n_chars"), (F.count("*") < 2.2 * n / 10000.0).alias("low_yield"))


# Orders and limits


def _top(name: str, by: str, cols: Callable[[], list], sql_order: str, n: int) -> None:
    @query(name, f"WITH {ACTIVE} SELECT fact_id, {by} FROM active ORDER BY {sql_order} LIMIT {n}")
    def top(spark: SparkSession, sf: str) -> DataFrame:
        """SRT-01 to SRT-06: a top-k over a custom order."""
        return active(spark, sf).orderBy(*cols()).limit(n).select("fact_id", by)


_top("order_by_tier", "tier", lambda: [R.ordered_choice("tier", TIER_ORDER), F.desc("recurrence"), F.asc("fact_id")], f"{_TIER_SQL}, recurrence DESC, fact_id", 100)
_top("order_by_depth", "depth", lambda: [R.ordered_choice("depth", DEPTH_ORDER), F.desc("recurrence"), F.asc("fact_id")], f"{_DEPTH_SQL}, recurrence DESC, fact_id", 100)
_top("order_identity_first", "predicate", lambda: [F.when(F.col("predicate") == "identifies_as", 0).otherwise(1), F.desc("recurrence"), F.asc("fact_id")], "CASE WHEN predicate = 'identifies_as' THEN 0 ELSE 1 END, recurrence DESC, fact_id", 60)
_top("top_by_confidence", "confidence", lambda: [F.desc("confidence"), F.asc("fact_id")], "confidence DESC, fact_id", 50)
_top("latest_inserted", "predicate", lambda: [F.desc("fact_id")], "fact_id DESC", 30)


@query(
    "adaptive_limit",
    f"""WITH {ACTIVE}, n AS (SELECT CASE WHEN count(*) FILTER (tier = 'identity') >= 200 THEN 300 ELSE 100 END AS most FROM active)
    SELECT fact_id, CAST(r AS INTEGER) AS rank FROM (SELECT fact_id, row_number() OVER (ORDER BY recurrence DESC, fact_id) AS r FROM active), n WHERE r <= most""",
)
def adaptive_limit(spark: SparkSession, sf: str) -> DataFrame:
    """SRT-08: a limit that depends on the data; the larger one bounds the sort."""
    a = active(spark, sf)
    most = a.agg(F.when(F.count_if(F.col("tier") == "identity") >= 200, 300).otherwise(100).alias("most"))
    top = a.orderBy(F.desc("recurrence"), "fact_id").limit(300)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("recurrence"), F.asc("fact_id"))))
    return ranked.join(F.broadcast(most), F.col("rank") <= F.col("most")).select("fact_id", "rank")


@query("category_display_order", f"WITH {ACTIVE} SELECT category, CAST(CASE category WHEN 'value' THEN 1 WHEN 'goal' THEN 2 WHEN 'biography' THEN 3 ELSE 99 END AS INTEGER) AS place, count(*) AS n FROM active GROUP BY 1, 2")
def category_display_order(spark: SparkSession, sf: str) -> DataFrame:
    """SRT-10."""
    place = F.coalesce(S.lookup({"value": "1", "goal": "2", "biography": "3"}, F.col("category")).cast("int"), F.lit(99))
    return active(spark, sf).groupBy("category", place.alias("place")).agg(F.count("*").alias("n")).orderBy("place", "category")


# Windows and caps


@query(
    "conversation_fact_cap",
    f"""WITH {ACTIVE} SELECT conv_id, fact_id, CAST(r AS INTEGER) AS rank FROM (SELECT conv_id, fact_id, row_number() OVER (PARTITION BY conv_id ORDER BY confidence DESC, fact_id) AS r FROM active) WHERE r <= 3""",
)
def conversation_fact_cap(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-15, WIN-09."""
    return R.top_per_group(active(spark, sf).select("conv_id", "fact_id", "confidence"), ["conv_id"], [F.desc("confidence"), F.asc("fact_id")], 3).select("conv_id", "fact_id", "rank")


_DOMAINS = {"alpha": ["then", "with"], "beta": ["eau", "ment"]}


@query(
    "domain_cap",
    f"""WITH {ACTIVE}, tagged AS (SELECT fact_id, recurrence, d FROM active, (VALUES ('alpha', 'then', 'with'), ('beta', 'eau', 'ment')) v(d, a, b) WHERE contains(lower(fact_text), a) OR contains(lower(fact_text), b)),
    ranked AS (SELECT fact_id, row_number() OVER (PARTITION BY d ORDER BY recurrence DESC, fact_id) AS r FROM tagged),
    gone AS (SELECT DISTINCT fact_id FROM ranked WHERE r > (SELECT greatest(1, floor(count(*) * 25 / 100.0)) FROM active))
    SELECT fact_id FROM active WHERE fact_id NOT IN (SELECT fact_id FROM gone)""",
)
def domain_cap(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-02."""
    return R.domain_cap(active(spark, sf), _DOMAINS, "fact_text", "fact_id", [F.desc("recurrence"), F.asc("fact_id")], 25).select("fact_id")


for _name, _order in [("predicate", ["predicate"]), ("category", ["category"]), ("predcat", ["predicate", "category"]), ("time", ["created_at"])]:

    def _chunked(spark: SparkSession, sf: str, order: list[str] = _order) -> DataFrame:
        """WIN-04, WIN-13: equal chunks of a total order."""
        cols = active(spark, sf).select("fact_id", *order)
        return R.chunk_numbers(cols, [F.asc_nulls_last(c) for c in [*order, "fact_id"]], 60).select("fact_id", "chunk")

    query(f"chunk_by_{_name}", f"WITH {ACTIVE} SELECT fact_id, (row_number() OVER (ORDER BY {', '.join(_order)}, fact_id) - 1) // 60 AS chunk FROM active")(_chunked)


@query("chunk_random_order")
def chunk_random_order(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-05: a seeded hash order, the null arm of the partition strategies."""
    return R.chunk_numbers(active(spark, sf).select("fact_id"), [F.xxhash64("fact_id", F.lit(42)), F.col("fact_id")], 60)


@query("random_sample")
def random_sample(spark: SparkSession, sf: str) -> DataFrame:
    """SRT-07: a seeded sample of 20."""
    return active(spark, sf).orderBy(F.xxhash64("fact_id", F.lit(7))).limit(20).select("fact_id")


# Scores


@query(
    "confidence_score",
    f"""WITH {FACTS} SELECT fact_id, round(greatest(least(0.20 * greatest(least(confidence, 1.0), 0.0) + 0.30 * CASE WHEN predicate IN ('studies', 'learned') THEN 0.7 WHEN predicate IN ('experienced', 'lost', 'founded', 'graduated_from', 'raised_in') THEN 0.6 ELSE 1.0 END
    + 0.25 * CASE WHEN subject = 'user' THEN 1.0 ELSE 0.5 END + 0.25 * least(recurrence / 30.0, 1.0), 1.0), 0.0), 6) AS confidence FROM facts""",
)
def confidence_score(spark: SparkSession, sf: str) -> DataFrame:
    """MTH-01, STR-09."""
    score = S.confidence(F.col("confidence"), S.predicate_intent("predicate"), F.col("subject"), F.col("recurrence"))
    return facts(spark, sf).select("fact_id", F.round(score, 6).alias("confidence"))


@query(
    "importance_recency_blend",
    f"""WITH {ACTIVE}, s AS (SELECT fact_id, least((0.7 * coalesce(significance, 0) + 0.3 * least(ln(coalesce(recurrence, 0) + 1) / ln(300.0) * 10, 10.0)) / 10, 1.0) AS importance,
    greatest(0.0, 1 - ({NOW} - created_at) / 86400.0 / 1100) AS recency, confidence FROM active)
    SELECT fact_id, round(importance, 6) AS importance, round(recency, 6) AS recency, round(0.55 * confidence + 0.35 * importance + 0.10 * recency, 6) AS score FROM s""",
)
def importance_recency_blend(spark: SparkSession, sf: str) -> DataFrame:
    """MTH-02, MTH-03, MTH-04."""
    s = active(spark, sf).select("fact_id", "confidence", S.importance(F.col("significance"), F.col("recurrence")).alias("i"), S.recency(F.col("created_at"), NOW).alias("r"))
    return s.select("fact_id", F.round("i", 6).alias("importance"), F.round("r", 6).alias("recency"), F.round(0.55 * F.col("confidence") + 0.35 * F.col("i") + 0.10 * F.col("r"), 6).alias("score"))


@query(
    "as_of_marks",
    f"""WITH {FACTS} SELECT fact_id, CASE WHEN temporal_state = 'past' THEN '[past] ' ELSE '' END || '(' || subject || ')' || CASE WHEN fact_class IN ('state', 'unclassified') AND temporal_state <> 'past'
    AND ({NOW} - created_at) / 86400.0 > 240 THEN ' (as of ' || strftime(make_timestamp(created_at * 1000000), '%Y-%m') || ')' ELSE '' END AS mark FROM facts""",
)
def as_of_marks(spark: SparkSession, sf: str) -> DataFrame:
    """DT-02."""
    suffix = S.as_of_suffix(F.col("fact_class"), F.col("temporal_state"), F.col("created_at"), NOW)
    past = F.when(F.col("temporal_state") == "past", "[past] ").otherwise("")
    return facts(spark, sf).select("fact_id", F.concat(past, F.lit("("), "subject", F.lit(")"), suffix).alias("mark"))
