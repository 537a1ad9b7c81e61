"""Queries of joins, set operations, conversations and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import scalars as S
from factloom.operators import joins as J
from factloom.operators import relational as R
from factloom.operators.knn import knn, similar_counts, similar_pairs
from factloom.operators.knn import pair_statistics as all_pairs
from factloom.plans.registry import query
from factloom.sources.domain import ACTIVE, FACTS, PROVENANCE, active, facts, messages, provenance, table


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    n = F.char_length("text")
    return messages(spark, sf).groupBy("conv_id").agg(F.count("*").alias("message_count"), F.sum(n).alias("total_chars"))


CONV = "conv AS (SELECT conv_id, count(*) AS message_count, CAST(sum(length(text)) AS BIGINT) AS total_chars FROM conversations GROUP BY 1)"


@query("messages_with_conversation", f"WITH {CONV} SELECT m.conv_id, m.turn, c.message_count FROM conversations m JOIN conv c ON m.conv_id = c.conv_id WHERE m.text IS NOT NULL AND length(m.text) > 10")
def messages_with_conversation(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-12, JN-01."""
    m = messages(spark, sf).where(F.col("text").isNotNull() & (F.char_length("text") > 10))
    return m.join(conversations(spark, sf), "conv_id").select("conv_id", "turn", "message_count")


@query("message_scan_sequential", "SELECT conv_id, string_agg(role || ':' || CAST(turn AS VARCHAR), ',' ORDER BY turn) AS turns FROM conversations WHERE role IN ('user', 'assistant') AND length(text) > 5 GROUP BY 1")
def message_scan_sequential(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-14."""
    m = messages(spark, sf).where(F.col("role").isin("user", "assistant") & (F.char_length("text") > 5))
    return m.groupBy("conv_id").agg(F.expr("listagg(concat(role, ':', turn), ',') WITHIN GROUP (ORDER BY turn)").alias("turns"))


@query("message_scan_batch", "SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, count(*) AS n FROM conversations GROUP BY 1")
def message_scan_batch(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-15: all roles, no floor."""
    return messages(spark, sf).groupBy("conv_id").agg(F.expr("listagg(role, ',') WITHIN GROUP (ORDER BY turn)").alias("roles"), F.count("*").alias("n"))


_LOG = "SELECT DISTINCT conv_id FROM facts WHERE fact_id % 3 = 0"


@query("unprocessed_conversations", f"WITH {FACTS}, {CONV} SELECT c.conv_id, c.message_count FROM conv c WHERE c.message_count >= 6 AND c.conv_id NOT IN ({_LOG})")
def unprocessed_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-13, SRC-11, JN-08, STM-03: the work queue as an anti-join."""
    log = facts(spark, sf).where("fact_id % 3 = 0").select("conv_id").distinct()
    return conversations(spark, sf).where("message_count >= 6").join(log, "conv_id", "left_anti").select("conv_id", "message_count")


@query("cited_coverage", f"WITH {ACTIVE}, {PROVENANCE} SELECT layer, count(DISTINCT p.fact_id) AS cited, round(count(DISTINCT p.fact_id) / CAST((SELECT count(*) FROM active) AS DOUBLE), 6) AS share FROM provenance p JOIN active a ON p.fact_id = a.fact_id GROUP BY 1")
def cited_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """JN-03, AGG-18."""
    a = active(spark, sf).select("fact_id")
    total = a.agg(F.count("*").alias("total"))
    c = provenance(spark, sf).join(a, "fact_id").groupBy("layer").agg(F.countDistinct("fact_id").alias("cited"))
    return c.join(F.broadcast(total)).select("layer", "cited", F.round(F.try_divide("cited", F.col("total").cast("double")), 6).alias("share"))


@query(
    "evidence_per_claim",
    f"""WITH {FACTS}, {PROVENANCE}, u AS (SELECT claim_id, p.fact_id, method, similarity, row_number() OVER (PARTITION BY claim_id, p.fact_id ORDER BY CASE method WHEN 'cited' THEN 0 ELSE 1 END, similarity DESC) AS first
    FROM provenance p JOIN facts f ON p.fact_id = f.fact_id), r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY similarity DESC, fact_id) AS place FROM u WHERE first = 1)
    SELECT claim_id, fact_id, method, CAST(place AS INTEGER) AS place FROM r WHERE place <= 10""",
)
def evidence_per_claim(spark: SparkSession, sf: str) -> DataFrame:
    """JN-04, WIN-03: cited before vector for the same fact, then the ten most similar."""
    p = provenance(spark, sf).join(facts(spark, sf).select("fact_id"), "fact_id")
    one = R.top_per_group(p, ["claim_id", "fact_id"], [F.when(F.col("method") == "cited", 0).otherwise(1), F.desc("similarity")], 1, "first")
    return R.top_per_group(one, ["claim_id"], [F.desc("similarity"), F.asc("fact_id")], 10, "place").select("claim_id", "fact_id", "method", "place")


@query("facts_with_conversation", f"WITH {FACTS}, {CONV} SELECT f.fact_id, c.message_count FROM facts f LEFT JOIN conv c ON f.conv_id = c.conv_id")
def facts_with_conversation(spark: SparkSession, sf: str) -> DataFrame:
    """JN-05, JN-07."""
    return facts(spark, sf).select("fact_id", "conv_id").join(conversations(spark, sf), "conv_id", "left").select("fact_id", "message_count")


@query("dangling_citations", f"WITH {FACTS}, {PROVENANCE} SELECT p.claim_id, p.fact_id, CASE WHEN f.fact_id IS NULL THEN 'not found' ELSE 'found' END AS status FROM provenance p LEFT JOIN facts f ON p.fact_id = f.fact_id")
def dangling_citations(spark: SparkSession, sf: str) -> DataFrame:
    """JN-06, PRV-07."""
    ids = facts(spark, sf).select("fact_id", F.lit("found").alias("hit"))
    return provenance(spark, sf).join(ids, "fact_id", "left").select("claim_id", "fact_id", F.coalesce("hit", F.lit("not found")).alias("status"))


@query("uncited_null_aware", f"WITH {ACTIVE}, {PROVENANCE} SELECT fact_id FROM active WHERE fact_id NOT IN (SELECT fact_id FROM provenance)")
def uncited_null_aware(spark: SparkSession, sf: str) -> DataFrame:
    """JN-09: NOT IN, which one null empties."""
    active(spark, sf).select("fact_id").createOrReplaceTempView("active_ids")
    provenance(spark, sf).select("fact_id").createOrReplaceTempView("cited_ids")
    return spark.sql("SELECT fact_id FROM active_ids WHERE fact_id NOT IN (SELECT fact_id FROM cited_ids)")


@query("uncited_anti", f"WITH {ACTIVE}, {PROVENANCE} SELECT fact_id FROM active a WHERE NOT EXISTS (SELECT 1 FROM provenance p WHERE p.fact_id = a.fact_id)")
def uncited_anti(spark: SparkSession, sf: str) -> DataFrame:
    """JN-09 without the null trap."""
    return active(spark, sf).select("fact_id").join(provenance(spark, sf), "fact_id", "left_anti")


@query("cited_semi", f"WITH {ACTIVE}, {PROVENANCE} SELECT fact_id, predicate FROM active WHERE fact_id IN (SELECT fact_id FROM provenance WHERE method = 'cited')")
def cited_semi(spark: SparkSession, sf: str) -> DataFrame:
    """JN-10."""
    return active(spark, sf).select("fact_id", "predicate").join(provenance(spark, sf).where("method = 'cited'"), "fact_id", "left_semi")


BY_MESSAGES = [(0, 10, 5, 12000), (11, 30, 10, 20000), (31, 60, 20, 30000), (61, 100000, 40, 60000)]
BY_CHARS = [(12001, 30000, 12, 30000), (30001, 60000, 25, 60000), (60001, 200000, 50, 120000), (200001, 10**9, 80, 200000)]


def _tier_sql(value: str, tiers: list[tuple], k: int) -> str:
    return "CASE " + " ".join(f"WHEN {value} BETWEEN {t[0]} AND {t[1]} THEN {t[2 + k]}" for t in tiers) + " END"


@query(
    "extraction_caps",
    f"""WITH {CONV}, m AS (SELECT conv_id, {_tier_sql('message_count', BY_MESSAGES, 0)} AS mf, {_tier_sql('message_count', BY_MESSAGES, 1)} AS mb, {_tier_sql('total_chars', BY_CHARS, 0)} AS cf, {_tier_sql('total_chars', BY_CHARS, 1)} AS cb FROM conv)
    SELECT conv_id, CASE WHEN cf > mf THEN cf ELSE mf END AS max_facts, CASE WHEN cf > mf THEN cb ELSE mb END AS input_budget FROM m""",
)
def extraction_caps(spark: SparkSession, sf: str) -> DataFrame:
    """JN-14."""
    return J.tier_lookup(conversations(spark, sf), "message_count", "total_chars", BY_MESSAGES, BY_CHARS, (20, 12000)).select("conv_id", "max_facts", "input_budget")


@query(
    "cooccurrence_edges",
    f"WITH {ACTIVE}, o AS (SELECT DISTINCT conv_id, predicate FROM active) SELECT a.predicate AS a, b.predicate AS b, count(*) AS n FROM o a JOIN o b ON a.conv_id = b.conv_id AND a.predicate < b.predicate GROUP BY 1, 2",
)
def cooccurrence_edges(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-05, JN-15."""
    return J.pair_counts(active(spark, sf), "conv_id", "predicate")


@query(
    "edge_neighbours",
    f"""WITH {ACTIVE}, o AS (SELECT DISTINCT conv_id, subject FROM active), e AS (SELECT DISTINCT a.subject AS a, b.subject AS b FROM o a JOIN o b ON a.conv_id = b.conv_id AND a.subject < b.subject)
    SELECT b AS node FROM e WHERE a IN ('me', 'user') UNION SELECT a FROM e WHERE b IN ('me', 'user')""",
)
def edge_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """JN-16, SET-01."""
    seeds = spark.createDataFrame([("me",), ("user",)], "seed string")
    return J.neighbours(J.pair_counts(active(spark, sf), "conv_id", "subject"), seeds)


@query(
    "associative_boost",
    f"""WITH {ACTIVE}, s AS (SELECT fact_id, conv_id, confidence, row_number() OVER (ORDER BY confidence DESC, fact_id) AS r FROM active), seeds AS (SELECT fact_id, conv_id FROM s WHERE r <= 10)
    SELECT fact_id, round(CASE WHEN r > 10 AND conv_id IN (SELECT conv_id FROM seeds) THEN confidence * 1.2 ELSE confidence END, 6) AS score FROM s""",
)
def associative_boost(spark: SparkSession, sf: str) -> DataFrame:
    """MTH-05: neighbours of the first ten retrieved, not the seeds themselves."""
    a = active(spark, sf).select("fact_id", "conv_id", "confidence")
    seeds = a.orderBy(F.desc("confidence"), "fact_id").limit(10)
    near = seeds.select("conv_id", F.lit(1).alias("near")).distinct()
    own = seeds.select("fact_id", F.lit(1).alias("own"))
    j = a.join(F.broadcast(near), "conv_id", "left").join(F.broadcast(own), "fact_id", "left")
    return j.select("fact_id", F.round(F.when(F.col("near").isNotNull() & F.col("own").isNull(), F.col("confidence") * 1.2).otherwise(F.col("confidence")), 6).alias("score"))


_HIT = "contains(lower(text), 'the')"


@query(
    "context_window",
    f"SELECT conv_id, turn FROM (SELECT conv_id, turn, max(CASE WHEN {_HIT} AND turn % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM conversations) WHERE near = 1",
)
def context_window(spark: SparkSession, sf: str) -> DataFrame:
    """JN-17: a match with its two neighbours on either side."""
    hit = F.contains(F.lower("text"), F.lit("the")) & (F.col("turn") % 3 == 0)
    return J.around(messages(spark, sf), "conv_id", "turn", hit, 2).select("conv_id", "turn")


@query(
    "context_frame",
    "SELECT conv_id, turn, array_to_string(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), '>') AS frame FROM conversations",
)
def context_frame(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-07."""
    return R.context_frame(messages(spark, sf), ["conv_id"], [F.col("turn")], F.col("role"), 1).select("conv_id", "turn", F.array_join("context", ">").alias("frame"))


@query(
    "character_budget",
    "SELECT conv_id, turn FROM (SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations) WHERE before <= 1500",
)
def character_budget(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-11."""
    return R.within_budget(messages(spark, sf), ["conv_id"], [F.col("turn")], F.char_length("text"), 1500).select("conv_id", "turn")


@query("user_text_having", "SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations WHERE role = 'user' GROUP BY 1 HAVING sum(length(text)) > 200")
def user_text_having(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-28."""
    u = messages(spark, sf).where("role = 'user'").groupBy("conv_id").agg(F.expr("listagg(text, '\\n') WITHIN GROUP (ORDER BY turn)").alias("t"), F.sum(F.char_length("text")).alias("n"))
    return u.where("n > 200").select("conv_id", F.md5("t").alias("digest"))


@query("first_conversations", f"WITH {ACTIVE} SELECT conv_id, best FROM (SELECT conv_id, min(fact_id) AS best FROM active WHERE confidence > 0.5 GROUP BY 1) ORDER BY best LIMIT 20")
def first_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-10."""
    return active(spark, sf).where("confidence > 0.5").groupBy("conv_id").agg(F.min("fact_id").alias("best")).orderBy("best").limit(20)


@query("pending_cost", f"""WITH {CONV} SELECT p.model, CAST(sum(total_chars) // 4 AS BIGINT) AS tokens_in, CAST(200 * count(*) AS BIGINT) AS tokens_out, round((sum(total_chars) // 4) * p.price_in / 1e6 + 200 * count(*) * p.price_out / 1e6, 9) AS cost
    FROM conv, (VALUES ('small', 0.25, 1.25), ('large', 3.0, 15.0)) p(model, price_in, price_out) GROUP BY p.model, p.price_in, p.price_out""")
def pending_cost(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-05: one total against a price table."""
    total = conversations(spark, sf).agg(F.floor(F.sum("total_chars") / 4).alias("tokens_in"), (200 * F.count("*")).alias("tokens_out"))
    prices = spark.createDataFrame([("small", 0.25, 1.25), ("large", 3.0, 15.0)], "model string, price_in double, price_out double")
    return total.join(F.broadcast(prices)).select("model", "tokens_in", "tokens_out", F.round(F.col("tokens_in") * F.col("price_in") / 1e6 + F.col("tokens_out") * F.col("price_out") / 1e6, 9).alias("cost"))


@query("extraction_log_upsert", f"WITH {FACTS} SELECT conv_id, CAST(sum(recurrence) AS BIGINT) AS facts_extracted, max(created_at) AS processed_at FROM facts GROUP BY 1")
def extraction_log_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-06: sum of counts, latest time."""
    return facts(spark, sf).groupBy("conv_id").agg(F.sum("recurrence").alias("facts_extracted"), F.max("created_at").alias("processed_at"))


@query("first_wins_dedup", "SELECT md5(text) AS k, min(doc_id) AS doc_id FROM documents GROUP BY text")
def first_wins_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-01, DUP-05: exact dedup, the first id wins; grouped by digest so texts are not shuffled."""
    return table(spark, sf, "documents").select(F.md5("text").alias("k"), "doc_id").groupBy("k").agg(F.min("doc_id").alias("doc_id"))


@query("forget_survivors", f"WITH {FACTS} SELECT fact_id, coalesce(superseded_by, CASE WHEN fact_id % 10 = 0 OR conv_id = 5 THEN 'user_forget' END) AS superseded_by FROM facts")
def forget_survivors(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-03, SNK-04: soft delete by id and by conversation."""
    gone = (F.col("fact_id") % 10 == 0) | (F.col("conv_id") == 5)
    return facts(spark, sf).select("fact_id", F.coalesce("superseded_by", F.when(gone, "user_forget")).alias("superseded_by"))


@query("reset_survivors", f"WITH {FACTS} SELECT fact_id FROM facts WHERE source IN ('src0', 'src1')")
def reset_survivors(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-16, SNK-22: rows of protected sources outlive a reset."""
    return facts(spark, sf).where(F.col("source").isin("src0", "src1")).select("fact_id")


@query("identity_priority", f"WITH {FACTS} SELECT scope, fact_id FROM (SELECT scope, fact_id, row_number() OVER (PARTITION BY scope ORDER BY CASE depth WHEN 'conviction' THEN 0 WHEN 'position' THEN 1 ELSE 2 END, created_at DESC, fact_id) AS r FROM facts) WHERE r = 1")
def identity_priority(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-23: one row by priority, then the latest."""
    best = F.min_by("fact_id", F.struct(R.ordered_choice("depth", ["conviction", "position"]), -F.col("created_at"), "fact_id"))
    return facts(spark, sf).groupBy("scope").agg(best.alias("fact_id"))


@query("batches_of_fifty", f"WITH {ACTIVE} SELECT fact_id, CAST((row_number() OVER (ORDER BY recurrence DESC, fact_id) - 1) // 50 AS BIGINT) AS batch, round(greatest(0.3 * confidence, 0.1), 6) AS decayed FROM active")
def batches_of_fifty(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-19, WIN-13."""
    a = active(spark, sf).select("fact_id", "recurrence", "confidence")
    return R.chunk_numbers(a, [F.desc("recurrence"), F.asc("fact_id")], 50, "batch").select("fact_id", "batch", F.round(F.greatest(0.3 * F.col("confidence"), F.lit(0.1)), 6).alias("decayed"))


@query(
    "provenance_replace",
    f"WITH {PROVENANCE} SELECT claim_id, fact_id, method, CAST(row_number() OVER (PARTITION BY claim_id, method ORDER BY similarity DESC, fact_id NULLS FIRST) AS INTEGER) AS place FROM provenance WHERE NOT (layer = 'CORE' AND method = 'vector')",
)
def provenance_replace(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-08, SNK-09, SNK-14: one (layer, method) partition goes, the rest are ranked anew."""
    p = provenance(spark, sf).where("NOT (layer = 'CORE' AND method = 'vector')")
    w = Window.partitionBy("claim_id", "method").orderBy(F.desc("similarity"), F.asc_nulls_first("fact_id"))
    return p.select("claim_id", "fact_id", "method", F.row_number().over(w).alias("place"))


# Sets


@query(
    "retrieval_precision_recall",
    f"""WITH {PROVENANCE}, c AS (SELECT claim_id, list(DISTINCT fact_id) FILTER (method = 'cited' AND fact_id IS NOT NULL) AS a, list(DISTINCT fact_id) FILTER (method = 'vector' AND fact_id IS NOT NULL AND fact_id % 2 = 0) AS b FROM provenance GROUP BY 1)
    SELECT claim_id, round(len(list_intersect(coalesce(a, []), coalesce(b, []))) / CAST(greatest(1, len(coalesce(b, []))) AS DOUBLE), 6) AS precision, round(len(list_intersect(coalesce(a, []), coalesce(b, []))) / CAST(greatest(1, len(coalesce(a, []))) AS DOUBLE), 6) AS recall FROM c""",
)
def retrieval_precision_recall(spark: SparkSession, sf: str) -> DataFrame:
    """SET-02, PRV-04."""
    c = provenance(spark, sf).groupBy("claim_id").agg(
        F.collect_set(F.when(F.col("method") == "cited", F.col("fact_id"))).alias("a"), F.collect_set(F.when((F.col("method") == "vector") & (F.col("fact_id") % 2 == 0), F.col("fact_id"))).alias("b")
    )
    both = F.size(F.array_intersect("a", "b"))
    share = lambda of: F.round(both / F.greatest(F.lit(1), F.size(of)), 6)
    return c.select("claim_id", share("b").alias("precision"), share("a").alias("recall"))


@query(
    "set_partition",
    f"""WITH {FACTS}, a AS (SELECT DISTINCT predicate FROM facts WHERE lang = 'fr'), b AS (SELECT DISTINCT predicate FROM facts WHERE lang = 'es') SELECT coalesce(a.predicate, b.predicate) AS predicate,
    CASE WHEN a.predicate IS NULL THEN 'only b' WHEN b.predicate IS NULL THEN 'only a' ELSE 'both' END AS part FROM a FULL JOIN b ON a.predicate = b.predicate""",
)
def set_partition(spark: SparkSession, sf: str) -> DataFrame:
    """SET-05, SET-06: one pass of flags instead of a full join."""
    f = facts(spark, sf).where("lang IN ('fr', 'es')").groupBy("predicate").agg(F.bool_or(F.col("lang") == "fr").alias("a"), F.bool_or(F.col("lang") == "es").alias("b"))
    return f.select("predicate", F.when(~F.col("a"), "only b").when(~F.col("b"), "only a").otherwise("both").alias("part"))


@query("theme_bag_union", "SELECT 'run1' AS run, lang AS theme FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'run2', lang FROM documents WHERE doc_id % 3 = 0")
def theme_bag_union(spark: SparkSession, sf: str) -> DataFrame:
    """SET-04: bag union tagged by run."""
    d = table(spark, sf, "documents")
    return d.where("doc_id % 2 = 0").select(F.lit("run1").alias("run"), F.col("lang").alias("theme")).unionByName(d.where("doc_id % 3 = 0").select(F.lit("run2").alias("run"), F.col("lang").alias("theme")))


@query(
    "benchmark_jaccard",
    r"""WITH w AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS s FROM benchmark)
    SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.s, b.s)) / CAST(greatest(1, len(list_distinct(list_concat(a.s, b.s)))) AS DOUBLE), 6) AS overlap FROM w a JOIN w b ON a.item_id < b.item_id WHERE len(list_intersect(a.s, b.s)) > 0""",
)
def benchmark_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """SET-03: overlap of word sets by a join on shared words."""
    w = table(spark, sf, "benchmark").select("item_id", S.word_set("text").alias("s"))
    x = w.select("item_id", F.size("s").alias("n"), F.explode("s").alias("word"))
    a, b = x.toDF("a", "na", "word"), x.toDF("b", "nb", "word")
    both = a.join(b, "word").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("n"))
    return both.select("a", "b", F.round(F.col("n") / (F.col("na") + F.col("nb") - F.col("n")), 6).alias("overlap"))


# Vectors

_DOT = "list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))"


@query(
    "vector_top_k",
    f"""SELECT claim_id, vec_id, CAST(rank AS INTEGER) AS rank FROM (SELECT a.vec_id AS claim_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DOT} DESC, b.vec_id) AS rank
    FROM embeddings a, embeddings b WHERE a.vec_id < 20 AND b.vec_id >= 20) WHERE rank <= 10""",
)
def vector_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """JN-13, VEC-04, PRV-05: each claim's ten nearest facts."""
    e = table(spark, sf, "embeddings")
    claims = e.where("vec_id < 20").select(F.col("vec_id").alias("claim_id"), "embedding")
    return knn(claims, e.where("vec_id >= 20"), "claim_id", "vec_id", "embedding", 10).select("claim_id", "vec_id", "rank")


@query("filtered_vector_top_k", f"""SELECT claim_id, vec_id, CAST(rank AS INTEGER) AS rank FROM (SELECT a.vec_id AS claim_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DOT} DESC, b.vec_id) AS rank
    FROM embeddings a, embeddings b WHERE a.vec_id < 5 AND b.vec_id >= 20 AND b.label IN (1, 2, 3)) WHERE rank <= 5""")
def filtered_vector_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-21, VEC-06: the predicate goes before the search."""
    e = table(spark, sf, "embeddings")
    claims = e.where("vec_id < 5").select(F.col("vec_id").alias("claim_id"), "embedding")
    return knn(claims, e.where("vec_id >= 20 AND label IN (1, 2, 3)"), "claim_id", "vec_id", "embedding", 5).select("claim_id", "vec_id", "rank")


@query("vector_top_k_all")
def vector_top_k_all(spark: SparkSession, sf: str) -> DataFrame:
    """JN-13, VEC-04, PRV-05: the ten nearest of all rows for every row whose id 50 divides."""
    e = table(spark, sf, "embeddings")
    claims = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("claim_id"), "embedding")
    return knn(claims, e, "claim_id", "vec_id", "embedding", 10).select("claim_id", "vec_id", "rank")


@query("filtered_vector_top_k_all")
def filtered_vector_top_k_all(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-21, VEC-06: the same queries, five nearest, the predicate before the search."""
    e = table(spark, sf, "embeddings")
    claims = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("claim_id"), "embedding")
    return knn(claims, e.where("label IN (1, 2, 3)"), "claim_id", "vec_id", "embedding", 5).select("claim_id", "vec_id", "rank")


@query("candidate_pairs", f"""SELECT a.vec_id AS a, b.vec_id AS b, CASE WHEN a.label = b.label THEN CAST(a.label AS VARCHAR) ELSE least(a.label, b.label) || '/' || greatest(a.label, b.label) END AS labels
    FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_DOT} >= 0.5""")
def candidate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """JN-11, VEC-03, VEC-05, AGG-09: pairs at or above the threshold."""
    e = table(spark, sf, "embeddings")
    pairs = similar_pairs(e, "vec_id", "embedding", 0.5)
    la, lb = e.select(F.col("vec_id").alias("a"), F.col("label").alias("la")), e.select(F.col("vec_id").alias("b"), F.col("label").alias("lb"))
    kind = F.when(F.col("la") == F.col("lb"), F.col("la").cast("string")).otherwise(F.concat(F.least("la", "lb").cast("string"), F.lit("/"), F.greatest("la", "lb").cast("string")))
    return pairs.join(la, "a").join(lb, "b").select("a", "b", kind.alias("labels"))


@query("pair_sweep", f"""SELECT t.threshold, count(p.s) AS n FROM (VALUES (CAST(0.2 AS DOUBLE)), (0.3), (0.4)) t(threshold) LEFT JOIN (SELECT {_DOT} AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) p ON p.s >= t.threshold GROUP BY 1""")
def pair_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """EVL-02: one search serves all thresholds; its pairs are counted, not listed."""
    thresholds = (0.2, 0.3, 0.4)
    t = spark.createDataFrame([(h,) for h in thresholds], "threshold double")
    found = similar_counts(table(spark, sf, "embeddings"), "vec_id", "embedding", thresholds).select("threshold", "n")
    return t.join(F.broadcast(found), "threshold", "left").select("threshold", F.coalesce("n", F.lit(0)).alias("n"))


@query("labelled_pairs", f"SELECT a.label, count(*) AS n FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_DOT} >= 0.5 GROUP BY 1")
def labelled_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """JN-12, EVL-02: only rows of equal labels are compared; the pairs are counted, not listed."""
    found = similar_counts(table(spark, sf, "embeddings"), "vec_id", "embedding", (0.5,), group="label")
    return found.select(F.col("g").alias("label"), "n")


@query("best_match", f"""WITH m AS (SELECT a.vec_id AS new_id, b.vec_id AS old_id, {_DOT} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DOT} DESC, b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id % 2 = 1 AND b.vec_id % 2 = 0)
    SELECT new_id, old_id, s >= 0.6 AS matched FROM m WHERE r = 1""")
def best_match(spark: SparkSession, sf: str) -> DataFrame:
    """JN-18."""
    e = table(spark, sf, "embeddings")
    new, old = e.where("vec_id % 2 = 1").select(F.col("vec_id").alias("new_id"), "embedding"), e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("old_id"), "embedding")
    return knn(new, old, "new_id", "old_id", "embedding", 1).select("new_id", "old_id", (F.col("similarity") >= 0.6).alias("matched"))


@query("pair_statistics", f"""WITH p AS (SELECT {_DOT} AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label = b.label) SELECT count(*) AS n, round(avg(s), 6) AS mean, round(median(s), 6) AS median, round(stddev_pop(s), 6) AS sd, round(min(s), 6) AS least, round(max(s), 6) AS most, count(*) FILTER (s >= 0.8) AS over_80, round(1 - avg(s), 6) AS divergence FROM p""")
def pair_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-26, AGG-37: statistics of similarity within labels."""
    s = all_pairs(table(spark, sf, "embeddings"), "vec_id", "embedding", (0.8,), group="label")
    row = (s["n"], *[s[k] for k in ("mean", "median", "sd", "least", "most")], *s["over"], None if s["mean"] is None else 1 - s["mean"])
    one = spark.createDataFrame([row], "n long, mean double, median double, sd double, least double, most double, over_80 long, divergence double")
    return one.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "sd", "least", "most")], "over_80", F.round("divergence", 6).alias("divergence"))


@query("pair_statistics_all")
def pair_statistics_all(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-26, AGG-37: statistics of similarity of all pairs, whatever their labels."""
    s = all_pairs(table(spark, sf, "embeddings"), "vec_id", "embedding", (0.8, 0.85, 0.9, 0.95))
    numbers = [s[k] for k in ("mean", "median", "sd", "least", "most")]
    row = (s["n"], *numbers, *s["over"], None if s["mean"] is None else 1 - s["mean"])
    return spark.createDataFrame([row], "n long, mean double, median double, sd double, least double, most double, over_80 long, over_85 long, over_90 long, over_95 long, divergence double")


@query("probe_delta", f"SELECT a.vec_id, round(1 - {_DOT}, 4) AS delta FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def probe_delta(spark: SparkSession, sf: str) -> DataFrame:
    """VEC-02, VEC-07."""
    e = table(spark, sf, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(1 - S.cosine("embedding", "other"), 4).alias("delta"))


@query("routing_of_candidates", f"""WITH m AS (SELECT a.vec_id, max({_DOT}) AS s FROM embeddings a JOIN embeddings b ON b.vec_id < 300 AND a.vec_id >= 300 GROUP BY 1) SELECT vec_id, CASE WHEN s > 0.85 THEN 'decide' WHEN s >= 0.3 THEN 'add .6' ELSE 'add .8' END AS route FROM m""")
def routing_of_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """DUP-01: what happens to a candidate by its nearest stored fact."""
    e = table(spark, sf, "embeddings")
    near = knn(e.where("vec_id >= 300"), e.where("vec_id < 300").select(F.col("vec_id").alias("old_id"), "embedding"), "vec_id", "old_id", "embedding", 1)
    s = F.col("similarity")
    return near.select("vec_id", F.when(s > 0.85, "decide").when(s >= 0.3, "add .6").otherwise("add .8").alias("route"))


@query("routing_of_candidates_all")
def routing_of_candidates_all(spark: SparkSession, sf: str) -> DataFrame:
    """DUP-01: the same of every row whose id 50 divides, by its nearest of all other rows."""
    e = table(spark, sf, "embeddings")
    near = knn(e.where("vec_id % 50 = 0"), e.select(F.col("vec_id").alias("old_id"), "embedding"), "vec_id", "old_id", "embedding", 2)
    s = F.col("similarity")
    best = near.where("vec_id <> old_id").groupBy("vec_id").agg(F.max("similarity").alias("similarity"))
    return best.select("vec_id", F.when(s > 0.85, "decide").when(s >= 0.3, "add .6").otherwise("add .8").alias("route"))


@query("distance_conversion", "SELECT vec_id, vec_id % 21 / 10.0 AS d, round(greatest(0.0, least(1.0, 1 - vec_id % 21 / 10.0)), 4) AS cosine, round(CASE WHEN vec_id % 21 = 0 THEN 1.0 ELSE greatest(0.0, least(1.0, 1 - (vec_id % 21 / 10.0) * (vec_id % 21 / 10.0) / 2)) END, 4) AS l2 FROM embeddings")
def distance_conversion(spark: SparkSession, sf: str) -> DataFrame:
    """MTH-08, MTH-09."""
    d = F.col("vec_id") % 21 / 10.0
    return table(spark, sf, "embeddings").select("vec_id", d.alias("d"), F.round(S.similarity_of(d, "cosine"), 4).alias("cosine"), F.round(S.similarity_of(d, "l2"), 4).alias("l2"))
