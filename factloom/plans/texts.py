"""Queries of scalar functions, texts, chunks and dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import scalars as S
from factloom.functions import vocabulary as V
from factloom.operators import folds
from factloom.plans.registry import query
from factloom.sources.domain import ACTIVE, FACTS, active, facts, messages, table

RAW = sorted({*V.ALIASES, *V.PREDICATES[:6], *[v for g in (V.INTENTS, V.TEMPORAL, V.FACT_CLASSES, V.TIERS) for vs in g.values() for v in vs], *V.CATEGORY_SYNONYMS, "Works At", " grew up in ", "", "goals", "no such thing"})


def _raw(i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in RAW]), (i % len(RAW) + 1).cast("int"))


_RAW = "raw AS (SELECT doc_id, [" + ", ".join("'" + v.replace("'", "''") + "'" for v in RAW) + f"][CAST(doc_id % {len(RAW)} + 1 AS INTEGER)] AS r, lower(trim(r)) AS f FROM documents)"


def _case(values: dict[str, str], key: str, default: str) -> str:
    q = lambda v: "'" + v.replace("'", "''") + "'"
    return f"CASE {key} " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in values.items()) + f" ELSE {default} END"


def _normal(name: str, f, sql: str) -> None:
    @query(f"normalize_{name}", f"WITH {_RAW} SELECT doc_id, {sql} AS value FROM raw")
    def normal(spark: SparkSession, sf: str) -> DataFrame:
        """STR-01, STR-03 to STR-07: a written value to its canonical form."""
        return table(spark, sf, "documents").select("doc_id", f(_raw(F.col("doc_id"))).alias("value"))


_normal("category", S.normalize_category, _case({v: v for v in V.CATEGORIES} | {v + "s": v for v in V.CATEGORIES} | V.CATEGORY_SYNONYMS, "f", "'unknown'"))
_normal("intent", S.normalize_intent, _case(V.inverted(V.INTENTS), "f", "'does'"))
_normal("temporal", S.normalize_temporal, _case(V.inverted(V.TEMPORAL), "f", "'unknown'"))
_normal("fact_class", S.normalize_fact_class, _case(V.inverted(V.FACT_CLASSES), "f", "'unclassified'"))
_normal("tier", S.normalize_tier, _case(V.inverted(V.TIERS), "f", "'untiered'"))
_OWN = "(" + ", ".join(f"'{v}'" for v in V.PREDICATES) + ")"
_normal("predicate", S.normalize_predicate, f"CASE WHEN r = '' THEN 'unknown' WHEN f IN {_OWN} THEN f ELSE coalesce({_case(V.ALIASES, 'f', 'NULL')}, CASE WHEN replace(f, ' ', '_') IN {_OWN} THEN replace(f, ' ', '_') END, f) END")


@query(
    "normalize_subject",
    f"""WITH {FACTS}, s AS (SELECT fact_id, lower(trim(subject)) AS s FROM facts) SELECT fact_id, CASE WHEN s IN ('', 'i', 'me', 'myself', 'user', 'the user') THEN 'user' WHEN regexp_matches(s, '\\b(wife|husband|spouse|partner)\\b') THEN 'spouse'
    WHEN regexp_matches(s, '\\bpets\\b') THEN 'pets' WHEN regexp_matches(s, '\\b(dog|cat|pet)\\b') THEN 'pet' WHEN regexp_matches(s, '\\b(inc|llc|ltd|company|corp)\\b') THEN 'company' WHEN regexp_matches(s, '\\bfriend\\b') THEN 'friend:' || trim(regexp_replace(s, '^.*\\bfriend\\b', ''))
    WHEN regexp_matches(s, '\\bcolleague\\b') THEN 'colleague:' || trim(regexp_replace(s, '^.*\\bcolleague\\b', '')) ELSE s END AS value FROM s""",
)
def normalize_subject(spark: SparkSession, sf: str) -> DataFrame:
    """STR-02."""
    return facts(spark, sf).select("fact_id", S.normalize_subject("subject").alias("value"))


@query(
    "fact_sentences",
    f"WITH {FACTS} SELECT fact_id, trim(subject || ' ' || replace(predicate, '_', ' ') || ' ' || object_text) AS sentence, CASE WHEN tier = 'contextual' THEN CASE WHEN predicate IN ({', '.join(repr(p) for p in V.IDENTITY_PREDICATES)}) THEN 'identity' ELSE 'contextual' END ELSE tier END AS tier, CASE WHEN source = 'claude_code' THEN 'project' ELSE 'personal' END AS scope FROM facts",
)
def fact_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """STR-08, STR-10, STR-11."""
    untiered = F.when(F.col("tier") != "contextual", F.col("tier"))
    return facts(spark, sf).select("fact_id", S.fact_sentence("subject", "predicate", "object_text").alias("sentence"), S.tier_by_predicate(untiered, "predicate").alias("tier"), S.scope_of("source").alias("scope"))


@query("anonymised", r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\bthen with\b', 'USER', 'g'), '(?i)\b(then|with)\b', 'USER', 'g'), 'USER(\s+USER)+', 'USER', 'g')) AS digest FROM documents WHERE lang = 'en'")
def anonymised(spark: SparkSession, sf: str) -> DataFrame:
    """STR-12."""
    return table(spark, sf, "documents").where("lang = 'en'").select("doc_id", F.md5(S.anonymise("text", "then with")).alias("digest"))


_CITED = "concat('Claim ', doc_id, ' [F-0a1b2c3d, F-00ff00ff] holds (A', doc_id % 4 + 1, '-A', doc_id % 4 + 3, ', M2) and C', doc_id % 7, '.')"


@query("strip_citations", rf"SELECT doc_id, regexp_replace(regexp_replace({_CITED}, '\s*\[F-[0-9a-f, F-]+\]', '', 'g'), '\s*\(([ACMP][0-9]+(-[ACMP]?[0-9]+)?(, ?)?)+\)', '', 'g') AS text FROM documents")
def strip_citations(spark: SparkSession, sf: str) -> DataFrame:
    """STR-13, SNK-12."""
    return table(spark, sf, "documents").select("doc_id", S.strip_citations(F.expr(_CITED)).alias("text"))


@query("citation_codes", f"""WITH t AS (SELECT doc_id, doc_id % 4 + 1 AS a, doc_id % 7 AS c FROM documents), e AS (SELECT doc_id, unnest(['A' || a, 'A' || (a + 1), 'A' || (a + 2), 'C2', 'C' || c]) AS code FROM t) SELECT doc_id, code, 1 AS one FROM (SELECT DISTINCT * FROM e)""")
def citation_codes(spark: SparkSession, sf: str) -> DataFrame:
    """STR-14: ranges give each code, M counts as C."""
    return table(spark, sf, "documents").select("doc_id", F.explode(S.citation_codes(F.expr(_CITED))).alias("code"), F.lit(1).alias("one"))


@query(
    "truncated_texts",
    """WITH t AS (SELECT doc_id, text, substr(text, 1, 200) AS h FROM documents), p AS (SELECT *, greatest(CASE WHEN instr(reverse(h), '.') > 0 THEN 200 - instr(reverse(h), '.') ELSE -1 END, CASE WHEN instr(reverse(h), chr(10)) > 0 THEN 200 - instr(reverse(h), chr(10)) ELSE -1 END) AS pos FROM t)
    SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN pos > 100 THEN substr(h, 1, pos + 1) ELSE h END AS text FROM p""",
)
def truncated_texts(spark: SparkSession, sf: str) -> DataFrame:
    """STR-15."""
    return table(spark, sf, "documents").select("doc_id", S.truncated("text", 200).alias("text"))


@query(
    "session_declarations",
    """WITH t AS (SELECT conv_id, turn, text, instr(lower(text), 'the ') AS pos FROM conversations WHERE role = 'user'), s AS (SELECT conv_id, turn, substr(text, pos, 100) AS s FROM t WHERE pos > 0),
    c AS (SELECT conv_id, turn, CASE WHEN instr(s, '.') > 0 THEN substr(s, 1, instr(s, '.') - 1) WHEN instr(s, '!') > 0 THEN substr(s, 1, instr(s, '!') - 1) WHEN instr(s, '?') > 0 THEN substr(s, 1, instr(s, '?') - 1) WHEN instr(s, chr(10)) > 0 THEN substr(s, 1, instr(s, chr(10)) - 1) ELSE s END AS snippet FROM s)
    SELECT conv_id, turn, trim(snippet) AS snippet FROM c WHERE length(trim(snippet)) > 15""",
)
def session_declarations(spark: SparkSession, sf: str) -> DataFrame:
    """STR-16: a snippet after a trigger, cut at the first mark in order of marks."""
    at = F.instr(F.lower("text"), "the ")
    s = messages(spark, sf).where("role = 'user'").where(at > 0).withColumn("s", F.substr("text", at, F.lit(100)))
    cut = F.col("s")
    for mark in reversed([".", "!", "?", "\n"]):
        cut = F.when(F.instr("s", mark) > 0, F.substr("s", F.lit(1), F.instr("s", mark) - 1)).otherwise(cut)
    return s.select("conv_id", "turn", F.trim(cut).alias("snippet")).where(F.char_length("snippet") > 15)


@query("prompt_contamination", "SELECT doc_id, array_to_string(list_filter(['license', 'password', 'AKIA'], lambda w: contains(text, w)), ',') AS found FROM documents")
def prompt_contamination(spark: SparkSession, sf: str) -> DataFrame:
    """STR-17, FLT-15."""
    words = F.array(*[F.lit(w) for w in ("license", "password", "AKIA")])
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.filter(words, lambda w: F.contains(F.col("text"), w)), ",").alias("found"))


@query(
    "spec_counts",
    r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Z]{2,}')) AS INTEGER) AS capitals, CAST(len(regexp_extract_all(text, '[^\s]+')) AS INTEGER) AS n_words, CAST(len(list_filter(string_split_regex(text, '[.!?]'), lambda s: regexp_matches(lower(s), '(^|[^a-z])(he|she|they)([^a-z]|$)'))) AS INTEGER) AS third_person FROM documents",
)
def spec_counts(spark: SparkSession, sf: str) -> DataFrame:
    """STR-19, STR-20, STR-21, STR-22, AGG-36: counts of patterns."""
    third = F.size(F.filter(F.split("text", r"[.!?]"), lambda s: F.lower(s).rlike("(^|[^a-z])(he|she|they)([^a-z]|$)")))
    return table(spark, sf, "documents").select("doc_id", F.regexp_count("text", F.lit("[A-Z]{2,}")).alias("capitals"), F.regexp_count("text", F.lit(r"[^\s]+")).alias("n_words"), third.alias("third_person"))


@query("token_budget", "SELECT doc_id, length(text) // 4 AS tokens, least(length(text) // 4, 250) AS given, greatest(0, length(text) // 4 - 250) AS overflow FROM documents")
def token_budget(spark: SparkSession, sf: str) -> DataFrame:
    """MTH-07."""
    t = F.floor(F.char_length("text") / 4)
    return table(spark, sf, "documents").select("doc_id", t.alias("tokens"), F.least(t, F.lit(250)).alias("given"), F.greatest(F.lit(0), t - 250).alias("overflow"))


_NOISE = "concat(text, ' ', repeat('ACGT', doc_id % 20), ' ', repeat('0a', doc_id % 30), ' ', repeat('12,', doc_id % 50))"


@query("stripped_noise")
def stripped_noise(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-13; its cases are in the tests."""
    return table(spark, sf, "documents").select("doc_id", S.strip_noise(F.expr(_NOISE)).alias("text"))


@query(
    "project_abstraction",
    r"""WITH m AS (SELECT conv_id, turn, role, regexp_replace(regexp_replace(text, '(?s)```.*?```', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM conversations WHERE role IN ('user', 'assistant'))
    SELECT conv_id, md5(string_agg(CASE WHEN role = 'user' OR length(t) <= 120 THEN t ELSE substr(split_part(t, chr(10), 1), 1, 60) || ' [...]' END, chr(10) ORDER BY turn)) AS digest FROM m GROUP BY 1""",
)
def project_abstraction(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-14: code blocks out, long assistant turns to their first line."""
    t = F.regexp_replace(F.regexp_replace("text", r"(?s)```.*?```", ""), r"\n{3,}", "\n\n")
    short = F.when((F.col("role") == "user") | (F.char_length("t") <= 120), F.col("t")).otherwise(F.concat(F.substring(F.split_part("t", F.lit("\n"), F.lit(1)), 1, 60), F.lit(" [...]")))
    m = messages(spark, sf).where("role IN ('user', 'assistant')").withColumn("t", t).withColumn("s", short)
    return m.groupBy("conv_id").agg(F.md5(F.expr("listagg(s, '\\n') WITHIN GROUP (ORDER BY turn)")).alias("digest"))


@query("correction_block", "SELECT doc_id FROM documents WHERE NOT (contains(lower(text), 'gnu general') OR contains(lower(text), 'apache'))")
def correction_block(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-06, SRC-16: patterns read from a JSON list block a candidate."""
    patterns = spark.createDataFrame([('["GNU General", "Apache"]',), ("not json",)], "patterns string")
    parsed = patterns.select(F.explode(F.from_json("patterns", "array<string>")).alias("p")).select(F.lower("p").alias("p"))
    docs = table(spark, sf, "documents")
    return docs.join(F.broadcast(parsed), F.contains(F.lower("text"), F.col("p")), "left_anti").select("doc_id")


@query(
    "validated_candidates",
    f"WITH {FACTS}, r AS (SELECT conv_id, fact_id, confidence, object_text, fact_text, row_number() OVER (PARTITION BY conv_id ORDER BY fact_id) AS pos FROM facts) SELECT conv_id, fact_id FROM r WHERE pos <= 8 AND confidence >= 0.3 AND length(object_text) >= 3 AND length(fact_text) >= 10",
)
def validated_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-07: the cap goes before the filters."""
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("fact_id"))
    f = facts(spark, sf).select("conv_id", "fact_id", "confidence", "object_text", F.char_length("fact_text").alias("n")).withColumn("pos", pos)
    return f.where("pos <= 8 AND confidence >= 0.3 AND length(object_text) >= 3 AND n >= 10").select("conv_id", "fact_id")


@query(
    "citation_prefixes",
    f"WITH ids AS (SELECT md5(CAST(doc_id AS VARCHAR)) AS id FROM documents), p AS (SELECT substr(id, 1, 8) AS prefix, min(id) AS id, count(*) AS n FROM ids GROUP BY 1) SELECT c.cite, coalesce(p.id, c.cite) AS resolved FROM (SELECT substr(md5(CAST(vec_id AS VARCHAR)), 1, 8) AS cite FROM embeddings UNION ALL SELECT 'zzzzzzzz' UNION ALL SELECT md5('1')) c LEFT JOIN p ON p.prefix = c.cite AND p.n = 1",
)
def citation_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-12, DST-04: a unique 8-letter prefix becomes the whole id, others pass."""
    ids = table(spark, sf, "documents").select(F.md5(F.col("doc_id").cast("string")).alias("id"))
    one = ids.groupBy(F.substring("id", 1, 8).alias("prefix")).agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1")
    cites = table(spark, sf, "embeddings").select(F.substring(F.md5(F.col("vec_id").cast("string")), 1, 8).alias("cite"))
    cites = cites.union(spark.range(1).select(F.lit("zzzzzzzz"))).union(spark.range(1).select(F.md5(F.lit("1"))))
    return cites.join(one, F.col("prefix") == F.col("cite"), "left").select("cite", F.coalesce("id", "cite").alias("resolved"))


@query("coerced_times", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1704067200.0 + event_id WHEN 1 THEN 1704067200.0 + event_id WHEN 2 THEN epoch(date_trunc('second', ts)) * 1.0 END AS seconds FROM events")
def coerced_times(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-05: milliseconds, seconds, ISO text, and what is none of them."""
    e = table(spark, sf, "events")
    base = F.lit(1704067200) + F.col("event_id")
    iso = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    raw = F.when(F.col("event_id") % 4 == 0, (base * 1000).cast("string")).when(F.col("event_id") % 4 == 1, base.cast("string")).when(F.col("event_id") % 4 == 2, iso).otherwise("soon")
    return e.withColumn("raw", raw).select("event_id", S.coerced_seconds("raw").alias("seconds"))


@query("text_file_ids", "SELECT doc_id, 'textfile_' || source || '_' || substr(md5(source || '/' || CAST(doc_id AS VARCHAR)), 1, 8) AS id FROM documents WHERE length(trim(text)) >= 50")
def text_file_ids(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-08, HSH-01: the length floor and the id's digest."""
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").where(F.char_length(F.trim("text")) >= 50).select("doc_id", F.concat(F.lit("textfile_"), "source", F.lit("_"), F.substring(F.md5(path), 1, 8)).alias("id"))


@query("source_documents", "SELECT CAST(row_number() OVER (ORDER BY title, doc_id) AS BIGINT) AS place, doc_id, title FROM (SELECT doc_id, substr(text, 1, 12) AS title FROM documents) QUALIFY row_number() OVER (PARTITION BY title ORDER BY doc_id) = 1")
def source_documents(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-22: running numbers over all rows, then the first of each title."""
    from factloom.operators.ranking import global_row_number

    t = table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 12).alias("title"))
    numbered = global_row_number(t, [F.asc_nulls_last("title"), F.asc("doc_id")], "place")
    return numbered.groupBy("title").agg(F.min_by("doc_id", "place").alias("doc_id"), F.min("place").alias("place")).select("place", "doc_id", "title")


@query("tolerant_json", "SELECT event_id, json_valid(props) AS valid, CAST(json_extract_string(props, '$.page') AS VARCHAR) AS page FROM events")
def tolerant_json(spark: SparkSession, sf: str) -> DataFrame:
    """JSN-01, JSN-03: trailing commas and text around the object are forgiven."""
    noisy = F.concat(F.lit("note: "), F.regexp_replace("props", r"\}$", ",}"), F.lit(" end"))
    return table(spark, sf, "events").select("event_id", S.tolerant_json(noisy).isNotNull().alias("valid"), F.get_json_object("props", "$.page").alias("page"))


@query("ordered_distinct", "SELECT conv_id, array_to_string(list(role ORDER BY first), ',') AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2) GROUP BY 1")
def ordered_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """ARR-01."""
    m = messages(spark, sf).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("r"))
    return m.select("conv_id", F.array_join(F.array_distinct("r"), ",").alias("roles"))


@query("block_ranges", "SELECT item_id, unnest(range(item_id, item_id + item_id % 4)) AS block FROM benchmark")
def block_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """ARR-02, PRV-16: start..end-1 to ids; an empty range gives none."""
    b = table(spark, sf, "benchmark").where("item_id % 4 > 0")
    return b.select("item_id", F.explode(F.sequence("item_id", F.col("item_id") + F.col("item_id") % 4 - 1)).alias("block"))


@query("source_fingerprint", "SELECT lang, md5(string_agg(md5(text) || ':' || CAST(n_chars AS VARCHAR), '|' ORDER BY md5(text), n_chars)) AS digest, substr(sha256(string_agg(CAST(doc_id AS VARCHAR), '|' ORDER BY doc_id)), 1, 16) AS ids_hash FROM documents GROUP BY 1")
def source_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-38, AGG-39: digests over sorted parts."""
    d = table(spark, sf, "documents").select("lang", "doc_id", F.concat(F.md5("text"), F.lit(":"), F.col("n_chars").cast("string")).alias("part"), F.struct(F.md5("text").alias("m"), "n_chars").alias("k"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x["part"])
    ids = F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string"))
    return d.groupBy("lang").agg(F.md5(F.array_join(parts, "|")).alias("digest"), F.substring(F.sha2(F.array_join(ids, "|"), 256), 1, 16).alias("ids_hash"))


@query("document_blocks", f"WITH {ACTIVE} SELECT fact_id, CAST(row_number() OVER (ORDER BY fact_id) AS INTEGER) || '. [F-' || substr(md5(CAST(fact_id AS VARCHAR)), 1, 8) || '] ' || substr(fact_text, 1, 40) AS line FROM active ORDER BY fact_id LIMIT 100")
def document_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """CHK-05."""
    top = active(spark, sf).orderBy("fact_id").limit(100)
    n = F.row_number().over(Window.orderBy("fact_id")).cast("string")
    return top.select("fact_id", F.concat(n, F.lit(". [F-"), F.substring(F.md5(F.col("fact_id").cast("string")), 1, 8), F.lit("] "), F.substring("fact_text", 1, 40)).alias("line"))


@query("sentence_chunks", r"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents), n AS (SELECT doc_id, len(s) AS n FROM s WHERE len(s) > 0)
    SELECT doc_id, CAST(greatest(0, ceil((n - 2) / 13.0) - 1) + 1 AS INTEGER) AS n_chunks FROM n""")
def sentence_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """CHK-03."""
    return table(spark, sf, "documents").select("doc_id", F.size(folds.sentence_chunks(F.col("text"))).alias("n_chunks")).where("n_chunks > 0")


@query("paragraph_chunks")
def paragraph_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """CHK-01, CHK-02, CHK-04: chunks with their number, of all."""
    c = table(spark, sf, "documents").select("doc_id", folds.packed_paragraphs(F.col("text"), 2000, 100, "\n").alias("chunks"))
    x = c.select("doc_id", F.size("chunks").alias("n"), F.posexplode("chunks").alias("i", "chunk"))
    return x.select(F.concat(F.col("doc_id").cast("string"), F.lit("__c"), (F.col("i") + 1).cast("string"), F.lit("of"), F.col("n").cast("string")).alias("request_id"), F.char_length("chunk").alias("n_chars"))


@query("greedy_distinct_facts")
def greedy_distinct_facts(spark: SparkSession, sf: str) -> DataFrame:
    """DUP-04: Jaccard suppression per category."""
    a = active(spark, sf).select("category", "fact_id", "confidence", "fact_text")
    return folds.greedy_distinct(a, "category", [(-F.col("confidence")).alias("c"), F.col("fact_id").alias("i")], "fact_id", S.word_set("fact_text"), 0.4, 25)


@query("topic_cap")
def topic_cap(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-08: five slots, at most two of a topic."""
    a = active(spark, sf).select("conv_id", "confidence", "fact_id", "category")
    items = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), F.col("fact_id").alias("id"), F.col("category").alias("topic")))), lambda x: F.struct(x["id"].alias("id"), x["topic"].alias("topic")))
    return a.groupBy("conv_id").agg(items.alias("items")).select("conv_id", F.transform(folds.capped_by_topic(F.col("items"), 2, 5), lambda x: x["id"]).alias("kept"))


@query("supersession_cycles", "WITH RECURSIVE n AS (SELECT doc_id AS i, CASE WHEN doc_id % 50 < 3 THEN doc_id - doc_id % 50 + (doc_id + 1) % 50 % 3 WHEN doc_id % 50 < 9 THEN doc_id + 1 END AS j FROM documents), r AS (SELECT i, j, 1 AS k FROM n WHERE j IS NOT NULL UNION ALL SELECT r.i, n.j, k + 1 FROM r JOIN n ON r.j = n.i WHERE n.j IS NOT NULL AND k < 8) SELECT DISTINCT i AS doc_id FROM r WHERE i = j")
def supersession_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """DUP-06."""
    i = F.col("doc_id")
    nxt = F.when(i % 50 < 3, i - i % 50 + (i + 1) % 50 % 3).when(i % 50 < 9, i + 1)
    return folds.supersession_cycles(table(spark, sf, "documents").select("doc_id", nxt.alias("next")), "doc_id", "next")
