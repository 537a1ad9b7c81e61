"""Scalar functions over facts and texts, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import vocabulary as V


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lookup(values: dict[str, str], key: Column) -> Column:
    """The value of a small literal map, null where it has none."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def _folded(x: Column | str) -> Column:
    return F.lower(F.trim(_c(x)))


def normalize_category(raw: Column | str) -> Column:
    """Exact, plural or synonym of a category, else unknown."""
    c = _folded(raw)
    own = {v: v for v in V.CATEGORIES}
    plural = {v + "s": v for v in V.CATEGORIES}
    return F.coalesce(lookup(own | plural | V.CATEGORY_SYNONYMS, c), F.lit("unknown"))


def normalize_intent(raw: Column | str) -> Column:
    return F.coalesce(lookup(V.inverted(V.INTENTS), _folded(raw)), F.lit("does"))


def normalize_temporal(raw: Column | str) -> Column:
    return F.coalesce(lookup(V.inverted(V.TEMPORAL), _folded(raw)), F.lit("unknown"))


def normalize_fact_class(raw: Column | str) -> Column:
    return F.coalesce(lookup(V.inverted(V.FACT_CLASSES), _folded(raw)), F.lit("unclassified"))


def normalize_tier(raw: Column | str) -> Column:
    return F.coalesce(lookup(V.inverted(V.TIERS), _folded(raw)), F.lit("untiered"))


def normalize_predicate(raw: Column | str) -> Column:
    """Canonical form, through aliases and underscores; an unknown one stays as it is."""
    p = _folded(raw)
    own = {v: v for v in V.PREDICATES}
    known = F.coalesce(lookup(own, p), lookup(V.ALIASES, p), lookup(own, F.regexp_replace(p, " ", "_")), p)
    return F.when(F.coalesce(_c(raw), F.lit("")) == "", "unknown").otherwise(known)


def normalize_subject(raw: Column | str) -> Column:
    """user for the narrator's own names; roles by the words they are told with."""
    s = _folded(raw)
    name = lambda word: F.concat(F.lit(f"{word}:"), F.trim(F.regexp_replace(s, rf"^.*\b{word}\b", "")))
    return (
        F.when(s.isNull() | (s == "") | s.isin("i", "me", "myself", "user", "the user"), "user")
        .when(s.rlike(r"\b(wife|husband|spouse|partner)\b"), "spouse")
        .when(s.rlike(r"\bpets\b"), "pets")
        .when(s.rlike(r"\b(dog|cat|pet)\b"), "pet")
        .when(s.rlike(r"\b(inc|llc|ltd|company|corp)\b"), "company")
        .when(s.rlike(r"\bfriend\b"), name("friend"))
        .when(s.rlike(r"\bcolleague\b"), name("colleague"))
        .otherwise(s)
    )


def fact_sentence(subject: Column | str, predicate: Column | str, obj: Column | str) -> Column:
    """subject, predicate with spaces, object; an empty predicate leaves two spaces."""
    shown = F.regexp_replace(F.coalesce(_c(predicate), F.lit("")), "_", " ")
    return F.trim(F.concat(_c(subject), F.lit(" "), shown, F.lit(" "), _c(obj)))


def predicate_intent(predicate: Column | str) -> Column:
    known = {"learned": "learning", "studies": "learning"} | {p: "historical" for p in ("experienced", "founded", "graduated_from", "lost", "raised_in")}
    return F.coalesce(lookup(known, _c(predicate)), F.lit("does"))


def tier_by_predicate(tier: Column | str, predicate: Column | str) -> Column:
    """Untiered facts become identity or contextual; tiered ones stay."""
    t = _c(tier)
    return F.when(t.isNull() | (t == "untiered"), F.when(_c(predicate).isin(V.IDENTITY_PREDICATES), "identity").otherwise("contextual")).otherwise(t)


def scope_of(source: Column | str) -> Column:
    return F.coalesce(lookup(V.SCOPES, _c(source)), F.lit("personal"))


def routed_layer(predicate: Column | str) -> Column:
    p = _c(predicate)
    return F.when(p.isin(V.ANCHOR_PREDICATES), "anchors").when(p.isin(V.PREDICTION_PREDICATES), "predictions").when(p.isin(V.BIOGRAPHY_PREDICATES), "biography").otherwise("preference")


def contains_any(text: Column | str, literals: list[str]) -> Column:
    """Whether the lower-cased text holds any of the literals (one pass of a quoted alternation)."""
    import re

    return F.lower(_c(text)).rlike("|".join(re.sub(r"([^A-Za-z0-9 ])", r"\\\1", x.lower()) for x in literals))


def like_contains(text: Column | str, needle: str) -> Column:
    """Case-insensitive LIKE %needle% whose needle's wildcards are literal."""
    return F.contains(F.lower(_c(text)), F.lit(needle.lower()))


# Scores


def confidence(raw: Column, intent: Column, subject: Column, n_messages: Column) -> Column:
    score = F.coalesce(lookup({"curious": "0.4", "does": "1.0", "historical": "0.6", "learning": "0.7"}, intent).cast("double"), F.lit(0.5))
    own = F.when(subject == "user", 1.0).otherwise(0.5)
    depth = F.least(n_messages / 30.0, F.lit(1.0))
    total = 0.20 * F.greatest(F.least(raw, F.lit(1.0)), F.lit(0.0)) + 0.30 * score + 0.25 * own + 0.25 * depth
    return F.greatest(F.least(total, F.lit(1.0)), F.lit(0.0))


def importance(significance: Column, recurrence: Column) -> Column:
    """.7 significance + .3 log-scaled recurrence, on 0 to 1; missing counts as 0."""
    rec = F.least(F.log(F.coalesce(recurrence, F.lit(0)) + 1) / F.log(F.lit(300.0)) * 10, F.lit(10.0))
    return F.least((0.7 * F.coalesce(significance, F.lit(0.0)) + 0.3 * rec) / 10, F.lit(1.0))


def recency(created_at: Column, now: int) -> Column:
    """Falls to 0 over 1100 days; a missing date counts as that old."""
    age = F.when(created_at.isNull() | (created_at == 0), 1100.0).otherwise((F.lit(now) - created_at) / 86400.0)
    return F.greatest(F.lit(0.0), 1 - age / 1100)


def similarity_of(distance: Column, space: str) -> Column:
    """Similarity of a distance in the named space, within 0 to 1."""
    forms = {"cosine": 1 - distance, "l2": 1 - distance * distance / 2, "ip": distance}
    if space not in forms:
        raise ValueError(f"unknown space: {space}")
    if space == "ip":
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), forms[space]))
    return F.when(distance <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), forms[space])))


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays, summed in order."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays; 0 where either has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two word sets over their union (at least 1)."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def word_set(text: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(_c(text)), r"\s+"), lambda w: w != ""))


# Texts


def strip_citations(text: Column | str) -> Column:
    """Without [F-...] and (A1, C2-C4) marks and the blanks before them."""
    out = F.regexp_replace(_c(text), r"\s*\[F-[0-9a-f, F-]+\]", "")
    return F.regexp_replace(out, r"\s*\(([ACMP][0-9]+(?:-[ACMP]?[0-9]+)?(?:, ?)?)+\)", "")


def citation_codes(text: Column | str) -> Column:
    """All codes A1, C2 ...; a range A1-A4 gives each, M counts as C."""
    found = F.regexp_extract_all(_c(text), F.lit(r"\b([ACMP][0-9]+(?:-[ACMP]?[0-9]+)?)\b"), F.lit(1))

    def expand(x: Column) -> Column:
        kind = F.regexp_replace(F.substring(x, 1, 1), "M", "C")
        low = F.regexp_extract(x, r"^[A-Z]([0-9]+)", 1).cast("int")
        high = F.coalesce(F.nullif(F.regexp_extract(x, r"-[A-Z]?([0-9]+)$", 1), F.lit("")).cast("int"), low)
        return F.transform(F.sequence(F.least(low, high), F.greatest(low, high)), lambda n: F.concat(kind, n.cast("string")))

    return F.array_distinct(F.flatten(F.transform(found, expand)))


def truncated(text: Column | str, budget: int) -> Column:
    """Within the budget, cut after the last full stop or line if past half of it."""
    t = F.substring(_c(text), 1, budget)
    back = lambda mark: F.when(F.instr(F.reverse(t), mark) > 0, budget - F.instr(F.reverse(t), mark)).otherwise(-1)
    at = F.greatest(back("."), back("\n"))
    return F.when(F.char_length(_c(text)) <= budget, _c(text)).otherwise(F.when(at > budget / 2, F.substr(t, F.lit(1), at + 1)).otherwise(t))


def strip_noise(text: Column | str) -> Column:
    """Sequences, hashes, notation and number tables replaced by placeholders, adjacent ones joined."""
    out = F.regexp_replace(_c(text), r"[ACGTUNacgtun]{50,}", "[sequence]")
    out = F.regexp_replace(out, r"\b[0-9a-fA-F]{32,}\b", "[hash]")
    out = F.regexp_replace(out, r"[=#()+\-\[\]\\/@A-Za-z0-9]{60,}", "[notation]")
    numeric = lambda line: (F.char_length(line) > 100) & (F.char_length(F.regexp_replace(line, r"[^0-9.,;:|\s+-]", "")) > 0.8 * F.char_length(line))
    out = F.array_join(F.transform(F.split(out, "\n"), lambda line: F.when(numeric(line), "[numbers]").otherwise(line)), "\n")
    return F.regexp_replace(out, r"(\[(?:sequence|hash|notation|numbers)\])(?:\s*\[(?:sequence|hash|notation|numbers)\])+", "$1")


def anonymise(text: Column | str, full_name: str) -> Column:
    """The full name, then its parts of over three letters, by USER; repeats collapse."""
    import re

    out = F.regexp_replace(_c(text), rf"(?i)\b{re.escape(full_name)}\b", "USER")
    for part in full_name.split():
        if len(part) > 3:
            out = F.regexp_replace(out, rf"(?i)\b{re.escape(part)}\b", "USER")
    return F.regexp_replace(out, r"USER(?:\s+USER)+", "USER")


def tolerant_json(text: Column | str) -> Column:
    """The outermost {...} of a text if it parses, without trailing commas if need be, else null."""
    body = F.nullif(F.regexp_extract(_c(text), r"(?s)(\{.*\})", 1), F.lit(""))
    return F.coalesce(F.try_parse_json(body), F.try_parse_json(F.regexp_replace(body, r",\s*([}\]])", "$1")))


def as_of_suffix(fact_class: Column, temporal: Column, created_at: Column, now: int) -> Column:
    """' (as of YYYY-MM)' of an old state that is not past."""
    old = (F.lit(now) - created_at) / 86400.0 > 240
    mark = F.concat(F.lit(" (as of "), F.date_format(F.timestamp_seconds(created_at), "yyyy-MM"), F.lit(")"))
    return F.when(fact_class.isin("state", "unclassified") & (temporal != "past") & old, mark).otherwise("")


def coerced_seconds(raw: Column | str) -> Column:
    """Epoch seconds of milliseconds, seconds or ISO text; null where it is none of them."""
    number = F.expr(f"try_cast({raw} AS double)") if isinstance(raw, str) else raw.try_cast("double")
    iso = F.unix_timestamp(F.try_to_timestamp(_c(raw))).cast("double")
    value = F.coalesce(number, iso)
    return F.when(value > 1e12, value / 1000).otherwise(value)
