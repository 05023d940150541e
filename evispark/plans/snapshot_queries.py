"""Field verdicts, values and merges, on rows made from the part table: a brand is an entity, a part one
row of evidence for one of its fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark import lexicon as L
from evispark.functions import fields as C
from evispark.functions import headcount as H
from evispark.operators import snapshot as S
from evispark.plans.registry import query, sql_values, table, values

FIELDS = ["policies.leave_policy", "hris_data.hris_system", "headcount", "headcount_range", "benefits.benefits_broker", "onboarding.onboarding_program", "company_name"]
TEMPLATES = [
    "The leave policy is documented and in place for all of the teams here.",
    "There is no benefits broker, and the onboarding program is missing today.",
    "We have {n} employees, and payroll runs on Workday for every one of them.",
    "Between {n} and more, about {n} to {m} employees report to this office.",
    "A time off policy exists; payroll, hris and Rippling are used by people ops.",
    "Short row {n}.",
    "The senior lead at m3 of the category and skill matrix has {n} pay bands.",
    "- Every employee must take {n} days of leave in each of the years.",
    "Nothing that matters is said in this line of {n} plain words and numbers.",
    "Our headcount is {n}; the benefits broker has been chosen with some care.",
    "## A heading of the handbook that goes on for longer than sixty letters",
]
_ENTITY = "substr(p_brand, 1, 8)"
_TEXT = f"CASE (p_partkey // 7) % {len(TEMPLATES)} " + " ".join(
    "WHEN {} THEN replace(replace('{}', '{{n}}', CAST({} AS VARCHAR)), '{{m}}', CAST(p_size + 10 AS VARCHAR))".format(i, t, "p_size % 3 + 1" if i in (2, 9) else "p_size") for i, t in enumerate(TEMPLATES)
) + " END"
_FIELD = f"CASE p_partkey % {len(FIELDS)} " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FIELDS)) + " END"
_KIND = "CASE p_partkey % 4 WHEN 0 THEN 'explicit' WHEN 1 THEN 'implicit' WHEN 2 THEN 'explicit_absence' ELSE 'ambiguous' END"
#: An entity is a brand and one of four parts of it, so that some have few rows.
_ROWS = f"SELECT p_brand || '-' || (p_partkey // 77) % 4 AS entity, {_FIELD} AS field, p_partkey AS chunk_id, {_TEXT} AS snippet, {_KIND} AS kind, (p_partkey * 37 % 101)::DOUBLE AS score FROM part"


def rows(spark, sf):
    part, key = table(spark, sf, "part"), F.col("p_partkey")
    turn, text, field = F.floor(key / 7) % len(TEMPLATES), F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, t in enumerate(TEMPLATES):
        n = F.col("p_size") % 3 + 1 if i in (2, 9) else F.col("p_size")
        filled = F.replace(F.replace(F.lit(t), F.lit("{n}"), n.cast("string")), F.lit("{m}"), (F.col("p_size") + 10).cast("string"))
        text = F.when(turn == i, filled).otherwise(text)
    for i, f in enumerate(FIELDS):
        field = F.when(key % len(FIELDS) == i, f).otherwise(field)
    kind = F.when(key % 4 == 0, "explicit").when(key % 4 == 1, "implicit").when(key % 4 == 2, "explicit_absence").otherwise("ambiguous")
    entity = F.concat_ws("-", "p_brand", F.floor(key / 77) % 4)
    return part.select(entity.alias("entity"), field.alias("field"), key.alias("chunk_id"), text.alias("snippet"), kind.alias("kind"), (key * 37 % 101).cast("double").alias("score"))


def _any(text: str, patterns: list[str]) -> str:
    joined = "|".join(f"(?:{p})" for p in patterns).replace("'", "''")
    return f"coalesce(regexp_matches(lower({text}), '{joined}'), FALSE)"


def _count(text: str, patterns: list[str]) -> str:
    return "(" + " + ".join("regexp_matches(lower({}), '{}')::INT".format(text, p.replace("'", "''")) for p in patterns) + ")"


def _aliases(field: str) -> list[str]:
    return list(dict.fromkeys([*C.ALIASES.get(field, []), field.split(".")[-1].replace("_", " ")]))


def _hits(field: str, text: str) -> str:
    cases = " ".join(f"WHEN '{f}' THEN " + " + ".join(f"contains(lower({text}), '{a}')::INT" for a in _aliases(f)) for f in FIELDS)
    return f"(CASE {field} {cases} END)"


_CONTROL = "regexp_matches(field, '^(" + "|".join(c.replace(".", r"\.") for c in C.CONTROL) + ")')"
_RELEVANT = f"""
    SELECT entity, field, chunk_id, snippet, kind, score, relevance, row_number() OVER (PARTITION BY entity, field ORDER BY relevance DESC, score DESC, chunk_id) AS place FROM (
        SELECT *, max(relevance) OVER (PARTITION BY entity, field) AS best FROM (
            SELECT *, 4 * {_hits("field", "snippet")} + {_count("snippet", C.POSITIVE + C.NEGATIVE)} - 3 * {_count("snippet", C.NOISE)} AS relevance FROM ({_ROWS}) WHERE length(snippet) >= 40))
    WHERE NOT ({_CONTROL} AND best > 0) OR relevance > 0 QUALIFY place <= 5
"""


@query(f"SELECT entity, field, chunk_id, relevance, place FROM ({_RELEVANT})")
def field_rows(spark, sf):
    return S.relevant(rows(spark, sf)).select("entity", "field", "chunk_id", "relevance", "place")


_RETRIEVAL = list(L.RETRIEVAL_RANK)
_TRACKED = f"SELECT entity, field, CASE (length(field) + ascii(entity[8]) + ascii(entity[-1])) % 5 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_RETRIEVAL)) + f" END AS retrieval FROM (SELECT DISTINCT entity FROM ({_ROWS})) CROSS JOIN (VALUES {sql_values([(f,) for f in FIELDS])}) AS f(field)"


def tracked(spark, sf):
    fields = F.broadcast(values(spark, [(f,) for f in FIELDS], "field string"))  # the profile's fields
    every = rows(spark, sf).select("entity").distinct().crossJoin(fields)
    turn, status = (F.length("field") + F.ascii(F.substring("entity", 8, 1)) + F.ascii(F.substring("entity", -1, 1))) % 5, F.lit(None).cast("string")
    for i, s in enumerate(_RETRIEVAL):
        status = F.when(turn == i, s).otherwise(status)
    return every.withColumn("retrieval", status)


_SYSTEM = "CASE " + " ".join(f"WHEN regexp_matches(lower(joined), '\\b{s.lower()}\\b') THEN '{s}'" for s in C.SYSTEMS) + " END"
_SPAN = r"(?i)\b(\d{1,5})\s*(?:-|–|to)\s*(\d{1,5})\b"


def _int(text: str, pattern: str, group: int = 1) -> str:
    return f"TRY_CAST(regexp_extract({text}, '{pattern}', {group}) AS INT)"


def _range(text: str) -> str:
    a, b = _int(text, _SPAN), _int(text, _SPAN, 2)
    return f"""CASE WHEN regexp_matches({text}, '{_SPAN}') THEN least({a}, {b}) || '-' || greatest({a}, {b}) WHEN regexp_matches({text}, '\\b(\\d{{1,5}})\\s*\\+') THEN {_int(text, chr(92) + "b(" + chr(92) + "d{1,5})" + chr(92) + "s*" + chr(92) + "+")} || '+'
        WHEN regexp_matches({text}, '{H.INEXACT}') AND regexp_matches({text}, '\\b\\d{{1,5}}\\b') THEN {_int(text, chr(92) + "b(" + chr(92) + "d{1,5})" + chr(92) + "b")} || '+' END"""


def _truth(text: str) -> str:
    return f"CASE WHEN {_any(text, C.NEGATIVE)} THEN 'false' WHEN {_any(text, C.POSITIVE)} THEN 'true' END"


_EXACT = "coalesce(" + ", ".join(f"CASE WHEN {_int('snippet', p)} > 0 THEN {_int('snippet', p)} END" for p, _ in H.EXACT) + ")"
_ASSESS = f"""
    WITH r AS ({_RELEVANT}), nums AS (
        SELECT entity, field, {_EXACT} AS num FROM r WHERE field = 'headcount' AND NOT regexp_matches(lower(snippet), '{H.RANGE_OR_PLUS}') AND NOT regexp_matches(lower(snippet), '{H.INEXACT}')
    ), votes AS (SELECT entity, field, arg_min(num, (-n, num)) AS num, count(*) AS n_numbers FROM (SELECT entity, field, num, count(*) AS n FROM nums WHERE num IS NOT NULL GROUP BY ALL) GROUP BY ALL),
    g AS (SELECT entity, field, count(*) AS n_rows, string_agg(snippet, ' ' ORDER BY place) AS joined, string_agg(snippet, ' ' ORDER BY place) FILTER (place <= 3) AS cited_text, bool_or(kind IN ('explicit', 'explicit_absence')) AS explicit FROM r GROUP BY ALL),
    j AS (SELECT t.entity, t.field, t.retrieval, coalesce(n_rows, 0) AS n_rows, joined, num, coalesce(n_numbers, 0) > 1 AS conflict, {_any("cited_text", C.NEGATIVE)} AS missing, coalesce(explicit, FALSE) AS explicit FROM ({_TRACKED}) t LEFT JOIN g USING (entity, field) LEFT JOIN votes USING (entity, field)),
    v AS (SELECT *, CASE WHEN conflict THEN 'conflict' WHEN n_rows = 0 THEN 'not_found' WHEN missing THEN 'explicitly_missing' WHEN retrieval = 'MENTIONED_EXPLICIT' OR explicit THEN 'present' WHEN retrieval IN ('MENTIONED_IMPLICIT', 'MENTIONED_AMBIGUOUS') THEN 'ambiguous' ELSE 'not_found' END AS verdict FROM j)
    SELECT entity, field, verdict,
        CASE verdict WHEN 'conflict' THEN 'weak' WHEN 'ambiguous' THEN 'weak' WHEN 'not_found' THEN 'none' WHEN 'present' THEN 'strong' ELSE CASE WHEN retrieval = 'MENTIONED_EXPLICIT' THEN 'strong' ELSE 'moderate' END END AS strength,
        CASE verdict WHEN 'conflict' THEN 0.52 WHEN 'present' THEN 0.86 WHEN 'explicitly_missing' THEN CASE WHEN retrieval = 'MENTIONED_EXPLICIT' THEN 0.84 ELSE 0.74 END WHEN 'ambiguous' THEN CASE WHEN retrieval = 'MENTIONED_IMPLICIT' THEN 0.44 ELSE 0.34 END
            ELSE CASE WHEN n_rows > 0 THEN 0.20 WHEN retrieval = 'NOT_RETRIEVED' THEN 0.14 ELSE 0.22 END END::DOUBLE AS confidence,
        CASE WHEN conflict THEN '' ELSE coalesce(CASE WHEN field = 'headcount' THEN CAST(num AS VARCHAR) WHEN field = 'headcount_range' THEN {_range("joined")} WHEN field = 'hris_data.hris_system' THEN {_SYSTEM} WHEN {_CONTROL} THEN {_truth("joined")} END, '') END AS value_text,
        least(n_rows, 3) AS n_citations, retrieval, verdict IN ('ambiguous', 'conflict', 'not_found') AS needs_confirmation,
        CASE WHEN verdict IN ('present', 'explicitly_missing') THEN verdict WHEN verdict IN ('ambiguous', 'conflict') THEN CASE WHEN n_rows > 0 THEN 'ambiguous' ELSE 'not_provided_in_sources' END WHEN retrieval = 'NOT_RETRIEVED' THEN 'not_assessed' ELSE 'not_provided_in_sources' END AS status FROM v
"""


def assessed(spark, sf):
    return S.assess(S.relevant(rows(spark, sf)), tracked(spark, sf))


@query(_ASSESS)
def field_assessment(spark, sf):
    return assessed(spark, sf)


_PARTS = f"SELECT regexp_replace(entity, '-.$', '') AS entity, field, verdict, confidence, n_citations, CAST(entity[-1] AS INT) AS part, value_text, status FROM ({_ASSESS})"


def parts(spark, sf):
    """The four parts of a brand as partial assessments of it."""
    return assessed(spark, sf).select(F.regexp_replace("entity", "-.$", "").alias("entity"), "field", "verdict", "confidence", "n_citations", F.substring("entity", -1, 1).cast("int").alias("part"), "value_text", "status")


_VRANK = "CASE verdict WHEN 'present' THEN 5 WHEN 'explicitly_missing' THEN 5 WHEN 'conflict' THEN 4 WHEN 'ambiguous' THEN 3 WHEN 'not_found' THEN 2 ELSE 1 END"


@query(f"SELECT entity, field, verdict, confidence, n_citations, part FROM ({_PARTS}) QUALIFY row_number() OVER (PARTITION BY entity, field ORDER BY {_VRANK} DESC, confidence DESC, n_citations DESC, part) = 1")
def assessment_merge(spark, sf):
    return S.merged_assessments(parts(spark, sf)).drop("value_text", "status")


_QUALITY = "CASE WHEN field = 'headcount' THEN 'int' WHEN value_text IN ('true', 'false') THEN 'bool' ELSE 'string' END"
_SRANK = "CASE status " + " ".join(f"WHEN '{s}' THEN {r}" for s, r in L.STATUS_PRECEDENCE.items()) + " ELSE 0 END"


@query(f"""
    SELECT entity, field, CASE WHEN status = 'ambiguous' AND n = 0 THEN 'not_provided_in_sources' ELSE status END AS status, value,
        CASE WHEN status IN ('not_provided_in_sources', 'not_assessed') OR n = 0 THEN 0 ELSE n END AS n_citations FROM (
        SELECT entity, field, arg_max(status, (r, n_citations, -part)) AS status, arg_max(value_text, (r, q, n_citations, -part)) FILTER (trim(value_text) <> '') AS value, least(sum(n_citations), 2)::BIGINT AS n FROM (
            SELECT *, {_SRANK} AS r, CASE {_QUALITY} WHEN 'bool' THEN 5 WHEN 'int' THEN 4 ELSE 3 END AS q FROM ({_PARTS})) GROUP BY ALL)
""")
def snapshot_merge(spark, sf):
    kind = F.when(F.col("field") == "headcount", "int").when(F.col("value_text").isin("true", "false"), "bool").otherwise("string")
    return S.merged_snapshots(parts(spark, sf).withColumns({"kind": kind, "value": F.col("value_text")}))


_PARSED = f"""CASE WHEN trim(value_text) = '' OR verdict NOT IN ('present', 'explicitly_missing') THEN NULL WHEN field = 'headcount' THEN {_int("value_text", chr(92) + "b(" + chr(92) + "d{1,5})" + chr(92) + "b")}::VARCHAR
    WHEN field = 'headcount_range' THEN {_range("value_text")} WHEN field = 'hris_data.hris_system' THEN value_text WHEN {_CONTROL} THEN value_text END"""
_OVERLAY = f"""
    SELECT entity, field, status, CASE WHEN v IS NOT NULL THEN CASE WHEN field = 'headcount' THEN 'int' WHEN field IN ('headcount_range', 'hris_data.hris_system') THEN 'string' ELSE 'bool' END END AS kind, v AS value FROM (
        SELECT entity, field, status, CASE WHEN field = 'headcount' AND NOT exact THEN NULL WHEN field = 'headcount_range' AND exact THEN NULL ELSE v END AS v FROM (
            SELECT *, bool_or(field = 'headcount' AND v IS NOT NULL AND NOT needs_confirmation AND confidence >= 0.85) OVER (PARTITION BY entity) AS exact FROM (SELECT *, {_PARSED} AS v FROM ({_ASSESS}))))
"""


@query(_OVERLAY)
def snapshot_values(spark, sf):
    return S.overlaid(assessed(spark, sf))


def sentences(spark, sf):
    return rows(spark, sf).select("entity", "chunk_id", F.lit(0).alias("pos"), F.col("snippet").alias("sentence"))


_EXACTLY = f"(NOT regexp_matches(lower(s), '{H.RANGE_OR_PLUS}') AND NOT regexp_matches(lower(s), '{H.INEXACT}') AND (" + " OR ".join(f"coalesce({_int('s', p)}, 0) > 0" for p, _ in H.EXACT) + "))"
_LISTED = rf"(length(s) >= 25 AND (regexp_matches(s, '^\s*([-*]|\d+[.)])\s+') OR length(s) - length(replace(s, '|', '')) >= 2) AND {_any('s', C.ITEM_SIGNALS)})"
_ADMISSIBLE = rf"CASE WHEN s = '' OR regexp_matches(s, '^#{{1,6}}\s+\S+') THEN FALSE WHEN {_LISTED} THEN TRUE WHEN regexp_matches(lower(s), '{H.RANGE_OR_PLUS}') OR {_EXACTLY} THEN length(s) >= 25 ELSE length(s) >= 60 AND regexp_matches(s, '[.:;]') END"


@query(f"SELECT chunk_id, {_ADMISSIBLE} AS admissible, {_LISTED} AS listed_rule FROM (SELECT chunk_id, regexp_replace(trim(snippet), '\\s+', ' ', 'g') AS s FROM ({_ROWS}))")
def citation_admissible(spark, sf):
    return rows(spark, sf).select("chunk_id", C.admissible(F.col("snippet")).alias("admissible"), C.listed_rule(F.col("snippet")).alias("listed_rule"))


@query(f"""
    WITH v AS ({_OVERLAY}), s AS (SELECT entity, chunk_id, snippet AS s FROM ({_ROWS})),
    f AS (SELECT entity, field, arg_min(said, chunk_id) AS said FROM (
        SELECT v.entity, field, chunk_id, CASE WHEN field = 'hris_data.hris_system' THEN {_SYSTEM.replace("joined", "s")} ELSE {_truth("s")} END AS said FROM v JOIN s USING (entity)
        WHERE value IS NULL AND status NOT IN ('present', 'explicitly_missing') AND {_CONTROL} AND {_hits("field", "s")} > 0 AND {_ADMISSIBLE}) WHERE said IS NOT NULL GROUP BY ALL)
    SELECT entity, field, CASE WHEN said IS NOT NULL THEN CASE WHEN field = 'hris_data.hris_system' THEN 'string' ELSE 'bool' END ELSE kind END AS kind, coalesce(said, value) AS value, CASE WHEN said IS NOT NULL THEN 'present' ELSE status END AS status
    FROM v LEFT JOIN f USING (entity, field)
""")
def snapshot_supplements(spark, sf):
    return S.supplemented(S.overlaid(assessed(spark, sf)), sentences(spark, sf))


@query(f"""
    SELECT chunk_id, field, alias_hits FROM (SELECT chunk_id, field, {_hits("field", "snippet")} AS alias_hits FROM (SELECT * FROM ({_ROWS}) QUALIFY field IS NOT NULL)) WHERE alias_hits > 0
""".replace(" QUALIFY field IS NOT NULL", ""))
def field_alias_hits(spark, sf):
    found = rows(spark, sf).select("chunk_id", "field", C.alias_hits(F.col("field"), F.col("snippet")).alias("alias_hits"))
    return found.where("alias_hits > 0")
