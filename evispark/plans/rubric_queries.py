"""Findings, scorecards, memos, guidance and lines of a report, on the benchmark's items as a rubric."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark import lexicon as L
from evispark.operators import decide as D
from evispark.operators import rubric as R
from evispark.plans import evidence_queries as EQ
from evispark.plans import matching_queries as MQ
from evispark.plans import snapshot_queries as SQ
from evispark.plans import stage_queries as ST
from evispark.plans.registry import once, query, sql_values, values

AREAS = ["strategy", "Compensation & Equity", "DEIB", "people_ops|hr-sops", "performance management", "onboarding", "data privacy controls"]
SEVERITIES = ["critical", "high", "medium", "low"]

_EVIDENCE = f"SELECT item_id, doc_id AS chunk_id, snippet, kind, score, rank FROM ({EQ._TOP})"
_STATUS = f"""
    SELECT b.item_id, CASE WHEN kind IN ('explicit', 'explicit_absence') THEN 'MENTIONED_EXPLICIT' WHEN kind = 'implicit' THEN 'MENTIONED_IMPLICIT' WHEN b.item_id % 2 = 0 THEN 'NOT_RETRIEVED' ELSE 'NOT_FOUND_IN_RETRIEVED' END AS retrieval
    FROM ({MQ.RUBRIC}) b LEFT JOIN (SELECT item_id, kind FROM ({_EVIDENCE}) WHERE rank = 1) USING (item_id)
"""
_ITEMS = f"""
    SELECT item_id, CASE item_id % {len(AREAS)} {" ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(AREAS))} END AS area, 'Item ' || item_id || '.' AS claim,
        CASE (item_id // 2) % 4 {" ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SEVERITIES))} END AS severity, item_id % 5 = 0 AS compliance, CASE WHEN item_id % 3 = 0 THEN 'Is item ' || item_id || ' there?' ELSE '' END AS question,
        list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda x: length(x) >= 4 AND x NOT IN ({L.sql_list(L.RELEVANCE_STOP)})) AS words FROM ({MQ.RUBRIC})
"""


def items(spark, sf):
    key, area, severity = F.col("item_id"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, a in enumerate(AREAS):
        area = F.when(key % len(AREAS) == i, a).otherwise(area)
    for i, s in enumerate(SEVERITIES):
        severity = F.when(F.floor(key / 2) % 4 == i, s).otherwise(severity)
    name = key.cast("string")
    return MQ.rubric(spark, sf).select(
        "item_id", area.alias("area"), F.concat(F.lit("Item "), name, F.lit(".")).alias("claim"), severity.alias("severity"), (key % 5 == 0).alias("compliance"),
        F.when(key % 3 == 0, F.concat(F.lit("Is item "), name, F.lit(" there?"))).otherwise("").alias("question"), R.relevance_tokens(F.col("text")).alias("words"),
    )


def evidence(spark, sf):
    return EQ.top(spark, sf).select("item_id", F.col("doc_id").alias("chunk_id"), "snippet", "kind", "score", "rank")


def statuses(spark, sf, rows):
    first = rows.where("rank = 1").select("item_id", "kind")
    found = MQ.rubric(spark, sf).select("item_id").join(first, "item_id", "left")
    return found.select("item_id", D.retrieval_status(F.col("kind"), F.col("item_id") % 2).alias("retrieval"))


@once
def findings(spark, sf):
    rows = evidence(spark, sf)
    return R.evaluate(items(spark, sf), rows, statuses(spark, sf, rows))


def _cited(where: str, name: str) -> str:
    return f"""SELECT item_id, count(*) AS n_{name}, string_agg(snippet, ' ' ORDER BY place) AS {name}_text FROM (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, score DESC, rank) AS place, max(hits) OVER (PARTITION BY item_id) AS most FROM (
            SELECT e.*, len(words) AS n_words, len(list_intersect(words, regexp_extract_all(lower(snippet), '[\\p{{L}}\\p{{N}}_]+'))) AS hits FROM ev e JOIN it USING (item_id) WHERE {where}))
        WHERE place <= CASE WHEN n_words = 0 THEN 2 WHEN most = 0 THEN 1 ELSE 2 END AND (hits > 0 OR most = 0) GROUP BY item_id"""


_FINDINGS = f"""
    WITH ev AS ({_EVIDENCE}), it AS ({_ITEMS}), st AS ({_STATUS}), a AS ({_cited("TRUE", "all")}), b AS ({_cited("kind = 'explicit_absence'", "absent")}),
    j AS (SELECT it.*, retrieval, coalesce(n_all, 0) AS n_all, coalesce(n_absent, 0) AS n_absent, all_text, absent_text, retrieval = 'MENTIONED_EXPLICIT' AND coalesce(n_absent, 0) > 0 AS missing
        FROM it JOIN st USING (item_id) LEFT JOIN a USING (item_id) LEFT JOIN b USING (item_id)),
    v AS (SELECT *, CASE WHEN missing THEN 'explicitly_missing' WHEN retrieval = 'NOT_RETRIEVED' THEN 'not_assessed' WHEN retrieval IN ('MENTIONED_IMPLICIT', 'MENTIONED_AMBIGUOUS') OR n_all > 0 THEN CASE WHEN n_all > 0 THEN 'ambiguous' ELSE 'not_provided_in_sources' END ELSE 'not_provided_in_sources' END AS status,
        CASE WHEN missing THEN n_absent ELSE n_all END AS n, lower(CASE WHEN missing THEN absent_text ELSE all_text END) AS t FROM j WHERE missing OR NOT (retrieval = 'MENTIONED_EXPLICIT' AND n_all > 0)),
    w AS (SELECT *, status <> 'explicitly_missing' AS needs_confirmation, status IN ('ambiguous', 'explicitly_missing') AS shown FROM v),
    x AS (SELECT * REPLACE (CASE WHEN needs_confirmation AND retrieval = 'NOT_RETRIEVED' AND NOT compliance THEN CASE severity WHEN 'critical' THEN 'high' WHEN 'high' THEN 'medium' ELSE 'low' END ELSE severity END AS severity) FROM w)
    SELECT item_id, area, claim, severity, status, retrieval, needs_confirmation, CASE WHEN shown THEN n ELSE 0 END AS n_citations,
        CASE WHEN NOT shown THEN '{R.UNASSIGNED}' WHEN regexp_matches(t, '\\bpeople ops\\b|\\bpeople team\\b') THEN 'People Team' WHEN regexp_matches(t, '\\bhr\\b|\\bhuman resources\\b') THEN 'HR Team' WHEN regexp_matches(t, '\\bfinance\\b') THEN 'Finance' WHEN regexp_matches(t, '\\boperations\\b|\\bops\\b') THEN 'Ops' ELSE '{R.UNASSIGNED}' END AS owner,
        CASE WHEN needs_confirmation THEN CASE WHEN question <> '' THEN question ELSE 'Can you confirm status of: ' || claim || '?' END END AS question, compliance OR severity IN ('high', 'critical') AS is_risk FROM x
"""


@query(_FINDINGS)
def rubric_findings(spark, sf):
    return findings(spark, sf)


@query(f"SELECT item_id, chunk_id, kind, rank FROM ({_EVIDENCE})")
def rubric_evidence(spark, sf):
    return evidence(spark, sf).select("item_id", "chunk_id", "kind", "rank")


BAND = [("small", 3 - i, i) for i in range(3)] + [("large", i, i) for i in range(7)]


@query(f"SELECT item_id, ord FROM ({_ITEMS}) JOIN (VALUES {sql_values(BAND)}) AS b(band, ord, item_id) USING (item_id) WHERE band = 'small' UNION ALL SELECT item_id + 100000, NULL FROM ({_ITEMS})")
def active_items(spark, sf):
    """The items of a known band, and (ids moved by 100,000) those of a band that isn't in the profile."""
    bands = values(spark, BAND, "band string, ord int, item_id long")
    some, all_ = (R.active(items(spark, sf), bands, band).select("item_id", "ord") for band in ("small", "elsewhere"))
    return some.unionByName(all_.select((F.col("item_id") + 100000).alias("item_id"), "ord"))


_KEYED = "CASE k " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in L.AREA_ALIASES.items() if a not in L.AREA_LABELS) + " ELSE k END"
_SCORE = f"""
    WITH f AS (SELECT *, {_KEYED} AS key FROM (SELECT *, regexp_replace(regexp_replace(lower(area), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS k FROM ({_FINDINGS}))),
    g AS (SELECT key, arg_min(area, item_id) AS first_area, count(*) AS n, count(*) FILTER (severity IN ('critical', 'high')) AS h, count(*) FILTER (severity IN ('critical', 'high') AND status = 'explicitly_missing') AS mh,
        count(*) FILTER (severity = 'critical' AND status <> 'explicitly_missing' AND status <> 'present') AS uc, count(*) FILTER (severity = 'medium') AS m FROM f GROUP BY key),
    r AS (SELECT coalesce(a.key, g.key) AS area, coalesce(label, CASE first_area WHEN 'people_ops|hr-sops' THEN 'People / Ops / HR-SOPs' END) AS label, coalesce(n, 0) AS n_findings,
        CASE WHEN coalesce(n, 0) = 0 THEN 'Developing' WHEN mh > 0 THEN 'Under-Developed' WHEN h >= 2 OR uc > 0 THEN 'Developing' ELSE 'Aligned' END AS maturity,
        CASE WHEN coalesce(h, 0) > 0 THEN 'Significant' WHEN coalesce(m, 0) > 0 THEN 'Moderate' ELSE 'Limited' END AS impact
        FROM (VALUES {sql_values(list(L.AREA_LABELS.items()))}) AS a(key, label) FULL OUTER JOIN g ON a.key = g.key)
    SELECT *, row_number() OVER (ORDER BY CASE impact WHEN 'Significant' THEN 3 WHEN 'Moderate' THEN 2 ELSE 1 END DESC, CASE maturity WHEN 'Under-Developed' THEN 4 WHEN 'Developing' THEN 3 WHEN 'Aligned' THEN 2 ELSE 1 END DESC, label DESC) AS rank FROM r
"""


def scored(spark, sf):
    areas = values(spark, list(L.AREA_LABELS.items()), "area string, label string")
    return R.scorecard(findings(spark, sf), areas, True, L.AREA_LABELS, L.AREA_ALIASES)


@query(_SCORE)
def rubric_scorecard(spark, sf):
    """All labelled areas and the others that findings name; areas without findings are 'Developing',
    as coverage is taken to be low."""
    return scored(spark, sf)


_LINE = """CASE status WHEN 'explicitly_missing' THEN 'Sources indicate a required control is not in place in ' || replace(area, '_', ' ') || '.'
    WHEN 'ambiguous' THEN 'Evidence is partial/indirect for a high-priority control in ' || replace(area, '_', ' ') || '; confirm before finalizing.'
    WHEN 'not_provided_in_sources' THEN 'High-priority control evidence was not found in reviewed sources for ' || replace(area, '_', ' ') || '.'
    WHEN 'not_assessed' THEN 'Source retrieval coverage was insufficient to assess a high-priority control in ' || replace(area, '_', ' ') || '.' ELSE 'Evidence indicates this control is documented: ' || rtrim(claim, '.') || '.' END"""
_SEV = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"


@query(f"""
    SELECT line, row_number() OVER (ORDER BY min(rank)) AS place FROM (SELECT {_LINE} AS line, rank FROM (SELECT *, row_number() OVER (ORDER BY {_SEV} DESC, item_id) AS rank FROM ({_FINDINGS})) ORDER BY rank LIMIT 3) GROUP BY line
""")
def growth_drivers(spark, sf):
    from pyspark.sql import Window as W

    ranked = findings(spark, sf).withColumn("rank", F.row_number().over(W.orderBy(D.rank_of(F.col("severity"), L.SEVERITY).desc(), "item_id")))  # a row an item
    return R.drivers(ranked)


@query(f"""
    SELECT item_id, CASE retrieval WHEN 'NOT_RETRIEVED' THEN 'Coverage gap (NOT_RETRIEVED): ' WHEN 'NOT_FOUND_IN_RETRIEVED' THEN 'Searched retrieved corpus; not observed (NOT_FOUND_IN_RETRIEVED): ' WHEN 'MENTIONED_AMBIGUOUS' THEN 'Mentioned but ambiguous (MENTIONED_AMBIGUOUS): ' ELSE 'Not provided in sources: ' END || claim AS line
    FROM ({_FINDINGS}) WHERE needs_confirmation ORDER BY item_id LIMIT 12
""")
def unknown_lines(spark, sf):
    open_ = findings(spark, sf).where("needs_confirmation").orderBy("item_id").limit(12)
    return open_.select("item_id", R.unknown_line(F.col("claim"), F.col("retrieval")).alias("line"))


@query(f"""
    SELECT entity, count(*) FILTER (verdict = 'present') AS confirmed, count(*) FILTER (verdict IN ('ambiguous', 'not_found', 'explicitly_missing')) AS weak, count(*) FILTER (verdict = 'conflict') AS conflicts,
        count(*) FILTER (verdict IN ('ambiguous', 'not_found')) AS gaps, least(count(*) FILTER (verdict IN ('ambiguous', 'conflict', 'not_found')), 12) AS questions,
        coalesce(array_to_string(list_sort(list(field || ': ' || CASE WHEN value_text <> '' THEN value_text ELSE 'unresolved' END || ' (confidence=' || printf('%.2f', confidence) || ')') FILTER (verdict = 'present'))[1:4], '; '), '') AS notes
    FROM ({SQ._ASSESS}) GROUP BY entity
""")
def field_memo(spark, sf):
    return R.memo(SQ.assessed(spark, sf))


RULES = [("r1", ["b1"], ["seed"]), ("r2", ["b2", "b3"], []), ("r3", [], ["series_a"]), ("r4", [], [])]
LINES = [
    ("r1", "practice", 1, "Set baseline controls"), ("r1", "practice", 2, "Hire help"), ("r1", "source", 1, "s1"), ("r1", "source", 2, "s9"),
    ("r2", "practice", 1, " hire HELP "), ("r2", "practice", 2, "Train managers"), ("r2", "practice", 3, ""), ("r2", "risk", 1, "Attrition"), ("r2", "source", 1, "s2"),
    ("r3", "practice", 1, "Set bands"), ("r3", "risk", 1, "attrition"), ("r4", "risk", 1, "Drift"), ("r4", "practice", 1, "Hire help"),
]
SOURCES = [("s1", 1, "First guide"), ("s2", 2, "Second guide"), ("s3", 3, "Third guide"), ("s4", 4, "Fourth guide")]
CAPS = {"practice": 3, "risk": 2, "source": 6}
_RULES = ", ".join(f"('{r}', {i}, {sizes or '[]::VARCHAR[]'}, {funds or '[]::VARCHAR[]'})" for i, (r, sizes, funds) in enumerate(RULES))
_APPLY = f"""
    SELECT entity, rule, ord, CASE WHEN len(sizes) > 0 THEN 2 ELSE 0 END + CASE WHEN len(funds) > 0 THEN 2 ELSE 0 END AS specificity FROM ({ST._INFER}) JOIN (VALUES {_RULES}) AS r(rule, ord, sizes, funds)
        ON (len(sizes) = 0 OR list_contains(sizes, stage_id)) AND (len(funds) = 0 OR (funding IS NOT NULL AND list_contains(funds, funding)))
"""


def applicable(spark, sf):
    rules = F.broadcast(values(spark, [(r, i, s, f) for i, (r, s, f) in enumerate(RULES)], "rule string, ord int, sizes array<string>, funds array<string>"))  # the profile's rules
    size = (F.size("sizes") == 0) | F.array_contains("sizes", F.col("stage_id"))
    fund = (F.size("funds") == 0) | F.coalesce(F.array_contains("funds", F.col("funding")), F.lit(False))
    special = F.when(F.size("sizes") > 0, 2).otherwise(0) + F.when(F.size("funds") > 0, 2).otherwise(0)
    return ST.inferred(spark, sf).join(rules, size & fund).select("entity", "rule", "ord", special.alias("specificity"))


@query(f"""
    WITH a AS ({_APPLY}), l AS (SELECT * FROM (VALUES {sql_values(LINES)}) AS l(rule, kind, pos, text)),
    o AS (SELECT entity, rule, row_number() OVER (PARTITION BY entity ORDER BY specificity DESC, coalesce(n, 0) DESC, ord) AS pl FROM a LEFT JOIN (SELECT rule, count(*) AS n FROM l WHERE kind = 'practice' GROUP BY rule) USING (rule)),
    d AS (SELECT entity, kind, trim(text) AS text, pl, pos FROM o JOIN l USING (rule) WHERE trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY entity, kind, lower(trim(text)) ORDER BY pl, pos) = 1),
    p AS (SELECT entity, kind, text, row_number() OVER (PARTITION BY entity, kind ORDER BY pl, pos) AS place FROM d),
    c AS (SELECT * FROM p WHERE place <= CASE kind WHEN 'practice' THEN 3 WHEN 'risk' THEN 2 ELSE 6 END),
    s AS (SELECT * FROM (VALUES {sql_values(SOURCES)}) AS s(source, ord, title)), k AS (SELECT entity, kind, title AS text, place FROM c JOIN s ON text = source WHERE kind = 'source')
    SELECT * FROM c WHERE kind <> 'source' UNION ALL SELECT * FROM k UNION ALL SELECT entity, 'source', title, ord FROM (SELECT DISTINCT entity FROM a WHERE entity NOT IN (SELECT entity FROM k)) CROSS JOIN s WHERE ord <= 3
""")
def stage_guidance(spark, sf):
    rules = values(spark, LINES, "rule string, kind string, pos int, text string")
    return R.guidance(applicable(spark, sf), rules, values(spark, SOURCES, "source string, ord int, title string"), CAPS)


LABELS = ["<20 employees", "20-49 employees", "50-99 employees", "100-250 employees", "250+ employees", "Under 20", ""]


@query(f"""SELECT label, CASE WHEN contains(lower(label), '<20') OR contains(lower(label), 'under 20') THEN 'founder-led' WHEN contains(label, '20') AND contains(label, '49') THEN 'generalist' WHEN contains(label, '50') AND contains(label, '99') THEN 'people-ops-lead'
    WHEN contains(label, '100') AND contains(label, '250') THEN 'head-of-people' ELSE 'scaled' END AS structure FROM (VALUES {sql_values([(x,) for x in LABELS])}) AS v(label)""")
def fallback_structure(spark, sf):
    return values(spark, [(x,) for x in LABELS], "label string").withColumn("structure", R.structure(F.col("label")))


_CATALOG = f"SELECT item_id, chunk_id, snippet, score, row_number() OVER (ORDER BY score DESC, item_id, rank) AS place FROM ({_EVIDENCE}) QUALIFY place <= 50"


@query(f"SELECT item_id, chunk_id, place FROM ({_CATALOG})")
def evidence_catalog(spark, sf):
    return R.catalog(evidence(spark, sf)).select("item_id", "chunk_id", "place")


#: What an outside reader might say: observation k of an item cites its documents and one that doesn't exist.
_OBS = f"SELECT item_id AS obs_id, item_id % 3 = 0 AS hypothesis, list(chunk_id ORDER BY chunk_id) AS ids FROM ({_EVIDENCE}) GROUP BY item_id"


@query(f"""
    WITH c AS (SELECT chunk_id, arg_max(snippet, place) AS snippet FROM ({_CATALOG}) GROUP BY chunk_id), o AS ({_OBS}),
    n AS (SELECT obs_id, least(count(*), 3) AS n FROM (SELECT obs_id, unnest(ids) AS chunk_id FROM o) JOIN c USING (chunk_id) GROUP BY obs_id), j AS (SELECT o.obs_id, hypothesis, coalesce(n, 0) AS n FROM o LEFT JOIN n USING (obs_id)),
    v AS (SELECT *, CASE WHEN n > 0 AND NOT hypothesis THEN 'present' WHEN n > 0 THEN 'ambiguous' ELSE 'not_provided_in_sources' END AS status FROM j)
    SELECT obs_id, n AS n_citations, status, CASE WHEN n > 0 AND hypothesis THEN 'MENTIONED_AMBIGUOUS' WHEN n > 0 THEN 'MENTIONED_EXPLICIT' ELSE 'NOT_FOUND_IN_RETRIEVED' END AS retrieval, status <> 'present' OR hypothesis AS needs_confirmation FROM v
""")
def reader_observations(spark, sf):
    rows = evidence(spark, sf)
    said = rows.groupBy(F.col("item_id").alias("obs_id")).agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"))
    return R.observations(said.withColumn("hypothesis", F.col("obs_id") % 3 == 0), R.catalog(rows))
