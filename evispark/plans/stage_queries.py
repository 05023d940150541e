"""Numbers of staff and size bands, on sentences made from the part table: a brand is an entity, a part
one sentence about it."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.functions import headcount as H
from evispark.operators import decide as D
from evispark.operators import evidence as E
from evispark.operators import stage as S
from evispark.plans.registry import query, sql_values, table, values

TEMPLATES = [
    "Our headcount is {n} as of this quarter in the region.",
    "We have {n} employees working across all of our offices today.",
    "A team of {n} ships software to customers every single week.",
    "There are about {n} employees in the company at this moment.",
    "The headcount range {n}-{m} employees is what the plan foresees.",
    "Now {n}+ team members have joined the workforce in this year.",
    "Vacation is {n} days for every employee, with notice given early.",
    "The company raised a Series A round and hired staff for growth.",
    "Our product ships in {n} sizes and nothing more is said here.",
    "A seed round was closed, and the board of directors met {n} times.",
    "Over {m} people and employees of the global entities took part.",
    "{n} staff",
]
BANDS = [("b1", 0, 9, 1), ("b2", 10, 24, 2), ("b3", 25, 39, 3), ("b4", 40, None, 4)]
STAGES = [("seed", "Seed", ["seed-funded"]), ("series_a", "Series A", []), ("series_b", "Series B", []), ("series_c_plus", "Series C+", ["growth stage"])]

_TEXT = "CASE p_partkey % {k} {cases} END".format(
    k=len(TEMPLATES),
    cases=" ".join("WHEN {} THEN replace(replace('{}', '{{n}}', CAST(p_size AS VARCHAR)), '{{m}}', CAST(p_size + 10 AS VARCHAR))".format(i, t) for i, t in enumerate(TEMPLATES)),
)
#: Small brands get one kind of sentence only, so that every case of the inference occurs.
_S = f"SELECT p_brand AS entity, p_partkey AS chunk_id, 0 AS pos, {_TEXT} AS sentence FROM part WHERE p_partkey % 12 <> 0 OR p_partkey % 5 = 0"


def sentences(spark, sf):
    part = table(spark, sf, "part").where("p_partkey % 12 <> 0 OR p_partkey % 5 = 0")
    text = F.lit(None).cast("string")
    for i, t in enumerate(TEMPLATES):
        filled = F.replace(F.replace(F.lit(t), F.lit("{n}"), F.col("p_size").cast("string")), F.lit("{m}"), (F.col("p_size") + 10).cast("string"))
        text = F.when(F.col("p_partkey") % len(TEMPLATES) == i, filled).otherwise(text)
    return part.select(F.col("p_brand").alias("entity"), F.col("p_partkey").alias("chunk_id"), F.lit(0).alias("pos"), text.alias("sentence"))


_UNITS = H.UNITS
_LOW_CONTEXT = "regexp_matches(lower(sentence), '{}')"


def _num(pattern: str, group: int = 1, text: str = "lower(sentence)") -> str:
    return f"TRY_CAST(regexp_extract({text}, '{pattern}', {group}) AS INT)"


_VAGUE = f"regexp_matches(lower(sentence), '{H.INEXACT}')"
_EXACT = "coalesce(" + ", ".join(f"CASE WHEN {_num(p)} > 0 THEN {{'value': {_num(p)}, 'score': {s} + bonus}} END" for p, s in H.EXACT) + ")"
_EXACT_ROWS = f"""
    SELECT entity, chunk_id, sentence, x.value AS value, x.score AS score FROM (
        SELECT *, {_EXACT} AS x FROM (SELECT *, CASE WHEN contains(lower(sentence), 'headcount') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(lower(sentence), '{_UNITS}') THEN 1 ELSE 0 END AS bonus FROM ({_S}))
        WHERE NOT regexp_matches(lower(sentence), '{H.RANGE_OR_PLUS}') AND NOT {_VAGUE}) WHERE x IS NOT NULL
"""


@query(f"SELECT chunk_id, value, score FROM ({_EXACT_ROWS})")
def headcount_exact(spark, sf):
    found = sentences(spark, sf).withColumn("x", H.exact(F.col("sentence"))).where("x IS NOT NULL")
    return found.select("chunk_id", "x.value", "x.score")


@query(f"""
    SELECT entity, value, n, score, chunk_id, n_values > 1 AS conflict FROM (
        SELECT entity, value, count(*) AS n, max(score) AS score, arg_min(chunk_id, (-score, chunk_id)) AS chunk_id, count(*) OVER (PARTITION BY entity) AS n_values,
            row_number() OVER (PARTITION BY entity ORDER BY count(*) DESC, max(score) DESC, value) AS k FROM ({_EXACT_ROWS}) GROUP BY entity, value) WHERE k = 1
""")
def headcount_majority(spark, sf):
    """The number that most sentences of an entity state; its citation is the first that scores best."""
    from pyspark.sql import Window as W

    found = sentences(spark, sf).withColumn("x", H.exact(F.col("sentence"))).where("x IS NOT NULL").select("entity", "chunk_id", "x.*")
    each = found.groupBy("entity", "value").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("score"), F.min(F.struct(-F.col("score"), "chunk_id"))["chunk_id"].alias("chunk_id"))
    each = each.withColumns({"conflict": F.count(F.lit(1)).over(W.partitionBy("entity")) > 1, "k": F.row_number().over(W.partitionBy("entity").orderBy(F.desc("n"), F.desc("score"), "value"))})
    return each.where("k = 1").drop("k")


_A, _B, _P, _ONE = _num(H.RANGE), _num(H.RANGE, 2), _num(H.PLUS.replace("'", "")), _num(H.ANY_EXACT)
_ROWS = f"""
    SELECT entity, chunk_id, sentence, x.field AS field, x.value AS value, x.score AS score, x.kind AS kind FROM (SELECT *, CASE
        WHEN regexp_matches(lower(sentence), '{H.RANGE}') THEN {{'field': 'headcount_range', 'value': least({_A}, {_B}) || '-' || greatest({_A}, {_B}), 'score': CASE WHEN {_VAGUE} THEN 9.2 ELSE 8.8 END::DOUBLE, 'kind': 'explicit'}}
        WHEN regexp_matches(lower(sentence), '{H.PLUS}') THEN {{'field': 'headcount_range', 'value': {_P} || '+', 'score': CASE WHEN {_VAGUE} THEN 8.5 ELSE 8.2 END::DOUBLE, 'kind': 'explicit'}}
        WHEN regexp_matches(lower(sentence), '{H.ANY_EXACT}') AND NOT {_VAGUE} THEN {{'field': 'headcount', 'value': CAST({_ONE} AS VARCHAR), 'score': 8.4::DOUBLE, 'kind': 'explicit'}}
        WHEN regexp_matches(lower(sentence), '{H.ANY_EXACT}') THEN {{'field': 'headcount_range', 'value': {_ONE} || '+', 'score': 7.4::DOUBLE, 'kind': 'ambiguous'}} END AS x
        FROM ({_S}) WHERE length(sentence) >= 30 AND regexp_matches(lower(sentence), '{"|".join(H.CONTEXT)}')) WHERE x IS NOT NULL
"""


def evidence_rows(spark, sf):
    return sentences(spark, sf).withColumn("x", H.evidence(F.col("sentence"))).where("x IS NOT NULL").select("entity", "chunk_id", "sentence", "x.*")


@query(f"SELECT chunk_id, field, value, score, kind FROM ({_ROWS})")
def headcount_rows(spark, sf):
    return evidence_rows(spark, sf).drop("entity", "sentence")


_FIELDS = [("headcount",), ("headcount_range",)]


@query(f"""
    SELECT e.entity, f.field, coalesce(n, 0) AS n, first_chunk, best_value, CASE WHEN n > 0 THEN 'MENTIONED_EXPLICIT' ELSE 'NOT_FOUND_IN_RETRIEVED' END AS status
    FROM (SELECT DISTINCT p_brand AS entity FROM part) e CROSS JOIN (VALUES {sql_values(_FIELDS)}) AS f(field) LEFT JOIN (
        SELECT entity, field, count(*) AS n, min(chunk_id) FILTER (k = 1) AS first_chunk, min(value) FILTER (k = 1) AS best_value FROM (
            SELECT *, row_number() OVER (PARTITION BY entity, field ORDER BY score DESC, chunk_id) AS k FROM (SELECT * FROM ({_ROWS}) QUALIFY row_number() OVER (PARTITION BY entity, field, chunk_id, sentence ORDER BY score DESC) = 1)
        ) WHERE k <= 6 GROUP BY entity, field) USING (entity, field)
""")
def headcount_fields(spark, sf):
    """The six best rows of each entity and field, and the field's status."""
    first = E.best(evidence_rows(spark, sf), ["entity", "field"], 6, [F.desc("score"), F.asc("chunk_id")], ["chunk_id", "sentence"])
    top = F.col("rank") == 1
    found = first.groupBy("entity", "field").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(top, F.col("chunk_id"))).alias("first_chunk"), F.max(F.when(top, F.col("value"))).alias("best_value"))
    every = table(spark, sf, "part").select(F.col("p_brand").alias("entity")).distinct().crossJoin(F.broadcast(values(spark, _FIELDS, "field string")))  # two rows
    status = F.when(F.col("n") > 0, "MENTIONED_EXPLICIT").otherwise("NOT_FOUND_IN_RETRIEVED")
    return every.join(found, ["entity", "field"], "left").select("entity", "field", F.coalesce("n", F.lit(0)).alias("n"), "first_chunk", "best_value", status.alias("status"))


_PIVOT = f"""CASE WHEN regexp_matches(l, '{H.STAGE_RANGE}') THEN {{'pivot': round_even(({_num(H.STAGE_RANGE, 1, "l")} + {_num(H.STAGE_RANGE, 2, "l")}) / 2.0, 0)::INT, 'confidence': 0.74::DOUBLE, 'exact': FALSE}}
    WHEN regexp_matches(l, '{H.PLUS}') THEN {{'pivot': {_num(H.PLUS, 1, "l")}, 'confidence': 0.70::DOUBLE, 'exact': FALSE}}
    WHEN regexp_matches(l, '{H.INEXACT}') THEN {{'pivot': coalesce({_num(H.STAGE_UNITS, 1, "l")}, {_num(H.STAGE_EXACT, 1, "l")}), 'confidence': 0.70::DOUBLE, 'exact': FALSE}}
    ELSE {{'pivot': coalesce({_num(H.STAGE_EXACT, 1, "l")}, {_num(H.STAGE_UNITS, 1, "l")}), 'confidence': 0.78::DOUBLE, 'exact': TRUE}} END"""
_SIGNALS = f"""
    SELECT entity, s.pivot AS pivot, s.confidence AS confidence, s.exact AS exact, chunk_id FROM (SELECT *, {_PIVOT} AS s FROM (SELECT *, lower(sentence) AS l FROM ({_S}))
        WHERE regexp_matches(l, '{"|".join(H.STAGE_CONTEXT)}') AND {" AND ".join(f"NOT regexp_matches(l, '{p}')" for p in H.OTHER_NUMBERS)})
    WHERE s.pivot IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity ORDER BY s.confidence DESC, chunk_id) = 1
"""


@query(_SIGNALS)
def stage_sentence(spark, sf):
    return S.sentence_signals(sentences(spark, sf)).drop("pos")


_ALIASES = S.funding_aliases(STAGES)
_FUNDING = f"""
    SELECT entity, stage, round(sum(CASE WHEN starts_with(alias, 'series ') THEN 1.4 ELSE 1.0 END)::DOUBLE, 6) AS score
    FROM ({_S}) JOIN (VALUES {sql_values(_ALIASES)}) AS a(stage, alias) ON regexp_matches(lower(sentence), '\\b' || replace(alias, '+', '\\+') || '\\b') GROUP BY ALL
"""


@query(_FUNDING)
def funding_scores(spark, sf):
    return S.funding_scores(sentences(spark, sf), _ALIASES)


def locations(spark, sf):
    """Where an entity is: three of the nations, by its brand's number."""
    nation = F.broadcast(table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("location")))  # 25 rows
    brand = table(spark, sf, "part").select(F.col("p_brand").alias("entity"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("b")).distinct()
    return brand.join(nation, (F.col("b") % 25 == F.col("n_nationkey")) | ((F.col("b") % 3 == 0) & (F.col("n_nationkey") == 6))).select("entity", "location")


_LOCATIONS = r"""
    SELECT entity, n_name AS location FROM (SELECT DISTINCT p_brand AS entity, CAST(regexp_extract(p_brand, '(\d+)', 1) AS INT) AS b FROM part) JOIN nation ON b % 25 = n_nationkey OR (b % 3 = 0 AND n_nationkey = 6)
"""
_COMPLEX = f"""
    SELECT DISTINCT entity, signal FROM (
        SELECT entity, p AS signal FROM ({_S}), (VALUES {sql_values([(p,) for p in S.PROXIES])}) AS v(p) WHERE contains(lower(sentence), p)
        UNION ALL SELECT entity, 'board_of_directors' FROM ({_S}) WHERE regexp_matches(lower(sentence), '{S.BOARD}')
        UNION ALL SELECT entity, 'multi-state' FROM ({_LOCATIONS}) GROUP BY entity HAVING count(DISTINCT lower(trim(location))) >= 2
        UNION ALL SELECT entity, 'multi-country' FROM ({_LOCATIONS}) WHERE regexp_matches(lower(location), '{"|".join(S.ABROAD)}'))
"""


@query(_COMPLEX)
def complexity_signals(spark, sf):
    return S.complexity_signals(sentences(spark, sf), locations(spark, sf))


_NUMBER = r"CAST(regexp_extract(p_brand, '(\d+)', 1) AS INT)"
_ENTITIES = f"""
    SELECT entity, CASE WHEN b % 5 = 0 THEN b END AS headcount, b % 2 = 0 AS headcount_exact, CASE b % 4 WHEN 1 THEN b || '-' || (b + 7) WHEN 3 THEN b || '+' END AS headcount_range
    FROM (SELECT DISTINCT p_brand AS entity, {_NUMBER} AS b FROM part)
"""


def entities(spark, sf):
    b = F.col("b")
    brand = table(spark, sf, "part").select(F.col("p_brand").alias("entity"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("b")).distinct()
    span = F.when(b % 4 == 1, F.concat_ws("-", b, b + 7)).when(b % 4 == 3, F.concat(b.cast("string"), F.lit("+")))
    return brand.select("entity", F.when(b % 5 == 0, b).alias("headcount"), (b % 2 == 0).alias("headcount_exact"), span.alias("headcount_range"))


def inferred(spark, sf):
    bands = values(spark, BANDS, "band string, lo int, hi int, ord int")
    # Brands whose number leaves 2 on division by 4 are judged by their sentences; a third of those have none.
    said = sentences(spark, sf).where("regexp_extract(entity, '([0-9]+)', 1) % 3 <> 2")
    return S.infer(entities(spark, sf), said, locations(spark, sf), F.broadcast(bands), STAGES, {b: hi for b, _, hi, _ in BANDS})


_SAID = f"SELECT * FROM ({{}}) WHERE CAST(regexp_extract(entity, '([0-9]+)', 1) AS INT) % 3 <> 2"
_GUESS = "CASE stage_id " + " ".join(f"WHEN '{b}' THEN '{S.size_funding(STAGES, hi)}'" for b, _, hi, _ in BANDS) + " END"
_RANGE_PIVOT = r"coalesce(CASE WHEN regexp_matches(headcount_range, '(\d{1,5})\s*(?:-|to)\s*(\d{1,5})') THEN round_even((CAST(regexp_extract(headcount_range, '(\d{1,5})\s*(?:-|to)\s*(\d{1,5})', 1) AS INT) + CAST(regexp_extract(headcount_range, '(\d{1,5})\s*(?:-|to)\s*(\d{1,5})', 2) AS INT)) / 2.0, 0)::INT END, TRY_CAST(regexp_extract(headcount_range, '(\d{1,5})', 1) AS INT))"
_INFER = f"""
    WITH e AS (SELECT *, {_RANGE_PIVOT} AS rp FROM ({_ENTITIES})),
    sig AS ({_SAID.format(_SIGNALS)}),
    k AS (
        SELECT e.entity, headcount_range, CASE WHEN headcount IS NOT NULL THEN headcount WHEN rp IS NOT NULL THEN rp ELSE sig."pivot" END AS pv,
            CASE WHEN headcount IS NOT NULL THEN CASE WHEN headcount_exact THEN 1.0 ELSE 0.72 END WHEN rp IS NOT NULL THEN 0.72 ELSE confidence END::DOUBLE AS c0,
            CASE WHEN headcount IS NOT NULL THEN headcount_exact WHEN rp IS NOT NULL THEN FALSE ELSE coalesce(exact, FALSE) END AS ex FROM e LEFT JOIN sig USING (entity)
    ), p AS (SELECT k.*, band, band IS NOT NULL AS num FROM k LEFT JOIN (VALUES {sql_values(BANDS)}) AS b(band, lo, hi, ord) ON pv >= lo AND (hi IS NULL OR pv <= hi)),
    x AS (SELECT *, num AND ex AS exact, num AND NOT ex AND band = 'b4' AS capped FROM p),
    prox AS (SELECT DISTINCT entity FROM ({_SAID.format(_COMPLEX)} AND signal NOT IN ('multi-country', 'multi-state')
        UNION ALL SELECT * FROM ({_COMPLEX}) WHERE signal IN ('multi-country')) WHERE signal IN ({", ".join(f"'{s}'" for s in S.PROVE_TOP)})),
    fund AS (SELECT entity, stage, least(0.9, 0.56 + 0.08 * score) AS fc FROM ({_SAID.format(_FUNDING)}) JOIN (VALUES {sql_values([(s, i) for i, (s, _, _) in enumerate(STAGES)])}) AS o(stage, i) USING (stage)
        QUALIFY row_number() OVER (PARTITION BY entity ORDER BY score DESC, i) = 1),
    y AS (SELECT x.*, CASE WHEN NOT num THEN 'b1' WHEN capped THEN 'b3' ELSE band END AS stage_id, prox.entity IS NOT NULL AND NOT exact AS proxy, stage, round(fc, 3) AS fc
        FROM x LEFT JOIN prox USING (entity) LEFT JOIN fund USING (entity)),
    z AS (SELECT *, coalesce(stage, {_GUESS}) AS funding, coalesce(fc, 0.34)::DOUBLE AS funding_confidence,
        CASE WHEN capped THEN greatest(0.22, c0 - 0.1) WHEN num THEN c0 ELSE 0.3 END AS c1 FROM y),
    q AS (SELECT *, CASE WHEN proxy THEN greatest(0.25, c1 - 0.08) ELSE c1 END AS c2 FROM z),
    r AS (SELECT *, CASE WHEN num THEN c2 ELSE least(c2, 0.68) END AS c3 FROM q)
    SELECT entity, stage_id, round_even(greatest(0.05, least(1.0, CASE WHEN stage IS NOT NULL THEN 0.7 * c3 + 0.3 * funding_confidence ELSE least(c3, funding_confidence) END))::DOUBLE, 3) AS confidence,
        CASE WHEN num THEN 'rules' ELSE 'unknown' END AS source, exact, stage_id AS stage_min, CASE WHEN capped OR proxy THEN 'b4' ELSE stage_id END AS stage_max, funding, funding_confidence, stage IS NOT NULL AS funding_stated,
        concat_ws(',', CASE WHEN NOT exact THEN 'explicit_headcount' END, CASE WHEN coalesce(headcount_range, '') = '' THEN 'headcount_range' END, CASE WHEN stage IS NULL THEN 'funding_round' END) AS missing FROM r
"""


@query(_INFER)
def stage_by_entity(spark, sf):
    return inferred(spark, sf)


@query(f"""
    SELECT entity, band AS alternative, alternative_confidence, rank FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY alternative_confidence DESC, ord) AS rank FROM (
        SELECT i.entity, b.band, b.ord, round(greatest(0.1, confidence - 0.18)::DOUBLE, 3) AS alternative_confidence FROM ({_INFER}) i JOIN (VALUES {sql_values(BANDS)}) AS a(stage_id, lo, hi, ord0) USING (stage_id)
        JOIN (VALUES {sql_values(BANDS)}) AS b(band, lo2, hi2, ord) ON abs(b.ord - a.ord0) = 1)) WHERE rank <= 2
""")
def stage_alternatives(spark, sf):
    return S.alternatives(inferred(spark, sf), F.broadcast(values(spark, BANDS, "band string, lo int, hi int, ord int")))


@query(f"SELECT entity, confidence < 0.62 AS provisional, funding || ' | ' || stage_id AS label FROM ({_INFER})")
def stage_label(spark, sf):
    return inferred(spark, sf).select("entity", S.provisional(F.col("confidence")).alias("provisional"), F.concat_ws(" | ", "funding", "stage_id").alias("label"))
