"""Queries that join bands, rules and aliases, merge by precedence, and roll findings up."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evispark import lexicon as L
from evispark.functions import text as T
from evispark.operators import decide as D
from evispark.plans.registry import query, sql_values, table, values

BANDS = [("micro", 1, 10, 1), ("small", 11, 20, 2), ("medium", 21, 35, 3), ("large", 36, 45, 4), ("top", 46, None, 5)]
_BANDS = f"(VALUES {sql_values(BANDS)}) AS b(band, lo, hi, ord)"
_SEV = "CASE WHEN toxic = 1 AND quality = 0 THEN 'critical' WHEN toxic = 1 THEN 'high' WHEN quality = 0 THEN 'medium' ELSE 'low' END"
_EVI = "CASE doc_id % 4 WHEN 0 THEN 'explicitly_missing' WHEN 1 THEN 'present' WHEN 2 THEN 'ambiguous' ELSE 'not_assessed' END"
_FINDINGS = f"SELECT doc_id, source AS area, substr(sha256(text), 1, 12) AS title, {_SEV} AS severity, {_EVI} AS status FROM labels JOIN documents USING (doc_id)"


def findings(spark, sf):
    """One finding per labelled document: area, title, severity, status."""
    toxic, good = F.col("toxic") == 1, F.col("quality") == 1
    severity = F.when(toxic & ~good, "critical").when(toxic, "high").when(~good, "medium").otherwise("low")
    turn = F.col("doc_id") % 4
    status = F.when(turn == 0, "explicitly_missing").when(turn == 1, "present").when(turn == 2, "ambiguous").otherwise("not_assessed")
    found = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return found.select("doc_id", F.col("source").alias("area"), F.substring(F.sha2("text", 256), 1, 12).alias("title"), severity.alias("severity"), status.alias("status"))


@query(f"SELECT p_partkey, band, ord FROM part JOIN {_BANDS} ON p_size >= lo AND (hi IS NULL OR p_size <= hi)")
def band_range_join(spark, sf):
    bands = F.broadcast(values(spark, BANDS, "band string, lo int, hi int, ord int"))  # five rows
    inside = (F.col("p_size") >= F.col("lo")) & (F.col("hi").isNull() | (F.col("p_size") <= F.col("hi")))
    return table(spark, sf, "part").join(bands, inside).select("p_partkey", "band", "ord")


@query(f"SELECT band, lag(band) OVER (ORDER BY ord) AS before, lead(band) OVER (ORDER BY ord) AS after, greatest(0.1, round(0.74 - 0.18, 2))::DOUBLE AS confidence FROM {_BANDS}")
def adjacent_bands(spark, sf):
    order = W.orderBy("ord")
    bands = values(spark, BANDS, "band string, lo int, hi int, ord int")
    return bands.select("band", F.lag("band").over(order).alias("before"), F.lead("band").over(order).alias("after"), F.greatest(F.lit(0.1), F.round(F.lit(0.74) - 0.18, 2)).alias("confidence"))


ALIASES = [("a", "series the", 1), ("b", "the", 2), ("b", "of", 2), ("c", "les", 3), ("d", "und", 4)]


@query(f"""
    SELECT source, stage, score, least(0.9, round(0.56 + 0.08 * score, 3))::DOUBLE AS confidence FROM (
        SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, ord) AS k FROM (
            SELECT source, stage, ord, round(sum(CASE WHEN starts_with(alias, 'series ') THEN 1.4 ELSE 1.0 END), 4)::DOUBLE AS score
            FROM documents JOIN (VALUES {sql_values(ALIASES)}) AS a(stage, alias, ord)
                ON regexp_matches(lower(text), '(?:^|[^a-z0-9])' || alias || '(?:$|[^a-z0-9])') GROUP BY source, stage, ord)) WHERE k = 1
""")
def alias_score_argmax(spark, sf):
    # The aliases are literals: one scan finds the rows of each, and no pattern varies by row.
    low = F.lower("text")
    hits = [
        F.when(low.rlike(f"(?:^|[^a-z0-9]){alias}(?:$|[^a-z0-9])"), F.struct(F.lit(stage).alias("stage"), F.lit(ord_).alias("ord"), F.lit(1.4 if alias.startswith("series ") else 1.0).alias("boost")))
        for stage, alias, ord_ in ALIASES
    ]
    found = table(spark, sf, "documents").select("source", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h"))
    found = found.groupBy("source", "h.stage", "h.ord").agg(F.round(F.sum("h.boost"), 4).alias("score"))
    best = found.withColumn("k", F.row_number().over(W.partitionBy("source").orderBy(F.desc("score"), "ord"))).where("k = 1")
    return best.select("source", "stage", "score", F.least(F.lit(0.9), F.round(0.56 + 0.08 * F.col("score"), 3)).alias("confidence"))


RULES = [("any", None, None, 3), ("auto", None, "AUTOMOBILE", 2), ("home", 7, None, 5), ("both", 7, "BUILDING", 1)]


@query(f"""
    SELECT c_custkey, rule, specificity FROM (
        SELECT c_custkey, rule, specificity, row_number() OVER (PARTITION BY c_custkey ORDER BY specificity DESC, practices DESC, rule) AS k FROM (
            SELECT c_custkey, rule, practices, 2 * (nation IS NOT NULL)::INT + 2 * (segment IS NOT NULL)::INT AS specificity
            FROM customer JOIN (VALUES {sql_values(RULES)}) AS r(rule, nation, segment, practices)
                ON (nation IS NULL OR nation = c_nationkey) AND (segment IS NULL OR segment = c_mktsegment))) WHERE k = 1
""")
def rule_wildcard_join(spark, sf):
    rules = F.broadcast(values(spark, RULES, "rule string, nation int, segment string, practices int"))
    fits = (F.col("nation").isNull() | (F.col("nation") == F.col("c_nationkey"))) & (F.col("segment").isNull() | (F.col("segment") == F.col("c_mktsegment")))
    found = table(spark, sf, "customer").join(rules, fits)
    found = found.withColumn("specificity", 2 * F.col("nation").isNotNull().cast("int") + 2 * F.col("segment").isNotNull().cast("int"))
    order = W.partitionBy("c_custkey").orderBy(F.desc("specificity"), F.desc("practices"), "rule")
    return found.withColumn("k", F.row_number().over(order)).where("k = 1").select("c_custkey", "rule", "specificity")


@query("""
    SELECT o_custkey, arg_max(o_orderpriority, (r, o_totalprice, -o_orderkey)) AS priority, max(r) AS rank, count(*) AS n
    FROM (SELECT *, CASE left(o_orderpriority, 1) WHEN '1' THEN 5 WHEN '2' THEN 4 WHEN '3' THEN 3 WHEN '4' THEN 2 ELSE 1 END AS r FROM orders) GROUP BY o_custkey
""")
def precedence_merge(spark, sf):
    first = F.substring("o_orderpriority", 1, 1)
    rank = D.rank_of(first, {"1": 5, "2": 4, "3": 3, "4": 2}, 1)
    found = table(spark, sf, "orders").withColumn("r", rank)
    best = F.max_by("o_orderpriority", F.struct("r", "o_totalprice", -F.col("o_orderkey")))
    return found.groupBy("o_custkey").agg(best.alias("priority"), F.max("r").alias("rank"), F.count(F.lit(1)).alias("n"))


@query("""
    SELECT o_custkey, value, n, n_values > 1 AS conflict FROM (
        SELECT o_custkey, value, n, count(*) OVER (PARTITION BY o_custkey) AS n_values, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, value) AS k
        FROM (SELECT o_custkey, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL)) WHERE k = 1
""")
def headcount_vote(spark, sf):
    """Arg-max vote with conflict detection (ties: least value)."""
    found = table(spark, sf, "orders").groupBy("o_custkey", F.col("o_orderstatus").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), "value")).alias("best")
    got = found.groupBy("o_custkey").agg(best, F.count(F.lit(1)).alias("n_values"))
    return got.select("o_custkey", "best.value", (-F.col("best.m")).alias("n"), (F.col("n_values") > 1).alias("conflict"))


_RANKED = f"""
    SELECT doc_id, area, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC,
        CASE status WHEN 'explicitly_missing' THEN 5 WHEN 'ambiguous' THEN 4 WHEN 'not_assessed' THEN 3 ELSE 1 END DESC, area DESC, title DESC, doc_id) AS rank
    FROM ({_FINDINGS})
"""


@query(f"SELECT * FROM ({_RANKED}) WHERE rank <= 50")
def rank_findings(spark, sf):
    keys = [D.rank_of(F.col("severity"), L.SEVERITY).desc(), D.rank_of(F.col("status"), L.STATUS_ORDER).desc(), F.desc("area"), F.desc("title"), F.asc("doc_id")]
    best = findings(spark, sf).orderBy(*keys).limit(50)  # top-k: partial per partition, then one small sort
    return best.select("doc_id", "area", F.row_number().over(W.orderBy(*keys)).alias("rank"))


@query(f"""
    WITH f AS ({_FINDINGS}), a AS (SELECT 'src' || i AS area FROM range(25) t(i))
    SELECT area, n, CASE WHEN mh > 0 THEN 'Under-Developed' WHEN h >= 2 OR uc > 0 THEN 'Developing' WHEN n >= 1 THEN 'Aligned' ELSE 'Strategic' END AS maturity,
        CASE WHEN h > 0 THEN 'Significant' WHEN m > 0 THEN 'Moderate' ELSE 'Limited' END AS impact
    FROM (SELECT a.area, count(f.doc_id) AS n, count(*) FILTER (severity IN ('critical', 'high') AND status = 'explicitly_missing') AS mh,
        count(*) FILTER (severity IN ('critical', 'high')) AS h, count(*) FILTER (severity = 'medium') AS m,
        count(*) FILTER (severity = 'critical' AND status IN ('ambiguous', 'not_assessed', 'not_provided_in_sources')) AS uc
        FROM a LEFT JOIN f USING (area) GROUP BY a.area)
""")
def functional_scorecard(spark, sf):
    severity, status = F.col("severity"), F.col("status")
    high = severity.isin("critical", "high")
    counts = findings(spark, sf).groupBy("area").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(high & (status == "explicitly_missing")).alias("mh"), F.count_if(high).alias("h"),
        F.count_if(severity == "medium").alias("m"), F.count_if((severity == "critical") & D.needs_confirmation(status)).alias("uc"),
    )
    areas = spark.range(25).select(F.concat(F.lit("src"), F.col("id")).alias("area"))
    got = areas.join(counts, "area", "left").na.fill(0)
    return got.select("area", "n", D.maturity(F.col("mh"), F.col("h"), F.col("uc"), F.col("n")).alias("maturity"), D.impact(F.col("h"), F.col("m")).alias("impact"))


@query(f"""
    SELECT doc_id, CASE WHEN status IN ('present', 'ambiguous', 'explicitly_missing') AND doc_id % 5 = 0 THEN 'uncited'
        WHEN status = 'not_assessed' AND doc_id % 5 <> 0 THEN 'cited' WHEN status = 'explicitly_missing' THEN 'no absence text' END AS violation
    FROM ({_FINDINGS}) WHERE violation IS NOT NULL
""")
def constraint_violations(spark, sf):
    cited = F.col("doc_id") % 5 != 0
    violation = (
        F.when(F.col("status").isin("present", "ambiguous", "explicitly_missing") & ~cited, "uncited")
        .when((F.col("status") == "not_assessed") & cited, "cited")
        .when(F.col("status") == "explicitly_missing", "no absence text")
    )
    return findings(spark, sf).select("doc_id", violation.alias("violation")).where("violation IS NOT NULL")


@query("""
    SELECT 'both' AS part, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)
    UNION ALL SELECT 'unlabelled', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
    UNION ALL SELECT 'all', count(*) FROM (SELECT doc_id FROM documents UNION SELECT page_id FROM pages)
    UNION ALL SELECT 'rows', count(*) FROM (SELECT doc_id FROM documents UNION ALL SELECT page_id FROM pages)
""")
def set_ops(spark, sf):
    docs, labels = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id")
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"))
    parts = {"both": docs.intersect(labels), "unlabelled": docs.exceptAll(labels).distinct(), "all": docs.union(pages).distinct(), "rows": docs.union(pages)}
    found = None
    for name, part in parts.items():
        one = part.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        found = one if found is None else found.unionByName(one)
    return found


SIGNALS = [("license", 1), ("token", 2), ("payroll", 3), ("handbook", 4), ("thing", 5)]


@query(f"""
    SELECT signal, ord, n, n = 0 AS missing FROM (SELECT s.signal, s.ord, count(d.doc_id) AS n FROM (VALUES {sql_values(SIGNALS)}) AS s(signal, ord)
        LEFT JOIN documents d ON contains(lower(d.text), s.signal) GROUP BY s.signal, s.ord)
""")
def signals_missing(spark, sf):
    low = F.lower("text")
    found = F.explode(F.filter(F.array(*[F.when(low.contains(s), F.lit(s)) for s, _ in SIGNALS]), lambda x: x.isNotNull()))
    counts = table(spark, sf, "documents").select(found.alias("signal")).groupBy("signal").agg(F.count(F.lit(1)).alias("n"))
    dim = values(spark, SIGNALS, "signal string, ord int")
    got = dim.join(counts, "signal", "left").na.fill(0, ["n"])
    return got.withColumn("missing", F.col("n") == 0)


@query(f"""
    SELECT base, top, proxies, numeric_, round_even(greatest(0.05, least(1.0, CASE WHEN f > 0.45 THEN 0.7 * c3 + 0.3 * f WHEN f IS NOT NULL THEN least(c3, f) ELSE c3 END)), 3)::DOUBLE AS confidence, f AS funding
    FROM (SELECT *, CASE WHEN NOT numeric_ THEN least(c2, 0.68) ELSE c2 END AS c3 FROM (
        SELECT *, CASE WHEN proxies THEN greatest(0.25, c1 - 0.08) ELSE c1 END AS c2 FROM (
            SELECT *, CASE WHEN top THEN greatest(0.22, base - 0.1) ELSE base END AS c1
            FROM (VALUES (1.0::DOUBLE), (0.72), (0.3)) AS b(base), (VALUES (TRUE), (FALSE)) AS t(top), (VALUES (TRUE), (FALSE)) AS p(proxies),
                (VALUES (TRUE), (FALSE)) AS n(numeric_), (VALUES (0.64::DOUBLE), (0.34), (NULL)) AS g(f))))
""")
def stage_confidence(spark, sf):
    rows = [(b, t, p, n, f) for b in (1.0, 0.72, 0.3) for t in (True, False) for p in (True, False) for n in (True, False) for f in (0.64, 0.34, None)]
    found = values(spark, rows, "base double, top boolean, proxies boolean, numeric_ boolean, funding double")
    return found.withColumn("confidence", D.stage_confidence(*map(F.col, found.columns)))


@query()
def stage_inference(spark, sf):
    """Size band and confidence of inline fixtures: exact, range, inexact and no headcount."""
    rows = [(1, "Headcount: 420 employees."), (2, "There are about 50-70 people working here."), (3, "around 135 employees"), (4, "No numbers."), (5, "Team size is 18 full-time employees")]
    bands = values(spark, [("1-49", 1, 49, 1), ("50-99", 50, 99, 2), ("100-250", 100, 250, 3), ("251+", 251, None, 4)], "band string, lo int, hi int, ord int")
    found = values(spark, rows, "id int, text string")
    span = T.headcount_range(F.col("text"))
    exact = T.exact_headcount(F.col("text"), "employees|employee|people|full-time employees|fte")
    low = F.regexp_extract(span, r"^(\d+)", 1).try_cast("int")
    high = F.regexp_extract(span, r"-(\d+)$", 1).try_cast("int")
    value = F.coalesce(exact, F.bround((low + F.coalesce(high, low)) / 2, 0).cast("int"))
    found = found.withColumns({"value": value, "base": F.when(exact.isNotNull(), 1.0).when(span.isNotNull(), 0.72).otherwise(0.3)})
    inside = (F.col("value") >= F.col("lo")) & (F.col("hi").isNull() | (F.col("value") <= F.col("hi")))
    got = found.join(F.broadcast(bands), inside, "left")
    sure = D.stage_confidence(F.col("base"), (F.col("band") == "251+") & (F.col("base") < 1), F.lit(False), F.col("value").isNotNull(), F.lit(None).cast("double"))
    return got.select("id", "value", "band", sure.alias("confidence"))


@query("""
    SELECT source, count(*) FILTER (severity_ = 'high') AS high, bool_or(severity_ = 'critical') AS any_critical, count(*) AS n,
        count(*) < 12 OR count(*) FILTER (doc_id % 4 <> 1) / count(*)::DOUBLE > 0.45 AS low_coverage
    FROM (SELECT source, doc_id, CASE WHEN toxic = 1 AND quality = 0 THEN 'critical' WHEN toxic = 1 THEN 'high' ELSE 'low' END AS severity_ FROM documents JOIN labels USING (doc_id)) GROUP BY source
""")
def coverage_by_source(spark, sf):
    found = findings(spark, sf)
    got = found.groupBy(F.col("area").alias("source")).agg(
        F.count_if(F.col("severity") == "high").alias("high"), F.bool_or(F.col("severity") == "critical").alias("any_critical"),
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("doc_id") % 4 != 1).alias("open"),
    )
    return got.select("source", "high", "any_critical", "n", D.low_coverage(F.col("n"), F.col("open") / F.col("n")).alias("low_coverage"))


@query()
def report(spark, sf):
    """The assembled report: one JSON per section."""
    from evispark.plans.evidence_queries import status

    card = functional_scorecard(spark, sf).select(F.lit("scorecard").alias("section"), F.col("area").alias("key"), F.to_json(F.struct("*")).alias("body"))
    found = status(spark, sf).select(F.lit("evidence").alias("section"), F.col("item_id").cast("string").alias("key"), F.to_json(F.struct("*")).alias("body"))
    top = rank_findings(spark, sf).select(F.lit("findings").alias("section"), F.col("rank").cast("string").alias("key"), F.to_json(F.struct("*")).alias("body"))
    return card.unionByName(found).unionByName(top)
