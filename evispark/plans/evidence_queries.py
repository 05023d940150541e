"""Queries over evidence: matching, ranking, rollups, red flags, audits."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evispark import lexicon as L
from evispark.functions import citation
from evispark.functions import text as T
from evispark.operators import decide as D
from evispark.operators import evidence as E
from evispark.operators import match as M
from evispark.plans import matching_queries as MQ
from evispark.plans.registry import once, query, sql_values, table, values
from evispark.storage import stored

TOP = 6
#: Characters of a document's beginning that a row shows.
SNIPPET = 300
POSITIVE, NEGATIVE = [" the ", " des "], [" no ", " not ", " nicht ", " pas "]
FIELDS = ["policies", "hiring", "benefits"]

_PAIRS = f"SELECT doc_id, item_id, n_phrases AS hits FROM ({MQ.MATCH}) WHERE n_phrases > 0"
_FLAT = r"regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_CLIP = f"CASE WHEN length(f) <= {SNIPPET} THEN f ELSE rtrim(substr(f, 1, {SNIPPET})) || '...' END"
_KIND = f"CASE WHEN {' OR '.join(f'contains(lower(snippet), {p!r})' for p in NEGATIVE)} THEN 'explicit_absence' WHEN {' OR '.join(f'contains(lower(snippet), {p!r})' for p in POSITIVE)} THEN 'explicit' ELSE 'implicit' END"
_TOP = f"""
    SELECT item_id, doc_id, n_terms, n_phrases, score, rank, snippet, {_KIND} AS kind FROM (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM ({MQ.MATCH})) WHERE rank <= {TOP}
    ) JOIN (SELECT doc_id, {_CLIP} AS snippet FROM (SELECT doc_id, {_FLAT} AS f FROM documents)) USING (doc_id)
"""
_SEARCHED = f"SELECT count(*) FROM documents WHERE NOT ({MQ.UNSEARCHABLE})"
_STATUS = f"""
    SELECT b.item_id, CASE WHEN kind IN ('explicit', 'explicit_absence') THEN 'MENTIONED_EXPLICIT' WHEN kind = 'implicit' THEN 'MENTIONED_IMPLICIT' WHEN ({_SEARCHED}) > 0 THEN 'NOT_FOUND_IN_RETRIEVED' ELSE 'NOT_RETRIEVED' END AS status,
        coalesce(n, 0) AS n_rows
    FROM ({MQ.RUBRIC}) b LEFT JOIN (SELECT item_id, max(kind) FILTER (rank = 1) AS kind, count(*) AS n FROM ({_TOP}) GROUP BY item_id) USING (item_id)
"""
#: One field or two that an item speaks of.
_ITEM_FIELDS = f"SELECT item_id, unnest(fields) AS field FROM (SELECT item_id, CASE WHEN item_id % 4 = 0 THEN [a, b] ELSE [a] END AS fields FROM (SELECT item_id, ['{"', '".join(FIELDS)}'][item_id % 3 + 1] AS a, ['{"', '".join(FIELDS)}'][(item_id + 1) % 3 + 1] AS b FROM ({MQ.RUBRIC})))"


def item_fields(spark, sf):
    """item_id, field: a row for each field of an item."""
    names, key = F.array(*map(F.lit, FIELDS)), F.col("item_id")
    a, b = (F.get(names, ((key + k) % 3).cast("int")) for k in (0, 1))
    return MQ.rubric(spark, sf).select("item_id", F.explode(F.when(key % 4 == 0, F.array(a, b)).otherwise(F.array(a))).alias("field"))


@once
def top(spark, sf):
    """The best documents of each item by the full score, with what a row shows and says."""
    found = MQ.matched(spark, sf).withColumns({"n_terms": F.col("n_terms").cast("long"), "n_phrases": F.col("n_phrases").cast("long")})
    best = stored(E.best(found, ["item_id"], TOP, [F.desc("score"), F.asc("chunk_id")], []).withColumnRenamed("chunk_id", "doc_id"), "best")
    shown = best.join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").withColumn("snippet", T.clip(F.col("text"), SNIPPET))
    kind = D.evidence_kind(F.col("snippet"), F.col("n_terms") > 0, POSITIVE, NEGATIVE)
    return shown.select("item_id", "doc_id", "n_terms", "n_phrases", "score", "rank", "snippet", kind.alias("kind"))


def status(spark, sf):
    """item_id, status, n_rows: items without rows are told apart by whether there was anything to search."""
    first = top(spark, sf).groupBy("item_id").agg(F.max(F.when(F.col("rank") == 1, F.col("kind"))).alias("kind"), F.count(F.lit(1)).alias("n"))
    searched = MQ.searched(spark, sf).agg(F.count(F.lit(1)).alias("searched"))
    found = MQ.rubric(spark, sf).select("item_id").join(first, "item_id", "left").crossJoin(searched)  # one row
    return found.select("item_id", D.retrieval_status(F.col("kind"), F.col("searched")).alias("status"), F.coalesce("n", F.lit(0)).alias("n_rows"))


@query(_PAIRS)
def phrase_match(spark, sf):
    """Documents that have a phrase of an item, and how many of its queries have one there."""
    return MQ.matched(spark, sf).where("n_phrases > 0").select(F.col("chunk_id").alias("doc_id"), "item_id", F.col("n_phrases").cast("long").alias("hits"))


@query(f"SELECT item_id, doc_id, n_terms, n_phrases, score FROM ({MQ.MATCH})")
def evidence_score(spark, sf):
    found = MQ.matched(spark, sf)
    return found.select("item_id", F.col("chunk_id").alias("doc_id"), F.col("n_terms").cast("long").alias("n_terms"), F.col("n_phrases").cast("long").alias("n_phrases"), "score")


@query(f"SELECT item_id, doc_id, n_terms, n_phrases, score, kind, rank FROM ({_TOP})")
def evidence_topk(spark, sf):
    return top(spark, sf).select("item_id", "doc_id", "n_terms", "n_phrases", "score", "kind", "rank")


@query(_STATUS)
def retrieval_status(spark, sf):
    return status(spark, sf)


_RANKS = sql_values(list(L.RETRIEVAL_RANK.items()))


@query(f"""
    SELECT field, arg_max(status, r) AS status, max(r) AS rank, count(*) AS n_items FROM ({_STATUS}) s
    JOIN (VALUES {_RANKS}) AS k(status, r) USING (status) JOIN ({_ITEM_FIELDS}) USING (item_id) GROUP BY field
""")
def field_rollup(spark, sf):
    found = status(spark, sf).withColumn("r", D.rank_of(F.col("status"), L.RETRIEVAL_RANK)).join(item_fields(spark, sf), "item_id")
    return found.groupBy("field").agg(F.max_by("status", "r").alias("status"), F.max("r").alias("rank"), F.count(F.lit(1)).alias("n_items"))


@query(f"SELECT status, count(*) AS n, sum(n_rows)::BIGINT AS n_rows FROM ({_STATUS}) GROUP BY status")
def coverage_summary(spark, sf):
    return status(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("n_rows").alias("n_rows"))


FLAGS = [("email", "[a-z0-9._]+@[a-z0-9.]+"), ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"), ("license", "license"), ("secret", "token =")]


@query(" UNION ALL ".join(
    f"SELECT '{rule}' AS rule, doc_id FROM (SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '{p}') ORDER BY doc_id LIMIT 3)" for rule, p in FLAGS
))
def red_flags(spark, sf):
    hits = M.pattern_hits(table(spark, sf, "documents").select("doc_id", F.lower("text").alias("text")), FLAGS)
    order = W.partitionBy("rule").orderBy("doc_id")
    return hits.withColumn("k", F.row_number().over(order)).where("k <= 3").select("rule", "doc_id")


@query(f"""
    SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(lower(text), '{"|".join(f"(?:{p})" for p in L.NEGATIVE)}') THEN 'explicit_absence'
        WHEN regexp_matches(lower(text), '{"|".join(f"(?:{p})" for p in L.POSITIVE)}') THEN 'explicit'
        WHEN contains(text, 'the') THEN 'implicit' ELSE 'ambiguous' END AS kind FROM documents) GROUP BY kind
""")
def evidence_kinds(spark, sf):
    kind = D.evidence_kind(F.col("text"), F.col("text").contains("the"))
    return table(spark, sf, "documents").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


VERDICTS = ["present", "explicitly_missing", "ambiguous", "conflict", "not_found", "other"]


@query(f"""
    SELECT v.verdict, r.retrieval, e.relevant, a.ran, CASE WHEN NOT ran THEN 'not_assessed' WHEN verdict IN ('present', 'explicitly_missing') THEN verdict
        WHEN verdict IN ('ambiguous', 'conflict') THEN CASE WHEN relevant THEN 'ambiguous' ELSE 'not_provided_in_sources' END
        WHEN verdict = 'not_found' AND retrieval = 'NOT_RETRIEVED' THEN 'not_assessed' ELSE 'not_provided_in_sources' END AS status
    FROM (VALUES {sql_values([(v,) for v in VERDICTS])}) AS v(verdict), (VALUES {sql_values([(r,) for r in L.RETRIEVAL_RANK])}) AS r(retrieval),
        (VALUES (TRUE), (FALSE)) AS e(relevant), (VALUES (TRUE), (FALSE)) AS a(ran)
""")
def status_mapping(spark, sf):
    rows = [(v, r, e, a) for v in VERDICTS for r in L.RETRIEVAL_RANK for e in (True, False) for a in (True, False)]
    found = values(spark, rows, "verdict string, retrieval string, relevant boolean, ran boolean")
    return found.withColumn("status", D.evidence_status(*map(F.col, found.columns)))


@query(f"""
    WITH t AS ({_TOP}), c AS (SELECT item_id, doc_id FROM t UNION ALL SELECT item_id, 1000000000 + item_id FROM benchmark WHERE item_id % 7 = 0)
    SELECT count(*) AS cited, count(*) FILTER (d.doc_id IS NULL) AS unknown, count(DISTINCT c.doc_id) AS cited_docs FROM c LEFT JOIN documents d USING (doc_id)
""")
def citation_audit(spark, sf):
    items = table(spark, sf, "benchmark").where("item_id % 7 = 0").select("item_id", (F.lit(1000000000) + F.col("item_id")).alias("doc_id"))
    cited = top(spark, sf).select("item_id", "doc_id").unionByName(items)
    known = table(spark, sf, "documents").select("doc_id", F.lit(1).alias("known"))
    return cited.join(known, "doc_id", "left").agg(
        F.count(F.lit(1)).alias("cited"), F.count_if(F.col("known").isNull()).alias("unknown"), F.countDistinct("doc_id").alias("cited_docs")
    )


@query(r"""
    SELECT doc_id, length(c) AS chars, sha256(c) AS digest FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        text, '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), 'https?://\S+', ' ', 'g'), '[#*_`>|]+', ' ', 'g'), '[^\x20-\x7E]+', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS c FROM documents)
""")
def citation_sanitize(spark, sf):
    clean = T.unlinked(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.length(clean).cast("long").alias("chars"), F.sha2(clean, 256).alias("digest"))


@query()
def citation_snippet(spark, sf):
    """citation_sanitize with the sentence that a citation shows."""
    clean = T.unlinked(F.col("text"))
    found = citation.snippet(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.length(clean).cast("long").alias("chars"), F.sha2(clean, 256).alias("digest"), found.alias("snippet"))


@query(r"""
    SELECT key, count(*) AS n, max(CASE role WHEN 'user' THEN 3 WHEN 'system' THEN 2 ELSE 1 END) AS severity, min(conv_id) AS first_conv
    FROM (SELECT conv_id, role, regexp_replace(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS key FROM conversations)
    WHERE key <> '' GROUP BY key ORDER BY n * severity DESC, severity DESC, n DESC, key LIMIT 8
""")
def follow_up_questions(spark, sf):
    severity = F.when(F.col("role") == "user", 3).when(F.col("role") == "system", 2).otherwise(1)
    found = table(spark, sf, "conversations").select("conv_id", severity.alias("s"), T.question_key(F.col("text")).alias("key")).where("key <> ''")
    found = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("s").alias("severity"), F.min("conv_id").alias("first_conv"))
    return found.orderBy((F.col("n") * F.col("severity")).desc(), F.desc("severity"), F.desc("n"), "key").limit(8)


@query(f"""
    SELECT status, count(*) AS n, sum(CASE WHEN rn <= 4 THEN 1 ELSE 0 END)::BIGINT AS kept, min(item_id) AS first_item
    FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY n_rows DESC, item_id) AS rn FROM ({_STATUS})) GROUP BY status
""")
def evidence_memo(spark, sf):
    found = status(spark, sf).withColumn("rn", F.row_number().over(W.partitionBy("status").orderBy(F.desc("n_rows"), "item_id")))
    return found.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rn") <= 4).alias("kept"), F.min("item_id").alias("first_item"))
