"""JSON documents set by path and checked by a schema, and evidence corrected by a targeted search."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.functions import document as D
from evispark.functions import text as T
from evispark.operators import overlay as O
from evispark.plans.registry import query, table

# -- set by path -------------------------------------------------------------------------------------


@query("""
    SELECT n_nationkey, trim(n_name) AS name, 'x' || n_nationkey AS deep, n_regionkey::VARCHAR AS region, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey::VARCHAR END AS kept, (n_regionkey * 10)::VARCHAR AS made FROM nation
""")
def json_set_path(spark, sf):
    """What is read back after setting a value beside others, below a missing object, and in place of a scalar."""
    key, region = F.col("n_nationkey"), F.col("n_regionkey")
    inner = F.struct(region.alias("region"), F.lit("old").alias("deep"), F.when(key % 2 == 0, key).alias("kept"))
    found = table(spark, sf, "nation").select("n_nationkey", "n_regionkey", F.to_json(F.struct(F.trim("n_name").alias("name"), inner.alias("place"), F.lit(1).alias("flat"))).alias("j"))
    found = found.withColumn("j", D.set_path(F.col("j"), "place.deep", F.concat(F.lit("x"), key.cast("string"))))
    found = found.withColumn("j", D.set_path(D.set_path(F.col("j"), "flat.made.here", region * 10), "new.list", F.lit(True)))
    read = {"name": "name", "deep": "place.deep", "region": "place.region", "kept": "place.kept", "made": "flat.made.here"}
    return found.select("n_nationkey", *(T.json_path(F.col("j"), path).alias(name) for name, path in read.items()))


# -- report validation -------------------------------------------------------------------------------

SCHEMA = {
    "type": "object", "required": ["id", "verdict", "meta"], "additionalProperties": False,
    "properties": {
        "id": {"type": "integer", "minimum": 1},
        "verdict": {"type": "string", "enum": ["good", "toxic"]},
        "meta": {"type": "object", "required": ["lang"], "properties": {"lang": {"type": ["string", "null"], "minLength": 2}, "score": {"type": "number", "maximum": 0.8}}},
    },
}


@query("""
    WITH r AS (SELECT doc_id, lang, toxic, doc_id % 10 AS tenth, doc_id % 17 = 0 AS broken FROM documents JOIN labels USING (doc_id))
    SELECT doc_id, 'not JSON' AS violation FROM r WHERE broken
    UNION ALL SELECT doc_id, '$.id: minimum' FROM r WHERE NOT broken AND doc_id < 1
    UNION ALL SELECT doc_id, '$.id: type' FROM r WHERE NOT broken AND doc_id % 7 = 3
    UNION ALL SELECT doc_id, '$.verdict: enum' FROM r WHERE NOT broken AND toxic = 0 AND tenth = 4
    UNION ALL SELECT doc_id, '$.meta: required lang' FROM r WHERE NOT broken AND lang IS NULL AND doc_id % 13 <> 5
    UNION ALL SELECT doc_id, '$.meta.score: maximum' FROM r WHERE NOT broken AND tenth = 9 AND doc_id % 13 <> 5
    UNION ALL SELECT doc_id, '$.meta: type' FROM r WHERE NOT broken AND doc_id % 13 = 5
    UNION ALL SELECT doc_id, '$: additionalProperties' FROM r WHERE NOT broken AND doc_id % 11 = 2
    UNION ALL SELECT doc_id, '$: required verdict' FROM r WHERE NOT broken AND toxic IS NULL
""")
def report_violations(spark, sf):
    """Reports made of labelled documents, some of them wrong, against a schema: a row for each rule broken."""
    key = F.col("doc_id")
    rows = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id")
    verdict = F.when(F.col("toxic") == 1, '"toxic"').when(F.col("toxic") == 0, F.when(key % 10 == 4, '"fine"').otherwise('"good"'))
    parts = [
        F.concat(F.lit('"id":'), F.when(key % 7 == 3, F.concat(F.lit('"'), key.cast("string"), F.lit('"'))).otherwise(key.cast("string"))),
        F.concat(F.lit('"verdict":'), verdict),
        F.concat(F.lit('"meta":'), F.when(key % 13 == 5, "[]").otherwise(F.to_json(F.struct("lang", (key % 10 / 10).alias("score"))))),
        F.when(key % 11 == 2, '"more":[1]'),
    ]
    text = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.when(key % 17 == 0, "").otherwise("}"))
    return D.checked(rows.select("doc_id", text.alias("report")), "doc_id", "report", SCHEMA)


# -- recovery ----------------------------------------------------------------------------------------

STATUSES = ["present", "ambiguous", "explicitly_missing", "not_provided_in_sources", "not_assessed"]
RETRIEVALS = ["MENTIONED_EXPLICIT", "MENTIONED_IMPLICIT", "MENTIONED_AMBIGUOUS", "NOT_FOUND_IN_RETRIEVED", "NOT_RETRIEVED"]
_EVIDENCE = f"SELECT p_brand AS entity, p_size % 12 AS field, ['{"', '".join(STATUSES)}'][min(p_partkey) % 5 + 1] AS status, CASE WHEN min(p_partkey) % 3 > 0 THEN min(p_partkey) END AS chunk_id, min(p_partkey) % 2 = 0 AS anchored FROM part WHERE p_size % 14 < 12 GROUP BY ALL"
_SEARCHED = f"SELECT p_brand AS entity, p_size % 13 AS field, ['{"', '".join(RETRIEVALS)}'][max(p_partkey) % 5 + 1] AS retrieval FROM part WHERE p_size % 13 <> 4 GROUP BY ALL"
_FOUND = "SELECT p_brand AS entity, p_size % 13 AS field, p_partkey AS chunk_id, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END AS snippet, p_retailprice::DOUBLE AS score FROM part WHERE p_size % 3 > 0"


@query(f"""
    WITH e AS ({_EVIDENCE}), s AS ({_SEARCHED}), c AS ({_FOUND}),
    b AS (SELECT entity, field, arg_max(chunk_id, (score, -chunk_id)) AS best, arg_max(snippet, (score, -chunk_id)) AS best_text, count(*) AS n FROM c GROUP BY ALL),
    j AS (SELECT coalesce(e.entity, s.entity) AS entity, coalesce(e.field, s.field) AS field, coalesce(status, 'not_provided_in_sources') AS status, retrieval, e.chunk_id, coalesce(anchored, FALSE) AND e.chunk_id IS NOT NULL AS held FROM e FULL JOIN s ON e.entity = s.entity AND e.field = s.field),
    k AS (SELECT j.*, best, n, retrieval IS NOT NULL AS tracked, coalesce(best_text <> '', FALSE) AS usable, status <> 'present' OR NOT held AS weak FROM j LEFT JOIN b USING (entity, field)),
    m AS (SELECT *, tracked AND usable AND weak AND (retrieval = 'MENTIONED_EXPLICIT' OR (retrieval IN ('MENTIONED_IMPLICIT', 'MENTIONED_AMBIGUOUS') AND status <> 'explicitly_missing')) AS taken,
        tracked AND retrieval IN ('NOT_RETRIEVED', 'NOT_FOUND_IN_RETRIEVED') AND status NOT IN ('present', 'explicitly_missing') AS nothing FROM k)
    SELECT entity, field, CASE WHEN taken AND retrieval = 'MENTIONED_EXPLICIT' THEN 'present' WHEN (taken AND status <> 'present') OR nothing THEN 'not_provided_in_sources' ELSE status END AS status, retrieval,
        CASE WHEN taken THEN best WHEN NOT (nothing AND retrieval = 'NOT_RETRIEVED') THEN chunk_id END AS chunk_id, CASE WHEN taken THEN '{O.RECOVERED}' END AS recovered_by, CASE WHEN tracked THEN coalesce(n, 0) END AS match_count FROM m
""")
def retrieval_overlay(spark, sf):
    """Evidence of five statuses, fields with and without a search of five outcomes, and what the search found."""
    part, key = table(spark, sf, "part"), F.col("p_partkey")
    group = lambda n: [F.col("p_brand").alias("entity"), (F.col("p_size") % n).alias("field")]
    pick = lambda names, k: F.get(F.array(*map(F.lit, names)), (k % 5).cast("int"))
    first = part.where("p_size % 14 < 12").groupBy(*group(12)).agg(F.min(key).alias("k"))
    cited = F.when(F.col("k") % 3 > 0, F.col("k"))
    evidence = first.select("entity", "field", pick(STATUSES, F.col("k")).alias("status"), cited.alias("chunk_id"), F.lit("own").alias("snippet"), (F.col("k") % 2 == 0).alias("anchored"))
    searched = part.where("p_size % 13 <> 4").groupBy(*group(13)).agg(F.max(key).alias("k")).select("entity", "field", pick(RETRIEVALS, F.col("k")).alias("retrieval"))
    text = F.when(key % 4 == 0, "").otherwise(F.col("p_name"))
    found = part.where("p_size % 3 > 0").select(*group(13), key.alias("chunk_id"), text.alias("snippet"), F.col("p_retailprice").cast("double").alias("score"), F.lit(True).alias("anchored"))
    return O.overlaid(evidence, searched, found, ["entity", "field"]).drop("snippet", "anchored")
