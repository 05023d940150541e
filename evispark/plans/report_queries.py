"""The report's own tables and lines, and a crawl over made pages that link to one another."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evispark import lexicon as L
from evispark.operators import report as P
from evispark.operators import rubric as R
from evispark.plans import rubric_queries as RQ
from evispark.plans.registry import query, table
from evispark.sources import readers


def _rank(column: str, table_: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table_.items()) + " ELSE 0 END"


_RANKED = f"""
    SELECT *, row_number() OVER (ORDER BY {_rank("severity", L.SEVERITY)} DESC, {_rank("status", L.STATUS_ORDER)} DESC, {_rank("retrieval", L.RETRIEVAL_RANK)} DESC, area DESC, lower(claim) DESC, item_id) AS rank FROM ({RQ._FINDINGS})
"""
_KEY = r"trim(replace(replace(regexp_replace(regexp_replace(regexp_replace(lower(question), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), 'can you confirm', ''), 'do you have', ''))"
_ASKED = f"""
    SELECT question, n, severity, place FROM (SELECT *, row_number() OVER (ORDER BY n * severity DESC, severity DESC, n DESC, first) AS place FROM (
        SELECT arg_min(question, item_id) AS question, count(*) AS n, max({_rank("severity", L.SEVERITY)}) AS severity, min(item_id) AS first FROM (SELECT *, {_KEY} AS key FROM ({RQ._FINDINGS}) WHERE question IS NOT NULL) WHERE key <> '' GROUP BY key)) WHERE place <= {P.QUESTIONS}
"""
_OPEN = f"""
    SELECT row_number() OVER (ORDER BY item_id) AS place, retrieval, CASE retrieval WHEN 'NOT_RETRIEVED' THEN 'Coverage gap (NOT_RETRIEVED): ' WHEN 'NOT_FOUND_IN_RETRIEVED' THEN 'Searched retrieved corpus; not observed (NOT_FOUND_IN_RETRIEVED): ' WHEN 'MENTIONED_AMBIGUOUS' THEN 'Mentioned but ambiguous (MENTIONED_AMBIGUOUS): ' ELSE 'Not provided in sources: ' END || claim AS line
    FROM ({RQ._FINDINGS}) WHERE needs_confirmation QUALIFY place <= {P.UNKNOWN}
"""


def unknown(findings):
    place = F.row_number().over(W.orderBy("item_id"))  # a row an item
    open_ = findings.where("needs_confirmation").withColumn("place", place).where(F.col("place") <= P.UNKNOWN)
    return open_.select("place", "retrieval", R.unknown_line(F.col("claim"), F.col("retrieval")).alias("line"))


@query(f"SELECT item_id, rank FROM ({_RANKED})")
def findings_ranked(spark, sf):
    return P.ranked_findings(RQ.findings(spark, sf)).select("item_id", "rank")


@query(_ASKED)
def questions_ranked(spark, sf):
    return P.questions(RQ.findings(spark, sf))


@query(f"""
    WITH u AS ({_OPEN}), n AS (SELECT count(*) FILTER (retrieval = 'NOT_RETRIEVED') AS a, count(*) FILTER (retrieval = 'NOT_FOUND_IN_RETRIEVED') AS b FROM u),
    l AS (SELECT line FROM (SELECT a || ' tracked field(s) were not retrievable from the reviewed corpus and may require follow-up.' AS line FROM n WHERE a > 0 UNION ALL SELECT b || ' tracked field(s) were searched but not explicitly found in retrieved sources.' FROM n WHERE b > 0) UNION ALL SELECT line FROM u WHERE place <= {P.LIMITATIONS})
    SELECT line FROM l UNION ALL SELECT 'No major source coverage limitations were detected from ingestion metrics.' WHERE (SELECT count(*) FROM l) = 0
""")
def data_limitations(spark, sf):
    open_ = unknown(RQ.findings(spark, sf))
    missed = [F.count_if(F.col("retrieval") == s) for s in ("NOT_RETRIEVED", "NOT_FOUND_IN_RETRIEVED")]
    return P.limitations(open_, *missed).select("line")


_REPORT = f"""
    SELECT * FROM (VALUES (1, 0, '## Functional Scorecard'), (1, 1, '| Area | Maturity | Impact |'), (1, 2, '|---|---|---|'), (2, 0, '## Findings'), (3, 0, '## Follow-up Questions'), (4, 0, '## Not Confirmed')) AS h(section, ord, line)
    UNION ALL SELECT 1, rank + 2, '| ' || replace(coalesce(label, ''), '|', '/') || ' | ' || maturity || ' | ' || impact || ' |' FROM ({RQ._SCORE})
    UNION ALL SELECT 2, rank, '- **' || claim || '** (' || severity || ', ' || status || '; owner: ' || owner || ')' FROM ({_RANKED})
    UNION ALL SELECT 3, place, '- ' || question FROM ({_ASKED}) UNION ALL SELECT 4, place, '- ' || line FROM ({_OPEN})
"""


def report_lines(spark, sf):
    found = RQ.findings(spark, sf)
    return P.lines(RQ.scored(spark, sf), P.ranked_findings(found), P.questions(found), unknown(found))


@query(_REPORT)
def report_markdown(spark, sf):
    """The lines of the markdown report."""
    return report_lines(spark, sf)


@query(f"SELECT count(*) AS n_lines, sum(length(line))::BIGINT AS chars FROM ({_REPORT})")
def report_text(spark, sf):
    """The report as one text: its lines and what they hold."""
    text = P.markdown(report_lines(spark, sf))
    kept = F.filter(F.split("markdown", "\n"), lambda s: s != "")
    return text.select(F.size(kept).cast("long").alias("n_lines"), F.aggregate(kept, F.lit(0).cast("long"), lambda a, s: a + F.length(s)).alias("chars"))


# -- a crawl over made pages ----------------------------------------------------------------------------

_KEYWORDS, _BONUS = ["1", "2", "7", "united"], "5"
_URL = "'https://atlas.example/r' || n_regionkey || '/' || replace(lower(trim(n_name)), ' ', '-')"
_TEXT = "trim(n_name) || ' has a page of its own. It speaks of the land of ' || trim(n_name) || '. A third line. A fourth united line.'"


def atlas(spark, sf):
    """A page per region that lists its nations, and one per nation."""
    nation = table(spark, sf, "nation").select("n_regionkey", F.trim("n_name").alias("name"))
    nation = nation.withColumn("path", F.concat(F.lit("/r"), F.col("n_regionkey").cast("string"), F.lit("/"), F.replace(F.lower("name"), F.lit(" "), F.lit("-"))))
    body = F.concat(F.lit("<html><body><p>"), "name", F.lit(" has a page of its own. It speaks of the land of "), "name", F.lit(". A third line. A fourth united line.</p></body></html>"))
    own = nation.select(F.concat(F.lit("https://atlas.example"), "path").alias("url"), body.alias("html"))
    item = F.concat(F.lit('<li><a href="'), "path", F.lit('">'), "name", F.lit("</a></li>"))
    lists = nation.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(item)), "").alias("items"))
    region = lists.select(F.concat(F.lit("https://atlas.example/region/"), F.col("n_regionkey").cast("string")).alias("url"), F.concat(F.lit("<html><body><ul>"), "items", F.lit("</ul></body></html>")).alias("html"))
    return own.unionByName(region), region.select("url")


@query(f"""
    WITH n AS (SELECT 'https://atlas.example/region/' || n_regionkey AS root, {_URL} AS url, trim(n_name) AS name, {_TEXT} AS text FROM nation),
    p AS (SELECT *, {" + ".join(f"contains(lower(url || ' ' || name), '{k}')::INT" for k in _KEYWORDS)} + contains(lower(url || ' ' || name), '{_BONUS}')::INT AS priority, name || ' has a page of its own. It speaks of the land of ' || name || '. A third line.' AS preview FROM n),
    s AS (SELECT *, {" + ".join(f"contains(lower(url || ' ' || preview), '{k}')::INT" for k in _KEYWORDS)} + contains(lower(url || ' ' || preview), '{_BONUS}')::INT + {" + ".join(f"contains(lower(preview), '{k}')::INT" for k in _KEYWORDS)} AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY priority DESC, length({"regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1)"}), url) AS k FROM p WHERE priority >= 1) WHERE k <= 4),
    c AS (SELECT root, url, 'child' AS role, score, row_number() OVER (PARTITION BY root ORDER BY score DESC, url) AS place FROM s)
    SELECT DISTINCT root, root AS url, 'root' AS role, 0 AS score, 0 AS place FROM n UNION ALL SELECT * FROM c WHERE place <= 2
""")
def crawl_atlas(spark, sf):
    """Regions as directories: of each the two best of its four likeliest nations, by their previews."""
    pages, seeds = atlas(spark, sf)
    return readers.crawl_directories(pages, seeds, _KEYWORDS, _BONUS, ["cookie"], ["/fr/"], most_links=25, per_host=4, top=2, budget=60)
