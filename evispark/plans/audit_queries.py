"""Citations, constraints, preselection and set comparisons."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evispark import lexicon as L
from evispark.functions import text as T
from evispark.operators import audit as A
from evispark.operators import evidence as E
from evispark.operators import model as M
from evispark.operators import preselect as P
from evispark.plans import evidence_queries as EQ
from evispark.plans import rubric_queries as RQ
from evispark.plans.registry import query, sql_values, table, values

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
#: Citations as a report might have them: those of the rubric, some of texts that changed, some of chunks that don't exist.
_CITED = f"SELECT item_id % 4 AS section, chunk_id + CASE WHEN item_id % 11 = 0 THEN 10000000 ELSE 0 END AS chunk_id, CASE WHEN item_id % 5 = 0 THEN 'changed ' || item_id WHEN item_id % 7 = 0 THEN '' ELSE snippet END AS snippet FROM ({RQ._EVIDENCE})"


def cited(spark, sf):
    key = F.col("item_id")
    moved = F.col("chunk_id") + F.when(key % 11 == 0, 10000000).otherwise(0)
    text = F.when(key % 5 == 0, F.concat(F.lit("changed "), key.cast("string"))).when(key % 7 == 0, "").otherwise(F.col("snippet"))
    return RQ.evidence(spark, sf).select((key % 4).alias("section"), moved.alias("chunk_id"), text.alias("snippet"))


@query(f"""
    WITH e AS ({RQ._EVIDENCE}), x AS (SELECT chunk_id, snippet, max((score, item_id, kind)) AS m FROM e GROUP BY ALL), n AS (SELECT chunk_id, max((score, item_id, kind)) AS m FROM e GROUP BY ALL)
    SELECT section, matched_by, count(*) AS n, min(item_id) AS first_item, count(*) FILTER (kind = 'explicit') AS explicit FROM (
        SELECT c.section, CASE WHEN x.m IS NOT NULL THEN 'snippet' WHEN n.m IS NOT NULL THEN 'chunk' END AS matched_by, coalesce(x.m, n.m)[2] AS item_id, coalesce(x.m, n.m)[3] AS kind
        FROM ({_CITED}) c LEFT JOIN x USING (chunk_id, snippet) LEFT JOIN n ON c.chunk_id = n.chunk_id) GROUP BY ALL
""")
def citation_metadata(spark, sf):
    """What the citations of each section are backed by: a row with the same text, or the chunk's best."""
    got = A.with_metadata(cited(spark, sf), RQ.evidence(spark, sf), ["item_id", "kind"])
    return got.groupBy("section", "matched_by").agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("first_item"), F.count_if(F.col("kind") == "explicit").alias("explicit"))


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(snippet, '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), 'https?://\S+', ' ', 'g'), '[#*_`>|]+', ' ', 'g'), '[^\x20-\x7E]+', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


@query(f"""
    SELECT count(*) AS scanned, count(*) FILTER (c <> '' AND c <> trim(snippet) OR c = '' AND told) AS cleaned, count(*) FILTER (c = '' AND NOT told) AS dropped, count(*) FILTER (c = '' AND told AND trim(snippet) = '') AS recovered, count(DISTINCT chunk_id) FILTER (doc_id IS NULL) AS unknown
    FROM (SELECT x.*, doc_id, coalesce({_CLEAN.replace("snippet", "text")} <> '', FALSE) AS told FROM (SELECT *, {_CLEAN} AS c FROM ({_CITED})) x LEFT JOIN documents ON chunk_id = doc_id)
""")
def citation_counters(spark, sf):
    known = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), (T.unlinked(F.col("text")) != "").alias("has_text"))
    return A.counters(cited(spark, sf), T.unlinked(F.col("snippet")), known)


@query(f"""
    SELECT section, count(*) AS n, count(DISTINCT chunk_id) AS chunks FROM (SELECT DISTINCT section, chunk_id, c FROM (SELECT *, {_CLEAN} AS c FROM ({_CITED})) WHERE c <> '') GROUP BY section
""")
def citation_rewritten(spark, sf):
    got = A.sanitized(cited(spark, sf), T.unlinked(F.col("snippet")))
    return got.groupBy("section").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("chunk_id").alias("chunks"))


@query(f"""
    WITH f AS ({RQ._FINDINGS})
    SELECT (SELECT count(*) FROM (SELECT DISTINCT chunk_id FROM ({_CITED})) WHERE chunk_id NOT IN (SELECT doc_id FROM documents)) AS unknown, (SELECT count(*) FROM f WHERE status = 'present' AND n_citations = 0) AS uncited,
        (SELECT count(*) FROM (SELECT DISTINCT chunk_id FROM ({_CITED})) WHERE chunk_id NOT IN (SELECT doc_id FROM documents)) = 0 AND (SELECT count(*) FROM f WHERE status = 'present' AND n_citations = 0) = 0 AS passed
""")
def report_audit(spark, sf):
    known = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"))
    return A.audit(cited(spark, sf), known, RQ.findings(spark, sf))


STATUSES = ["present", "ambiguous", "explicitly_missing", "not_provided_in_sources", "not_assessed"]
TEXTS = ["There is no policy.", "A policy exists.", "Missing", "none", "", "It does not exist"]
_WRONG = "CASE WHEN status IN ('present', 'ambiguous', 'explicitly_missing') AND n < 1 THEN 'uncited' WHEN status IN ('not_provided_in_sources', 'not_assessed') AND n > 0 THEN 'cited' WHEN status = 'explicitly_missing' AND NOT regexp_matches(lower(t), '{}') THEN 'no absence language' END".format("|".join(A.ABSENCE))


@query(f"SELECT status, n, t, {_WRONG} AS violation FROM (VALUES {sql_values([(s,) for s in STATUSES])}) AS s(status), (VALUES (0), (2)) AS n(n), (VALUES {sql_values([(t,) for t in TEXTS])}) AS t(t) WHERE violation IS NOT NULL")
def evidence_violations(spark, sf):
    rows = [(s, n, t) for s in STATUSES for n in (0, 2) for t in TEXTS]
    found = values(spark, rows, "status string, n int, t string")
    return found.withColumn("violation", A.violation(F.col("status"), F.col("n"), F.col("t"))).where("violation IS NOT NULL")


#: Citations of 200 characters at a place that some documents don't reach, cut at the text's end, and bands from parts' sizes and prices.
_EXTENTS = "SELECT 'citation' AS kind, doc_id AS id, doc_id * 37 % 900 - 5 AS low, least(doc_id * 37 % 900 + 195, n_chars) AS high FROM documents"
_BANDS = "SELECT 'band', p_partkey, p_size, trunc(p_retailprice)::BIGINT % 50 FROM part"


@query(f"""
    SELECT kind, id, CASE kind WHEN 'band' THEN 'maximum below minimum' ELSE CASE WHEN high < low THEN 'end before start' ELSE 'negative start' END END AS violation
    FROM (SELECT * FROM ({_EXTENTS}) UNION ALL SELECT * FROM ({_BANDS})) WHERE high < low OR (kind = 'citation' AND low < 0)
""")
def bounds_violations(spark, sf):
    """Extents that end before they start or start before the text, and bands whose maximum is below their minimum."""
    at = F.col("doc_id") * 37 % 900
    cited = table(spark, sf, "documents").select(F.lit("citation").alias("kind"), F.col("doc_id").alias("id"), A.bounds_violation(at - 5, F.least(at + 195, F.col("n_chars"))).alias("violation"))
    band = F.when(F.col("p_retailprice").cast("long") % 50 < F.col("p_size"), "maximum below minimum")
    bands = table(spark, sf, "part").select(F.lit("band").alias("kind"), F.col("p_partkey").alias("id"), band.alias("violation"))
    return cited.unionByName(bands).where("violation IS NOT NULL")


# -- preselection ------------------------------------------------------------------------------------

KEYWORDS, PATTERNS, KEEP = [["license", "token"], ["tion"], ["que"], ["the"], ["@"]], [r"\bno\b", r"\bhave\b", "copyright"], 40
_SENTS = rf"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {_STRIP.format('x')}), lambda x: x <> '')"
_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> '')"
_ANY = "regexp_matches({}, '" + "|".join(f"(?:{p})" for p in PATTERNS) + "')"
_NAMED = " + ".join("(" + " OR ".join(f"contains(low, '{a}')" for a in g) + ")::INT" for g in KEYWORDS)
_KEYED = " OR ".join(f"contains(lower(s), '{a}')" for g in KEYWORDS for a in g)
_PRE = rf"""
    SELECT chunk_id, score, must, text, sents FROM (SELECT *, (length(text) >= 320)::INT + CASE WHEN len(sents) >= 2 THEN 2 ELSE 0 END - CASE WHEN len(l) >= 6 AND len(list_filter(l, lambda s: len(string_split_regex(s, '\s+')) <= 4)) >= 0.6 * len(l) AND len(list_filter(l, lambda s: regexp_matches(s, '[.:;!?]'))) <= 0.25 * len(l) THEN 4 ELSE 0 END
        + least(3, {_NAMED}) + {_ANY.format("low")}::INT AS score FROM (
        SELECT doc_id AS chunk_id, text, lower(text) AS low, {_SENTS} AS sents, {_LINES} AS l, doc_id % 97 = 0 AS must FROM documents
        QUALIFY row_number() OVER (PARTITION BY lower({_STRIP.format("regexp_replace(text, '\\s+', ' ', 'g')")}) ORDER BY doc_id) = 1)) WHERE must OR score >= 0
"""


@query(rf"""
    SELECT chunk_id, row_number() OVER (ORDER BY must DESC, score DESC, length(whole) DESC, chunk_id) AS place, score,
        CASE WHEN len(sents) = 0 THEN whole WHEN len(told) >= 2 THEN array_to_string(told[1:6], ' ') ELSE array_to_string(sents[1:4], ' ') END AS text
    FROM (SELECT * EXCLUDE (text), text AS whole, list_filter(sents, lambda s: {_KEYED} OR {_ANY.format("lower(s)")}) AS told FROM ({_PRE})) ORDER BY must DESC, score DESC, length(whole) DESC, chunk_id LIMIT {KEEP}
""")
def chunk_preselection(spark, sf):
    """Texts worth reading, cut to the sentences that matter."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return P.preselected(docs, KEYWORDS, PATTERNS, docs.where("chunk_id % 97 = 0"), KEEP)


_HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\.', '')"

# -- windows and sets --------------------------------------------------------------------------------


@query(f"""
    SELECT field, item_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY score DESC, item_id, chunk_id) AS rank FROM (
        SELECT * FROM (SELECT e.* EXCLUDE (rank), f.field FROM ({RQ._EVIDENCE}) e JOIN ({EQ._ITEM_FIELDS}) f USING (item_id)) QUALIFY row_number() OVER (PARTITION BY field, chunk_id, snippet ORDER BY score DESC, item_id, chunk_id) = 1)) WHERE rank <= 6
""")
def field_topk(spark, sf):
    """The six best rows of each field over all its items, equal passages once."""
    rows = RQ.evidence(spark, sf).drop("rank").join(EQ.item_fields(spark, sf), "item_id")
    order = [F.desc("score"), F.asc("item_id"), F.asc("chunk_id")]
    return E.best(rows, ["field"], 6, order, ["chunk_id", "snippet"]).select("field", "item_id", "chunk_id", "score", "rank")


@query(rf"""
    SELECT doc_id, count(*) AS n, sum(length(CASE WHEN length(s || ' ' || nxt) <= 200 THEN s || ' ' || nxt ELSE s END))::BIGINT AS chars FROM (
        SELECT doc_id, s, coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY i), '') AS nxt FROM (SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS i FROM (SELECT doc_id, {_SENTS} AS l FROM documents))) GROUP BY doc_id
""")
def neighbour_sentences(spark, sf):
    """Each sentence with the one after it, where both fit in 200 characters: a fold over the row's own
    sentences, no shuffle."""
    s = F.col("s")
    both = F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.concat_ws(" ", F.get(s, i), F.coalesce(F.get(s, i + 1), F.lit(""))))
    size = F.aggregate(F.zip_with(both, s, lambda b, o: F.when(F.length(b) <= 200, F.length(b)).otherwise(F.length(o))), F.lit(0).cast("long"), lambda a, x: a + x)
    found = table(spark, sf, "documents").select("doc_id", T.sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    return found.select("doc_id", F.size("s").cast("long").alias("n"), size.alias("chars"))


@query(f"""
    SELECT word, count(*) AS n_docs FROM (SELECT unnest([{L.sql_list(L.NOISE_TOKENS)}]) AS word UNION SELECT unnest([{L.sql_list(L.RELEVANCE_STOP)}]))
    JOIN (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents) USING (word) GROUP BY word
""")
def stop_words(spark, sf):
    """How many documents have each word of either list."""
    both = F.array_union(F.array(*map(F.lit, L.NOISE_TOKENS)), F.array(*map(F.lit, L.RELEVANCE_STOP)))
    words = table(spark, sf, "documents").select(F.explode(F.array_intersect(T.tokens(F.col("text")), both)).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n_docs"))


@query("""SELECT (SELECT count(*) FROM (SELECT source FROM documents EXCEPT ALL SELECT source FROM documents WHERE doc_id % 10 <> 3)) AS lost, (SELECT count(*) FROM (SELECT source FROM documents WHERE doc_id % 10 <> 3 EXCEPT ALL SELECT source FROM documents)) AS added,
    (SELECT count(*) FROM documents WHERE doc_id % 10 = 3) = 0 AS equal""")
def multiset_compare(spark, sf):
    """Two multisets of labels are equal if neither leaves anything of the other."""
    one = table(spark, sf, "documents").select("source")
    two = table(spark, sf, "documents").where("doc_id % 10 <> 3").select("source")
    lost, added = (a.exceptAll(b).agg(F.count(F.lit(1)).alias(n)) for a, b, n in ((one, two, "lost"), (two, one, "added")))
    return lost.crossJoin(added).withColumn("equal", (F.col("lost") == 0) & (F.col("added") == 0))  # one row each


CALLS = [("a", 1, "fields", "ok", 1, 10), ("a", 2, "fields", "truncated", 3, 20), ("a", 3, "report", "connection", 1, 5), ("b", 1, "fields", "disabled", 0, 0)]


@query(f"SELECT run, count(*) AS calls, count(*) FILTER (status NOT IN ('ok', 'disabled')) AS errors, sum(attempts)::BIGINT AS attempts FROM (VALUES {sql_values(CALLS)}) AS c(run, call, name, status, attempts, ms) GROUP BY run")
def call_statistics(spark, sf):
    return M.call_statistics(values(spark, CALLS, M.CALLS))


@query("SELECT n_nationkey, (row_number() OVER (ORDER BY n_nationkey) - 1) // 7 AS batch FROM nation")
def prompt_batches(spark, sf):
    return M.batches(table(spark, sf, "nation").select("n_nationkey"), ["n_nationkey"], 7)


@query(f"""SELECT page_id, (place - 1) // 48 AS sheet, place FROM (SELECT page_id, row_number() OVER (PARTITION BY h ORDER BY page_id) AS place FROM (SELECT page_id, {_HOST} AS h FROM pages))""")
def line_pages(spark, sf):
    """Sheets of 48 lines, per host."""
    from evispark.functions import html as H

    place = F.row_number().over(W.partitionBy(H.host(F.col("url"))).orderBy("page_id"))
    return table(spark, sf, "pages").select("page_id", place.alias("place")).select("page_id", F.floor((F.col("place") - 1) / 48).alias("sheet"), "place")
