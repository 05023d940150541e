"""Text functions one by one, on the tables or on small fixtures, with SQL that states each."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark import lexicon as L
from evispark.functions import text as T
from evispark.operators import decide as D
from evispark.operators import evidence as E
from evispark.operators import rubric as R
from evispark.plans.registry import query, sql_values, table, values

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_FLAT = _STRIP.format(r"regexp_replace({}, '\s+', ' ', 'g')")
_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> '')"
_SENTS = rf"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {_STRIP.format('x')}), lambda x: x <> '')"
_PARAS = rf"list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: {_STRIP.format('x')}), lambda x: x <> '')"


@query(f"""
    SELECT doc_id, count(DISTINCT lower(w)) AS n, sum(length(w)) FILTER (first)::BIGINT AS chars FROM (
        SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id, lower(w) ORDER BY i) = 1 AS first FROM (
            SELECT doc_id, {_FLAT.format("unnest(ws)")} AS w, unnest(range(len(ws))) AS i FROM (SELECT doc_id, list_concat({_PARAS}, {_SENTS}) AS ws FROM documents))) GROUP BY doc_id
""")
def query_windows(spark, sf):
    found = T.first_seen(F.transform(F.concat(T.paragraphs(F.col("text")), T.sentences(F.col("text"))), T.collapse))
    kept = table(spark, sf, "documents").select("doc_id", found.alias("w")).where(F.size("w") > 0)
    return kept.select("doc_id", F.size("w").cast("long").alias("n"), F.aggregate("w", F.lit(0), lambda a, x: a + F.length(x)).cast("long").alias("chars"))


@query(rf"""
    SELECT doc_id, len({_PARAS}) AS n_paragraphs, array_to_string({_SENTS}[1:3], ' ') AS lead,
        length(f) >= 80 AND (len(regexp_extract_all(f, '[.!?](?:\s|$)')) >= 2 OR len(regexp_extract_all(lower(f), '[a-z0-9'']+')) >= 22) AS contextual FROM (SELECT *, {_FLAT.format("text")} AS f FROM documents)
""")
def paragraph_tests(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.size(T.page_paragraphs(text)).cast("long").alias("n_paragraphs"), T.first_sentences(text, 3).alias("lead"), T.contextual(text).alias("contextual"))


@query(rf"""
    SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '^\s*([-*]|\d+[.)])\s+'))) >= 2 AS is_list, len(list_filter(string_split(text, chr(10)), lambda s: contains(s, '|'))) >= 2 AS is_table,
        CASE WHEN len(l) = 0 THEN 0.0 ELSE round_even(b::DOUBLE / len(l) - m::DOUBLE / len(l), 3) END AS nav, len(l) >= 6 AND b >= 0.6 * len(l) AND m <= 0.25 * len(l) AS nav_like, len(l) >= 2 AND p >= 0.55 * len(l) AND b5 >= 0.45 * len(l) AS tabular
    FROM (SELECT *, len(list_filter(l, lambda s: len(string_split_regex(s, '\s+')) <= 4)) AS b, len(list_filter(l, lambda s: len(string_split_regex(s, '\s+')) <= 5)) AS b5, len(list_filter(l, lambda s: regexp_matches(s, '[.:;!?]'))) AS m,
        len(list_filter(l, lambda s: contains(s, '|'))) AS p FROM (SELECT doc_id, text, {_LINES} AS l FROM documents))
""")
def structure_flags(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", T.is_list(text).alias("is_list"), T.is_table(text).alias("is_table"), T.nav_balance(text).alias("nav"), T.nav_like(text).alias("nav_like"), T.tabular_noise(text).alias("tabular")
    )


PHRASES = ["the end", "of the", "token", "license", "que", "tion"]
_W = r"[^\p{L}\p{N}_]"


@query(f"""
    SELECT phrase, count(*) FILTER (whole) AS n_phrase, count(*) FILTER (stem) AS n_stem FROM (
        SELECT phrase, regexp_matches(lower(text), '(?:^|{_W})' || array_to_string(regexp_extract_all(phrase, '[a-z0-9]+'), '[^\\p{{L}}\\p{{N}}]+') || '(?:$|{_W})') AS whole,
            regexp_matches(lower(text), '(?:^|{_W})' || phrase || '(?:$|{_W})') OR (length(phrase) >= 5 AND regexp_matches(lower(text), '(?:^|{_W})' || left(phrase, -1) || '[a-z]{{0,6}}(?:$|{_W})')) AS stem
        FROM documents, (VALUES {sql_values([(p,) for p in PHRASES])}) AS v(phrase)) GROUP BY phrase
""")
def phrase_and_stem(spark, sf):
    """How many documents have each phrase, and each as a term or stem. One pass: a count per phrase."""
    docs = table(spark, sf, "documents")
    counts = [F.count_if(F.regexp_like(F.lower("text"), T.phrase_pattern(F.lit(p)))).alias(f"p{i}") for i, p in enumerate(PHRASES)]
    stems = [F.count_if(T.stem_match(F.col("text"), F.lit(p))).alias(f"s{i}") for i, p in enumerate(PHRASES)]
    one = docs.agg(*counts, *stems)
    each = F.array(*[F.struct(F.lit(p).alias("phrase"), F.col(f"p{i}").alias("n_phrase"), F.col(f"s{i}").alias("n_stem")) for i, p in enumerate(PHRASES)])
    return one.select(F.explode(each).alias("e")).select("e.*")


@query(rf"""
    SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') AS safe, CASE WHEN length(url) <= 40 THEN url ELSE '...' || right(url, 37) END AS short FROM pages
""")
def short_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.safe_name(F.col("url")).alias("safe"), T.short_source(F.col("url"), 40).alias("short"))


@query(rf"""
    SELECT page_id, count(*) AS n, min(sha256(k)) AS least FROM (SELECT page_id, regexp_replace(lower({_FLAT.format("regexp_replace(b, '<[^>]+>', ' ', 'g')")}), '[^a-z0-9 ]', '', 'g') AS k
        FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<p(?: [^>]*)?>(.*?)</p>', 1)) AS b FROM pages)) WHERE trim(k) <> '' GROUP BY page_id
""")
def paragraph_keys(spark, sf):
    from evispark.functions import html as H

    found = table(spark, sf, "pages").select("page_id", F.explode(H.blocks(F.col("html"), "p")).alias("b")).where(T.paragraph_key(F.col("b")).isNotNull())
    plain = F.regexp_replace(F.lower("b"), "[^a-z0-9 ]", "")
    return found.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.sha2(plain, 256)).alias("least"))


AREAS = ["Strategy", " Compensation & Equity ", "deib", "Diversity, Equity, Inclusion, Belonging (DEIB)", "hr-data/sop x", "People_ops|hr", "performance management", "", "  ", "SOPs / Deib"]
_TITLES = {"hr-data/sop x": "HR-Data / Sop X", "People_ops|hr": "People / Ops / HR", "SOPs / Deib": "SOPs / DEIB", "": "Other", "  ": "Other"}


@query(f"""
    SELECT area, CASE k {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in L.AREA_ALIASES.items())} ELSE k END AS key,
        CASE area {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _TITLES.items())} END AS title
    FROM (SELECT area, regexp_replace(regexp_replace(lower(area), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS k FROM (VALUES {sql_values([(a,) for a in AREAS])}) AS v(area))
""")
def area_keys(spark, sf):
    area = F.col("area")
    title = F.when(area.isin(list(_TITLES)), R.unknown_label(area))
    return values(spark, [(a,) for a in AREAS], "area string").select("area", R.area_of(area, L.AREA_LABELS, L.AREA_ALIASES).alias("key"), title.alias("title"))


_IDS = r"list_distinct(regexp_extract_all({}, '\b([A-Za-z0-9_-]+-c\d{{3,5}})\b', 1))"
_SIGN = r"list_transform(list_filter(string_split_regex({}, '\r?\n'), lambda s: regexp_matches(s, '^\s{{0,3}}#{{1,6}}\s+\S')), lambda s: length(regexp_extract(s, '^\s*(#+)', 1)) || ' ' || regexp_replace(regexp_extract(s, '^\s*#+\s+(.*)$', 1), '\s+$', ''))"
#: A report of each document: fenced or not, and its revision with the same references, another heading, an id less or its ids in another order.
_REPORTS = """SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN '```markdown' || chr(10) || r || chr(10) || '```' ELSE r END AS a,
        CASE doc_id % 4 WHEN 0 THEN r WHEN 1 THEN replace(r, '## Part', '## Other part') WHEN 2 THEN replace(r, '-c001', '') ELSE replace(replace(replace(r, '-c001', '-cxxx'), '-c0002', '-c001'), '-cxxx', '-c0002') END AS b
        FROM (SELECT doc_id, '# ' || coalesce(lang, 'none') || chr(10) || text || ' doc-' || doc_id || '-c001' || chr(10) || '## Part' || chr(10) || 'doc-' || doc_id || '-c0002' AS r FROM documents WHERE text IS NOT NULL)"""


def _reports(spark, sf):
    key, line = F.col("doc_id"), F.lit("\n")
    ids = [F.concat(F.lit("doc-"), key.cast("string"), F.lit(f"-c{n}")) for n in ("001", "0002")]
    r = F.concat(F.lit("# "), F.coalesce("lang", F.lit("none")), line, "text", F.lit(" "), ids[0], line, F.lit("## Part"), line, ids[1])
    rows = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", r.alias("r"))
    swap = lambda t, a, b: F.replace(t, F.lit(a), F.lit(b))
    turned = swap(swap(swap(F.col("r"), "-c001", "-cxxx"), "-c0002", "-c001"), "-cxxx", "-c0002")
    b = F.when(key % 4 == 0, F.col("r")).when(key % 4 == 1, swap(F.col("r"), "## Part", "## Other part")).when(key % 4 == 2, swap(F.col("r"), "-c001", "")).otherwise(turned)
    a = F.when(key % 3 == 0, F.concat(F.lit("```markdown\n"), "r", F.lit("\n```"))).otherwise(F.col("r"))
    return rows.select(key.alias("id"), a.alias("a"), b.alias("b"))



@query(f"""
    SELECT id, len({_IDS.format("a")}) AS n_ids, array_to_string({_SIGN.format("a")}, '; ') AS headings, array_to_string({_SIGN.format("a")}, '; ') = array_to_string({_SIGN.format("b")}, '; ') AND list_sort({_IDS.format("a")}) = list_sort({_IDS.format("b")}) AS accepted
    FROM (SELECT id, CASE WHEN regexp_matches(a, '(?is)^\\s*```(?:markdown|md)?\\s*.*?\\s*```\\s*$') THEN regexp_extract(a, '(?is)^\\s*```(?:markdown|md)?\\s*(.*?)\\s*```\\s*$', 1) ELSE a END AS a, b FROM ({_REPORTS}))
""")
def revision_check(spark, sf):
    """A revised text is taken only if it keeps headings and cited ids."""
    found = _reports(spark, sf).withColumn("a", T.unfenced(F.col("a")))
    return found.select("id", F.size(T.cited_ids(F.col("a"))).cast("long").alias("n_ids"), F.array_join(T.heading_signature(F.col("a")), "; ").alias("headings"), T.same_references(F.col("a"), F.col("b")).alias("accepted"))


@query(rf"""
    SELECT id, CASE WHEN markdown AND regexp_extract(told, '^#\s+(.+)$', 1) <> '' THEN regexp_extract(told, '^#\s+(.+)$', 1) WHEN stem = '' THEN 'Untitled' ELSE stem END AS title FROM (
        SELECT id, markdown, trim(regexp_replace(stem, '[_-]', ' ', 'g')) AS stem, coalesce(list_filter(list_transform(string_split(t, chr(10)), lambda x: {_FLAT.format("x")}), lambda x: x <> '' AND (regexp_matches(x, '^#\s+\S') OR len(string_split(x, ' ')) >= 4))[1], '') AS told
        FROM (SELECT doc_id AS id, doc_id % 2 = 0 AS markdown, CASE WHEN doc_id % 7 = 0 THEN '--' ELSE coalesce(source, '') || '_' || doc_id END AS stem,
            CASE doc_id % 5 WHEN 0 THEN '#  Title  ' || doc_id || chr(10) || text WHEN 1 THEN 'intro' || chr(10) || chr(10) || '# Late but fine' || chr(10) || text WHEN 2 THEN text || chr(10) || '# Too late' ELSE text END AS t FROM documents WHERE text IS NOT NULL))
""")
def file_titles(spark, sf):
    """Titles of documents as files: some with a heading at once, some after a short line, some after whole lines."""
    key = F.col("doc_id")
    text = (
        F.when(key % 5 == 0, F.concat(F.lit("#  Title  "), key.cast("string"), F.lit("\n"), "text")).when(key % 5 == 1, F.concat(F.lit("intro\n\n# Late but fine\n"), "text"))
        .when(key % 5 == 2, F.concat("text", F.lit("\n# Too late"))).otherwise(F.col("text"))
    )
    stem = F.when(key % 7 == 0, "--").otherwise(F.concat(F.coalesce("source", F.lit("")), F.lit("_"), key.cast("string")))
    return table(spark, sf, "documents").where("text IS NOT NULL").select(key.alias("id"), T.file_title(text, stem, key % 2 == 0).alias("title"))


@query(f"""
    SELECT key, count(*) AS n FROM (SELECT trim(replace(replace({_FLAT.format("regexp_replace(lower(q), '[^a-z0-9\\s]', ' ', 'g')")}, 'can you confirm', ''), 'do you have', '')) AS key FROM (
        SELECT CASE conv_id % 3 WHEN 0 THEN 'Can you confirm: ' WHEN 1 THEN 'Do you have ' ELSE '' END || text || '?' AS q FROM conversations WHERE text IS NOT NULL)) GROUP BY key
""")
def question_keys(spark, sf):
    """Turns of conversations as questions, asked in three ways."""
    key = F.col("conv_id")
    asked = F.concat(F.when(key % 3 == 0, "Can you confirm: ").when(key % 3 == 1, "Do you have ").otherwise(""), "text", F.lit("?"))
    return table(spark, sf, "conversations").where("text IS NOT NULL").groupBy(T.question_key(asked).alias("key")).agg(F.count(F.lit(1)).alias("n"))


_DROP = r"regexp_replace({}, '(?i)\b(avoid|do not|don''t|never)\b[^.]*[.]?', '', 'g')"


@query(f"""
    SELECT id, CASE WHEN k = '' THEN 'default' WHEN length(k) <= 220 THEN k ELSE rtrim(regexp_replace(rtrim(substr(k, 1, 220)), ' [^ ]*$', ''), ' ,;:') END AS goal
    FROM (SELECT id, {_FLAT.format(_DROP.format(_FLAT.format("coalesce(g, '')")))} AS k FROM (SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'Avoid long lists. ' || text WHEN 1 THEN 'Never do this' WHEN 2 THEN 'Assess; do not guess, cite. ' || text ELSE text END AS g FROM documents))
""")
def compact_goals(spark, sf):
    """Documents as goals, some with prohibitions in front."""
    key = F.col("doc_id")
    goal = F.when(key % 4 == 0, F.concat(F.lit("Avoid long lists. "), "text")).when(key % 4 == 1, "Never do this").when(key % 4 == 2, F.concat(F.lit("Assess; do not guess, cite. "), "text")).otherwise(F.col("text"))
    return table(spark, sf, "documents").select(key.alias("id"), T.compact_goal(goal, "default").alias("goal"))


@query(f"""SELECT doc_id, n_legal, n_domain, NOT (n_irrelevant > 0) AND NOT (n_legal >= 2 AND n_domain = 0) AS searchable FROM (SELECT doc_id, contains(t, 'license')::INT + contains(t, 'token =')::INT + contains(t, '@')::INT AS n_legal,
    contains(t, ' the ')::INT + contains(t, ' que ')::INT AS n_domain, contains(t, 'gnu general')::INT AS n_irrelevant FROM (SELECT doc_id, lower(text) AS t FROM documents))""")
def searchable_texts(spark, sf):
    signals = E.Signals(irrelevant=["gnu general"], legal=["license", "token =", "@"], domain=[" the ", " que "])
    low = F.lower("text")
    return table(spark, sf, "documents").select("doc_id", E.pattern_count(low, signals.legal).alias("n_legal"), E.pattern_count(low, signals.domain).alias("n_domain"), E.searchable(F.col("text"), signals).alias("searchable"))


_NESTED = "'{\"nation\":{\"name\":\"' || trim(n_name) || '\",\"region\":{\"key\":' || n_regionkey || '}}}'"


@query(f"SELECT n_nationkey, json_extract_string(j, '$.nation.name') AS name, json_extract_string(j, '$.nation.region.key') AS region, json_extract_string(j, '$.nation.size.x') AS missing FROM (SELECT n_nationkey, {_NESTED} AS j FROM nation)")
def json_paths(spark, sf):
    nested = F.to_json(F.struct(F.struct(F.trim("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("key")).alias("region")).alias("nation")))
    found = table(spark, sf, "nation").select("n_nationkey", nested.alias("j"))
    j = F.col("j")
    return found.select("n_nationkey", T.json_path(j, "nation.name").alias("name"), T.json_path(j, "nation.region.key").alias("region"), T.json_path(j, "nation.size.x").alias("missing"))


@query("""SELECT o_orderpriority AS priority, s.retrieval, c.compliance, CASE WHEN retrieval = 'NOT_RETRIEVED' AND NOT compliance THEN CASE sev WHEN 'critical' THEN 'high' WHEN 'high' THEN 'medium' ELSE 'low' END ELSE sev END AS severity, n FROM (
    SELECT o_orderpriority, CASE left(o_orderpriority, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS sev, count(*) AS n FROM orders GROUP BY 1), (VALUES ('NOT_RETRIEVED'), ('MENTIONED_IMPLICIT')) AS s(retrieval), (VALUES (TRUE), (FALSE)) AS c(compliance)""")
def severity_steps(spark, sf):
    first = F.substring("priority", 1, 1)
    found = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"))
    found = found.crossJoin(F.broadcast(values(spark, [(r, c) for r in ("NOT_RETRIEVED", "MENTIONED_IMPLICIT") for c in (True, False)], "retrieval string, compliance boolean")))  # four rows
    severity = F.when(first == "1", "critical").when(first == "2", "high").when(first == "3", "medium").otherwise("low")
    return found.select("priority", "retrieval", "compliance", D.adjusted_severity(severity, F.col("retrieval"), F.col("compliance")).alias("severity"), "n")
