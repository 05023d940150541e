"""Structure of documents and pages: sections, chunks, text forms of a page, priorities of links."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evispark import lexicon as L
from evispark.functions import html as H
from evispark.functions import text as T
from evispark.operators import blocks as B
from evispark.operators import chunking as C
from evispark.plans import page_queries as P
from evispark.plans.registry import query, table

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_FLAT = _STRIP.format(r"regexp_replace({}, '\s+', ' ', 'g')")

#: Lines of a made document per brand: headings of all kinds, lists, tables and text.
LINES = ["# Top {n}", "## Part {n}", "Some text of part {n}, which follows:", "- item {n}", "| {n} | x |", "1.2.3 Deeper {n} things", "SECTION NAME", "", "Plain words {n}.", "* other item", "##### Far down"]
_LINE = f"CASE p_partkey % {len(LINES)} " + " ".join("WHEN {} THEN replace('{}', '{{n}}', CAST(p_size AS VARCHAR))".format(i, x) for i, x in enumerate(LINES)) + " END"
_TABLE = f"SELECT p_brand AS doc_id, p_partkey AS pos, {_LINE} AS line FROM part"


def lines(spark, sf):
    text, part = F.lit(None).cast("string"), table(spark, sf, "part")
    for i, x in enumerate(LINES):
        text = F.when(F.col("p_partkey") % len(LINES) == i, F.replace(F.lit(x), F.lit("{n}"), F.col("p_size").cast("string"))).otherwise(text)
    return part.select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("pos"), text.alias("line"))


_MD, _NUM, _UP = r"^\s*(#{1,6})\s+(.+?)\s*$", r"^\s*(\d+(?:\.\d+)*)[.)]?\s+([A-Z].{2,})$", r"^\s*([A-Z][A-Z\s\-/]{3,80})\s*$"
_LEVEL = f"CASE WHEN regexp_matches(s, '{_MD}') THEN length(regexp_extract(s, '{_MD}', 1)) WHEN regexp_matches(s, '{_NUM}') THEN least(6, len(string_split(regexp_extract(s, '{_NUM}', 1), '.'))) WHEN regexp_matches(s, '{_UP}') THEN 1 END"
_SECTIONS = f"""
    SELECT doc_id, pos, line, count(own) OVER w AS section, last_value(own IGNORE NULLS) OVER w AS level FROM (SELECT *, {_LEVEL} AS own FROM (SELECT *, {_STRIP.format("line")} AS s FROM ({_TABLE})))
    WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
"""


@query(f"SELECT doc_id, pos, section, level FROM ({_SECTIONS})")
def section_ids(spark, sf):
    return B.section_ids(lines(spark, sf)).drop("line")


_STRUCTURED = rf"""len(list_filter(l, lambda s: regexp_matches(s, '{_MD}'))) >= 1 OR len(list_filter(l, lambda s: NOT regexp_matches(s, '{_MD}') AND (regexp_matches({_STRIP.format("s")}, '{_NUM}') OR regexp_matches({_STRIP.format("s")}, '{_UP}')))) >= 2"""


@query(rf"SELECT doc_id, {_STRUCTURED} AS structured FROM (SELECT doc_id, string_split_regex(text, '\r?\n') AS l FROM documents)")
def structured_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", B.structured(F.col("text")).alias("structured"))


_MODE = rf"CASE WHEN {_STRIP.format('line')} = '' THEN 'blank' WHEN own IS NOT NULL THEN 'heading' WHEN regexp_matches(line, '^\s*([-*]|\d+[.)])\s+') THEN 'list' WHEN contains(line, '|') THEN 'table' ELSE 'text' END"
_BLOCKS = f"""
    SELECT doc_id, min(pos) AS first_line, mode, max(pos) AS last_pos, arg_max(line, pos) AS last_line FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM (
            SELECT *, (mode <> coalesce(lag(mode) OVER (PARTITION BY doc_id ORDER BY pos), '') OR mode = 'heading')::INT AS fresh FROM (
                SELECT doc_id, pos, line, {_MODE} AS mode FROM (SELECT *, {_LEVEL} AS own FROM (SELECT *, {_STRIP.format("line")} AS s FROM ({_TABLE}))))))
    WHERE mode <> 'blank' GROUP BY doc_id, block, mode
"""


@query(f"""
    SELECT doc_id, first_line, mode, CASE WHEN before LIKE '%:' OR before_mode = 'heading' THEN before END AS context FROM (
        SELECT *, {_STRIP.format("lag(last_line) OVER (PARTITION BY doc_id ORDER BY first_line)")} AS before, lag(mode) OVER (PARTITION BY doc_id ORDER BY first_line) AS before_mode FROM ({_BLOCKS}))
""")
def block_context(spark, sf):
    """Blocks of lines with the line that introduces each: the last of the block before, if it ends with
    a colon or is a heading."""
    order = W.partitionBy("doc_id").orderBy("pos")
    found = lines(spark, sf).withColumn("mode", C.line_mode(F.col("line")))
    fresh = (F.col("mode") != F.coalesce(F.lag("mode").over(order), F.lit(""))) | (F.col("mode") == "heading")
    runs = found.withColumn("block", F.sum(fresh.cast("int")).over(order)).where("mode <> 'blank'")
    blocks = runs.groupBy("doc_id", "block", "mode").agg(F.min("pos").alias("first_line"), T.strip(F.max_by("line", "pos")).alias("last_line"))
    return C.with_context(blocks).select("doc_id", "first_line", "mode", "context")


@query()
def chunk_structured(spark, sf):
    """Documents cut by their structure, as pages would be."""
    docs = table(spark, sf, "documents").withColumn("source_type", F.lit("file"))
    found = B.chunk_documents(docs, B.Options(most=1200, overlap=120, semantic=True))
    return found.select("doc_id", "chunk_id", "ord", "section", "start_char", "end_char", "is_list", "is_table", "nav_score", F.length("text").alias("chars"))


@query()
def chunk_summary(spark, sf):
    docs = table(spark, sf, "documents").withColumn("source_type", F.lit("url"))
    return B.chunk_statistics(B.chunk_documents(docs, B.Options(salient=["license", "the"])), ["license", "the"])


# -- pages ------------------------------------------------------------------------------------------

_KEYWORDS, _FOREIGN, _BONUS = ["the", "en", "tion", "er"], ["/fr/", "-uk", "canada"], "guide|index"
_SCORE = "(" + " + ".join(f"contains(seen, '{k}')::INT" for k in _KEYWORDS) + f" + regexp_matches(seen, '{_BONUS}')::INT - 2 * (" + " + ".join(f"contains(seen, '{k}')::INT" for k in [*L.IRRELEVANT_URL, *_FOREIGN]) + "))"
_SCORED = f"""
    SELECT page_id, url, target, max({_SCORE}) AS score FROM (SELECT page_id, url, target, lower(target || ' ' || anchor) AS seen FROM (
        SELECT page_id, url, anchor, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '//') THEN 'https:' || href WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || href
            WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN NULL ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '([^/])/[^/]*$', '\\1/') || href END AS target FROM ({P._LINKS})))
    WHERE target IS NOT NULL GROUP BY page_id, url, target
"""


def scored_links(spark, sf):
    found = table(spark, sf, "pages").select("page_id", "url", F.explode(H.links(F.col("html"))).alias("l"))
    found = found.select("page_id", "url", H.absolute(F.col("l.href"), F.col("url")).alias("target"), F.col("l.anchor").alias("anchor")).where("target IS NOT NULL")
    score = H.link_score(F.col("target"), F.col("anchor"), _KEYWORDS, _BONUS, L.IRRELEVANT_URL, _FOREIGN)
    return found.groupBy("page_id", "url", "target").agg(F.max(score).alias("score"))


@query(f"SELECT page_id, target, score FROM ({_SCORED})")
def link_scores(spark, sf):
    """Every absolute link of every page with its priority."""
    return scored_links(spark, sf).drop("url")


_HOSTS = r"regexp_replace(lower(regexp_extract({}, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\.', '')"
_PATH = "regexp_extract({}, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1)"


@query(f"""
    SELECT page_id, target, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, length({_PATH.format("target")}), target) AS rank FROM (
        SELECT * FROM ({_SCORED}) WHERE score >= 1 AND {_HOSTS.format("url")} = {_HOSTS.format("target")})) WHERE rank <= 3
""")
def page_link_priorities(spark, sf):
    """The three best links of a page to its own host, with a score of one at least."""
    found = scored_links(spark, sf).where((F.col("score") >= 1) & (H.host(F.col("url")) == H.host(F.col("target"))))
    order = W.partitionBy("page_id").orderBy(F.desc("score"), F.length(H.path(F.col("target"))), "target")
    return found.withColumn("rank", F.row_number().over(order)).where("rank <= 3").drop("url")


def _without(*tags: str) -> str:
    out = "html"
    for t in tags:
        out = rf"regexp_replace({out}, '(?is)<{t}\b[^>]*>.*?</{t}>', ' ', 'g')"
    return out


def _tag_lines() -> str:
    """RE2 has no back-reference: one alternative per tag, with its own groups."""
    tags = ["h1", "h2", "h3", "h4", "p", "li", "th", "td", "pre", "code"]
    return "|".join(rf"<{t}(?: [^>]*)?>.*?</{t}>" for t in tags)


_BODY = r"regexp_replace(regexp_replace(b, '^<[^>]*>', ''), '</[^>]*>$', '')"
_WIKI = rf"""
    SELECT page_id, string_agg(line, chr(10) ORDER BY i) AS wiki FROM (SELECT page_id, i, CASE WHEN regexp_matches(b, '(?i)^<h[1-4]') THEN '## ' WHEN regexp_matches(b, '(?i)^<li') THEN '- ' ELSE '' END || t AS line FROM (
        SELECT page_id, i, b, {_FLAT.format("regexp_replace(" + _BODY + ", '<[^>]+>', ' ', 'g')")} AS t FROM (
            SELECT page_id, unnest(x) AS b, unnest(range(len(x))) AS i FROM (SELECT page_id, regexp_extract_all({_without("script", "style", "noscript", "nav", "footer", "aside", "form", "svg")}, '(?is)({_tag_lines()})', 1) AS x FROM pages))) WHERE t <> '') GROUP BY page_id
"""
_PATHS, _MARKS = ["en", "docs", "kb"], ["table of contents", "the "]


@query(f"""
    SELECT page_id, length(w) AS wiki_chars, sha256(w) AS digest, is_wiki AND length(w) >= {H.WIKI_LEAST} AS as_wiki, chars < 800 OR mean_line < 55 AS plain_directory FROM (
        SELECT p.page_id, coalesce(wiki, '') AS w, length(coalesce(wiki, '')) AS chars, regexp_matches(lower({_PATH.format("url")}), '{"|".join(_PATHS)}') OR regexp_matches(lower(html), '{"|".join(_MARKS)}') AS is_wiki,
            CASE WHEN coalesce(wiki, '') = '' THEN 0.0 ELSE list_sum(list_transform(string_split(wiki, chr(10)), lambda s: length(trim(s)))) / len(string_split(wiki, chr(10)))::DOUBLE END AS mean_line FROM pages p LEFT JOIN ({_WIKI}) USING (page_id))
""")
def page_wiki_text(spark, sf):
    """A page's lines in marked form, whether it counts as a handbook, and whether it is a directory by
    its text alone."""
    pages = table(spark, sf, "pages").select("page_id", "url", "html", H.wiki_text(F.col("html")).alias("wiki"))
    wiki, text = H.is_wiki(F.col("url"), F.col("html"), _PATHS, _MARKS), F.col("wiki")
    mode = H.extract_mode(wiki, F.length(text), F.lit(0)) == "policy_wiki"
    return pages.select("page_id", F.length(text).alias("wiki_chars"), F.sha2(text, 256).alias("digest"), mode.alias("as_wiki"), H.is_directory(text, F.lit(0.0), H.mean_line(text)).alias("plain_directory"))


@query()
def page_main_text(spark, sf):
    """The form of each page's text that counts, by the mode rule: handbook lines, dense blocks or all."""
    pages = table(spark, sf, "pages").select("page_id", "url", "html", H.wiki_text(F.col("html")).alias("wiki"), H.dense_text(F.col("html")).alias("dense"))
    mode = H.extract_mode(H.is_wiki(F.col("url"), F.col("html")), F.length("wiki"), F.length("dense"))
    pages = pages.withColumn("mode", mode)
    text = F.when(F.col("mode") == "policy_wiki", F.col("wiki")).when(F.col("mode") == "readability", F.col("dense")).otherwise(H.page_text(F.col("html")))
    pages = pages.withColumn("text", T.normalize(text))
    return pages.select("page_id", "mode", F.length("text").alias("chars"), H.is_directory(F.col("text"), H.link_density(F.col("html")), H.mean_line(F.col("text"))).alias("is_directory"))
