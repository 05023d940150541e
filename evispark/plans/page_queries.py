"""Queries over web pages: text, links, directories, boilerplate, sources."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evispark import lexicon as L
from evispark.functions import html as H
from evispark.functions import text as T
from evispark.plans.registry import query, table
from evispark.sources import readers

_COLLAPSE = r"regexp_replace(regexp_replace({}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_TITLE = _COLLAPSE.format(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
_VISIBLE = _COLLAPSE.format(
    r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
)
_ANCHOR = r"""(?is)<a [^>]*href="([^"#]*)[^"]*"[^>]*>(.*?)</a>"""
_LINKS = f"""
    SELECT page_id, url, html, unnest(regexp_extract_all(html, '{_ANCHOR}', 1)) AS href,
        {_COLLAPSE.format("regexp_replace(unnest(regexp_extract_all(html, '" + _ANCHOR + "', 2)), '<[^>]+>', ' ', 'g')")} AS anchor
    FROM pages
"""
_HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\.', '')"


@query(f"SELECT page_id, {_TITLE} AS title, length({_VISIBLE}) AS chars FROM pages")
def page_title_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", H.title(F.col("html")).alias("title"), F.length(H.visible(F.col("html"))).cast("long").alias("chars"))


@query(f"SELECT page_id, count(*) AS n_links, sum(length(anchor)) AS anchor_chars, min(href) AS first_href FROM ({_LINKS}) GROUP BY page_id")
def page_links(spark, sf):
    found = table(spark, sf, "pages").select("page_id", H.links(F.col("html")).alias("l")).where(F.size("l") > 0)
    chars = F.aggregate("l", F.lit(0).cast("long"), lambda n, x: n + F.length(x["anchor"]))
    return found.select("page_id", F.size("l").cast("long").alias("n_links"), chars.alias("anchor_chars"), F.array_min(F.transform("l", lambda x: x["href"])).alias("first_href"))


@query(f"""
    SELECT p.page_id, round(coalesce(inside, 0) / greatest(length({_VISIBLE}), 1)::DOUBLE, 6) AS link_density,
        length({_VISIBLE}) < 800 OR round(coalesce(inside, 0) / greatest(length({_VISIBLE}), 1)::DOUBLE, 6) > 0.35 AS is_directory
    FROM pages p LEFT JOIN (SELECT page_id, sum(length(anchor)) AS inside FROM ({_LINKS}) GROUP BY page_id) USING (page_id)
""")
def link_density_directory(spark, sf):
    density = H.link_density(F.col("html"))
    return table(spark, sf, "pages").select("page_id", density.alias("link_density"), ((F.length(H.visible(F.col("html"))) < 800) | (density > 0.35)).alias("is_directory"))


_WORDS = ["the", "en", "tion", "er"]


@query(f"""
    SELECT host, href, score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, length(href), href) AS rank FROM (
            SELECT {_HOST} AS host, href, max({" + ".join(f"contains(lower(href || ' ' || anchor), '{w}')::INT" for w in _WORDS)}) AS score
            FROM ({_LINKS}) GROUP BY ALL) WHERE score >= 1) WHERE rank <= 8
""")
def link_priority_topk(spark, sf):
    found = table(spark, sf, "pages").select(H.host(F.col("url")).alias("host"), F.explode(H.links(F.col("html"))).alias("l"))
    seen = F.lower(F.concat_ws(" ", "l.href", "l.anchor"))
    score = sum((seen.contains(w).cast("int") for w in _WORDS), F.lit(0))
    best = found.groupBy("host", F.col("l.href").alias("href")).agg(F.max(score).alias("score")).where("score >= 1")
    order = W.partitionBy("host").orderBy(F.desc("score"), F.length("href"), "href")
    return best.withColumn("rank", F.row_number().over(order)).where("rank <= 8")


#: Characters of a page's text that its content score reads, as in the survey's HTM-11.
PREVIEW = 3500


@query(f"""
    SELECT page_id, score, FALSE AS seed FROM (SELECT page_id, least(5, 2 * ({" + ".join(f"contains(path, '{t}')::INT" for t in ("en", "page", "fr"))})) + least(3, {" + ".join(f"contains(title, '{t}')::INT" for t in _WORDS)})
        + least(6, {" + ".join(f"contains(preview, '{t}')::INT" for t in L.CONTENT_TERMS)}) + CASE WHEN regexp_matches(preview, '{L.STAGE_SIGNAL}') THEN 3 ELSE 0 END
        - least(6, 2 * ({" + ".join(f"contains(url, '{t}')::INT" for t in L.IRRELEVANT_URL)})) - CASE WHEN length(text) < 220 THEN 1 ELSE 0 END AS score
        FROM (SELECT *, substr(lower(text), 1, {PREVIEW}) AS preview FROM (SELECT page_id, lower(url) AS url, lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1)) AS path, lower({_TITLE}) AS title, {_VISIBLE} AS text FROM pages))) WHERE score >= 2
""")
def page_relevance(spark, sf):
    """Pages whose address, title and text score 2 or more, and seeds whatever their score. A page is a
    seed if it was fetched from the address it was asked for (``requested_url``, if the table has it)."""

    def hits(column, words):
        return sum((column.contains(w).cast("int") for w in words), F.lit(0))

    pages = table(spark, sf, "pages")
    seed = F.col("requested_url").eqNullSafe(F.col("url")) if "requested_url" in pages.columns else F.lit(False)
    # Texts are columns of their own before they are asked for many words: one pass over the page each.
    texts = pages.select("page_id", F.lower("url").alias("url"), F.lower(H.path(F.col("url"))).alias("path"), F.lower(H.title(F.col("html"))).alias("title"), H.visible(F.col("html")).alias("text"), seed.alias("seed"))
    texts = texts.withColumn("preview", F.explode(F.array(F.substring(F.lower("text"), 1, PREVIEW))))
    score = (
        F.least(F.lit(5), 2 * hits(F.col("path"), ("en", "page", "fr")))
        + F.least(F.lit(3), hits(F.col("title"), _WORDS))
        + F.least(F.lit(6), hits(F.col("preview"), L.CONTENT_TERMS))
        + F.when(F.col("preview").rlike(L.STAGE_SIGNAL), 3).otherwise(0)
        - F.least(F.lit(6), 2 * hits(F.col("url"), L.IRRELEVANT_URL))
        - F.when(F.length("text") < 220, 1).otherwise(0)
    )
    return texts.select("page_id", score.alias("score"), "seed").where("score >= 2 OR seed")


_PARAS = rf"""
    SELECT page_id, url, p, sha256(regexp_replace(lower(p), '[^a-z0-9 ]', '', 'g')) AS key, pos FROM (
        SELECT page_id, url, unnest(range(len(b))) AS pos, unnest(list_transform(b, lambda x: {_COLLAPSE.format("regexp_replace(x, '<[^>]+>', ' ', 'g')")})) AS p
        FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<(?:p|li|h1|div)(?: [^>]*)?>(.*?)</(?:p|li|h1|div)>', 1) AS b FROM pages)) WHERE p <> ''
"""


#: A paragraph on more than this share of the pages is boilerplate.
COMMON_SHARE = 0.3


@query(f"""
    WITH p AS ({_PARAS}), n AS (SELECT greatest(2, floor({COMMON_SHARE} * count(*))::BIGINT + 1) AS least FROM pages),
    common AS (SELECT key FROM p WHERE length(p) >= 40 GROUP BY key HAVING count(DISTINCT page_id) >= (SELECT least FROM n))
    SELECT page_id, count(*) AS kept, sum(length(p)) AS chars FROM p WHERE key NOT IN (SELECT key FROM common) GROUP BY page_id
""")
def boilerplate_removal(spark, sf):
    """Paragraphs left on each page: one goes if it is on max(2,
    floor(COMMON_SHARE * pages) + 1) pages or more."""
    pages = table(spark, sf, "pages")
    found = pages.select("page_id", F.explode(H.blocks(F.col("html"), "p|li|h1|div")).alias("p"))
    found = found.withColumn("key", F.sha2(F.regexp_replace(F.lower("p"), "[^a-z0-9 ]", ""), 256))
    least = pages.agg(F.greatest(F.lit(2), F.floor(F.lit(COMMON_SHARE) * F.count(F.lit(1))) + 1).alias("least"))
    common = found.where(F.length("p") >= 40).select("key", "page_id").distinct().groupBy("key").count()
    common = common.crossJoin(F.broadcast(least)).where("count >= least")
    left = found.join(common.select("key"), "key", "left_anti")
    return left.groupBy("page_id").agg(F.count(F.lit(1)).alias("kept"), F.sum(F.length("p")).alias("chars"))


@query(f"SELECT {_HOST} AS host, count(*) AS pages, min(page_id) AS first_page, count(DISTINCT url) AS urls FROM pages GROUP BY 1")
def url_host_dedupe(spark, sf):
    return table(spark, sf, "pages").groupBy(H.host(F.col("url")).alias("host")).agg(
        F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page"), F.countDistinct("url").alias("urls")
    )


@query()
def page_parsed_text(spark, sf):
    text = H.page_text(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.length(text).alias("chars"), F.sha1(text).alias("digest"))


@query()
def url_candidates(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.posexplode(readers.addresses(F.concat_ws(" ", "url", "html"))).alias("pos", "found"))


@query()
def directory_crawl(spark, sf):
    pages = table(spark, sf, "pages")
    return readers.crawl(pages, pages, _WORDS).select("host", "target", "score", "rank", "page_id")


@query("""
    SELECT 'n_nationkey: ' || n_nationkey || ' | n_name: ' || trim(n_name) || ' | n_regionkey: ' || n_regionkey AS line FROM nation
""")
def csv_linearize(spark, sf):
    return readers.linearized(table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@query()
def unified_sources(spark, sf):
    pages = table(spark, sf, "pages")
    got = readers.documents(spark, pasted=["Team size is 18 full-time employees.", " "], pages=pages)
    return got.select("doc_id", "source", "source_type", "content_hash", F.length("text").alias("chars"))
