"""Queries over text: normalising, splitting, statistics, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark import lexicon as L
from evispark.functions import text as T
from evispark.operators import chunking as C
from evispark.plans.registry import query, table

_MOJI = "coalesce(text, '')"
for _bad, _good in L.MOJIBAKE:
    _MOJI = f"replace({_MOJI}, '{_bad}', '{_good.replace(chr(39), chr(39) * 2)}')"

# Sentences for RE2, which has no look-behind: a mark after each break, then a split.
SENTENCES = r"""
    SELECT doc_id, trim(s, E' \t\n\r') AS sentence
    FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM documents)
    WHERE trim(s, E' \t\n\r') <> ''
"""


@query(rf"""
    SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_MOJI},
        '\r\n?', chr(10), 'g'), '[\x00-\x08\x0B-\x1F\x7F]', '', 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest
    FROM documents
""")
def normalize_text(spark, sf):
    text = T.normalize(F.col("text"), unicode=False)
    return table(spark, sf, "documents").select("doc_id", F.sha2(text, 256).alias("digest"))


@query()
def normalize_nfkc(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.normalize(F.col("text")), 256).alias("digest"))


@query(f"SELECT doc_id, count(*) AS n, sum(length(sentence)) AS chars, min(sentence) AS first_sorted FROM ({SENTENCES}) GROUP BY doc_id")
def sentences(spark, sf):
    found = table(spark, sf, "documents").select("doc_id", T.sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    chars = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return found.select("doc_id", F.size("s").cast("long").alias("n"), chars.alias("chars"), F.array_min("s").alias("first_sorted"))


@query(r"""
    SELECT doc_id, len(t) AS n_tokens, len(list_filter(t, lambda x: length(x) >= 3 AND x NOT IN (%s))) AS n_core
    FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)
""" % L.sql_list(L.NOISE_TOKENS))
def token_counts(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", F.size(T.tokens(text)).cast("long").alias("n_tokens"), F.size(T.core_tokens(text, L.NOISE_TOKENS)).cast("long").alias("n_core")
    )


_LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


@query(rf"""
    SELECT doc_id, len(l) AS n_lines,
        len(list_filter(l, lambda x: length(x) < 40)) AS n_short,
        len(list_filter(l, lambda x: regexp_matches(x, '[.!?]$'))) AS n_closed,
        round((len(list_filter(l, lambda x: length(x) < 40)) - len(list_filter(l, lambda x: regexp_matches(x, '[.!?]$')))) / greatest(len(l), 1)::DOUBLE, 3) AS nav_score,
        len(list_filter(l, lambda x: contains(x, '|'))) >= 2 AS is_table,
        len(regexp_extract_all(text, '[.!?](?:\s|$)')) AS n_sentence_ends
    FROM (SELECT doc_id, text, {_LINES} AS l FROM documents)
""")
def line_statistics(spark, sf):
    text = F.col("text")
    found = T.lines(text)
    return table(spark, sf, "documents").select(
        "doc_id",
        F.size(found).cast("long").alias("n_lines"),
        F.size(F.filter(found, lambda s: F.length(s) < 40)).cast("long").alias("n_short"),
        F.size(F.filter(found, lambda s: s.rlike(r"[.!?]$"))).cast("long").alias("n_closed"),
        T.nav_score(text).alias("nav_score"),
        T.is_table(text).alias("is_table"),
        T.sentence_count(text).cast("long").alias("n_sentence_ends"),
    )


@query(r"""
    SELECT doc_id, slug, CASE WHEN length(flat) <= 60 THEN flat ELSE rtrim(substr(flat, 1, 60), ' ') || '...' END AS clipped
    FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS flat,
        coalesce(nullif(regexp_replace(lower(regexp_replace(text, '[^a-zA-Z0-9]+', '-', 'g')), '^-+|-+$', '', 'g'), ''), 'document') AS slug
        FROM documents)
""")
def slug_and_clip(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select("doc_id", T.slug(text).alias("slug"), T.clip(text, 60).alias("clipped"))


@query(rf"""
    SELECT sum((n >= 6 AND NOT (n < 14 AND first IN ({L.sql_list(L.LOW_CONTEXT_PREFIXES)})) AND NOT ends_with(sentence, ':')
        AND (regexp_matches(sentence, '[.!?]$') OR n >= 12))::INT)::BIGINT AS n_sentence_like, count(*) AS n, lang
    FROM (SELECT d.lang, s.sentence, len(list_filter(regexp_split_to_array(s.sentence, '\s+'), lambda x: x <> '')) AS n,
        lower(regexp_extract(s.sentence, '^(\S+)', 1)) AS first
        FROM ({SENTENCES}) s JOIN documents d USING (doc_id)) GROUP BY lang
""")
def sentence_tests(spark, sf):
    found = table(spark, sf, "documents").select("lang", F.explode(T.sentences(F.col("text"))).alias("sentence"))
    like = T.sentence_like(F.col("sentence")).cast("long")
    return found.groupBy("lang").agg(F.sum(like).alias("n_sentence_like"), F.count(F.lit(1)).alias("n"))


_MODES = r"""
    SELECT doc_id, pos, line, CASE WHEN regexp_replace(line, '^\s+|\s+$', '', 'g') = '' THEN 'blank'
        WHEN regexp_matches(line, '^\s*#{1,6}\s+.+$') OR regexp_matches(line, '^\s*\d+(?:\.\d+)*[.)]?\s+[A-Z].{2,}$')
            OR regexp_matches(line, '^\s*[A-Z][A-Z\s\-/]{3,80}\s*$') THEN 'heading'
        WHEN regexp_matches(line, '^\s*([-*]|\d+[.)])\s+') THEN 'list'
        WHEN contains(line, '|') THEN 'table' ELSE 'text' END AS mode
    FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents)
"""


@query(f"""
    SELECT doc_id, block, mode, count(*) AS n_lines, min(pos) AS first_line, sum(length(line)) AS chars FROM (
        SELECT *, sum(CASE WHEN mode <> coalesce(before, '') OR mode = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS block
        FROM (SELECT *, lag(mode) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM ({_MODES}))
    ) WHERE mode <> 'blank' GROUP BY doc_id, block, mode
""")
def line_blocks(spark, sf):
    return C.block_runs(table(spark, sf, "documents"))


@query()
def chunk_documents(spark, sf):
    got = C.chunks(table(spark, sf, "documents"), most=1200)
    return got.select("chunk_id", "doc_id", "ord", "heading", "start", "end", F.sha1("text").alias("digest"))


@query()
def chunk_overlap(spark, sf):
    got = C.chunks(table(spark, sf, "documents"), most=800, overlap=80)
    return got.select("chunk_id", "doc_id", "start", "end")


@query(r"""
    SELECT doc_id, length(text) AS chars FROM documents
    WHERE NOT (length(text) < 300 OR len(regexp_extract_all(text, '[.!?](?:\s|$)')) < 2)
        OR contains(lower(text), 'license') OR contains(lower(text), 'token')
""")
def chunk_quality_gate(spark, sf):
    return C.quality_gate(table(spark, sf, "documents"), ["license", "token"]).select("doc_id", F.length("text").cast("long").alias("chars"))


@query("""
    SELECT source, lang, count(*) AS n, count(*) FILTER (length(text) < 300) AS n_short, sum(length(text)) AS chars,
        round(avg(length(text)), 2) AS avg_chars, count(DISTINCT sha256(text)) AS n_texts
    FROM documents GROUP BY source, lang
""")
def text_statistics(spark, sf):
    size = F.length("text")
    return table(spark, sf, "documents").groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(size < 300).alias("n_short"), F.sum(size).alias("chars"),
        F.round(F.avg(size), 2).alias("avg_chars"), F.countDistinct(F.sha2("text", 256)).alias("n_texts"),
    )


@query("""
    SELECT min(doc_id) AS doc_id, count(*) AS copies, sha256(text) AS digest FROM documents GROUP BY text
""")
def content_dedupe(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query(r"""
    SELECT doc_id, pos, CASE WHEN regexp_replace(line, '^\s+|\s+$', '', 'g') = '' THEN 'blank' WHEN regexp_matches(line, '^###\s') THEN 'h3'
        WHEN regexp_matches(line, '^##\s') THEN 'h2' WHEN regexp_matches(line, '^#\s') THEN 'h1' WHEN regexp_matches(line, '^\s*[-*]\s') THEN 'bullet'
        WHEN regexp_matches(line, '^\s*\d+[.)]\s') THEN 'number' WHEN contains(line, '|') THEN 'table' ELSE 'paragraph' END AS kind
    FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents)
""")
def markdown_lines(spark, sf):
    found = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), T.markdown_kind(F.col("line")).alias("kind"))


@query(r"""
    SELECT doc_id, CASE WHEN lo <> '' THEN least(lo::INT, hi::INT) || '-' || greatest(lo::INT, hi::INT) WHEN plus <> '' THEN plus::INT || '+'
        WHEN about <> '' THEN about::INT || '+' END AS headcount_range
    FROM (SELECT doc_id, regexp_extract(text, '\b(\d{1,5})\s*(?:-|–|to)\s*(\d{1,5})\b', 1) AS lo, regexp_extract(text, '\b(\d{1,5})\s*(?:-|–|to)\s*(\d{1,5})\b', 2) AS hi,
        regexp_extract(text, '\b(\d{1,5})\s*\+', 1) AS plus,
        regexp_extract(lower(text), '\b(?:about|around|approximately|over|nearly|almost|more than|at least)\s+(\d{1,5})\b', 1) AS about FROM documents)
    WHERE lo <> '' OR plus <> '' OR about <> ''
""")
def headcount_extract(spark, sf):
    got = table(spark, sf, "documents").select("doc_id", T.headcount_range(F.col("text")).alias("headcount_range"))
    return got.where("headcount_range IS NOT NULL")
