"""Rubric items matched with whole documents by the full score, ranked, with the passage they cite."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark import lexicon as L
from evispark.functions import passage as P
from evispark.functions import text as T
from evispark.operators import decide as D
from evispark.operators import evidence as E
from evispark.plans.registry import once, query, table
from evispark.storage import stored

#: Words that occur in the test tables, in the places of the rubric's own patterns.
SIGNALS = E.Signals(irrelevant=["gnu general"], legal=["license", "token ="], domain=["the", "und", "que"], process=["tion", "ung"], generic=["about"], noise=L.NOISE_TOKENS + L.RELEVANCE_STOP)
TOP, LEAST = 6, 40

_FLAT = r"' ' || array_to_string(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'), ' ') || ' '"
_SENTENCES = r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
_LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


def _count(patterns: list[str]) -> str:
    return "(" + " + ".join(f"contains(low, '{p}')::INT" for p in patterns) + ")"


#: A rubric's texts: passages, and names that no document has.
NAMES = 100_000
RUBRIC = f"SELECT item_id, text FROM benchmark UNION ALL SELECT {NAMES} + n_nationkey, n_name FROM nation"
UNSEARCHABLE = "{irrelevant} > 0 OR ({legal} >= 2 AND {domain} = 0)".format(**{k: _count(getattr(SIGNALS, k)).replace("low,", "lower(text),") for k in ("irrelevant", "legal", "domain")})

_ROWS = rf"""
    WITH rub AS (
        SELECT item_id, q, array_to_string(t[4 * q + 1 : 4 * q + 4], ' ') AS query FROM (SELECT *, unnest(range((len(t) + 3) // 4)) AS q FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM ({RUBRIC})))
    ), rq AS (
        SELECT *, list_filter(toks, lambda x: length(x) >= 3 AND x NOT IN ({L.sql_list(SIGNALS.noise)})) AS core FROM (SELECT *, regexp_extract_all(query, '[a-z0-9]+') AS toks FROM rub) WHERE len(toks) > 0
    ), terms AS (SELECT DISTINCT item_id, q, unnest(core) AS term FROM rq),
    anchors AS (
        SELECT item_id, term FROM (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY min(q * 100 + i)) AS k FROM (SELECT item_id, q, unnest(core) AS term, unnest(range(len(core))) AS i FROM rq)
            WHERE length(term) >= 4 AND term NOT IN ({L.sql_list(SIGNALS.generic)}) GROUP BY item_id, term) WHERE k <= 6
    ), d AS (
        SELECT doc_id, text, low, {_FLAT.format("text")} AS flat, {_LINES} AS l FROM (SELECT doc_id, text, lower(text) AS low FROM chunks)
        WHERE NOT {_count(SIGNALS.irrelevant)} > 0 AND NOT ({_count(SIGNALS.legal)} >= 2 AND {_count(SIGNALS.domain)} = 0)
    ), facts AS (
        SELECT doc_id, flat, 0.25 * {_count(SIGNALS.domain)} - 0.14 * {_count(SIGNALS.legal)} - 0.18 * greatest(0.0, CASE WHEN len(l) = 0 THEN 0.0 ELSE
            round_even(len(list_filter(l, lambda s: len(string_split_regex(s, '\s+')) <= 4))::DOUBLE / len(l) - len(list_filter(l, lambda s: regexp_matches(s, '[.:;!?]')))::DOUBLE / len(l), 3) END) AS base,
            {_count(SIGNALS.process)} > 0 AS process FROM d
    ), w AS (
        SELECT doc_id, k, unnest(list_distinct(regexp_extract_all(lower(win), '[\p{{L}}\p{{N}}]+'))) AS token
        FROM (SELECT doc_id, unnest(ws) AS win, unnest(range(len(ws))) AS k FROM (SELECT doc_id, list_concat(string_split_regex(text, '\n\s*\n'), {_SENTENCES}) AS ws FROM d))
    ), tt AS (
        SELECT DISTINCT token, term FROM (SELECT DISTINCT token FROM w) JOIN (SELECT DISTINCT term FROM terms)
            ON token = term OR (length(term) >= 5 AND starts_with(token, left(term, -1)) AND regexp_matches(substr(token, length(term)), '^[a-z]{{0,6}}$'))
    ), hit AS (SELECT doc_id, k, item_id, q, term FROM w JOIN tt USING (token) JOIN terms USING (term)),
    per AS (
        SELECT doc_id, item_id, q, max(n) >= 2 AS win FROM (SELECT doc_id, k, item_id, q, count(DISTINCT term) AS n FROM hit GROUP BY ALL) GROUP BY ALL
    ), cand AS (SELECT DISTINCT doc_id, item_id FROM hit),
    judged AS (
        SELECT doc_id, item_id, q, coalesce(win, FALSE) AS win, contains(flat, ' ' || array_to_string(toks, ' ') || ' ')
            OR len(list_filter(range(1, len(core)), lambda i: contains(flat, ' ' || core[i] || ' ' || core[i + 1] || ' '))) > 0 AS phrase
        FROM cand JOIN rq USING (item_id) JOIN facts USING (doc_id) LEFT JOIN per USING (doc_id, item_id, q)
    ), fits AS (SELECT * FROM judged WHERE win OR phrase),
    n_terms AS (SELECT doc_id, item_id, count(DISTINCT term) AS n_terms, list_sort(list(DISTINCT term)) AS terms FROM hit JOIN fits USING (doc_id, item_id, q) GROUP BY ALL),
    n_phr AS (SELECT doc_id, item_id, count(*) FILTER (phrase) AS n_phrases FROM fits GROUP BY ALL),
    n_anc AS (SELECT doc_id, item_id, count(*) FILTER (contains(flat, ' ' || term || ' ')) AS n_anchors FROM n_terms JOIN anchors USING (item_id) JOIN facts USING (doc_id) GROUP BY ALL)
    SELECT doc_id, item_id, n_terms, terms, n_phrases, coalesce(n_anchors, 0) AS n_anchors,
        round(2.1 * n_terms + 0.72 * n_phrases + base + CASE WHEN process AND coalesce(n_anchors, 0) > 0 THEN 1.35 + 0.22 * least(n_anchors, 3) ELSE 0 END, 4) AS score
    FROM n_terms JOIN n_phr USING (doc_id, item_id) JOIN facts USING (doc_id) LEFT JOIN n_anc USING (doc_id, item_id)
"""


#: Pieces of documents: each ``PIECE`` characters, numbered within their document.
PIECE, MOST_PIECES = 1200, 100_000
_PIECES = f"SELECT doc_id * {MOST_PIECES} + start // {PIECE} AS doc_id, substr(text, start + 1, {PIECE}) AS text, text AS document, start, least(start + {PIECE}, length(text)) AS stop FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), {PIECE})) AS start FROM documents)"


def _matches(chunks: str) -> str:
    """Rows with terms of the table ``chunks`` (doc_id, text)."""
    return _ROWS.replace("FROM chunks)", f"FROM ({chunks}))")


MATCH = f"SELECT * EXCLUDE (terms) FROM ({_matches('documents')})"


def rubric(spark, sf):
    """item_id, text: the benchmark's passages, and the nations' names."""
    names = table(spark, sf, "nation").select((F.lit(NAMES) + F.col("n_nationkey")).cast("long").alias("item_id"), F.col("n_name").alias("text"))
    return table(spark, sf, "benchmark").select(F.col("item_id").cast("long").alias("item_id"), "text").unionByName(names)


def items(spark, sf):
    """Queries of four tokens each, over an item's whole text."""
    tokens = rubric(spark, sf).select("item_id", T.tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    tokens = tokens.select("item_id", "t", F.explode(F.sequence(F.lit(0), F.floor((F.size("t") - 1) / 4).cast("int"))).alias("q"))
    return tokens.select("item_id", "q", F.array_join(F.slice("t", 4 * F.col("q") + 1, 4), " ").alias("query"))


@once
def index(spark, sf):
    """Whole documents as tokens."""
    return E.index_rows(documents(spark, sf), SIGNALS)


def documents(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def searched(spark, sf):
    """The documents that are searched, by what was written of them."""
    return E.searchable_of(index(spark, sf))


def matched(spark, sf):
    """Every document and item that meet, with the full score."""
    return E.matches(documents(spark, sf), items(spark, sf), SIGNALS, searched(spark, sf))


@query(MATCH)
def rubric_match(spark, sf):
    found = matched(spark, sf)
    return found.select(
        F.col("chunk_id").alias("doc_id"), "item_id", F.col("n_terms").cast("long").alias("n_terms"), F.col("n_phrases").cast("long").alias("n_phrases"), F.col("n_anchors").cast("long").alias("n_anchors"), "score"
    )


@query(f"SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM ({MATCH})) WHERE rank <= {TOP}")
def rubric_topk(spark, sf):
    order = [F.desc("score"), F.asc("chunk_id")]
    return E.best(matched(spark, sf), ["item_id"], TOP, order, []).select("item_id", F.col("chunk_id").alias("doc_id"), "score", "rank")


# -- passages ----------------------------------------------------------------------------------------


def _flat(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


def _in_context(flat: str) -> str:
    return rf"(length({flat}) >= 80 AND (len(regexp_extract_all({flat}, '[.!?](?:\s|$)')) >= 2 OR len(regexp_extract_all(lower({flat}), '[a-z0-9'']+')) >= 22))"


def _sentence_like(flat: str) -> str:
    words = f"regexp_extract_all(lower({flat}), '[a-z0-9'']+')"
    return f"(len({words}) >= 6 AND NOT (len({words}) < 14 AND {words}[1] IN ({L.sql_list(L.LOW_CONTEXT_PREFIXES)})) AND NOT ends_with({flat}, ':') AND (regexp_matches({flat}, '[.!?]$') OR len({words}) >= 12))"


_OTHER = r"[^\p{L}\p{N}_]"
_PLACE = rf"CASE WHEN regexp_matches(' ' || near || ' ', '(?is){_OTHER}' || t || '{_OTHER}') THEN length(regexp_extract(' ' || near || ' ', '(?is)^(.*?){_OTHER}' || t || '{_OTHER}', 1)) END"
_BREAK = "chr(10) || chr(10)"
_TAIL, _HEAD = r"regexp_extract(substr(near, 1, {0}), '[^.!?\n]*$')", r"regexp_extract(substr(near, {0} + 1), '^[^.!?\n]*[.!?\n]?')"
_PARTS = r"list_filter(list_transform({}, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
_NAMED = rf"len(list_filter(terms, lambda t: regexp_matches(' ' || p[i] || ' ', '(?is){_OTHER}' || t || '{_OTHER}'))) > 0"
#: The passage of rows with text, document, start, stop and terms.
_SNIPPETS = rf"""
    SELECT * EXCLUDE (found), CASE WHEN length(found) <= {P.MOST} THEN found ELSE rtrim(substr(found, 1, {P.MOST})) || '...' END AS snippet FROM (
    SELECT doc_id, item_id, score, sure, coalesce(CASE WHEN {_in_context("paragraph")} THEN paragraph END, CASE WHEN {_in_context("sentence")} THEN sentence END,
        list_filter(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN {_NAMED} THEN CASE WHEN {_in_context(_flat("p[i]"))} THEN {_flat("p[i]")} WHEN i < len(p) AND {_in_context(_flat("p[i] || ' ' || p[i + 1]"))} THEN {_flat("p[i] || ' ' || p[i + 1]")} END END), lambda x: x IS NOT NULL)[1],
        list_filter(list_transform(range(1, len(s) + 1), lambda i: CASE WHEN {_sentence_like("s[i]")} THEN CASE WHEN i < len(s) AND length(s[i] || ' ' || s[i + 1]) <= {P.MOST} AND {_sentence_like("(s[i] || ' ' || s[i + 1])")} THEN s[i] || ' ' || s[i + 1] ELSE s[i] END END), lambda x: x IS NOT NULL AND {_in_context("x")})[1],
        lead) AS found
    FROM (SELECT *, {_flat(f"string_split(substr(near, 1, place), {_BREAK})[-1] || string_split(substr(near, place + 1), {_BREAK})[1]")} AS paragraph,
        CASE WHEN own <> '' AND nxt <> '' AND nxt <> own AND length(own || ' ' || nxt) <= {P.MOST} AND {_sentence_like("(own || ' ' || nxt)")} THEN own || ' ' || nxt ELSE own END AS sentence
    FROM (SELECT *, {_flat(_TAIL.format("place") + " || " + _HEAD.format("place"))} AS own, {_flat(_TAIL.format("after") + " || " + _HEAD.format("after"))} AS nxt
    FROM (SELECT *, least(length(near) - 1, place + length({_HEAD.format("place")})) AS after
    FROM (SELECT *, coalesce(list_filter(list_transform(terms, lambda t: {_PLACE}), lambda x: x IS NOT NULL)[1], least(length(near) - 1, start - near_start)) AS place,
        CASE WHEN len(paras) > 0 THEN paras ELSE [{_flat("text")}] END AS p, list_transform({_PARTS.format(_SENTENCES)}, lambda x: {_flat("x")}) AS s
    FROM (SELECT *, greatest(0, start - {P.AROUND}) AS near_start, CASE WHEN {_flat(f"substr(document, greatest(0, start - {P.AROUND}) + 1, stop + {P.AROUND} - greatest(0, start - {P.AROUND}))")} <> ''
        THEN substr(document, greatest(0, start - {P.AROUND}) + 1, stop + {P.AROUND} - greatest(0, start - {P.AROUND})) END AS near FROM picked))))))
"""
_PASSAGES = rf"""
    WITH pieces AS MATERIALIZED (SELECT *, {_PARTS.format(r"string_split_regex(text, '\n\s*\n')")} AS paras FROM ({_PIECES})),
    rows AS MATERIALIZED (SELECT *, {_flat("array_to_string(paras[1:2], ' ')")} AS lead, length({_flat("array_to_string(paras[1:2], ' ')")}) >= {LEAST} AS sure FROM ({_matches("SELECT doc_id, text FROM pieces")}) JOIN pieces USING (doc_id)),
    picked AS (SELECT * FROM rows QUALIFY NOT sure OR row_number() OVER (PARTITION BY item_id, sure ORDER BY score DESC, doc_id) <= {TOP}), shown AS ({_SNIPPETS})
    SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, snippet FROM shown WHERE length(snippet) >= {LEAST} QUALIFY rank <= {TOP}
"""


def pieces(spark, sf, chunks=None):
    """chunk_id, text, document, start, end of each stretch of ``PIECE`` characters; of the documents of ``chunks`` only, if given."""
    size = F.length("text")
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "text")
    if chunks:
        docs = docs.join(chunks.select(F.expr(f"(chunk_id - pmod(chunk_id, {MOST_PIECES})) div {MOST_PIECES}").alias("doc_id")).distinct(), "doc_id", "left_semi")
    docs = E.dealt_out(docs, "doc_id").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(PIECE))).alias("start"))
    number = F.col("doc_id") * MOST_PIECES + F.floor(F.col("start") / PIECE)
    return docs.select(number.alias("chunk_id"), F.substring("text", F.col("start") + 1, F.lit(PIECE)).alias("text"), F.col("text").alias("document"), "start", F.least(F.col("start") + PIECE, F.length("text")).alias("end"))


def snippets(spark, sf):
    """chunk_id, item_id, score, snippet, kind of the six best passages of each item.

    A chunk whose first two paragraphs have ``LEAST`` characters surely shows a passage as long, so only
    an item's six best such chunks, and short ones that score as well, are looked at."""
    chunks = pieces(spark, sf).select("chunk_id", "text")
    sure = F.length(P.fallback(F.coalesce("text", F.lit("")))) >= LEAST
    found = stored(E.matches(chunks, items(spark, sf), SIGNALS, E.token_index(chunks, SIGNALS, {"sure": sure}, dealt=True)), "scored")
    order = [F.desc("score"), F.asc("chunk_id")]
    first = E.best(found.where("sure"), ["item_id"], TOP, order, []).drop("rank")
    bar = first.groupBy("item_id").agg(F.when(F.count(F.lit(1)) >= TOP, F.min("score")).alias("bar"))
    short = found.where("NOT sure").join(bar, "item_id", "left").where("bar IS NULL OR score >= bar").drop("bar")
    seen = stored(first.unionByName(short), "looked_at")
    rows = P.best(seen.join(pieces(spark, sf, seen), "chunk_id"))
    rows = rows.where(F.length("snippet") >= LEAST).withColumn("kind", D.evidence_kind(F.col("snippet"), F.lit(True)))
    return E.best(rows, ["item_id"], TOP, order, ["chunk_id", "snippet"])


@query(_PASSAGES)
def rubric_snippets(spark, sf):
    return snippets(spark, sf).select("item_id", F.col("chunk_id").alias("doc_id"), "score", "rank", "snippet")
