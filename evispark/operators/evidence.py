"""Evidence of rubric items in chunks: which chunk mentions which item, how strongly, in which words.

Nothing here is a regular-expression join. The chunks' tokens are written once; they meet the rubric's terms by
their first letters, and phrases by two neighbouring tokens. Whatever a token or a phrase says of an item is bits of a few longs, so a chunk
and an item are one row of longs from the first grouping to the score, and the only tables that are joined with chunks
are the rubric's own. Every join is an equi-join that the planner may broadcast, by size, or split, by skew.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evispark import lexicon as L
from evispark.functions import text as T
from evispark.storage import stored

NO_WORD = r"[^\p{L}\p{N}]+"
#: Patterns that stand for themselves.
PLAIN = re.compile("[A-Za-z0-9 =_]+")
PARAGRAPH_BREAK = r"\n\s*\n"
STEM_LEAST, STEM_TAIL = 5, 6
#: First letters by which tokens and terms meet: all of a shorter term, the most that a stem has.
KEYS = STEM_LEAST - 1, STEM_LEAST
ANCHORS, ANCHOR_LEAST = 6, 4
#: The index's own columns.
INDEX = ["chunk_id", "words", "parts", "base", "process"]


@dataclass
class Signals:
    """Patterns over lower-cased text, and words, that the score reads."""

    irrelevant: list[str] = field(default_factory=lambda: L.IRRELEVANT_TEXT)
    legal: list[str] = field(default_factory=lambda: L.LEGAL)
    domain: list[str] = field(default_factory=lambda: L.DOMAIN)
    process: list[str] = field(default_factory=lambda: L.PROCESS)
    noise: list[str] = field(default_factory=lambda: L.NOISE_TOKENS)
    generic: list[str] = field(default_factory=lambda: L.GENERIC_ANCHORS)


def words_of(text: Column) -> Column:
    """Tokens in order: runs of letters and digits of any script, lower-cased."""
    return _words(F.lower(F.coalesce(text, F.lit(""))))


def _words(low: Column) -> Column:
    return F.array_remove(F.split(low, NO_WORD), "")


def joined(tokens: Column) -> Column:
    """Tokens between single blanks, one at either end: a phrase is a substring of this."""
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


def pattern_count(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns occur."""
    found = (F.contains(text, F.lit(p)) if PLAIN.fullmatch(p) else text.rlike(p) for p in patterns)
    return sum((F.coalesce(x, F.lit(False)).cast("int") for x in found), F.lit(0))


def searchable(text: Column, signals: Signals) -> Column:
    """Neither about cookies and subscriptions nor legal small print alone."""
    return _kept(F.lower(F.coalesce(text, F.lit(""))), signals)


def _kept(low: Column, signals: Signals) -> Column:
    legal_only = (pattern_count(low, signals.legal) >= 2) & (pattern_count(low, signals.domain) == 0)
    return ~(pattern_count(low, signals.irrelevant) > 0) & ~legal_only


def rubric(items: DataFrame, signals: Signals) -> DataFrame:
    """One row per item: its queries as (q, tokens, core tokens), their distinct core tokens in order (``all``), and its anchor words."""
    core = T.core_tokens(F.col("query"), signals.noise)
    each = items.select("item_id", "q", T.tokens(F.col("query")).alias("tokens"), core.alias("core")).where(F.size("tokens") > 0)
    found = each.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("q", "tokens", "core"))).alias("queries"))
    words = F.array_distinct(F.flatten(F.transform("queries", lambda x: x["core"])))
    anchors = F.filter(words, lambda t: (F.length(t) >= ANCHOR_LEAST) & ~t.isin(signals.generic))
    return found.select("item_id", "queries", F.array_sort(words).alias("all"), F.slice(anchors, 1, ANCHORS).alias("anchors"))


def dealt_out(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``chunks`` by a hash of ``key``, in parts that the planner sizes: a table of one file, or of one group of rows
    a file, is read by one task, and what is then done with its texts must not stay there."""
    return chunks.repartition(key)


def token_index(chunks: DataFrame, signals: Signals | None = None, carried: dict[str, Column] | None = None, dealt: bool = False) -> DataFrame:
    """The searchable ``chunks`` as ``index_rows``, written once."""
    return searchable_of(stored(index_rows(chunks, signals, carried, dealt), "index"))


def searchable_of(rows: DataFrame) -> DataFrame:
    """The rows of the searchable chunks of a table of ``index_rows``."""
    return rows.where("process IS NOT NULL")


def index_rows(chunks: DataFrame, signals: Signals | None = None, carried: dict[str, Column] | None = None, dealt: bool = False) -> DataFrame:
    """The ``chunks`` (chunk_id, text) as tokens: chunk_id, words (in order), parts, base, process, and ``carried``: what is said of
    a chunk's ``text`` besides, which ``matches`` hands on. All null but for these and chunk_id where a chunk isn't searchable.
    ``dealt``: the chunks have been dealt out already.

    ``parts`` are the paragraphs, and the sentences that go beyond one (any other is inside a paragraph); null for a
    text of one paragraph, which is a window itself. ``base`` and ``process`` are what the score reads of the text alone."""
    signals = signals or Signals()
    low, kept = F.col("low"), F.col("kept")
    paragraphs = F.filter(F.split("text", PARAGRAPH_BREAK), lambda p: T.strip(p) != "")
    beyond = F.filter(F.split("text", T.SENTENCE_BREAK), lambda s: s.rlike(PARAGRAPH_BREAK))
    # Columns of their own: lower-casing is dear. No filter: it would be moved before the dealing, to the few tasks that read.
    rows = (chunks if dealt else dealt_out(chunks)).select("chunk_id", "text", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    return rows.withColumn("kept", _kept(low, signals)).select(
        "chunk_id",
        F.when(kept, _words(low)).alias("words"),
        F.when(kept & F.col("text").rlike(PARAGRAPH_BREAK), F.when(F.size(paragraphs) > 1, F.concat(paragraphs, beyond))).alias("parts"),
        F.when(kept, 0.25 * pattern_count(low, signals.domain) - 0.14 * pattern_count(low, signals.legal) - 0.18 * F.greatest(F.lit(0.0), T.nav_balance(F.col("text")))).alias("base"),
        F.when(kept, pattern_count(low, signals.process) > 0).alias("process"),
        *(c.alias(n) for n, c in (carried or {}).items()),
    )


@dataclass
class Asked:
    """A rubric as small tables. Sets are columns of longs: ``found``: an item's terms by their place in ``all``; ``told`` and
    ``near``: its queries by their place; ``there``: its anchors.

    ``items``: item_id, all. ``queries``: item_id, and a query's place (``told``) and terms (``found``).
    ``says``: key (hash of a term's first letters), term, the ``stem`` by which other tokens mean it, item_id, the sets of a token that
    means the term (``told``, ``there``: only of the term itself). ``grams``: key (hash of the first two), four tokens in a row (the last two null if any will do), item_id, told, and the
    ``phrase`` that is still to be looked for if four tokens don't settle it (``open``: there are such)."""

    items: DataFrame
    queries: DataFrame
    says: DataFrame
    grams: DataFrame
    slots: dict[str, int]
    open: bool


def asked(items: DataFrame, signals: Signals) -> Asked:
    """What ``items`` ask of chunks; nothing here grows with these."""
    each = stored(rubric(items, signals), "items")
    most = each.agg(F.max(F.size("all")), F.max(F.size("queries"))).first()
    slots = {k: max(1, -(-(n or 0) // 63)) for k, n in {"found": most[0], "told": most[1], "near": most[1], "there": 1}.items()}
    sets = lambda **of: [c for k in ("found", "told", "there") for c in _set(k, of.get(k, F.lit(None).cast("int")), slots[k])]
    queries = each.select("item_id", F.posexplode("queries").alias("k", "x")).select("item_id", "k", "x.tokens", "x.core")
    terms = each.select("item_id", F.posexplode("all").alias("i", "term"))
    needed = queries.select("item_id", "k", F.explode(F.array_distinct("core")).alias("term")).join(terms, ["item_id", "term"])
    masks = needed.groupBy("item_id", "k").agg(*(F.bit_or(c).alias(n) for n, c in zip(_names(slots, "found"), _set("found", F.col("i"), slots["found"]))))
    masks = masks.select("item_id", *_names(slots, "found"), *_set("told", F.col("k"), slots["told"]))
    meant = terms.select("term", "item_id", *sets(found=F.col("i")), (F.length("term") >= STEM_LEAST).alias("by_stem"))
    anchors = each.select("item_id", F.posexplode("anchors").alias("i", "term")).select("term", "item_id", *sets(there=F.col("i")), F.lit(False).alias("by_stem"))
    single = queries.where(F.size("tokens") == 1).select(F.get("tokens", F.lit(0)).alias("term"), "item_id", *sets(told=F.col("k")), F.lit(False).alias("by_stem"))
    says = meant.unionByName(anchors).unionByName(single).groupBy("term", "item_id")
    says = stored(says.agg(*(F.bit_or(n).alias(n) for n in _names(slots, "found", "told", "there")), F.max("by_stem").alias("by_stem")), "says")
    stem = F.when(F.max("by_stem"), F.expr("substr(term, 1, length(term) - 1)"))
    known = says.groupBy("term").agg(stem.alias("stem"), F.xxhash64(F.substring(F.coalesce(stem, F.col("term")), 1, KEYS[1])).alias("key"))
    says = stored(says.drop("by_stem").join(known, "term"), "terms")
    at = lambda n: F.get("t", F.lit(n)).alias("abcd"[n])
    pairs = F.transform(F.sequence(F.lit(1), F.size("core") - 1), lambda i: F.slice("core", i, 2))
    pairs = queries.where(F.size("core") >= 2).select("item_id", "k", F.explode(F.array_distinct(pairs)).alias("t"))
    # A query of core tokens alone has its phrase only where it has a pair.
    whole = queries.where((F.size("tokens") >= 2) & (F.size("core") < F.size("tokens"))).select("item_id", "k", F.col("tokens").alias("t"))
    grams = pairs.unionByName(whole).select(*map(at, range(4)), "item_id", *_set("told", F.col("k"), slots["told"]), F.when(F.size("t") > 4, joined(F.col("t"))).alias("phrase"))
    grams = stored(grams.withColumn("key", F.xxhash64("a", "b")), "grams")
    return Asked(each.select("item_id", "all"), stored(masks, "queries"), says, grams, slots, not grams.where("phrase IS NOT NULL").isEmpty())


def meanings(tokens: DataFrame, ask: Asked) -> DataFrame:
    """``tokens`` with item_id and the sets of what each says: it is a term, or a term of five letters and more without
    its last one, plus up to six letters. Tokens and terms meet by a hash of their first letters, so no table of all tokens is made."""
    token, tail = F.col("token"), F.expr("substr(token, length(stem) + 1)")
    longer = F.startswith(token, F.col("stem")) & (F.length("token") <= F.length("stem") + STEM_TAIL) & tail.rlike("^[a-z]*$")
    keys = F.when(F.length("token") > KEYS[0], F.array(*(F.xxhash64(F.substring("token", 1, k)) for k in KEYS))).otherwise(F.array(F.xxhash64("token")))
    found = tokens.withColumn("key", F.explode(keys)).join(ask.says, "key").where((token == F.col("term")) | longer)
    found = found.withColumn("own", token == F.col("term")).drop("key", "token", "stem", "term")
    return found.withColumns({n: F.when(F.col("own"), F.col(n)).otherwise(F.lit(0).cast("long")) for n in _names(ask.slots, "told", "there")}).drop("own")


def _names(slots: dict[str, int], *which: str) -> list[str]:
    return [f"{k}{s}" for k in which or slots for s in range(slots[k])]


def _set(name: str, place: Column, slots: int) -> list[Column]:
    """The set that holds ``place`` alone; empty if that is null."""
    return [_bit(place, s).alias(f"{name}{s}") for s in range(slots)]


def hits_of(have: DataFrame, key: list[str], queries: DataFrame, slots: int) -> DataFrame:
    """``key``, item_id, q, found, same: the query's terms that a row's ``have`` has, two or more unless the query
    is easy, and those of them in its ``exact``, as ``slots`` longs with the bits of the terms' places. Rows of
    ``have`` are one of each ``key``."""
    asked = queries.select("item_id", "q", "easy", "often", F.get("terms", "often").alias("common"), F.posexplode("terms").alias("i", "term")).where("easy OR i <> often")
    hits = have.select(*key, "have", "exact", F.explode("have").alias("term")).join(asked, "term")
    own, also = F.array_contains("exact", F.col("term")), F.array_contains("have", F.col("common"))
    often = F.when(also, F.col("often"))
    hits = hits.select(*key, "item_id", "q", "easy", "i", F.when(own, F.col("i")).alias("i_same"), often.alias("c"), F.when(F.array_contains("exact", F.col("common")), often).alias("c_same"))

    def bits(place: str, common: str, slot: int) -> Column:
        return F.bit_or(_bit(F.col(place), slot)).bitwiseOR(F.bit_or(_bit(F.col(common), slot)))

    sets = {"found": [bits("i", "c", s) for s in range(slots)], "same": [bits("i_same", "c_same", s) for s in range(slots)]}
    hits = hits.groupBy(*key, "item_id", "q").agg(F.max("easy").alias("easy"), *(c.alias(f"{n}{s}") for n, cs in sets.items() for s, c in enumerate(cs)))
    hits = hits.select(*key, "item_id", "q", "easy", *(F.array(*(f"{n}{s}" for s in range(slots))).alias(n) for n in sets))
    return hits.where(F.col("easy") | (_size("found", slots) >= 2)).drop("easy")


def _bit(place: Column, slot: int) -> Column:
    """The long ``slot`` of a set of places that holds ``place`` alone."""
    return F.when(F.floor(place / 63) == slot, F.call_function("shiftleft", F.lit(1).cast("long"), (place % 63).cast("int"))).otherwise(F.lit(0).cast("long"))


def _size(found: str, slots: int) -> Column:
    return sum((F.bit_count(F.get(found, F.lit(s))) for s in range(slots)), F.lit(0))


def _in(place: Column, found: Column) -> Column:
    return F.getbit(F.get(found, F.floor(place / 63).cast("int")), (place % 63).cast("int")) == 1


def candidates(have: DataFrame, queries: DataFrame, slots: int) -> DataFrame:
    """chunk_id, item_id, q, found, same of every chunk that has enough of a query's terms: for terms as arrays. ``matches`` doesn't use it."""
    return stored(hits_of(have.repartition(dealt(have), "chunk_id"), ["chunk_id"], queries, slots), "candidates")


def dealt(df: DataFrame) -> int:
    """Parts for much work on few bytes: a fixed number, which the planner doesn't join by size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def close_hits(index: DataFrame, ask: Asked) -> DataFrame:
    """chunk_id, item_id, near: queries with two terms in one paragraph or sentence of a chunk that has several."""
    found, near = _names(ask.slots, "found"), _names(ask.slots, "near")
    parts = index.where("parts IS NOT NULL").select("chunk_id", F.posexplode("parts").alias("w", "part"))
    words = parts.select("chunk_id", "w", F.explode(F.array_distinct(words_of(F.col("part")))).alias("token"))
    windows = meanings(words, ask).groupBy("chunk_id", "w", "item_id").agg(*(F.bit_or(n).alias(n) for n in found))
    close = windows.join(_needs(ask), "item_id").where(_count(_both(found)) >= 2)
    return close.select("chunk_id", "item_id", *(F.col(f"q_told{s}").alias(n) for s, n in enumerate(near)))


def told_hits(index: DataFrame, ask: Asked) -> DataFrame:
    """chunk_id, item_id, told: queries whose phrase, or two neighbouring core tokens, occur in a chunk."""
    told = _names(ask.slots, "told")
    places = F.explode(F.sequence(F.lit(0), F.size("words") - 2)).alias("i")
    runs = index.where(F.size("words") >= 2).select("chunk_id", "words", places)
    word = lambda n: F.get("words", F.col("i") + n)
    runs = runs.select("chunk_id", F.xxhash64(word(0), word(1)).alias("key"), *(word(n).alias(f"word{n}") for n in range(4)))
    # Equal, said so that the hash alone is the join's key: a long is looked up faster than two strings.
    same = [f"startswith(word{n}, {x}) AND octet_length(word{n}) <= octet_length({x})" for n, x in enumerate("ab")]
    same = " AND ".join([*same, "(c IS NULL OR c = word2)", "(d IS NULL OR d = word3)"])
    found = runs.join(ask.grams, "key").where(same).select("chunk_id", "item_id", *told, "phrase")
    if not ask.open:
        return found.drop("phrase")
    rest = found.where("phrase IS NOT NULL").distinct().join(index.select("chunk_id", joined(F.col("words")).alias("flat")), "chunk_id")
    return found.where("phrase IS NULL").drop("phrase").unionByName(rest.where(F.contains("flat", F.col("phrase"))).select("chunk_id", "item_id", *told))


def _needs(ask: Asked) -> DataFrame:
    return ask.queries.select("item_id", *(F.col(n).alias(f"q_{n}") for n in ask.queries.columns if n != "item_id"))


def _both(names: list[str], others: list[str] | None = None) -> list[Column]:
    """What a row's sets share with a query's, of the same name or of ``others``."""
    return [F.col(n).bitwiseAND(F.col(f"q_{o}")) for n, o in zip(names, others or names)]


def _count(sets: list[Column]) -> Column:
    return sum((F.bit_count(c) for c in sets), F.lit(0))


def matches(chunks: DataFrame, items: DataFrame, signals: Signals | None = None, index: DataFrame | None = None) -> DataFrame:
    """chunk_id, item_id, score, terms, n_terms, n_phrases, n_anchors of every chunk that qualifies for an item, and what the index carries.

    ``chunks``: chunk_id, text. ``items``: item_id, q, query (one row per query). A query qualifies by its
    phrase, by two neighbouring core tokens, or by a paragraph or sentence with two of its core terms.

    ``chunks`` is read once, for the index (not at all if ``index`` is given). What a chunk has of an item is one row of
    longs, whose bits are the item's terms, queries and anchors; texts are never joined but for phrases of more than four tokens."""
    signals = signals or Signals()
    index = index or token_index(chunks, signals)
    ask = asked(items, signals)
    slots, found, told, near = ask.slots, *(_names(ask.slots, k) for k in ("found", "told", "near"))
    carried = [n for n in index.columns if n not in INDEX]
    known = {n: kind for n, kind in index.dtypes if n in ("base", "process", *carried)}
    none = lambda have: {n: F.lit(0).cast("long") for n in _names(slots) if n not in have} | {n: F.lit(None).cast(kind) for n, kind in known.items()}
    own = meanings(index.select("chunk_id", *known, F.col("parts").isNull().alias("whole"), F.explode(F.array_distinct("words")).alias("token")), ask)
    own = own.withColumns({n: F.when(F.col("whole"), F.lit(-1)).otherwise(F.lit(0)).cast("long") for n in near}).drop("whole")
    met = own.unionByName(told_hits(index, ask).withColumns(none(told))).unionByName(close_hits(index, ask).withColumns(none(near)))
    met = met.groupBy("chunk_id", "item_id").agg(*(F.bit_or(n).alias(n) for n in _names(slots)), *(F.max(n).alias(n) for n in known))
    # Most pairs have one term: they are dropped before the item's queries are looked at.
    met = met.where((_count([F.col(n) for n in told]) > 0) | ((_count([F.col(n) for n in found]) >= 2) & (_count([F.col(n) for n in near]) > 0)))
    is_told, is_near = (_count(_both(names, told)) > 0 for names in (told, near))
    met = met.join(_needs(ask), "item_id").where(is_told | ((_count(_both(found)) >= 2) & is_near))
    same = [*told, "there0", *known]
    met = met.groupBy("chunk_id", "item_id").agg(*(F.bit_or(c).alias(n) for n, c in zip(found, _both(found))), *(F.first(n).alias(n) for n in same))
    met = met.join(ask.items, "item_id")
    n_terms, n_phrases, n_anchors = (_count([F.col(n) for n in names]) for names in (found, told, ["there0"]))
    terms = F.filter("all", lambda t, i: _in(i, F.array(*found)))
    met = met.select("chunk_id", "item_id", terms.alias("terms"), n_terms.alias("n_terms"), n_phrases.alias("n_phrases"), n_anchors.alias("n_anchors"), *known)
    bonus = F.when(F.col("process") & (F.col("n_anchors") > 0), 1.35 + 0.22 * F.least("n_anchors", F.lit(3))).otherwise(0.0)
    score = F.round(2.1 * F.col("n_terms") + 0.72 * F.col("n_phrases") + F.col("base") + bonus, 4)
    return met.select("chunk_id", "item_id", score.alias("score"), "terms", "n_terms", "n_phrases", "n_anchors", *carried)


def best(found: DataFrame, key: list[str], k: int, order: list[Column], same: list[str]) -> DataFrame:
    """The ``k`` first rows of each ``key`` by ``order``, of rows that agree in ``same`` the first only (all, if it is empty)."""
    if same:
        first = F.row_number().over(W.partitionBy(*key, *same).orderBy(*order))
        found = found.withColumn("_first", first).where("_first = 1").drop("_first")
    return found.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)
