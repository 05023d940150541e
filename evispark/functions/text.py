"""Text column functions: normalising, splitting, tests and counts. All stay in the JVM, but for
``nfkc``, for which Spark has no built-in."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from evispark.lexicon import LOW_CONTEXT_PREFIXES, MOJIBAKE

SENTENCE_BREAK = r"(?<=[.!?])\s+"
BULLET = r"^\s*([-*]|\d+[.)])\s+"
MARKDOWN_HEADING = r"^\s*(#{1,6})\s+(.+?)\s*$"
NUMBERED_HEADING = r"^\s*(\d+(?:\.\d+)*)[.)]?\s+([A-Z].{2,})$"
UPPER_HEADING = r"^\s*([A-Z][A-Z\s\-/]{3,80})\s*$"


@F.arrow_udf(StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    import unicodedata

    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s+", " "))


def normalize(text: Column, unicode: bool = True) -> Column:
    """NFKC, mojibake repair, line ends, control characters, runs of blanks and of blank lines."""
    text = F.coalesce(text, F.lit(""))
    text = nfkc(text) if unicode else text
    text = reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), MOJIBAKE, text)
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F\x7F]", "")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def slug(text: Column, default: str = "document") -> Column:
    found = F.regexp_replace(F.lower(F.regexp_replace(text, r"[^a-zA-Z0-9]+", "-")), r"^-+|-+$", "")
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(default))


def title_of(text: Column, stem: Column) -> Column:
    """A level-1 markdown heading, else the first line of four words or more, else the stem."""
    lines = F.transform(F.split(text, "\n"), strip)
    wordy = F.filter(lines, lambda x: F.size(F.split(x, r"\s+")) >= 4)
    heading = F.nullif(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1), F.lit(""))
    return F.coalesce(heading, F.get(wordy, F.lit(0)), stem)


def file_title(text: Column, stem: Column, markdown: Column) -> Column:
    """A markdown file's level-1 heading if it comes before any line of four words, else the stem in words."""
    found = F.transform(lines(text), collapse)
    told = F.get(F.filter(found, lambda s: s.rlike(r"^#\s+\S") | (F.size(F.split(s, " ")) >= 4)), F.lit(0))
    heading = F.regexp_extract(told, r"^#\s+(.+)$", 1)
    plain = strip(F.regexp_replace(stem, "[_-]", " "))
    return F.coalesce(F.when(markdown & (heading != ""), heading), F.nullif(plain, F.lit("")), F.lit("Untitled"))


def short_source(text: Column, most: int = 96) -> Column:
    """The end of a long name, after an ellipsis."""
    plain = strip(F.coalesce(text, F.lit("")))
    cut = F.concat(F.lit("..."), F.substring(plain, F.length(plain) - (most - 4), F.lit(most - 3)))
    return F.when(plain == "", "unknown").when(F.length(plain) <= most, plain).otherwise(cut)


def compact_goal(text: Column, default: str, most: int = 220) -> Column:
    """A goal without its prohibitions, cut at a word."""
    kept = collapse(F.regexp_replace(collapse(F.coalesce(text, F.lit(""))), r"(?i)\b(avoid|do not|don't|never)\b[^.]*[.]?", ""))
    cut = F.regexp_replace(F.regexp_replace(F.rtrim(F.substring(kept, 1, most)), r" [^ ]*$", ""), r"[ ,;:]+$", "")
    return F.when(kept == "", default).when(F.length(kept) <= most, kept).otherwise(cut)


CHUNK_ID = r"\b([A-Za-z0-9_-]+-c\d{3,5})\b"


def cited_ids(markdown: Column) -> Column:
    """Chunk ids in a text, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(markdown, F.lit("")), F.lit(CHUNK_ID), F.lit(1)))


def heading_signature(markdown: Column) -> Column:
    """'level label' of every markdown heading, in order."""
    found = F.filter(F.split(F.coalesce(markdown, F.lit("")), r"\r?\n"), lambda s: s.rlike(r"^\s{0,3}#{1,6}\s+\S"))
    return F.transform(found, lambda s: F.concat_ws(" ", F.length(F.regexp_extract(s, r"^\s*(#+)", 1)), strip(F.regexp_extract(s, r"^\s*#+\s+(.*)$", 1))))


def unfenced(markdown: Column) -> Column:
    """The inside of a text that is one fenced block."""
    inside = F.regexp_extract(markdown, r"(?is)^\s*```(?:markdown|md)?\s*(.*?)\s*```\s*$", 1)
    return F.when(markdown.rlike(r"(?is)^\s*```(?:markdown|md)?\s*.*?\s*```\s*$"), inside).otherwise(markdown)


def same_references(before: Column, after: Column) -> Column:
    """A revision keeps the headings in order and the cited ids in any order."""
    same_ids = F.array_sort(cited_ids(before)) == F.array_sort(cited_ids(after))
    return (F.array_join(heading_signature(before), "\n") == F.array_join(heading_signature(after), "\n")) & same_ids


def json_path(document: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text, as text; null where a step is missing."""
    return F.get_json_object(document, "$." + path)


def clip(text: Column, size: int) -> Column:
    flat = collapse(text)
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, size)), F.lit("...")))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0))


def core_tokens(text: Column, noise: list[str]) -> Column:
    return F.filter(tokens(text), lambda t: (F.length(t) >= 3) & ~t.isin(noise))


def shingles(found: Column, size: int) -> Column:
    """Distinct runs of ``size`` of an array of tokens. Pass a materialised column: an expression
    would be evaluated again inside the lambda for every run."""
    last = F.size(found) - size + 1
    every = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(found, i, size), " "))
    return F.when(last >= 1, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


#: Word bounds that are the same for letters of any script.
BEFORE, AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def phrase_pattern(query: Column) -> Column:
    """A pattern for the query's tokens in order, with anything but words between, at word bounds."""
    return F.concat(F.lit("(?i)" + BEFORE), F.array_join(tokens(query), r"[^\p{L}\p{N}]+"), F.lit(AFTER))


def stem_match(text: Column, term: Column) -> Column:
    """The term itself, or (five letters and more) the term less its last letter plus up to six."""
    exact = F.regexp_like(F.lower(text), F.concat(F.lit(BEFORE), term, F.lit(AFTER)))
    stem = F.concat(F.lit(BEFORE), F.substring(term, F.lit(1), F.length(term) - 1), F.lit("[a-z]{0,6}" + AFTER))
    return exact | ((F.length(term) >= 5) & F.regexp_like(F.lower(text), stem))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_BREAK), strip), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda s: s != "")


def page_paragraphs(text: Column) -> Column:
    """Parts between blank lines; the lines, if there is nothing else."""
    found = paragraphs(text)
    return F.when(F.size(found) > 0, found).otherwise(lines(text))


def first_seen(values: Column, cap: int | None = None) -> Column:
    """The stripped values that aren't blank, each once whatever its capitals, in order; ``cap`` at most."""
    empty = F.array().cast("array<string>")

    def take(seen: Column, value: Column) -> Column:
        low = F.lower(value)
        new = ~F.array_contains(seen["low"], low)
        return F.when(new, F.struct(F.array_append(seen["low"], low).alias("low"), F.array_append(seen["out"], value).alias("out"))).otherwise(seen)

    kept = F.filter(F.transform(values, strip), lambda v: v != "")
    out = F.aggregate(kept, F.struct(empty.alias("low"), empty.alias("out")), take, lambda s: s["out"])
    return F.slice(out, 1, cap) if cap else out


def windows(text: Column) -> Column:
    """Paragraphs, then sentences, blanks collapsed, equal ones once; the whole text if there are none."""
    found = F.array_distinct(F.transform(F.concat(paragraphs(text), sentences(text)), collapse))
    return F.when(F.size(found) > 0, found).otherwise(F.array(collapse(text)))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def sentence_like(text: Column) -> Column:
    count, flat = F.size(words(text)), strip(text)
    first = F.lower(F.regexp_extract(flat, r"^(\S+)", 1))
    weak = (count < 14) & first.isin(LOW_CONTEXT_PREFIXES)
    return (count >= 6) & ~weak & ~flat.endswith(":") & (flat.rlike(r"[.!?]$") | (count >= 12))


def contextual(text: Column) -> Column:
    """Eighty characters, and two sentences or 22 words."""
    flat = collapse(text)
    many = F.regexp_count(F.lower(flat), F.lit("[a-z0-9']+")) >= 22
    return (F.length(flat) >= 80) & ((sentence_count(flat) >= 2) | many)


def sentence_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[.!?](?:\s|$)"))


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda s: s != "")


def nav_score(text: Column, short: int = 40) -> Column:
    """Share of short lines less share of lines that end a sentence."""
    found = lines(text)
    n = F.greatest(F.size(found), F.lit(1))
    brief = F.size(F.filter(found, lambda s: F.length(s) < short))
    closed = F.size(F.filter(found, lambda s: s.rlike(r"[.!?]$")))
    return F.round((brief - closed) / n, 3)


def nav_balance(text: Column) -> Column:
    """Share of lines of at most four words less share of lines with punctuation; 0 without lines."""

    def balance(found: Column) -> Column:
        n = F.size(found)
        brief = F.size(F.filter(found, lambda s: ~s.rlike(r"(?:\s+\S+){4}")))
        marked = F.size(F.filter(found, lambda s: s.rlike("[.:;!?]")))
        return F.when(n == 0, 0.0).otherwise(F.bround(brief / n - marked / n, 3))

    return F.get(F.transform(F.array(lines(text)), balance), F.lit(0))  # the lines are split once


def is_list(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda s: s.rlike(BULLET))) >= 2


def is_table(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda s: s.contains("|"))) >= 2


def nav_like(text: Column) -> Column:
    """Six lines and more, three fifths of them of at most four words, a quarter at most with punctuation."""
    found = lines(text)
    n = F.size(found)
    brief = F.size(F.filter(found, lambda s: F.size(F.split(s, r"\s+")) <= 4))
    marked = F.size(F.filter(found, lambda s: s.rlike("[.:;!?]")))
    return (n >= 6) & (brief >= 0.6 * n) & (marked <= 0.25 * n)


def tabular_noise(text: Column) -> Column:
    """Two lines and more, 55 % of them with a bar and 45 % of at most five words."""
    found = lines(text)
    n = F.size(found)
    bars = F.size(F.filter(found, lambda s: s.contains("|")))
    brief = F.size(F.filter(found, lambda s: F.size(F.split(s, r"\s+")) <= 5))
    return (n >= 2) & (bars >= 0.55 * n) & (brief >= 0.45 * n)


def first_sentences(text: Column, count: int) -> Column:
    return F.array_join(F.slice(sentences(text), 1, count), " ")


def paragraph_key(text: Column) -> Column:
    """Hash of a paragraph without case, punctuation and extra blanks; null if nothing is left."""
    plain = F.regexp_replace(F.lower(collapse(text)), r"[^a-z0-9 ]", "")
    return F.when(strip(plain) != "", F.sha1(plain))


def area_key(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def question_key(text: Column) -> Column:
    flat = collapse(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "))
    flat = F.replace(F.replace(flat, F.lit("can you confirm"), F.lit("")), F.lit("do you have"), F.lit(""))
    return strip(flat)


def unlinked(text: Column) -> Column:
    """Markdown links to their labels; addresses, markup and other symbols dropped."""
    text = F.regexp_replace(text, r"\[([^\]]+)\]\([^)]+\)", "$1")
    text = F.regexp_replace(F.regexp_replace(text, r"https?://\S+", " "), r"[#*_`>|]+", " ")
    return collapse(F.regexp_replace(text, r"[^\x20-\x7E]+", " "))


def markdown_kind(line: Column) -> Column:
    return (
        F.when(strip(line) == "", "blank")
        .when(line.rlike(r"^###\s"), "h3")
        .when(line.rlike(r"^##\s"), "h2")
        .when(line.rlike(r"^#\s"), "h1")
        .when(line.rlike(r"^\s*[-*]\s"), "bullet")
        .when(line.rlike(r"^\s*\d+[.)]\s"), "number")
        .when(line.contains("|"), "table")
        .otherwise("paragraph")
    )


def heading_level(line: Column) -> Column:
    """Level of a markdown, numbered or upper-case heading; null for other lines."""
    numbered = F.regexp_extract(line, NUMBERED_HEADING, 1)
    return (
        F.when(line.rlike(MARKDOWN_HEADING), F.length(F.regexp_extract(line, MARKDOWN_HEADING, 1)))
        .when(numbered != "", F.least(F.lit(6), F.size(F.split(numbered, r"\."))))
        .when(line.rlike(UPPER_HEADING), 1)
    )


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_")


def headcount_range(text: Column) -> Column:
    """'lo-hi', or 'n+' for a plus sign or an inexact number; null without a number."""
    low = F.regexp_extract(text, r"\b(\d{1,5})\s*(?:-|–|to)\s*(\d{1,5})\b", 1)
    high = F.regexp_extract(text, r"\b(\d{1,5})\s*(?:-|–|to)\s*(\d{1,5})\b", 2)
    plus = F.regexp_extract(text, r"\b(\d{1,5})\s*\+", 1)
    about = F.regexp_extract(F.lower(text), r"\b(?:about|around|approximately|over|nearly|almost|more than|at least)\s+(\d{1,5})\b", 1)
    a, b = low.try_cast("int"), high.try_cast("int")
    return (
        F.when(low != "", F.concat_ws("-", F.least(a, b), F.greatest(a, b)))
        .when(plus != "", F.concat(plus.try_cast("int"), F.lit("+")))
        .when(about != "", F.concat(about.try_cast("int"), F.lit("+")))
    )


def exact_headcount(text: Column, terms: str = "employees|employee|people|team members|fte") -> Column:
    """An exact number before one of the terms; null if the text has a range or is inexact."""
    found = F.regexp_extract(F.lower(text), rf"\b(\d{{1,5}})\s*(?:{terms})\b", 1)
    return F.when(headcount_range(text).isNull() & (found != ""), found.try_cast("int"))
