"""The passage that an evidence row shows: the paragraph, or the sentence and the one after it, around the
first matched term, in the chunk and its surroundings in the document.

Bounds around an anchor are the last mark before it and the first one after, which are a tail and a head
of the text cut there; so everything is a column of built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evispark.functions import text as T
from evispark.lexicon import LOW_CONTEXT_PREFIXES

#: Characters of the document on either side of the chunk, and of a passage.
AROUND, MOST = 900, 900


def reads_like_a_sentence(text: Column) -> Column:
    """Six words, not a fragment that goes on from elsewhere, no colon at the end, closed or of twelve words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0))
    fragment = (F.size(words) < 14) & F.coalesce(F.get(words, F.lit(0)).isin(LOW_CONTEXT_PREFIXES), F.lit(False))
    return (F.size(words) >= 6) & ~fragment & ~F.endswith(text, F.lit(":")) & (text.rlike("[.!?]$") | (F.size(words) >= 12))


def clipped(flat: Column, most: int) -> Column:
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("...")))


def mentions(text: Column, terms: Column) -> Column:
    """Some term occurs as a word; true without terms."""
    return (F.size(terms) == 0) | F.exists(terms, lambda t: F.regexp_like(text, _word(t)))


def _word(term: Column) -> Column:
    return F.concat(F.lit("(?i)" + T.BEFORE), term, F.lit(T.AFTER))


def window(document: Column, start: Column, end: Column) -> Column:
    """The document from ``AROUND`` characters before the chunk to as many after it."""
    begin = F.greatest(F.lit(0), start - AROUND)
    return F.substring(document, begin + 1, end + AROUND - begin)


def anchor(near: Column, own: Column, terms: Column) -> Column:
    """How many characters of ``near`` come before the first term, in the terms' order, that occurs in it as a word; ``own`` if none does."""
    places = F.filter(F.transform(terms, lambda t: F.regexp_instr(near, _word(t))), lambda p: p > 0)
    return F.coalesce(F.get(places, F.lit(0)) - 1, F.least(F.length(near) - 1, own))


def paragraph_at(text: Column, at: Column) -> Column:
    """The stretch between blank lines around ``at``."""
    before, after = F.substring(text, F.lit(1), at), F.substring(text, at + 1, F.length(text))
    return F.concat(F.substring_index(before, "\n\n", -1), F.substring_index(after, "\n\n", 1))


def _tail(text: Column, at: Column) -> Column:
    return F.regexp_extract(F.substring(text, F.lit(1), at), r"[^.!?\n]*\z", 0)


def _head(text: Column, at: Column) -> Column:
    return F.regexp_extract(F.substring(text, at + 1, F.length(text)), r"^[^.!?\n]*[.!?\n]?", 0)


def sentence_at(text: Column, at: Column) -> Column:
    """The stretch between sentence marks or line ends around ``at``; a mark at ``at`` ends it."""
    return F.concat(_tail(text, at), _head(text, at))


def with_next(text: Column, at: Column, most: int = MOST) -> Column:
    """The sentence at ``at``, with the one after it if both read like a sentence and fit."""
    own = T.collapse(sentence_at(text, at))
    after = T.collapse(sentence_at(text, F.least(F.length(text) - 1, at + F.length(_head(text, at)))))
    both = F.concat(own, F.lit(" "), after)
    return F.when((own != "") & (after != "") & (after != own) & (F.length(both) <= most) & reads_like_a_sentence(both), both).otherwise(own)


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))


def from_paragraphs(text: Column, terms: Column) -> Column:
    """The first paragraph with a term that has context, alone or with the next; null if there is none."""
    found = T.paragraphs(text)
    found = F.when(F.size(found) > 0, found).otherwise(F.array(T.collapse(text)))

    def passage(own: Column, i: Column) -> Column:
        flat, after = T.collapse(own), F.get(found, i + 1)
        both = T.collapse(F.concat(own, F.lit(" "), after))
        return F.when(mentions(own, terms), F.when(T.contextual(own), flat).when(after.isNotNull() & T.contextual(both), both))

    return _first(F.transform(found, passage))


def from_sentences(text: Column, most: int = MOST) -> Column:
    """The first sentence that reads like one and has context, with the next if both fit; null if there is none."""
    found = T.sentences(text)

    def passage(own: Column, i: Column) -> Column:
        flat, after = T.collapse(own), F.get(found, i + 1)
        both = T.collapse(F.concat(own, F.lit(" "), after))
        long = F.when(after.isNotNull() & (F.length(both) <= most) & reads_like_a_sentence(both), both).otherwise(flat)
        return F.when(reads_like_a_sentence(flat) & T.contextual(long), long)

    return _first(F.transform(found, passage))


def fallback(text: Column) -> Column:
    """The first two paragraphs."""
    return T.collapse(F.array_join(F.slice(T.paragraphs(text), 1, 2), " "))


def best(rows, terms: str = "terms", most: int = MOST):
    """Adds ``snippet`` to rows with text, document, start, end (offsets of the chunk in its document) and ``terms``.

    The first that has context (eighty characters, and two sentences or 22 words) of: the paragraph, and the sentence with its neighbour, around
    the first term in the document near the chunk; a paragraph of the chunk with a term; a sentence of the
    chunk. Else the chunk's first two paragraphs. Null texts are empty; without document or offsets only the chunk is read."""
    text, terms_ = F.coalesce("text", F.lit("")), F.coalesce(F.col(terms), F.array().cast("array<string>"))
    near = F.coalesce(window(F.col("document"), F.col("start"), F.col("end")), F.lit(""))
    own = F.col("start") - F.greatest(F.lit(0), F.col("start") - AROUND)
    rows = rows.withColumn("_near", F.when(T.strip(near) != "", near)).withColumn("_at", anchor(F.col("_near"), own, terms_))
    rows = rows.withColumns({"_paragraph": T.collapse(paragraph_at(F.col("_near"), F.col("_at"))), "_sentence": with_next(F.col("_near"), F.col("_at"), most)})
    choices = [F.when(T.contextual(F.col(c)), F.col(c)) for c in ("_paragraph", "_sentence")]
    found = F.coalesce(*choices, from_paragraphs(text, terms_), from_sentences(text, most), fallback(text))
    return rows.withColumn("snippet", clipped(found, most)).drop("_near", "_at", "_paragraph", "_sentence")
