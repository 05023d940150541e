"""Numbers of employees in sentences: exact, range, lower bound or inexact, as column functions.

Patterns are fixed values; what is theirs alone is the order in which they decide. Sentences are ASCII
after normalising, where Java's word bounds are what is meant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terms and patterns that results depend on.
CONTEXT = ["headcount", "employees", "employee", "people", "team members", "workforce", "staff", "fte"]
STAGE_CONTEXT = ["headcount", "employees", "employee", "workforce", "staff", "fte", "full-time", "team members"]
UNITS = "employees|employee|fte|team members"
INEXACT = r"(?i)\b(about|around|approximately|approx\.?|~|over|under|nearly|almost|more than|less than|at least|at most)\b"
RANGE = rf"(?i)\b(\d{{1,5}})\s*(?:-|–|to)\s*(\d{{1,5}})\s*(?:{UNITS}|people)?\b"
PLUS = r"\b(\d{1,5})\s*\+"
ANY_EXACT = rf"(?i)\b(\d{{1,5}})\s*(?:{UNITS}|people)\b"
RANGE_OR_PLUS = r"\b\d{1,5}\s*(?:-|to)\s*\d{1,5}\b|\b\d{1,5}\s*\+"
EXACT = [
    (r"(?i)\bheadcount\s*(?:is|=|:|at|of)?\s*(\d{1,5})\b", 6),
    (rf"(?i)\b(?:we|company)\s+(?:have|has|are)\s+(\d{{1,5}})\s*(?:{UNITS}|people)\b", 6),
    (rf"(?i)\b(\d{{1,5}})\s*(?:{UNITS})\b", 5),
    (r"(?i)\b(?:team|workforce)\s+of\s+(\d{1,5})\b", 4),
]
OTHER_NUMBERS = [r"\b30\s*/\s*60\s*/\s*90\b", r"\b\d+\s*(day|days|week|weeks|month|months)\b", r"\bnotice\b"]
STAGE_EXACT = r"\bheadcount\s*(?:is|=|:|at)?\s*(\d{2,5})\b"
STAGE_UNITS = rf"\b(\d{{2,5}})\s*(?:{UNITS}|people)\b"
STAGE_RANGE = r"\b(\d{1,5})\s*(?:-|to)\s*(\d{1,5})\b"


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def _has_any(text: Column, words: list[str]) -> Column:
    return F.lower(text).rlike("|".join(w.replace("-", r"\-") for w in words))


def inexact(text: Column) -> Column:
    return text.rlike(INEXACT)


def exact(text: Column) -> Column:
    """struct<value, score> of the first pattern that gives a positive number; null for a range, a plus
    sign or an inexact number."""
    low = F.lower(text)
    bonus = F.when(low.contains("headcount"), 2).otherwise(0) + F.when(low.rlike(UNITS), 1).otherwise(0)
    found = F.coalesce(*[F.when(_number(text, p) > 0, F.struct(_number(text, p).alias("value"), (F.lit(s) + bonus).alias("score"))) for p, s in EXACT])
    return F.when(~low.rlike(RANGE_OR_PLUS) & ~inexact(low), found)


def evidence(sentence: Column, least: int = 30) -> Column:
    """struct<field, value, score, kind>: what a sentence of ``least`` characters that speaks of staff
    says, as a headcount or as a headcount range; null if it gives no number."""
    low, vague = F.lower(sentence), inexact(sentence)
    a, b, plus, one = _number(low, RANGE), _number(low, RANGE, 2), _number(low, PLUS), _number(low, ANY_EXACT)

    def row(field: str, value: Column, score: Column, kind: str) -> Column:
        return F.struct(F.lit(field).alias("field"), value.alias("value"), score.cast("double").alias("score"), F.lit(kind).alias("kind"))

    found = (
        F.when(low.rlike(RANGE), row("headcount_range", F.concat_ws("-", F.least(a, b), F.greatest(a, b)), F.when(vague, 9.2).otherwise(8.8), "explicit"))
        .when(low.rlike(PLUS), row("headcount_range", F.concat(plus.cast("string"), F.lit("+")), F.when(vague, 8.5).otherwise(8.2), "explicit"))
        .when(low.rlike(ANY_EXACT) & ~vague, row("headcount", one.cast("string"), F.lit(8.4), "explicit"))
        .when(low.rlike(ANY_EXACT), row("headcount_range", F.concat(one.cast("string"), F.lit("+")), F.lit(7.4), "ambiguous"))
    )
    return F.when((F.length(sentence) >= least) & _has_any(sentence, CONTEXT), found)


def stage_signal(sentence: Column) -> Column:
    """struct<pivot, confidence, exact>: the number that places an entity in a size band; null for
    durations, notice periods and sentences that don't speak of staff."""
    low = F.lower(sentence)
    a, b = _number(low, STAGE_RANGE), _number(low, STAGE_RANGE, 2)
    named, counted = _number(low, STAGE_EXACT), _number(low, STAGE_UNITS)

    def row(pivot: Column, confidence: float, sure: bool = False) -> Column:
        return F.when(pivot.isNotNull(), F.struct(pivot.cast("int").alias("pivot"), F.lit(confidence).alias("confidence"), F.lit(sure).alias("exact")))

    found = (
        F.when(low.rlike(STAGE_RANGE), row(F.bround((a + b) / 2, 0), 0.74))
        .when(low.rlike(PLUS), row(_number(low, PLUS), 0.70))
        .when(inexact(low), row(F.coalesce(counted, named), 0.70))
        .otherwise(row(F.coalesce(named, counted), 0.78, True))
    )
    other = F.lit(False)
    for p in OTHER_NUMBERS:
        other = other | low.rlike(p)
    return F.when(_has_any(sentence, STAGE_CONTEXT) & ~other, found)
