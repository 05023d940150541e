"""Tracked fields of a profile: what they are called, what a snippet says of them, which rows count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evispark.functions import headcount as H
from evispark.functions import text as T

# Names and patterns that results depend on.
ALIASES = {
    "policies.leave_policy": ["leave policy", "time off policy", "sick time policy", "pto policy", "paid time off policy", "time off and absence policy", "absence policy"],
    "hris_data.hris_system": ["hris", "human resources information system", "time away", "time off", "payroll", "onboarding"],
}
SYSTEMS = ["Workday", "BambooHR", "Rippling", "ADP", "UKG", "SuccessFactors", "Oracle HCM", "Namely", "Gusto", "Paylocity", "Dayforce", "SAP SuccessFactors"]
NEGATIVE = [r"\bno\b", r"\bnot\b", r"\bwithout\b", r"\bdoes not\b", r"\bdon't\b", r"\bmissing\b", r"\black\b"]
POSITIVE = [r"\bhas\b", r"\bhave\b", r"\buses?\b", r"\busing\b", r"\bin place\b", r"\bpolicy\b", r"\bdocumented\b"]
NOISE = [
    r"\b(junior|senior|lead|principal)\b.{0,50}\b(l[1-5]|m[1-5])\b",
    r"\bcategory\b.{0,40}\bskill\b",
    r"\bmastery\b.{0,120}\bscope\b",
    r"\bownership\b.{0,60}\bmanager of one\b",
    r"\|\s*category\s*\|",
    r"\|\s*-----\s*\|",
]
CONTROL = ["policies.", "hiring.", "onboarding.", "manager_enablement.", "performance.", "comp_leveling.", "hris_data.", "er_retention.", "benefits."]
ITEM_SIGNALS = [
    r"\b\d{1,4}\b",
    r"\$\s*\d",
    r"\b(day|days|week|weeks|month|months|year|years|hour|hours)\b",
    r"\b(eligible|eligibility|must|required|may|will|prohibited|entitled)\b",
    r"\b(employee|employees|manager|leave|overtime|benefits|policy)\b",
]


def any_of(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def count_of(text: Column, patterns: list[str]) -> Column:
    return sum((F.lower(text).rlike(p).cast("int") for p in patterns), F.lit(0))


def leaf(field: Column) -> Column:
    """The last part of a dotted name, in words."""
    return F.lower(F.trim(F.replace(F.element_at(F.split(field, r"\."), -1), F.lit("_"), F.lit(" "))))


def aliases(field: Column, special: dict[str, list[str]] = ALIASES) -> Column:
    """What a field is called: its special aliases, then its leaf."""
    own = F.array().cast("array<string>")
    for name, words in special.items():
        own = F.when(field == name, F.array(*map(F.lit, words))).otherwise(own)
    return F.array_distinct(F.concat(own, F.array(leaf(field))))


def alias_hits(field: Column, text: Column) -> Column:
    low = F.lower(text)
    return F.size(F.filter(aliases(field), lambda a: (a != "") & F.contains(low, a)))


def relevance(field: Column, snippet: Column) -> Column:
    """Four for each alias, one for each statement of having or lacking, minus three for each noise form."""
    return 4 * alias_hits(field, snippet) + count_of(snippet, POSITIVE + NEGATIVE) - 3 * count_of(snippet, NOISE)


def usable(snippet: Column) -> Column:
    flat = T.collapse(snippet)
    return (F.length(flat) >= 40) & flat.rlike(r"\p{L}")


def is_control(field: Column) -> Column:
    return F.coalesce(field.rlike("^(" + "|".join(c.replace(".", r"\.") for c in CONTROL) + ")"), F.lit(False))


def range_text(text: Column) -> Column:
    """'lo-hi', 'n+' for a plus sign, 'n+' for the first number of an inexact text; null without one."""
    flat, span, plus = T.collapse(text), r"(?i)\b(\d{1,5})\s*(?:-|–|to)\s*(\d{1,5})\b", r"\b(\d{1,5})\s*\+"
    a, b = F.regexp_extract(flat, span, 1).try_cast("int"), F.regexp_extract(flat, span, 2).try_cast("int")
    one = F.regexp_extract(flat, r"\b(\d{1,5})\b", 1).try_cast("int").cast("string")
    return (
        F.when(flat.rlike(span), F.concat_ws("-", F.least(a, b), F.greatest(a, b)))
        .when(flat.rlike(plus), F.concat(F.regexp_extract(flat, plus, 1).try_cast("int").cast("string"), F.lit("+")))
        .when(flat.rlike(H.INEXACT) & one.isNotNull(), F.concat(one, F.lit("+")))
    )


def system_name(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(*[F.when(low.rlike(rf"\b{s.lower()}\b"), F.lit(s)) for s in SYSTEMS])


def truth(text: Column) -> Column:
    """'false' for a statement of absence, else 'true' for one of presence."""
    return F.when(any_of(text, NEGATIVE), "false").when(any_of(text, POSITIVE), "true")


def value_text(field: Column, joined: Column, headcounts: Column) -> Column:
    """A field's value as its snippets (``joined``) state it; ``headcounts``: the commonest number."""
    return F.coalesce(
        F.when(field == "headcount", headcounts.cast("string"))
        .when(field == "headcount_range", range_text(joined))
        .when(field == "hris_data.hris_system", system_name(joined))
        .when(is_control(field), truth(joined)),
        F.lit(""),
    )


def parsed_value(field: Column, value: Column) -> Column:
    """struct<kind, text>: a value text as a typed value in long form; null if it is none."""
    raw, low = T.strip(value), F.lower(T.strip(value))
    number = F.when(~low.rlike(H.RANGE_OR_PLUS) & ~H.inexact(low), F.regexp_extract(raw, r"\b(\d{1,5})\b", 1).try_cast("int"))
    flag = F.when(low.isin("true", "yes", "present", "in place", "documented"), "true").when(low.isin("false", "no", "missing", "not present"), "false").otherwise(truth(raw))

    def of(kind: str, text: Column) -> Column:
        return F.when(text.isNotNull(), F.struct(F.lit(kind).alias("kind"), text.alias("text")))

    found = (
        F.when(field == "headcount", of("int", number.cast("string")))
        .when(field == "headcount_range", of("string", range_text(raw)))
        .when(field == "hris_data.hris_system", of("string", raw))
        .when(is_control(field), of("bool", flag))
    )
    return F.when(raw != "", found)


def listed_rule(text: Column) -> Column:
    """A bullet or table row of 25 characters that states a rule: a number, a span of time, a duty."""
    flat = T.strip(text)
    marked = flat.rlike(r"^\s*([-*]|\d+[.)])\s+") | (F.regexp_count(flat, F.lit(r"\|")) >= 2)
    return (F.length(flat) >= 25) & marked & any_of(flat, ITEM_SIGNALS)


def admissible(snippet: Column) -> Column:
    """A citation that reads like a sentence: no heading; a listed rule; a headcount statement of 25
    characters; else 60 characters with punctuation inside."""
    flat = T.collapse(snippet)
    counted = F.lower(flat).rlike(H.RANGE_OR_PLUS) | H.exact(flat).isNotNull()
    return (
        F.when((flat == "") | flat.rlike(r"^#{1,6}\s+\S+"), False)
        .when(listed_rule(flat), True)
        .when(counted, F.length(flat) >= 25)
        .otherwise((F.length(flat) >= 60) & flat.rlike("[.:;]"))
    )


def stated(sentence: Column, field: Column) -> Column:
    """'true' or 'false' if an admissible sentence that names the field says so; null otherwise."""
    return F.when((alias_hits(field, sentence) > 0) & admissible(sentence), truth(sentence))
