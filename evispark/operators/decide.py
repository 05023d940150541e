"""Decision tables: evidence kinds, statuses, maturity, impact, confidence, owners."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evispark import lexicon as L


def rank_of(value: Column, table: dict[str, int], default: int = 0) -> Column:
    out = F.lit(default)
    for name, rank in table.items():
        out = F.when(value == name, rank).otherwise(out)
    return out


def evidence_kind(text: Column, has_terms: Column, positive: list[str] = L.POSITIVE, negative: list[str] = L.NEGATIVE) -> Column:
    low = F.lower(text)
    return (
        F.when(low.rlike("|".join(f"(?:{p})" for p in negative)), "explicit_absence")
        .when(low.rlike("|".join(f"(?:{p})" for p in positive)), "explicit")
        .when(has_terms, "implicit")
        .otherwise("ambiguous")
    )


def retrieval_status(kind: Column, searched: Column) -> Column:
    return (
        F.when(kind.isin("explicit", "explicit_absence"), "MENTIONED_EXPLICIT")
        .when(kind == "implicit", "MENTIONED_IMPLICIT")
        .when(kind == "ambiguous", "MENTIONED_AMBIGUOUS")
        .when(searched > 0, "NOT_FOUND_IN_RETRIEVED")
        .otherwise("NOT_RETRIEVED")
    )


def evidence_status(verdict: Column, retrieval: Column, relevant: Column, ran: Column) -> Column:
    verdict, retrieval = F.lower(F.trim(verdict)), F.upper(F.trim(retrieval))
    return (
        F.when(~ran, "not_assessed")
        .when(verdict.isin("present", "explicitly_missing"), verdict)
        .when(verdict.isin("ambiguous", "conflict"), F.when(relevant, "ambiguous").otherwise("not_provided_in_sources"))
        .when((verdict == "not_found") & (retrieval == "NOT_RETRIEVED"), "not_assessed")
        .otherwise("not_provided_in_sources")
    )


def needs_confirmation(status: Column) -> Column:
    return status.isin("ambiguous", "not_provided_in_sources", "not_assessed")


def adjusted_severity(severity: Column, retrieval: Column, compliance: Column) -> Column:
    lower = F.when(severity == "critical", "high").when(severity == "high", "medium").otherwise("low")
    return F.when((retrieval == "NOT_RETRIEVED") & ~compliance, lower).otherwise(severity)


def maturity(missing_high: Column, high: Column, unresolved_critical: Column, n: Column) -> Column:
    return (
        F.when(missing_high > 0, "Under-Developed")
        .when((high >= 2) | (unresolved_critical > 0), "Developing")
        .when(n >= 1, "Aligned")
        .otherwise("Strategic")
    )


def impact(high: Column, medium: Column) -> Column:
    return F.when(high > 0, "Significant").when(medium > 0, "Moderate").otherwise("Limited")


def low_coverage(chunks: Column, unresolved_share: Column) -> Column:
    return (chunks < 12) | (unresolved_share > 0.45)


def stage_confidence(base: Column, top_band_unproven: Column, proxies: Column, numeric: Column, funding: Column) -> Column:
    """Adjustments in their order: top-band cap, proxies, no number, blend with funding, clamp."""
    c = F.when(top_band_unproven, F.greatest(F.lit(0.22), base - 0.1)).otherwise(base)
    c = F.when(proxies, F.greatest(F.lit(0.25), c - 0.08)).otherwise(c)
    c = F.when(~numeric, F.least(c, F.lit(0.68))).otherwise(c)
    c = F.when(funding > 0.45, 0.7 * c + 0.3 * funding).when(funding.isNotNull(), F.least(c, funding)).otherwise(c)
    return F.bround(F.greatest(F.lit(0.05), F.least(F.lit(1.0), c)), 3)
