"""Checks and repairs of what a report cites: metadata, constraints, counters. All are joins on chunk ids
and conditional counts; a violation is a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Language of absence, one of which an 'explicitly missing' finding must cite.
ABSENCE = [r"\bno\b", r"\bnot in place\b", r"\bdoes not exist\b", r"\bmissing\b", r"\bnone\b", r"\bwithout\b"]


def with_metadata(citations: DataFrame, evidence: DataFrame, columns: list[str]) -> DataFrame:
    """``citations`` (chunk_id, snippet) with ``columns`` of the evidence row that has both, else of the
    best row of the chunk. ``evidence``: chunk_id, snippet, score and the columns."""
    first = lambda keys: evidence.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct("score", *columns)).alias("m"))
    exact, near = first(["chunk_id", "snippet"]).withColumnRenamed("m", "_exact"), first(["chunk_id"]).withColumnRenamed("m", "_near")
    got = citations.join(exact, ["chunk_id", "snippet"], "left").join(near, "chunk_id", "left")
    found = F.coalesce("_exact", "_near")
    return got.select(*citations.columns, *[found[c].alias(c) for c in columns], F.when(F.col("_exact").isNotNull(), "snippet").when(F.col("_near").isNotNull(), "chunk").alias("matched_by"))


def violation(status: Column, n_citations: Column, cited_text: Column) -> Column:
    """What is wrong with a finding's evidence; null if nothing is."""
    absent = F.lower(F.coalesce(cited_text, F.lit(""))).rlike("|".join(ABSENCE))
    return (
        F.when(status.isin("present", "ambiguous", "explicitly_missing") & (n_citations < 1), "uncited")
        .when(status.isin("not_provided_in_sources", "not_assessed") & (n_citations > 0), "cited")
        .when((status == "explicitly_missing") & ~absent, "no absence language")
    )


def bounds_violation(start: Column, end: Column) -> Column:
    return F.when(end < start, "end before start").when(start < 0, "negative start")


def sanitized(citations: DataFrame, clean: Column) -> DataFrame:
    """``citations`` (section, chunk_id, snippet) with the text they may show; those without go, equal
    ones of a section stay once. ``clean`` is the rewritten snippet."""
    kept = citations.withColumn("_clean", clean).where("_clean IS NOT NULL AND _clean <> ''")
    once = F.row_number().over(W.partitionBy("section", "chunk_id", "_clean").orderBy("snippet"))
    return kept.withColumn("_k", once).where("_k = 1").drop("_k", "snippet").withColumnRenamed("_clean", "snippet")


def counters(citations: DataFrame, clean: Column, known: DataFrame) -> DataFrame:
    """One row: citations scanned, cleaned, dropped and recovered, distinct unknown chunk ids.

    ``clean`` is the rewritten snippet; where nothing is left of it the chunk's own text stands in, if that has any
    (``known``: chunk_id, has_text). A citation is cleaned if it is shown in other words, recovered if it had none."""
    rows = citations.withColumn("_clean", F.coalesce(clean, F.lit("")))
    rows = rows.join(known.select("chunk_id", F.coalesce("has_text", F.lit(False)).alias("_text")), "chunk_id", "left")
    own, empty = F.col("_clean") != "", F.trim(F.coalesce("snippet", F.lit(""))) == ""
    borrowed = ~own & F.coalesce("_text", F.lit(False))
    return rows.agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if((own & (F.col("_clean") != F.trim("snippet"))) | borrowed).alias("cleaned"), F.count_if(~own & ~borrowed).alias("dropped"),
        F.count_if(borrowed & empty).alias("recovered"), F.countDistinct(F.when(F.col("_text").isNull(), F.col("chunk_id"))).alias("unknown"),
    )


def audit(cited: DataFrame, known: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: whether every cited chunk exists and no finding that is present lacks evidence."""
    unknown = cited.select("chunk_id").distinct().join(known.select("chunk_id"), "chunk_id", "left_anti").agg(F.count(F.lit(1)).alias("unknown"))
    bare = findings.agg(F.count_if((F.col("status") == "present") & (F.col("n_citations") == 0)).alias("uncited"))
    return unknown.crossJoin(bare).withColumn("passed", (F.col("unknown") == 0) & (F.col("uncited") == 0))  # one row each
