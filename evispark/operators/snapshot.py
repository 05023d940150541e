"""A snapshot in long form, one row per entity and field, from ranked evidence rows.

Rows: entity, field, chunk_id, snippet, kind, score. Fields' verdicts, values and merges are aggregates
over an entity's and field's rows; nothing is pivoted until a sink asks for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evispark import lexicon as L
from evispark.functions import fields as C
from evispark.functions import headcount as H
from evispark.operators import decide as D

VERDICT = {"present": 5, "explicitly_missing": 5, "conflict": 4, "ambiguous": 3, "not_found": 2}
#: How much a kind of value tells.
QUALITY = {"bool": 5, "int": 4, "double": 4, "string": 3, "list": 2, "struct": 1}
_KEY = ["entity", "field"]


def relevant(rows: DataFrame, limit: int = 5) -> DataFrame:
    """The usable rows of each field, best first; of a control's rows only those that speak of it, if
    any does. Adds relevance and place."""
    found = rows.where(C.usable(F.col("snippet"))).withColumn("relevance", C.relevance(F.col("field"), F.col("snippet")))
    speaks = F.max("relevance").over(W.partitionBy(*_KEY)) > 0
    found = found.withColumn("speaks", speaks).where(~(C.is_control(F.col("field")) & F.col("speaks")) | (F.col("relevance") > 0)).drop("speaks")
    order = W.partitionBy(*_KEY).orderBy(F.desc("relevance"), F.desc("score"), "chunk_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def _joined(limit: int | None) -> Column:
    """Snippets in order, one text."""
    taken = F.collect_list(F.when(F.col("place") <= limit, F.struct("place", "snippet")) if limit else F.struct("place", "snippet"))
    return F.array_join(F.transform(F.array_sort(taken), lambda x: x["snippet"]), " ")


def assess(rows: DataFrame, tracked: DataFrame, cited: int = 3) -> DataFrame:
    """One row per tracked entity and field (entity, field, retrieval): verdict, strength, confidence,
    value_text and citations, the first ``cited`` rows."""
    number = H.exact(F.col("snippet"))["value"]
    counted = rows.withColumn("number", F.when(F.col("field") == "headcount", number))
    votes = counted.where("number IS NOT NULL").groupBy(*_KEY, "number").count()
    votes = votes.groupBy(*_KEY).agg(F.min(F.struct(-F.col("count"), "number"))["number"].alias("number"), F.count(F.lit(1)).alias("n_numbers"))
    found = rows.groupBy(*_KEY).agg(
        F.count(F.lit(1)).alias("n_rows"), _joined(None).alias("joined"), _joined(cited).alias("cited_text"), F.coalesce(F.bool_or(F.col("kind").isin("explicit", "explicit_absence")), F.lit(False)).alias("explicit")
    )
    all_ = tracked.join(found, _KEY, "left").join(votes, _KEY, "left")
    retrieval, none = F.coalesce("retrieval", F.lit("NOT_RETRIEVED")), F.coalesce("n_rows", F.lit(0)) == 0
    stated, missing = retrieval == "MENTIONED_EXPLICIT", C.any_of(F.col("cited_text"), C.NEGATIVE)
    conflict = F.coalesce("n_numbers", F.lit(0)) > 1

    def row(verdict: str, strength: Column | str, confidence: Column | float) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(F.lit(verdict).alias("verdict"), lit(strength).alias("strength"), lit(confidence).alias("confidence"))

    judged = (
        F.when(conflict, row("conflict", "weak", 0.52))
        .when(none, row("not_found", "none", F.when(retrieval == "NOT_RETRIEVED", 0.14).otherwise(0.22)))
        .when(missing, row("explicitly_missing", F.when(stated, "strong").otherwise("moderate"), F.when(stated, 0.84).otherwise(0.74)))
        .when(stated | F.col("explicit"), row("present", "strong", 0.86))
        .when(retrieval.isin("MENTIONED_IMPLICIT", "MENTIONED_AMBIGUOUS"), row("ambiguous", "weak", F.when(retrieval == "MENTIONED_IMPLICIT", 0.44).otherwise(0.34)))
        .otherwise(row("not_found", "none", 0.20))
    )
    value = F.when(conflict, "").otherwise(C.value_text(F.col("field"), F.coalesce("joined", F.lit("")), F.col("number")))
    got = all_.select(*_KEY, judged.alias("j"), value.alias("value_text"), F.least(F.coalesce("n_rows", F.lit(0)), F.lit(cited)).alias("n_citations"), retrieval.alias("retrieval"))
    unsure = F.col("j.verdict").isin("ambiguous", "conflict", "not_found")
    status = D.evidence_status(F.col("j.verdict"), F.col("retrieval"), F.col("n_citations") > 0, F.lit(True))
    return got.select(*_KEY, "j.*", "value_text", "n_citations", "retrieval", unsure.alias("needs_confirmation"), status.alias("status"))


def merged_assessments(parts: DataFrame) -> DataFrame:
    """Of several assessments of a field (column ``part``) the best: verdict, confidence, citations; the
    first part wins a tie."""
    rank = D.rank_of(F.col("verdict"), VERDICT, 1)
    order = W.partitionBy(*_KEY).orderBy(rank.desc(), F.desc("confidence"), F.desc("n_citations"), "part")
    return parts.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def merged_snapshots(parts: DataFrame) -> DataFrame:
    """Partial snapshots (entity, field, part, status, n_citations, kind, value) to one row per field.

    The status with most weight and citations, and, apart from it, the value whose status, kind and
    citations weigh most; an ambiguous field without citations was not provided."""
    rank = D.rank_of(F.col("status"), L.STATUS_PRECEDENCE)
    status = F.max_by("status", F.struct(rank.alias("r"), F.col("n_citations").alias("n"), (-F.col("part")).alias("p")))
    weight = F.struct(rank.alias("r"), D.rank_of(F.col("kind"), QUALITY).alias("q"), F.col("n_citations").alias("n"), (-F.col("part")).alias("p"))
    there = F.col("value").isNotNull() & (F.trim("value") != "")
    found = parts.groupBy(*_KEY).agg(status.alias("status"), F.max_by(F.when(there, F.col("value")), F.when(there, weight)).alias("value"), F.least(F.sum("n_citations"), F.lit(2)).alias("n_citations"))
    bare = F.col("n_citations") == 0
    settled = F.when((F.col("status") == "ambiguous") & bare, "not_provided_in_sources").otherwise(F.col("status"))
    return found.select(*_KEY, settled.alias("status"), "value", F.when(settled.isin("not_provided_in_sources", "not_assessed"), 0).otherwise(F.col("n_citations")).alias("n_citations"))


def overlaid(assessed: DataFrame) -> DataFrame:
    """Assessments as typed values: entity, field, kind, value, status. Of headcount and headcount range
    only one stands: an exact number that needs no confirmation, else the range."""
    parsed = C.parsed_value(F.col("field"), F.col("value_text"))
    kept = assessed.withColumn("v", F.when(F.col("verdict").isin("present", "explicitly_missing"), parsed))
    sure = (F.col("field") == "headcount") & F.col("v").isNotNull() & ~F.col("needs_confirmation") & (F.col("confidence") >= 0.85)
    exact = F.coalesce(F.bool_or(sure).over(W.partitionBy("entity")), F.lit(False))
    out = F.when(F.col("field") == "headcount", F.when(exact, F.col("v"))).when(F.col("field") == "headcount_range", F.when(~exact, F.col("v"))).otherwise(F.col("v"))
    return kept.withColumn("exact", exact).select(*_KEY, out["kind"].alias("kind"), out["text"].alias("value"), "status")


def supplemented(values: DataFrame, sentences: DataFrame) -> DataFrame:
    """Fields without a value or a settled status take the first sentence of their entity that states
    one. ``sentences``: entity, chunk_id, pos, sentence."""
    open_ = values.where(F.col("value").isNull() & ~F.col("status").isin("present", "explicitly_missing") & C.is_control(F.col("field")))
    near = open_.select(*_KEY).join(sentences, "entity")
    named = F.when(F.col("field") == "hris_data.hris_system", F.when((C.alias_hits(F.col("field"), F.col("sentence")) > 0) & C.admissible(F.col("sentence")), C.system_name(F.col("sentence"))))
    said = F.coalesce(named, F.when(F.col("field") != "hris_data.hris_system", C.stated(F.col("sentence"), F.col("field"))))
    first = near.withColumn("said", said).where("said IS NOT NULL").groupBy(*_KEY).agg(F.min(F.struct("chunk_id", "pos", "said")).alias("s"))
    got = values.join(first, _KEY, "left")
    new = F.col("s").isNotNull()
    kind = F.when(new, F.when(F.col("field") == "hris_data.hris_system", "string").otherwise("bool")).otherwise(F.col("kind"))
    return got.select(*_KEY, kind.alias("kind"), F.coalesce("s.said", "value").alias("value"), F.when(new, "present").otherwise(F.col("status")).alias("status"))
