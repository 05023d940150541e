"""Evidence of an earlier step, corrected by what a targeted search found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECOVERED = "targeted_retrieval"


def overlaid(evidence: DataFrame, searched: DataFrame, candidates: DataFrame, key: list[str]) -> DataFrame:
    """key, status, retrieval, chunk_id, snippet, anchored, recovered_by, match_count: one row per key of either side.

    ``evidence``: key, status, chunk_id, snippet, anchored (the first citation, null if there is none, and
    whether it has a place in a document). ``searched``: key, retrieval (the fields that are tracked).
    ``candidates``: key, chunk_id, snippet, score, anchored of what the search found.

    A tracked field without evidence is not provided. Where the search found an explicit mention, and the
    evidence isn't present with an anchored citation, the best candidate is cited and the field is present. Where it
    found an implicit or ambiguous one, the best candidate is cited, unless the field is explicitly missing, and what isn't present stays not provided.
    Where it found nothing, what is neither present nor missing is not provided, and after no search at all
    cites nothing. A candidate without chunk or text is no citation. Fields that aren't tracked are
    unchanged. Keys match null to null; equal scores go by chunk."""
    best = F.max_by(F.struct("chunk_id", "snippet", F.coalesce("anchored", F.lit(False)).alias("anchored")), F.struct(F.col("score"), -F.col("chunk_id"))).alias("best")
    top = candidates.groupBy(*key).agg(best, F.count(F.lit(1)).alias("n"))
    own = evidence.select(*(F.col(k).alias(f"_{k}") for k in key), "status", "chunk_id", "snippet", "anchored")
    asked = searched.select(*(F.col(k).alias(f"_s_{k}") for k in key), "retrieval", F.lit(True).alias("tracked"))
    found = own.join(asked, [F.col(f"_{k}").eqNullSafe(F.col(f"_s_{k}")) for k in key], "full")
    there = F.col("status").isNotNull()
    found = found.select(*(F.when(there, F.col(f"_{k}")).otherwise(F.col(f"_s_{k}")).alias(k) for k in key), *(c for c in found.columns if not c.startswith("_")))
    top = top.select(*(F.col(k).alias(f"_t_{k}") for k in key), "best", "n")
    found = found.join(top, [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in key], "left")
    old = F.coalesce("status", F.lit("not_provided_in_sources"))
    held = F.col("chunk_id").isNotNull() & F.coalesce("anchored", F.lit(False))
    weak = (old != "present") | ~held
    usable = F.coalesce(F.col("best.chunk_id").isNotNull() & (F.col("best.snippet") != ""), F.lit(False))
    tracked = F.coalesce("tracked", F.lit(False))
    explicit = tracked & F.coalesce(F.col("retrieval") == "MENTIONED_EXPLICIT", F.lit(False)) & weak & usable
    partly = tracked & F.coalesce(F.col("retrieval").isin("MENTIONED_IMPLICIT", "MENTIONED_AMBIGUOUS"), F.lit(False)) & weak & (old != "explicitly_missing") & usable
    nothing = tracked & F.coalesce(F.col("retrieval").isin("NOT_RETRIEVED", "NOT_FOUND_IN_RETRIEVED"), F.lit(False)) & ~old.isin("present", "explicitly_missing")
    dropped = nothing & (F.col("retrieval") == "NOT_RETRIEVED")
    status = F.when(explicit, "present").when((partly & (old != "present")) | nothing, "not_provided_in_sources").otherwise(old)
    taken = explicit | partly
    cite = {c: F.when(taken, F.col(f"best.{c}")).when(~dropped, F.col(c)) for c in ("chunk_id", "snippet", "anchored")}
    return found.select(
        *key, status.alias("status"), "retrieval", *(v.alias(c) for c, v in cite.items()), F.when(taken, RECOVERED).alias("recovered_by"),
        F.when(tracked, F.coalesce("n", F.lit(0))).cast("long").alias("match_count"),
    )
