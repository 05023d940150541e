"""Findings: what a rubric's items lack, from their evidence; scorecards, memos, drivers and lines of a
report, from findings. Everything is keyed by the rubric's items or areas, which are small; evidence is
reduced to two rows an item before anything is joined to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evispark import lexicon as L
from evispark.functions import text as T
from evispark.operators import decide as D

WORD = r"[\p{L}\p{N}_]+"
UNASSIGNED = "TBD / assign (e.g., HR/People, Finance, Ops)"


def relevance_tokens(text: Column, stop: list[str] | None = None) -> Column:
    stop = L.RELEVANCE_STOP if stop is None else stop
    return F.array_distinct(F.filter(T.tokens(text), lambda t: (F.length(t) >= 4) & ~t.isin(stop)))


def relevant_citations(evidence: DataFrame, items: DataFrame, limit: int = 2) -> DataFrame:
    """The ``limit`` rows of each item with most of its words, then the best score; if none has any, the
    best one alone (``limit``, if the item has no words). ``items``: item_id, words."""
    found = evidence.join(items.select("item_id", "words"), "item_id")
    seen = F.regexp_extract_all(F.lower("snippet"), F.lit(WORD), F.lit(0))
    found = found.withColumn("hits", F.size(F.array_intersect("words", seen)))
    order = W.partitionBy("item_id").orderBy(F.desc("hits"), F.desc("score"), "rank")
    found = found.withColumns({"place": F.row_number().over(order), "most": F.max("hits").over(W.partitionBy("item_id"))})
    most = F.when(F.size("words") == 0, limit).when(F.col("most") == 0, 1).otherwise(limit)
    return found.where((F.col("place") <= most) & ((F.col("hits") > 0) | (F.col("most") == 0))).drop("words", "most")


def active(items: DataFrame, bands: DataFrame, band: str) -> DataFrame:
    """The items of a band in its order (``bands``: band, ord, item_id); all of them if the band is unknown."""
    own = bands.where(F.col("band") == band).select("item_id", "ord")
    known = own.agg(F.count(F.lit(1)).alias("known"))
    got = items.join(own, "item_id", "left").crossJoin(F.broadcast(known))  # one row
    return got.where((F.col("known") == 0) | F.col("ord").isNotNull()).drop("known")


def owner(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(low.rlike(r"\bpeople ops\b|\bpeople team\b"), "People Team")
        .when(low.rlike(r"\bhr\b|\bhuman resources\b"), "HR Team")
        .when(low.rlike(r"\bfinance\b"), "Finance")
        .when(low.rlike(r"\boperations\b|\bops\b"), "Ops")
        .otherwise(UNASSIGNED)
    )


def evaluate(items: DataFrame, evidence: DataFrame, statuses: DataFrame) -> DataFrame:
    """One finding per item that isn't explicitly there.

    ``items``: item_id, area, claim, severity, compliance, question, words. ``evidence``: item_id,
    chunk_id, snippet, kind, score, rank. ``statuses``: item_id, retrieval."""

    def cited(rows: DataFrame, name: str) -> DataFrame:
        kept = relevant_citations(rows, items).groupBy("item_id")
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "snippet"))), lambda x: x["snippet"]), " ")
        return kept.agg(F.count(F.lit(1)).alias(f"n_{name}"), text.alias(f"{name}_text"))

    got = items.join(cited(evidence, "all"), "item_id", "left").join(cited(evidence.where("kind = 'explicit_absence'"), "absent"), "item_id", "left")
    got = got.join(statuses, "item_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_all", "n_absent")})
    explicit, retrieval = F.coalesce(F.col("retrieval") == "MENTIONED_EXPLICIT", F.lit(False)), F.col("retrieval")
    missing = explicit & (F.col("n_absent") > 0)
    got = got.where(missing | ~(explicit & (F.col("n_all") > 0)))
    missed = F.coalesce(retrieval == "NOT_RETRIEVED", F.lit(False))
    weak = retrieval.isin("MENTIONED_IMPLICIT", "MENTIONED_AMBIGUOUS") | (F.col("n_all") > 0)
    verdict = F.when(missing, "explicitly_missing").when(missed, "not_found").when(weak, "ambiguous").otherwise("not_found")
    got = got.withColumn("verdict", verdict).withColumn("n", F.when(missing, F.col("n_absent")).otherwise(F.col("n_all")))
    status = D.evidence_status(F.col("verdict"), F.coalesce("retrieval", F.lit("")), F.col("n") > 0, ~missed)
    got = got.withColumn("status", status).withColumn("needs_confirmation", D.needs_confirmation(F.col("status")))
    shown = F.col("status").isin("ambiguous", "explicitly_missing")
    severity = F.when(F.col("needs_confirmation"), D.adjusted_severity(F.col("severity"), F.coalesce("retrieval", F.lit("")), F.col("compliance"))).otherwise(F.col("severity"))
    text = F.when(F.col("verdict") == "explicitly_missing", F.col("absent_text")).otherwise(F.col("all_text"))
    ask = F.coalesce(F.nullif("question", F.lit("")), F.concat(F.lit("Can you confirm status of: "), F.col("claim"), F.lit("?")))
    return got.select(
        "item_id", "area", "claim", severity.alias("severity"), "status", "retrieval", "needs_confirmation",
        F.when(shown, F.col("n")).otherwise(0).alias("n_citations"),
        owner(F.when(shown, text)).alias("owner"),
        F.when(F.col("needs_confirmation"), ask).alias("question"),
        (F.col("compliance") | severity.isin("high", "critical")).alias("is_risk"),
    )


def area_of(area: Column, labels: dict[str, str], aliases: dict[str, str]) -> Column:
    """An area's key: one that has a label, or what it is an alias of, or itself."""
    key, out = T.area_key(area), T.area_key(area)
    for name, meant in aliases.items():
        if name not in labels:
            out = F.when(key == name, F.lit(meant)).otherwise(out)
    return out


def unknown_label(area: Column) -> Column:
    """An unlabelled area as a title: capitals after anything that isn't a letter, as in 'Sops / Hr' -> 'SOPs / HR'."""
    flat = T.collapse(F.regexp_replace(F.regexp_replace(area, r"[_|]+", " / "), r"\s*/\s*", " / "))
    parts = F.regexp_extract_all(F.lower(flat), F.lit(r"([a-z]+|[^a-z]+)"), F.lit(0))
    titled = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), "")
    for wrong, right in (("Hr", "HR"), ("Deib", "DEIB"), ("Sops", "SOPs")):
        titled = F.regexp_replace(titled, rf"\b{wrong}\b", right)
    return F.when(flat == "", "Other").otherwise(titled)


def scorecard(findings: DataFrame, areas: DataFrame, low_coverage: bool | Column, labels: dict[str, str], aliases: dict[str, str]) -> DataFrame:
    """area, label, maturity, impact, n_findings, rank: every labelled area (``areas``: area, label) and
    every other that findings name, the worst first; equal ones by label, falling."""
    high, open_ = F.col("severity").isin("critical", "high"), F.col("status").isin("ambiguous", "not_assessed", "not_provided_in_sources")
    found = findings.withColumn("key", area_of(F.col("area"), labels, aliases)).groupBy("key").agg(
        F.min(F.struct("item_id", "area"))["area"].alias("first_area"),
        F.count(F.lit(1)).alias("n_findings"),
        F.count_if(high).alias("n_high"),
        F.count_if(high & (F.col("status") == "explicitly_missing")).alias("n_missing"),
        F.count_if((F.col("severity") == "critical") & open_).alias("n_critical"),
        F.count_if(F.col("severity") == "medium").alias("n_medium"),
    )
    got = areas.withColumnRenamed("area", "key").join(found, "key", "full_outer")
    got = got.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_findings", "n_high", "n_missing", "n_critical", "n_medium")})
    low = low_coverage if isinstance(low_coverage, Column) else F.lit(low_coverage)
    maturity = F.when((F.col("n_findings") == 0) & low, "Developing").otherwise(D.maturity(F.col("n_missing"), F.col("n_high"), F.col("n_critical"), F.col("n_findings")))
    impact = F.when(F.col("n_findings") == 0, "Limited").otherwise(D.impact(F.col("n_high"), F.col("n_medium")))
    got = got.select(F.col("key").alias("area"), F.coalesce("label", unknown_label(F.col("first_area"))).alias("label"), maturity.alias("maturity"), impact.alias("impact"), "n_findings")
    order = W.orderBy(D.rank_of(F.col("impact"), L.IMPACT).desc(), D.rank_of(F.col("maturity"), L.MATURITY_RISK).desc(), F.desc("label"))
    return got.withColumn("rank", F.row_number().over(order))  # a row an area


def driver_line(status: Column, area: Column, title: Column) -> Column:
    where = F.replace(area, F.lit("_"), F.lit(" "))
    return (
        F.when(status == "explicitly_missing", F.concat(F.lit("Sources indicate a required control is not in place in "), where, F.lit(".")))
        .when(status == "ambiguous", F.concat(F.lit("Evidence is partial/indirect for a high-priority control in "), where, F.lit("; confirm before finalizing.")))
        .when(status == "not_provided_in_sources", F.concat(F.lit("High-priority control evidence was not found in reviewed sources for "), where, F.lit(".")))
        .when(status == "not_assessed", F.concat(F.lit("Source retrieval coverage was insufficient to assess a high-priority control in "), where, F.lit(".")))
        .otherwise(F.concat(F.lit("Evidence indicates this control is documented: "), F.regexp_replace(T.strip(title), r"\.+$", ""), F.lit(".")))
    )


def drivers(findings: DataFrame, k: int = 3) -> DataFrame:
    """line, place: what drives the result, from the first ``k`` findings by rank that aren't minor and
    present; equal lines once."""
    told = findings.where(~((F.col("status") == "present") & F.col("severity").isin("low", "medium"))).orderBy("rank").limit(k)
    lines = told.select(driver_line(F.col("status"), F.col("area"), F.col("claim")).alias("line"), "rank").groupBy("line").agg(F.min("rank").alias("rank"))
    return lines.select("line", F.row_number().over(W.orderBy("rank")).alias("place"))


def unknown_line(name: Column, retrieval: Column) -> Column:
    return (
        F.when(retrieval == "NOT_RETRIEVED", F.concat(F.lit("Coverage gap (NOT_RETRIEVED): "), name))
        .when(retrieval == "NOT_FOUND_IN_RETRIEVED", F.concat(F.lit("Searched retrieved corpus; not observed (NOT_FOUND_IN_RETRIEVED): "), name))
        .when(retrieval == "MENTIONED_AMBIGUOUS", F.concat(F.lit("Mentioned but ambiguous (MENTIONED_AMBIGUOUS): "), name))
        .otherwise(F.concat(F.lit("Not provided in sources: "), name))
    )


def memo(assessed: DataFrame, confirmed: int = 4, lines: int = 12) -> DataFrame:
    """Per entity: counts of confirmed, weak, conflicting and missing fields; the note of its confirmed
    fields and the number of questions, both capped."""
    note = F.concat("field", F.when(F.col("value_text") != "", F.concat(F.lit(": "), F.col("value_text"))).otherwise(F.lit(": unresolved")), F.format_string(" (confidence=%.2f)", "confidence"))
    sure = F.col("verdict") == "present"
    notes = F.slice(F.array_sort(F.collect_list(F.when(sure, note))), 1, confirmed)
    return assessed.groupBy("entity").agg(
        F.count_if(sure).alias("confirmed"),
        F.count_if(F.col("verdict").isin("ambiguous", "not_found", "explicitly_missing")).alias("weak"),
        F.count_if(F.col("verdict") == "conflict").alias("conflicts"),
        F.count_if(F.col("verdict").isin("ambiguous", "not_found")).alias("gaps"),
        F.least(F.count_if(F.col("verdict").isin("ambiguous", "conflict", "not_found")), F.lit(lines)).alias("questions"),
        F.array_join(notes, "; ").alias("notes"),
    )


def guidance(applicable: DataFrame, rules: DataFrame, sources: DataFrame, caps: dict[str, int]) -> DataFrame:
    """entity, kind, place, text: the lists of the rules that apply, in the order of their specificity
    and length, each text once whatever its capitals, ``caps`` by kind; sources fall back to the first
    three. ``applicable``: entity, rule, specificity. ``rules``: rule, kind, pos, text."""
    size = rules.where("kind = 'practice'").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    ranked = applicable.join(size, "rule", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ranked = ranked.withColumn("at", F.row_number().over(W.partitionBy("entity").orderBy(F.desc("specificity"), F.desc("n"), "ord")))
    lines = ranked.select("entity", "rule", "at").join(rules, "rule").withColumn("text", T.strip(F.col("text"))).where("text <> ''")
    first = F.row_number().over(W.partitionBy("entity", "kind", F.lower("text")).orderBy("at", "pos"))
    lines = lines.withColumn("k", first).where("k = 1")
    lines = lines.withColumn("place", F.row_number().over(W.partitionBy("entity", "kind").orderBy("at", "pos")))
    lines = lines.where(F.col("place") <= D.rank_of(F.col("kind"), caps, 1_000_000)).select("entity", "kind", "place", "text")
    cited = lines.where("kind = 'source'").join(sources.select(F.col("source").alias("text"), "title"), "text").select("entity", "kind", "place", F.col("title").alias("text"))
    without = applicable.select("entity").distinct().join(cited.select("entity").distinct(), "entity", "left_anti")
    spare = without.crossJoin(F.broadcast(sources.where("ord <= 3").select("ord", "title")))  # three rows
    return lines.where("kind <> 'source'").unionByName(cited).unionByName(spare.select("entity", F.lit("source").alias("kind"), F.col("ord").alias("place"), F.col("title").alias("text")))


def structure(label: Column) -> Column:
    """The fall-back people structure for a size label."""
    low = F.lower(label)
    both = lambda a, b: F.contains(low, F.lit(a)) & F.contains(low, F.lit(b))
    return (
        F.when(F.contains(low, F.lit("<20")) | F.contains(low, F.lit("under 20")), "founder-led")
        .when(both("20", "49"), "generalist")
        .when(both("50", "99"), "people-ops-lead")
        .when(both("100", "250"), "head-of-people")
        .otherwise("scaled")
    )


def observations(found: DataFrame, catalog: DataFrame, limit: int = 3) -> DataFrame:
    """Observations of an outside reader (obs_id, chunk_ids, hypothesis) with the citations that the
    catalogue (chunk_id, snippet, score) backs, as statuses."""
    # Of rows that share a chunk the last of the catalogue's order counts.
    last = catalog.groupBy("chunk_id").agg(F.max_by("snippet", "place").alias("snippet"))
    each = found.select("obs_id", F.posexplode("chunk_ids").alias("pos", "chunk_id")).join(last, "chunk_id")
    kept = each.withColumn("k", F.row_number().over(W.partitionBy("obs_id").orderBy("pos"))).where(F.col("k") <= limit)
    n = F.coalesce("n", F.lit(0))
    got = found.select("obs_id", "hypothesis").join(kept.groupBy("obs_id").agg(F.count(F.lit(1)).alias("n")), "obs_id", "left").select("obs_id", "hypothesis", n.alias("n"))
    some, guess = F.col("n") > 0, F.col("hypothesis")
    verdict = F.when(some & ~guess, "present").when(some | guess, "ambiguous").otherwise("not_found")
    retrieval = F.when(some & guess, "MENTIONED_AMBIGUOUS").when(some, "MENTIONED_EXPLICIT").otherwise("NOT_FOUND_IN_RETRIEVED")
    status = D.evidence_status(verdict, retrieval, some, F.lit(True))
    return got.select("obs_id", F.col("n").alias("n_citations"), status.alias("status"), retrieval.alias("retrieval"), (D.needs_confirmation(status) | guess).alias("needs_confirmation"))


def catalog(evidence: DataFrame, limit: int = 50) -> DataFrame:
    """The ``limit`` best evidence rows over all items, in order (``place``)."""
    top = evidence.orderBy(F.desc("score"), "item_id", "rank").limit(limit)
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc("score"), "item_id", "rank")))
