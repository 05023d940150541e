"""The size band and funding stage of each entity, from stated numbers, sentences and proxies.

Every step is a join with a small dimension, a conditional aggregate per entity or a ranked pick, so any
number of entities is placed in one plan. Dimensions: bands (band, lo, hi, ord; hi null: open) and
funding (stage, label, ord) with aliases (stage, alias)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evispark.functions import headcount as H
from evispark.operators import decide as D

# Terms that hint at a large company, and what a funding stage is also called.
PROXIES = ["global entities", "global", "multi-country", "international", "investor relations", " ir ", "workday"]
PROVE_TOP = ["global entities", "global", "multi-country", "board_of_directors", "investor relations", "workday"]
ABROAD = ["canada", "uk", "united kingdom", "germany", "france", "india", "singapore", "australia", "japan", "mexico", "brazil", "emea", "apac", "latam"]
BOARD = r"\bboard of directors\b|\bboard meetings?\b"
MORE_ALIASES = [
    (("seed",), ("series",), ["seed", "seed stage", "pre-seed", "pre seed"]),
    (("series a", "series_a", "series-a"), (), ["series a", "series-a", "series_a", "post-seed"]),
    (("series b", "series_b", "series-b"), (), ["series b", "series-b", "series_b"]),
    (("series c", "series_c", "series-c", "c+", "growth"), (), ["series c", "series-c", "series c+", "series d", "series e", "series f", "pre-ipo", "ipo", "public company"]),
]
#: Words that a funding stage is recognised by, for bands that end below a size.
BY_SIZE = [(20, ("seed", "pre-seed")), (50, ("series a", "series-a", "series_a")), (100, ("series b", "series-b", "series_b")), (None, ("series c", "series-c", "series c+", "series d", "growth", "ipo"))]


def funding_aliases(stages: list[tuple[str, str, list[str]]]) -> list[tuple[str, str]]:
    """(stage, alias) rows of (stage, label, aliases), with the usual other spellings."""
    rows = []
    for stage, label, aliases in stages:
        names = {x.lower().strip() for x in (stage, label, *aliases)}
        seen = " ".join(sorted(names))
        for any_of, none_of, more in MORE_ALIASES:
            if any(x in seen for x in any_of) and not any(x in seen for x in none_of):
                names.update(more)
        rows += [(stage, n) for n in sorted(names) if len(n) >= 3]
    return rows


def size_funding(stages: list[tuple[str, str, list[str]]], top: int | None) -> str | None:
    """The funding stage that a band ending at ``top`` employees suggests."""
    words = next(w for limit, w in BY_SIZE if limit is None or top is not None and top < limit)
    return next((s for s, label, aliases in stages if any(w in " ".join([s, label, *aliases]).lower() for w in words)), None)


def complexity_signals(sentences: DataFrame, locations: DataFrame) -> DataFrame:
    """entity, signal: proxies of a large company in an entity's texts, and in where it is."""
    low = F.lower("sentence")
    found = F.array(*[F.when(low.contains(p), F.lit(p)) for p in PROXIES], F.when(low.rlike(BOARD), F.lit("board_of_directors")))
    spoken = sentences.select("entity", F.explode(F.filter(found, lambda s: s.isNotNull())).alias("signal")).distinct()
    place = F.lower(F.trim("location"))
    abroad = place.rlike("|".join(ABROAD))
    where = locations.where(place != "").groupBy("entity").agg(F.countDistinct(place).alias("n"), F.coalesce(F.bool_or(abroad), F.lit(False)).alias("abroad"))
    both = F.array(F.when(F.col("n") >= 2, F.lit("multi-state")), F.when(F.col("abroad"), F.lit("multi-country")))
    return spoken.unionByName(where.select("entity", F.explode(F.filter(both, lambda s: s.isNotNull())).alias("signal"))).distinct()


def funding_scores(sentences: DataFrame, aliases: list[tuple[str, str]]) -> DataFrame:
    """entity, stage, score: 1.4 for each sentence and alias of the form 'series x', 1 for others."""
    low = F.lower("sentence")
    hits = [F.when(low.rlike(rf"\b{a.replace('+', chr(92) + '+')}\b"), F.struct(F.lit(s).alias("stage"), F.lit(1.4 if a.startswith("series ") else 1.0).alias("boost"))) for s, a in aliases]
    found = sentences.select("entity", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h"))
    return found.groupBy("entity", F.col("h.stage").alias("stage")).agg(F.round(F.sum("h.boost"), 6).alias("score"))


def sentence_signals(sentences: DataFrame) -> DataFrame:
    """entity, pivot, confidence, exact, chunk_id, pos: the earliest of the surest sentences."""
    found = sentences.withColumn("s", H.stage_signal(F.col("sentence"))).where("s IS NOT NULL")
    order = W.partitionBy("entity").orderBy(F.desc("s.confidence"), "chunk_id", "pos")
    return found.withColumn("_k", F.row_number().over(order)).where("_k = 1").select("entity", "s.*", "chunk_id", "pos")


def infer(entities: DataFrame, sentences: DataFrame, locations: DataFrame, bands: DataFrame, stages: list[tuple[str, str, list[str]]], tops: dict[str, int | None]) -> DataFrame:
    """One row per entity: band, confidence, source, exactness, lowest and highest band that it may be
    in, funding stage with its confidence and what is not known.

    ``entities``: entity, headcount, headcount_exact, headcount_range. ``tops``: band -> its end."""
    stated = F.struct(F.col("headcount").alias("pivot"), F.when(F.col("headcount_exact"), 1.0).otherwise(0.72).alias("confidence"), F.coalesce("headcount_exact", F.lit(False)).alias("exact"))
    low, high = F.regexp_extract("headcount_range", r"(\d{1,5})\s*(?:-|to)\s*(\d{1,5})", 1).try_cast("int"), F.regexp_extract("headcount_range", r"(\d{1,5})\s*(?:-|to)\s*(\d{1,5})", 2).try_cast("int")
    alone = F.regexp_extract("headcount_range", r"(\d{1,5})", 1).try_cast("int")
    pivot = F.coalesce(F.bround((low + high) / 2, 0).cast("int"), alone)
    ranged = F.struct(pivot.alias("pivot"), F.lit(0.72).alias("confidence"), F.lit(False).alias("exact"))
    said = sentence_signals(sentences).select("entity", F.struct("pivot", "confidence", "exact").alias("said"))
    known = entities.join(said, "entity", "left").withColumn(
        "signal", F.coalesce(F.when(F.col("headcount").isNotNull(), stated), F.when(pivot.isNotNull(), ranged), F.col("said"))
    )
    edges = bands.agg(F.min_by("band", "ord").alias("first"), F.max_by("band", "ord").alias("top"), F.max("ord").alias("top_ord"), F.max_by("band", F.when(F.col("hi").isNotNull(), F.col("ord"))).alias("below"))
    inside = (F.col("signal.pivot") >= F.col("lo")) & (F.col("hi").isNull() | (F.col("signal.pivot") <= F.col("hi")))
    placed = known.join(bands, inside, "left").crossJoin(F.broadcast(edges))  # one row of edges
    numeric = F.col("band").isNotNull()
    exact = numeric & F.coalesce(F.col("signal.exact"), F.lit(False))
    capped = numeric & ~exact & (F.col("band") == F.col("top"))
    proxies = complexity_signals(sentences, locations).where(F.col("signal").isin(PROVE_TOP)).select("entity").distinct().withColumn("proxied", F.lit(True))
    order = {s: i for i, (s, _, _) in enumerate(stages)}
    scores = funding_scores(sentences, funding_aliases(stages)).withColumn("_o", D.rank_of(F.col("stage"), order))
    first = W.partitionBy("entity").orderBy(F.desc("score"), "_o")
    funded = scores.withColumn("_k", F.row_number().over(first)).where("_k = 1").select("entity", F.col("stage").alias("found_funding"), F.round(F.least(F.lit(0.9), 0.56 + 0.08 * F.col("score")), 3).alias("found_confidence"))
    got = placed.join(proxies, "entity", "left").join(funded, "entity", "left")
    chosen = F.when(~numeric, F.col("first")).when(capped, F.col("below")).otherwise(F.col("band"))
    got = got.withColumns({"numeric": numeric, "exact": exact, "capped": capped, "stage_id": chosen, "proxy": F.coalesce("proxied", F.lit(False)) & ~exact})
    guess = F.lit(None).cast("string")
    for band, end in tops.items():
        guess = F.when(F.col("stage_id") == band, F.lit(size_funding(stages, end))).otherwise(guess)
    fund = F.coalesce("found_confidence", F.when(guess.isNotNull(), 0.34))
    base = F.when(F.col("numeric"), F.col("signal.confidence")).otherwise(0.3)
    return got.select(
        "entity",
        "stage_id",
        D.stage_confidence(base, F.col("capped"), F.col("proxy"), F.col("numeric"), fund).alias("confidence"),
        F.when(F.col("numeric"), "rules").otherwise("unknown").alias("source"),
        "exact",
        F.col("stage_id").alias("stage_min"),
        F.when(F.col("capped") | F.col("proxy"), F.col("top")).otherwise(F.col("stage_id")).alias("stage_max"),
        F.coalesce("found_funding", guess).alias("funding"),
        fund.alias("funding_confidence"),
        F.col("found_funding").isNotNull().alias("funding_stated"),
        F.concat_ws(",", F.when(~F.col("exact"), "explicit_headcount"), F.when(F.coalesce("headcount_range", F.lit("")) == "", "headcount_range"), F.when(F.col("found_funding").isNull(), "funding_round")).alias("missing"),
    )


def alternatives(inferred: DataFrame, bands: DataFrame, k: int = 2) -> DataFrame:
    """The neighbouring bands of each entity's band as candidates, best first."""
    ord_of = bands.select(F.col("band").alias("stage_id"), F.col("ord").alias("at"))
    near = inferred.join(ord_of, "stage_id").join(bands, F.abs(F.col("ord") - F.col("at")) == 1)
    confidence = F.round(F.greatest(F.lit(0.1), F.col("confidence") - 0.18), 3)
    rank = F.row_number().over(W.partitionBy("entity").orderBy(F.desc("alternative_confidence"), "ord"))
    return near.select("entity", F.col("band").alias("alternative"), confidence.alias("alternative_confidence"), "ord").withColumn("rank", rank).where(F.col("rank") <= k).drop("ord")


def provisional(confidence: Column, threshold: float = 0.62) -> Column:
    return confidence < threshold
