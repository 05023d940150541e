"""Chunks worth reading for a set of fields: scored, the required ones first, cut to what matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evispark.functions import fields as C
from evispark.functions import text as T


def signal_score(text: Column, keywords: list[list[str]], patterns: list[str]) -> Column:
    """Length, sentences, menus, fields named (``keywords``: the names of each) and statements."""
    low = F.lower(text)
    named = sum(((sum((F.contains(low, F.lit(a)).cast("int") for a in names), F.lit(0)) > 0).cast("int") for names in keywords), F.lit(0))
    return (
        (F.length(text) >= 320).cast("int")
        + F.when(F.size(T.sentences(text)) >= 2, 2).otherwise(0)
        - F.when(T.nav_like(text), 4).otherwise(0)
        + F.least(F.lit(3), named)
        + C.any_of(text, patterns).cast("int")
    )


def compressed(text: Column, keywords: list[list[str]], patterns: list[str], most: int = 6, least: int = 2, first: int = 4) -> Column:
    """The first ``most`` sentences that name a field or state something; with fewer than ``least`` the
    text's first ones."""
    names = [a for group in keywords for a in group]
    all_ = T.sentences(text)
    told = F.filter(all_, lambda s: sum((F.contains(F.lower(s), F.lit(a)).cast("int") for a in names), F.lit(0)) + C.any_of(s, patterns).cast("int") > 0)
    kept = F.array_join(F.slice(F.when(F.size(told) >= least, F.slice(told, 1, most)).otherwise(F.slice(all_, 1, first)), 1, most), " ")
    return F.when(F.size(all_) == 0, text).otherwise(kept)


def preselected(chunks: DataFrame, keywords: list[list[str]], patterns: list[str], required: DataFrame, k: int = 120) -> DataFrame:
    """chunk_id, place, score, text: equal texts once, required chunks first, then those that score 0 and
    more, by score and length; all of them if none does. ``required``: chunk_id."""
    once = F.row_number().over(W.partitionBy(F.xxhash64(F.lower(T.collapse(F.col("text")))), F.lower(T.collapse(F.col("text")))).orderBy("chunk_id"))
    found = chunks.withColumn("_k", once).where("_k = 1").drop("_k").withColumn("score", signal_score(F.col("text"), keywords, patterns))
    must = required.select("chunk_id").distinct().withColumn("must", F.lit(True))
    found = found.join(must, "chunk_id", "left").withColumn("must", F.coalesce("must", F.lit(False)))
    good = found.agg(F.coalesce(F.bool_or(F.col("must") | (F.col("score") >= 0)), F.lit(False)).alias("some"))
    found = found.crossJoin(F.broadcast(good)).where(~F.col("some") | F.col("must") | (F.col("score") >= 0))  # one row
    order = [F.desc("must"), F.desc("score"), F.desc(F.length("text")), F.asc("chunk_id")]
    top = found.orderBy(*order).limit(k)
    place = F.row_number().over(W.orderBy(*order))  # k rows
    return top.select("chunk_id", place.alias("place"), "score", compressed(F.col("text"), keywords, patterns).alias("text"))
