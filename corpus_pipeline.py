"""Corpus pipeline: language, exact duplicates, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it and gives the next
stage what was written. All but the last return the columns of ``documents``.

In every stage: null and empty texts are texts without words; texts of any length are read whole; rows are
told apart by doc_id (null equals null) and text, and a repeated row is one of a group or a row of its own as the
stage says; columns that ``documents`` doesn't have are kept as they are, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.llm import exact_dedup, langid, mixing, packing, simhash
from evispark.llm.common import id_part, written
from evispark.llm.queries import tokenizer

#: A document whose words' largest posteriors have a lower mean is in no language that was learned.
LEAST_CERTAINTY = 0.4
#: Near copies: five-word shingles, and fingerprints of 256 bits (4 words) that differ in at most so many; texts of
#: similarity 0.8 differ in 39 on average, of 0.7 in 49.
NEAR = {"shingle": 5, "words": 4, "radius": 42}
#: A name that no table of documents has.
_FOUND = "__language__"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: texts without letters, or whose words are in no language, go. A text
    in several languages stays, and so does what can't be judged: a text with letters when no
    language, or not the one it is labelled with, could be learned."""
    got = langid.identify(docs, id_part(F.col("doc_id"), 4) != 2, into=_FOUND)
    found = {x: F.col(f"{_FOUND}.{x}") for x in ("lang_pred", "certainty", "unlearned")}
    letters = found["certainty"].isNull() | (found["lang_pred"] != langid.UND)
    stays = found["certainty"].isNull() | found["unlearned"] | (found["certainty"] >= LEAST_CERTAINTY)
    return got.where(letters & stays).drop(_FOUND)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, whatever ids its rows have."""
    return exact_dedup.representatives(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the one with the least doc_id (nulls last), of several texts
    with that id the one of the least hash. Texts without words are one group."""
    return simhash.representatives(docs, **NEAR)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says; rarer sources are raised, those with most are lowered. Rows
    without a source, or of no words, have the rate that their text's posterior gives; rows that agree in id, text
    and source have as many copies each."""
    return mixing.mix(docs, **mixing.BY_SOURCE)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A text
    without words is its end id; rows that repeat are packed each; other columns are left behind."""
    return packing.pack(docs, tokenizer())


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("simhash_dedup", near),
    ("mixing", mix),
    ("packing", pack),
]

#: The stages learn models and tokenize: SQL can't express them; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
