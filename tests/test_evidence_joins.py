"""A token meets the rubric in one join on a long, and words are split, not extracted."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from evispark.operators import evidence as E

TEXTS = {1: "", 2: "...", 3: " Ab, ab-c\u00d1o \u00e9t\u00e9!9x ", 4: None, 5: "leave of absence\nleaves"}


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_split(spark):
    texts = spark.createDataFrame(list(TEXTS.items()), "chunk_id long, text string")
    got = texts.select("chunk_id", E.words_of(F.col("text")).alias("w"))
    want = {1: [], 2: [], 3: ["ab", "ab", "c\u00f1o", "\u00e9t\u00e9", "9x"], 4: [], 5: ["leave", "of", "absence", "leaves"]}
    assert {r["chunk_id"]: list(r["w"]) for r in got.collect()} == want
    assert "regexp_extract_all" not in plan(got)


def test_tokens_and_pairs_meet_in_one_join_on_a_long(spark):
    chunks = spark.createDataFrame([(k, t) for k, t in TEXTS.items() if t], "chunk_id long, text string")
    items = spark.createDataFrame([(1, 0, "leave of absence"), (2, 0, "ab \u00e9t\u00e9")], "item_id long, q int, query string")
    index, ask = E.token_index(chunks), E.asked(items, E.Signals(noise=["of"]))
    own = E.meanings(index.select("chunk_id", F.explode("words").alias("token")), ask)
    told = E.told_hits(index, ask)
    for found in (own, told):
        keys = [x.split("Inner, ")[1] for x in plan(found).splitlines() if "Join Inner" in x]
        assert len(keys) == 1 and dict(ask.grams.dtypes)["key"] == dict(ask.says.dtypes)["key"] == "bigint"
        assert keys[0].count("key#") == 2 and not re.search(r"word[01]#\d+ = |= word[01]#", keys[0])
    assert {(r["chunk_id"], r["item_id"]) for r in own.collect()} >= {(5, 1)}
    assert {(r["chunk_id"], r["item_id"]) for r in told.collect()} == {(5, 1)}
