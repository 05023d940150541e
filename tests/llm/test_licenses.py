"""Licence scan: against all rules without gate and containment pair by pair, and the base phrases by hand."""

from __future__ import annotations

import re
import string

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evispark.llm import licenses
from evispark.llm.license_rules import RULES, parsed

BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
    "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
)


def plain(text):
    """(words, kept spans): every rule on every text, every pair of spans compared."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    flat = (" " + " ".join(words) + " ").encode()
    spans = []
    for k, rule in enumerate(RULES):
        for m in re.finditer(rule.pattern, flat):
            start = flat[: m.start()].count(b" ") - 1
            spans.append((start, start + len(m[0].split()), k))

    def counts_more(x, y):
        rank = lambda s: (-RULES[s[2]].priority, s[0] - s[1], s[2], s[0])
        return rank(x) < rank(y) and x[0] <= y[0] and y[1] <= x[1]

    return words, [s for s in spans if RULES[s[2]].base or not any(counts_more(o, s) for o in spans)]


def base_places(words):
    return sorted((i, label) for label, phrase in BASE.items() for p in [phrase.split()] for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p)


def expected(doc_id, text):
    words, spans = plain(text)
    places = base_places(words)
    at = [p for p, _ in places]
    wrong = 1.0
    for label in {RULES[s[2]].label for s in spans}:
        wrong *= 1 - max(RULES[s[2]].confidence for s in spans if RULES[s[2]].label == label)
    return (
        doc_id, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})),
        ",".join(sorted({RULES[s[2]].label for s in spans})), round(1 - wrong, 9), len(spans),
    )


def got(table):
    rows = licenses.summary(table).drop("n_suppressed").collect()
    return sorted(((*r[:7], round(r[7], 9), r[8]) for r in rows), key=repr)


def test_scan_like_every_rule_on_every_text(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = sorted((expected(*r) for r in table.collect()), key=repr)
    assert got(table) == want and any(r[2] for r in want) and any(r[6] for r in want)


def test_overlaps_and_odd_rows(spark):
    texts = [
        None, "", " \n\t", "...", "Released UNDER the MIT-License (MIT license).", NOTICE, NOTICE + " " + NOTICE, "GPL, GPLv3; LGPL v2.1",
        "cc by nc CC-BY-NC cc by nc-nd 4.0", "Licensed under CC BY-NC-SA 4.0 or the Apache License, Version 2.0", "mit der Lizenz é under the mit licenseé",
        "x " * 50_000 + "apache license version 2 " * 2_000, " under the mit license", "SPDX-License-Identifier: GPL-2.0-or-later",
    ]
    rows = [(i, t, "clash", 7, "clash") for i, t in enumerate([*texts, texts[4]])] + [(None, texts[4], "c", 1, "c"), (4, texts[4], "c", 1, "c")]
    table = spark.createDataFrame(rows, "doc_id long, text string, found string, n_words int, label string")
    want = sorted((expected(r[0], r[1]) for r in rows), key=repr)
    assert got(table) == want
    assert got(table.limit(0)) == []
    labels = {r[0]: r[6] for r in got(table) if r[0] is not None}
    assert labels[5] == "gpl-3-or-later" and labels[7] == "gpl,gpl-3,lgpl" and labels[9] == "apache-2,cc-by-nc,cc-by-nc-sa-4.0"


def test_rules_may_be_given(spark):
    rules = parsed("own | secret | secret sauce", 1, 0.5) + parsed("more | secret | my secret sauce", 1, 0.25)
    table = spark.createDataFrame([(1, "My secret sauce; secret sauce")], "doc_id long, text string")
    row = licenses.summary(table, rules).first()
    assert (row["labels"], row["n_kept"], row["n_suppressed"], row["n_base"]) == ("more,own", 2, 1, 0) and abs(row["score"] - 0.625) < 1e-9
    spans = licenses.scan(table, rules).select(F.explode("found").alias("f")).select("f.start", "f.end", "f.label", "f.kept").collect()
    assert [tuple(s) for s in spans] == [(0, 3, "more", True), (1, 3, "own", False), (3, 5, "own", True)]


@settings(max_examples=400, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.data(), st.integers(0, len(RULES) - 1))
def test_a_match_has_the_rules_keywords(data, k):
    body = RULES[k].pattern.decode().removeprefix("(?<= )").removesuffix("(?= )").replace(r"\S", "[a-z0-9]").replace(r"\d", "[0-9]")
    text = data.draw(st.from_regex(body, fullmatch=True, alphabet=st.sampled_from(string.ascii_lowercase + string.digits + " ")))
    scanner = licenses.Scanner()
    words = licenses.words_of(text)
    assert RULES[k].keys <= set(words)
    assert any(rule == k and (a, b) == (0, len(words)) for a, b, rule in scanner.spans(words))


def test_there_are_hundreds_of_rules():
    assert len(RULES) > 250 and sum(r.base for r in RULES) == 3 and len({r.label for r in RULES}) > 100
