"""Licence scan: ordered signature rules behind a keyword gate, overlaps resolved by priority and containment.

A text becomes words: A-Z lower-cased, words are runs of 0-9, a-z and everything beyond ASCII. Each rule of
``license_rules`` is a pattern over the words joined by blanks, and is tried only where all its
keywords are among the words, so a text that speaks of no licence costs one pass over its words.

Detections are word intervals. One is suppressed if a detection that counts more contains its interval: of
higher priority, or as high and longer, or as long and of an earlier rule. Containment is transitive,
so it doesn't matter whether the one that contains is suppressed itself; sorted by what counts, one
running maximum of ends over starts (a Fenwick tree) decides each in logarithmic time. Detections of base rules are never suppressed.

Texts are independent rows: nothing is shuffled. Every text is read whole, by one task, which holds one batch.

Defined results: null texts are empty; texts without words have no detections and score 0; rows that
repeat a doc_id or a text are rows of their own; null doc_ids stay null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, texts
from .license_rules import RULES, Rule

#: A-Z to a-z; all other ASCII but digits and letters to blanks; bytes of longer characters stay.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

FOUND = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("rule", pa.int32()), ("priority", pa.int32()), ("confidence", pa.float64()), ("base", pa.bool_()), ("kept", pa.bool_())])
_KIND = pa.struct([("n_words", pa.int64()), ("found", pa.list_(FOUND))])
KIND = "struct<n_words:long,found:array<struct<start:long,end:long,label:string,rule:int,priority:int,confidence:double,base:boolean,kept:boolean>>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


@cache
def _compiled(pattern: bytes) -> re.Pattern[bytes]:
    return re.compile(pattern)


class Scanner:
    def __init__(self, rules: list[Rule] = RULES):
        self.rules = rules

    @cached_property
    def gates(self) -> dict[bytes, list[int]]:
        """Rules by one of their keywords, the one that fewest rules ask for."""
        asked = defaultdict(int)
        for rule in self.rules:
            for key in rule.keys:
                asked[key] += 1
        found = defaultdict(list)
        for k, rule in enumerate(self.rules):
            found[min(rule.keys, key=lambda x: (asked[x], x))].append(k)
        return dict(found)

    @cached_property
    def keys(self) -> frozenset[bytes]:
        return frozenset().union(*(r.keys for r in self.rules))

    def spans(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(first word, word after the last, rule) of every match of a rule whose keywords are there."""
        seen = self.keys.intersection(words)
        tried = sorted(k for key in seen if key in self.gates for k in self.gates[key] if self.rules[k].keys <= seen)
        if not tried:
            return []
        flat = b" " + b" ".join(words) + b" "
        found = [(m.start() - 1, m.end(), k) for k in tried for m in _compiled(self.rules[k].pattern).finditer(flat)]
        if not found:
            return []
        blanks = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)  # the one before word i is blanks[i]
        ends = np.searchsorted(blanks, np.array([f[:2] for f in found]))
        return [(a, b, k) for (a, b), (_, _, k) in zip(ends.tolist(), found)]

    def kept(self, spans: list[tuple[int, int, int]]) -> list[bool]:
        """Whether each span is contained in none that counts more."""
        rules = self.rules
        order = sorted(range(len(spans)), key=lambda i: (-rules[spans[i][2]].priority, spans[i][0] - spans[i][1], spans[i][2], spans[i][0]))
        starts = {s: i + 1 for i, s in enumerate(sorted({s[0] for s in spans}))}
        tree, out = [0] * (len(starts) + 1), [True] * len(spans)  # prefix maxima of ends
        for i in order:
            start, end, k = spans[i]
            at, most = starts[start], 0
            while at:
                most, at = max(most, tree[at]), at & (at - 1)
            out[i] = rules[k].base or most < end
            at = starts[start]
            while at < len(tree):
                tree[at], at = max(tree[at], end), at + (at & -at)
        return out

    def scan(self, text: str | None) -> dict:
        words = words_of(text)
        spans = self.spans(words)
        found = []
        for (a, b, k), kept in zip(spans, self.kept(spans)):
            r = self.rules[k]
            found.append({"start": a, "end": b, "label": r.label, "rule": k, "priority": r.priority, "confidence": r.confidence, "base": r.base, "kept": kept})
        return {"n_words": len(words), "found": sorted(found, key=lambda f: (f["start"], f["end"], f["rule"]))}


def scan(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id, n_words, found (start, end, label, rule, priority, confidence, base, kept: word
    intervals, end exclusive, suppressed ones too), one row per row of ``docs``."""
    prepare(docs.sparkSession)
    scanner = Scanner(list(rules))

    @F.arrow_udf(KIND)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([scanner.scan(t) for t in batch.to_pylist()], _KIND)

    return texts(docs).select("doc_id", of("text").alias("_s")).select("doc_id", "_s.n_words", "_s.found")


def _labels(found: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda f: f["label"]))), ",")


def summary(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_kept, n_suppressed.

    ``score``: the chance that some kept label is right, if each label's best detection errs on its own."""
    base, kept = F.filter("found", lambda f: f["base"]), F.filter("found", lambda f: f["kept"])
    starts = F.transform(base, lambda f: f["start"])
    label = F.array_distinct(F.transform(kept, lambda f: f["label"]))
    best = F.transform(label, lambda name: F.array_max(F.transform(F.filter(kept, lambda f: f["label"] == name), lambda f: f["confidence"])))
    wrong = F.aggregate(best, F.lit(1.0), lambda a, c: a * (F.lit(1.0) - c))
    size = lambda found: F.size(found).cast("long")
    return scan(docs, rules).select(
        "doc_id", "n_words", size(base).alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        _labels(base).alias("base_labels"), _labels(kept).alias("labels"), (F.lit(1.0) - wrong).alias("score"),
        size(kept).alias("n_kept"), (size("found") - size(kept)).alias("n_suppressed"),
    )
