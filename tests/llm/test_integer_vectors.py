"""Vector codes and hard negatives against brute force on whole integers."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evispark.llm import integers, negatives, vector_codes

KIND = "vec_id long, embedding array<double>, label int, q string, row int, error string, anchor string"
CLASH = ("clash", 1, "clash", "clash")


def whole(x, scale, width):
    q = [max(-integers.MOST, min(integers.MOST, math.floor(scale * v) if abs(v) < 1e300 else int(math.copysign(integers.MOST, v)))) for v in x]
    return q + [0] * (width - len(q))


def usable(x):
    return x is not None and all(v is not None and math.isfinite(v) for v in x)


def coded(rows, entries, rounds, scale=1024, parts=4):
    """Every part against every entry, in Python integers."""
    kept = [r for r in rows if usable(r[1])]
    width = -(-max((len(r[1]) for r in kept), default=0) // parts) * parts
    size = width // parts
    vectors = [(r[0], r[2], whole(r[1], scale, width)) for r in kept]
    first = sorted(vectors, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[v[p * size : (p + 1) * size] for _, _, v in first] for p in range(parts)]

    def near(p, v):
        part = v[p * size : (p + 1) * size]
        return min((sum((a - b) ** 2 for a, b in zip(part, c)), k) for k, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            mine = defaultdict(list)
            for _, _, v in vectors:
                mine[near(p, v)[1]].append(v[p * size : (p + 1) * size])
            books[p] = [[sum(c) // len(mine[k]) for c in zip(*mine[k])] if k in mine else c for k, c in enumerate(books[p])]
    found = [(i, label, [near(p, v) for p in range(parts)]) for i, label, v in vectors]
    by_label = defaultdict(int)
    for _, label, n in found:
        by_label[label] += sum(d for d, _ in n)
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in n), sum(d for d, _ in n), by_label[label], digest) for i, label, n in found), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], KIND)


def some_rows(n, dim, seed, levels=5):
    rng = np.random.default_rng(seed)
    return [(int(i), (rng.integers(-levels, levels, dim) / 64).tolist(), int(rng.integers(0, 4))) for i in rng.permutation(n)]


ODD = [
    (3, None, 1), (5, [0.1, None, 0.2, 0.3], 1), (6, [0.1, float("nan"), 0.2, 0.3], 1), (7, [0.1, float("inf"), 0.2, 0.3], 1), (8, [1e300, -1e300, 0.5, 0.25], 2),
    (8, [0.5, 0.5, 0.5, 0.5], None), (8, [0.5, 0.5, 0.5, 0.5], None), (None, [0.25, -0.5, 0.125, 0.0], 3), (9, [0.0, 0.0, 0.0, 0.0], 3), (100, [0.5, 0.25], 3), (200, [], None),
]


@pytest.mark.parametrize("rows, entries", [(some_rows(300, 16, 1), 32), (some_rows(60, 10, 2), 256), (ODD, 4), (ODD + some_rows(50, 8, 3), 16), ([], 8), ([(1, [], None)], 8)])
def test_codes_like_brute_force(spark, rows, entries):
    got = vector_codes.summary(table(spark, rows).repartition(3), entries=entries, rounds=3)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == coded(rows, entries, 3)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(1, 5), st.integers(1, 3), st.integers(1, 9), st.integers(0, 2**31), st.sampled_from([1, 1 << 21]))
def test_tree_search_keeps_lower_index_ties(n, dim, levels, leaf, seed, scale):
    rng = np.random.default_rng(seed)
    entries, rows = scale * rng.integers(-levels, levels + 1, (n, dim)), scale * rng.integers(-levels, levels + 1, (80, dim))
    far = ((rows[:, None] - entries[None]) ** 2).sum(2)
    found = vector_codes.Search(vector_codes.kd_tree(entries, leaf=leaf), entries, rows)
    assert (found.index == far.argmin(1)).all() and (found.best == far.min(1)).all()


def test_the_tree_skips_boxes():
    rng = np.random.default_rng(5)
    entries = np.concatenate([rng.integers(-20, 20, (64, 4)) + c for c in (0, 1000, 5000, 9000)])
    asked = []

    class Counting(vector_codes.Search):
        def visit(self, node, ask):
            asked.append(len(ask) if node.children is None else 0)
            super().visit(node, ask)

    rows = np.repeat(entries, 4, axis=0)
    Counting(vector_codes.kd_tree(entries), entries, rows)
    assert sum(asked) < 0.25 * len(rows) * len(entries) / vector_codes.LEAF


def test_hot_labels_come_back_whole(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "HOT_LEAST", 5)
    rows = [(i, [i / 64, 0.0, 0.5, i % 3 / 8], 1 if i % 3 else None if i % 2 else i) for i in range(80)]
    got = vector_codes.summary(table(spark, rows), entries=8, rounds=2)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == coded(rows, 8, 2)


def mined(rows, k=5, scale=256):
    kept = [r for r in rows if usable(r[1]) and r[2] is not None]
    width = max((len(r[1]) for r in kept), default=0)
    told = [(i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, whole(x, scale, width)) for i, x, label in kept]
    out = []
    for n, (i, label, v) in enumerate(told):
        if i is None or i % 100:
            continue
        scored = sorted(((sum(a * b for a, b in zip(v, w)), j, other, m) for m, (j, other, w) in enumerate(told) if m != n), key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        for score, j, _, _ in [s for s in scored if s[2] == label][:k]:
            near = [s for s in scored if s[2] != label and 80 * score <= 100 * s[0] <= 100 * score][:k]
            out += [(i, j, rank, s[1], score, s[0]) for rank, s in enumerate(near, 1)]
    return sorted(out, key=repr)


def label():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def near_rows(n, dim, seed):
    """Vectors near one another, so that limits hold; with ties and repeated ids."""
    rng = np.random.default_rng(seed)
    rows = [(int(i), (1 + rng.integers(-6, 7, dim) / 64).tolist(), int(rng.integers(0, 3))) for i in range(n)]
    return rows + rows[100:103] + [(7, rows[0][1], 0), (None, rows[100][1], 1), (None, rows[100][1], 2)]


@pytest.mark.parametrize("rows", [near_rows(450, 8, 1), near_rows(230, 3, 2) + ODD, ODD, [], [(100, [0.5, 0.5], 1)], [(i, [-0.5, 0.5 - i / 512], i % 2) for i in range(0, 300, 50)]])
@pytest.mark.parametrize("batch", [8192, 2])
def test_negatives_like_brute_force(spark, rows, batch):
    got = negatives.mine(table(spark, rows).repartition(4), F.col("vec_id") % 100 == 0, label(), batch=batch)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == mined(rows)


def test_limits_are_inclusive():
    falling = np.array([100, 80, 80, 79, 0, -5])
    assert negatives.limits(falling, 100, 80, 100) == (0, 3) and negatives.limits(falling, 99, 80, 100) == (1, 3)
    assert negatives.limits(falling, 0, 80, 100) == (4, 5) and negatives.limits(falling, -5, 80, 100)[0] >= negatives.limits(falling, -5, 80, 100)[1]


def test_products_are_exact_beyond_doubles():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(-integers.MOST, integers.MOST, (5, 4096)) for _ in "ab")
    a[0], b[0] = integers.MOST, integers.MOST - 1
    assert integers.products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
