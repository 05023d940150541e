"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct slots (of ``SLOTS``) of its words, its word pairs and its pairs
with one word between. FTRL-proximal keeps per-coordinate accumulators z and n; a weight is
non-zero only where |z| exceeds the L1 strength, so the model that is sent to the tasks is a short
list of slots and weights, at most ``SLOTS`` long.

Training passes over a bounded sample of labelled rows: at most ``per_class`` of each class, of at
most ``train_chars`` characters, those with the least hash. Scores read every whole text.

Defined results: null and empty texts have no features and score the bias; a document with several
labels is toxic if one of them is; null labels are ignored; with no labels, or of one class only,
scores are 0.5 less a hair (nothing is toxic) or that class's share; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hash_share, held, prepare

SLOTS = 1 << 20
PER_CLASS = 3_000
TRAIN_CHARS = 20_000
ALPHA, BETA, L1, L2 = 1.0, 1.0, 5.0, 0.0
PASSES = 6
MEMO = 600_000

_EDGES = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class Slots:
    """Hashed features of texts, with a memo of word hashes."""

    def __init__(self) -> None:
        self.memo: dict[bytes, int] = {}

    def hashes(self, texts: list[str | None]) -> list[np.ndarray]:
        import xxhash

        if len(self.memo) > MEMO:
            self.memo.clear()
        split = [(t or "").lower().encode().split() for t in texts]
        memo = self.memo
        for c in set().union(*split).difference(memo):
            word = c.strip(_EDGES)
            memo[c] = xxhash.xxh3_64_intdigest(word) | 1 if word else 0
        get = memo.__getitem__
        out = [np.fromiter(map(get, s), np.uint64, len(s)) for s in split]
        return [h[h > 0] for h in out]

    @staticmethod
    def of(h: np.ndarray) -> np.ndarray:
        """Slots of all words, pairs and skip-pairs, repeats included."""
        a, b, c, d = _MIX
        parts = [h * a, h[:-1] * b + h[1:] * c, h[:-2] * c + h[2:] * d]
        x = np.concatenate(parts)
        x ^= x >> np.uint64(29)
        return ((x * b) >> np.uint64(64 - 20)).astype(np.int64)


@dataclass
class Weights:
    slots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    bias: float = 0.0
    name: str = ""


class Ftrl:
    """Per-coordinate FTRL-proximal (McMahan et al., 2013)."""

    def __init__(self, slots: int = SLOTS, alpha=ALPHA, beta=BETA, l1=L1, l2=L2):
        self.z, self.n = np.zeros(slots + 1), np.zeros(slots + 1)  # the last is the bias, without L1
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        pull = np.where(at == len(self.z) - 1, 0.0, self.l1)
        rate = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        return np.where(np.abs(z) <= pull, 0.0, (np.sign(z) * pull - z) / rate)

    def step(self, at: np.ndarray, label: int) -> float:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g
        return p

    def model(self) -> Weights:
        w = self.weights(np.arange(len(self.z)))
        at = np.nonzero(w[:-1])[0]
        return Weights(at.astype(np.int32), w[at].astype(np.float32), float(w[-1]), uuid.uuid4().hex)


def train(rows: list[tuple[int, str]], passes: int = PASSES, seed: int = 7) -> Weights:
    """Fit on (label, text) rows. Both classes are sampled alike, so scores say how much likelier a
    text is under label 1 than its class's rarity would; the bias isn't corrected for that, as a
    corrected one lost a thirtieth of the toxic held-out rows for no fewer false alarms."""
    labels = np.array([r[0] for r in rows])
    ones = int(labels.sum()) if len(rows) else 0
    if not ones or ones == len(rows):
        return Weights(bias=30.0 if ones else -30.0 if len(rows) else -1e-9, name=uuid.uuid4().hex)
    slots, fit, bias = Slots(), Ftrl(), np.array([SLOTS])
    feats = [np.append(np.unique(Slots.of(h)), bias) for h in slots.hashes([r[1] for r in rows])]
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for i in rng.permutation(len(rows)).tolist():
            fit.step(feats[i], int(labels[i]))
    return fit.model()


class Scorer:
    def __init__(self, model: Weights):
        self.slots, self.bias = Slots(), model.bias
        self.dense = np.zeros(SLOTS, np.float32)
        self.dense[model.slots] = model.values

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for i, h in enumerate(self.slots.hashes(texts)):
            at = Slots.of(h)
            at = np.unique(at[self.dense[at] != 0])  # only slots with a weight need be told apart
            out[i] = self.bias + self.dense[at].astype(float).sum()
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def _worker(model: Weights) -> Scorer:
    return held(model.name, lambda: Scorer(model))


def sample(docs: DataFrame, labels: DataFrame, learn_from: Column, per_class: int, train_chars: int):
    """(label, text) rows from labelled rows where ``learn_from`` (of doc_id) holds."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & F.coalesce(learn_from, F.lit(False)))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = [F.xxhash64("doc_id").asc(), F.col("doc_id").asc()]
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    picked = None
    for k in (0, 1):
        part = known.where((F.col("toxic") == k) & hash_share(4 * per_class / max(1, sizes.get(k, 0)), "doc_id"))
        part = part.orderBy(*order).limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    # 2 * per_class ids at most; rows that repeat an id count once.
    fit = docs.where(F.col("text").isNotNull() & (F.length("text") <= train_chars)).select("doc_id", "text")
    rows = fit.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id")
    return [(r[0], r[1]) for r in rows.select("toxic", "text").collect()]


def score(
    docs: DataFrame,
    labels: DataFrame,
    learn_from: Column,
    per_class: int = PER_CLASS,
    train_chars: int = TRAIN_CHARS,
) -> DataFrame:
    """doc_id, ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.5), one row per row of ``docs``."""
    spark = docs.sparkSession
    prepare(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = train(sample(base, labels, learn_from, per_class, train_chars))
    shipped = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def guess(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = _worker(shipped.value)
        for batch in batches:
            yield pa.array(scorer.scores(batch.to_pylist()), pa.float64())

    got = docs.select("doc_id", guess(F.col("text").cast("string")).alias("score"))
    return got.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
