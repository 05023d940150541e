"""Soft-membership mixing of documents to target token weights (DataFrame operations only).

A naive-Bayes table learned from labelled rows (hashed words by domain) gives every document a
posterior over domains. Document rates r >= 0 (expected copies), from 1 on, then minimise by
projected gradient steps

    sum_k w_k (sum_d r_d a_kd - b_k)^2

where a_kd is document d's tokens times its posterior of domain k as a share of all tokens, b_k the
target share and w_k one over domain k's share today. A step in the metric that weighs documents by
their tokens is r_d <- max(0, r_d - sum_k p_kd e_k), e_k the domain's error as a part of its share: the
weighted Gram matrix has rows that add up to 1, so the step needs no search. A rate depends on the
other documents only through those errors (one number per domain), so a step is one aggregation that
returns K numbers, and each task replays the short list of them to get its rates: nothing is rewritten
between steps, and nothing but K numbers reaches the driver. Steps end when every domain's total is
within ``TOLERANCE`` of its target, or after ``STEPS``; ``met`` says for each domain whether it is.

Words are exploded and their table entries (whole millionths, so that sums are the same in any order)
added up by row number, with partial aggregation: a text of any length is a stream of words, and no
lambda runs over it once per domain. Tokens are white-space words: the native form can't run a
tokenizer.

Defined results: null and empty texts have no tokens, the prior as posterior and rate 1; rows that
repeat are weighed each; a null label isn't learned from; with no labelled row at all there is
nothing to balance and every rate is 1; a target for a domain without tokens can't be met; other
columns are kept (``mix``) or ignored (``rates``).
"""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, columns_of, hash_share, written

BUCKETS = 4096
PER_DOMAIN = 2_000
STEPS = 60
TOLERANCE = 1e-3
#: Words of evidence that a posterior rests on at most: keeps memberships soft.
EVIDENCE = 24.0
#: Targets are the shares raised to this power: rarer domains are raised.
TEMPER = 0.8
#: A row's own label is taken to be right with this probability, where labels count as evidence.
TRUST = 0.9999


def split_words(text: Column) -> Column:
    """White-space chunks; an empty text, and blanks at the ends, give empty ones."""
    return F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), SPACES + "+")


def bucket_of(word: Column) -> Column:
    """Index of a word in the table; null for an empty chunk."""
    return F.when(word != "", F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int"))


def constant(value: list, kind: str) -> Column:
    """One literal, however long: the parse is folded when the query is planned."""
    return F.from_json(F.lit(json.dumps(value)), kind)


class Classifier:
    """log p(bucket | domain), in millionths, and log p(domain): BUCKETS numbers a domain."""

    def __init__(self, domains: list[str], prior: list[float], table: list[list[int]]):
        self.domains, self.prior, self.table = domains, prior, table

    def entries(self, spark: SparkSession) -> DataFrame:
        """A row for each bucket: _b, and its entry of every domain (_w0, ...). As literals these numbers would be in every
        text of a plan that the driver keeps."""
        columns = {"_b": pa.array(range(BUCKETS), pa.int32())}
        return spark.createDataFrame(pa.table(columns | {f"_w{j}": pa.array(row, pa.int64()) for j, row in enumerate(self.table)}))

    def logits(self, evidence: list[Column], tokens: Column, label: Column | None = None) -> Column:
        """array<double> in the order of ``domains`` from the summed table entries of a row's words;
        a ``label`` that is no domain counts for none."""
        if not self.domains:
            return F.array().cast("array<double>")
        n = F.greatest(F.lit(1.0), tokens / F.lit(EVIDENCE)) * F.lit(1e6)
        out = [F.lit(p) + F.coalesce(e, F.lit(0)) / n for p, e in zip(self.prior, evidence)]
        if label is not None:
            right, wrong = math.log(TRUST), math.log((1 - TRUST) / max(1, len(self.domains) - 1))
            known = label.isin(self.domains)
            out = [x + F.when(label == d, right).when(known, wrong).otherwise(0.0) for x, d in zip(out, self.domains)]
        return F.array(*out)


def normalise(logits: Column) -> Column:
    shifted = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, y: a + y))


def train(docs: DataFrame, label: str = "lang", per_domain: int = PER_DOMAIN) -> Classifier:
    """Fit the table on at most ``per_domain`` ids of each label, the ones with the least hash."""
    known = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    known = known.select("doc_id", F.col(label).cast("string").alias("domain"), "text")
    counts = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}  # a row a domain
    if not counts:
        return Classifier([], [], [])
    domains, total = sorted(counts), sum(counts.values())
    # Only ids below a hash bound that leaves about four times as many as wanted are ranked.
    bound = F.create_map(*[F.lit(x) for d in domains for x in (d, min(1.0, 4 * per_domain / counts[d]))])[F.col("domain")]
    ids = known.where(hash_share(bound, "doc_id")).select("domain", "doc_id").distinct()
    first = W.partitionBy("domain").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = ids.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= per_domain).drop("_k")
    fit = known.join(F.broadcast(ids), ["domain", "doc_id"])  # per_domain ids a domain at most
    found = fit.select("domain", F.explode(split_words(F.col("text"))).alias("word"))
    found = found.groupBy("domain", bucket_of(F.col("word")).alias("bucket")).count().where("bucket IS NOT NULL")
    table = {d: [1.0] * BUCKETS for d in domains}
    for r in found.collect():  # BUCKETS rows a domain at most
        table[r["domain"]][r["bucket"]] += r["count"]
    log = []
    for d in domains:
        size = sum(table[d])
        log.append([round(1e6 * math.log(x / size)) for x in table[d]])
    return Classifier(domains, [math.log(counts[d] / total) for d in domains], log)


def memberships(docs: DataFrame, model: Classifier, *keep: str, label: str | None = None) -> DataFrame:
    """tokens and posterior of every row, with ``keep``; the column ``label`` is evidence beside the text."""
    own = [] if label is None else [F.col(label).cast("string").alias("_own")]
    rows = docs.select(*keep, *own, F.monotonically_increasing_id().alias("_row"), F.col("text").alias("_text"))
    words = rows.withColumn("_word", F.explode(split_words(F.col("_text")))).drop("_text")
    words = words.withColumn("_b", bucket_of(F.col("_word"))).drop("_word")
    if model.domains:
        words = words.join(F.broadcast(model.entries(docs.sparkSession)), "_b", "left")
    sums = [F.sum(f"_w{j}").alias(f"_e{j}") for j in range(len(model.table))]
    key = [*keep, *(["_own"] if own else []), "_row"]
    got = words.groupBy(*key).agg(F.count("_b").alias("tokens"), *sums)
    logits = model.logits([F.col(f"_e{j}") for j in range(len(model.table))], F.col("tokens"), F.col("_own") if own else None)
    return got.select(*keep, "tokens", logits.alias("_l")).select(*keep, "tokens", normalise(F.col("_l")).alias("posterior"))


def replay(posterior: Column, tokens: Column, errors: list[list[float]]) -> Column:
    """The rate of a row after the steps that ``errors`` describe; 1 without tokens."""
    if not errors:
        return F.lit(1.0)

    def step(rate: Column, error: Column) -> Column:
        pull = F.aggregate(F.zip_with(posterior, error, lambda p, e: p * e), F.lit(0.0), lambda a, x: a + x)
        return F.greatest(F.lit(0.0), rate - pull)

    return F.when(tokens > 0, F.aggregate(constant(errors, "array<array<double>>"), F.lit(1.0), step)).otherwise(1.0)


class Fit:
    """What ``fit_rates`` found: the classifier, the errors to replay, and of every domain the share
    of all ``total`` tokens that it has, that is wanted and that the rates achieve."""

    def __init__(self, model: Classifier, shares: list[float], targets: list[float], total: float = 0.0):
        self.model, self.shares, self.targets, self.total = model, shares, targets, total
        self.achieved, self.errors = list(shares), []

    def rate(self, posterior: Column, tokens: Column) -> Column:
        return replay(posterior, tokens, self.errors)

    def met(self) -> list[bool]:
        return [abs(a - b) <= TOLERANCE * b for a, b in zip(self.achieved, self.targets)]


def fit_rates(table: DataFrame, model: Classifier, targets: dict[str, float] | None = None, steps: int = STEPS, level: bool = False) -> Fit:
    """Projected-gradient least squares over ``table`` (tokens, posterior).

    ``targets``: token share wanted of each domain, in units of today's tokens (they may add up to
    more than 1; a domain that isn't named keeps its share). Default: shares ** TEMPER, scaled so that
    no domain shrinks or, with ``level``, to add up to 1, which lowers the domains that have most.
    """
    k = len(model.domains)

    def totals(rate: Column) -> list[float]:
        sums = [F.sum(F.col("tokens") * F.col("_r") * F.get("posterior", F.lit(j))).alias(f"m{j}") for j in range(k)]
        row = table.select("tokens", "posterior", rate.alias("_r")).agg(F.sum("tokens").alias("all"), *sums).first()
        return [float(x or 0) for x in row]

    total, *share = totals(F.lit(1.0)) if k else [0.0]
    if not total:
        return Fit(model, [0.0] * k, [0.0] * k)
    share = [m / total for m in share]
    if targets is None:
        wanted = [s**TEMPER for s in share]
        scale = 1.0 / sum(wanted) if level else max(s / w for s, w in zip(share, wanted) if w)
        wanted = [scale * w for w in wanted]
    else:
        wanted = [targets.get(d, s) for d, s in zip(model.domains, share)]
    fit = Fit(model, share, wanted, total)
    reachable = [j for j in range(k) if share[j] > 1e-12]
    while len(fit.errors) < steps and not all(fit.met()[j] for j in reachable):
        fit.errors.append([round((fit.achieved[j] - wanted[j]) / share[j], 12) if share[j] > 1e-12 else 0.0 for j in range(k)])
        fit.achieved = [m / total for m in totals(fit.rate(F.col("posterior"), F.col("tokens")))[1:]]
    return fit


def copies(rate: Column, *key: Column) -> Column:
    """A whole number of copies with the rate as expectation, decided by a hash of ``key``."""
    rate = F.when(F.abs(rate - 1) < 0.005, F.lit(1.0)).otherwise(rate)  # rates a hair from 1 lose no rows
    uniform = F.pmod(F.xxhash64(F.lit("copies"), *key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + (uniform < rate - F.floor(rate)).cast("long")).cast("long")


def rates(
    docs: DataFrame, label: str = "lang", targets: dict[str, float] | None = None, steps: int = STEPS,
    level: bool = False, own: bool = False,
) -> DataFrame:
    """doc_id, source, tokens, domain (likeliest), membership (its posterior), rate and copies, and of
    the row's domain the tokens that the table has, that are wanted and that the rates achieve, and
    whether that is within TOLERANCE (``target_met``).

    ``own``: a row's label is evidence of its domain beside the text."""
    model = train(docs, label)
    totals = ["domain_tokens", "target_tokens", "achieved_tokens"]
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text", *([label] if label not in ("doc_id", "source", "text") else []))
    table = written(memberships(keyed, model, "doc_id", "source", label=label if own and model.domains else None), "memberships")
    if not model.domains:
        return table.select(
            "doc_id", "source", "tokens", F.lit(None).cast("string").alias("domain"), F.lit(1.0).alias("membership"), F.lit(1.0).alias("rate"), F.lit(1).cast("long").alias("copies"),
            *[F.lit(None).cast("double").alias(c) for c in totals], F.lit(None).cast("boolean").alias("target_met"),
        )
    fit = fit_rates(table, model, targets, steps, level)
    best = F.array_max("posterior")
    at = (F.array_position("posterior", best) - 1).cast("int")
    got = table.withColumn("rate", F.round(fit.rate(F.col("posterior"), F.col("tokens")), 9))
    return got.select(
        "doc_id",
        "source",
        "tokens",
        F.get(F.array(*map(F.lit, model.domains)), at).alias("domain"),
        F.round(best, 9).alias("membership"),
        "rate",
        copies(F.col("rate"), F.col("doc_id")).alias("copies"),
        *[F.get(F.array(*[F.lit(round(fit.total * x, 3)) for x in shares]), at).alias(c) for c, shares in zip(totals, (fit.shares, fit.targets, fit.achieved))],
        F.get(F.array(*map(F.lit, fit.met())), at).alias("target_met"),
    )


#: Names that no table of documents has.
_KEY, _COPIES, _EACH = "__mixing_key__", "__mixing_copies__", "__mixing_each__"


def mix(
    docs: DataFrame, label: str = "lang", targets: dict[str, float] | None = None, level: bool = False, own: bool = False,
) -> DataFrame:
    """The rows of ``docs``, each as many times as its copies say; its columns are unchanged.

    Copies are a function of doc_id and text (and of the label, with ``own``), so they are written as a
    table of those that differ from one copy and joined back.
    """
    model = train(docs, label)
    if not model.domains:
        return docs
    key = F.xxhash64("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")), *([F.col(label).cast("string")] if own else []))
    table = written(memberships(docs.withColumn(_KEY, key), model, "doc_id", _KEY, label=label if own else None), "memberships")
    fit = fit_rates(table, model, targets, level=level)
    rate = F.round(fit.rate(F.col("posterior"), F.col("tokens")), 9)
    counts = written(table.select(_KEY, copies(rate, F.col("doc_id")).alias(_COPIES)), "copies")
    other = counts.where(F.col(_COPIES) != 1).dropDuplicates([_KEY])
    seen = docs.withColumn(_KEY, key).join(other, _KEY, "left")
    times = F.array_repeat(F.lit(1), F.coalesce(_COPIES, F.lit(1)).cast("int"))
    return seen.withColumn(_EACH, F.explode(times)).select(*columns_of(docs))


#: The dealt mix: every source is a domain and its targets are level.
BY_SOURCE = {"label": "source", "level": True, "own": True}
