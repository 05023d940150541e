"""Personal data by weak supervision.

Candidates are spans of four kinds: the base patterns' matches, and looser forms (phone numbers
without a plus sign, spelled-out e-mail addresses, digit runs of card length that fail their check
digit, dotted quads with parts over 255). Four labelers vote on each (1 personal, -1 not, 0 no
opinion):

* regex: the base pattern's own check (Luhn, parts, digit count);
* gazetteer: known top-level domains, country codes, issuer prefixes, reserved address blocks;
* context: cue words before the span, for and against;
* edges: whether the span stands alone or is glued into something longer.

Expectation-maximisation over the vote patterns (at most 3^4 per kind, counted over all candidates)
estimates each labeler's reliability per kind and the posterior of each pattern. A logistic
regression over hashed span features is then trained with those posteriors as labels; it decides which
candidates are added. It learns from a bounded sample of distinct feature lists: every (kind, vote
pattern) that occurs has its share of ``SAMPLE`` and ``LEAST_OF_EACH`` lists at least, so that neither
spans that repeat nor rare patterns leave a kind untrained. Base matches always stay; an added span
never overlaps one of its kind, and even odds add nothing.

Every pattern runs in linear time: starts inside a run that has failed are never retried.

Defined results: null and empty texts have no spans (the digest of the empty string); rows that
repeat are labelled each; with no candidates nothing is trained; an empty table gives no rows; other
columns are ignored. Offsets count code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import prepare, release, written

KINDS = ["email", "ip", "card", "phone"]
SAMPLE = 6_000
LEAST_OF_EACH = 20
FEATURES = 1 << 14
ACCEPT = 0.5
CONTEXT = 40

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# Possessive where nothing follows: a run of any length keeps no state to go back to.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOOSE_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_SPELLED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,63}"
    r"(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot ) ?[A-Za-z0-9-]{1,63})+"
)

# Gazetteers and cue words.
_TLDS = frozenset("com org net edu gov mil int info biz io ai co me tv app dev de fr es it uk us ca eu ch at be nl pl pt se".split())
_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92")
_ISSUERS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "6011", "65", "35")
_FOR = re.compile(r"\b(?:e-?mail|mail|contact|write|reach|call|tel|phone|fax|mobile|card|visa|credit|ip|host|address|login|from)\b", re.I)
_AGAINST = re.compile(r"\b(?:version|release|token|key|hash|isbn|issn|order|invoice|serial|build|id|sku|section|figure)\b", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            end = found.end()
        at = text.find("@", max(at + 1, end))
    return out


def matches(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, looser candidates), each by kind as listed, then start."""
    base, loose = [], []
    if "@" in text:
        base += [("email", a, b) for a, b in emails(text)]
    if (" dot " in text or "dot)" in text or "dot]" in text or "dot}" in text):
        loose += [("email", m.start(), m.end()) for m in _SPELLED.finditer(text)]
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                (base if all(map(_small, m[0].split("."))) else loose).append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = _only_digits(m[0])
                if 16 <= len(digits) <= 19 and luhn(digits):
                    base.append(("card", m.start(), m.end()))
                elif 13 <= len(digits) <= 19:
                    loose.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_only_digits(m[0])) <= 15:
                    base.append(("phone", m.start(), m.end()))
                else:
                    loose.append(("phone", m.start(), m.end()))
        loose += [("phone", m.start(), m.end()) for m in _LOOSE_PHONE.finditer(text)]
    return base, loose


def votes(text: str, kind: str, start: int, end: int, base: bool) -> tuple[int, int, int, int]:
    span, before = text[start:end], text[max(0, start - CONTEXT) : start]
    digits = _only_digits(span)
    if kind == "email":
        known = span.rpartition(".")[2].strip(" )]}").lower().rpartition(" ")[2] in _TLDS
    elif kind == "ip":
        known = not span.startswith(("0.", "10.", "127.", "192.168.", "255."))
    elif kind == "card":
        known = digits.startswith(_ISSUERS)
    else:
        known = digits.startswith(_CODES) if span[0] == "+" else digits[0] in "23456789"
    cue = (1 if _FOR.search(before) else 0) - (1 if _AGAINST.search(before) else 0)
    left, right = text[start - 1 : start], text[end : end + 1]
    glued = left.isalnum() or right.isalnum() or (left in ".-_/" and left and left != "") or (right in "_/@" and right != "")
    return (1 if base else -1), (1 if known else -1), cue, (-1 if glued else 1)


_DIGITS, _UPPER, _LOWER = re.compile("[0-9]+"), re.compile("[A-Z]+"), re.compile("[a-z]+")


def features(text: str, kind: str, start: int, end: int) -> list[int]:
    """Hashed: shape of the whole span (digit runs with their lengths), length (by powers of two from
    32 on), characters at its edges, words before it."""
    span, size = text[start:end], end - start
    shape = _LOWER.sub("a", _UPPER.sub("A", _DIGITS.sub(lambda m: f"9{len(m[0])}", span)))
    left, right = text[start - 1 : start], text[end : end + 1]
    names = [f"{kind}|{x}" for x in ("", f"s{shape}", f"n{size if size < 32 else 32 + size.bit_length()}", f"l{left if not left.isalnum() else 'x'}", f"r{right if not right.isalnum() else 'x'}", f"d{len(_only_digits(span))}", f"p{span[:2]}")]
    names += [f"{kind}|c{w}" for w in text[max(0, start - CONTEXT) : start].lower().split()[-3:]]
    return [zlib.crc32(n.encode()) % FEATURES for n in names]


SPAN = "struct<kind:int,start:long,end:long,base:boolean,pattern:int,features:array<int>>"


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and its candidate spans; the only pass over the texts."""

    @F.arrow_udf(f"array<{SPAN}>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(
            pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("pattern", pa.int32()), ("features", pa.list_(pa.int32()))])
        )
        for batch in batches:
            yield pa.array([_spans(t or "") for t in batch.to_pylist()], kind)
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), find(F.col("text").cast("string")).alias("spans"))


def _spans(text: str) -> list[dict]:
    base, loose = matches(text)
    taken = {k: [(a, b) for kind, a, b in base if kind == k] for k in KINDS}  # disjoint, by start
    rows = []
    for group, is_base in ((base, True), (loose, False)):
        for kind, a, b in group:
            if not is_base:
                spans, at = taken[kind], bisect_left(taken[kind], (a, b))
                if at < len(spans) and spans[at][0] < b or at and spans[at - 1][1] > a:
                    continue
                spans.insert(at, (a, b))
            v = votes(text, kind, a, b, is_base)
            pattern = sum((x + 1) * 3**i for i, x in enumerate(v))
            rows.append({"kind": KINDS.index(kind), "start": a, "end": b, "base": is_base, "pattern": pattern, "features": features(text, kind, a, b)})
    return rows


def reliabilities(counts: list[tuple[int, int, int]], rounds: int = 50) -> tuple[dict[tuple[int, int], float], np.ndarray]:
    """EM over (kind, pattern, count): posteriors of the patterns, and per kind and labeler the
    probabilities of each vote given personal and given not (kind, labeler, class, vote)."""
    table = np.zeros((len(KINDS), 4, 2, 3))
    post: dict[tuple[int, int], float] = {}
    for k in range(len(KINDS)):
        rows = [(p, n) for kind, p, n in counts if kind == k]
        if not rows:
            continue
        votes_ = np.array([[p // 3**i % 3 for i in range(4)] for p, _ in rows])
        n = np.array([c for _, c in rows], float)
        q = 1 / (1 + np.exp(-(votes_ - 1) @ np.array([2.0, 1.0, 1.0, 1.0])))  # start: weighted majority
        for _ in range(rounds):
            share = np.clip((q * n).sum() / n.sum(), 0.02, 0.98)
            for i in range(4):
                for v in range(3):
                    at = votes_[:, i] == v
                    # A labeler that is right more often than not is the prior.
                    good, bad = (4.0, 1.0) if v == 2 else (1.0, 4.0) if v == 0 else (2.0, 2.0)
                    table[k, i, 1, v] = (q * n)[at].sum() + good
                    table[k, i, 0, v] = ((1 - q) * n)[at].sum() + bad
            table[k] /= table[k].sum(2, keepdims=True)
            logit = np.log(share / (1 - share)) + sum(np.log(table[k, i, 1, votes_[:, i]] / table[k, i, 0, votes_[:, i]]) for i in range(4))
            q = 1 / (1 + np.exp(-np.clip(logit, -35, 35)))
        post.update({(k, p): float(x) for (p, _), x in zip(rows, q)})
    return post, table


def train(sample: list[tuple[list[int], float]], rounds: int = 30, seed: int = 7) -> np.ndarray:
    """Logistic regression with AdaGrad on (features, probability) rows."""
    weights, seen = np.zeros(FEATURES), np.full(FEATURES, 1e-2)
    rng = np.random.default_rng(seed)
    rows = [(np.unique(f), p) for f, p in sample]
    for _ in range(min(rounds, max(3, 60_000 // max(1, len(rows))))):
        for i in rng.permutation(len(rows)).tolist():
            at, p = rows[i]
            g = 1 / (1 + np.exp(-np.clip(weights[at].sum(), -35, 35))) - p + 1e-4 * weights[at]
            seen[at] += g * g
            weights[at] -= 0.2 * g / np.sqrt(seen[at])
    return weights


def _sampled(lists: DataFrame, counts: list, post: dict[tuple[int, int], float], sample: int) -> list[tuple[list[int], float]]:
    """(features, posterior): of each (kind, pattern) the lists with the least hash, as many as its
    quota. Only lists below a hash bound that leaves about four quotas are ranked."""
    total = sum(r["lists"] for r in counts)
    if not total:
        return []
    quota = {(r["kind"], r["pattern"]): LEAST_OF_EACH + sample * r["lists"] // total for r in counts}
    bounds = [(r["kind"], r["pattern"], q, min(1.0, 4 * q / r["lists"])) for r in counts for q in [quota[(r["kind"], r["pattern"])]]]
    bounds = lists.sparkSession.createDataFrame(bounds, "kind int, pattern int, quota long, share double")
    place = F.xxhash64("features")
    near = lists.join(F.broadcast(bounds), ["kind", "pattern"])  # 4 * 81 rows at most
    near = near.where(F.pmod(place, F.lit(1 << 30)) <= F.col("share") * (1 << 30))
    rank = F.row_number().over(W.partitionBy("kind", "pattern").orderBy(place, "features"))
    few = near.withColumn("rank", rank).where("rank <= quota").orderBy("kind", "pattern", "rank")
    return [(r[0], post[(r[1], r[2])]) for r in few.select("features", "kind", "pattern").collect()]


def detect(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans as text."""
    prepare(docs.sparkSession)
    found = written(candidates(docs), "spans")
    spans = found.select(F.explode("spans").alias("s")).select("s.kind", "s.pattern", "s.features")
    lists = written(spans.groupBy("kind", "pattern", "features").agg(F.count(F.lit(1)).alias("n")), "lists")
    counts = lists.groupBy("kind", "pattern").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("lists")).collect()
    post, _ = reliabilities([(r["kind"], r["pattern"], r["n"]) for r in counts])  # 4 * 81 rows at most
    weights = found.sparkSession.sparkContext.broadcast(train(_sampled(lists, counts, post, sample)))  # FEATURES numbers

    kind = "struct<n:array<long>,sha:string,spans:string,added:long>"

    @F.arrow_udf(kind)
    def decide(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = weights.value
        of = pa.struct([("n", pa.list_(pa.int64())), ("sha", pa.string()), ("spans", pa.string()), ("added", pa.int64())])
        for batch in batches:
            yield pa.array([_decided(s, w) for s in batch.to_pylist()], of)

    got = found.select("doc_id", decide("spans").alias("r"))
    n = [F.col("r.n").getItem(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return got.select("doc_id", *n, F.col("r.sha").alias("base_sha256"), F.col("r.spans").alias("spans"), F.col("r.added").alias("n_added"))


def _decided(spans: list[dict], weights: np.ndarray) -> dict:
    base = [s for s in spans if s["base"]]
    more = [s for s in spans if not s["base"] and 1 / (1 + np.exp(-weights[np.unique(s["features"])].sum())) > ACCEPT]

    def text(rows: list[dict]) -> str:
        rows = sorted(rows, key=lambda s: (s["kind"], s["start"], s["end"]))
        return ",".join(f"{KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in rows)

    return {
        "n": [sum(s["kind"] == k for s in base) for k in range(len(KINDS))],
        "sha": hashlib.sha256(text(base).encode()).hexdigest(),
        "spans": text(base + more),
        "added": len(more),
    }
