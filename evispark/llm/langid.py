"""Word-level language labels by a linear-chain conditional random field.

A word is a white-space chunk; a chunk of over ``WIDTH`` code points (text without spaces) is as many
words as it has pieces of that width. A chain is a run of words of one document. The score of a label sequence is the
sum of emission weights (hashed prefixes, suffixes, character 2- and 3-grams and the word itself,
plus lexicon membership per language) and of learned transitions. Training maximises the
conditional likelihood with forward-backward gradients and AdaGrad, on chains of which half are
spliced from texts of different languages, so that transitions learn both staying and switching.
Prediction runs forward-backward over every word of every text; a document's language is the one
with the largest mean posterior over its words, and that mean is the score. A text of over ``LONG``
words is cut into chains that overlap by ``CONTEXT`` words on either side: messages are carried
across a border by words whose own posteriors are taken from the neighbouring chain.

Training reads a bounded sample of labelled rows (``per_lang`` rows of each language of at most
``train_chars`` characters, the ones with the least hash; fewer rows each beyond ``TRAIN_ROWS`` in
all); everything else reads all rows. Languages beyond the ``MOST_LANGS`` commonest are not learned:
the model takes 0.5 MB a language and is sent to every task.

Defined results: a null text, or one without a letter, is ``und`` with score 0; a null lang is not
learned from; with nothing to learn from all documents are ``und``; repeated rows are predicted
each; other columns are kept, but ones named like those that ``identify`` adds are replaced.
"""

from __future__ import annotations

import unicodedata
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hash_share, held, prepare

UND = "und"
CHAIN = 48
WIDTH = 20
BUCKETS = 1 << 17
PER_LANG = 150
TRAIN_CHARS = 20_000
TRAIN_ROWS = 4_800
MOST_LANGS = 256
LEXICON = 2_000
ROUNDS = 30
MEMO = 400_000
#: Words whose features are looked up at once; chain cells that forward-backward takes at once.
BLOCK, CELLS = 8192, 1 << 20
LONG, CONTEXT = 1024, 16

_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def has_letter(text: str) -> bool:
    """A character of Unicode category L."""
    return text.isalpha() or any(map(str.isalpha, text))


def pieces(text: str | None) -> list[bytes]:
    """White-space chunks, the ones of over WIDTH code points cut into pieces."""
    chunks = (text or "").encode().lower().split()
    if max(map(len, chunks), default=0) <= WIDTH:
        return chunks
    out: list[bytes] = []
    for c in chunks:
        if len(c) <= WIDTH or len(word := c.decode("utf-8", "replace")) <= WIDTH:
            out.append(c)
        else:
            out += [word[a : a + WIDTH].encode() for a in range(0, len(word), WIDTH)]
    return out


def word_of(chunk: bytes) -> str:
    """The lower-cased word of a white-space chunk, without ASCII punctuation at its ends; empty if
    it has no letter."""
    word = unicodedata.normalize("NFC", chunk.decode("utf-8", "replace").lower().strip(_EDGES))
    return word if has_letter(word) else ""


def features(words: list[str]) -> np.ndarray:
    """Hashed feature numbers, one row per word; -1 where a word has fewer."""
    chars = np.array(words, f"U{WIDTH}").view("u4").reshape(len(words), WIDTH).astype(np.uint64)
    back = np.array([w[-3:][::-1] for w in words], "U3").view("u4").reshape(len(words), 3).astype(np.uint64)
    whole = np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint64, len(words))

    def mix(kind: int, *parts: np.ndarray) -> np.ndarray:
        h = np.full(parts[0].shape, 0x9E3779B97F4A7C15 * (kind + 1) & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for p in parts:
            h = (h ^ p) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
        return (h % np.uint64(BUCKETS)).astype(np.int64)

    columns = [mix(0, whole)]
    for k in (1, 2, 3):
        for kind, side in ((k, chars), (3 + k, back)):
            columns.append(np.where(side[:, k - 1] > 0, mix(kind, *(side[:, i] for i in range(k))), -1))
    edge = np.concatenate([np.full((len(words), 1), 32, np.uint64), chars], 1)
    for k in (2, 3):
        for at in range(WIDTH + 2 - k):
            if not (last := edge[:, at + k - 1]).any():
                break
            columns.append(np.where(last > 0, mix(6 + k, *(edge[:, at + i] for i in range(k))), -1))
    return np.stack(columns, 1)


@dataclass
class Model:
    """Weights of fixed size: BUCKETS + lexicon slots by languages; safe to ship to every task."""

    langs: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS + 1, 0), np.float32))
    lexicon: dict[str, list[int]] = field(default_factory=dict)  # word -> numbers of languages
    lexical: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    trans: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(0))
    name: str = ""

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.langs)), np.float32)
        for a in range(0, len(words), BLOCK):
            some, rows = words[a : a + BLOCK], out[a : a + BLOCK]
            rows += self.weights[features(some)].sum(1)
            for i, w in enumerate(some):
                if w in self.lexicon:
                    rows[i] += self.lexical[self.lexicon[w]].sum(0)
        return out


def forward_backward(emit: np.ndarray, size: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """Posteriors (chains, time, labels), expected transitions summed over all chains, and the
    log-likelihood normaliser of each chain. ``emit`` is padded; ``size`` has the lengths."""
    n, long, k = emit.shape
    shift = emit.max(2, keepdims=True)
    local, step = np.exp(emit - shift), np.exp(trans)
    alpha, scale = np.empty((n, long, k)), np.ones((n, long))
    live = np.arange(long)[None, :] < size[:, None]
    now = np.exp(start)[None, :] * local[:, 0]
    for t in range(long):
        if t:
            now = (alpha[:, t - 1] @ step) * local[:, t]
        total = now.sum(1)
        now = now / total[:, None]
        if not live[:, t].all():
            now = np.where(live[:, t, None], now, alpha[:, t - 1])
            total = np.where(live[:, t], total, 1.0)
        alpha[:, t], scale[:, t] = now, total
    beta, pairs = np.ones((n, k)), np.zeros((k, k))
    post = np.empty((n, long, k))
    post[:, long - 1] = alpha[:, long - 1]
    for t in range(long - 2, -1, -1):
        next_ = live[:, t + 1, None]
        right = local[:, t + 1] * beta / scale[:, t + 1, None]
        pairs += (alpha[:, t] * next_).T @ right * step
        beta = np.where(next_, right @ step.T, 1.0)
        post[:, t] = alpha[:, t] * beta
    post /= post.sum(2, keepdims=True)
    normaliser = (np.log(scale) * live).sum(1) + (shift[:, :, 0] * live).sum(1)
    return post, pairs, normaliser


def _chains(words: np.ndarray, label: int) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(words[a : a + CHAIN], np.full(min(CHAIN, len(words) - a), label)) for a in range(0, len(words), CHAIN)]


def train(rows: list[tuple[str, str]], rounds: int = ROUNDS, seed: int = 7) -> Model:
    """Fit on (lang, text) rows."""
    langs = sorted({lang for lang, _ in rows})
    k = len(langs)
    if not k:
        return Model([], name=uuid.uuid4().hex)
    vocab: dict[str, int] = {}
    chains, counts = [], [Counter() for _ in langs]
    for lang, text in rows:
        found = [w for w in map(word_of, pieces(text)) if w]
        if found:
            label = langs.index(lang)
            counts[label].update(found)
            chains += _chains(np.array([vocab.setdefault(w, len(vocab)) for w in found]), label)
    if not chains:
        return Model([], name=uuid.uuid4().hex)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(chains))
    for a, b in zip(order[0::4].tolist(), order[1::4].tolist()):  # code-switched chains
        (wa, la), (wb, lb) = chains[a], chains[b]
        cut = int(rng.integers(1, max(2, min(len(wa), len(wb)))))
        chains[a] = np.concatenate([wa[:cut], wb[cut:]]), np.concatenate([la[:cut], lb[cut:]])
        chains[b] = np.concatenate([wb[:cut], wa[cut:]]), np.concatenate([lb[:cut], la[cut:]])
    size = np.array([len(w) for w, _ in chains])
    word, gold = np.zeros((len(chains), size.max()), np.int64), np.zeros((len(chains), size.max()), np.int64)
    for i, (w, y) in enumerate(chains):
        word[i, : len(w)], gold[i, : len(y)] = w, y
    live = np.arange(size.max())[None, :] < size[:, None]

    lexicon: dict[str, list[int]] = {}
    for label, c in enumerate(counts):
        for w, n in c.most_common(LEXICON):
            if n >= 3:
                lexicon.setdefault(w, []).append(label)
    words = list(vocab)
    feats = features(words)
    member = np.zeros((len(words), k))
    for i, w in enumerate(words):
        member[i, lexicon.get(w, [])] = 1
    there = feats >= 0
    flat, owner = feats[there], np.nonzero(there)[0]
    weights, lexical = np.zeros((BUCKETS + 1, k)), np.zeros((k, k))
    trans, start = np.zeros((k, k)), np.zeros(k)
    state = [np.full(x.shape, 1e-2) for x in (weights, lexical, trans, start)]
    true_pairs = np.zeros((k, k))
    inside = live[:, 1:]
    np.add.at(true_pairs, (gold[:, :-1][inside], gold[:, 1:][inside]), 1)
    first = np.bincount(gold[:, 0], minlength=k)
    rows_at_once = max(1, 2 * CELLS // (size.max() * k))
    # Rare languages weigh as much as frequent ones: rows are sampled per language.
    for _ in range(rounds):
        vocab_emit = np.zeros((len(words), k))
        for j in range(k):
            vocab_emit[:, j] = np.bincount(owner, weights[flat, j], len(words))
        vocab_emit += member @ lexical
        by_word, pairs, begins = np.zeros((len(words), k)), np.zeros((k, k)), first.astype(float)
        for a in range(0, len(size), rows_at_once):
            at = slice(a, a + rows_at_once)
            post, some, _ = forward_backward(vocab_emit[word[at]], size[at], trans, start)
            pairs += some
            begins -= post[:, 0].sum(0)
            miss = -post
            np.put_along_axis(miss, gold[at, :, None], np.take_along_axis(miss, gold[at, :, None], 2) + 1, 2)
            by_word += np.stack([np.bincount(word[at][live[at]], miss[live[at]][:, j], len(words)) for j in range(k)], 1)
        grad = np.stack([np.bincount(flat, by_word[owner, j], BUCKETS + 1) for j in range(k)], 1)
        for x, g, s in zip(
            (weights, lexical, trans, start), (grad, member.T @ by_word, true_pairs - pairs, begins), state
        ):
            g = g - 0.01 * x
            s += g * g
            x += 0.3 * g / np.sqrt(s)
    weights[BUCKETS] = 0  # where index -1 points
    return Model(langs, weights.astype(np.float32), lexicon, lexical.astype(np.float32), trans, start, uuid.uuid4().hex)


class Emissions:
    """A worker's memo from chunk to a row of emission scores; row 0 is for chunks without a letter."""

    def __init__(self, model: Model):
        self.model, self.at = model, {}
        self.rows = np.zeros((1, len(model.langs)), np.float32)

    def learn(self, chunks: set[bytes]) -> None:
        if len(self.at) > MEMO:
            self.at.clear()
            self.rows = self.rows[:1].copy()
        new = chunks.difference(self.at)
        if new:
            by_word: dict[str, list[bytes]] = {}
            for c in new:
                by_word.setdefault(word_of(c), []).append(c)
            for c in by_word.pop("", ()):
                self.at[c] = 0
            base = len(self.rows)
            self.rows = np.concatenate([self.rows, self.model.emissions(list(by_word))])
            for i, same in enumerate(by_word.values()):
                for c in same:
                    self.at[c] = base + i

    def label(self, texts: list[str | None]) -> list[np.ndarray]:
        """Posteriors (words, languages) of each text's words that have a letter."""
        split = [pieces(t) for t in texts]
        self.learn(set().union(*split))
        get, k = self.at.__getitem__, len(self.model.langs)
        found = [np.fromiter(map(get, s), np.int64, len(s)) for s in split]
        found = [f[f > 0] for f in found]
        lengths = np.array([len(f) for f in found])
        flat = np.concatenate(found) if found else np.zeros(0, np.int64)
        out = np.empty((len(flat), k))
        own, span = _spans(lengths)
        size = span[:, 1] - span[:, 0]
        for at in _alike(size, CELLS // max(1, k)):
            n = size[at]
            place = span[at, 0][:, None] + np.arange(n.max())
            live = np.arange(n.max()) < n[:, None]
            post, _, _ = forward_backward(self.rows[flat[np.where(live, place, 0)]].astype(float), n, self.model.trans, self.model.start)
            mine = live & (place >= own[at, 0][:, None]) & (place < own[at, 1][:, None])
            out[place[mine]] = post[mine]
        return np.split(out, np.cumsum(lengths)[:-1]) if len(lengths) else []


def _spans(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the words that each chain labels, and of those that it runs over."""
    own, span, begin = [], [], 0
    for n in lengths.tolist():
        for a in range(0, n, LONG):
            b = min(n, a + LONG)
            own.append((begin + a, begin + b))
            span.append((begin + max(0, a - CONTEXT), begin + min(n, b + CONTEXT)))
        begin += n
    return np.array(own, np.int64).reshape(-1, 2), np.array(span, np.int64).reshape(-1, 2)


def _alike(size: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers in groups of similar ``size`` whose padded cells are at most ``most``."""
    order = np.argsort(size, kind="stable")
    cuts, begin = [], 0
    for i, n in enumerate(size[order].tolist()):
        if i > begin and (i - begin + 1) * n > most:
            cuts.append(i)
            begin = i
    return [g for g in np.split(order, cuts) if len(g)]


def _worker(model: Model) -> Emissions:
    return held(model.name, lambda: Emissions(model))


def sample(docs: DataFrame, learn_from: Column, per_lang: int, train_chars: int) -> list[tuple[str, str]]:
    """At most ``per_lang`` labelled whole texts of each of the ``MOST_LANGS`` commonest languages."""
    known = docs.where(F.coalesce(learn_from, F.lit(False)) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    fit = known.where(F.col("text").isNotNull() & (F.length("text") <= train_chars))
    counts = fit.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS).collect()
    if not counts:
        return []
    per_lang = min(per_lang, max(10, TRAIN_ROWS // len(counts)))
    # Only ids below a hash bound that leaves about four times as many as wanted are ranked.
    bound = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 4 * per_lang / r["count"]))])[F.col("lang")]
    near = fit.where(bound.isNotNull() & hash_share(bound, "doc_id"))
    first = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = near.select("lang", "doc_id").distinct()
    ids = ids.select("lang", "doc_id", F.row_number().over(first).alias("_k")).where(F.col("_k") <= per_lang)
    # At most per_lang * MOST_LANGS ids; rows that repeat an id count once.
    ids = F.broadcast(ids.select("lang", "doc_id"))
    return [(r[0], r[1]) for r in fit.join(ids, ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text")).orderBy("lang", "doc_id").select("lang", "text").collect()]


def identify(
    docs: DataFrame,
    learn_from: Column,
    per_lang: int = PER_LANG,
    train_chars: int = TRAIN_CHARS,
    into: str = "language",
) -> DataFrame:
    """``docs`` plus a struct ``into`` (a name that ``docs`` doesn't have) of lang_pred, score, switches
    (label changes between neighbouring words), certainty (mean of each word's largest posterior; null if
    a text with letters meets a model that knows no language) and unlearned (the row has a label, and
    the model doesn't know that language).

    Learns from rows where ``learn_from`` is true. Columns of ``docs`` are unchanged, whatever their names."""
    spark = docs.sparkSession
    prepare(spark)
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
        learn_from.alias("_learn"),
    )
    model = train(sample(base, F.col("_learn"), per_lang, train_chars))
    shipped = spark.sparkContext.broadcast(model)  # BUCKETS x MOST_LANGS floats at most
    kind = "struct<lang_pred:string,score:double,words:long,switches:long,certainty:double>"

    @F.arrow_udf(kind)
    def guess(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shipped.value
        for batch in batches:
            columns = zip(*_predict(model, batch.to_pylist()))
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.StructArray.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["lang_pred", "score", "words", "switches", "certainty"]
            )

    label = F.col("lang").cast("string")
    known = label.isin(model.langs) if model.langs else F.lit(False)
    got = docs.withColumn(into, guess(F.col("text").cast("string")))
    return got.withColumn(into, F.col(into).withField("unlearned", label.isNotNull() & ~known))


def _predict(model: Model, texts: list[str | None]) -> list[tuple[str, float, int, int, float | None]]:
    if not model.langs:
        return [(UND, 0.0, 0, 0, None if has_letter(t or "") else 0.0) for t in texts]
    out = []
    for post in _worker(model).label(texts):
        if not len(post):
            out.append((UND, 0.0, 0, 0, 0.0))
            continue
        mean, labels = post.mean(0), post.argmax(1)
        k = int(mean.argmax())
        out.append((model.langs[k], float(min(1.0, mean[k])), len(post), int((labels[1:] != labels[:-1]).sum()), float(min(1.0, post.max(1).mean()))))
    return out
