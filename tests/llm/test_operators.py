"""Corpus operators against brute force, round trips and held-out accuracy on small tables."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evispark.llm import exact_dedup, langid, mixing, packing, pii, sharding, simhash, token_files, toxicity, vectors
from evispark.llm.chunks import ChunkEncoder
from evispark.llm.common import components, id_part
from evispark.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None, None), (2, "", "en"), (3, "   \t\n", "en"), (4, "Same text here, twice over.", "en"), (5, "Same text here, twice over.", None),
    (5, "Same text here, twice over.", "en"), (None, "No id at all, it has none.", "fr"), (7, "word " * 9000, "en"), (8, "ＦＵＬＬ é é <|endoftext|> ½", "de"),
    (9, "x@y.co +1 (743) 555-3824 4111 1111 1111 1111 1.2.3.4", "en"), (10, "a b c", "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, "s", "clash", "clash", 0) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _b string, kept string, _n int")


def test_chunk_encoder_matches_library(docs):
    encoder = ChunkEncoder.at(tokenizer())
    texts = [r[0] for r in docs.select("text").limit(60).collect()] + [r[1] or "" for r in ODD]
    for t in texts:
        want = np.array(encoder.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert b"".join(encoder.batch([t])[0]) == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" .,!?;:'\n\tab1é<|>")), max_size=60))
def test_chunk_encoder_property(text):
    encoder = ChunkEncoder.at(tokenizer())
    want = np.array(encoder.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert b"".join(encoder.batch([text])[0]) == want


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_token_files_round_trip(spark, request, odd, which):
    table = odd.limit(0) if which == "empty" else request.getfixturevalue(which)
    folder = token_files.write_token_files(table, tokenizer())
    got = token_files.read_token_files(spark, folder).orderBy("start").collect()
    library, start, want = ChunkEncoder.at(tokenizer()).library, 0, []
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    for doc_id, text in table.select("doc_id", "text").collect():
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        want.append((doc_id, len(ids) // 4, zlib.crc32(ids)))
    assert sorted([(r[0], r[2], r[3]) for r in got], key=repr) == sorted(want, key=repr)
    ids = [r[0] for r in got if r[0] is not None]
    assert ids == sorted(ids)


def test_lookup_opens_few_shards(spark, docs, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_DOCS", 20)
    folder = token_files.write_token_files(docs, tokenizer())
    ids = [r[0] for r in docs.select("doc_id").orderBy("doc_id").limit(60).collect()][::25]
    got = {r["doc_id"]: r["ids"] for r in token_files.lookup(spark, folder, ids).collect()}
    library = ChunkEncoder.at(tokenizer()).library
    for doc_id, text in docs.where(F.col("doc_id").isin(ids)).select("doc_id", "text").collect():
        assert got[doc_id] == library.encode(text or "", add_special_tokens=False).ids + [1]
    assert token_files.lookup(spark, folder, []).count() == 0 and len(got) == len(ids)


def test_token_file_damage_is_seen(spark, docs, tmp_path):
    folder = token_files.write_token_files(docs.limit(5), tokenizer(), str(tmp_path / "t"))
    name = token_files.manifest(spark, folder).first()["name"]
    shard = token_files.Shard.open(folder, name)
    assert len(shard.find(int(shard.doc_ids[0]))) == 1
    raw = bytearray((tmp_path / "t" / name).read_bytes())
    raw[int(shard.offsets[0]) + 12] ^= 0xFF
    (tmp_path / "t" / name).write_bytes(raw)
    with pytest.raises(Exception):  # noqa: B017
        token_files.Shard.open(folder, name).document(0)


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_packing_is_whole(request, odd, which):
    table = odd.limit(0) if which == "empty" else request.getfixturevalue(which)
    got = packing.pack(table, tokenizer()).toPandas()
    library = ChunkEncoder.at(tokenizer()).library
    want = sorted((len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in table.select("doc_id", "text").collect()))
    assert got.length.sum() == sum(want)
    pieces = {}
    for r in got.itertuples():
        pieces.setdefault(r.sequence_id, []).append(r)
    whole = []
    for doc_id, text in table.select("doc_id", "text").collect():
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        whole.append((doc_id, ids))
    found = sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got.itertuples()), key=repr)
    if which == "docs":  # unique ids: every piece is what the library's ids say
        by_id = dict(whole)
        for doc_id, start, length, crc, total in found:
            ids = by_id[doc_id]
            assert total == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes())
        for doc_id, ids in whole:
            mine = sorted((s, n) for d, s, n, _, _ in found if d == doc_id)
            assert [s for s, _ in mine] == [0, *np.cumsum([n for _, n in mine])[:-1].tolist()] and sum(n for _, n in mine) == len(ids)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= 2048 and (g.offset.values == np.cumsum(g.length.values) - g.length.values).all()


def test_best_cuts_are_optimal():
    rng = np.random.default_rng(3)
    for _ in range(20):
        pos = np.concatenate([[0], np.cumsum(rng.integers(1, 40, 25))])
        penalty = np.concatenate([[0], rng.choice([0, 4, 24], 25)])
        best = [0.0] + [np.inf] * 25
        for j in range(1, 26):
            for i in range(j):
                n = pos[j] - pos[i]
                if n <= 64:
                    pad = 0 if n & (n - 1) == 0 else 64 - n
                    best[j] = min(best[j], best[i] + pad + packing.SEQUENCE_COST + penalty[j])
        cost, i = 0, 0
        for j in packing.best_cuts(pos, penalty, 64):
            n = pos[j] - pos[i]
            cost += (0 if n & (n - 1) == 0 else 64 - n) + packing.SEQUENCE_COST + penalty[j]
            i = j
        assert cost == best[25]


def test_language_held_out(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(table, id_part(F.col("doc_id"), 4) != 2, per_lang=40).select("*", "language.*").where(id_part(F.col("doc_id"), 4) == 2)
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 200 and right > 0.97


def test_language_letters_long_words_and_names(spark):
    rows = [(1, "① ② ½ ٣", "en"), (2, "the cat " * 50, "en"), (3, "le chat " * 50, "fr"), (4, "xx" * 15 + "lechatlechat" * 400, None), (5, "ª", None)]
    table = spark.createDataFrame(rows * 3, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(table.withColumns({"_lid": F.lit(7), "a.b": F.lit("x"), "score": F.lit("own")}), F.lit(True)).select("doc_id", "_lid", "`a.b`", "language.*").collect()}
    assert got[1]["lang_pred"] == langid.UND and got[1]["_lid"] == 7 and isinstance(got[1]["score"], float)
    assert got[2]["lang_pred"] == "en" and got[3]["lang_pred"] == "fr" and got[5]["lang_pred"] != langid.UND
    cut = langid.pieces(rows[3][1] + " é" + "ü" * 30)
    assert max(len(c.decode()) for c in cut) == langid.WIDTH and "".join(c.decode() for c in cut) == rows[3][1] + "é" + "ü" * 30


def test_language_messages_cross_chain_borders(spark):
    rng = np.random.default_rng(3)
    table = [("en", " ".join(rng.choice(["the", "cat", "sat", "on"], 60))) for _ in range(20)] + [("fr", " ".join(rng.choice(["le", "chat", "sur", "la"], 60))) for _ in range(20)]
    model = langid.train(table, rounds=10)
    words = rng.choice(["the", "cat", "le", "chat", "zzz", "qqq"], 2600).tolist()
    post = langid.Emissions(model).label([" ".join(words), "le chat", "", "the " * 30])
    emit = model.emissions(words).astype(float)[None]
    whole, _, _ = langid.forward_backward(emit, np.array([2600]), model.trans, model.start)
    assert np.abs(post[0] - whole[0]).max() < 1e-3 and [len(p) for p in post] == [2600, 2, 0, 30]


def test_language_odd(odd):
    got = {(r["doc_id"], r["text"]): r for r in langid.identify(odd, F.lit(True)).select("*", "language.*").collect()}
    assert got[(1, None)]["lang_pred"] == langid.UND and got[(3, "   \t\n")]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in langid.identify(odd, F.lit(False)).select("language.lang_pred").collect()} == {langid.UND}


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(1)
    emit, trans, start = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    post, _, z = langid.forward_backward(emit, np.array([4]), trans, start)
    total, marginal = 0.0, np.zeros((4, 3))
    for y in np.ndindex(3, 3, 3, 3):
        w = np.exp(start[y[0]] + sum(emit[0, t, y[t]] for t in range(4)) + sum(trans[y[t], y[t + 1]] for t in range(3)))
        total += w
        for t in range(4):
            marginal[t, y[t]] += w
    assert np.allclose(post[0], marginal / total) and np.isclose(z[0], np.log(total))


def brute_dedup(rows):
    groups: dict[str, list] = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub("[ \t-\r]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0))
    return list(((None if n else i), len(v), hashlib.sha256(k.encode()).hexdigest(), (None if min(v)[1] else min(v)[2])) for k, v in groups.items() for _, n, i in v)


@pytest.mark.parametrize("which,block", [("docs", 4096), ("docs", 64), ("odd", 16), ("empty", 64)])
def test_exact_dedup(request, odd, which, block):
    table = odd.limit(0) if which == "empty" else request.getfixturevalue(which)
    got = exact_dedup.duplicates(table, block).collect()
    want = brute_dedup(table.select("doc_id", "text").collect())
    assert sorted(((r[0], r[2], r[4], r[1]) for r in got), key=repr) == sorted(want, key=repr)
    assert sum(r["kept"] for r in got) == len({r["text_sha256"] for r in got})


def test_exact_dedup_common_blocks(spark):
    table = spark.createDataFrame([(i, "same words" if i % 3 else f"other {i}") for i in range(900)], "doc_id long, text string")
    got = exact_dedup.duplicates(table, 4).collect()
    assert sum(r["kept"] for r in got) == 301 and max(r["group_size"] for r in got) == 600


def brute_simhash(prints: list[tuple[int, int]], radius: int) -> dict[int, int]:
    up = list(range(len(prints)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= radius:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(prints):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return {doc_id: least[find(i)] for i, (doc_id, _) in enumerate(prints)}


@pytest.mark.parametrize("shard", [2048, 3])
def test_simhash(docs, shard):
    got = simhash.near_duplicates(docs, shard=shard).collect()
    want = brute_simhash([(r[0], int(r[1], 16)) for r in got], 4)
    assert {r[0]: r[2] for r in got} == want


def plain_fingerprint(text, shingle):
    """Bit by bit, with the library's hash of whole strings."""
    import xxhash

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    joined = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in joined]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_fingerprints_bit_by_bit(docs):
    for (text,) in docs.select("text").limit(40).collect() + [("Ａ É a\u00a0b\u2003c d e F",), ("one two",), (None,), (" \x0b ",)]:
        for shingle in (4, 5):
            assert simhash.fingerprint(text, shingle) == plain_fingerprint(text, shingle)


def test_simhash_planted(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 62, 60)]
    fps = base + [b ^ (1 << int(rng.integers(0, 60))) ^ (1 << int(rng.integers(0, 60))) for b in base]
    points = spark.createDataFrame([(f,) for f in fps], "fp long").distinct()
    for n in (100, 1 << 22, 1 << 34):  # every choice of blocks finds the same links
        roots = {r[0]: r[1] for r in components(simhash.links(points, n, 4, 16)).collect()}
        for a, b in zip(base, fps[60:]):
            assert a == b or roots[a] == roots[b]


def plain_wide(text, shingle, words):
    """The further words bit by bit, in Python's integers."""
    import xxhash

    tokens = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not tokens:
        return 0
    found, full = 0, 2**64 - 1
    for word in range(words):
        hashes = []
        for i in range(max(1, len(tokens) - shingle + 1)):
            z = xxhash.xxh64(" ".join(tokens[i : i + shingle]), seed=42).intdigest()
            if word:
                z = (z + word * 0x9E3779B97F4A7C15) & full
                z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & full
                z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & full
                z ^= z >> 31
            hashes.append(z)
        found |= sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)) << (64 * word)
    return found


def altered(text, rng, similarity):
    """``text`` with words replaced until the Jaccard similarity of its five-word shingles is as given."""
    words = text.split()
    whole = set(zip(*(words[i:] for i in range(5))))
    for at in rng.permutation(len(words)):
        words[at] = f"x{rng.integers(1 << 30)}"
        now = set(zip(*(words[i:] for i in range(5))))
        if len(whole & now) / len(whole | now) <= similarity:
            break
    return " ".join(words)


@pytest.mark.parametrize("shard", [2048, 3])
def test_wide_simhash(spark, docs, shard):
    """Components, by brute force, of all pairs that are near; and their recall."""
    rng, words, radius = np.random.default_rng(11), 4, 42
    texts = [r[0] for r in docs.where("length(text) between 600 and 4000").select("text").orderBy("doc_id").distinct().limit(60).collect()]
    rows = [(i, t) for i, t in enumerate(texts + [altered(t, rng, 0.9) for t in texts])] + [(500, None), (501, " "), (None, ""), (502, texts[0]), (None, "one two"), (None, None)]
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, fp int, w0 int")
    got = simhash.near_duplicates(table, 5, radius, shard, words).collect()
    assert len(got) == len(rows) and {len(r[1]) for r in got} == {16 * words}
    prints = {i: int(f, 16) for i, f, _ in got if i is not None}
    texts_of = dict(rows)
    for i in (0, 1, 60, 500):
        assert prints[i] == plain_wide(texts_of[i], 5, words) == simhash.fingerprint(texts_of[i], 5, words)
    ids = sorted(prints)
    up = {i: i for i in ids}
    for _ in ids:
        for i in ids:
            for j in ids:
                x = prints[i] ^ prints[j]
                if x.bit_count() <= radius:
                    up[i] = up[j] = min(up[i], up[j])
    assert {i: c for i, _, c in got if i is not None} == up
    assert np.mean([up[60 + i] == up[i] for i in range(60)]) >= 0.9 and up[501] == 500 and up[502] == 0
    kept = simhash.representatives(table, 5, radius, shard, words)
    assert kept.columns == table.columns and kept.count() == len({f if i is None else up[i] for i, f, _ in got} - {"0" * 64})
    assert simhash.representatives(table.limit(0), 5, radius, shard, words).count() == 0


def test_keys_for_find_as_many_at_every_size():
    for n in (10, 1 << 27, 1 << 30, 1 << 37):
        keys = simhash.keys_for(n, 4)
        size = len(keys[0])
        same = (1 - np.arccos(1.6 / 1.8) / np.pi) ** (8 * size)
        assert 1 - (1 - same) ** len(keys) >= 0.9 and len({frozenset(k) for k in keys}) == len(keys)
        assert all(len(set(k)) == size and max(k) < 32 for k in keys) and n / 256**size <= 2**11


def test_simhash_odd(odd):
    got = simhash.near_duplicates(odd)
    zero = got.where("doc_id in (1, 2, 3)").collect()
    assert {r["fingerprint"] for r in zero} == {"0" * 16} and {r["component_id"] for r in zero} == {1}
    assert got.count() == len(ODD) and simhash.near_duplicates(odd.limit(0)).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 32))
    x = np.concatenate([base, base[:120] + rng.normal(size=(120, 32)) * 0.12, base[:5], base[:5] * 3])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9000, None), (9001, [0.0] * 32), (9002, [float("nan")] * 32), (9003, [1.0, 2.0]), (9004, [2.0, 4.0])]
    got = {r[0]: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cell_rows=40, cell=64).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(1) - 1
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.97 * want.sum()
    assert [got[i]["n_links"] for i in (9000, 9001, 9002, 9003, 9004)] == [0, 0, 0, 1, 1]
    assert got[9004]["component_id"] == 9003 and not got[9004]["kept"] and got[9000]["kept"]


@pytest.mark.parametrize("most_cells", [2048, 4])
def test_vectors_levels(spark, most_cells):
    """One and two levels of cells; the links counted by brute force."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(900, 48))
    x = np.concatenate([base, base[:300] + rng.normal(size=(300, 48)) * 0.1]).astype(np.float32)
    rows = [(i, [float(v) for v in r], "clash", 1) for i, r in enumerate(x)] + [(None, [float(v) for v in x[0]], "", 2), (7, [float(v) for v in x[7]], "", 3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cls string, n int")
    got = vectors.near_duplicates(table, cell_rows=20, cell=64, most_cells=most_cells).collect()
    u = np.concatenate([x, x[[0, 7]]]).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(1) - 1
    links = {r["vec_id"]: r["n_links"] for r in got if r["vec_id"] is not None}
    assert len(got) == len(rows) and all(links[i] <= want[i] for i in range(len(x)))
    assert sum(links[i] for i in range(len(x))) >= 0.97 * want[: len(x)].sum()
    mine = [r for r in got if r["vec_id"] is None]
    assert mine[0]["component_id"] == 0 and not mine[0]["kept"] and sum(r["vec_id"] == 7 and r["kept"] for r in got) == 2
    assert vectors.near_duplicates(table.limit(0)).count() == 0


def test_vectors_common_and_useless(spark, monkeypatch):
    monkeypatch.setattr(vectors, "HOT_LEAST", 10)
    rows = [(i, [1.0, 2.0]) for i in range(60)] + [(100 + i, [0.0, 0.0]) for i in range(60)] + [(200 + i, [-1.0, float(i)]) for i in range(5)] + [(300, None), (301, [None, 1.0])]
    got = {r["vec_id"]: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[i]["n_links"] == 59 and got[i]["component_id"] == 0 for i in range(60))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in [*range(100, 160), 300, 301]) and len(got) == len(rows)


def test_vectors_of_any_magnitude(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e200, 1.0001e200]), (2, [1e-200, 1e-200]), (3, [1.0, 0.001]), (4, [5e-324, 0.0]), (5, [1e308, -1e308]), (6, [-1.7e308, 1.7e308])]
    got = {r["vec_id"]: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (0, 6)}


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = (
                kind == "email"
                or (kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")))
                or (kind == "card" and 16 <= len(digits) <= 19 and pii.luhn(digits))
                or (kind == "phone" and 8 <= len(digits) <= 15)
            )
            if fine:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a_.@-+ ()0123459%é", max_size=60))
def test_base_spans_property(text):
    assert pii.matches(text)[0] == brute_spans(text)


def test_personal_data(docs, odd):
    for table in (docs, odd):
        got = pii.detect(table).collect()
        want = sorted((r[0], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(r[1] or "")).encode()).hexdigest()) for r in table.where("doc_id is not null").select("doc_id", "text").collect())
        assert sorted((r["doc_id"], r["base_sha256"]) for r in got if r["doc_id"] is not None) == want
    assert pii.detect(odd.limit(0)).count() == 0


@pytest.mark.parametrize("n", [300, 6000])
def test_personal_data_repeated_spans(spark, n):
    """However often a doubtful span repeats, it is judged by its posterior alone."""
    rows = [(i if i % 2 else None, "order serial 112 555 1234 now") for i in range(n)] + [(-1, "call me: 212-555-0187 or +1 212 555 0187")]
    got = pii.detect(spark.createDataFrame(rows, "doc_id long, text string"), sample=100)
    assert got.where("doc_id IS NULL OR doc_id >= 0").agg(F.sum("n_added")).first()[0] == 0


def test_personal_data_many_spans_in_one_text():
    import time

    text = "212-555-0187 " * 20_000
    began = time.time()
    assert len(pii._spans(text)) == 20_000 and time.time() - began < 5


def test_every_pattern_is_sampled(spark):
    rows = [(0, 5, [i, i + 1]) for i in range(4000)] + [(3, 7, [9, 9])] * 50
    lists = spark.createDataFrame(rows, "kind int, pattern int, features array<int>").groupBy("kind", "pattern", "features").agg(F.count(F.lit(1)).alias("n"))
    counts = lists.groupBy("kind", "pattern").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("lists")).collect()
    got = pii._sampled(lists, counts, {(0, 5): 0.9, (3, 7): 0.1}, 200)
    assert sum(p == 0.1 for _, p in got) == 1 and 200 <= sum(p == 0.9 for _, p in got) <= 200 + pii.LEAST_OF_EACH


def test_ftrl_against_a_plain_loop():
    rng = np.random.default_rng(1)
    fit, z, n = toxicity.Ftrl(slots=8, alpha=0.5, beta=1.0, l1=0.7, l2=0.1), [0.0] * 9, [0.0] * 9
    for _ in range(200):
        at, label = np.append(np.sort(rng.choice(8, 3, replace=False)), 8), int(rng.integers(2))
        w = {}
        for i in at.tolist():  # McMahan et al., algorithm 1; the last slot is the bias, without L1
            l1 = 0.0 if i == 8 else 0.7
            w[i] = 0.0 if abs(z[i]) <= l1 else -(z[i] - (l1 if z[i] > 0 else -l1)) / ((1.0 + n[i] ** 0.5) / 0.5 + 0.1)
        p = 1 / (1 + np.exp(-sum(w.values())))
        for i in at.tolist():
            g = p - label
            sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.5
            z[i] += g - sigma * w[i]
            n[i] += g * g
        assert np.isclose(fit.step(at, label), p)
    assert np.allclose(fit.z, z) and np.allclose(fit.n, n)


def test_toxicity_of_one_class_and_repeated_labels(spark, odd):
    labels = spark.createDataFrame([(4, 1), (4, 0), (4, None), (9, 1), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score(odd, labels, F.lit(True)).collect()
    assert all(r["predicted"] == 1 and r["score"] > 0.5 for r in got) and len(got) == len(ODD)


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    few = table.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = toxicity.score(few, labels, id_part(F.col("doc_id"), 5) != 0, per_class=700).where(id_part(F.col("doc_id"), 5) == 0).join(labels, "doc_id")
    hit, false = got.agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))), F.avg(F.when(F.col("toxic") == 0, F.col("predicted")))).first()
    assert hit > 0.7 and false < 0.03


def test_toxicity_odd(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(odd, none, F.lit(True)).collect()
    assert len(got) == len(ODD) and all(r["predicted"] == 0 for r in got)


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_sharding(request, odd, which):
    table = odd.limit(0) if which == "empty" else request.getfixturevalue(which)
    got = sharding.shard(table).toPandas()
    want = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for (t,) in table.select("text").collect())
    assert sorted(zip(got["size"], got.text_crc32)) == want
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


@pytest.mark.parametrize("part", [10_000, 7])
def test_rows_that_repeat_are_dealt_out(spark, monkeypatch, part):
    monkeypatch.setattr(sharding, "PART", part)
    rows = [(1, "same " * 200)] * 2000 + [(None, "none")] * 300 + [(i, f"text {i}") for i in range(500)] + [(7, "text 7")] * 3
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(got) == len(rows) and len(sizes) == 24 and sizes.max() - sizes.min() <= 2 * 1008
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    once = sharding.shard(spark.createDataFrame(rows[2300:2800], "doc_id long, text string")).toPandas().set_index("doc_id").virtual_slot
    for doc_id, g in got[got["size"] < 20].groupby("doc_id"):
        assert once[doc_id] in set(g.virtual_slot)


def test_shards_are_near_equal_and_edits_are_versions(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sharding.shard(table, folder=str(tmp_path)).groupBy("shard").agg(F.sum("size").alias("bytes")).toPandas()
    most = table.agg(F.max(F.octet_length("text"))).first()[0] + 8
    assert len(got) == 24 and got.bytes.max() - got.bytes.min() <= most
    assert sharding.latest_version(spark, str(tmp_path)) == 2
    again = sharding.shard(table, folder=str(tmp_path))
    assert again.agg(F.max("map_version")).first()[0] == 2  # in balance: no edit
    old = {r["slot"]: r["shard"] for r in sharding.load_map(spark, str(tmp_path), 2).collect()}
    more = sharding.shard(table.unionByName(table.where("doc_id < 20")), folder=str(tmp_path))
    assert more.agg(F.max("map_version")).first()[0] == 3
    new = {r["slot"]: r["shard"] for r in sharding.load_map(spark, str(tmp_path), 3).collect()}
    assert 0 < sum(old[s] != new[s] for s in old) < len(old) / 10


def test_map_edits():
    sizes = {s: 100 + s % 7 for s in range(600)}
    first = sharding.rebalanced(sharding.first_map(600, 24), sizes, 24)
    grown = sharding.rebalanced(first, sizes, 25)
    moved = [a for a, b in zip(first, grown) if a != b]
    assert all(b == 24 for a, b in zip(first, grown) if a != b) and len(moved) <= 600 // 24
    assert sharding.rebalanced(first, sizes, 24) == first


def fitted(p, t, share, wanted, rounds=4000):
    """The same problem by plain projected gradient, to the end."""
    rate = np.ones(len(t))
    for _ in range(rounds):
        now = (p * (t * rate)[:, None]).sum(0) / t.sum()
        rate = np.where(t > 0, np.maximum(0, rate - p @ ((now - wanted) / share)), 1)
    return rate, (p * (t * rate)[:, None]).sum(0) / t.sum()


def test_mixing(spark, docs, odd):
    got = mixing.rates(docs).toPandas()
    assert (got.rate >= 0).all() and len(got) == docs.count() and got.target_met.all()
    model = mixing.train(docs)
    table = mixing.memberships(docs, model).toPandas()
    p, t = np.stack(table.posterior), table.tokens.values.astype(float)
    share = (p * t[:, None]).sum(0) / t.sum()
    wanted = share**mixing.TEMPER * max(share / share**mixing.TEMPER)
    rate, now = fitted(p, t, share, wanted)
    assert np.abs(now / wanted - 1).max() < 1e-6 and np.abs(np.sort(rate) - np.sort(got.rate)).max() < 0.02
    assert mixing.mix(odd).columns == odd.columns and mixing.rates(odd.limit(0)).count() == 0
    mixed = mixing.mix(docs).groupBy("doc_id").count().collect()
    assert {r[0]: r[1] for r in mixed} == {r.doc_id: r.copies for r in got.itertuples() if r.copies}


def test_mixing_posteriors_word_by_word(docs, odd):
    for table in (docs.limit(30), odd):
        model = mixing.train(table)
        words = [(r["text"], np.array(r["posterior"]), r["tokens"]) for r in mixing.memberships(table, model, "text").collect()]
        hashes = {r[0]: r[1] for r in table.select(F.explode(mixing.split_words(F.col("text"))).alias("w")).select("w", mixing.bucket_of(F.col("w"))).distinct().collect()}
        for text, posterior, tokens in words:
            found = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
            n = max(1.0, len(found) / mixing.EVIDENCE)
            logits = np.array([q + sum(row[hashes[w]] for w in found) / 1e6 / n for q, row in zip(model.prior, model.table)])
            e = np.exp(logits - logits.max())
            assert tokens == len(found) and np.allclose(posterior, e / e.sum())


@pytest.mark.parametrize("targets", [{"en": 0.25, "de": 0.25, "es": 0.25, "fr": 0.25}, {"en": 0.9, "de": 0.02}, {"en": 0.0}])
def test_mixing_meets_given_targets(spark, targets):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.rates(table, targets=targets).toPandas()
    each, total = got.groupby("domain").first(), got.tokens.sum()
    for d, wanted in targets.items():
        if d in each.index:
            assert abs(each.achieved_tokens[d] - wanted * total) <= 1.001 * mixing.TOLERANCE * wanted * total + 1e-3 * total * (wanted == 0)


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000, i) for i in range(1001, 1200)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    seen = {n: n for e in edges for n in e}
    for _ in range(300):
        for a, b in edges:
            seen[a] = seen[b] = min(seen[a], seen[b])
    assert got == {n: r for n, r in seen.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_columns_of_the_result_may_be_there_already(spark, odd):
    """Columns that clash with those of the result, and dotted names, change nothing."""
    labels = spark.createDataFrame([(4, 1), (9, 0), (10, 0)], "doc_id long, toxic int")
    for of, names in ((pii.detect, ["spans", "n_email", "base_sha256"]), (lambda t: toxicity.score(t, labels, F.lit(True)), ["score", "predicted", "toxic"])):
        clash = odd.withColumns({name: F.lit("own") for name in [*names, "a.b"]})
        assert sorted(map(repr, of(clash).collect())) == sorted(map(repr, of(odd).collect()))
