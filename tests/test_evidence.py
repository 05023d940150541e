"""Rubric matching and passages against plain Python on small inputs."""

import re

from pyspark.sql import functions as F

from evispark.functions import passage as P
from evispark.operators import evidence as E

CHUNKS = [
    ("c1", "Managers track overtime weekly. Leave requests were tracked too.\n\nThe hotline is open all day."),
    ("c2", "We set our cookie preferences here, and overtime leave."),
    ("c3", "Privacy policy and personal information of staff. Overtime."),
    ("c4", "Nothing of note."),
    ("c5", "Over time, leave! Requests pile up; overtimes grow"),
    ("c6", None),
]
ITEMS = [("a", 0, "overtime leave requests"), ("a", 1, "hotline"), ("b", 0, "manager tracks overtime"), ("c", 0, "open the day")]


def stem_hit(term: str, text: str) -> bool:
    return bool(re.search(rf"\b{term}\b", text) or len(term) >= 5 and re.search(rf"\b{term[:-1]}[a-z]{{0,6}}\b", text))


def plain(text: str, queries: list[str], signals: E.Signals):
    low = text.lower()
    count = lambda ps: sum(bool(re.search(p, low)) for p in ps)
    if count(signals.irrelevant) or count(signals.legal) >= 2 and not count(signals.domain):
        return None
    windows = [w.lower() for w in [*re.split(r"\n\s*\n", text), *re.split(r"(?<=[.!?])\s+", text)] if w.strip()]
    terms, phrases, every = set(), 0, []
    for q in queries:
        tokens = re.findall("[a-z0-9]+", q.lower())
        core = [t for t in tokens if len(t) >= 3 and t not in signals.noise]
        every += core
        seen = lambda ts: bool(re.search(r"\b" + r"[\W_]+".join(ts) + r"\b", low))
        phrase = seen(tokens) or any(seen(core[i : i + 2]) for i in range(len(core) - 1))
        window = any(sum(stem_hit(t, w) for t in set(core)) >= 2 for w in windows)
        if phrase or window:
            terms |= {t for t in core if stem_hit(t, low)}
            phrases += phrase
    if not terms:
        return None
    anchors = [t for t in dict.fromkeys(every) if len(t) >= 4 and t not in signals.generic][:6]
    n = sum(bool(re.search(rf"\b{a}\b", low)) for a in anchors)
    lines = [x for x in text.split("\n") if x.strip()]
    nav = round(sum(len(x.split()) <= 4 for x in lines) / len(lines) - sum(any(c in x for c in ".:;!?") for x in lines) / len(lines), 3)
    bonus = 1.35 + 0.22 * min(n, 3) if count(signals.process) and n else 0
    return round(2.1 * len(terms) + 0.72 * phrases + 0.25 * count(signals.domain) - 0.14 * count(signals.legal) - 0.18 * max(0, nav) + bonus, 4), sorted(terms)


def test_score_of_every_pair(spark):
    signals = E.Signals()
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, text string")
    items = spark.createDataFrame(ITEMS, "item_id string, q int, query string")
    got = {(r["chunk_id"], r["item_id"]): (r["score"], r["terms"]) for r in E.matches(chunks, items, signals).collect()}
    want = {}
    for c, text in CHUNKS:
        for i in {i for i, _, _ in ITEMS}:
            if text and (found := plain(text, [q for k, _, q in ITEMS if k == i], signals)):
                want[(c, i)] = found
    assert got == want and len(want) >= 4
    assert E.matches(chunks.limit(0), items).count() == 0 and E.matches(chunks, items.limit(0)).count() == 0


def test_best_rows_are_told_apart_by_what_they_show(spark):
    rows = [("i", c, s, t) for c, s, t in [("a", 3.0, "x"), ("a", 2.0, "x"), ("b", 3.0, "x"), ("c", 1.0, "y")]]
    found = spark.createDataFrame(rows, "item string, chunk string, score double, snippet string")
    got = E.best(found, ["item"], 2, [F.desc("score"), F.asc("chunk")], ["chunk", "snippet"]).orderBy("rank").collect()
    assert [(r["chunk"], r["score"], r["rank"]) for r in got] == [("a", 3.0, 1), ("b", 3.0, 2)]


def test_passages(spark):
    doc = "Intro line.\n\nThe leave policy was revised in March by the team. It now covers part-time staff as well, from the first day on.\n\nEnd."
    whole = "The leave policy was revised in March by the team. It now covers part-time staff as well, from the first day on."
    lead = "Heading:\n\nThis sentence names overtime in a long enough line of plain words for the reader to follow, " + "and more " * 6
    far = "x " * 700 + "\n\n" + whole + "\n\n" + "y " * 700
    cases = [
        ("x", doc, 13, 60, ["leave"], whole), ("Short one.", None, None, None, ["one"], "Short one."), (None, None, None, None, None, ""),
        (lead, None, None, None, ["overtime"], " ".join(lead.split()[1:])), (far[1300:1500], far, 1300, 1500, ["nothing", "LEAVE".lower()], whole),
        ("word " * 400, None, None, None, [], ("word " * 180).rstrip() + "..."), ("é leave", "é leave", 0, 7, ["leave"], "é leave"),
        # the paragraph is too short, so the sentence goes on over the line
        ("Leave is due.", "Leave is due to every one of us\n\nfrom the day on which all of the papers were signed by both sides.", 0, 13, ["leave"], "Leave is due."),
    ]
    rows = spark.createDataFrame([(k, *c[:5]) for k, c in enumerate(cases)], "k int, text string, document string, start int, end int, terms array<string>")
    got = {r["k"]: r["snippet"] for r in P.best(rows).collect()}
    assert [got[k] for k in range(len(cases))] == [c[5] for c in cases]
    at = spark.createDataFrame([("One. Two! Three", 6), ("a\n\nbc\n\nd", 4), ("line\nnext", 5), ("end\n", 4)], "t string, at int")
    assert [tuple(r) for r in at.select(P.sentence_at(F.col("t"), F.col("at")), P.paragraph_at(F.col("t"), F.col("at"))).collect()] == [(" Two!", "One. Two! Three"), ("bc\n", "bc"), ("next", "line\nnext"), ("", "end\n")]
    like = spark.createDataFrame([("and so it is with us all",), ("One two three four five six.",), ("One two three four five six:",), ("One two three",)], "t string")
    assert [r[0] for r in like.select(P.reads_like_a_sentence(F.col("t"))).collect()] == [False, True, False, False]


def plain_snippet(text, doc, start, end, terms, most=900):
    """The rules in plain Python."""
    flat = lambda s: " ".join(s.split())
    clip = lambda s: s if len(s) <= most else s[:most].rstrip() + "..."
    words = lambda s: re.findall("[a-z0-9']+", s.lower())
    context = lambda s: len(s) >= 80 and (len(re.findall(r"[.!?](?:\s|$)", s)) >= 2 or len(words(s)) >= 22)

    def like(s):
        w = words(s)
        return len(w) >= 6 and not (w[0] in ("and", "or", "but", "to", "with", "without") and len(w) < 14) and not s.endswith(":") and (s[-1] in ".!?" or len(w) >= 12)

    def bounds(s, at):
        ends = [i for c in ".!?\n" if (i := s.find(c, at)) >= 0]
        return max(s.rfind(c, 0, at) for c in ".!?\n") + 1, min(ends) + 1 if ends else len(s)

    begin = max(0, start - 900)
    near = doc[begin : end + 900]
    if near.strip():
        at = next((m.start() for t in terms if (m := re.search(rf"\b{t}\b", near, re.I))), min(len(near) - 1, start - begin))
        a = near.rfind("\n\n", 0, at)
        b = near.find("\n\n", at)
        paragraph = flat(near[a + 2 if a >= 0 else 0 : b if b >= 0 else len(near)])
        if context(paragraph):
            return clip(paragraph)
        a, b = bounds(near, at)
        own, after = flat(near[a:b]), flat(near[slice(*bounds(near, min(len(near) - 1, b)))])
        both = f"{own} {after}"
        sentence = both if own and after and after != own and len(both) <= most and like(both) else own
        if context(sentence):
            return clip(sentence)
    paragraphs = [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()] or [flat(text)]
    for own, after in zip(paragraphs, [*paragraphs[1:], None]):
        if not terms or any(re.search(rf"\b{t}\b", own, re.I) for t in terms):
            for p in (flat(own), flat(f"{own} {after}") if after is not None else ""):
                if context(p):
                    return clip(p)
    sentences = [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]
    for own, after in zip(sentences, [*sentences[1:], None]):
        if like(flat(own)):
            both = flat(f"{own} {after}") if after is not None else ""
            p = both if both and len(both) <= most and like(both) else flat(own)
            if context(p):
                return clip(p)
    return clip(flat(" ".join(paragraphs[:2]) if text.strip() else ""))


def test_passages_like_plain_rules(spark):
    """Random texts of short words, marks and breaks; chunks anywhere in them."""
    import random

    rng = random.Random(4)
    rows = []
    for k in range(400):
        words = [rng.choice(["leave", "team", "and", "to", "Policy", "x1", "day", "é"]) + rng.choice(["", "", "", "", ".", "!", ":", "\n", "\n\n", "\n \n"]) for _ in range(rng.choice([3, 30, 200, 900]))]
        doc = " ".join(words)
        start = rng.randrange(len(doc))
        end = min(len(doc), start + rng.choice([20, 200, 1500]))
        rows.append((k, doc[start:end], doc, start, end, rng.choice([["leave"], ["zzz", "policy"], ["zzz"], []])))
    got = {r["k"]: r["snippet"] for r in P.best(spark.createDataFrame(rows, "k int, text string, document string, start int, end int, terms array<string>")).collect()}
    for k, *case in rows:
        assert got[k] == plain_snippet(*case), case
