"""The sentence that a citation shows: noise lines go, then the first usable sentence of the rest.

The tests count words, capitals and letters of each line and sentence, for which Python is used;
whole texts are read, only the chosen sentence is clipped."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CLIP = 420
CAPITALS = 0.62

_LINK = re.compile(r"\[([^\]]+)\]\(([^)]+)\)")
_ADDRESS = re.compile(r"https?://\S+", re.I)
_MARKUP = str.maketrans(dict.fromkeys("`|*#[]()", " "))
_BULLET = re.compile(r"^\s*[-*+]\s+")
_OTHER = re.compile(r"[^\t\n\r\x20-\x7E]")
_VERB = re.compile(
    r"\b(is|are|was|were|has|have|had|includes?|provides?|requires?|reviewed?|documented?|tracked?|offers?|"
    r"follows?|maintains?|receives?|using|use|supports?)\b",
    re.I,
)
_MENU = ("getting started", "benefits", "how we work", "our rituals", "internal systems", "readme", "table of contents")
_NAV = ("getting started", "benefits", "how we work", "making a career", "our rituals", "internal systems", "code of conduct", "state leave provisions")


def cleaned(text: str) -> str:
    """Links to their labels; addresses, markup and all but printable ASCII dropped, blanks collapsed."""
    text = _LINK.sub(lambda m: m[1].strip(), text)
    text = _BULLET.sub("", _ADDRESS.sub(" ", text).translate(_MARKUP))
    return " ".join(_OTHER.sub("", text).split())


def _shouts(words: list[str], text: str) -> bool:
    return sum(w[:1].isupper() for w in words) / len(words) >= CAPITALS and not _VERB.search(text)


def noise_line(raw: str, clean: str) -> bool:
    """Addresses, link lists, rules, paths, menus, titles and lines of under six words."""
    low, words = raw.lower(), clean.split()
    if sum(map(str.isalpha, clean)) < 8 or len(words) < 6:
        return True
    if any(x in low for x in ("http://", "https://", ".md", "](", "-----")) or raw.count("[") >= 2 or raw.count("*") >= 4:
        return True
    if sum(x in low for x in ("/", "\\", "github.com", "blob/")) >= 2:
        return True
    return "." not in clean and any(x in clean.lower() for x in _MENU) or _shouts(words, clean)


def _closed(text: str) -> str:
    text = text[:CLIP].rstrip() if len(text) > CLIP else text
    return text if text[-1] in ".!?" else text + "."


def first_usable(text: str) -> str | None:
    """The first sentence of eight words or more that is no menu, rule or title; else all of the text
    if it has eight words and is no menu."""
    text = cleaned(text)
    menu = lambda s: sum(x in s.lower() for x in _NAV) >= 2 and not _VERB.search(s)
    for s in re.split(r"(?<=[.!?])\s+", text):
        words = s.split()
        if len(words) < 8 or not any(map(str.isalpha, s)) or "-----" in s or menu(s) or _shouts(words, s):
            continue
        if re.search(r"\bM\d\b", s) and not _VERB.search(s):
            continue
        return _closed(s)
    return _closed(text) if len(text.split()) >= 8 and not menu(text) else None


def snippet_of(text: str | None) -> str | None:
    lines = [(x, cleaned(x)) for x in re.split(r"\r?\n", text or "") if x.strip()]
    kept = [c for raw, c in lines if not noise_line(raw, c)]
    return first_usable(" ".join(kept) if kept else text or "")


@F.arrow_udf(StringType())
def snippet(texts: pa.Array) -> pa.Array:
    return pa.array([snippet_of(t) for t in texts.to_pylist()], pa.string())
