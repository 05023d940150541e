"""HTML column functions in pattern form, and a parser-based text extractor for irregular pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from evispark import lexicon as L
from evispark.functions.text import collapse

_SKIP = frozenset("script style noscript nav header footer form aside svg".split())
_BREAK = frozenset("p div li h1 h2 h3 h4 h5 h6 td th tr br section article pre".split())
_NOISE = ("nav", "menu", "footer", "header", "sidebar", "cookie", "breadcrumb", "social", "promo", "subscribe", "banner")


def without(html: Column, *tags: str) -> Column:
    for tag in tags:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    return html


def visible(html: Column) -> Column:
    """Text outside tags, without scripts and styles."""
    return collapse(F.regexp_replace(without(html, "script", "style"), r"<[^>]+>", " "))


def title(html: Column) -> Column:
    return collapse(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def blocks(html: Column, tags: str = "p|li|h1|h2|h3|h4|td|th|pre") -> Column:
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<(?:{tags})(?: [^>]*)?>(.*?)</(?:{tags})>"), F.lit(1))
    return F.filter(F.transform(found, lambda b: collapse(F.regexp_replace(b, r"<[^>]+>", " "))), lambda b: b != "")


def links(html: Column) -> Column:
    """array<struct<href, anchor>> in page order."""
    pattern = r'(?is)<a [^>]*href="([^"#]*)[^"]*"[^>]*>(.*?)</a>'
    href = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    anchor = F.regexp_extract_all(html, F.lit(pattern), F.lit(2))
    return F.zip_with(href, anchor, lambda h, a: F.struct(h.alias("href"), collapse(F.regexp_replace(a, r"<[^>]+>", " ")).alias("anchor")))


#: Parts of an address and words of a page that mark a handbook or wiki.
WIKI_PATHS = ["handbook", "wiki", "policy", "policies", "docs", "knowledge-base", "kb"]
WIKI_WORDS = ["table of contents", "job families", "handbook"]
WIKI_LEAST, DENSE_LEAST = 200, 400


def wiki_text(html: Column) -> Column:
    """Headings as '## ', items as '- ' and other text blocks, a line each, in page order."""
    plain = without(html, "script", "style", "noscript", "nav", "footer", "aside", "form", "svg")
    pattern = r"(?is)<(h[1-4]|p|li|th|td|pre|code)(?: [^>]*)?>(.*?)</\1>"
    kinds, inside = F.regexp_extract_all(plain, F.lit(pattern), F.lit(1)), F.regexp_extract_all(plain, F.lit(pattern), F.lit(2))

    def line(kind: Column, body: Column) -> Column:
        text = collapse(F.regexp_replace(body, r"<[^>]+>", " "))
        mark = F.when(F.lower(kind).rlike("^h"), "## ").when(F.lower(kind) == "li", "- ").otherwise("")
        return F.when(text != "", F.concat(mark, text))

    return F.array_join(F.filter(F.zip_with(kinds, inside, line), lambda x: x.isNotNull()), "\n")


def dense_text(html: Column) -> Column:
    """The text blocks that are mostly text: 25 characters, and less than half of them in links."""
    plain = without(html, "script", "style", "noscript", "nav", "header", "footer", "aside", "form", "svg")
    found = F.regexp_extract_all(plain, F.lit(r"(?is)<(?:p|pre|td|h1|h2|h3|li)(?: [^>]*)?>(.*?)</(?:p|pre|td|h1|h2|h3|li)>"), F.lit(1))

    def parts(body: Column) -> Column:
        text = collapse(F.regexp_replace(body, r"<[^>]+>", " "))
        linked = collapse(F.regexp_replace(F.regexp_replace(body, r"(?is)<a [^>]*>(.*?)</a>", "\u0001$1\u0002"), r"(?s)(?:^|\x02)[^\x01]*(?:\x01|$)", " "))
        return F.struct(text.alias("text"), F.length(linked).alias("linked"))

    kept = F.filter(F.transform(found, parts), lambda b: (F.length(b["text"]) >= 25) & (2 * b["linked"] < F.length(b["text"])))
    return F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n")


def is_wiki(url: Column, html: Column, paths: list[str] = WIKI_PATHS, words: list[str] = WIKI_WORDS) -> Column:
    return F.lower(path(url)).rlike("|".join(paths)) | F.lower(html).rlike("|".join(words))


def extract_mode(wiki: Column, wiki_chars: Column, dense_chars: Column) -> Column:
    """Which text of a page counts, by how long its forms are."""
    return F.when(wiki & (wiki_chars >= WIKI_LEAST), "policy_wiki").when(dense_chars >= DENSE_LEAST, "readability").otherwise("fallback")


def mean_line(text: Column) -> Column:
    found = F.filter(F.split(text, "\n"), lambda s: F.trim(s) != "")
    total = F.aggregate(found, F.lit(0), lambda n, s: n + F.length(F.trim(s)))
    return F.when(F.size(found) == 0, 0.0).otherwise(total / F.size(found))


def is_directory(text: Column, links: Column, line: Column) -> Column:
    """A page of links: short, mostly links, or of short lines."""
    return (F.length(text) < 800) | (links > 0.35) | (line < 55)


def link_score(
    url: Column, anchor: Column, keywords: list[str] = L.LINK_KEYWORDS, bonus: str = L.LINK_BONUS,
    irrelevant: list[str] = L.IRRELEVANT_URL, foreign: list[str] = L.FOREIGN_URL,
) -> Column:
    """One for each keyword in address or anchor, one more for a ``bonus`` pattern, minus two for each
    irrelevant part and each part of another country."""
    seen = F.lower(F.concat_ws(" ", url, anchor))
    hits = sum((F.contains(seen, F.lit(k)).cast("int") for k in keywords), F.lit(0))
    bad = sum((F.contains(seen, F.lit(k)).cast("int") for k in [*irrelevant, *foreign]), F.lit(0))
    return hits + seen.rlike(bonus).cast("int") - 2 * bad


def link_density(html: Column) -> Column:
    inside = F.aggregate(links(html), F.lit(0), lambda n, x: n + F.length(x["anchor"]))
    return F.round(inside / F.greatest(F.length(visible(html)), F.lit(1)), 6)


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1)), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)


def absolute(url: Column, base: Column) -> Column:
    """Links against their page: absolute, host-relative or path-relative; null for other schemes."""
    root = F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/])/[^/]*$", "/")
    return (
        F.when(url.rlike(r"^https?://"), url)
        .when(url.startswith("//"), F.concat(F.lit("https:"), url))
        .when(url.startswith("/"), F.concat(root, url))
        .when(url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), None)
        .otherwise(F.concat(folder, url))
    )


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden: list[str] = []

    def handle_starttag(self, tag, attrs):
        names = " ".join(v or "" for k, v in attrs if k in ("class", "id")).lower()
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.append(tag)
        elif tag in _SKIP or any(n in names.split() or f"{n}-" in names for n in _NOISE):
            self.hidden.append(tag)
        if tag in _BREAK:
            self.parts.append("\n\n")
        if not self.hidden and tag in ("h1", "h2", "h3", "h4"):
            self.parts.append("## ")
        elif not self.hidden and tag == "li":
            self.parts.append("- ")

    def handle_endtag(self, tag):
        if self.hidden and tag == self.hidden[-1]:
            self.hidden.pop()
        elif tag in _BREAK:
            self.parts.append("\n\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def parsed_text(html: str | None) -> str:
    """Readable text of a page: blocks apart by blank lines, headings and items marked."""
    reader = _Text()
    reader.feed(html or "")
    blocks_ = (" ".join(b.split()) for b in "".join(reader.parts).split("\n\n"))
    return "\n\n".join(b for b in blocks_ if b and b not in ("##", "-"))


@F.arrow_udf(StringType())
def page_text(pages: pa.Array) -> pa.Array:
    return pa.array([parsed_text(p) for p in pages.to_pylist()], pa.string())
