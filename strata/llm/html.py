"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is read as a sequence of words and tags. Words score positive and tags negative, each with a weight learned
from labelled pages: those whose article is marked by exactly one ``article`` element. Words of page furniture
(elements that are named as such and do not hold the content) and tags never seen in labelled pages do not count, and words of
links do as far as labelled articles have them. One linear scan finds the contiguous run with the highest sum.
The run, extended to the borders of its first and last block, is the content; its text without furniture is the result.

Names of furniture are the fixed ones below and those learned: classes, ids and roles whose words stand outside the
labelled articles (log-odds below ``NAME_ODDS`` in at least ``NAME_PAGES`` pages).

The weights come from at most ``LABELLED`` pages, those with the smallest hashed ids; every page is read whole.

Defined cases: a null or empty page, or one without words outside furniture, has an empty text; unclosed elements
end with the page, unclosed furniture holds nothing but its tag; repeated rows are pages of their own; an empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELLED = 1000
TAG_NAMES = 200  # tag names that get a weight of their own
NAMES = 500      # classes, ids and roles that are learned
NAME_PAGES = 5   # pages that a learned name occurs in
NAME_ODDS = -3.0
MOST = 0.5       # share of a page's words beyond which elements of one name are no furniture, if no article or main stands outside
NEARLY_ALL = 0.75  # the same beside an article or main
_LEAST = 0.02    # a tag costs at least this much, a word earns at least as much

# Elements without text, elements and words of class, id or role that name page furniture, blocks.
SILENT = ("script", "style", "noscript", "template", "iframe", "svg", "head", "title", "object", "math")
FURNITURE = ("nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "textarea", "label")
FURNITURE_WORDS = (
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "consent", "cookie", "cookies", "copyright", "disqus", "footer", "header", "login", "masthead", "menu",
    "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo",
    "promoted", "recommended", "related", "reply", "replies", "respond", "search", "share", "sharing", "sidebar",
    "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget", "widgets",
    "complementary", "contentinfo", "alert", "dialog", "alertdialog",
)
# Names of elements that may hold articles other than the page's own, or what nobody sees.
OTHERS = frozenset(("comment", "comments", "disqus", "reply", "replies", "respond", "related", "recommended", "promoted",
                    "promo", "sponsor", "sponsored", "complementary", "hidden"))
# First parts of classes that tell about the layout around an element.
LAYOUT = ("has", "with", "no", "without")
INLINE = ("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
          "time", "tt", "u", "var", "wbr")
# Elements whose id is the target of a link, often made of the words of a heading.
ANCHORED = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "dt", "dd", "pre", *INLINE))
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")

# Elements whose content is no markup.
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "title", "math", "object", "textarea")
_RAW_END = {name: re.compile(f"</{name}\\s*>", re.I) for name in RAW}
_OPENING = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_PLAIN = re.compile(r"[^>\"']*")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")
_BLANK = re.compile(r"\s+")
_FURNITURE_WORDS = frozenset(FURNITURE_WORDS)

Event = tuple[str, str, bool]  # kind (a tag name, "/" and a tag name, or "" for text), text, in furniture


def names_of(name: str, attributes: str) -> list[str]:
    """Classes, roles and id of an element; not the ids of headings and the like, which are targets of links."""
    return [token for match in _ATTRIBUTE.finditer(attributes)
            if (key := match[1].lower()) in ("class", "role") or key == "id" and name not in ANCHORED
            for token in (match[2] or match[3] or match[4] or "").lower().split()]


@lru_cache(maxsize=1 << 14)
def _furniture_names(name: str, attributes: str, learned: frozenset[str]) -> frozenset[str]:
    """Names of furniture that an element has: a learned class, id or role, or a fixed word as the last part of one.

    ``hidden`` stands for an element that is not shown, ``form`` for a form, which may as well wrap a page.
    """
    if name in ("html", "body", "article", "main"):
        return frozenset()
    found = {"form"} if name == "form" else set()
    for match in _ATTRIBUTE.finditer(attributes):
        key, value = match[1].lower(), (match[2] or match[3] or match[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value.strip() == "true" or key == "style" and _UNSEEN.search(value):
            found.add("hidden")
    for token in names_of(name, attributes):
        parts = _PARTS.split(token.strip("-_"))
        if parts[-1] in _FURNITURE_WORDS and (len(parts) == 1 or parts[0] not in LAYOUT):
            found.add(parts[-1])
        elif token in learned:
            found.add(token)
    return frozenset(found)


class _Finder:
    """Forward searches in a page, whose number of failures does not grow with the page."""

    def __init__(self, page: str):
        self.page, self.missing = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def raw_end(self, name: str, at: int) -> int:
        """After the end tag of a raw element; -1 if there is none."""
        if name in self.missing:
            return -1
        found = _RAW_END[name].search(self.page, at)
        if not found:
            self.missing.add(name)
        return found.end() if found else -1

    def tag_end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag; one in quotes does not, unless a quote is left open."""
        begin = at
        if self.find(">", at) < 0:
            return -1
        while True:
            at = _PLAIN.match(self.page, at).end()
            if at >= len(self.page):
                return self.find(">", begin)
            if self.page[at] == ">":
                return at
            at = self.find(self.page[at], at + 1) + 1
            if not at:
                return self.find(">", begin)


def scanned(page: str) -> Iterator[tuple[str, str, str]]:
    """kind, text and attributes of tags and texts in order, in one pass; comments and raw elements are left out."""
    finder, at, size = _Finder(page), 0, len(page)
    while at < size:
        if page[at] != "<":
            to = finder.find("<", at)
            to = size if to < 0 else to
            yield "", page[at:to], ""
            at = to
            continue
        if page.startswith("<!--", at):
            to = finder.find("-->", at + 4)
            at = size if to < 0 else to + 3
            continue
        if page.startswith(("<!", "<?"), at):
            to = finder.find(">", at)
            if to >= 0:
                at = to + 1
                continue
        opening = _OPENING.match(page, at)
        to = finder.tag_end(opening.end()) if opening else -1
        if to < 0:
            yield "", "<", ""
            at += 1
            continue
        name = opening[2].lower()
        after = finder.raw_end(name, to + 1) if not opening[1] and name in _RAW_END else -1
        if after < 0:
            yield opening[1] + name, "", page[opening.end():to]
        at = max(after, to + 1)


def events(page: str, learned: frozenset[str] = frozenset()) -> list[Event]:
    """Tags and texts of a page in order, and whether they stand in furniture."""
    raw = list(scanned(page))
    inside = _furniture(raw, learned)
    return [(kind, text, inside[i]) for i, (kind, text, _) in enumerate(raw)]


def _furniture(raw: list[tuple[str, str, str]], learned: frozenset[str]) -> list[bool]:
    """Which events stand in furniture: elements by their tag name first, then those that a class, id or role names.

    What holds the content is no furniture, whatever its name: an element with an ``article`` or ``main`` (outside
    of any other article), and elements of one name that together hold most words of the page.
    """
    ends = _ends(raw)
    inside = [False] * len(raw)
    articles = [i for i, (kind, _, _) in enumerate(raw) if kind == "article"]
    mains = [i for i, (kind, _, _) in enumerate(raw) if kind == "main"]
    nested, until = [False] * len(raw), 0
    for i in articles:
        begin, until = max(i + 1, until), max(until, ends[i])
        nested[begin:until] = [True] * (until - begin)

    def within(places: list[int], i: int) -> int:
        return bisect_left(places, ends[i]) - bisect_left(places, i)

    def content(i: int, others: bool) -> bool:
        """Whether the element holds ``main`` or articles; all of them, if it may hold further articles."""
        if within(mains, i):
            return True
        held = 0 if nested[i] else within(articles, i)
        return held == len(articles) and held > 0 and not mains if others else held > 0

    until = 0
    for i, (kind, _, _) in enumerate(raw):
        if i >= until and (kind in SILENT or kind in FURNITURE and kind != "form" and not content(i, True)):
            until = max(until, ends[i])
        inside[i] = i < until
    named = [(i, names) for i, (kind, _, attributes) in enumerate(raw)
             if kind and kind[0] != "/" and not inside[i] and (attributes or kind == "form") and kind not in VOID
             and (names := _furniture_names(kind, attributes, learned))]
    if not named:
        return inside
    articles, mains = ([i for i in places if not inside[i]] for places in (articles, mains))
    words = [0, *accumulate(0 if kind or inside[i] else len(text.split()) for i, (kind, text, _) in enumerate(raw))]
    reach: dict[str, list[int]] = {}  # of each name: where its elements end so far, their words, articles and mains
    for i, names in named:
        for name in names:
            at = reach.setdefault(name, [0, 0, 0])
            if i >= at[0]:
                at[:] = ends[i], at[1] + words[ends[i]] - words[i], at[2] + within(articles, i) + within(mains, i)
    unfit = {name for name, (_, n, marked) in reach.items()
             if (n > MOST * words[-1] if marked == len(articles) + len(mains) else n > NEARLY_ALL * words[-1] and name not in OTHERS)}
    until = 0
    for i, names in named:
        names = names - unfit
        if i >= until and names and not content(i, bool(names & OTHERS)):
            until = ends[i]
            inside[i:until] = [True] * (until - i)
    return inside


def _ends(raw: list[tuple[str, str, str]]) -> list[int]:
    """By place of an opening tag: the place after its end tag; right after itself if there is none."""
    ends = list(range(1, len(raw) + 1))
    open_: dict[str, list[int]] = {}
    for i, (kind, _, _) in enumerate(raw):
        if kind and kind[0] != "/":
            open_.setdefault(kind, []).append(i)
        elif kind and open_.get(kind[1:]):
            ends[open_[kind[1:]].pop()] = i + 1
    return ends


def tally(page: str) -> Counter | None:
    """Words ("", of links "a ") and tags of a page inside and outside its one article, words under each name (".name"),
    and the page itself for each name outside ("/.name"); None for a page that is no label."""
    raw = list(scanned(page))
    kinds = [kind for kind, _, _ in raw]
    if kinds.count("article") != 1 or kinds.count("/article") != 1:
        return None
    furniture = _furniture(raw, frozenset())
    first, last = kinds.index("article"), kinds.index("/article")
    counts: Counter = Counter()
    links = 0
    words = [0]
    for i, (kind, text, _) in enumerate(raw):
        n = len(text.split())
        words.append(words[-1] + n)
        links = max(0, links + (kind == "a") - (kind == "/a"))
        counts[kind if kind else "a " if links else "", first < i < last and not furniture[i]] += 1 if kind else n
    ends, seen = _ends(raw), set()
    for i, (kind, _, attributes) in enumerate(raw):
        if attributes and kind[0] != "/" and not furniture[i] and not i < first < ends[i]:
            for name in set(names_of(kind, attributes)):
                counts[f".{name}", first < i < last] += words[ends[i]] - words[i]
                if not first < i < last and name not in seen:
                    seen.add(name)
                    counts[f"/.{name}", False] += 1
    return counts


def learn(pages: DataFrame) -> dict[str, float]:
    """The weight of a word (under "") and of each tag, from the labelled ones among the pages with the smallest hashes."""
    # The hash that bounds the sample is found on narrow rows; pages that tie with it all count.
    order = F.xxhash64("page_id", "url")
    whole = pages.where("html is not null")
    last = whole.select(order.alias("h")).orderBy("h").limit(LABELLED).agg(F.max("h")).first()[0]
    sample = whole.where(order <= F.lit(last))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for page in batch["html"]:
                total.update(tally(page.as_py()) or {})
            rows = [(kind, inside, n) for (kind, inside), n in total.items()]
            kinds, insides, counts = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.string()), pa.array(insides, pa.bool_()), pa.array(counts, pa.int64())],
                names=["kind", "inside", "n"])

    counted = (sample.select("html").mapInArrow(count, "kind string, inside boolean, n long").groupBy("kind")
               .agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inside"),
                    F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("outside")))
    most = F.desc(F.col("inside") + F.col("outside"))
    is_name, is_page = F.col("kind").startswith("."), F.col("kind").startswith("/.")
    rows = counted.where(~is_name & ~is_page).orderBy(F.desc(F.col("kind").isin("", "a ")), most, "kind").limit(TAG_NAMES + 2).collect()
    pages_of = counted.where(is_page & (F.col("outside") >= NAME_PAGES)).select(F.substring("kind", 2, 1 << 20).alias("kind"))
    rows += counted.where(is_name).join(pages_of, "kind").orderBy(most, "kind").limit(NAMES).collect()
    return weights({row["kind"]: (row["inside"], row["outside"]) for row in rows})


def weights(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log-odds of standing in content; a word's is kept above zero and a tag's below, those of links and names as they are."""
    odds = {kind: math.log((inside + 0.5) / (outside + 0.5)) for kind, (inside, outside) in counts.items()}
    kept = {kind: value if kind == "a " or kind[:1] == "." else max(_LEAST, value) if not kind else min(-_LEAST, value)
            for kind, value in odds.items()}
    return kept | ({} if "" in odds else {"": 1.0})


def learned_names(weight: dict[str, float]) -> frozenset[str]:
    return frozenset(kind[1:] for kind, value in weight.items() if kind[:1] == "." and value < NAME_ODDS)


def best_run(found: list[Event], weight: dict[str, float]) -> tuple[int, int] | None:
    """First and last event of the run with the highest sum, by one scan; None if nothing scores above zero."""
    word = weight[""]
    linked = min(word, weight.get("a ", word))
    best, run, begin, answer, links = 0.0, 0.0, 0, None, 0
    for i, (kind, text, furniture) in enumerate(found):
        if furniture:
            value = 0.0
        elif kind:
            value = weight.get(kind, -_LEAST)
            links = max(0, links + (kind == "a") - (kind == "/a"))
        else:
            value = len(text.split()) * (linked if links else word)
        if run <= 0:
            run, begin = 0.0, i
        run += value
        if run > best:
            best, answer = run, (begin, i)
    return answer


def _block(found: list[Event], first: int, last: int) -> tuple[int, int]:
    """The run extended to where its first block begins and its last one ends, as places."""
    def border(i: int) -> bool:
        return bool(found[i][0]) and found[i][0].lstrip("/") not in INLINE

    while first > 0 and not border(first) and not border(first - 1):
        first -= 1
    while last + 1 < len(found) and not border(last) and not border(last + 1):
        last += 1
    return first, last + 1


def main_text(page: str | None, weight: dict[str, float]) -> str:
    """The text of the content: blocks in page order, joined by one space."""
    found = events(page, learned_names(weight)) if page else []
    run = best_run(found, weight)
    if run is None:
        return ""
    begin, end = _block(found, *run)
    parts: list[str] = []
    for kind, text, furniture in found[begin:end]:
        if kind and kind.lstrip("/") not in INLINE:
            parts.append(" ")
        elif not kind and not furniture:
            parts.append(entities.unescape(text))
    return _BLANK.sub(" ", "".join(parts)).strip()


def extracted(pages: DataFrame, weight: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html)."""
    weight = learn(pages) if weight is None else weight

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), weight) for page in batch["html"]]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(
        extract, "page_id long, url string, text string, n_chars long")
