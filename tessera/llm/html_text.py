"""Main text of web pages by a maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags. Words score by where they stand (zone, innermost block, link or not, class of
the element that holds them) and tags, always below zero, by their name and zone; one linear scan finds the contiguous run of the
greatest sum, which is the article. Text of that run is kept unless an element around it is of a kind, or is named as a
kind, that isn't the article's (menus, adverts, notices, comments, forms and the like); what one such element may take
off the sum is bounded by VISIT, so one in the middle of an article doesn't part it.

Weights come from labelled pages: in a bounded sample (SAMPLE pages with an <article> or <main> element, least in a
hash of id and page) the words inside are content and the others are not. Neither learning nor extraction sees the mark
itself: its tags count as those of a <div>, and a page is scanned alike with and without one. Extraction reads every
whole page. Kinds of words with a class are learned where SEEN words of the sample have them, the others without it.

Defined cases: null and empty pages give an empty text; a page cut off within a tag loses that tag alone; with
equal sums the run that ends first is taken, and of these the shortest; <br> is white space within its block; very long pages, and very deep
ones, are read whole in one pass, in time in proportion to their length; repeated rows are
extracted alike; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, table

SAMPLE = 2000
#: Words of the sample that a kind with a class must have, and the most that one zone may take off a run's sum.
SEEN, VISIT = 20, 20.0
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements whose content isn't text of the page.
RAW = frozenset("script style noscript template svg math iframe object textarea title select head audio video canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_SCORED = BLOCKS | frozenset("a b i em strong span br img input".split())
#: Elements that are never part of an article's text.
ZONES = {"nav": "menu", "menu": "menu", "footer": "footer", "aside": "sidebar", "form": "form", "button": "form", "label": "form", "fieldset": "form", "dialog": "notice", "header": "header"}
#: Parts of class, id and role names that say so as well.
NAMES = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc sitemap",
    "header": "header masthead topbar banner",
    "footer": "footer contentinfo copyright",
    "sidebar": "sidebar aside complementary related recommended widget",
    "notice": "notice cookie cookies consent gdpr popup modal alert overlay paywall disclaimer",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion",
    "form": "form login signup subscribe newsletter search",
    "comment": "comment comments reply replies disqus discussion",
    "share": "share sharing social",
}
_ZONE_OF = {word: zone for zone, words in NAMES.items() for word in words.split()}
#: Parts that may stand beside them in a name; a name with any other part (form-factor) says nothing.
_PLAIN = frozenset("area bar block body bottom box button container content footer group header inner item items left link links list main menu nav outer page panel post posts right section site title top wrap wrapper".split())
#: Without labelled pages.
DEFAULT = {"word": 1.0, "zone": -0.1, "link": -0.5, "tag": -0.05}
_SCOPE = frozenset("article aside blockquote body div dd details dialog fieldset figure footer form header html li main nav section td th table ul ol dl".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_MARKS = ("article", "main")


def _named(attributes: str) -> tuple[str, str]:
    """The zone that class, id or role name, and the class."""
    zone, cls = "", ""
    for m in _NAMED.finditer(attributes):
        names = next(x for x in m.groups() if x is not None)
        if m[0][:1] in "cC":
            cls = names.strip().lower()[:40]
        for name in names.split():
            parts = [x.lower() for x in _PART.findall(name)]
            found = [_ZONE_OF[x] for x in parts if x in _ZONE_OF]
            if found and not zone and all(x in _ZONE_OF or x in _PLAIN for x in parts):
                zone = found[0]
    return zone, cls


class _Stack:
    """Open elements, with what holds below each; finding one by its tag takes no walk."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.held: list[tuple[str, bool, str, int, str]] = []  # zone, inside a mark, innermost block, open links, class
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    def top(self) -> tuple[str, bool, str, int, str]:
        return self.held[-1] if self.held else ("", False, "body", 0, "")

    def push(self, tag: str, held: tuple[str, bool, str, int, str]) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        if tag in _SCOPE:
            self.scopes.append(len(self.tags))
        self.tags.append(tag)
        self.held.append(held)

    def cut(self, k: int) -> None:
        while len(self.tags) > k:
            tag = self.tags.pop()
            self.held.pop()
            self.places[tag].pop()
            if tag in _SCOPE:
                self.scopes.pop()

    def close(self, tag: str) -> None:
        if self.places.get(tag):
            self.cut(self.places[tag][-1])

    def shut(self, tags: set[str]) -> None:
        """Closes the innermost of the tags, if no other scope begins within it."""
        k = max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)
        if k >= 0 and k >= (self.scopes[-1] if self.scopes else 0):
            self.cut(k)


def tokens(page: str) -> Iterator[tuple[str, str, str, bool, bool]]:
    """(kind of token, text, zone, starts a block, inside <article> or <main>) in page order; texts are still escaped."""
    stack = _Stack()
    at, end, fresh, raw = 0, len(page), True, ""
    zone, inside, block, links, cls = stack.top()
    low = ""
    while at <= end:
        if raw:
            low = low or page.lower()
            stop = low.find(f"</{raw}", at)
            if stop < 0:
                return
            close = page.find(">", stop)
            at, raw = (end + 1 if close < 0 else close + 1), ""
            continue
        m = _TAG.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            yield f"{zone}|{block}|{'a' if links else ''}|{cls}", page[at:stop], zone, fresh, inside
            fresh = False
        if not m:
            return
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in BLOCKS:
            fresh = True
        name = "div" if tag in _MARKS else tag if tag in _SCORED else "other"
        yield f"<{name}|{zone}", " " if tag in ("br", "td", "th") else "", zone, fresh, inside
        if closing:
            stack.close(tag)
        elif tag in RAW:
            if not attributes.endswith("/"):
                raw = tag if tag != "head" else ""
            if raw:
                continue
        elif tag not in VOID:
            stack.shut(_CLOSES.get(tag, set()) | ({"p"} if tag in BLOCKS else set()))
            around, within, outer, many, held = stack.top()
            here, own = _named(attributes) if "=" in attributes and tag not in ("html", "body", *_MARKS) else ("", "")
            if tag in ZONES:
                here = "" if tag == "header" and within else ZONES[tag]
            stack.push(tag, (around or here, within or tag in _MARKS, "div" if tag in _MARKS else tag if tag in BLOCKS else outer, many + (tag == "a"), own or held))
        zone, inside, block, links, cls = stack.top()


def labelled(page: str) -> Counter:
    """(token kind, inside) -> words, or tags, of a page; kinds of words with a class count without it as well."""
    out: Counter = Counter()
    for kind, text, zone, _, inside in tokens(page):
        n, side = 1 if kind[0] == "<" else len(text.split()), inside and not zone
        out[kind, side] += n
        if kind[0] != "<" and kind[-1] != "|":
            out[_bare(kind), side] += n
    return out


def _bare(kind: str) -> str:
    return "|".join(kind.split("|", 3)[:3]) + "|"


def weigh(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log-odds of being inside: of words by place, of tags by name, in proportion to words; tags below zero."""
    words = {side: sum(n for (k, s), n in counts.items() if s == side and k[0] != "<" and k[-1] == "|") + 1 for side in (True, False)}
    out = {}
    for kind in {k for k, _ in counts}:
        held = counts.get((kind, True), 0), counts.get((kind, False), 0)
        odds = math.log((held[0] + 0.5) / (held[1] + 0.5))
        if kind[0] == "<":
            out[kind] = max(-2.0, min(-0.05, odds - math.log(words[True] / words[False])))
        elif kind[-1] == "|" or sum(held) >= SEEN:
            out[kind] = max(-1.0, min(2.0, odds))
    return out


def weight(kind: str, weights: dict[str, float]) -> float:
    """Of one word or tag of the kind."""
    if kind[0] == "<":
        return weights.get(kind, DEFAULT["tag"])
    w = weights.get(kind)
    if w is None:
        w = weights.get(_bare(kind))
    if w is None:
        zone, _, link, _ = kind.split("|", 3)
        w = DEFAULT["zone"] if zone else DEFAULT["link"] if link else DEFAULT["word"]
    return w


def scores(found: list[tuple[str, str, str, bool, bool]], weights: dict[str, float]) -> list[float]:
    """What each token adds to a run's sum."""
    out, visit, known = [], 0.0, {}
    for kind, text, zone, _, _ in found:
        w = known.get(kind)
        if w is None:
            w = known[kind] = weight(kind, weights)
        x = w if kind[0] == "<" else w * len(text.split())
        if zone:
            x = max(min(x, 0.0), -VISIT - visit)
            visit += x
        else:
            visit = 0.0
        out.append(x)
    return out


def best_run(values: list[float]) -> tuple[int, int]:
    """Of the runs of the greatest sum the one that ends first, of these the shortest; empty if none is above zero."""
    best, total, start, run = 0.0, 0.0, 0, (0, 0)
    for i, x in enumerate(values):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, run = total, (start, i + 1)
    return run


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The blocks of the best run, joined by empty lines."""
    found = list(tokens(page or ""))
    first, stop = best_run(scores(found, weights))
    blocks: list[list[str]] = []
    for kind, text, zone, fresh, _ in found[first:stop]:
        if fresh or not blocks:
            blocks.append([])
        if not zone and text:
            blocks[-1].append(" " if kind[0] == "<" else html.unescape(text))
    return "\n\n".join(filter(None, (" ".join("".join(b).split()) for b in blocks)))


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> dict[str, float]:
    """Weights from a sample of the pages that mark their article."""
    bound_batches(pages.sparkSession)
    rows = pages.select(F.xxhash64(id_col, html_col).alias("h"), F.col(html_col).alias("html")).where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    # The greatest hash of the sample reaches the driver, then its counts by kind; rows with one hash are one page.
    most = rows.select("h").orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    if most is None:
        return {}
    sample = rows.where(F.col("h") <= most).dropDuplicates(["h"]).select("html")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                out.update(labelled(page))
        if out:
            kinds, n = zip(*out.items(), strict=True)
            yield pa.record_batch([pa.array([k for k, _ in kinds]), pa.array([s for _, s in kinds]), pa.array(n, pa.int64())], names=["kind", "inside", "n"])

    got = sample.mapInArrow(counted, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect()
    return weigh({(r["kind"], r["inside"]): r["n"] for r in got})


def main_text(page: Column, weights: dict[str, float]) -> Column:
    @F.arrow_udf("string")
    def of(pages: pa.Array) -> pa.Array:
        return pa.array([extract(x.as_py(), weights) for x in pages], pa.string())

    return of(page)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = pages.select("page_id", "url", main_text(F.col("html"), train(pages)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


SQL: dict[str, str] = {}
QUERIES = {"op5_html_text": op5_html_text}
