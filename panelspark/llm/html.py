"""Main text of web pages by line-block distribution.

Markup is stripped into lines: every block element ends a line, and every sectioning
element leaves as many empty lines as the window is wide. Text lengths are summed over a
sliding window of lines; the sum surges where a section's text starts and dives to zero
where it ends. That is done on every page. Sections with few links and SHARE of the
densest one's text are dense. Article and main elements only weigh: beside text in them
other sections count by OUTSIDE, and links in them cost half. If a section in an article
(or main element) is dense, all sections in articles (main elements) are kept; of the
others, the dense ones, and sections with few links between them or next to them. Articles
with less than SHARE of the greatest one's text are teasers and go. Names only weigh too:
what is named as furniture goes only if the rest of the page holds SHARE of its text."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frees, small_batches

WINDOW, SHARE, LINKS, OUTSIDE = 3, 0.2, 0.5, 0.5
SCHEMA = "page_id bigint, url string, text string, n_chars bigint"
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
SILENT = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "head", "title", "textarea", "select", "option"}
CHROME = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset"}
SECTIONS = {"div", "section", "article", "main", "header", "body", "html", "table", "ul", "ol", "dl", *CHROME}
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "td", "th", "dt", "dd", "br", "hr", "pre", "blockquote", "figure", "figcaption", "address", "caption", "center", "details", "summary", "legend", "label", "thead", "tbody", "tfoot", *SECTIONS}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
#: Words of names that page furniture has, and words that go with them: fixed values. A
#: name is furniture if it has one of the first and none but these.
FURNITURE = set("ad ads advert advertisement adverts advertising sponsor sponsored promo promos promotion banner banners cookie cookies consent gdpr notice notices alert alerts sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus replies respond share sharing social related recommended newsletter subscribe signup login popup modal overlay widget widgets pagination pager copyright skip skiplink".split())
GO_WITH = set("left right top bottom side site page global primary secondary sticky fixed mobile desktop list lists item items area box boxes bar bars block blocks wrap wrapper container section sections region panel inner outer header head links link buttons button icons icon form thread threads feed unit slot post posts article articles story stories user reader id class 1 2 3 4".split())
ATTR = re.compile(r"\b(class|id|role|aria-label|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}


def beside(name: str, attrs: str) -> bool:
    """Whether an element holds no article text."""
    if name in CHROME:
        return True
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if key == "role" and value.lower() in ROLES:
            return True
    return False


def furniture(name: str, attrs: str) -> bool:
    """Whether an element is named as page furniture is."""
    if name in ("html", "body", "article", "main"):
        return False
    for m in ATTR.finditer(attrs):
        if m[1].lower() in ("class", "id"):
            for token in (m[2] or m[3] or m[4] or "").lower().split():
                parts = {x for x in re.split(r"[-_]+", token) if x}
                if parts & FURNITURE and parts <= FURNITURE | GO_WITH:
                    return True
    return False


Line = tuple[str, int, bool, int, tuple[int, ...]]


def lines(page: str) -> list[Line]:
    """(text, number of the article it is in or 0, in a main element, characters of links,
    numbers of the elements around it that are named as furniture or are articles in
    articles) of each line; empty lines are gaps between sections."""
    out: list[Line] = []
    open_: list[tuple[str, bool, bool]] = []  # name, silent or beside, a head of an article
    depth = {"article": 0, "main": 0}
    dark = anchors = article = marks = 0
    around: list[int] = []
    marked: list[int] = []  # per open element: its number, or 0
    parts: list[str] = []
    linked = 0

    def end() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, article if depth["article"] else 0, depth["main"] > 0, min(linked, len(text)), tuple(around)))
            parts.clear()
        linked = 0

    def gap() -> None:
        end()
        if out and out[-1][0]:
            out.extend([("", 0, False, 0, ())] * WINDOW)

    def close(i: int) -> None:
        nonlocal dark
        while len(open_) > i:
            name, hid, _ = open_.pop()
            dark -= hid
            if marked.pop():
                around.pop()
            if name in depth:
                depth[name] -= 1

    at = 0
    while at < len(page):
        m = TAG.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text and not dark:
            parts.append(text)
            linked += len(text) if anchors else 0
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if name in BLOCKS and not dark:
            (gap if name in SECTIONS else end)()
        if m[1]:
            if name == "a":
                anchors = max(0, anchors - 1)
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == name:
                    was, held = dark, len(around)
                    if held and any(marked[i:]):
                        gap()
                    close(i)
                    if was and not dark and name in SECTIONS:
                        gap()
                    break
                if name not in SECTIONS and open_[i][0] in SECTIONS:
                    break  # a stray end tag doesn't close what holds it
            continue
        if name in VOID:
            continue
        if name in ("script", "style", "textarea", "title"):  # raw text up to its end tag
            stop = re.compile(rf"</{name}\s*>|\Z", re.I).search(page, at)
            at = stop.end()
            continue
        if name == "a":
            anchors += 1
            continue
        if name == "p":
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == "p":
                    close(i)
                    break
                if open_[i][0] in SECTIONS:
                    break
        hid = name in SILENT or beside(name, m[3]) or name == "header" and not depth["article"]
        named = furniture(name, m[3]) or name == "article" and depth["article"] > 0
        if hid or named or name in SECTIONS or name == "p":
            if (hid or named) and not dark:
                (gap if named else end)()
            open_.append((name, hid, False))
            marks += named
            marked.append(marks if named else 0)
            if named:
                around.append(marks)
            article += name == "article" and not depth["article"]
            dark += hid
            if name in depth:
                depth[name] += 1
    end()
    return out


def without_furniture(rows: list[Line]) -> list[Line]:
    """Lines in named elements go, but only where the name can be right: the rest of the page
    holds a share of the element's text at least. A wrapper of all the text stays, whatever
    it is called, and the elements in it are judged in turn."""
    size: dict[int, int] = {}
    for text, *_, around in rows:
        for k in around:
            size[k] = size.get(k, 0) + len(text)
    left = sum(len(r[0]) for r in rows)
    gone: set[int] = set()
    for k in sorted(size):  # outer elements come first
        own = sum(len(r[0]) for r in rows if k in r[4] and gone.isdisjoint(r[4]))
        if own and left - own >= SHARE * own:
            gone.add(k)
            left -= own
    return [r if gone.isdisjoint(r[4]) else ("", 0, False, 0, ()) for r in rows]


def sections(rows: list[Line]) -> list[tuple[int, int, int, list[str], int]]:
    """(kind, characters, characters of links, lines, article) of each text between a surge
    of the window sums and the dive after it; kind: 1 in an article, 2 in a main element, 0
    in neither. Section ends make gaps, so a section has one kind."""
    size = np.array([len(r[0]) for r in rows] + [0] * WINDOW)
    sums = np.convolve(size, np.ones(WINDOW, int))[WINDOW - 1 :][: len(rows)]  # of a line and those after it
    out = []
    i = 0
    while i < len(rows):
        if not rows[i][0]:
            i += 1
            continue
        j = i  # a surge; the dive is the first window without text
        while j < len(rows) and sums[j] > 0 and rows[j][1] == rows[i][1]:
            j += 1
        part = [r for r in rows[i:j] if r[0]]
        kind = 1 if part[0][1] else 2 if part[0][2] else 0
        out.append((kind, sum(len(r[0]) for r in part), sum(r[3] for r in part), [r[0] for r in part], part[0][1]))
        i = j
    return out


def extract(page: str | None) -> str:
    """The main text of one page."""
    found = sections(without_furniture(lines(page or "")))
    # of several articles, those with a share of the greatest's text
    whole: dict[int, int] = {}
    for _, n, links, _, article in found:
        whole[article] = whole.get(article, 0) + n - (LINKS * links if article else 0)
    whole.pop(0, None)
    found = [x for x in found if not x[4] or whole[x[4]] >= SHARE * max(whole.values())]
    tagged = any(kind for kind, *_ in found)
    low = [links <= LINKS * n for _, n, links, *_ in found]
    # tags halve what links cost; beside tagged sections, others count by OUTSIDE
    size = [n - (LINKS * links if kind else links) for kind, n, links, *_ in found]
    most = max((s for s, (kind, *_), few in zip(size, found, low) if kind or few), default=0)
    dense = [(kind or few) and s * (OUTSIDE if tagged and not kind else 1) >= SHARE * most for s, (kind, *_), few in zip(size, found, low)]
    kinds = {kind for (kind, *_), d in zip(found, dense) if d}
    kept = {i for i, (kind, *_) in enumerate(found) if kind and kind in kinds}
    if 0 in kinds:
        seeds = [i for i, (kind, *_) in enumerate(found) if dense[i] and not kind]
        plain = {i for i, (kind, *_) in enumerate(found) if low[i] and not kind}
        a, b = seeds[0], seeds[-1]
        while a - 1 in plain:
            a -= 1
        while b + 1 in plain:
            b += 1
        kept |= {i for i in plain if a <= i <= b}
    return " ".join(t for i in sorted(kept) for t in found[i][3])


def main_text(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars (code points). Null html counts
    as empty, and gives an empty text, as do pages without a text section; of articles or
    sections of equal size all stay; pages are read whole; a repeated or null page_id is a
    row like any other; equal rows give equal rows; other columns are left out; an empty table gives
    an empty table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    small_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(frees(run), SCHEMA)
