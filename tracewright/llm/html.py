"""Main text of web pages by a minimum cut.

A page is read as a row of text blocks. A linear classifier gives each block a
cost for being called content and one for being called boilerplate; these are
the capacities to the two terminals. Neighbours in the page and neighbours
under one parent element are tied by edges that cost something when they are
told apart. The minimum cut, found by maximum flow, is the cheapest labelling.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements and name parts that tell what a region is for.
RAW = {"script", "style"}
UNSEEN = set("head title noscript template iframe svg math object canvas audio video select option textarea button input label datalist dialog".split())
REGIONS = set("nav aside footer form menu".split())
BLOCKS = set("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ALWAYS_OUT = set("""nav navbar navigation menu sidebar footer cookie cookies consent gdpr notice advert adverts advertisement advertising ads ad adbox adsense
    sponsor sponsored promo promotion comment comments commentlist reply replies disqus respond newsletter subscribe subscription breadcrumb breadcrumbs
    pagination pager popup modal overlay login signup related recommended share sharing social widget banner alert""".split())
OUTSIDE_OUT = set("header masthead topbar toolbar search tools meta tags copyright bottom legal".split())
ROLES_OUT = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
INSIDE = set("article content main post entry story body text".split())
TEXTUAL = set("p h1 h2 h3 h4 h5 h6 blockquote pre li td dd figcaption".split())

_PART = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^'">]|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|([^<]+|<)""", re.S)
_NAME = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_SENTENCE = re.compile(r"[.!?…。]\W*$")

# Weights of the classifier, as log-odds of being content.
BIAS, LENGTH, SENTENCE, LINKS, IN_MAIN, IN_NAMED, IN_TEXTUAL, IN_OUT = -0.8, 1.6, 0.6, -4.0, 3.0, 1.5, 0.8, -20.0
NEXT, SIBLING = 0.4, 0.4   # cost of telling neighbours apart


class _Element:
    __slots__ = ("tag", "out", "main", "named", "unseen", "link", "parent")

    def __init__(self, tag, above, attributes):
        self.tag, self.parent = tag, above
        self.unseen = above is not None and above.unseen or tag in UNSEEN
        self.main = above is not None and above.main or tag in ("article", "main")
        self.link = above is not None and above.link or tag == "a"
        self.named = above is not None and above.named
        self.out = above is not None and above.out or tag in REGIONS or tag == "header" and not self.main
        if attributes and tag not in ("html", "body"):
            for m in _NAME.finditer(attributes):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name in ("class", "id"):
                    parts = set(_WORD.findall(_CAMEL.sub(" ", value).lower()))
                    if parts & ALWAYS_OUT or not self.main and parts & OUTSIDE_OUT:
                        self.out = True
                    elif parts & INSIDE:
                        self.named = True
                elif name == "role":
                    self.out = self.out or value.lower() in ROLES_OUT
                    self.main = self.main or value.lower() in ("main", "article")
                elif name == "style":
                    self.out = self.out or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
                elif name == "hidden" and m[0].lower() == "hidden" or name == "aria-hidden" and value.lower() == "true":
                    self.out = True


def blocks(html: str) -> list[tuple[str, float, _Element]]:
    """(text, share of characters in links, innermost block element), in page order."""
    out: list[tuple[str, float, _Element]] = []
    root = _Element("", None, "")
    stack, words, linked, total = [root], [], 0, 0
    at = 0

    def end_block():
        nonlocal words, linked, total
        if words:
            text = " ".join("".join(words).split())
            if text:
                home = next((e for e in reversed(stack) if e.tag in BLOCKS), root)
                out.append((text, linked / max(total, 1), home))
            words, linked, total = [], 0, 0

    while at < len(html):
        m = _PART.match(html, at)
        at = m.end()
        if m[7] is not None:
            if not stack[-1].unseen:
                text = unescape(m[7])
                words.append(text)
                total += len(text)
                linked += len(text) * stack[-1].link
            continue
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag in BLOCKS:
                end_block()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag not in BLOCKS and stack[i].tag in BLOCKS:
                    break          # an inline end tag closes nothing beyond its block
            continue
        if tag == "br":
            words.append(" ")
            continue
        if tag in BLOCKS:
            end_block()
            if tag == "body":
                while stack[-1].unseen:        # a head that was never closed
                    stack.pop()
            for i in range(len(stack) - 1, 0, -1):      # a new block ends an open paragraph; a new item ends the one before
                if stack[i].tag == "p" or stack[i].tag == tag and tag in ("li", "dt", "dd", "td", "th", "tr"):
                    del stack[i:]
                    break
                if stack[i].tag in BLOCKS:
                    break
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>|\Z", re.I).search(html, at)
            at = close.end()
            continue
        if tag not in VOID and not (m[3] or m[6] or "").endswith("/"):
            stack.append(_Element(tag, stack[-1], m[3] or m[6]))
    end_block()
    return out


def content_odds(text: str, links: float, home: _Element) -> float:
    """Log-odds that a block is content."""
    words = text.count(" ") + 1
    return (BIAS + LENGTH * min(1.0, words / 20) + SENTENCE * bool(_SENTENCE.search(text)) + LINKS * links + IN_MAIN * home.main
            + IN_NAMED * home.named + IN_TEXTUAL * (home.tag in TEXTUAL) + IN_OUT * home.out)


def minimum_cut(odds: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source (content) in the cheapest labelling, by maximum flow along shortest paths."""
    n = len(odds)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    at: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, there: float, back: float) -> None:
        at[a].append(len(to))
        to.append(b)
        room.append(there)
        at[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, x in enumerate(odds):
        if x > 0:
            edge(source, i, x, 0.0)
        elif x < 0:
            edge(i, sink, -x, 0.0)
    for a, b, c in ties:
        edge(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in at[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                path, a = [], source
                continue
            while turn[a] < len(at[a]):
                e = at[a][turn[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(at[a]):
                path.append(e)
                a = to[e]
            elif path:
                e = path.pop()
                a = to[e ^ 1]
                turn[a] += 1
            else:
                break


def main_text(html: str | None) -> str:
    """Text of the blocks labelled content, in page order, joined by one space."""
    page = blocks(html or "")
    last: dict[int, int] = {}
    ties = []
    for i, (_, _, home) in enumerate(page):
        if i:
            ties.append((i - 1, i, NEXT))
        parent = id(home.parent or home)
        if (j := last.get(parent)) is not None:
            ties.append((j, i, SIBLING))
        last[parent] = i
    inside = minimum_cut([content_odds(*b) for b in page], ties)
    return " ".join(b[0] for b, c in zip(page, inside, strict=True) if c)


def _extractor(html: str, carry: list[str]):
    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                texts = [main_text(x.as_py()) for x in part.column(html)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in carry], pa.array(texts, pa.string())], [*[f"c{i}" for i in range(len(carry))], "text"])
    return extract


def extract(pages: DataFrame, carry: list[str] | None = None, html: str = "html") -> DataFrame:
    """The carried columns (default: all but the html) with ``text``, the main text.

    White space inside a block becomes one space, character references are
    decoded, and nothing else is changed, dropped or capped. A null or empty
    page, and one without content, has an empty text. Pages are judged one by
    one, so repeated pages give equal texts; a carried column named text gives
    way to the result.
    """
    carry = [c for c in (carry if carry is not None else [c for c in pages.columns if c != html]) if c != "text"]
    schema = T.StructType([*[T.StructField(f"c{i}", pages.schema[c].dataType) for i, c in enumerate(carry)], T.StructField("text", T.StringType())])
    return pages.select(*dict.fromkeys([*carry, html])).mapInArrow(_extractor(html, carry), schema).toDF(*carry, "text")


def n_chars():
    return F.char_length("text").cast("long")
