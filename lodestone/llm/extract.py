"""Main text of web pages by a minimum cut.

A page is split into blocks of text. A classifier gives each block the log odds of being content; its
cost for either label is the capacity of the block's edge to source or sink. Blocks that follow each
other, and neighbours under one parent, are tied by edges whose capacity falls with the distance
of their elements in the tree, and is less across the edge of an element that stands for something of its own. The
maximum flow's cut is the labelling of least cost, and the blocks on the source's side are the text, in page order.

The log odds have two parts, neither of which decides alone. What the page says of itself: elements such as
article, nav, footer, form, and class, id and role, where a name that is a telling word (ad, comments)
counts more than one that only holds it (ad-free), and one that holds words of both sorts
(content-with-sidebar) counts nothing. An element that claims to be content cancels what a form around it says, and
main what anything around it says; inside one that claims to be content, names that often stand for a part of the text
(alert, notice) count no more than names that only hold a word. A heading that announces readers' comments speaks
against all that follows it under the same parent, a link "Reply" against what shares its element. And what the text looks like (length, links, end marks, headings,
legal phrases): its weights are fitted by logistic regression, drawn towards START, on the
blocks of at most SAMPLE_PAGES pages, those with the smallest hashes, labelled by the first part; the
bound keeps the fit off the driver's memory whatever the table's size.

Scripts, styles, comments and the head are no blocks. Character references are decoded, each
run of white space in a block becomes one space, blocks are joined by two line feeds. br is white
space. Null and empty html: empty text. A page without markup is one block. Where no
element claims to be content, all blocks get BARE in favour of it. Time grows with a page's length,
whatever its depth. Repeated rows give equal results, null ids stay null; an empty table gives an empty
result. Other columns of the pages are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

SAMPLE_PAGES, TEXT_LIMIT, BARE = 400, 3.0, 1.0
#: Capacities of edges: to the next block and to the next under the same parent, at no distance; their decay by step; what is left across an element that stands for something.
NEXT, NEAR, DECAY, ACROSS = 2.6, 1.0, 0.5, 0.2
#: Log odds of what an element says: a telling element or name, a name that holds a telling word, and the most that all of them take away.
TELLS, HOLDS, CLAIMS, MOST = 6.0, 2.0, 3.0, 8.0
#: Elements that end a block of text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav object ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is not text.
RAW_TAGS = frozenset("script style template noscript textarea svg math".split())
#: Elements that hold no main text.
BOILER_TAGS = frozenset("nav aside footer form menu dialog button select fieldset head title iframe object".split())
CONTENT_TAGS = frozenset(("article", "main"))
#: Words of class, id or role that stand for something else than the main text.
BOILER_WORDS = frozenset(
    "ad ads advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus "
    "footer header masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted related "
    "replies reply respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Those of them that text inside an article has, too.
LOOSE_WORDS = frozenset("alert banner disclaimer notice notification widget".split())
#: Elements that may be wrapped around a whole page.
WRAP_TAGS = frozenset(("form", "fieldset"))
CONTENT_WORDS = frozenset("article content entry main post story".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSERS = BLOCK_TAGS | {"button", "select"}
VOID = frozenset(("hr", "iframe"))
_name = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_special = re.compile("[>\"']")
_attr = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_word = re.compile(r"[a-z]+|[A-Z][a-z]*")
_end = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW_TAGS}


class Block:
    """text; linked: characters in links; tag; structure: log odds by what the page says; said: the innermost element that says something; parent: node above its element; depth, and low: the depth of what it shares with the block before."""

    __slots__ = ("text", "linked", "tag", "structure", "said", "node", "parent", "depth", "low")

    def __init__(self, text: str, linked: int, tag: str, structure: float, said: int, node: int, parent: int, depth: int, low: int):
        self.text, self.linked, self.tag, self.structure, self.said, self.node, self.parent, self.depth, self.low = text, linked, tag, structure, said, node, parent, depth, low


def _names(attributes: str, inside: bool = False) -> tuple[float, float]:
    """(against, for) content, of the names in class, id and role; inside: of an element that claims to be content."""
    against = support = 0.0
    for m in _attr.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            found = {w.lower() for w in _word.findall(name)}
            bad, good = found & BOILER_WORDS, found & CONTENT_WORDS
            if bad and not good:
                against = max(against, TELLS if len(found) == 1 and not (inside and bad <= LOOSE_WORDS) else HOLDS)
            elif good and not bad:
                support = max(support, CLAIMS if len(found) == 1 else HOLDS)
    return against, support


class Tag(NamedTuple):
    """Where a tag, comment or declaration lies; name is None for the latter two, inner is the text of a CDATA section."""

    start: int
    end: int
    closes: bool
    name: str | None
    attributes: str
    inner: str


class Scanner:
    """Finds tags in page order, in time that grows with the page whatever is left open in it.

    A tag ends at the first > outside quotes. Where the way from a quote on has been found to lead to none, it is not taken
    again, and behind the page's last > only comments and CDATA sections are looked for.
    """

    def __init__(self, page: str) -> None:
        self.page, self.last = page, page.rfind(">")
        self.specials, self.dead = [m.start() for m in _special.finditer(page)], set()

    def after(self, at: int) -> Tag | None:
        page = self.page
        while True:
            at = page.find("<" if at <= self.last else "<!", at)
            if at < 0:
                return None
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return Tag(at, end + 3 if end >= 0 else len(page), False, None, "", "")
            if page.startswith("<![CDATA[", at):
                end = page.find("]]>", at + 9)
                return Tag(at, end + 3 if end >= 0 else len(page), False, None, "", page[at + 9 : end] if end >= 0 else page[at + 9 :])
            if at < self.last:
                if page[at + 1] in "!?":
                    return Tag(at, page.index(">", at) + 1, False, None, "", "")
                m = _name.match(page, at)
                end = self._end(m.end()) if m else -1
                if end >= 0:
                    return Tag(at, end + 1, bool(m[1]), m[2].lower(), page[m.end() : end], "")
            at += 1

    def _end(self, at: int) -> int:
        """The first > outside quotes; -1 if there is none."""
        k, seen = bisect_left(self.specials, at), []
        while k < len(self.specials):
            spot = self.specials[k]
            sign = self.page[spot]
            if sign == ">":
                return spot
            close = -1 if spot in self.dead else self.page.find(sign, spot + 1)
            seen.append(spot)
            if close < 0:
                break
            k = bisect_left(self.specials, close + 1, k)
        self.dead.update(seen)
        return -1


class Element(NamedTuple):
    tag: str
    node: int
    against: float
    support: float
    said: int
    #: What forms around it say, as part of against.
    wrapped: float = 0.0


def blocks_of(page: str | None) -> list[Block]:
    page = page or ""
    out: list[Block] = []
    stack = [Element("", 0, 0.0, 0.0, 0)]
    open_tags: Counter[str] = Counter()
    pieces: list[str] = []
    linked, in_link, nodes, at, low = 0, False, 0, 0, 1

    def pop(size: int) -> None:
        nonlocal low
        while len(stack) > size:
            open_tags[stack.pop().tag] -= 1
        low = min(low, size)

    def flush() -> None:
        nonlocal linked, low
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                top = stack[-1]
                above = stack[-2].node if len(stack) > 1 else -1
                out.append(Block(text, linked, top.tag, top.support - min(MOST, top.against), top.said, top.node, above, len(stack), low))
                low = len(stack)
            pieces.clear()
        linked = 0

    def push(tag: str, attributes: str) -> None:
        nonlocal nodes
        nodes += 1
        top = stack[-1]
        against, support = _names(attributes, top.support > 0) if attributes else (0.0, 0.0)
        outer, wrapped = top.against, top.wrapped
        if tag in BOILER_TAGS or (tag == "header" and not top.support):
            if tag in WRAP_TAGS and not against:
                wrapped += TELLS
            against = max(against, TELLS)
        elif tag in CONTENT_TAGS and not against:
            support = CLAIMS
        if support and not against:
            outer = 0.0 if tag == "main" else outer - wrapped
            wrapped = 0.0
        says = against or outer != top.against or (support and not top.support)
        stack.append(Element(tag, nodes, outer + against, max(top.support, support), nodes if says else top.said, wrapped))
        open_tags[tag] += 1

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if in_link:
                linked += len(text)

    scanner = Scanner(page)
    while at < len(page):
        m = scanner.after(at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start])
        at, tag = m.end, m.name
        if tag is None:
            say(m.inner)
            continue
        if m.closes:
            if tag == "a":
                in_link = False
            elif tag in CLOSERS:
                flush()
                in_link = False
                if open_tags[tag] > 0:
                    size = len(stack)
                    while stack[size - 1].tag != tag:
                        size -= 1
                    pop(size - 1)
            continue
        if tag in RAW_TAGS:
            end = _end[tag].search(page, at)
            at = end.end() if end else len(page)
        elif tag == "br":
            pieces.append(" ")
        elif tag == "a":
            in_link = True
        elif tag in ("button", "select", "option", "input", "label") or tag in BLOCK_TAGS:
            flush()
            if tag in BLOCK_TAGS or tag in ("button", "select"):
                if stack[-1].tag == "p":
                    pop(len(stack) - 1)
                shut = CLOSED_BY.get(tag)
                while shut and stack[-1].tag in shut:
                    pop(len(stack) - 1)
                if tag not in VOID and not m.attributes.endswith("/"):
                    push(tag, m.attributes)
    flush()
    return _comments(out)


#: Headings over readers' comments, and what stands below each of these, in four languages.
OVER_COMMENTS = re.compile(r"(?:\d+ )?(?:reader |user )?(?:comments?|replies|responses|kommentare?|commentaires?|comentarios?)(?: \(?\d+\)?)?:?|(?:leave|post|write) an? (?:comment|reply):?", re.I)
BELOW_COMMENT = re.compile(r"reply|antworten|répondre|responder", re.I)


def _comments(found: list[Block]) -> list[Block]:
    """found, with what headings and reply links say of readers' comments."""
    under, depth, seen = None, 0, set()
    size = sum(len(b.text) for b in found)
    at: dict[int, list[Block]] = {}
    for b in found:
        at.setdefault(b.node, []).append(b)
        if b.parent != b.node:
            at.setdefault(b.parent, []).append(b)
    for b in found:
        if under is not None and b.low <= depth:
            under = None
        short = len(b.text) < 40
        if short and b.tag[:1] == "h" and b.tag[1:].isdigit() and OVER_COMMENTS.fullmatch(b.text):
            under, depth = b.node, b.depth - 2
        if under is not None:
            b.structure, b.said = min(b.structure, 0.0) - TELLS, -under
        elif short and b.linked and BELOW_COMMENT.fullmatch(b.text):
            # the element that the link is in, or the one above if it has that one for itself; one with most of the page's text is no comment
            unit, said = b.node if len(at[b.node]) > 1 else b.parent, b.said
            if unit not in seen and unit != said and 2 * sum(len(x.text) for x in at[unit]) <= size:
                for x in at[unit]:
                    if x.said == said:
                        x.structure, x.said = x.structure - TELLS, -unit
            seen.add(unit)
    return found


#: Where the fit begins, and what it is drawn to: constant, length, linked share, end mark, under 30 characters, heading, list item, legal or housekeeping phrase, separators.
START = np.array([-0.6, 1.2, -3.5, 1.2, -0.8, 0.4, -0.6, -3.0, -1.5])
#: Phrases of notices, in four languages.
LEGAL = re.compile(r"©|\ball rights reserved\b|\bcopyright\b|\bprivacy policy\b|\bterms of (?:use|service)\b|\bcookies?\b|\bsign (?:in|up)\b|\blog ?in\b|\bsubscribe\b|\btous droits réservés\b|\balle rechte vorbehalten\b|\btodos los derechos reservados\b", re.I)


def look(b: Block) -> list[float]:
    """What the text looks like."""
    n = len(b.text)
    return [
        1.0, math.log1p(n) / 5, min(1.0, b.linked / n), float(b.text[-1] in ".!?:\"'»”"), float(n < 30), float(b.tag[:1] == "h" and b.tag[1:].isdigit()), float(b.tag == "li"),
        float(n < 300 and LEGAL.search(b.text) is not None), min(1.0, sum(map(b.text.count, "|•·›»")) / 3),
    ]


def fit(pages: list[str]) -> np.ndarray:
    """Logistic regression of the structure's verdict on what the text looks like, with a ridge around START."""
    x, y = [], []
    for page in pages:
        for b in blocks_of(page):
            if abs(b.structure) >= CLAIMS:
                x.append(look(b))
                y.append(float(b.structure > 0))
    if not x or len(set(y)) < 2:
        return START.copy()
    a, y = np.array(x), np.array(y)
    w, weight = START.copy(), np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    for _ in range(30):
        p = 1 / (1 + np.exp(-a @ w))
        grad = a.T @ (weight * (p - y)) + 0.02 * (w - START)
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + 0.02 * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    return w


def max_flow(n: int, source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which of n nodes are on the source's side of a minimum cut, the smallest such side; edges hold both ways.

    What can run through a node straight from source to sink is sent first. A node with more excess, or more
    lack, than all its edges carry is on its side in a minimum cut; its edges then are its neighbours' excess
    or lack, which may settle them in turn. Among the nodes that are left the flow runs by level
    graphs: all shortest ways are filled before longer ones are looked for.
    """
    excess = [a - b for a, b in zip(source, sink, strict=True)]
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, c in edges:
        near[a].append((b, c))
        near[b].append((a, c))
    tied = [sum(c for _, c in x) for x in near]
    side: list[bool | None] = [None] * n
    queue = list(range(n))
    while queue:
        k = queue.pop()
        if side[k] is not None or -tied[k] < excess[k] <= tied[k]:
            continue
        side[k] = excess[k] > tied[k]
        for j, c in near[k]:
            if side[j] is None:
                excess[j] += c if side[k] else -c
                tied[j] -= c
                queue.append(j)
    left = [k for k in range(n) if side[k] is None]
    if not left:
        return [bool(x) for x in side]
    to: dict[int, list[int]] = {k: [] for k in left}
    head: list[int] = []
    room: list[float] = []
    for a, b, c in edges:
        if side[a] is None and side[b] is None:
            for x, y in ((a, b), (b, a)):
                to[x].append(len(head))
                head.append(y)
                room.append(c)
    tiny = 1e-12
    while True:
        level = {k: 0 for k in left if excess[k] > tiny}
        queue, reached = list(level), False
        for k in queue:
            reached |= excess[k] < -tiny
            for e in to[k]:
                if room[e] > tiny and head[e] not in level:
                    level[head[e]] = level[k] + 1
                    queue.append(head[e])
        if not reached:
            return [bool(x) if x is not None else k in level for k, x in enumerate(side)]
        tried = dict.fromkeys(level, 0)
        for start in [k for k in left if excess[k] > tiny]:
            path: list[int] = []
            k = start
            while excess[start] > tiny:
                if excess[k] < -tiny:
                    flow = min(excess[start], -excess[k], *(room[e] for e in path))
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    excess[start] -= flow
                    excess[k] += flow
                    path, k = [], start
                    continue
                ways = to[k]
                while tried[k] < len(ways) and not (room[ways[tried[k]]] > tiny and level.get(head[ways[tried[k]]]) == level[k] + 1):
                    tried[k] += 1
                if tried[k] < len(ways):
                    path.append(ways[tried[k]])
                    k = head[path[-1]]
                elif path:
                    k = head[path.pop() ^ 1]
                    tried[k] += 1
                else:
                    break


def label(found: list[Block], weights: np.ndarray) -> tuple[list[bool], list[float]]:
    """Which blocks are content, and each block's own log odds."""
    text = np.clip(np.array([look(b) for b in found]) @ weights, -TEXT_LIMIT, TEXT_LIMIT)
    bare = 0.0 if any(b.structure > 0 for b in found) else BARE
    odds = [float(t) + bare + b.structure for t, b in zip(text, found, strict=True)]
    content = [math.log1p(math.exp(min(30.0, o))) for o in odds]
    boiler = [math.log1p(math.exp(min(30.0, -o))) for o in odds]
    edges, last = [], {}
    for k, b in enumerate(found):
        if k:
            c = NEXT * math.exp(-DECAY * (found[k - 1].depth + b.depth - 2 * b.low))
            edges.append((k - 1, k, c if found[k - 1].said == b.said else ACROSS * c))
        near = last.get(b.parent)
        if near is not None and near != k - 1:
            c = NEAR * math.exp(-2 * DECAY)
            edges.append((near, k, c if found[near].said == b.said else ACROSS * c))
        last[b.parent] = k
    return max_flow(len(found), content, boiler, edges), odds


def extract(page: str | None, weights: np.ndarray) -> str:
    found = blocks_of(page)
    if not found:
        return ""
    return "\n\n".join(b.text for b, s in zip(found, label(found, weights)[0], strict=True) if s)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    # The hashes alone find the sample's edge, so that tasks don't each send SAMPLE_PAGES whole pages.
    hashed = pages.select("html", F.xxhash64("page_id").alias("h"))
    edge = hashed.select("h").orderBy("h").limit(SAMPLE_PAGES).agg(F.max("h")).first()[0]
    sample = hashed.filter(F.col("h") <= F.lit(edge)).orderBy("h", "html").limit(SAMPLE_PAGES)
    weights = fit(sorted(r[0] or "" for r in sample.select("html").collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [extract(x.as_py(), weights) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_mincut_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


QUERIES = {"op8_mincut_extraction": op8_mincut_extraction}
ORACLES: dict[str, str] = {}
