"""Main-text extraction by minimum-cut labelling.

A page becomes a sequence of text blocks. A classifier over structure and text features gives each
block the log-odds of being content, which become a capacity to the content or to the boilerplate
terminal. Neighbouring blocks, blocks of one DOM container, and containers within one another are
tied by smoothness edges. The minimum cut (maximum flow) then separates content from boilerplate,
so a short line within an article stays, and a sentence within a link list goes.

The classifier is a logistic regression, fitted once on the driver to labelled pages that
``page_samples`` makes up: the same parts of pages as semantic elements, with telling names, and
with foreign or no names, so that no feature decides alone.

Each page is worked on by itself, so nothing is shuffled, and the work is linear in the blocks:
a container is one auxiliary node, never all pairs of its blocks.

Defined cases: null or empty html gives an empty text and 0 characters; unclosed elements,
truncated pages and broken references are read as browsers read them; repeated rows stay
repeated; an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

import functools
import html as _html
import math
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_MARK = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*+|[^<>]*+)(?:>|(?=<)|\Z)""", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_RAW = frozenset("script style noscript template textarea svg iframe object canvas math select title".split())
#: Of these, the ones that an absent end tag lets run to the end of the page.
_ENDLESS = frozenset("script style textarea iframe title".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_ITEM = frozenset("li td th dd dt option summary figcaption".split())
#: A start tag of the key ends an open element of the value.
_ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_BOILER_TAG = frozenset("nav menu footer aside form button dialog label fieldset head header".split())
_INSERT_WORD = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising comment comments discussion disqus promo promoted promotion related replies reply respond responses sponsor sponsored teaser".split()
)
_BOILER_WORD = frozenset(
    "alert banner breadcrumb breadcrumbs byline consent cookie cookies copyright dialog disclaimer footer form gdpr header hidden login masthead menu menubar modal nav navbar navigation navigator newsletter "
    "notice notices notification pagination pager popular popup rail recommended search share sharing sidebar sidenav signup skip social subnav subscribe subscription tags toolbar topbar topnav trending widget widgets".split()
)
_BOILER_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
_CONTENT_WORD = frozenset("article articlebody body content entry main post story text".split())
#: Words of names that say nothing of what is inside; the word before them is what a name is about.
_PLAIN_WORD = frozenset("area bar block bottom box col column container first group inner item items last left list outer page panel right row section site slot top unit wrap wrapper zone".split())
#: Words of interfaces, for the share of them in a block's text.
_PANEL_WORD = frozenset(
    "about accept account agb alle all anmelden archive blog cart cookies contact consent copyright datenschutz email facebook follow help home impressum imprint instagram kontakt legal log login "
    "mehr menu more newsletter next policy preferences previous privacy register reply reserved rights rss search settings share shop sign sitemap startseite subscribe suche support teilen terms twitter "
    "accueil confidentialité connexion mentions partager rechercher recherche réservés vorbehalten weiter zurück".split()
)
#: What smoothness costs: a cut between neighbours in one container and across containers, between a block and its container, between containers.
NEXT_TO, NEXT_ACROSS, SAME_CONTAINER, WITHIN = 0.8, 0.2, 0.8, 0.4
#: Log-odds are limited to this; hidden blocks have its negative.
MOST = 12.0


class _Frame:
    """An open element and what it and its ancestors say: of boilerplate by structure, by names of inserts and of layout, and of content; its container."""

    __slots__ = ("content", "hidden", "insert", "key", "layout", "structure", "tag")

    def __init__(self, tag: str, said: tuple[int, int, int, int, int], key: int):
        self.tag, self.key = tag, key
        self.structure, self.insert, self.layout, self.content, self.hidden = said

    @property
    def said(self) -> tuple[int, int, int, int, int]:
        return self.structure, self.insert, self.layout, self.content, self.hidden


def _named(value: str) -> list[tuple[str, bool]]:
    """The words of class or id names, and whether each is what its name is about: the last word that is not a plain one."""
    out = []
    for name in value.split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        about = next((i for i in range(len(words) - 1, -1, -1) if words[i] not in _PLAIN_WORD), -1)
        out += [(w, i == about) for i, w in enumerate(words)]
    return out


def _judge(tag: str, attrs: str, up: _Frame) -> tuple[int, int, int, int, int]:
    """What an element says (structure, insert, layout, content, hidden), with what its ancestors say.

    Levels are 0 (nothing), 1 (a word of a name), 2 (what a name is about), content also 3 (an
    article or main element). Names of layouts ("with-sidebar") may stand on wrappers of a whole
    page, so an article or main element within ends what they say; names of comments, adverts and
    the like hold inside too.
    """
    structure, insert, layout, content, hidden = up.said
    whole = tag == "article" or tag == "main"
    if whole:
        content, layout = 3, 0
    elif tag in _BOILER_TAG and not (tag == "header" and content >= 3):
        structure = 1
    if "=" in attrs or "hidden" in attrs:
        words: list[tuple[str, bool]] = []
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), (a or b or c).lower()
            if name in ("class", "id", "itemprop"):
                words += _named(value)
            elif name == "role":
                structure = max(structure, int(value in _BOILER_ROLE))
                content = 3 if value in ("main", "article") else content
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) or name == "aria-hidden" and value == "true":
                hidden = 1
        if re.search(r"(?:^|\s)hidden(?:\s|$|=)", attrs):
            hidden = 1
        if tag not in ("html", "body") and words:
            level = lambda known: max((2 if about else 1 for w, about in words if w in known), default=0)
            own = level(_CONTENT_WORD)
            if own or content >= 3:
                words = [(w, about) for w, about in words if w != "header"]  # an article's own head
            insert = max(insert, level(_INSERT_WORD))
            if not whole:
                layout = max(layout, level(_BOILER_WORD))
            content = max(content, own)
    return structure, insert, layout, content, hidden


class Block(NamedTuple):
    """A run of text between block elements, in page order."""

    text: str
    said: tuple[int, int, int, int, int]
    container: int
    linked: float  # share of the text in links
    heading: bool
    item: bool


def blocks_of(page: str) -> tuple[list[Block], list[int]]:
    """The blocks of a page, and the container that each container is in."""
    found: list[Block] = []
    stack = [_Frame("", (0, 0, 0, 0, 0), 0)]
    within = [0]
    links, heading = 0, False
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join(_html.unescape("".join(text)).split())
            if whole:
                top = stack[-1]
                found.append(Block(whole, top.said, top.key, min(1.0, linked / len(whole)), heading, top.tag in _ITEM))
            text.clear()
        linked = 0

    at, n = 0, len(page)
    while at < n:
        m = _MARK.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            linked += len(piece) if links else 0
        at = max(m.end(), m.start() + 1)
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if not m[1]:
            if tag in _RAW:
                if m[0].endswith("/>") and tag in ("svg", "math"):
                    continue
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
                if not end and tag not in _ENDLESS:
                    continue
                at = end.end() if end else n
                if tag == "textarea" or tag == "title":
                    flush()
                continue
            if tag in _BLOCK:
                flush()
                if tag in _VOID:
                    continue
                heading = len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"
                ends = _ENDS.get(tag)
                if stack[-1].tag == "p" or ends and stack[-1].tag in ends:
                    stack.pop()
                if ends and stack[-1].tag in ends:
                    stack.pop()
            elif tag in _VOID:
                continue
            elif tag == "a":
                links = 1
                continue
            elif tag not in _BOILER_TAG and not ("=" in m[3] and ("class" in m[3] or "id" in m[3] or "hidden" in m[3] or "style" in m[3])):
                continue
            said = _judge(tag, m[3], stack[-1])
            same = said[:3] == stack[-1].said[:3]
            if tag not in _BLOCK and same:
                continue
            if tag not in _BLOCK:
                flush()
            # a paragraph, item or heading belongs to the container around it
            own = tag in ("p", "li", "td", "th", "tr", "br", "dd", "dt") or len(tag) == 2 and tag[0] == "h"
            if not own or not same:
                key = len(within)
                within.append(stack[-1].key)
            else:
                key = stack[-1].key
            stack.append(_Frame(tag, said, key))
        else:
            if tag == "a":
                links = 0
                continue
            if tag in _BLOCK:
                flush()
                heading = False
            depth = len(stack) - 1
            while depth and stack[depth].tag != tag:
                if tag not in _BLOCK and stack[depth].tag in _BLOCK:
                    depth = 0
                    break
                depth -= 1
            if depth:
                flush()
                del stack[depth:]
    flush()
    return found, within


WIDTH = 22


def described(blocks: list[Block]) -> list[list[float]]:
    """Features of the blocks of one page."""
    per: dict[int, list[float]] = {}
    sizes = [b.text.count(" ") + 1 for b in blocks]
    for b, n in zip(blocks, sizes, strict=True):
        sums = per.setdefault(b.container, [0.0, 0.0, 0.0])
        sums[0] += n
        sums[1] += b.linked * n
        sums[2] += 1
    out = []
    for i, (b, n) in enumerate(zip(blocks, sizes, strict=True)):
        structure, insert, layout, content, _ = b.said
        words, links, count = per[b.container]
        around = [sizes[k] for k in range(max(0, i - 2), min(len(blocks), i + 3))]
        panel = sum(w.strip(".,:;!?|()") in _PANEL_WORD for w in b.text.lower().split()) / n if n <= 40 else 0.0
        out.append([
            1.0, min(2.0, 0.5 * math.log1p(n)), b.linked, links / words, min(2.0, 0.5 * math.log1p(words / count)), min(2.0, 0.5 * math.log1p(sum(around) / len(around))),
            float(b.text[-1] in ".!?:;\"')"), min(1.0, 10 * (b.text.count(",") + b.text.count(". ")) / n), float(b.heading), float(b.item), panel, float(panel > 0.3),
            float("©" in b.text or "copyright" in b.text.lower()), float(structure), float(insert == 1), float(insert == 2), float(layout == 1), float(layout == 2), float(content == 1), float(content == 2), float(content == 3),
            float(len(blocks) < 6),
        ])
    return out


@functools.cache
def learned(pages: int = 1500) -> tuple[float, ...]:
    """Weights of the features: a ridge logistic regression on made-up pages, by Newton's method."""
    from semaloom.llm import page_samples

    x, y = [], []
    for page in page_samples.pages(pages):
        blocks, labels = page_samples.labelled(page)
        x += described(blocks)
        y += labels
    xs, ys, w = np.array(x), np.array(y, np.float64), np.zeros(WIDTH)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(xs @ w, -30, 30)))
        step = np.linalg.solve((xs * (p * (1 - p))[:, None]).T @ xs + np.eye(WIDTH), xs.T @ (ys - p) - w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(w)


def costs_of(blocks: list[Block], weights: tuple[float, ...]) -> list[float]:
    """Log-odds of being content."""
    odds = (np.array(described(blocks)) @ np.array(weights)).tolist()
    return [-MOST if b.said[4] else max(-MOST, min(MOST, o)) for b, o in zip(blocks, odds, strict=True)]


def min_cut(costs: list[float], edges: list[tuple[int, int, float]], nodes: int) -> list[bool]:
    """Which of the first len(costs) nodes stay on the content side of a minimum cut.

    ``costs`` are signed terminal capacities, ``edges`` are undirected with a capacity, and nodes
    beyond ``len(costs)`` are auxiliary. Dinic's algorithm with iterative searches.
    """
    if all(c > 0 for c in costs):
        return [True] * len(costs)
    if all(c <= 0 for c in costs):
        return [False] * len(costs)
    source, sink = nodes, nodes + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(nodes + 2)]

    def edge(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(forth)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, c in enumerate(costs):
        if c > 0:
            edge(source, i, c, 0.0)
        elif c < 0:
            edge(i, sink, -c, 0.0)
    for a, b, c in edges:
        edge(a, b, c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (nodes + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(len(costs))]
        nxt = [0] * (nodes + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(cap[e] for e in path)
                first = 0
                for k, e in enumerate(path):
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                for k, e in enumerate(path):
                    if cap[e] <= tiny:
                        first = k
                        break
                a = to[path[first] ^ 1]
                del path[first:]
                continue
            moved = False
            while nxt[a] < len(out[a]):
                e = out[a][nxt[a]]
                if cap[e] > tiny and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                    moved = True
                    break
                nxt[a] += 1
            if not moved:
                if not path:
                    break
                e = path.pop()
                a = to[e ^ 1]
                nxt[a] += 1


def content_of(blocks: list[Block], within: list[int], weights: tuple[float, ...]) -> list[bool]:
    """Which blocks the minimum cut leaves with the content."""
    nodes = len(blocks)
    edges: list[tuple[int, int, float]] = []
    groups: dict[int, int] = {}
    for i, b in enumerate(blocks):
        chain = [b.container]
        while chain[-1] and within[chain[-1]] not in groups:
            chain.append(within[chain[-1]])
        for c in reversed(chain):
            if c not in groups:
                groups[c] = nodes
                nodes += 1
                if c:
                    edges.append((groups[c], groups[within[c]], WITHIN))
        if i and blocks[i - 1].said[:3] == b.said[:3]:
            edges.append((i - 1, i, NEXT_TO if blocks[i - 1].container == b.container else NEXT_ACROSS))
        edges.append((i, groups[b.container], SAME_CONTAINER))
    return min_cut(costs_of(blocks, weights), edges, nodes)


def main_text(page: str | None, weights: tuple[float, ...] | None = None) -> str:
    """The main text of one page; empty for null, empty or text-free pages."""
    if not page:
        return ""
    blocks, within = blocks_of(page)
    if not blocks:
        return ""
    keep = content_of(blocks, within, weights or learned())
    return " ".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) per page."""
    weights = learned()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # a bounded piece of pages in memory at a time
                part = batch.slice(at, 256)
                texts = [main_text(x, weights) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[key, url, "text", "n_chars"]
                )

    rows = pages.select(key, url, html)
    kind = dict(rows.dtypes)
    return rows.mapInArrow(work, f"`{key}` {kind[key]}, `{url}` {kind[url]}, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
