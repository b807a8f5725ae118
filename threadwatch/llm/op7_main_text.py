"""Main text of HTML pages by minimum-cut labelling.

A page is cut into text blocks.  Each block's classifier cost of being content or
boilerplate becomes a capacity towards the two terminals; neighbouring blocks, and blocks
close in the document tree, are tied by smoothness edges.  The maximum flow's minimum cut
labels all blocks of a page together.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadwatch.llm.words import slices_by_bytes
from threadwatch.session import ship_package

# Elements by what they mean for text blocks.
RAW = "script style title textarea".split()  # no mark-up inside
SKIPPED = set("noscript template svg iframe object math canvas select button audio video".split())
FOREIGN = {"svg", "math"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
STRUCTURE = set("""
html body main article section div nav aside header footer form fieldset p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd
table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary dialog menu hr label legend
center hgroup search
""".split())
#: a start tag that closes an open element of these names, within the nearest container
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
          "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
CLOSES |= {t: {"p"} for t in STRUCTURE - set(CLOSES) - {"label", "caption", "summary"}}
CLOSES["p"] = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
CONTAINERS = set("html body main article section div nav aside header footer form table ul ol dl blockquote".split())

BOILER_TAGS = {"nav": 7.0, "footer": 6.0, "aside": 6.0, "form": 6.0, "menu": 6.0, "dialog": 6.0, "header": 5.0,
               "address": 1.0, "fieldset": 5.0, "label": 4.0, "search": 6.0}
CONTENT_TAGS = {"article": 3.0, "main": 2.0, "p": 1.0, "blockquote": 0.5, "pre": 0.5, "h1": 1.0, "h2": 0.5, "h3": 0.5}
#: name parts of class, id and role
BOILER_NAMES = set("""
ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner cookie cookies consent
gdpr notice notices alert notification sidebar side comment comments discussion disqus respond reply replies menu nav navbar
navigation breadcrumb breadcrumbs footer masthead topbar toolbar related recommended recommendations popular trending share
sharing social newsletter subscribe subscription signup login register search pagination pager widget widgets popup modal
overlay tags copyright legal disclaimer form complementary contentinfo skip teaser outbrain taboola feedback rating
""".split())
CONTENT_NAMES = set("article content main post entry story body text".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*>|<[!?/a-zA-Z][^>]*\Z", re.DOTALL | re.IGNORECASE)
_ENDS = {name: re.compile(rf"</(?:{name})(?:[\s/][^>]*)?>", re.IGNORECASE) for name in [*RAW, "svg|math"]}
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*[\"']?true",
                     re.IGNORECASE)
_PARTS = re.compile(r"[a-z]+|[0-9]+")

ADJACENT = 0.6
CLOSE = 0.8
UNIT = 1000  # capacities are whole numbers of thousandths


class Block:
    __slots__ = ("text", "linked", "path", "benefit", "parent")

    def __init__(self, text: str, linked: int, path: list, parent: int):
        self.text, self.linked, self.path, self.parent = text, linked, path, parent
        self.benefit = 0.0


def tags_of(page: str) -> tuple[list[tuple[int, int, bool, str, str]], dict[int, int]]:
    """Tags as (start, end, closing, name, attributes) and, by a skipped element's start tag, its end tag.

    A raw element goes up to its end tag or the end of the page and counts as one tag.  In
    foreign content, which any structure ends, a raw name has no such power without an end
    tag there.  Comments are tags without a name.
    """
    tags: list[tuple[int, int, bool, str, str]] = []
    ends: dict[int, int] = {}
    waiting: dict[str, list[int]] = {name: [] for name in SKIPPED}
    ahead: dict[str, re.Match | None] = {}
    foreign = at = 0

    def end_of(name: str) -> re.Match | None:
        if name not in ahead or ahead[name] and ahead[name].start() < at:
            ahead[name] = _ENDS[name].search(page, at)
        return ahead[name]

    while m := _TOKEN.search(page, at):
        at = m.end()
        closing, name, rest = bool(m[1] or m[4]), (m[2] or m[5] or "").lower(), m[3] or m[6] or ""
        empty = rest.endswith("/")
        if name in SKIPPED:
            if closing:
                if waiting[name]:
                    ends[waiting[name].pop()] = len(tags)
                if name in FOREIGN:
                    foreign = max(0, foreign - 1)
            elif not (empty and name in FOREIGN):
                waiting[name].append(len(tags))
                foreign += name in FOREIGN
        elif name in RAW and not closing and not (empty and foreign):
            end = end_of(name)
            if foreign:
                out = end_of("svg|math")
                if end and (out is None or end.start() < out.start()):
                    at = end.end()
            else:
                at = end.end() if end else len(page)
        elif name in STRUCTURE and not closing:
            foreign = 0
        tags.append((m.start(), at, closing, name, rest))
    return tags, ends


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order, with the open elements around each (number, tag, names, hidden)."""
    blocks: list[Block] = []
    stack: list[tuple[int, str, frozenset, bool]] = []
    parts: list[str] = []
    state = {"linked": 0, "links": 0, "number": 0}

    def flush():
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append(Block(text, min(state["linked"], len(text)), stack.copy(), stack[-1][0] if stack else 0))
            parts.clear()
        state["linked"] = 0

    def add(text: str):
        if text:
            parts.append(text)
            if state["links"]:
                state["linked"] += len(text.strip())

    at = 0
    tags, ends = tags_of(page)
    for n, (start, end, closing, name, rest) in enumerate(tags):
        if start < at:  # in a skipped element
            continue
        add(page[at:start])
        at = tags[ends[n]][1] if n in ends else end
        if name in ("button", "select", "textarea"):
            flush()
        elif name == "a":
            state["links"] = 0 if closing else 1
        elif name in ("br", "wbr"):
            parts.append(" " if name == "br" else "")
        elif name in STRUCTURE:
            flush()
            state["links"] = 0
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][1] == name:
                        del stack[i:]
                        break
                continue
            closed = CLOSES.get(name, ())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][1] in closed:
                    del stack[i:]
                    break
                if stack[i][1] in CONTAINERS:
                    break
            if name not in VOID and not (rest.endswith("/") and name not in ("p", "div")):
                state["number"] += 1
                names = frozenset(p for t in _NAMES.findall(rest) for p in _PARTS.findall("".join(t).lower())) if rest else \
                    frozenset()
                stack.append((state["number"], name, names, bool(rest and _HIDDEN.search(rest))))
    add(page[at:])
    flush()
    return blocks


def benefit(block: Block) -> float:
    """How much cheaper it is to call the block content than boilerplate (log odds of fixed weights)."""
    n = len(block.text)
    words = block.text.count(" ") + 1
    linked = block.linked / n
    score = -0.8 + 0.8 * math.log1p(min(words, 60) / 6) - 4.0 * linked
    if block.text[-1] in ".!?…\"”»:;":
        score += 0.4
    inside = False
    for _, tag, names, hidden in block.path:
        if hidden:
            score -= 9
        if tag in ("article", "main"):
            inside = True
        weight = BOILER_TAGS.get(tag, 0.0)
        score -= weight * (0.2 if tag == "header" and inside else 1.0)
        if names and tag not in ("html", "body"):
            if names & BOILER_NAMES:
                score -= 2.0 if names & CONTENT_NAMES else 7.0
            elif names & CONTENT_NAMES:
                score += 1.0
    tags = {tag for _, tag, _, _ in block.path}
    score += sum(w for t, w in CONTENT_TAGS.items() if t in tags)
    if block.path and block.path[-1][1] in ("li", "td", "th", "dt") and not inside:
        score -= 1.0
    return score


class Flow:
    """Maximum flow by layered networks (Dinic) over whole-number capacities."""

    def __init__(self, n: int):
        self.edges: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []

    def tie(self, a: int, b: int, forth: int, back: int = 0) -> None:
        self.edges[a].append(len(self.to))
        self.to.append(b)
        self.room.append(forth)
        self.edges[b].append(len(self.to))
        self.to.append(a)
        self.room.append(back)

    def layers(self, source: int) -> list[int]:
        level = [-1] * len(self.edges)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in self.edges[a]:
                b = self.to[e]
                if self.room[e] and level[b] < 0:
                    level[b] = level[a] + 1
                    queue.append(b)
        return level

    def source_side(self, source: int, sink: int) -> list[bool]:
        """Which nodes the source still reaches once the flow is greatest."""
        while True:
            level = self.layers(source)
            if level[sink] < 0:
                return [x >= 0 for x in level]
            at = [0] * len(self.edges)
            path: list[int] = []
            node = source
            while True:
                if node == sink:
                    least = min(self.room[e] for e in path)
                    cut = None
                    for i, e in enumerate(path):
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                        if cut is None and not self.room[e]:
                            cut = i
                    node = self.to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                edges = self.edges[node]
                while at[node] < len(edges):
                    e = edges[at[node]]
                    if self.room[e] and level[self.to[e]] == level[node] + 1:
                        break
                    at[node] += 1
                if at[node] < len(edges):
                    path.append(edges[at[node]])
                    node = self.to[edges[at[node]]]
                elif node == source:
                    break
                else:
                    e = path.pop()
                    node = self.to[e ^ 1]
                    at[node] += 1


def distance(a: Block, b: Block) -> int:
    """Steps between two blocks' elements in the document tree."""
    same = 0
    for x, y in zip(a.path, b.path):
        if x[0] != y[0]:
            break
        same += 1
    return len(a.path) + len(b.path) - 2 * same


def label(blocks: list[Block]) -> list[bool]:
    """Which blocks are content."""
    n = len(blocks)
    flow = Flow(n + 2)
    source, sink = n, n + 1
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        b.benefit = benefit(b)
        size = round(abs(b.benefit) * UNIT)
        if size:
            flow.tie(*((source, i) if b.benefit > 0 else (i, sink)), size)
        if i:
            tie = round(ADJACENT * UNIT / (1 + distance(blocks[i - 1], b)))
            flow.tie(i - 1, i, tie, tie)
        above = b.path[-2][0] if len(b.path) > 1 else 0
        if above in last:  # the block before under the same parent, be it adjacent or not
            tie = round(CLOSE * UNIT / 2)
            flow.tie(last[above], i, tie, tie)
        last[above] = i
    return flow.source_side(source, sink)[:n]


def main_text(page: str | None) -> str:
    blocks = blocks_of(page) if page else []
    if not blocks:
        return ""
    return "\n\n".join(b.text for b, keep in zip(blocks, label(blocks)) if keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices_by_bytes(whole, "_html"):
            texts = [main_text(p) for p in batch.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())],
                                             names=["_row", "text", "n_chars"])


def extract_text(pages: DataFrame, *, html_col: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``carry`` columns, ``text`` and ``n_chars`` (code points), one row per input row.

    Blocks labelled content are joined in page order by two line feeds; white space inside
    a block becomes one space, character references are decoded.  A null or empty page, or
    one without content, has an empty text.  Unclosed and truncated mark-up is taken as far
    as it goes; of skipped elements without an end tag, only the start tag goes.  Ids, null
    or repeated, play no part; a page is handled alone, so no shuffle.

    No labels for pages exist, so the classifier behind the terminal capacities is not
    fitted: its costs are log odds with weights set by hand (``benefit``).
    """
    ship_package(pages.sparkSession)
    rows = pages.select(F.struct(F.lit(0).alias("_"), *carry).alias("_row"), F.col(html_col).cast("string").alias("_html"))
    schema = T.StructType([rows.schema["_row"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(_extract, schema).select(*[F.col("_row")[c].alias(c) for c in carry], "text", "n_chars")


def op7_min_cut_main_text(spark, sf_dir: str) -> DataFrame:
    """Main text of every whole page of ``pages``."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
