"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks at block-level tags.  A linear classifier scores each block from
the elements around it, the words that name them, its share of link text, its length and its
punctuation.  Elements that say what they are weigh much; the rest weighs as much as the
smoothness edges, so that the cut decides it.  The score becomes a capacity to the source (content) or to the sink
(boilerplate).  Smoothness edges join neighbours on the page and blocks of one container;
they weigh less the farther apart two blocks are in the document tree.  The minimum cut is
the labelling with the least total cost, so a doubtful block goes with its surroundings and
a clear one stands for itself.

Pages are independent: one Arrow-batched pass, no shuffle.  A page's graph has a few edges
per block, and flow crosses only where labels change, so the work is linear in practice.

Signs of other parts do not count on what wraps the page: ``html`` and ``body``, the first
``main`` (else ``article``) itself, an article that is most of it, and elements that hold it and more than half of the
page's text.  On a page with neither, a wrapper holds a heading of first level, ``nav``,
``header`` or ``footer`` and more than half of the text; a form may hold a container named
as content instead.  Below a wrapper the nearer element decides as anywhere else.

Kept text: character references are decoded, white space within a block (``<br>`` too) is
one blank, blocks are joined in page order by a line break.  Scripts, styles, comments and
other raw elements are never text.

Edge cases: a null or empty page has an empty text; unclosed and stray tags are tolerated; a
page without any content block has an empty text; repeated rows give repeated results; other
columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import deque
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.common import map_batches

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title|svg|math|iframe|object|textarea|select|canvas|audio|video)\b(?:[^>"']|"[^"]*"|'[^']*')*(?:/>|>.*?(?:</\1\s*>|\Z))|<(/?)([a-z][a-z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-z][a-z0-9:-]*)([^>]*)>|<[!?][^>]*>""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([a-z_:-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

#: Elements by their part in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
OUTSIDE = frozenset("nav footer aside form button menu dialog fieldset head".split())
INSIDE = frozenset("article main".split())
#: Class, id and role words of parts that are not the article; a star stands for any ending.
OUTSIDE_WORDS = "ad ads advert* adsense sponsor* promo promot* banner* cookie* consent gdpr notice* notification* popup modal overlay newsletter* subscri* share sharing social related recommend* sidebar* sidenav menu* nav navbar navigation breadcrumb* footer foot masthead topbar toolbar comment* disqus replies respond login signin signup register search searchform widget* pagination pager copyright legal disclaimer alert* skip toc complementary contentinfo".split()
#: Of these, the ones that are subjects of articles too: in an ``id``, which may be a heading's slug, they are a hint only.
SUBJECTS = "consent gdpr notice* notification* social search login signin signup register copyright legal disclaimer alert* replies respond related share sharing complementary".split()
#: Words that say where a part is or what holds it; beside them a word of another part says what the part is.
STRUCTURE = frozenset("site page global top bottom left right primary secondary outer inner wrap wrapper container area section block panel box bar list item items links link buttons button icons row col column group holder region".split())
#: Elements whose class, id and role name a part of the page; on others a class is a hint.
CONTAINERS = frozenset("html body div section aside nav header footer main article form ul ol dl table tbody tr td details center figure fieldset menu dialog".split())
#: Before these, the words of a class say what the page has around the element, not what the element is.
MODIFIERS = frozenset("has no not with without".split())
LANDMARKS = frozenset("h1 nav header footer".split())
INSIDE_WORDS = "article post entry story content main body text prose".split()

#: Weights of the classifier, in nats; above zero is content.
WEIGHTS = {
    "bias": -1.5,
    "outside": -14.0,
    "outside_word": -12.0,
    "outside_hint": -2.0,
    "page_header": -14.0,
    "hidden": -14.0,
    "inside": 6.0,
    "inside_word": 1.5,
    "paragraph": 0.8,
    "heading": 0.4,
    "list_item": -0.2,
    "link_share": -3.0,
    "per_log_char": 0.35,
    "sentence": 0.9,
    "boilerplate_phrase": -1.5,
}
_PHRASE = re.compile(r"©|\(c\)\s*\d{4}|all rights reserved|cookies?|subscribe|sign up|log ?in|advertisement|sponsored|privacy policy|terms of (?:use|service)", re.I)
NEIGHBOUR, CONTAINER = 1.5, 0.8


def _matcher(words: list[str]) -> re.Pattern:
    return re.compile("|".join(re.escape(w[:-1]) + r"\w*" if w.endswith("*") else re.escape(w) for w in words))


_OUT, _IN, _SUBJECT = _matcher(OUTSIDE_WORDS), _matcher(INSIDE_WORDS), _matcher(SUBJECTS)


@dataclass
class Block:
    text: str
    links: int
    tag: str
    path: tuple[int, ...]
    score: float = 0.0
    title: bool = False


@dataclass(eq=False)
class _Open:
    tag: str
    number: int
    outside: bool = False
    outside_word: bool = False
    outside_hint: bool = False
    inside: bool = False
    inside_word: bool = False
    header: bool = False
    hidden: bool = False
    begun: bool = False
    chars: int = 0
    core: bool = False
    landmark: bool = False
    content: bool = False

    def unwrap(self, has_core: bool, total: int) -> None:
        """Forget signs of other parts on an element that wraps the page."""
        holds = self.core if has_core else self.landmark or (self.tag == "form" and self.content)
        if self.tag in ("html", "body") or (self.core and self.inside) or (holds and 2 * self.chars > total):
            self.outside_word = self.outside_hint = False
            self.outside &= self.tag != "form"
            self.header &= self.tag == "header"


def _named(made: _Open, attribute: str, parts: list[str]) -> None:
    """What one token of a class, id or role says of an element.

    A token of nothing but words of other parts, structure and content names the part; one
    that has other words too, an id of a subject, and a class of a paragraph only hint at it.
    """
    if not parts or parts[0] in MODIFIERS:
        return
    out = [p for p in parts if _OUT.fullmatch(p)]
    made.inside_word |= any(_IN.fullmatch(p) for p in parts)
    if made.tag in CONTAINERS:
        made.header |= "header" in parts and not made.inside_word
    if not out or made.inside:
        return
    plain = all(p in out or p in STRUCTURE or p.isdigit() or _IN.fullmatch(p) for p in parts)
    if made.tag in CONTAINERS and plain and not (attribute == "id" and all(_SUBJECT.fullmatch(p) for p in out)):
        made.outside_word = True
    elif made.tag in CONTAINERS or (attribute == "class" and plain):
        made.outside_hint = True


def _opened(tag: str, attributes: str, number: int) -> _Open:
    made = _Open(tag, number, outside=tag in OUTSIDE, inside=tag in INSIDE, header=tag == "header")
    if attributes.strip(" /"):
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or "").strip("\"'")
            if name in ("class", "id", "role"):
                for token in value.split():
                    _named(made, name, [p.lower() for p in _PART.findall(token)])
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                made.hidden = True
    return made


def blocks(page: str) -> list[Block]:
    """The page's runs of text between block-level tags, with the numbers of the elements around them."""
    stack: list[_Open] = []
    out: list[Block] = []
    pieces: list[str] = []
    around: list[tuple[_Open, ...]] = []
    signs: list[_Open] = []
    cores: dict[str, list[_Open]] = {}
    links = number = at = total = 0

    def close() -> None:
        nonlocal links, total
        text = " ".join("".join(pieces).split())
        if text:
            total += len(text)
            for o in stack:
                o.begun = True
                o.chars += len(text)
            container = [o for o in stack if o.tag not in INLINE]
            tag = container[-1].tag if container else ""
            out.append(Block(text, links, tag, tuple(o.number for o in container)))
            around.append(tuple(stack))
        pieces.clear()
        links = 0

    for m in _TAG.finditer(page):
        if m.start() > at:
            text = html.unescape(page[at : m.start()])
            pieces.append(text)
            if any(o.tag == "a" for o in stack):
                links += len(text)
        at = m.end()
        tag, closes, attributes = (m[3] or m[6] or "").lower(), m[2] or m[5], m[4] or m[7] or ""
        if not tag:
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag not in INLINE:
            close()
        if closes:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                # a stray end tag of a small element does not close the part of the page it is in
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
        elif tag not in VOID and not attributes.endswith("/"):
            if tag in CLOSES_P or tag == "li":
                own = "li" if tag == "li" else "p"
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag == own:
                        del stack[k:]
                        break
                    if stack[k].tag not in INLINE:
                        break
            number += 1
            element = _opened(tag, attributes, number)
            # an article's own header opens it; one in its midst, or outside it, is a part of the page
            element.header &= not any(o.inside and not o.begun for o in stack)
            if tag in LANDMARKS:
                for o in reversed(stack):
                    if o.landmark:
                        break
                    o.landmark = True
            if element.inside_word and not element.outside_word:
                for o in reversed(stack):
                    if o.content:
                        break
                    o.content = True
            stack.append(element)
            if element.inside and tag not in cores:
                cores[tag] = stack[:]
            if element.outside or element.outside_word or element.outside_hint or element.header:
                signs.append(element)
    if at < len(page):
        pieces.append(html.unescape(page[at:]))
    close()
    core, article = cores.get("main") or cores.get("article") or [], cores.get("article") or []
    # an article that makes up most of main is a part of the way down
    if core and article[: len(core)] == core and 2 * article[-1].chars > core[-1].chars:
        core = article
    for o in core:
        o.core = True
    for o in signs:
        o.unwrap(bool(core), total)
    _free_title(out, around)
    for block, elements in zip(out, around):
        block.score = _score(block, elements)
    return out


def _free_title(found: list[Block], around: list[tuple[_Open, ...]]) -> None:
    """A page header's only first heading is the article's title where the article begins without a heading."""
    core = next((i for i, elements in enumerate(around) if any(o.inside for o in elements)), None)
    tops = [i for i, block in enumerate(found) if block.tag == "h1"]
    if core is None or len(tops) != 1 or tops[0] >= core or found[core].tag in ("h1", "h2", "h3"):
        return
    elements = around[tops[0]]
    if any(o.tag == "header" for o in elements) and not any(o.outside or o.outside_word or o.hidden for o in elements):
        found[tops[0]].title = True




def _score(block: Block, stack: tuple[_Open, ...]) -> float:
    w = WEIGHTS
    inside = any(o.inside for o in stack)
    score = w["bias"] + w["per_log_char"] * min(7.0, len(block.text).bit_length())
    score += w["outside"] * any(o.outside for o in stack) + w["outside_word"] * any(o.outside_word for o in stack) + w["hidden"] * any(o.hidden for o in stack)
    score += w["outside_hint"] * any(o.outside_hint for o in stack)
    score += w["inside"] if block.title else w["page_header"] * any(o.header for o in stack)
    score += w["inside"] * inside + w["inside_word"] * any(o.inside_word for o in stack)
    tag = block.tag
    score += w["paragraph"] * (tag in ("p", "blockquote", "pre")) + w["heading"] * (tag in ("h1", "h2", "h3")) + w["list_item"] * (tag == "li")
    score += w["link_share"] * min(1.0, block.links / len(block.text))
    score += w["sentence"] * bool(re.search(r"[.!?…][\"'”’)]*(?:\s|$)", block.text))
    if len(block.text) < 200 and _PHRASE.search(block.text):
        score += w["boilerplate_phrase"]
    return score


def proximity(a: tuple[int, ...], b: tuple[int, ...]) -> float:
    """One over one plus the steps between two containers in the tree."""
    shared = 0
    for x, y in zip(a, b):
        if x != y:
            break
        shared += 1
    return 1.0 / (1 + len(a) + len(b) - 2 * shared)


@dataclass
class FlowGraph:
    """Residual capacities of a flow network; minimum_cut() follows shortest augmenting paths by levels."""

    n: int
    to: list[int] = field(default_factory=list)
    left: list[float] = field(default_factory=list)
    arcs: list[list[int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.arcs = [[] for _ in range(self.n)]

    def edge(self, a: int, b: int, forward: float, backward: float = 0.0) -> None:
        self.arcs[a].append(len(self.to))
        self.to.append(b)
        self.left.append(forward)
        self.arcs[b].append(len(self.to))
        self.to.append(a)
        self.left.append(backward)

    def _levels(self, source: int) -> list[int]:
        level = [-1] * self.n
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in self.arcs[a]:
                if self.left[e] > 1e-12 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        return level

    def minimum_cut(self, source: int, sink: int) -> list[bool]:
        """Which nodes stay on the source's side."""
        while (level := self._levels(source))[sink] >= 0:
            spot = [0] * self.n
            path: list[int] = []
            a = source
            while True:
                if a == sink:
                    flow = min(self.left[e] for e in path)
                    for e in path:
                        self.left[e] -= flow
                        self.left[e ^ 1] += flow
                    path, a = [], source
                    continue
                while spot[a] < len(self.arcs[a]):
                    e = self.arcs[a][spot[a]]
                    if self.left[e] > 1e-12 and level[self.to[e]] == level[a] + 1:
                        break
                    spot[a] += 1
                else:
                    if not path:
                        break
                    a = self.to[path.pop() ^ 1]
                    spot[a] += 1
                    continue
                path.append(e)
                a = self.to[e]
        return [x >= 0 for x in level]


def smoothness(found: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours and between successive blocks of one container."""
    edges = [(i, i + 1, NEIGHBOUR * proximity(found[i].path[:-1], found[i + 1].path[:-1])) for i in range(len(found) - 1)]
    last: dict[int, int] = {}
    for i, block in enumerate(found):
        for k, node in enumerate(block.path[-3:-1]):
            if node in last and last[node] < i - 1:
                edges.append((last[node], i, CONTAINER / (2 - k)))
            last[node] = i
    return edges


def labels(found: list[Block]) -> list[bool]:
    """True for each content block: the labelling of least cost."""
    n = len(found)
    graph = FlowGraph(n + 2)
    for i, block in enumerate(found):
        if block.score >= 0:
            graph.edge(n, i, block.score)
        else:
            graph.edge(i, n + 1, -block.score)
    for a, b, weight in smoothness(found):
        graph.edge(a, b, weight, weight)
    return graph.minimum_cut(n, n + 1)[:n]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, labels(found)) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(page) for page in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_batches(rows, run, T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
