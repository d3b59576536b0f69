"""Main text of web pages by minimum cut.

A page is a sequence of text blocks in the element tree. A classifier prices each
block: the costs of calling it content or boilerplate are the capacities of its
edges to source and sink. Blocks that follow one another, and blocks of one parent,
are joined by smoothness edges that weaken with the distance in the tree. The
minimum cut is the labelling of least total cost.

The classifier is a logistic regression on how a block is made (length, links,
punctuation, depth, hashes of tags and class names around it). No page comes with
labels, so it is fitted on blocks that tell by themselves what they are: those in
elements named as content (``article``) or as boilerplate (``nav``). Such names
also add evidence of their own, as strong as a few blocks around.
"""

from __future__ import annotations

import html as entities
import math
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.llm.fit import fit_around
from trialframe.llm.store import bounded_batches, lightly, unused
from trialframe.llm.words import text_column

#: Elements that begin and end a block.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose content is never text of the page.
SILENT = frozenset("script style template noscript iframe object svg canvas audio video map textarea button select title".split())
RAW = frozenset(("script", "style", "textarea", "title"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and parts of class names or ids that speak for boilerplate or for content.
BOILER_TAGS = frozenset("nav footer aside form menu dialog head".split())
BOILER_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices overlay paywall popup privacy promo promoted promotion recommended related replies reply responses search share sharing sidebar signup site-footer site-header skip social sponsor sponsored subscribe subscription toolbar topbar widget".split())
CONTENT_TAGS = frozenset(("article", "main"))
CONTENT_WORDS = frozenset("article body content entry main post story text".split())

#: Pages and blocks that the classifier is fitted on at most; taken by the hash of the page and of the block.
FIT_PAGES, FIT_BLOCKS = 500, 20_000
#: Places for hashed tags and class names, and ancestors whose names a block takes.
HASHES, ANCESTORS = 64, 3
#: Evidence of a name that tells content or boilerplate, in log odds; the fitted part counts up to LIMIT either way.
CONTENT, BOILER, LIMIT = 6.0, -8.0, 3.0
#: Capacity of the edge between two blocks of one parent; it halves with each further step in the tree.
EDGE = 1.5
#: The fit starts from these weights (bias, length, links, end of a sentence, marks, depth) and leaves them as far as blocks say.
PRIOR = (-2.4, 0.6, -4.0, 1.0, 0.5, 0.0)
#: What holds them there, for each block of the fit: pages of one make must not teach that their every tag is boilerplate elsewhere.
RIDGE = 0.2

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")
_SCOPE = frozenset("article aside body div footer form header main nav section table td th ul ol dl".split())
_NEVER_BEYOND = frozenset("comment comments footer sidebar nav menu ad ads".split())


@dataclass(slots=True)
class Node:
    """An open element: what its surroundings say, and where it stands among block elements."""

    tag: str
    boiler: bool
    content: bool
    silent: bool
    up: Node | None
    holder: Node | None
    level: int
    bins: frozenset[int]
    parts: bool = False  # whether it has block elements of its own


@dataclass(slots=True)
class Block:
    text: str
    linked: int
    boiler: bool
    content: bool
    holder: Node

    @property
    def parent(self) -> Node:
        """The element whose child the block is; loose text beside block elements is a child like them."""
        return self.holder if self.holder.parts or self.holder.up is None else self.holder.up


def _open(tag: str, attributes: str, up: Node) -> Node:
    names: set[str] = set()
    hidden = False
    for m in _ATTRIBUTE.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "hidden" or (m[1].lower() == "aria-hidden" and value == "true"):
            hidden = hidden or m[1].lower() == "hidden"
        else:
            names.update(_WORD.findall(value))
            names.update(value.split())
    boiler = up.boiler or tag in BOILER_TAGS or (tag == "header" and not up.content) or bool(names & BOILER_WORDS and not (names & CONTENT_WORDS and not names & _NEVER_BEYOND))
    content = up.content or tag in CONTENT_TAGS or bool(names & CONTENT_WORDS and not boiler)
    own = frozenset(zlib.crc32(n.encode()) % HASHES for n in (f"<{tag}>", *names))
    node = Node(tag, boiler, content, up.silent or tag in SILENT or hidden, up.holder, None, up.level, own)
    if tag in BLOCK:
        node.holder, node.level = node, up.level + 1
        up.holder.parts = True
    else:
        node.holder = up.holder
    return node


class _Stack:
    """The open elements, with the places of each tag and of the elements that end a scope."""

    def __init__(self):
        root = Node("", False, False, False, None, None, 0, frozenset())
        root.holder = root
        self.nodes = [root]
        self.at: dict[str, list[int]] = {}
        self.scopes: list[int] = [0]

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in _SCOPE:
            self.scopes.append(len(self.nodes))
        self.nodes.append(node)

    def pop(self) -> Node:
        node = self.nodes.pop()
        self.at[node.tag].pop()
        if node.tag in _SCOPE:
            self.scopes.pop()
        return node

    def holds(self, tag: str) -> bool:
        return bool(self.at.get(tag))

    def in_scope(self, tag: str) -> bool:
        """Whether ``tag`` is open and no scope has begun in it."""
        return self.holds(tag) and self.scopes[-1] <= self.at[tag][-1]

    def close(self, tag: str) -> None:
        while self.pop().tag != tag:
            pass


def read_blocks(page: str) -> list[Block]:
    """The page's text blocks in order; character references decoded, white space single."""
    stack, out = _Stack(), []
    parts: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            last = stack.nodes[-1]
            out.append(Block(text, linked, last.holder.boiler or last.boiler, last.holder.content, last.holder))
        parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not stack.nodes[-1].silent:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if stack.holds("a"):
                linked += len(text.strip())

    at = 0
    while found := _TOKEN.search(page, at):
        say(page[at : found.start()])
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            if stack.holds(tag):
                if tag in BLOCK:
                    close()
                stack.close(tag)
            continue
        if tag in VOID:
            if tag == "br":
                say(" ")
            elif tag in BLOCK:
                close()
            continue
        if tag in BLOCK:
            close()
            for name in _ended_by(tag):
                if stack.in_scope(name):
                    stack.close(name)
        stack.push(_open(tag, found[3], stack.nodes[-1]))
        if found[3].endswith("/") and tag in ("svg", "iframe", "object", "script"):
            stack.pop()
        elif tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            stack.pop()
    say(page[at:])
    close()
    return out


def _ended_by(tag: str) -> tuple[str, ...]:
    """Elements that a new ``tag`` ends without an end tag of their own."""
    if tag in ("li", "option", "tr"):
        return ("p", tag)
    if tag in ("dt", "dd"):
        return ("p", "dt", "dd")
    if tag in ("td", "th"):
        return ("p", "td", "th")
    return ("p",)


def features(block: Block) -> np.ndarray:
    """How the block is made, and which names stand around it."""
    x = np.zeros(len(PRIOR) + HASHES)
    text = block.text
    marks = sum(text.count(m) for m in ".,;:")
    x[: len(PRIOR)] = 1.0, math.log1p(len(text)), min(1.0, block.linked / len(text)), text[-1] in ".!?…\"”", min(1.0, 20 * marks / len(text)), math.log1p(block.holder.level)
    node = block.holder
    for _ in range(1 + ANCESTORS):
        for k in node.bins:
            x[len(PRIOR) + k] = 1.0
        node = node.up
        if node is None:
            break
    return x


def _prior() -> np.ndarray:
    return np.concatenate((PRIOR, np.zeros(HASHES)))


def costs(block: Block, weights: np.ndarray) -> tuple[float, float]:
    """(cost of calling it boilerplate, cost of calling it content): the two logarithmic losses."""
    odds = float(np.clip(features(block) @ weights, -LIMIT, LIMIT)) + (BOILER if block.boiler else CONTENT if block.content else 0.0)
    return float(np.logaddexp(0.0, odds)), float(np.logaddexp(0.0, -odds))


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between blocks that follow one another, by their distance in the tree, and to the last block before with the same parent."""
    edges, last = [], {}
    for k, block in enumerate(blocks):
        sibling = last.get(id(block.parent))
        if k and sibling != k - 1:
            one, two, steps = blocks[k - 1].holder, block.holder, 0
            while one is not two:  # as many steps as elements were closed and opened in between
                if one.level >= two.level:
                    one = one.up
                else:
                    two = two.up
                steps += 1
            if steps < 40:
                edges.append((k - 1, k, EDGE * 0.5 ** max(steps - 2, 0)))
        if sibling is not None:
            edges.append((sibling, k, EDGE))
        last[id(block.parent)] = k
    return edges


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source in the cut of least capacity; with the sink where both are equal.

    Nodes of at most two neighbours are taken out one after another, each leaving
    its best choice for every choice of its neighbours as an edge between them.
    Edges of a page do not cross when its blocks stand in a row, so there always
    is such a node and the time is linear; other graphs that run out of such nodes
    are an error.
    """
    n = len(source)
    price = [[source[i], sink[i]] for i in range(n)]  # [with the sink, with the source]
    near: list[dict[int, list[float]]] = [{} for _ in range(n)]  # tables [00, 01, 10, 11], own side first

    def join(a: int, b: int, table: tuple[float, float, float, float]) -> None:
        if b in near[a]:
            old, back = near[a][b], near[b][a]
            for k, x in enumerate(table):
                old[k] += x
            back[:] = old[0], old[2], old[1], old[3]
        else:
            near[a][b], near[b][a] = list(table), [table[0], table[2], table[1], table[3]]

    for a, b, c in edges:
        if a != b:
            join(a, b, (0.0, c, c, 0.0))
    taken = []
    ready, gone = deque(i for i in range(n) if len(near[i]) <= 2), [False] * n
    while ready:
        v = ready.popleft()
        if gone[v] or len(near[v]) > 2:
            continue
        gone[v] = True
        around = list(near[v].items())
        taken.append((v, price[v], around))
        zero, one = price[v]
        for a, _ in around:
            del near[a][v]
        if len(around) == 1:
            (a, t), = around
            price[a][0] += min(zero + t[0], one + t[2])
            price[a][1] += min(zero + t[1], one + t[3])
        elif around:
            (a, t), (b, u) = around
            join(a, b, tuple(min(zero + t[x] + u[y], one + t[2 + x] + u[2 + y]) for x in (0, 1) for y in (0, 1)))
        ready.extend(a for a, _ in around if len(near[a]) <= 2)
    if len(taken) < n:
        raise ValueError("edges cross")
    side = [0] * n
    for v, (zero, one), around in reversed(taken):
        for a, t in around:
            zero += t[side[a]]
            one += t[2 + side[a]]
        side[v] = int(one < zero - 1e-9)
    return [bool(x) for x in side]


def main_blocks(blocks: list[Block], weights: np.ndarray) -> list[Block]:
    """The blocks that the cut leaves with the content side."""
    priced = [costs(b, weights) for b in blocks]
    stays = minimum_cut([p[0] for p in priced], [p[1] for p in priced], smoothness(blocks))
    return [b for b, s in zip(blocks, stays) if s]


def main_text(page: str, weights: np.ndarray | None = None) -> str:
    """The page's main text; without ``weights``, by those that a fit starts from."""
    return "\n".join(b.text for b in main_blocks(read_blocks(page), _prior() if weights is None else weights))


def learn_blocks(pages: DataFrame, html: str = "html") -> np.ndarray:
    """The classifier's weights, fitted on blocks of at most ``FIT_PAGES`` of ``pages`` that names tell; without such blocks, those it starts from."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in text_column(batch.column(0)).to_pylist():
                known = [b for b in read_blocks(page) if b.boiler or b.content]
                yield pa.record_batch(
                    [pa.array([not b.boiler for b in known], pa.bool_()), pa.array([list(features(b)) for b in known], pa.list_(pa.float64())), pa.array([zlib.crc32(f"{k} {b.text}".encode("utf-8", "replace")) for k, b in enumerate(known)], pa.int64())],
                    ["y", "x", "h"],
                )

    # the pages of the smallest hashes; no page is moved before it is known to be one of them
    rows = pages.select(F.col(html).alias("html"), F.xxhash64(html).alias("k")).where("html is not null")
    last = rows.select("k").distinct().orderBy("k").limit(FIT_PAGES).agg(F.max("k")).first()[0]
    some = rows.where(F.col("k") <= last).groupBy("k").agg(F.first("html").alias("html")).select("html")
    got = some.mapInArrow(measure, "y boolean, x array<double>, h long").orderBy("h", "y", "x").limit(FIT_BLOCKS).toPandas()
    if not len(got):
        return _prior()
    return fit_around(np.stack(got["x"].to_numpy()), got["y"].to_numpy(float), _prior(), ridge=RIDGE * len(got))


def extract_text(pages: DataFrame, html: str = "html", text: str = "text", weights: np.ndarray | None = None) -> DataFrame:
    """``pages`` with the main text of ``html``, blocks joined by line feeds; the classifier is fitted on them unless ``weights`` are given.

    A null or empty page, and one without content, has an empty text; very long and
    deeply nested pages are read whole; repeated rows have repeated texts, and no
    rows give none. A block that both labels would cost the same is left out. A
    column of the name ``text`` is replaced, all others are kept as they are.
    """
    bounded_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(learn_blocks(pages, html) if weights is None else weights)
    names = [n for n in pages.columns if n.lower() != text.lower()]
    own = unused([*names, text], "html")[0]
    schema = pages.select(*names).withColumn(text, F.lit("")).schema

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lightly(batches):
            yield pa.record_batch([*batch.columns[:-1], pa.array([main_text(p, shared.value) for p in text_column(batch.columns[-1]).to_pylist()], pa.string())], [*names, text])

    return pages.select(*names, F.col(html).alias(own)).mapInArrow(extract, schema)
