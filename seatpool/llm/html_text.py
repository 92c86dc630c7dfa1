"""Main text of pages by minimum-cut labelling of their blocks."""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

# Elements whose content is no text of the page.
_raw = "script|style|noscript|template|textarea|iframe|svg|object|select|canvas|audio|video|math|title"
# Values of attributes may hold tag ends. Only foreign elements can be closed by their own tag.
_attributes = r"""[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*"""
_token = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?!(?:svg|math)(?=[\s/]){_attributes}(?<=/)>)({_raw})(?=[\s/>])(?:{_attributes}|[^>]*)>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*)({_attributes})(?:>|\Z)|<(?:[!?/]|[a-zA-Z])[^>]*(?:>|\Z)",
    re.S | re.I,
)
_attribute = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_space = re.compile(r"\s+")
_unseen = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
# Their text is no text of the page; a block inside ends them, so that one left open swallows nothing.
_CONTROLS = frozenset(("button", "label"))

_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
# Elements that an open one of the second kind ends.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# Costs: positive speaks for main text. A container's cost counts once on the way to a block.
_CONTAINERS = {"article": 3.0, "main": 2.0, "nav": -7.0, "footer": -7.0, "aside": -7.0, "form": -7.0, "menu": -7.0, "dialog": -7.0, "head": -20.0}
_HEADER = -7.0
_BAD = -7.0
_GOOD = 1.0
_bad = re.compile(
    r"\b(?:ad|ads|adv|advert\w*|adbox|adsense|banner\w*|sponsor\w*|promo\w*|cookie\w*|consent\w*|gdpr|notice\w*|alert\w*|"
    r"side-?bar\w*|widget\w*|menu\w*|nav|navbar|navigation|breadcrumb\w*|share|sharing|social\w*|related\w*|recommend\w*|"
    r"comments?|comment-?list|disqus\w*|repl(?:y|ies)|respond|footer\w*|masthead|copyright|newsletter\w*|subscri\w*|popup\w*|"
    r"modal\w*|overlay|login|signup|search\w*|pagination|pager|complementary|contentinfo|toolbar|skip\w*|teaser\w*)\b", re.I
)
_good = re.compile(r"\b(?:article\w*|content|post|entry|story|main|maintext|body-?text|prose)\b", re.I)
_comment = re.compile(r"\b(?:comments?|comment-?list|disqus\w*|repl(?:y|ies)|respond)\b", re.I)
# Parts of a name that say how a page looks around an element, not what the element is.
_around = re.compile(r"(?:^|-)(?:has|with|no|without|not|hide|show)-.*$|^.*-(?:open|opened|closed|enabled|disabled|on|off|visible|ready)$", re.I)
_hump = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_rights = re.compile(r"©|\ball rights reserved\b|\bcopyright\b", re.I)

#: Smoothness between adjacent blocks, halved for each step to their common container, and
#: between a block and the next of the same container.
ADJACENT = 0.8
NEAR = 0.4
#: Characters from which a block with few links counts as prose.
PROSE = 60


@dataclass(slots=True)
class _Node:
    """An element: what its tag and its names say by themselves, and, for all that lies in it,
    characters of prose, characters in an article, and whether a main heading is there."""

    tag: str
    up: _Node | None
    depth: int = 0
    article: bool = False
    anchor: bool = False
    by_tag: float = 0.0
    by_name: float = 0.0
    against: bool = False
    comment: bool = False
    prose: int = 0
    anchored: int = 0
    titled: bool = False
    cost: float = 0.0
    closed: bool = False


@dataclass(slots=True)
class _Block:
    node: _Node
    text: str
    linked: int


@dataclass
class _Reader:
    """Cuts a page into blocks: stretches of text between starts and ends of block elements."""

    blocks: list[_Block] = field(default_factory=list)
    nodes: list[_Node] = field(default_factory=lambda: [_Node("html", None)])
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    links: int = 0
    control: str = ""

    def __post_init__(self) -> None:
        self.node = self.nodes[0]

    def flush(self) -> None:
        if self.pieces:
            text = _space.sub(" ", html.unescape("".join(self.pieces))).strip()
            if text:
                self.blocks.append(_Block(self.node, text, self.linked))
            self.pieces.clear()
        self.linked = 0

    def text(self, value: str) -> None:
        if self.control:
            return
        self.pieces.append(value)
        if self.links:
            self.linked += len(value)

    def start(self, tag: str, rest: str) -> None:
        if tag == "a":
            self.links = 1
        if tag == "br" or tag == "img" or tag == "wbr":
            self.pieces.append("" if tag == "wbr" else " ")
        if tag in _CONTROLS:
            self.control = tag
        if tag not in _BLOCKS:
            return
        self.control = ""
        self.flush()
        node = self.node
        if node.tag == "p":
            node = node.up
        if node.tag in _ENDS.get(tag, ()):
            while node.tag in _ENDS[tag]:
                node = node.up
        if tag == "hr":
            self.node = node
            return
        new = _Node(tag, node, node.depth + 1, node.article or tag in ("article", "main"))
        new.by_tag = _HEADER if tag == "header" and not new.article else _CONTAINERS.get(tag, 0.0)
        new.anchor = node.anchor or new.article
        new.titled = tag == "h1"
        if rest.strip() and tag not in ("body", "html"):
            self.named(new, rest)
        new.comment |= node.comment
        new.against = node.against or new.comment or new.by_tag < 0 and tag != "form"
        self.node = new
        self.nodes.append(new)

    def named(self, node: _Node, rest: str) -> None:
        """What attributes say: an element that is not shown, or names as whole words of its own."""
        for found in _attribute.finditer(rest):
            name, value = found[1].lower(), found[2] or found[3] or found[4] or ""
            if name in ("class", "id", "role"):
                if node.tag == "main":
                    continue
                for word in html.unescape(value).split():
                    word = _around.sub("", _hump.sub("-", word).replace("_", "-"))
                    if _bad.search(word):
                        node.by_name = _BAD
                        node.comment |= _comment.search(word) is not None
                    elif not node.article and _good.search(word):
                        node.by_name = node.by_name or _GOOD
            elif (
                name == "hidden" and value.lower() != "until-found" or name == "aria-hidden" and value.lower() == "true"
                or name == "style" and _unseen.search(value)
            ):
                node.by_tag = min(node.by_tag, _BAD)
        node.anchor = node.anchor or node.by_name > 0

    def end(self, tag: str) -> None:
        if tag == "a":
            self.links = 0
        if tag == self.control:
            self.control = ""
        if tag not in _BLOCKS:
            return
        self.control = ""
        self.flush()
        node = self.node
        while node is not None and node.tag != tag:
            node = node.up
        if node is not None and node.up is not None:
            self.node = node.up


def weigh(nodes: list[_Node], found: list[_Block]) -> None:
    """Costs of elements, from the page down. Names do not speak against an element that holds
    most of the page's prose and all of what lies in articles, nor does being a form if it also
    holds a main heading or an article; comments stay comments."""
    for block in found:
        node, size = block.node, len(block.text)
        if block.linked * 2 < size and not node.against:
            node.prose += size if size >= PROSE else 0
            node.anchored += size if node.anchor else 0
    for node in reversed(nodes):
        if node.up is not None:
            node.up.prose += node.prose
            node.up.anchored += node.anchored
            node.up.titled |= node.titled
    page = nodes[0]
    for node in nodes:
        most = node.prose * 2 > page.prose and node.anchored == page.anchored
        named, tagged = node.by_name, node.by_tag
        if most and not node.comment:
            named = max(named, 0.0)
            if node.tag == "form" and (node.titled or node.anchored):
                tagged = 0.0
        own = min(tagged, named) if named < 0 else tagged if tagged < 0 else max(tagged, named)
        node.closed = own < 0
        node.cost = (node.up.cost if node.up is not None else 0.0) + own


def blocks(page: str) -> list[_Block]:
    reader, at = _Reader(), 0
    for found in _token.finditer(page):
        if found.start() > at:
            reader.text(page[at : found.start()])
        at = found.end()
        tag = found[3]
        if tag is None:
            reader.pieces.append(" ") if found[1] is None or found[1].lower() != "title" else None
        elif found[2]:
            reader.end(tag.lower())
        else:
            reader.start(tag.lower(), found[4])
    if at < len(page):
        reader.text(page[at:])
    reader.flush()
    weigh(reader.nodes, reader.blocks)
    return reader.blocks


def evidence(block: _Block) -> float:
    """Classifier cost of a block: what speaks for main text less what speaks against."""
    size, node = len(block.text), block.node
    density = min(1.0, block.linked / size)
    value = node.cost
    if node.tag in _HEADINGS:
        value += 1.0 if node.tag == "h1" else 0.4
    else:
        value += -0.6 if size < 40 else 0.3 if size < 120 else 1.2
        if node.tag == "p":
            value += 0.6
        if block.text[-1] in ".!?…:;\"'»”":
            value += 0.4
    if density > 0.5 and not (node.article and size > 200):
        value -= 2.5 * density
    if size < 300 and _rights.search(block.text):
        value -= 1.5
    return value


def _holder(block: _Block) -> _Node:
    node = block.node
    return node if node.closed or node.up is None else node.up


def smoothness(found: list[_Block]) -> list[tuple[int, int, float]]:
    """Edges between adjacent blocks, and between a block and the next in the same container.
    Nothing joins a block of an element that is no main text with one outside of it."""
    edges, last = [], {}
    for i, block in enumerate(found):
        holder = _holder(block)
        if i:
            a, b, steps, parted = _holder(found[i - 1]), holder, 0, False
            while a is not b and not parted:
                if a.depth >= b.depth:
                    a, parted = a.up, a.closed
                else:
                    b, parted = b.up, b.closed
                steps += 1
            if not parted:
                edges.append((i - 1, i, ADJACENT / (1 << min(steps, 20))))
        before = last.get(id(holder), i - 1)
        if before < i - 1:
            edges.append((before, i, NEAR))
        last[id(holder)] = i
    return edges


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least total cost: a block against its evidence costs the evidence, two joined
    blocks with different labels cost their edge. Max-flow by shortest augmenting levels from
    the blocks for main text to those against."""
    n = len(costs)
    if all(c > 0 for c in costs) or all(c <= 0 for c in costs):
        return [c > 0 for c in costs]
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, cost in enumerate(costs):
        edge(source, i, cost, 0.0) if cost > 0 else edge(i, sink, -cost, 0.0)
    for a, b, weight in edges:
        edge(a, b, weight, weight)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [v >= 0 for v in level[:n]]
        nexts = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if room[e] <= tiny)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while nexts[a] < len(out[a]):
                e = out[a][nexts[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                nexts[a] += 1
            else:
                if a == source:
                    break
                a = to[path.pop() ^ 1]
                nexts[a] += 1
                continue
            path.append(e)
            a = to[e]


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    labels = minimum_cut([evidence(b) for b in found], smoothness(found))
    return "\n\n".join(b.text for b, label in zip(found, labels) if label)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Character references are decoded, white space in a block is one space, blocks are joined
    by two line feeds. Null and empty pages, and pages without main text, have the empty text.
    Tags cut off at the end of a page are no text, nor is what buttons and labels say. Pages of
    any length are read whole, in time linear in their length up to the cut; an empty table
    gives an empty one. Repeated rows are repeated in the result.
    Other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    schema = T.StructType([
        rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                schema.names,
            )

    return rows.mapInArrow(work, schema)
