"""Main text of web pages by minimum-cut labelling of their blocks.

The text of a page falls into blocks at block-level tags. A logistic score of
each block's markup and wording gives the cost of calling it content or
boilerplate (terminal capacities); neighbours in the page and blocks of one
parent element should rarely differ (smoothness edges). The minimum cut, found
by max-flow, is the labelling of the least total cost.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

# HTML element names and the words that name page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())
MATH = frozenset("annotation annotation-xml maction math menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
INLINE = MATH | frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
FURNITURE = frozenset("nav header footer aside form menu dialog button fieldset head".split())
#: Furniture if they have an end tag: without one, they'd hold the rest of their parent.
UNSHOWN = frozenset("svg template select".split())
CONTENT = frozenset("article main".split())
_HTML = frozenset("article aside blockquote body div dl dd dt footer form h1 h2 h3 h4 h5 h6 header li main nav ol p pre section table ul".split())
_FOREIGN = _HTML | frozenset("b big br center code em embed hr i img menu meta ruby s small span strike strong sub sup tt u var".split())
#: HTML tags that end an open svg, math or select when they start; svg and math hold HTML again inside HOLDERS.
ENDS = {"svg": _FOREIGN, "math": _FOREIGN, "select": _HTML - {"div"}}
HOLDERS = frozenset("foreignobject desc mi mo mn ms mtext annotation-xml".split())
_NAMES = r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice|popup|modal|nav\w*|menu|breadcrumbs?|header|masthead|footer|side-?bar|widget|related|share|social|comments?|replies|respond|disqus|newsletter|subscribe|login|signup|search"
_PARTS = r"area|articles?|bar|block|box|buttons?|container|content|form|inner|items?|lists?|links?|main|outer|panel|posts?|section|site|slot|stories|threads?|top|bottom|left|right|unit|wrap|wrapper|\d+"
#: A class, id or role that is one of the names, alone or with words for a part of a page: NAMED. One that holds a name beside other words only hints at furniture.
NAMED = re.compile(rf"(?:(?:{_PARTS})[-_])*(?:{_NAMES})(?:[-_](?:{_NAMES}|{_PARTS}))*", re.I)
HINT = re.compile(rf"(?<![a-z])(?:{_NAMES})(?![a-z])", re.I)
#: Names of what readers write: they hold for all inside, articles too.
READERS = re.compile(r"(?<![a-z])(?:comments?|replies|respond|disqus)(?![a-z])", re.I)
#: Names of an article's own head, which count for nothing inside one.
HEADS = re.compile(rf"(?:(?:{_PARTS})[-_])*(?:header|masthead)(?:[-_](?:{_PARTS}))*", re.I)
#: Elements of text itself: a name on one inside an article is only a hint.
TEXTUAL = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S)
#: A value is quoted only if a quote comes right after the equals sign; other values may hold quotes.
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*))")
#: An element that ends the listed open ones when it starts.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}}

#: Weights of the block score; above 0 is content. They are set by hand, as log-odds: prose of twenty words and two
#: stops outweighs a link or two; an element of the article outweighs missing prose; furniture and names of it outweigh
#: both. A hint counts as a name outside of article and main; inside it is one soft cost, less than a sentence. A name
#: counts only for what surrounds the article, not for a wrapper of it (see Name).
WEIGHTS = {"bias": 0.3, "words": 0.35, "stops": 0.4, "links": -4.0, "furniture": -8.0, "content": 3.0, "named": -6.0, "hinted": -1.0, "heading": 0.6}
ADJACENT, SIBLING = 0.5, 0.7
#: A wrapper holds so much of the page's prose: text of blocks of so many words that are not mostly links.
WRAPPER_SHARE, PROSE_WORDS = 0.8, 8


@dataclass(eq=False)
class Name:
    """An element with a name of furniture (level 2) or a hint at one (1), and what its subtree holds.

    It is taken for a wrapper of the article, and its name counts for nothing, if
    it holds an article or main element, or WRAPPER_SHARE of the page's prose:
    under a hint at once, under a full name if that is several blocks below a
    heading. Names of reader comments always count.
    """

    level: int
    readers: bool
    article: bool = False
    heading: bool = False
    prose: int = 0
    prose_blocks: int = 0

    def wraps(self, prose: int) -> bool:
        if self.readers:
            return False
        most = prose > 0 and self.prose >= WRAPPER_SHARE * prose
        return self.article or most and (self.level == 1 or self.heading and self.prose_blocks > 1)


@dataclass
class Block:
    """Text of one run between block-level tags, and where it stands."""

    parent: int
    furniture: bool
    content: bool
    #: The names over it, up to the article that it lies in.
    names: tuple[Name, ...]
    heading: bool
    #: 2 under a name of furniture, 1 under a hint at one.
    named: int = 0
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


@dataclass
class _Open:
    tag: str
    number: int
    furniture: bool
    content: bool
    names: tuple[Name, ...]
    #: svg, math or select, if tags are read by its rules here.
    inside: str = ""


def _ended(page: str, tag: str) -> set[int]:
    """Where start tags of this name stand that have an end tag of their own."""
    waiting, out = [], set()
    for m in re.finditer(rf"<(/?){tag}(?=[\s/>])([^>]*)>", page, re.I):
        if not m[1] and not m[2].endswith("/"):
            waiting.append(m.start())
        elif m[1] and waiting:
            out.add(waiting.pop())
    return out


def blocks(page: str) -> list[Block]:
    """The page's blocks in order; scripts, styles, comments and markup leave none."""
    out: list[Block] = []
    root = _Open("", 0, False, False, ())
    stack, count, current, links = [root], 0, None, 0
    at, size = 0, len(page)
    ended: dict[str, set[int]] = {}

    def add(raw: str) -> None:
        nonlocal current
        if current is None:
            if not raw.strip():
                return
            holder = next((e for e in reversed(stack) if e.tag not in INLINE), root)
            top = stack[-1]
            outer = stack[-2].number if holder is stack[-1] and len(stack) > 1 else holder.number
            current = Block(outer, top.furniture, top.content, top.names, holder.tag in ("h1", "h2", "h3", "h4", "h5", "h6"))
            out.append(current)
        current.parts.append(raw)
        if links:
            current.linked += len(raw)

    while at < size:
        found = TOKEN.search(page, at)
        if found is None:
            add(page[at:])
            break
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        if found[2] is None:
            continue
        closing, tag, attributes = found[1], found[2].lower(), found[3]
        inside = stack[-1].inside
        if not closing and tag in ENDS.get(inside, ()):
            while stack[-1].inside:
                links -= stack.pop().tag == "a"
            inside = ""
        foreign = tag in ("svg", "math") or inside in ("svg", "math")
        empty = foreign and attributes.rstrip().endswith("/")
        if tag in RAW and not closing and not empty and not (foreign and tag == "title"):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            if tag not in INLINE:
                current = None
            continue
        if tag not in INLINE:
            current = None
        elif tag == "br" and current is not None:
            current.parts.append(" ")
        if tag in VOID or empty and not closing:
            continue
        if closing:
            place = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if place:
                links -= sum(e.tag == "a" for e in stack[place:])
                del stack[place:]
            continue
        ends = CLOSES.get(tag, ())
        while ends:
            place = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag not in INLINE), 0)
            if not place or stack[place].tag not in ends:
                break
            links -= sum(e.tag == "a" for e in stack[place:])
            del stack[place:]
        above = stack[-1]
        names, content = above.names, above.content
        if "=" in attributes and tag not in ("html", "body"):
            words = " ".join(m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes) if m[1].lower() in ("class", "id", "role")).split()
            readers = any(map(READERS.search, words))
            if content:
                words = [w for w in words if not HEADS.fullmatch(w)]
            full, hinted = any(map(NAMED.fullmatch, words)), any(map(HINT.search, words))
            if hinted and (tag not in CONTENT or readers):
                names = (*names, Name(1 if not full or content and tag in TEXTUAL else 2, readers))
        if tag in CONTENT and not any(n.readers for n in names):
            content = True
            for name in names:
                name.article = True
            names = ()
        hidden = "hidden" in attributes and re.search(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden=.?true", attributes) is not None
        count += 1
        furniture = above.furniture or tag in FURNITURE and not (tag == "header" and above.content) or hidden
        if tag in UNSHOWN and not furniture:
            if tag not in ended:
                ended[tag] = _ended(page, tag)
            furniture = found.start() in ended[tag]
        inside = "" if tag == "template" or inside and tag in HOLDERS else tag if tag in ENDS else above.inside
        stack.append(_Open(tag, count, furniture, content, names, inside))
        links += tag == "a"

    for block in out:
        block.text = " ".join(html.unescape("".join(block.parts)).split())
    out = [b for b in out if b.text]
    _settle(out)
    return out


def _settle(found: list[Block]) -> None:
    """Decide which names count for each block, now that all of the page is known."""
    total = 0
    for block in found:
        prose = len(block.text) if block.text.count(" ") + 1 >= PROSE_WORDS and 2 * block.linked < sum(map(len, block.parts)) and not block.furniture else 0
        total += prose
        for name in block.names:
            name.heading |= block.heading
            name.prose += prose
            name.prose_blocks += prose > 0
    for block in found:
        block.named = max((n.level for n in block.names if not n.wraps(total)), default=0)


def score(block: Block) -> float:
    """Log-odds that a block is content."""
    size = sum(map(len, block.parts))
    words = block.text.count(" ") + 1
    stops = sum(block.text.count(c) for c in ".,;:!?")
    w = WEIGHTS
    return (
        w["bias"] + w["words"] * math.log(words) + w["stops"] * min(stops, 5) / 2 + w["links"] * block.linked / max(size, 1)
        + w["furniture"] * block.furniture + w["content"] * block.content + w["heading"] * block.heading
        + (w["hinted"] if block.named == 1 and block.content else w["named"] * (block.named > 0))
    )


def cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the source's side of a minimum cut; odds above 0 pull there.

    Max-flow by blocking flows: nodes with an excess send it in layers of equal
    distance to nodes with a lack. Edges are few to a node and hold less than
    most nodes want, so flow ends nearby and a few rounds over the page do.
    """
    tiny, n, excess = 1e-12, len(odds), list(odds)
    places: dict[tuple[int, int], int] = {}
    near: list[list[int]] = [[] for _ in odds]
    ends: list[int] = []
    room: list[float] = []
    for a, b, capacity in edges:
        pair = (min(a, b), max(a, b))
        if pair not in places:
            places[pair] = len(ends)
            near[a].append(len(ends))
            near[b].append(len(ends) + 1)
            ends += [b, a]
            room += [0.0, 0.0]
        e = places[pair]
        room[e] += capacity
        room[e + 1] += capacity

    while True:
        layer, depth, found = [-1] * n, 0, False
        sources = front = [i for i, x in enumerate(excess) if x > tiny]
        for i in front:
            layer[i] = 0
        while front and not found:
            depth, after = depth + 1, []
            for i in front:
                for e in near[i]:
                    j = ends[e]
                    if layer[j] < 0 and room[e] > tiny:
                        layer[j] = depth
                        after.append(j)
                        found = found or excess[j] < -tiny
            front = after
        if not found:
            return [x >= 0 for x in layer]
        at = [0] * n
        for source in sources:
            path: list[int] = []
            i = source
            while excess[source] > tiny:
                if excess[i] < -tiny:
                    amount = min(excess[source], -excess[i], *(room[e] for e in path))
                    excess[source] -= amount
                    excess[i] += amount
                    for e in path:
                        room[e] -= amount
                        room[e ^ 1] += amount
                    path, i = [], source
                    continue
                while at[i] < len(near[i]) and not (room[near[i][at[i]]] > tiny and layer[ends[near[i][at[i]]]] == layer[i] + 1):
                    at[i] += 1
                if at[i] < len(near[i]):
                    path.append(near[i][at[i]])
                    i = ends[path[-1]]
                elif path:
                    i = ends[path.pop() ^ 1]
                    at[i] += 1
                else:
                    break


def main_text(page: str | None) -> str:
    """The content blocks of one page, joined by newlines."""
    found = blocks(page or "")
    last: dict[int, int] = {}
    edges = []
    for i, block in enumerate(found):
        if i:
            edges.append((i - 1, i, ADJACENT))
        if block.parent in last:
            edges.append((last[block.parent], i, SIBLING))
        last[block.parent] = i
    kept = cut([score(b) for b in found], edges)
    return "\n".join(b.text for b, k in zip(found, kept, strict=True) if k)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with ``text`` in place of the html column: the main text of every page, whole.

    Null and empty pages, and pages without content, give an empty text; other
    columns stay, but for one that has the text column's name. A page of any
    size is one row's work.
    """
    kept = [c for c in pages.columns if c not in (html_col, text_col)]
    schema = pages.select(*kept).schema.add(text_col, "string")

    def apply(batches):
        for batch in batches:
            texts = pa.array([main_text(p) for p in batch.column(len(kept)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*kept, text_col])

    return pages.select(*kept, html_col).mapInArrow(apply, schema)
