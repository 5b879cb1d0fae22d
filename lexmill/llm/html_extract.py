"""Main text of HTML pages by minimum cut.

A page is read into blocks (text between block-level tags). A linear classifier
on tags, class names, length and links says what it costs to call a block content
or boilerplate: these are the capacities to the two terminals. Neighbours in page
order and blocks that are close in the DOM are joined by edges that cost their
weight if the two ends are labelled differently. The minimum cut is the cheapest
labelling of all blocks together.
"""

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, replace
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexmill.llm.shared import whole_text

# HTML's elements by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr".split()
)
HIDDEN = frozenset(
    "script style head title noscript template iframe object embed svg math canvas audio video map select option optgroup"
    " datalist textarea button input legend dialog noframes".split()
)
P_CLOSERS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr main menu nav ol p pre search section table ul".split()
)
SAME_CLOSERS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
FOREIGN = frozenset("svg math".split())
SCOPES = frozenset("ul ol dl table article section div main body".split())

#: Words in class, id, role and aria-label that speak against and for content.
AGAINST = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu"
    " breadcrumb breadcrumbs sidebar aside side footer foot header masthead topbar toolbar cookie cookies consent gdpr notice"
    " alert popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended"
    " recommendations comment comments reply replies discussion disqus respond widget widgets pager pagination copyright"
    " legal disclaimer search hidden skip contentinfo complementary dialog form teaser tags".split()
)
FOR = frozenset("article content post entry story main text body articlebody maincontent".split())
#: Beside these a name tells of the page around the element, not of the element.
LAYOUT = frozenset("has with no without".split())

#: The classifier: score in favour of content, in units of log odds.
WEIGHTS = {
    "bias": -0.6,
    "article": 3.0,
    "against_tag": -7.0,
    "against_name": -7.0,
    "for_name": 1.5,
    "words": 0.7,
    "links": -3.0,
    "sentence": 0.5,
    "heading": 0.4,
    "paragraph": 0.5,
}
#: Edges: between neighbours in page order, more if they share their parent, and to the next block with the same parent.
ADJACENT, SAME_PARENT, SIBLING = 0.3, 0.5, 0.3
SCALE = 1000


@dataclass(slots=True)
class Place:
    """An open element, and what it and those around it say of their text; made once, from its parent's."""

    tag: str = ""
    number: int = 0
    above: int = 0
    depth: int = 0
    #: Of the nearest element that is not inline: itself, or one around it.
    block_tag: str = ""
    inside: bool = False
    against: bool = False
    form_outside: bool = False
    form_inside: bool = False
    header_inside: bool = False
    paragraph: bool = False
    names: frozenset[str] = frozenset()

    def child(self, tag: str, number: int, names: frozenset[str]) -> "Place":
        names = self.names | names if names else self.names
        if tag in INLINE:
            return replace(self, tag=tag, names=names)
        inside = self.inside or tag in ("article", "main")
        form = tag in ("form", "fieldset")
        header = tag == "header"
        return Place(
            tag,
            number,
            self.number,
            self.depth + 1,
            tag,
            inside,
            # A header around the article is the page's.
            self.against or tag in ("nav", "menu", "footer", "aside", "search") or header and not self.inside,
            # Some pages stand in a form as a whole.
            self.form_outside or form and not inside,
            self.form_inside or form and inside,
            self.header_inside or header and self.inside,
            self.paragraph or tag == "p",
            names,
        )


@dataclass(slots=True)
class Block:
    """One block: its text, its place in the DOM, how much of it is link text, and how deep it and the block before part."""

    text: str
    place: Place
    link_chars: int
    common: int


def _spoken(tag: str, tokens: list[list[str]]) -> frozenset[str]:
    """What the names of an element, each as its words, say about its text.

    Where a whole name says content, compound ones such as ``tag-notice`` do not
    speak against it; only names made of such words alone do.
    """
    words = frozenset(word for token in tokens for word in token)
    if tag in ("html", "body", "main") or words & LAYOUT:
        return frozenset()
    if words & FOR and words & AGAINST <= {"header", "head"}:  # a headline's box
        return words & FOR
    if any(FOR.issuperset(token) for token in tokens):
        whole = [word for token in tokens if AGAINST.issuperset(token) for word in token]
        return words & FOR | frozenset(whole)
    return words & (AGAINST | FOR)


class _Blocks(HTMLParser):
    """Reads a page in one pass; the work on a tag does not grow with the elements around it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[Place] = [Place()]
        self.count: Counter[str] = Counter()
        self.made = self.hidden = self.links = self.link_chars = 0
        # The least depth since the last block: up to there its path and the next one's agree.
        self.least = 0
        self.parts: list[str] = []

    def parse_html_declaration(self, i: int) -> int:
        if self.rawdata.startswith("<![", i):  # in a page that is a comment, whatever it says
            return self.parse_bogus_comment(i)
        return super().parse_html_declaration(i)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            place = self.open[-1]
            self.blocks.append(Block(text, place, self.link_chars, min(self.least, place.depth)))
            self.least = place.depth
        self.parts, self.link_chars = [], 0

    def _pop_to(self, at: int) -> None:
        for place in self.open[at:]:
            self.count[place.tag] -= 1
            self.hidden -= place.tag in HIDDEN
            self.links -= place.tag == "a"
        del self.open[at:]
        self.least = min(self.least, self.open[-1].depth)

    def _close_same(self, tag: str) -> None:
        same = SAME_CLOSERS.get(tag, {"p"} if tag in P_CLOSERS else None)
        if same and any(self.count[other] for other in same):
            for at in range(len(self.open) - 1, 0, -1):
                if self.open[at].tag in same:
                    self._pop_to(at)
                    return
                if self.open[at].tag in SCOPES:
                    return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE:
            self.flush()
            self._close_same(tag)
        if tag == "body":  # whatever was left open in the head is over
            keep = 2 if len(self.open) > 1 and self.open[1].tag == "html" else 1
            self._pop_to(keep)
            self.hidden = 0
        if tag in VOID:
            return
        named = [v.lower() for k, v in attrs if v and k in ("class", "id", "role", "aria-label")]
        tokens = [[w for w in re.split(r"[^a-z]+", token) if w] for value in named for token in value.split()]
        off = any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
        names = _spoken(tag, [t for t in tokens if t]) | (frozenset({"hidden"}) if off else frozenset())
        self.made += 1
        self.count[tag] += 1
        self.open.append(self.open[-1].child(tag, self.made, names))
        self.hidden += tag in HIDDEN
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in FOREIGN:  # these alone may close themselves
            self.flush()
        elif tag in VOID or tag in INLINE:
            self.handle_starttag(tag, attrs)
            if tag not in VOID:
                self.handle_endtag(tag)
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        if tag not in INLINE:
            self.flush()
        if not self.count[tag]:
            return
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                self._pop_to(at)
                return
            if tag in INLINE and self.open[at].tag in SCOPES:
                return

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)
            if self.links:
                self.link_chars += len("".join(data.split()))


def blocks_of(html: str) -> list[Block]:
    """The text blocks of a page, in page order, without scripts, styles, forms and other hidden parts."""
    if "&#" in html:  # numbers too long for any character, which cannot be read as one
        html = re.sub(r"&#0*[1-9][0-9]{7,};?", "\ufffd", re.sub(r"&#0+(?=[0-9])", "&#", html))
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.blocks


def content_score(block: Block) -> float:
    """Log odds that a block is content."""
    w, place = WEIGHTS, block.place
    n = len(block.text.split())
    heading = place.block_tag in ("h1", "h2", "h3")
    against = place.against or (place.form_inside if place.inside else place.form_outside)
    against = against or place.header_inside and not heading  # there it may hold the headline
    names = place.names - {"header", "head"} if place.inside and heading else place.names
    chars = max(1, len("".join(block.text.split())))
    score = w["bias"]
    score += w["article"] * place.inside
    score += w["against_tag"] * against
    score += w["against_name"] * bool(names & AGAINST)
    score += w["for_name"] * bool(names & FOR)
    score += w["words"] * min(3.0, math.log2(1 + n) - 2)
    score += w["links"] * min(1.0, block.link_chars / chars) ** 2
    score += w["sentence"] * (block.text[-1] in ".!?…。」”\"")
    score += w["heading"] * heading
    score += w["paragraph"] * place.paragraph
    return score


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours and between close relatives in the DOM."""
    edges, last = [], {}
    for i, block in enumerate(blocks):
        parent = block.place.above
        if i:
            before = blocks[i - 1].place
            near = block.common / max(block.place.depth, before.depth, 1)
            same = SAME_PARENT if parent == before.above else 0.0
            edges.append((i - 1, i, ADJACENT * (0.5 + near) + same))
        if parent in last and last[parent] != i - 1:
            edges.append((last[parent], i, SIBLING))
        last[parent] = i
    return edges


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's (content) side of a minimum cut.

    A positive score is the capacity from the source, a negative one that to the
    sink. Flow is pushed along shortest paths in level graphs until none is left;
    nodes that the source still reaches are content. Capacities are whole numbers,
    so the result is exact and the same everywhere.
    """
    n = len(scores)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[int] = []
    at: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, ab: int, ba: int) -> None:
        at[a].append(len(to))
        to.append(b)
        room.append(ab)
        at[b].append(len(to))
        to.append(a)
        room.append(ba)

    for i, s in enumerate(scores):
        value = round(s * SCALE)
        if value > 0:
            link(source, i, value, 0)
        elif value < 0:
            link(i, sink, -value, 0)
    for a, b, weight in edges:
        link(a, b, round(weight * SCALE), round(weight * SCALE))
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in at[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(i for i, e in enumerate(path) if not room[e])
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[a] < len(at[a]):
                e = at[a][turn[a]]
                if room[e] and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            else:
                if a == source:
                    break
                e = path.pop()
                a = to[e ^ 1]
                turn[a] += 1
                continue
            path.append(e)
            a = to[e]


def main_text(html: str) -> str:
    """The blocks on the content side, joined by one space.

    Markup that the parser gives up on is read without its tags.
    """
    try:
        blocks = blocks_of(html)
    except (AssertionError, ValueError):
        blocks = blocks_of(re.sub(r"<[!?][^>]*>|&#", " ", html))
    content = min_cut([content_score(b) for b in blocks], smoothness(blocks))
    return " ".join(b.text for b, yes in zip(blocks, content, strict=True) if yes)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Whole pages are read, nothing is cut. Null and empty html give an empty text,
    broken markup is read as far as it goes. Null ids and urls are kept, repeated
    rows come out repeated, an empty table gives an empty result. Further columns
    are not read. Each row is worked on alone, without a shuffle.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", whole_text("html").alias("html"))
    return rows.mapInArrow(compute, "page_id long, url string, text string, n_chars long")
