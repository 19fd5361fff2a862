"""Main text of web pages by a minimum cut between content and boilerplate blocks."""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that begin and end a block of text (fixed names of the HTML standard).
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt"
    " fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li"
    " main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
#: Elements whose content is no text of the page.
HIDDEN_TAGS = frozenset(
    "canvas head iframe noscript object script select style svg template textarea title".split()
)
#: Elements whose text is hidden unless it stands in the running text of one of the others.
CONTROL_TAGS = frozenset(["button"])
TEXT_TAGS = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe".split())
BOILER_TAGS = frozenset("aside dialog footer form menu nav".split())
CONTENT_TAGS = frozenset("article main".split())
#: An open element that ends when one of these begins.
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
# Words of class names, ids and roles (fixed values). A name that is one of SIGNS, or ends with
# one, tells of boilerplate; a name that begins with one of FIRST does so less surely; any other
# name with one of them in it, or one of DOUBTFUL, leaves doubt.
SIGNS = frozenset(
    "ad ads advert adverts advertisement advertising alert alerts banner breadcrumb breadcrumbs"
    " comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar"
    " navigation newsletter notice notices notification notifications pager pagination popup promo"
    " promos promotion recommendations recommended related replies share sharing sidebar signup"
    " social sponsor sponsored sponsors subscribe toolbar widget widgets".split()
)
FIRST = frozenset(
    "ad ads advert breadcrumb cookie footer nav newsletter pagination popup promo share sidebar"
    " social sponsor sponsored subscribe widget".split()
)
#: Names that begin so are boilerplate whatever follows: readers wrote what is in them.
READERS = frozenset("comment comments disqus replies".split())
DOUBTFUL = frozenset("bio header login".split())
PHRASES = frozenset(
    "author-bio related-articles related-content related-items related-links related-news"
    " related-posts related-stories".split()
)
CONTENT_NAMES = frozenset(
    "article article-body article-content body-content content content-body entry entry-content"
    " main main-content page-content post post-body post-content story story-body text".split()
)
PARTS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
ATTRIBUTE = re.compile(
    r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""",
    re.I,
)
#: A tag or comment that the end of the page cuts off.
CUT = re.compile(r"<(?:[a-zA-Z/!?][^<]*)?$")
TOKEN = re.compile(
    r"""<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"']|["'])*?)>""",
    re.S,
)
#: Smoothness between blocks next to each other, and between siblings. All edges of a block
#: together outweigh a doubtful name or a short text, but no sure sign.
ADJACENT, SIBLING = 0.75, 1.0
#: Costs of the classifier, as log-odds that a block is content (see ``scores``).
SURE, LIKELY, DOUBT = 9.0, 8.0, 1.5
INSIDE, NAMED, LINKS, TEXT_TAG = 4.0, 2.5, 4.0, 1.0


@dataclass
class Element:
    tag: str
    number: int
    hidden: bool
    signs: float
    content: int
    named: int


@dataclass
class Block:
    """A run of text between two block boundaries, with what the classifier looks at."""

    tag: str
    parent: int
    depth: int
    signs: float
    content: int
    named: int
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def sign_of(name: str) -> float:
    """How much a class name, id or role tells of boilerplate."""
    parts = PARTS.findall(CAMEL.sub("-", name).lower())
    if not parts:
        return 0.0
    whole = "-".join(parts)
    if whole in SIGNS or parts[0] in READERS or whole in PHRASES:
        return SURE
    if len(parts) > 1 and (parts[-1] in SIGNS or parts[0] in FIRST):
        return LIKELY
    return DOUBT if any(x in SIGNS or x in DOUBTFUL for x in parts) else 0.0


def _signs(tag: str, attributes: str) -> tuple[bool, float, bool]:
    """Whether an element is hidden, its signs of boilerplate, and whether its name tells of
    content."""
    hidden, found, named = tag in HIDDEN_TAGS, SURE * (tag in BOILER_TAGS), False
    if attributes and not attributes.isspace():
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or "").strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                hidden = True
            elif name == "style":
                hidden |= "display:none" in value.lower().replace(" ", "")
            elif tag not in ("html", "body", "article", "main"):
                # one element is as much of a sign as its clearest name
                found = max([found, *map(sign_of, value.split())])
                named |= any(v.lower() in CONTENT_NAMES for v in value.split())
    return hidden, found, named


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order. Unclosed and stray tags are borne."""
    stack: list[Element] = []
    out: list[Block] = []
    current: Block | None = None
    number = at = 0
    links = 0

    def flush() -> None:
        nonlocal current
        if current is not None:
            current.text = " ".join(html.unescape("".join(current.pieces)).split())
            if current.text:
                out.append(current)
        current = None

    def add(text: str) -> None:
        nonlocal current
        top = stack[-1] if stack else None
        if not text or top is not None and top.hidden:
            return
        if current is None:
            if text.isspace():
                return
            own = [e for e in stack if e.tag in BLOCK_TAGS]
            tag = own[-1].tag if own else ""
            holder = own[-2].number if len(own) > 1 else 0
            signs, content, named = (top.signs, top.content, top.named) if top else (0.0, 0, 0)
            current = Block(tag, holder, len(own), signs, content, named)
        current.pieces.append(text)
        current.linked += len(text) if links else 0

    def close(place: int) -> None:
        nonlocal links
        links -= sum(e.tag == "a" for e in stack[place:])
        del stack[place:]

    length = len(page)
    end_of_tags = page.rfind(">") + 1
    while at < length:
        m = TOKEN.search(page, at, end_of_tags) if at < end_of_tags else None
        if m is None:
            add(CUT.sub("", page[at:]))
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in BLOCK_TAGS:
            flush()
        if m[1]:
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), None)
            if place is not None and (tag in BLOCK_TAGS or not any(
                e.tag in BLOCK_TAGS for e in stack[place:]
            )):
                close(place)
            continue
        if tag in BLOCK_TAGS:
            if any(e.tag == "p" for e in stack):
                place = max(i for i, e in enumerate(stack) if e.tag == "p")
                if not any(e.tag in BLOCK_TAGS for e in stack[place + 1 :]):
                    close(place)
            ends = CLOSES.get(tag)
            if ends:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag in ends:
                        close(i)
                        break
                    if stack[i].tag in ("ul", "ol", "table", "dl", "select"):
                        break
        if tag == "body":
            close(next((i for i, e in enumerate(stack) if e.tag == "head"), len(stack)))
        if tag in VOID_TAGS or m[3].endswith("/") and tag not in BLOCK_TAGS:
            if tag == "br":
                add(" ")
            continue
        hidden, signs, named = _signs(tag, m[3])
        if tag in CONTROL_TAGS and not any(e.tag in TEXT_TAGS for e in stack):
            hidden = True
        top = stack[-1] if stack else None
        if tag in RAW_TAGS:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else length
            continue
        number += 1
        content = (top.content if top else 0) + (tag in CONTENT_TAGS)
        if tag == "header" and not content:
            signs += SURE
        if tag == "a":
            links += 1
        stack.append(
            Element(
                tag,
                number,
                hidden or bool(top and top.hidden),
                signs + (top.signs if top else 0.0),
                content,
                named + (top.named if top else 0),
            )
        )
    flush()
    return out


def scores(blocks: list[Block]) -> list[float]:
    """Log-odds that a block is content.

    Signs of boilerplate in the elements around a block count against it, and so do links. Where
    a page marks its article, being in it decides unless there are such signs; an element named
    like a content area says less. On a page without marks, long text, a closing full stop and
    headings speak for a block. What is left in doubt goes with its neighbours.
    """
    marked, named = any(b.content for b in blocks), any(b.named for b in blocks)
    out = []
    for b in blocks:
        words = b.text.count(" ") + 1
        density = min(1.0, b.linked / max(1, len(b.text)))
        score = -min(b.signs, 2 * SURE) - LINKS * density
        if marked:
            score += INSIDE if b.content else -INSIDE
        else:
            if named:
                score += NAMED if b.named else -NAMED / 2
            score += min(2.0, words / 10) - 1.0
            score += 0.5 if b.text[-1] in ".!?:;\"'" else -0.5
        if re.fullmatch("h[1-6]|p|pre|blockquote", b.tag):
            score += TEXT_TAG
        out.append(score)
    return out


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours in the page, weaker the further apart they are in the tree,
    and between each block and the next one of the same parent."""
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            before = blocks[i - 1]
            apart = abs(b.depth - before.depth) + (b.parent != before.parent)
            edges.append((i - 1, i, ADJACENT * math.exp(-apart)))
        if (j := last.get(b.parent)) is not None:
            edges.append((j, i, SIBLING))
        last[b.parent] = i
    return edges


def minimum_cut(score: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True where a block is on the content side of a minimum cut.

    A block is tied to the content side by its score if positive, else to the boilerplate
    side; cutting an edge costs its weight. A block whose tie is stronger than all its edges
    together is on its own side in every minimum cut, so its edges become ties of the others;
    the flow runs between the blocks that are left.
    """
    n = len(score)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    tie, side = list(score), [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is None and abs(tie[i]) > sum(near[i].values()):
            side[i] = tie[i] > 0
            for j, w in near[i].items():
                tie[j] += w if side[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    left = [i for i in range(n) if side[i] is None]
    if left:
        reached = _flow(left, tie, near)
        for i in left:
            side[i] = i in reached
    return side


def _flow(nodes: list[int], tie: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes on the source side after a maximum flow along shortest paths."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in nodes}
    room[source], room[sink] = {}, {}
    for i in nodes:
        a, b = (source, i) if tie[i] > 0 else (i, sink)
        room[a][b] = abs(tie[i])
        room[b].setdefault(a, 0.0)
    while True:
        came = {source: source}
        todo = deque([source])
        while todo and sink not in came:
            a = todo.popleft()
            for b, w in room[a].items():
                if w > 1e-9 and b not in came:
                    came[b] = a
                    todo.append(b)
        if sink not in came:
            return set(came) - {source}
        path, b = [], sink
        while b != source:
            path.append((came[b], b))
            b = came[b]
        least = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= least
            room[b][a] = room[b].get(a, 0.0) + least


def main_text(page: str | None) -> str:
    """The content blocks of a page, joined by empty lines; empty if there are none."""
    if not page:
        return ""
    found = blocks_of(page)
    content = minimum_cut(scores(found), smoothness(found))
    return "\n\n".join(b.text for b, c in zip(found, content, strict=True) if c)


def extracted(
    df: DataFrame, html_column: str = "html", text_column: str = "text"
) -> DataFrame:
    """``df`` with the main text of each row's page in ``text_column``.

    Every row is treated alone: repeated rows give the same text, NULL and empty pages an
    empty one, an empty table stays empty. A page of any length is read in one task, and its
    blocks are held there. An existing ``text_column`` is replaced.
    """

    @F.pandas_udf("string")
    def text_of(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            yield batch.map(main_text, na_action=None).astype(object)

    return df.withColumn(text_column, text_of(F.col(html_column)))
