"""Main text of web pages by tag-path ratios.

A page becomes text nodes with root-to-leaf tag paths (inline tags but links fold into their block). Per path, characters and
punctuation marks are divided by the number of its nodes; the two ratios are fused (the root of text ratio times
punctuation ratio). Blocks take the fused ratios of their nodes' paths, smoothed with a Gaussian over the page's order, where a
neighbour counts the less the further up the element is that holds both. What a path says by its tags, classes, ids and roles is a
factor of that score (an article or main element, a menu or footer, a sidebar, a link), never more. Paths whose
blocks reach a share of the page's best score are content. The smallest element that holds nearly all of that content (if it is below the
body) is the article: its other blocks are content too unless they score next to nothing, since headings and
list items are short. Nothing in elements such as nav and footer is content.

Only markup, scripts, styles, form controls and the like are no text at all. Defined cases: a null or empty page has the empty text; unclosed and misplaced tags, cut character references and
unended comments or scripts are read as browsers do, as far as blocks are concerned; repeated rows are extracted each; a very long page, and
one of ten thousands of unclosed tags, takes time in proportion to its length;
an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import own_name, read, ship

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|iframe|svg|textarea|select|title)\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S | re.I)
_HINT = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mi mn mo mrow ms mtext q ruby rt rp s samp small span strike strong sub sup time tt u var wbr br img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the left closes an open tag of the right.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPES = frozenset("ul ol dl table article main section div body html nav aside footer header".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")

#: Factors of what an element says of its text: of article and main, of tags that hold no article text, of names that say the same, and of links.
ARTICLE, ASIDE, NAMED, LINK = 12.0, 0.02, 0.1, 0.1
ASIDE_TAGS = frozenset("head nav footer aside form button dialog menu option object canvas audio video".split())
COMMENT_NAMES = frozenset("comment comments comment-list commentlist disqus-thread respond replies".split())
NAMES = COMMENT_NAMES | frozenset("ad ads advert advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal newsletter subscribe subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer related related-posts related-articles related-links recommended share sharing social login search search-form toolbar widget pagination pager copyright complementary contentinfo alert header".split())
NAME_STARTS = ("ad-", "ads-", "advert-", "cookie-", "sidebar-", "comment-", "comments-", "newsletter-", "footer-", "nav-", "menu-", "social-", "share-", "promo-", "sponsor-")
NAME_ENDS = ("-ad", "-ads", "-sidebar", "-comments", "-nav", "-menu", "-footer", "-banner", "-notice", "-newsletter", "-promo", "-breadcrumbs")
#: Spread of the smoothing in blocks, the factor for each level between neighbours, the share of the best score that content reaches, the same
#: inside of the article, and the part of the content that the article holds.
SIGMA, APART, SHARE, LEAST, HELD = 1.0, 0.3, 0.3, 0.03, 0.9


class Path:
    """A tag path, by its last tag and the path above: each path of a page is one object."""

    __slots__ = ("above", "tag", "below")

    def __init__(self, above: Path | None = None, tag: str = ""):
        self.above, self.tag, self.below = above, tag, {}

    def to(self, tag: str) -> Path:
        found = self.below.get(tag)
        if found is None:
            found = self.below[tag] = Path(self, tag)
        return found

    def __str__(self) -> str:
        tags, at = [], self
        while at.above is not None:
            tags.append(at.tag)
            at = at.above
        return "/".join(reversed(tags))


@dataclass(eq=False)
class Node:
    """An element around blocks (no inline one, nor html and body): its number in page order, how many such elements it and those around it are, and the next one around it."""

    number: int
    depth: int
    above: Node | None


@dataclass
class Element:
    tag: str
    path: Path
    node: Node | None = None  # the innermost that is it or around it
    factor: float = 1.0  # of the aside tags and names around its text
    article: bool = False  # within an article or main element, and no aside between
    comment: bool = False
    link: bool = False


@dataclass
class Block:
    nodes: list[tuple[Path, str, float]] = field(default_factory=list)  # path, text, factor
    node: Node | None = None

    def text(self) -> str:
        return " ".join("".join(t for _, t, _ in self.nodes).split())


def named_aside(names: set[str], in_article: bool) -> bool:
    return any((n in NAMES or n.startswith(NAME_STARTS) or n.endswith(NAME_ENDS)) and not (n == "header" and in_article) for n in names)


def element(tag: str, attrs: str, above: Element | None, root: Path, number: int) -> Element:
    e = Element(tag, above.path if above else root)
    if above:
        e.factor, e.article, e.comment, e.node, e.link = above.factor, above.article, above.comment, above.node, above.link
    if tag == "a" or tag not in INLINE:
        e.path, e.link = e.path.to(tag), e.link or tag == "a"
    if tag not in INLINE and tag not in ("html", "body"):
        e.node = Node(number, e.node.depth + 1 if e.node else 1, e.node)
    names = {n.replace("_", "-") for m in _HINT.finditer(attrs) for n in m[1].strip("\"'").lower().split()} if attrs else set()
    if tag in ASIDE_TAGS or tag == "header" and not e.article:
        e.factor, e.article = e.factor * ASIDE, False
    elif names and tag not in ("html", "body") and named_aside(names, e.article) and (tag not in ("article", "main") or names & COMMENT_NAMES):
        e.factor, e.article, e.comment = e.factor * NAMED, False, e.comment or bool(names & COMMENT_NAMES)
    elif tag in ("article", "main") and not e.comment and e.factor > ASIDE:
        e.article, e.factor = True, 1.0
    return e


def blocks_of(page: str) -> list[Block]:
    """The blocks that have text, in page order. Each step looks at the innermost open element of a tag, not at all open elements."""
    done: list[Block] = []
    stack: list[Element] = []
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of each tag
    scopes: list[int] = []  # of the open elements that end the search for one to close
    root = Path()
    block, at, number = Block(), 0, 0

    def flush() -> None:
        nonlocal block
        if any(not t.isspace() for _, t, _ in block.nodes):
            done.append(block)
        block = Block()

    def pop_to(k: int) -> None:
        if any(e.tag not in INLINE for e in stack[k:]):
            flush()
        while len(stack) > k:
            tag = stack.pop().tag
            places[tag].pop()
            if tag in SCOPES:
                scopes.pop()

    def innermost(tags: Iterable[str]) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=-1)

    def text(raw: str) -> None:
        if not raw:
            return
        top = stack[-1] if stack else None
        factor = top.factor * (ARTICLE if top.article else 1.0) * (LINK if top.link else 1.0) if top else 1.0
        if not block.nodes:
            block.node = top.node if top else None
        block.nodes.append((top.path if top else root, unescape(raw), factor))

    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            if places[tag]:
                pop_to(places[tag][-1])
            elif tag not in INLINE:
                flush()
            continue
        if tag not in INLINE:
            flush()
            k = innermost(("p",))
            if k >= 0 and (not scopes or k >= scopes[-1]):
                pop_to(k)
        if tag in CLOSES:
            k = innermost(CLOSES[tag])
            if k >= 0 and (tag == "body" or not scopes or k >= scopes[-1]):
                pop_to(k)
        if tag in VOID:
            if tag == "br":
                text(" ")
            continue
        number += 1
        places[tag].append(len(stack))
        if tag in SCOPES:
            scopes.append(len(stack))
        stack.append(element(tag, m["attrs"] or "", stack[-1] if stack else None, root, number))
    text(page[at:])
    flush()
    return done


def _ratios(blocks: list[Block]) -> dict[Path, tuple[float, float]]:
    chars: dict[Path, int] = defaultdict(int)
    marks: dict[Path, int] = defaultdict(int)
    nodes: dict[Path, int] = defaultdict(int)
    for b in blocks:
        for path, t, _ in b.nodes:
            if t and not t.isspace():
                chars[path] += len(t.strip())
                marks[path] += len(PUNCTUATION.findall(t))
                nodes[path] += 1
    return {p: (chars[p] / n, marks[p] / n) for p, n in nodes.items()}


def ratios_of(blocks: list[Block]) -> dict[str, tuple[float, float]]:
    """Text and punctuation ratio of each tag path: characters and marks by node with text."""
    return {str(p): x for p, x in _ratios(blocks).items()}


def _apart(a: Node | None, b: Node | None) -> int:
    """By how many levels the deeper of two elements is below the one that holds both. Steps are as many as the elements between."""
    deep = max(a.depth if a else 0, b.depth if b else 0)
    while a is not b:
        if b is None or (a is not None and a.depth >= b.depth):
            a = a.above
        else:
            b = b.above
    return deep - (a.depth if a else 0)


def scores_of(blocks: list[Block]) -> np.ndarray:
    """Fused and smoothed ratios of the blocks' paths, times what the paths say."""
    fused = {p: (c * (0.5 + m)) ** 0.5 for p, (c, m) in _ratios(blocks).items()}
    own, factors = np.zeros(len(blocks)), np.ones(len(blocks))
    for k, b in enumerate(blocks):
        weights = np.array([len(t.strip()) for _, t, _ in b.nodes], float)
        own[k] = weights @ np.array([fused.get(p, 0.0) for p, _, _ in b.nodes]) / weights.sum()
        factors[k] = weights @ np.array([f for _, _, f in b.nodes]) / weights.sum()
    sums, total = own.copy(), np.ones(len(blocks))
    around = [b.node.above if b.node else None for b in blocks]
    for gap in (1, 2, 3):
        near = np.exp(-0.5 * (gap / SIGMA) ** 2)
        for k in range(len(blocks) - gap):
            w = near * APART ** _apart(around[k], around[k + gap])
            sums[k] += w * own[k + gap]
            sums[k + gap] += w * own[k]
            total[k] += w
            total[k + gap] += w
    return sums / total * factors


def _held(blocks: list[Block], sizes: np.ndarray, content: np.ndarray) -> dict[Node, int]:
    """The size of the content in each element: handed up from element to element, the later numbers first."""
    held: dict[Node, int] = {}
    for k in np.flatnonzero(content):
        at = blocks[k].node
        if at is not None:
            held[at] = held.get(at, 0) + int(sizes[k])
            while at.above is not None and at.above not in held:
                at = at.above
                held[at] = 0
    for e in sorted(held, key=lambda e: -e.number):
        if e.above is not None:
            held[e.above] += held[e]
    return held


def _inside(blocks: list[Block], article: Node) -> np.ndarray:
    """Whether each block is in an element; what is known of an element is kept."""
    known: dict[Node | None, bool] = {None: False, article: True}
    out = np.zeros(len(blocks), bool)
    for k, b in enumerate(blocks):
        at, way = b.node, []
        while at not in known:
            way.append(at)
            at = at.above
        known.update(dict.fromkeys(way, known[at]))
        out[k] = known[at]
    return out


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    score = scores_of(blocks)
    content = score >= SHARE * score.max()
    sizes = np.array([len(b.text()) for b in blocks])
    held = _held(blocks, sizes, content)
    factors = np.array([max(f for _, t, f in b.nodes if not t.isspace()) for b in blocks])
    enough = [e for e, n in held.items() if n >= HELD * sizes[content].sum()]
    if enough:
        inside = _inside(blocks, max(enough, key=lambda e: (e.depth, e.number)))
        best = factors[content].max()
        content |= inside & ((score >= LEAST * score.max()) & (factors >= LINK * best) | (factors >= best))
    content &= factors > ASIDE
    return "\n".join(t for b, keep in zip(blocks, content.tolist(), strict=True) if keep and (t := b.text()))


def extract(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """pages with text, their main text (text_ if that name is taken)."""
    ship(pages.sparkSession)
    at, name = pages.columns.index(html_col), own_name(pages, "text")
    schema = T.StructType([*pages.schema.fields, T.StructField(name, T.StringType())])

    def run(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in records:
            texts = pa.array([main_text(x.as_py()) for x in record.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*record.columns, texts], names=[*record.schema.names, name])

    return pages.mapInArrow(run, schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
