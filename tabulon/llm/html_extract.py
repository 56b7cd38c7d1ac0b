"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with its root-to-leaf tag path; inline
parts are fused with their block's path.  Blocks are aggregated by path: text
outside links and punctuation, a block.  Both ratios are smoothed over the
paths of one container and fused by product, and the paths that reach a share
of the text-weighted mean are content nodes.

What a page says of itself comes first.  Menus, headers, footers, asides, forms,
buttons and elements whose class, id or role names such a thing, an advert, a
notice or a comment list are guards: they don't compete, unless all of the
page's text is in one.  Where there are article or main elements, the article is
what stands in them, however short, their own headers with the title included,
but for paths that the ratios show to be menus: several short blocks made of
links.  Elsewhere the ratios decide: content nodes mark the article's region,
and the other blocks in it (headings, list items, cells) stay.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from tabulon.llm.words import chunks

#: Element names of the HTML standard by role.
RAW = "script style textarea title iframe noembed noframes xmp".split()
HIDDEN = frozenset("head template noscript svg math object canvas select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BOILERPLATE = frozenset("nav header footer aside form button menu dialog".split())
CONTAINERS = frozenset("article main".split())
#: Of these even the only text of a page is no article.
NEVER = re.compile(r"^(?:nav|menu|footer|aside|button|dialog)$|nav|menu|footer|comment|disqus|cookie|consent|\bads?\b|advert|sponsor")
_NAME = r"(?:ads?|adverts?|advertisements?|sponsor(?:ed)?|promo(?:tion)?s?|banner|nav|navbar|navigation|menu|breadcrumbs?|side[_-]?bar|footer|masthead|cookies?|consent|notices?|newsletter|subscribe|popup|modal|comments?|disqus|respond|related|share|sharing|social|complementary|contentinfo|search|widget)"
_BEFORE = r"(?:(?:main|site|global|page|top|bottom|left|right|primary|secondary|sub|reader|user)[_-]+)?"
_BEHIND = r"(?:[_-]+(?:list|items?|box|block|wrap|wrapper|container|section|area|bar|links?|thread|form|unit|slot|posts?|articles?|stories|buttons?|left|right|top|bottom|\d+))*"
#: A class, id or role that marks what isn't the article: whole tokens made of such words, so that 'no-sidebar' or 'page-header' don't count.
NAMED = re.compile(rf"(?:^|\s)({_BEFORE}{_NAME}(?:[_-]+{_NAME})*{_BEHIND}|(?:site[_-]+|global[_-]+)?header)(?:$|\s)")
#: A path is content from this share of the text-weighted mean of the fused ratio.
THRESHOLD = 0.2
#: Menu paths: so many blocks at least, this share of their text in links, and shorter than this on average.
MENU_BLOCKS, MENU_LINKS, MENU_CHARS = 3, 0.8, 40
#: The region of a page without article and main is the smallest element with this share of the content paths' text.
REGION = 0.9
#: A guard is lifted if it holds so many times the text that stands outside all guards; again for guards in guards, until none is.
LIFT = 20
#: Elements deeper than this count as parts of the one at this depth, as in browsers.
DEPTH = 512

_MARK = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_TAG = re.compile(r"[^\s/>]+")
_STOP = re.compile(r""">|=[ \t\n\r\f]*(["'])""")
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}
_NAMES = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_CAMEL = re.compile(r"([a-z])([A-Z])")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？؟،]")
#: An opening tag of the first kind closes an open one of the second, inside the nearest block that holds it.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_FENCE = frozenset("ul ol dl table article main section div body html td th blockquote form nav aside header footer".split())


@dataclass
class Block:
    """One block of text: its tag path and element by number, and whether it is in an article or main element."""

    path: int
    node: int
    scoped: bool
    pieces: list[str] = field(default_factory=list)
    links: int = 0
    text: str = ""


@dataclass
class Page:
    """Blocks outside guards in page order; parents and names of paths; parents of elements; text held by each guard."""

    blocks: list[Block]
    path_parent: list[int]
    path_tag: list[str]
    node_parent: list[int]
    guarded: Counter
    guard_name: dict[int, str]


def _tag_end(page: str, at: int, lost: set[str]) -> int:
    """Place of the '>' that ends a tag, or -1; quotes count right behind '=', and one that is never closed (kept in ``lost``) doesn't."""
    while True:
        m = _STOP.search(page, at)
        if m is None:
            return -1
        if m[0] == ">":
            return m.start()
        at = m.end()
        if m[1] not in lost:
            close = page.find(m[1], at)
            if close < 0:
                lost.add(m[1])
            else:
                at = close + 1


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of each tag; what lies between is text.  Comments and raw elements have an empty name.

    One pass: what was looked at is never looked at again.  A tag that the page
    ends in, an open comment and an open raw element take the rest, as in browsers.
    """
    at, lost, n = 0, set(), len(page)
    while True:
        m = _MARK.search(page, at)
        if m is None:
            return
        start = m.start()
        if m[0] == "<!--":
            end = page.find("-->", start + 2)
            at = n if end < 0 else end + 3
            yield start, at, "", False, ""
        elif m[0] in ("<!", "<?"):
            end = page.find("]]>" if page.startswith("<![CDATA[", start) else ">", m.end())
            at = n if end < 0 else page.find(">", end) + 1
            yield start, at, "", False, ""
        else:
            name = _TAG.match(page, m.end() - 1)
            end = _tag_end(page, name.end(), lost)
            if end < 0:
                yield start, n, "", False, ""
                return
            low, closing = name[0].lower(), m[0][1] == "/"
            at = end + 1
            yield start, at, low, closing, page[name.end() : end]
            if low in _CLOSE and not closing:
                close = _CLOSE[low].search(page, at)
                raw = at
                at = n if close is None else close.start()
                yield raw, at, "", False, ""


def _guard(tag: str, attributes: str, scoped: bool) -> str:
    """What makes an element a guard, or ''; the header of an article is part of it."""
    if tag in BOILERPLATE and not (tag == "header" and scoped):
        return tag
    if attributes and tag not in ("html", "body"):
        for values in _NAMES.findall(attributes):
            found = NAMED.search(_CAMEL.sub(r"\1-\2", "".join(values)).lower())
            if found:
                return found[1]
    return ""


def read_page(page: str, lifted: frozenset[int] = frozenset()) -> Page:
    """Blocks of a page; ``lifted`` are guards, by the number of their tag, that count as plain elements."""
    out = Page([], [-1], [""], [-1], Counter(), {})
    paths: dict[tuple[int, str], int] = {}
    # Of each open element: tag, path, element, guard (number of the outermost), scoped, in a link, hidden.
    stack: list[tuple[str, int, int, int, bool, bool, bool]] = [("", 0, 0, 0, False, False, False)]
    opened: Counter = Counter()
    current: Block | None = None
    at = 0

    def text(upto: int) -> None:
        nonlocal current
        _, path, node, guard, scoped, link, hidden = stack[-1]
        if upto <= at or hidden:
            return
        piece = html.unescape(page[at:upto])
        if guard:
            out.guarded[guard] += len(piece.strip())
            return
        if current is None:
            current = Block(path, node, scoped)
            out.blocks.append(current)
        current.pieces.append(piece)
        if link:
            current.links += len(piece.strip())

    def pop(i: int) -> None:
        for element in stack[i:]:
            opened[element[0]] -= 1
        del stack[i:]

    for number, (start, end, tag, closing, attributes) in enumerate(tags(page), 1):
        text(start)
        at = end
        if not tag:
            continue
        if tag not in INLINE:
            current = None
        if closing:
            if opened[tag] > 0:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        pop(i)
                        break
                    if stack[i][0] in _FENCE and tag not in _FENCE:
                        break
            continue
        if tag in VOID:
            if tag == "br" and current is not None:
                current.pieces.append(" ")
            continue
        closes = _CLOSES.get(tag) or ({"p"} if tag not in INLINE else ())
        if any(opened[c] > 0 for c in closes):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in closes:
                    pop(i)
                    break
                if stack[i][0] in _FENCE:
                    break
        if len(stack) > DEPTH:
            continue
        _, path, node, guard, scoped, link, hidden = stack[-1]
        if not guard and number not in lifted:
            name = _guard(tag, attributes, scoped)
            if name:
                guard, out.guard_name[number] = number, name
        if tag not in INLINE:
            step = (path, tag)
            if step not in paths:
                paths[step] = len(out.path_parent)
                out.path_parent.append(path)
                out.path_tag.append(tag)
            path, node = paths[step], len(out.node_parent)
            out.node_parent.append(stack[-1][2])
        stack.append((tag, path, node, guard, scoped or tag in CONTAINERS, link or tag == "a", hidden or tag in HIDDEN))
        opened[tag] += 1
    text(len(page))
    for block in out.blocks:
        block.text = " ".join("".join(block.pieces).split())
    out.blocks = [b for b in out.blocks if b.text]
    return out


def unguarded(page: str) -> Page:
    """The page with those guards lifted that hold all but a little of its text, such as a form around everything."""
    lifted: frozenset[int] = frozenset()
    found = read_page(page)
    while found.guarded:
        guard, size = max(found.guarded.items(), key=lambda x: (x[1], -x[0]))
        free = sum(len(b.text) for b in found.blocks)
        if size <= LIFT * free or 2 * size <= sum(found.guarded.values()) + free or NEVER.search(found.guard_name[guard]):
            break
        lifted |= {guard}
        found = read_page(page, lifted)
    return found


@dataclass
class PathRatios:
    """Blocks of one path: how many, text outside links and in all, punctuation marks."""

    n: int = 0
    plain: int = 0
    chars: int = 0
    marks: int = 0


def path_ratios(blocks: list[Block]) -> dict[int, PathRatios]:
    out: dict[int, PathRatios] = defaultdict(PathRatios)
    for b in blocks:
        own = out[b.path]
        own.n += 1
        own.chars += len(b.text)
        own.plain += max(0, len(b.text) - b.links)
        own.marks += len(_PUNCTUATION.findall(b.text))
    return out


def content_paths(ratios: dict[int, PathRatios], parent: list[int], threshold: float = THRESHOLD) -> set[int]:
    """Paths whose smoothed and fused ratio reaches the threshold."""
    near: dict[int, PathRatios] = defaultdict(PathRatios)
    for p, own in ratios.items():
        box = near[parent[p]]
        box.n, box.plain, box.marks = box.n + own.n, box.plain + own.plain, box.marks + own.marks
    fused = {}
    for p, own in ratios.items():
        box = near[parent[p]]
        fused[p] = (own.plain / own.n + box.plain / box.n) / 2 * (1 + (own.marks / own.n + box.marks / box.n) / 2)
    total = sum(own.chars for own in ratios.values())
    mean = sum(fused[p] * own.chars for p, own in ratios.items()) / max(total, 1)
    return {p for p, x in fused.items() if x >= threshold * mean}


def _region(found: Page, content: set[int]) -> tuple[int, int]:
    """First and last element number inside the smallest element with most of the content paths' text."""
    n = len(found.node_parent)
    weight, last = [0] * n, list(range(n))
    for b in found.blocks:
        if b.path in content:
            weight[b.node] += len(b.text)
    for node in range(n - 1, 0, -1):
        up = found.node_parent[node]
        weight[up] += weight[node]
        last[up] = max(last[up], last[node])
    top = max(node for node in range(n) if weight[node] >= REGION * weight[0])
    return top, last[top]


def main_text(page: str | None, threshold: float = THRESHOLD) -> str:
    """The article's blocks, white space turned into single blanks, joined by newlines; '' if there is none."""
    found = unguarded(page or "")
    scoped = [b for b in found.blocks if b.scoped]
    pool = scoped or found.blocks
    if not pool:
        return ""
    ratios = path_ratios(pool)
    content = content_paths(ratios, found.path_parent, threshold)

    def menu(path: int) -> bool:
        own = ratios[path]
        return path not in content and own.n >= MENU_BLOCKS and own.chars - own.plain >= MENU_LINKS * own.chars and own.chars < MENU_CHARS * own.n

    menus = {p for p in ratios if menu(p)}
    if scoped:
        return "\n".join(b.text for b in scoped if b.path not in menus)
    first, last = _region(found, content)
    return "\n".join(b.text for b in pool if b.path not in menus and (b.path in content or first <= b.node <= last or found.path_tag[b.path] == "h1"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page; null and empty html give an empty text.

    Each page is read whole and by itself, in time proportional to its length;
    repeated rows give repeated rows and an empty table none.  Only the three
    columns page_id, url and html are read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "html"):
                text = [main_text(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id").cast(pa.int64()), part.column("url"), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return pages.select("page_id", "url", "html").mapInArrow(work, "page_id long, url string, text string, n_chars long")
