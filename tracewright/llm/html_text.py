"""Main text of web pages by tree scoring.

A page is cut into blocks: runs of text between block-level tags, each at a node of a light tree (unclosed paragraphs,
list items, cells and options end where HTML says they do; inline elements that are left out don't cut a block).
Elements for menus, headers, footers, asides, forms, scripts, styles and hidden elements are boilerplate. Class and id
words that name such parts count against an element: alone, or beside words of layout only (``site-header``), it is
boilerplate; beside other words (``related-work``), its blocks earn half, and it is kept if it still scores like prose.
A page in which nothing else is left is read again without regard to such names. Every other paragraph-like block of at
least 25 characters earns points, 1 + its commas + up to 3 for length, which its container gets in full, the next
ancestor by half, and the next four by a third of that per level. A container's points are discounted by its link
density. The best container and those of its siblings that score near it, or are plain long paragraphs, are kept with
all their blocks but lists of links that follow no heading (an article's references do). Headings just before the first kept
block stay if they stand in an element around the best container. Names of headings, and ids of paragraphs and list items, say
nothing: they are mostly made of their own words.

Blocks come in page order; character references are decoded, white space inside a block becomes one space, ends are
trimmed, and a line feed joins blocks. Where no block earns points, all remaining blocks are taken.

Edge cases: a null html counts as empty and gives the empty text; broken, cut or plain text input is read as far as it
goes; depth and length are not bounded by recursion; equal scores go to the earlier container; repeated rows give
repeated rows; other columns are kept apart in a struct, and text and n_chars take the place of columns of
that name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, read_table, small_batches, text_or_empty

# A quotation mark opens a value only after an equals sign.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|</>|<(?:[!?]|/[^a-zA-Z>])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>]*))*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}, "body": {"head"},
}
WALLS = frozenset("ul ol dl table div article section main body blockquote td th aside nav header footer form".split())
# Elements, roles and name words of boilerplate.
APART = frozenset("head script style noscript template nav header footer aside form button select textarea iframe object svg canvas menu dialog fieldset search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar aside footer header masthead comment comments respond reply replies disqus cookie cookies consent notice notices popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended recommendations toolbar widget pagination pager skip".split()
)
# Words of layout, which beside a name of boilerplate don't say what else an element is.
LAYOUT = frozenset(
    "site page main primary secondary global top bottom left right upper lower fixed sticky float inner outer wrap wrapper container content box block bar "
    "area section panel row col column columns list items item group slot unit links link post posts article articles story stories body head title text form "
    "feed hub zone wide mini small large mobile desktop hidden js is has no id div root region module component c g l m u".split()
)
PARAGRAPHS = frozenset("p pre td blockquote dd li div section article main figcaption body html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl div section table p".split())
LEAST, SIBLING, LINKS, LEVELS = 25, 0.2, 0.5, 6
#: What an element with a doubtful name must be worth to be kept, and the share of points that its blocks earn.
PROSE, DOUBT = 1.0, 0.5
ENDED = frozenset().union(*ENDS.values())


class Node:
    __slots__ = ("apart", "chars", "depth", "doubt", "inline", "links", "mark", "nested", "points", "tag", "up")

    def __init__(self, tag: str, up: Node | None, apart: bool = False, doubt: bool = False, inline: bool = False):
        self.tag, self.up, self.depth, self.inline, self.nested = tag, up, up.depth + 1 if up else 0, inline, 0
        self.apart = apart or up is not None and up.apart
        # the nearest element, from this one up, with a doubtful name; and the nearest that an end rule looks at
        self.doubt = self if doubt else up.doubt if up else None
        self.mark = self if up is None or tag in WALLS or tag in ENDED else up.mark
        self.points, self.chars, self.links = 0.0, 0, 0


def standing(tag: str, attributes: str, names: bool = True) -> int:
    """2 for boilerplate, 1 for an element with a doubtful name, else 0."""
    if tag in APART:
        return 2
    if not attributes or tag in ("body", "html", "main", "article"):
        return 0
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in ROLES:
        return 2
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return 2
    worst = 0
    # ids of headings, paragraphs and list items are mostly made of their words; a heading's class says as little
    told = "" if tag in HEADINGS else found.get("class", "") if tag in ("p", "li") else found.get("class", "") + " " + found.get("id", "")
    for token in told.split() if names else ():
        words = [w.lower() for w in WORDS.findall(token)]
        if not NAMES.isdisjoint(words):
            worst = max(worst, 2 if all(w in NAMES or w in LAYOUT for w in words) else 1)
    return worst


def blocks_of(html: str, names: bool = True) -> list[tuple[Node, str, int]]:
    """(node, text, characters in links) of each block outside boilerplate, in page order."""
    root = node = Node("html", None)
    opened: dict[str, int] = {}
    out: list[tuple[Node, str, int]] = []
    parts: list[str] = []
    linked, in_link = 0, False

    def block() -> Node:
        n = node
        while n.inline:
            n = n.up
        return n

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text and not (b := block()).apart:
                out.append((b, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not node.apart:
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    def push(n: Node) -> None:
        nonlocal node
        opened[n.tag] = opened.get(n.tag, 0) + 1
        node = n

    def leave(n: Node) -> None:
        """Close n and all that is open in it; the root stays."""
        nonlocal node
        goal = n.up or root
        while node is not goal:
            opened[node.tag] -= 1
            node = node.up

    at, find = 0, TOKEN.search
    while m := find(html, at):
        add(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        layout = tag in BLOCK
        if m[1]:
            if tag == "a":
                in_link = False
            elif tag == "br":
                parts.append(" ")
            if layout:
                flush()
            if opened.get(tag):
                if node.inline and node.tag == tag and node.nested:
                    node.nested -= 1
                    continue
                n = node
                while n.tag != tag:
                    n = n.up
                if layout:
                    in_link = False
                elif n is not node and any_block(node, n):
                    continue  # an inline element's end tag doesn't close the blocks opened in it
                leave(n)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?:[\s/][^>]*)?>", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif tag == "br":
            parts.append(" ")
        elif tag == "hr":
            flush()
        elif tag == "a":
            in_link = True
        elif layout:
            flush()
            in_link = False
            if tag in ("html", "body"):
                if opened.get("head"):
                    n = node
                    while n.tag != "head":
                        n = n.up
                    leave(n)
                continue
            if (b := block()).tag == "p":
                leave(b)
            ends, n = ENDS.get(tag, ()), node.mark
            while ends and n.up is not None and (n.tag in ends or n.tag not in WALLS):
                up = n.up
                if n.tag in ends:
                    leave(n)
                n = up.mark
            judged = standing(tag, m[3], names)
            push(Node(tag, node, judged == 2, judged == 1))
        elif tag in VOID or tag == "svg" and m[3].endswith("/"):
            continue
        elif node.inline and node.tag == tag:
            node.nested += 1
        elif tag in APART or m[3] and standing(tag, m[3], names) == 2:
            push(Node(tag, node, True, False, True))
    add(html[at:])
    flush()
    return out


def any_block(node: Node, top: Node) -> bool:
    """Whether a block stands between node and its ancestor top."""
    while node is not top:
        if not node.inline:
            return True
        node = node.up
    return False


def value(n: Node) -> float:
    return n.points * (1 - n.links / n.chars) if n.chars else 0.0


def under_headings(blocks: list[tuple[Node, str, int]]) -> set[int]:
    """Lists whose first block follows a heading of the element that they are in: an article's references, say, rather than a menu."""
    out: set[int] = set()
    for (before, _, _), (node, _, _) in zip(blocks, blocks[1:], strict=False):
        if before.tag in HEADINGS:
            n, lists = node, []
            while n.up is not None and n.depth > before.up.depth:
                if n.tag in LISTS:
                    lists.append(id(n))
                n = n.up
            if n is before.up:
                out.update(lists)
    return out


def main_text(html: str, names: bool = True) -> str:
    blocks = blocks_of(html, names)
    scored: dict[int, Node] = {}
    nodes: dict[int, Node] = {}
    for node, text, links in blocks:
        node.chars += len(text)
        node.links += links
        n = node
        while n is not None and id(n) not in nodes:
            nodes[id(n)] = n
            n = n.up
        if node.tag in PARAGRAPHS and len(text) >= LEAST:
            points = (1 + text.count(",") + min(len(text) // 100, 3)) * (1 - links / len(text)) * (DOUBT if node.doubt else 1)
            n, level = (node if node.tag not in ("p", "pre", "li", "dd", "td", "figcaption") else node.up), 0
            while n is not None and level < LEVELS:
                n.points += points / (1, 2)[level] if level < 2 else points / (3 * level)
                scored[id(n)] = n
                n, level = n.up, level + 1
    for n in sorted(nodes.values(), key=lambda n: -n.depth):
        if n.up is not None:
            n.up.chars += n.chars
            n.up.links += n.links
    if not scored:
        return "\n".join(text for _, text, _ in blocks) or (main_text(html, False) if names else "")
    best = max(scored.values(), key=value)
    bar = max(10.0, SIBLING * value(best))
    chosen: dict[int, bool] = {}
    headed = under_headings(blocks)

    def kept(node: Node) -> bool:
        """Whether a block at node is of the best container or a kept sibling, and not in a list of links or a doubtful part."""
        trail, n, answer = [], node, None
        while n is not None and answer is None:
            answer = chosen.get(id(n))
            if answer is None:
                trail.append(n)
                if n is best:
                    answer = True
                elif n.doubt is n and value(n) < PROSE:
                    answer = False
                elif n is not node and n.up is best.up and n.up is not None and value(n) >= bar:
                    answer = True
                elif n.up is best.up and n.up is not None:
                    answer = value(n) >= bar or (n.tag == "p" and n.chars > 80 and n.links / n.chars < 0.25)
                elif n.up is None:
                    answer = False
                elif n.tag in LISTS and n.chars and n.links / n.chars > LINKS and n.links > 1 and id(n) not in headed:
                    answer = False
                n = n.up
        for n in trail:
            chosen[id(n)] = bool(answer)
        return bool(answer)

    keep = [kept(node) for node, _, _ in blocks]
    first = keep.index(True) if True in keep else 0
    over, n = set(), best.up
    while n is not None:
        over.add(id(n))
        n = n.up
    while first and (node := blocks[first - 1][0]).tag in HEADINGS and node.doubt is None and id(node.up) in over:
        first -= 1
        keep[first] = True
    return "\n".join(text for (_, text, _), k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame, columns: list, html: str = "html") -> DataFrame:
    """columns (of pages) with text and n_chars."""
    picked = small_batches(pages).select(F.struct(*columns).alias("row"), text_or_empty(html).alias("html"))
    row = picked.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["row", "text", "n_chars"])

    return beside(picked.mapInArrow(run, f"row {row}, text string, n_chars bigint"), "text", "n_chars")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"), ["page_id", "url"])
