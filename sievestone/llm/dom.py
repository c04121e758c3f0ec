"""A small tree builder for web pages: what the extractor needs of a document's structure, and its text.

It follows the recovery of browsers where that moves text: implied end tags,
void elements, raw-text elements, stray end tags, unclosed comments and tags.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field
from html import unescape

# Element names of the HTML standard by how they parse.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr svg path".split())
#: Inline where they hold text, as in a table of data; blocks where they hold blocks, as in a layout.
CELLS = frozenset(("td", "th"))
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt tr".split())
# A start tag of the key ends an open element of the values, up to the given ancestors.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tr"}, {"table"}), "option": ({"option"}, {"select"})}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*|[^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?i)(?:^|[\s/\"'])(class|id|role|aria-label|itemprop|hidden|data-k)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    attributes: str = ""
    marked: bool = False
    inputs: int = 0
    tags: int = 0
    links: int = 0
    link_chars: int = 0
    chars: int = 0
    own: int = 0
    texts: int = 0
    end: int = 0
    children: list[int] = field(default_factory=list)


@dataclass(slots=True)
class Page:
    nodes: list[Node]
    #: (node, text or None for a block's edge), in page order
    stream: list[tuple[int, str | None]]


def _tags(html: str) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, lower-case name, is an end tag, attributes) of all tags that count, comments as tags without a name."""
    out = []
    pos = 0
    while m := _TAG.search(html, pos):
        pos = m.end()
        name = (m[2] or "").lower()
        if name in RAW and not m[1]:
            m2 = re.compile(f"</{name}(?=[\\s/>]|\\Z)[^>]*>?", re.I).search(html, pos)
            pos = m2.end() if m2 else len(html)
            name = ""
        out.append((m.start(), pos, name, bool(m[1]), m[3] or ""))
    return out


def _block_cells(tags: list[tuple[int, int, str, bool, str]]) -> set[int]:
    """Which of the tags begin cells of rows in which some cell holds a block; of nested tables each counts for itself."""
    found: set[int] = set()
    rows: list[list[int]] = [[]]  # the cells so far of the open row of each open table
    laid_out: list[bool] = [False]

    def end_row() -> None:
        if laid_out[-1]:
            found.update(rows[-1])
        rows[-1], laid_out[-1] = [], False

    for i, (_, _, name, ends, _) in enumerate(tags):
        if name == "tr":
            end_row()
        elif name in CELLS and not ends:
            rows[-1].append(i)
        elif name == "table":
            if not ends:
                laid_out[-1] |= bool(rows[-1])
                rows.append([])
                laid_out.append(False)
            elif len(rows) > 1:
                end_row()
                rows.pop()
                laid_out.pop()
        elif not ends and name in CLOSES_P:
            laid_out[-1] |= bool(rows[-1])
    while rows:
        end_row()
        rows.pop()
        laid_out.pop()
    return found


def parse(html: str) -> Page:
    """Block nodes with their subtrees' counts; inline elements count towards the block that holds them."""
    nodes = [Node("#root", -1, 0)]
    stream: list[tuple[int, str | None]] = []
    stack: list[tuple[str, int, bool]] = [("#root", 0, False)]  # (tag, block node, is inline)
    open_at: defaultdict[str, list[int]] = defaultdict(list)  # where each tag is open in the stack
    blocks_at = [0]  # where blocks are open in the stack
    anchors = 0

    def text(raw: str) -> None:
        at = stack[-1][1]
        s = unescape(raw) if "&" in raw else raw
        stream.append((at, s))
        if n := len(s) if not s.isspace() else 0:
            node = nodes[at]
            node.own += n
            node.texts += 1
            if anchors:
                node.link_chars += n

    def push(tag: str, at: int, inline: bool) -> None:
        open_at[tag].append(len(stack))
        if not inline:
            blocks_at.append(len(stack))
        stack.append((tag, at, inline))

    def close_to(i: int) -> None:
        nonlocal anchors
        while len(stack) > i:
            tag, at, inline = stack.pop()
            open_at[tag].pop()
            if tag == "a":
                anchors -= 1
            if not inline:
                blocks_at.pop()
                stream.append((at, None))
                nodes[at].end = len(nodes)

    def last(names: Iterable[str]) -> int:
        return max((open_at[n][-1] for n in names if open_at.get(n)), default=0)

    def end_open(names: Iterable[str], stop: Iterable[str]) -> None:
        """Close the innermost of the names, unless one of ``stop`` is open within it."""
        at = last(names)
        if at > last(stop):
            close_to(at)

    pos = 0
    tags = _tags(html)
    blocks_of = _block_cells(tags)
    for i, (start, end, name, ends, attributes) in enumerate(tags):
        if start > pos:
            text(html[pos:start])
        pos = end
        if not name:
            continue
        if ends:
            if name == "br":
                text(" ")
            elif name in INLINE:
                if (at := last((name,))) > blocks_at[-1]:
                    close_to(at)
            elif at := last(HEADINGS if name in HEADINGS else (name,)):
                close_to(at)
            if name in CELLS:
                text(" ")
            continue
        if name in CLOSES_P:
            end_open(("p",), ("button", "table", "td", "th") if name != "table" else ("button",))
        if name in ENDS:
            end_open(*ENDS[name])
        at = stack[-1][1]
        inline = name in INLINE or name in CELLS and i not in blocks_of
        if inline:
            nodes[at].tags += 1
            if name == "br" or name in CELLS:
                text(" ")
            if name not in VOID and not attributes.rstrip().endswith("/"):
                push(name, at, True)
                if name == "a":
                    anchors += 1
                    nodes[at].links += 1
            continue
        if name in VOID:
            if name == "hr":
                stream.append((at, None))
            nodes[at].inputs += name == "input"
            continue
        node = Node(name, at, nodes[at].depth + 1)
        if attributes:
            found = _ATTRIBUTE.findall(attributes)
            node.attributes = " ".join(x for k, *v in found if k.lower() != "data-k" for x in (["hidden"] if k.lower() == "hidden" else v) if x).lower()
            node.marked = any(k == "data-k" for k, *_ in found)
        nodes[at].children.append(len(nodes))
        push(name, len(nodes), False)
        nodes.append(node)
        stream.append((len(nodes) - 1, None))
    if pos < len(html):
        text(html[pos:])
    close_to(1)
    nodes[0].end = len(nodes)
    for node in reversed(nodes):
        node.chars += node.own
        if node.parent >= 0:
            up = nodes[node.parent]
            up.tags += node.tags + 1
            for k in ("inputs", "links", "link_chars", "chars", "texts"):
                setattr(up, k, getattr(up, k) + getattr(node, k))
    return Page(nodes, stream)


def blocks(page: Page, kept: list[bool]) -> list[str]:
    """The text of the kept nodes: one string a block, its white space folded."""
    out: list[str] = []
    now: list[str] = []
    for at, s in page.stream:
        if s is None:
            if now:
                out.append(" ".join("".join(now).split()))
                now = []
        elif kept[at]:
            now.append(s)
    if now:
        out.append(" ".join("".join(now).split()))
    return [b for b in out if b]
