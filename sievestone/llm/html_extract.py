"""Operator 8: main text of web pages by boosted trees over their nodes.

Every block node gets features of its subtree's density, attribute tokens (its
own and its ancestors'), depth and siblings; boosted trees give the log-odds
that it belongs to the main text. Decoding is hierarchical: the best consistent
choice keeps a node only below kept ancestors and drops all below a dropped
one. The trees learn from ``TRAINING_PAGES`` generated pages of many layouts,
whose main text is known.

Defined results: null, empty or text-free pages give an empty text; a page
without markup is one block; null urls are kept; repeated rows are extracted
alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import boosting
from .common import in_arrow, pick, table
from .dom import Page, blocks, parse

TRAINING_PAGES = 800
#: Nodes that are scored at a time.
NODES_A_BATCH = 20_000
TAGS = "nav header footer aside form article main section div p h1 h2 h3 ul ol li table blockquote pre figure figcaption body button td tr".split()
# Words in class, id and role attributes that tell parts of a page, by part.
TOKENS = {
    "main": "article content post entry story main body text page-content prose",
    "menu": "nav menu breadcrumb navbar navigation toc pagination pager skip tabs",
    "head": "header masthead banner topbar top-bar logo branding hero",
    "foot": "footer copyright legal colophon bottom contentinfo imprint",
    "side": "sidebar aside widget related recommend recommended more-stories trending popular complementary rail secondary",
    "talk": "comment comments reply replies discussion respond disqus reviews feedback",
    "ads": "ad ads advert advertisement sponsor sponsored promo promoted adsense adbox commercial outbrain taboola",
    "note": "cookie cookies notice consent alert gdpr newsletter subscribe popup modal overlay warning paywall toast signup hidden",
    "ask": "form search login contact-form searchform",
    "share": "share social sharing follow tags byline meta print",
}
_GROUP = {w: i for i, ws in enumerate(TOKENS.values()) for w in ws.split()}
_TAG = {t: i for i, t in enumerate(TAGS)}
#: Tags that count when they stand above a node.
OUTER = "nav header footer aside form article main ul li".split()


def _groups(attributes: str) -> int:
    """A bit for each part that the attribute tokens name, whole or as a piece between - and _."""
    found = 0
    for token in attributes.split():
        for piece in {token, *token.replace("_", "-").split("-")}:
            if (g := _GROUP.get(piece)) is None:
                g = _GROUP.get(piece.rstrip("s"))
            if g is not None:
                found |= 1 << g
    return found


def node_features(page: Page) -> np.ndarray:
    nodes = page.nodes
    whole = max(1, nodes[0].chars)
    rows = []
    codes = []
    above = [(0, 0)] * len(nodes)  # attribute parts and tags of the ancestors
    before = 0
    own_groups = [_groups(n.attributes) if n.attributes else 0 for n in nodes]
    alike = Counter((n.parent, n.tag) for n in nodes[1:])
    paragraphs = [0] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        paragraphs[i] += nodes[i].tag == "p"
        paragraphs[nodes[i].parent] += paragraphs[i]
    for i, n in enumerate(nodes):
        if i:
            up, tags = above[n.parent]
            t = _TAG.get(nodes[n.parent].tag)
            above[i] = (up | own_groups[n.parent], tags | (1 << t if t is not None else 0))
        siblings = nodes[n.parent].children if i else [0]
        parent = nodes[n.parent] if i else n
        up, tags = above[i]
        codes.append((_TAG.get(n.tag, -1), own_groups[i], up, tags))
        rows.append(
            (
                n.chars,
                n.own,
                n.link_chars / max(1, n.chars),
                n.links / max(1, n.texts),
                n.tags / (1 + n.chars / 100),
                n.chars / max(1, n.texts),
                n.chars / whole,
                n.chars / max(1, parent.chars),
                float(n.inputs > 0),
                float(n.depth),
                before / whole,
                len(siblings),
                (alike[n.parent, n.tag] if i else 1) / len(siblings),
                parent.own,
                parent.link_chars / max(1, parent.chars),
                paragraphs[i],
                paragraphs[n.parent] if i else 0,
                n.end - i,
            )
        )
        before += n.own
    c, x = np.array(codes, dtype=np.int64), np.array(rows, dtype=np.float64)
    parts, outer = np.arange(len(TOKENS)), np.array([_TAG[t] for t in OUTER])
    return np.concatenate([c[:, :1] == np.arange(len(TAGS)), c[:, 1:2] >> parts & 1, c[:, 2:3] >> parts & 1, c[:, 3:] >> outer & 1, x], axis=1)


def decode(page: Page, logits: np.ndarray) -> list[bool]:
    """The best choice in which every kept node's ancestors are kept; a node weighs by the text that is its own."""
    nodes = page.nodes
    gain = [float(x) * (1 + np.log1p(n.own)) for x, n in zip(logits, nodes, strict=True)]
    for i in range(len(nodes) - 1, 0, -1):
        if gain[i] > 0:
            gain[nodes[i].parent] += gain[i]
    kept = [True] * len(nodes)
    for i, n in enumerate(nodes[1:], 1):
        kept[i] = kept[n.parent] and gain[i] > 0
    return kept


class _Author:
    """Generates pages of varied layouts; blocks of the main text carry data-k."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        made = ["".join(r.choice(("th", "an", "er", "on", "re", "st", "é", "en", "ou", "li", "ka", "m", "ß", "ó")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        s = " ".join(made).capitalize()
        kind = r.random()
        s = s.upper() if kind < 0.05 else "%%% ".join(s.split(" ")) if kind < 0.08 else " | ".join(s.split(" ")) if kind < 0.11 else s
        return s + r.choice((".", ".", ".", "!", "?", ""))

    def prose(self) -> str:
        kind = self.r.random()
        if kind < 0.12:
            return self.words(1, 4)
        if kind < 0.16:
            return self.r.choice(("This work is licensed under the ", "&copy; 2020 ", "Copyright (c) ", "All rights reserved. ")) + self.words(2, 12)
        return " ".join(self.words(3, 25) for _ in range(self.r.randint(1, 5)))

    def box(self, part: str, tags: tuple[str, ...], inner: str, plain: float = 0.0) -> str:
        """An element of some tag, named after its part by a class or an id, or (``plain``) not at all."""
        r = self.r
        tag = r.choice(tags)
        if tag not in ("div", "section", "ul") and r.random() < 0.5 or r.random() < plain:
            return f"<{tag}>{inner}</{tag}>"
        word = r.choice(TOKENS[part].split())
        name = r.choice((word, word, f"{word}-{r.choice(('box', 'area', 'inner', 'x1', 'list'))}", f"{r.choice(('site', 'c', 'block', 'page'))}-{word}", f"{word} {r.choice(('wide', 'clearfix', 'col-4'))}"))
        gone = " hidden" if part == "note" and r.random() < 0.2 else ""
        return f'<{tag} {r.choice(("class", "class", "id"))}="{name}"{gone}>{inner}</{tag}>'

    def links(self, low: int = 3, high: int = 9) -> str:
        r = self.r
        items = [f'<a href="/{i}">{self.words(1, 4)}</a>' for i in range(r.randint(low, high))]
        form = r.random()
        if form < 0.6:
            return "<ul>" + "".join(f"<li>{x}" + ("</li>" if form < 0.5 else "") for x in items) + "</ul>"
        return " &middot; ".join(items) if form < 0.8 else "".join(f"<p>{x}</p>" for x in items)

    def talk(self) -> str:
        return "".join(self.box("talk", ("div", "li", "article"), f"<p>{self.words(1, 3)}</p><p>{self.prose()}</p>", 0.3) for _ in range(self.r.randint(1, 6)))

    def some(self, part: str) -> str:
        r, k = self.r, self.r.random()
        text = self.prose() if k < 0.5 else f"<p>{self.prose()}</p>" if k < 0.8 else f"<h3>{self.words(1, 5)}</h3><p>{self.prose()}</p>"
        if part == "menu":
            return self.box("menu", ("nav", "nav", "div", "ul"), self.links(), 0.1)
        if part == "head":
            return self.box("head", ("header", "header", "div"), f"<a href='/'>{self.words(1, 3)}</a>" + (f"<p>{self.words(2, 8)}</p>" if k < 0.5 else "") + (self.some("menu") if k > 0.4 else ""))
        if part == "foot":
            return self.box("foot", ("footer", "footer", "div"), ("&copy; " + self.words(1, 6) if k < 0.7 else "") + (f" &middot; {self.prose()}" if k < 0.5 else f"<p>{self.prose()}</p>") + (self.links(2, 5) if k > 0.6 else ""))
        if part == "side":
            return self.box("side", ("aside", "aside", "div", "section"), (f"<h3>{self.words(1, 4)}</h3>" if k < 0.7 else "") + (self.links() if k < 0.6 else text))
        if part == "talk":
            return self.box("talk", ("div", "section", "section"), f"<h2>{self.words(1, 3)}</h2>" * (k < 0.7) + self.talk())
        if part == "ask":
            return self.box("ask", ("form",), f"<label>{self.words(1, 3)}</label><input name='q'>" + (f"<p>{self.words(3, 15)}</p>" if k < 0.5 else "") + "<button>" + self.words(1, 2) + "</button>")
        if part == "share":
            return self.box("share", ("div", "ul"), self.links(2, 5))
        return self.box(part, ("div", "div", "section", "aside") if r.random() < 0.9 else ("p",), text + (f"<button>{self.words(1, 2)}</button>" if part == "note" and k < 0.6 else ""))

    def article(self) -> str:
        r = self.r
        out = []
        head = f"<h1 data-k>{self.words(2, 12)}</h1>"
        if r.random() < 0.85:
            out.append(f"<header>{head}</header>" if r.random() < 0.15 else head)
        for _ in range(r.choice((1, 1, 2, 3, 4, 6, 8, 12, 20))):
            k = r.random()
            if k < 0.72:
                linked = self.prose().replace(" ", " <a href='/x'>" + self.words(1, 2) + "</a> ", 1) if r.random() < 0.15 else self.prose()
                out.append(f"<p data-k>{linked}</p>" if r.random() < 0.85 else f"<p data-k><b>{linked}<br>")
            elif k < 0.8:
                out.append(f"<h{2 + (k < 0.76)} data-k>{self.words(1, 8)}</h{2 + (k < 0.76)}>")
            elif k < 0.86:
                out.append("<ul>" + "".join(f"<li data-k>{self.prose()}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif k < 0.9:
                out.append(f"<blockquote><p data-k>{self.prose()}</p></blockquote>" if k < 0.88 else f"<pre data-k>{self.words(3, 30)}</pre>")
            elif k < 0.93:
                out.append("<table>" + "".join(f"<tr data-k><td>{self.words(1, 3)}<td>{self.words(1, 3)}</tr>" for _ in range(r.randint(2, 4))) + "</table>")
            elif k < 0.95:
                out.append(f"<figure><img src='x'><figcaption data-k>{self.words(3, 10)}</figcaption></figure>")
            elif k < 0.97:
                out.append(f"<div data-k>{self.prose()}</div>")
            else:
                out.append(self.some(r.choice(("ads", "side", "share", "note"))))
        if r.random() < 0.15:
            out.append(self.some(r.choice(("share", "talk", "side"))))
        body = "".join(out)
        if r.random() < 0.06:  # lines of text without elements of their own
            lines = "<br><br>".join(self.prose() for _ in range(r.randint(2, 8)))
            return self.box("main", ("div", "div", "article", "main"), head + lines, 0.2).replace(">", " data-k>", 1)
        if r.random() < 0.2:
            body = f"<section>{body}</section>"
        if r.random() < 0.05:
            depth = r.randint(3, 40)
            body = "<div>" * depth + body + "</div>" * depth
        k = r.random()
        return f"<article>{body}</article>" if k < 0.45 else self.box("main", ("article", "main", "div", "div", "section"), body, 0.2) if k < 0.93 else body

    def columns(self) -> str:
        """A page laid out by a table, its article in one of the cells."""
        r = self.r
        cell = lambda part, inner: f'<td{r.choice(("", f" class={part}", " width=20%", " valign=top"))}>{inner}'
        sides = [cell(p, self.links() if p == "menu" else self.some(p)) for p in ("menu", "side", "ads") if r.random() < 0.6]
        sides.insert(r.randint(0, len(sides)), cell(r.choice(("content", "main", "x1")), self.article()))
        rows = [f"<tr><td colspan={len(sides)}>{self.some('head')}</tr>"] * (r.random() < 0.5) + ["<tr>" + "".join(sides) + "</tr>"] + [f"<tr><td colspan={len(sides)}>{self.some('foot')}</tr>"] * (r.random() < 0.6)
        return "<table>" + "".join(rows) + "</table>"

    def page(self) -> str:
        r = self.r
        parts = [*(p for p, odds in (("note", 0.3), ("head", 0.5), ("menu", 0.7), ("ads", 0.45), ("side", 0.25), ("ask", 0.15)) if r.random() < odds)]
        if r.random() < 0.3:
            r.shuffle(parts)
        after = [p for p, odds in (("share", 0.2), ("ads", 0.25), ("talk", 0.45), ("side", 0.4), ("ask", 0.25), ("note", 0.15), ("menu", 0.1)) if r.random() < odds]
        r.shuffle(after)
        after += ["foot"] * (r.random() < 0.8)
        body = "".join(map(self.some, parts)), self.article(), "".join(map(self.some, after))
        inner = "".join(body) if r.random() < 0.92 else self.columns()
        if r.random() < 0.3:
            inner = f"<div{r.choice(('', ' id=page', ' class=wrapper', ' class=container'))}>{inner}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{inner}</body></html>"


def labels(page: Page) -> np.ndarray:
    """1 for the blocks marked data-k and whatever holds one of them."""
    y = np.array([float(n.marked) for n in page.nodes])
    for i in range(len(y) - 1, 0, -1):
        if y[i]:
            y[page.nodes[i].parent] = 1
    return y


@cache
def trained(pages: int = TRAINING_PAGES, seed: int = 3) -> boosting.Forest:
    author = _Author(seed)
    made = [parse(author.page()) for _ in range(pages)]
    return boosting.fit(np.concatenate([node_features(p) for p in made]), np.concatenate([labels(p) for p in made]))


def extract(htmls: list[str | None], forest: boosting.Forest) -> list[str]:
    """The main text of each page: its blocks, joined by blank lines."""
    out: list[str] = []
    held: list[tuple[Page, np.ndarray]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            logits, at = forest.logits(np.concatenate([x for _, x in held])), 0
            for page, x in held:
                out.append("\n\n".join(blocks(page, decode(page, logits[at : at + len(x)]))))
                at += len(x)
        held.clear()
        size = 0

    for html in htmls:
        page = parse(html or "")
        if len(page.nodes) == 1:  # no markup: nothing to choose
            flush()
            out.append("\n\n".join(blocks(page, [True])))
            continue
        x = node_features(page)
        held.append((page, x))
        size += len(x)
        if size > NODES_A_BATCH:
            flush()
    flush()
    return out


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row of ``pages`` (page_id, url, html)."""
    forest = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(extract(batch.column(2).to_pylist(), forest.value), type=pa.string())], names=["page_id", "url", "text"])

    return in_arrow(pick(pages, "page_id", "url", "html"), run, "page_id bigint, url string, text string")


def op8_boosted_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).selectExpr("page_id", "url", "text", "CAST(length(text) AS BIGINT) AS n_chars")
