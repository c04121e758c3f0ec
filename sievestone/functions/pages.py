"""Web pages: a tree from the standard library's parser, and what is taken from it, in Arrow UDFs.

Only work on trees runs in Python; whatever can be said on strings and arrays
(filters, cuts, joins of paragraphs) is left to Column functions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DEVANAGARI_BASE, ScriptProfile, SiteProfile
from ..session import short_batches
from . import text as X

# Fixed values of the HTML standard: elements without content, and those that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Element:
    __slots__ = ("attributes", "children", "parent", "removed", "tag")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None) -> None:
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Element | str] = []
        self.removed = False

    def _nodes(self) -> Iterator[Element | str]:
        """All below in page order, however deep."""
        todo = [iter(self.children)]
        while todo:
            c = next(todo[-1], None)
            if c is None:
                todo.pop()
            elif isinstance(c, str):
                yield c
            elif not c.removed:
                yield c
                todo.append(iter(c.children))

    def walk(self) -> Iterator[Element]:
        return (c for c in self._nodes() if not isinstance(c, str))

    def strings(self) -> Iterator[str]:
        return (c for c in self._nodes() if isinstance(c, str))

    def text(self) -> str:
        return "".join(self.strings())

    def first(self, tag: str, classes: str = "") -> Element | None:
        return next((e for e in self.walk() if e.tag == tag and (not classes or re.search(classes, e.attributes.get("class", "")))), None)

    def remove(self) -> None:
        self.removed = True


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)
        self.open = Counter()

    def _close(self, tag: str) -> None:
        """End the innermost open element of that tag, and what is open in it."""
        while self.open[tag]:
            self.open[self.at.tag] -= 1
            found, self.at = self.at.tag == tag, self.at.parent
            if found:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ENDS_PARAGRAPH:
            self._close("p")
        if tag == "li" and self.at.tag == "li":
            self._close("li")
        e = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(e)
        if tag not in VOID:
            self.at = e
            self.open[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        self._close(tag)

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(html: str | None) -> Element:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def _mapped(kind: str, f: Callable[[str | None], object]) -> Callable[[Column | str], Column]:
    @F.pandas_udf(kind)
    def udf(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in pages:
            yield s.map(f)

    short_batches()
    return lambda c: udf(X.col(c))


def headline(c: Column | str, suffixes: tuple[str, ...] = (), entities: tuple[tuple[str, str], ...] | None = None) -> Column:
    """The first h1, even an empty one; else the title without the site's suffix; else og:title; else empty.

    Character references are read as browsers do, also without their semicolon; with ``entities``,
    (written, meant), only those are replaced, one after another, and all others stay as they are written.
    """

    def of(html: str | None) -> str:
        if entities is None:
            return told(tree(html))
        # with every & escaped, the parser gives back what is written
        return reduce(lambda t, e: t.replace(*e), entities, told(tree((html or "").replace("&", "&amp;")))).strip()

    def told(page: Element) -> str:
        if h1 := page.first("h1"):
            return "".join(s.strip() for s in h1.strings())
        if title := page.first("title"):
            own = title.text().strip()
            return next((own.replace(s, "").strip() for s in suffixes if s in own), own)
        og = next((e for e in page.walk() if e.tag == "meta" and e.attributes.get("property") == "og:title"), None)
        return og.attributes.get("content", "").strip() if og else ""

    return _mapped("string", of)(c)


def _container(page: Element, site: SiteProfile) -> Element | None:
    found = next((e for tag, cls in site.containers if (e := page.first(tag, cls))), None)
    if found:
        for e in list(found.walk()):
            if e.tag in site.prune_tags or re.search(site.prune_classes, e.attributes.get("class", ""), re.I):
                e.remove()
    return found


def paragraphs(c: Column | str, site: SiteProfile) -> Column:
    """array<string> of the container's paragraphs that aren't blank; null without a container."""

    def of(html: str | None) -> list[str] | None:
        found = _container(tree(html), site)
        return None if found is None else [t for e in found.walk() if e.tag == "p" and (t := e.text().strip())]

    return _mapped("array<string>", of)(c)


def whole_text(c: Column | str, site: SiteProfile) -> Column:
    """All text of the container, else of the body without its furniture, else of the page; pieces joined by blanks."""

    def of(html: str | None) -> str:
        page = tree(html)
        found = _container(page, site)
        if found is None and (found := page.first("body")):
            for e in list(found.walk()):
                if e.tag in ("nav", "header", "footer", "aside", "script", "style"):
                    e.remove()
        return " ".join(t for s in (found or page).strings() if (t := s.strip()))

    return _mapped("string", of)(c)


def links(c: Column | str) -> Column:
    """array<struct<href, text>> of all anchors that have an address."""
    of = lambda html: [{"href": e.attributes["href"], "text": e.text().strip()} for e in tree(html).walk() if e.tag == "a" and e.attributes.get("href")]
    return _mapped("array<struct<href:string,text:string>>", of)(c)


def text_blocks(c: Column | str) -> Column:
    """array<string> of all single pieces of text, for the fallback to the largest one."""
    return _mapped("array<string>", lambda html: [t for s in tree(html).strings() if (t := s.strip())])(c)


def permalink(c: Column | str, base: str) -> Column:
    """An article card's address: rel=bookmark, a title heading's link, a title link, else the first that isn't a taxonomy's."""

    def of(html: str | None) -> str | None:
        anchors = [e for e in tree(html).walk() if e.tag == "a" and e.attributes.get("href")]
        titled = [a for a in anchors if any(re.fullmatch("h[1-6]", p.tag) and re.search("entry-title|post-title|article-title", p.attributes.get("class", ""), re.I) for p in _parents(a))]
        marked = [a for a in anchors if "bookmark" in a.attributes.get("rel", "").split()]
        classed = [a for a in anchors if re.search("entry-title-link|post-title-link", a.attributes.get("class", ""), re.I)]
        slugs = [a for a in anchors if a.attributes["href"].startswith(base) and len(a.attributes["href"].split("/")) >= 4 and not re.search("/(category|tag|author|page)/", a.attributes["href"])]
        return next((x[0].attributes["href"] for x in (marked, titled, classed, slugs) if x), None)

    return _mapped("string", of)(c)


def _parents(e: Element) -> Iterator[Element]:
    while e.parent:
        e = e.parent
        yield e


def absolute(base: str, href: str) -> str:
    return urljoin(base, href)


def is_caption(p: Column, script: ScriptProfile = DEVANAGARI_BASE) -> Column:
    """Short and without a character of the script."""
    return (X.count_chars(p, script.chars) == 0) & (F.length(p) < 80)


def is_quotation_marker(p: Column) -> Column:
    return p.rlike(rf'^In[{X.WS}]+["\x{{201c}}\x{{201d}}][^"\x{{201c}}\x{{201d}}]{{0,60}}["\x{{201c}}\x{{201d}}][{X.WS}]*$')


def is_boilerplate(p: Column) -> Column:
    return (F.length(p) < 200) & X.has_boilerplate(p)


# Marks of author notes, of "read also" sections and of embedded data.
AUTHOR_MARKS = "सिविल इंजीनियर|ब्लॉगर|कमेंटेटर|anuragranjan|@gmail\\.com"
STOP_MARKS = "read also|ई भी पढ़ीं|इहो पढ़ीं|related|संबंधित|अउरी पढ़ीं"
DATA_MARKS = '@context|@type|schema\\.org|json|\\{|\\}|"@'
READ_ALSO = ("ई भी पढ़ीं", "इहो पढ़ीं", "अउरी पढ़ीं", "Read also", "संबंधित")


def body_paragraphs(ps: Column, script: ScriptProfile = DEVANAGARI_BASE, least: int = 50, least_script: int = 30) -> Column:
    """Paragraphs before the first stop mark that are long and scripted enough and no note or data.

    A short paragraph or a note never stops, even if it holds a stop mark.
    """
    skipped = lambda p: (F.length(p) < least) | p.rlike(AUTHOR_MARKS)
    stops = F.transform(ps, lambda p: F.when(~skipped(p) & F.lower(p).rlike(STOP_MARKS), 1).otherwise(0))
    at = F.array_position(stops, 1).cast("int")
    before = F.slice(ps, F.lit(1), F.when(at > 0, at - 1).otherwise(F.size(ps)))
    return F.filter(before, lambda p: ~skipped(p) & ~F.lower(p).rlike(DATA_MARKS) & (X.count_chars(p, script.chars) > least_script))


def largest_block(blocks: Column, script: ScriptProfile = DEVANAGARI_BASE, least: int = 200, least_script: int = 50) -> Column:
    """The block with the greatest product of script characters and length, the first on a tie."""
    fit = F.filter(blocks, lambda p: (F.length(p) > least) & ~p.rlike(AUTHOR_MARKS) & ~F.lower(p).rlike(STOP_MARKS) & ~F.lower(p).rlike(DATA_MARKS) & (X.count_chars(p, script.chars) > least_script))
    scored = F.transform(fit, lambda p: F.struct((X.count_chars(p, script.chars).cast("bigint") * F.length(p)).alias("s"), p.alias("p")))
    start = F.struct(F.lit(-1).cast("bigint").alias("s"), F.lit(None).cast("string").alias("p"))
    return F.aggregate(scored, start, lambda best, x: F.when(x["s"] > best["s"], x).otherwise(best))["p"]


def extract_articles(pages: DataFrame, site: SiteProfile, html: str = "html", script: ScriptProfile = DEVANAGARI_BASE) -> DataFrame:
    """``pages`` with article_text, null where there is no container or too little text.

    Paragraphs by the site's profile, without captions, quotation markers and site
    furniture, cleaned of hashtags and sentences of furniture.
    """
    if not site.paragraphs:
        own = X.clean_to_script(X.strip_preamble(whole_text(html, site)))
        return pages.withColumn("article_text", F.when(F.length(own) >= site.least_chars, own))
    kept = F.filter(F.col("_ps"), lambda p: ~is_quotation_marker(p) & ~is_caption(p, script) & ~is_boilerplate(p))
    enough = lambda own: F.when(F.length(own) >= site.least_chars, own)
    article = X.bound(kept, lambda ps: F.when(F.size(ps) > 0, X.bound(X.clean_social(F.array_join(ps, " ")), enough)))
    return pages.withColumn("_ps", paragraphs(html, site)).withColumn("article_text", article).drop("_ps")


def extract_body(pages: DataFrame, site: SiteProfile, html: str = "html", script: ScriptProfile = DEVANAGARI_BASE, names: tuple[str, ...] = ()) -> DataFrame:
    """``pages`` with headline and article_text by the rules of ``body_paragraphs``, else the largest block."""
    read = pages.withColumn("_ps", paragraphs(html, site)).withColumn("_blocks", text_blocks(html)).withColumn("headline", headline(html, site.title_suffixes))
    own = F.array_join(body_paragraphs(F.coalesce("_ps", F.array().cast("array<string>")), script), " ")
    large = largest_block(F.col("_blocks"), script)
    best = F.when((F.length(own) >= site.least_chars) | large.isNull() | (F.length(large) <= F.length(own)), own).otherwise(large)
    cut = X.clean_brackets(X.cut_after(best, READ_ALSO, names))
    return read.withColumn("article_text", F.when(F.length(cut) > site.least_chars, cut)).drop("_ps", "_blocks")
