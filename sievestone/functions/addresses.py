"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def canonical_article_url(c: Column | str, base: str) -> Column:
    """base/?p=N for an address with a numeric parameter p, taken relative to ``base``; else null."""
    href = col(c)
    whole = F.when(F.startswith(href, F.lit("http")), href).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(href, "^/+", "")))
    p = F.try_parse_url(whole, F.lit("QUERY"), F.lit("p"))
    return F.when(p.rlike(r"^\d+$"), F.concat(F.lit(base.rstrip("/") + "/?p="), p))


def url_path(c: Column | str) -> Column:
    return F.regexp_extract(col(c), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def url_category(c: Column | str) -> Column:
    """The first segment of the path; no path: empty."""
    return F.split_part(F.regexp_replace(url_path(c), "^/+|/+$", ""), F.lit("/"), F.lit(1))


def netloc(c: Column | str) -> Column:
    return F.regexp_extract(col(c), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def is_redirected_home(c: Column | str) -> Column:
    """No parameter p and no path."""
    return ~col(c).rlike(r"[?&]p=") & url_path(c).isin("", "/")


def is_dead_page(final_url: Column | str, html: Column | str, base: str) -> Column:
    """Landed on the start or a listing page, or the first 3000 characters say 404."""
    here, top = F.regexp_replace(col(final_url), "/+$", ""), F.lower(F.substring(col(html), 1, 3000))
    says = F.contains(top, F.lit('class="error404"')) | F.contains(top, F.lit("<title>page not found")) | F.contains(top, F.lit("<title>404"))
    return (here == base.rstrip("/")) | here.rlike(r"/page/\d+$") | F.coalesce(says, F.lit(False))


# Parts of addresses that aren't articles.
NOT_ARTICLES = "about|contact|category|tag|author|facebook|twitter|instagram"
MEDIA = r"\.(jpg|png|jpeg|gif|webp|pdf)$"
TAXONOMY = "/(category|tag|author|page)/"


def is_article_link(href: Column | str, text: Column | str, domain: str, least: int = 15) -> Column:
    return F.contains(col(href), F.lit(domain)) & (F.length(col(text)) > least) & ~F.lower(col(href)).rlike(NOT_ARTICLES)


def is_media(c: Column | str) -> Column:
    return col(c).rlike(MEDIA)
