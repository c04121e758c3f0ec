"""Readers: delimited tables, checkpoints, metric files, sitemaps and listing pages."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import pages
from ..functions.addresses import canonical_article_url, is_article_link, is_media
from ..schemas import SLICE, strings

#: What stands for null while a file is parsed, so that a quoted empty string isn't taken for it.
NULL = "\x00null\x00"
CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "charToEscapeQuoteEscaping": '"', "maxCharsPerColumn": "-1", "nullValue": NULL}


def read_articles(spark: SparkSession, path: str, schema: T.StructType | None = None, encoding: str = "UTF-8") -> DataFrame:
    """A CSV with a header, quoted newlines and doubled quotes. Every column is a string unless ``schema`` says else."""
    reader = spark.read.options(**CSV, encoding=encoding)
    return reader.schema(schema).option("enforceSchema", "false").csv(path) if schema else reader.option("inferSchema", "false").csv(path)


def read_articles_any(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """UTF-8, or Latin-1 if some line isn't valid UTF-8. Lines are checked one by one, whatever the files' size."""
    bad = spark.read.text(path).where(~F.is_valid_utf8("value"))
    return read_articles(spark, path, schema, "UTF-8" if bad.isEmpty() else "ISO-8859-1")


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, missing ones empty."""
    return read_articles(spark, path).na.fill("")


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a small workbook, read on the driver: a header, then strings; an absent cell is empty."""
    content = spark.read.format("binaryFile").load(path).select("content").first()[0]
    rows = list(_sheet_rows(bytes(content)))
    width = len(rows[0]) if rows else 0
    table = [tuple((r + [""] * width)[:width]) for r in rows[1:]]
    return spark.createDataFrame(table, strings(*rows[0])) if rows else spark.createDataFrame([], "value string")


def _sheet_rows(content: bytes) -> Iterator[list[str]]:
    """The cells of a workbook's first sheet: shared, inline and formula strings, numbers as they are written."""
    # Places and names of the public format.
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    told = lambda e: "".join(t.text or "" for t in e.iter(f"{space}t"))
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = [told(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{space}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        sheet = ElementTree.fromstring(z.read(min(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))))
    for row in sheet.iter(f"{space}row"):
        cells: list[str] = []
        for c in row.iter(f"{space}c"):
            letters = re.match("[A-Z]*", c.get("r", ""))[0]
            at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) - 1 if letters else len(cells)
            value = c.findtext(f"{space}v") or ""
            cells += [""] * (at - len(cells)) + [shared[int(value)] if c.get("t") == "s" else told(c) if c.get("t") == "inlineStr" else value]
        yield cells


def read_json_map(spark: SparkSession, path: str, value: str | T.DataType, key: str = "key", name: str = "value") -> DataFrame:
    """(key, value) of a JSON object file that holds a checkpoint or a cache; no file: no rows."""
    kind = value if isinstance(value, str) else value.simpleString()
    try:
        text = spark.read.text(path, wholetext=True)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], f"{key} string, {name} {kind}")
        raise
    return text.select(F.explode(F.from_json("value", f"map<string,{kind}>")).alias(key, name))


def read_metric_slices(spark: SparkSession, path: str, priority: int = 0, schema: str = SLICE) -> DataFrame:
    """Slices of metric files: an object with ``slices``, a list, or one slice; with file and source_priority."""
    text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    bundle = F.from_json("value", f"struct<slices:array<{schema}>>")["slices"]
    listed, one = F.from_json("value", f"array<{schema}>"), F.array(F.from_json("value", schema))
    top = F.substring(F.ltrim("value"), 1, 1)
    found = F.when(top == "[", listed).otherwise(F.coalesce(bundle, one))
    return text.select("file", F.lit(priority).alias("source_priority"), F.explode(found).alias("s")).select("s.*", "file", "source_priority")


def sitemap_locations(c: Column | str) -> Column:
    """array<string> of all locations, with or without a namespace."""
    xml = F.col(c) if isinstance(c, str) else c
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?s)<(?:\w+:)?loc>\s*(.*?)\s*</(?:\w+:)?loc>"), 1), lambda x: F.replace(F.regexp_replace(x, r"^<!\[CDATA\[|\]\]>$", ""), F.lit("&amp;"), F.lit("&")))


def sitemap_children(index: DataFrame, xml: str = "xml", like: str = "post") -> DataFrame:
    """Child maps of an index: those like posts, or all if none is."""
    each = index.select(F.explode(sitemap_locations(xml)).alias("url")).distinct()
    posts = each.where(F.contains(F.regexp_extract("url", "[^/]*$", 0), F.lit(like)))
    return each if posts.isEmpty() else posts


def sitemap_articles(maps: DataFrame, xml: str = "xml", prefix: str = "", limit: int | None = None) -> DataFrame:
    """Distinct article addresses of urlsets, without media; in order, if limited."""
    urls = maps.select(F.explode(sitemap_locations(xml)).alias("url")).where(~is_media("url") & F.startswith("url", F.lit(prefix))).distinct()
    return urls.orderBy("url").limit(limit) if limit else urls


def first_sitemap(candidates: list[DataFrame]) -> DataFrame:
    """The first candidate that has any address."""
    return next((c for c in candidates if not c.isEmpty()), candidates[-1])


def total_pages(listing: DataFrame, html: str = "html") -> DataFrame:
    """One row: the highest page number that listing pages link to, 1 at least."""
    numbers = F.transform(F.regexp_extract_all(F.col(html), F.lit(r"paged=(\d+)"), 1), lambda x: x.cast("int"))
    return listing.agg(F.greatest(F.coalesce(F.max(F.array_max(numbers)), F.lit(1)), F.lit(1)).alias("pages"))


def article_links(listing: DataFrame, base: str, html: str = "html") -> DataFrame:
    """Distinct canonical article addresses that listing pages link to."""
    href = listing.select(F.explode(pages.links(html)).alias("a")).select(canonical_article_url(F.col("a.href"), base).alias("url"))
    return href.where("url IS NOT NULL").distinct()


def home_links(home: DataFrame, domain: str, html: str = "html", order: str = "page_id", limit: int | None = None) -> DataFrame:
    """Article links of start pages, each at its first place, in order."""
    each = home.select(F.col(order).alias("_o"), F.posexplode(pages.links(html)).alias("_p", "a")).where(is_article_link(F.col("a.href"), F.col("a.text"), domain))
    first = each.groupBy(F.col("a.href").alias("url")).agg(F.min(F.struct("_o", "_p")).alias("_at")).orderBy("_at").drop("_at")
    return first.limit(limit) if limit else first
