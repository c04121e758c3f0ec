"""The corpus validator: thirteen checks over one projection, one aggregate and the group-bys that need their own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import DEVANAGARI, MAITHILI_HINDI, PREAMBLE_WORDS, LanguageMarkers, ScriptProfile
from . import profile

REQUIRED = ["article_link", "article_text", "article_language"]
# Numbers and names of the checks, and which of them count as issues.
CHECKS = [
    (1, "required_columns", True), (2, "duplicate_links", True), (3, "url_format", True), (4, "near_empty", True), (5, "script_ratio", True), (6, "latin_present", True), (7, "html_present", True),
    (8, "stray_symbols", True), (9, "preamble_remnant", True), (10, "duplicate_texts", True), (11, "language_mismatch", False), (12, "short_texts", False), (13, "foreign_leakage", False),
]
HTML_TAG = "<[^>]+>"
LENGTH_EDGES = [200, 500, 1000, 2000, 5000]


@dataclass(frozen=True)
class ValidationProfile:
    """What a corpus is held against."""

    url: str = r"^https://maithilijindabaad\.com/\?p=\d+$"
    script: ScriptProfile = DEVANAGARI
    markers: LanguageMarkers = MAITHILI_HINDI
    preamble: tuple[str, ...] = PREAMBLE_WORDS
    least_stripped: int = 100
    least_ratio: float = 0.50
    short: int = 200


def stray_symbols(c: Column | str, script: ScriptProfile = DEVANAGARI) -> Column:
    """The distinct characters outside script, digits and plain punctuation, in order of appearance.

    What is kept goes in whole runs first; common characters stand before the class that lists them all.
    """
    left = F.regexp_replace(X.col(c), f'[{script.chars} [{X.KEPT_MARKS}\\-"]]++', "")
    return F.array_distinct(F.regexp_extract_all(left, F.lit("(?s)(.)"), 1))


def latin_words(c: Column | str, n: int = 5) -> Column:
    return F.slice(F.regexp_extract_all(X.col(c), F.lit("([A-Za-z]{2,})"), 1), 1, n)


def html_tags(c: Column | str, n: int = 3) -> Column:
    return F.slice(F.regexp_extract_all(X.col(c), F.lit(f"({HTML_TAG})"), 1), 1, n)


def row_checks(articles: DataFrame, p: ValidationProfile) -> DataFrame:
    """link and one boolean for each check on single rows."""
    text = F.col("_text")
    told = articles.withColumn("_text", F.coalesce("article_text", F.lit(""))).withColumn("_share", X.foreign_share(text, p.markers))
    return told.select(
        F.col("article_link"),
        (~F.coalesce(F.col("article_link").rlike(p.url), F.lit(False))).alias("url_format"),
        (~X.is_long(text, p.least_stripped)).alias("near_empty"),
        ((text != "") & (X.script_ratio_chars(text, p.script) < p.least_ratio)).alias("script_ratio"),
        text.rlike("[A-Za-z]").alias("latin_present"),
        text.rlike(HTML_TAG).alias("html_present"),
        text.rlike(f'[^{p.script.chars}{X.KEPT_MARKS}\\-"]').alias("stray_symbols"),
        X.has_preamble(text, p.preamble).alias("preamble_remnant"),
        (F.coalesce("article_language", F.lit("")) != X.language_of(F.col("_share"), p.markers)).alias("language_mismatch"),
        (F.length(text) < p.short).alias("short_texts"),
        F.coalesce(F.col("_share") >= p.markers.mixed_from, F.lit(False)).alias("foreign_leakage"),
    )


#: Parts of a check's rows that are counted and ranked apart, so that a check that every row fails is no hot task.
SALTS = 256


def _summed(flagged: DataFrame, n: int) -> DataFrame:
    """(check_name, affected, examples) from a row for each link and check that it fails: the count and the n least links.

    Both come from one pass over the rows.
    """
    salted = flagged.withColumn("_s", F.pmod(F.xxhash64("article_link"), F.lit(SALTS)))
    part = W.partitionBy("check_name", "_s")
    ranked = salted.withColumn("_r", F.row_number().over(part.orderBy("article_link"))).withColumn("_n", F.count("*").over(part)).where(F.col("_r") <= n)
    return ranked.groupBy("check_name").agg(F.sum(F.when(F.col("_r") == 1, F.col("_n"))).alias("affected"), F.slice(F.array_sort(F.collect_list("article_link")), 1, n).alias("examples"))


def validation_report(articles: DataFrame, p: ValidationProfile, n_examples: int = 5) -> DataFrame:
    """(check_no, check_name, affected, examples, is_issue), one row a check; examples are the least links, none is an empty array."""
    spark = articles.sparkSession
    absent = [c for c in REQUIRED if c not in articles.columns]
    articles = articles.withColumns({c: F.lit(None).cast("string") for c in absent})
    rows = row_checks(articles, p)
    names = [n for _, n, _ in CHECKS if n in rows.columns]
    flagged = rows.select("article_link", F.explode(F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in names]))).alias("check_name"))
    found = _summed(flagged, n_examples)
    links = profile.duplicate_keys(articles, F.col("article_link"), "link")
    prefix = F.struct(*X.wide_key(F.substring("article_text", 1, 300)))
    texts = articles.groupBy(prefix.alias("key")).agg(F.count("*").alias("n"), F.min("article_link").alias("link")).where("n > 1")
    for name, more in (("duplicate_links", links), ("duplicate_texts", texts)):
        found = found.union(_summed(more.select(F.col("link").alias("article_link"), F.lit(name).alias("check_name")), n_examples))
    named = spark.createDataFrame([("required_columns", len(absent), sorted(absent)[:n_examples])], "check_name string, affected bigint, examples array<string>")
    numbered = spark.createDataFrame(CHECKS, "check_no int, check_name string, flag boolean")
    found = F.broadcast(numbered).join(found.union(named), "check_name", "left")  # 13 rows
    affected = F.coalesce("affected", F.lit(0))
    return found.select("check_no", "check_name", affected.alias("affected"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"), (F.col("flag") & (affected > 0)).alias("is_issue"))


def examples(articles: DataFrame, p: ValidationProfile, check: str, n: int = 5) -> DataFrame:
    """The first n links of a check on single rows."""
    return row_checks(articles, p).where(check).select("article_link").orderBy("article_link").limit(n)


def exit_code(report: DataFrame) -> int:
    return int(not report.where("is_issue").isEmpty())
