"""Queries of readers, writers, crawls, resumable jobs and streams, with their SQL.

Those of files write to the scratch folder what they read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import schemas as S
from .functions import addresses as U
from .functions import pages as H
from .functions import prompts as P
from .functions import replies as N
from .functions import text as X
from .operators import annotate, tables
from .operators import overlap as O
from .plans import jobs
from .queries import QUERIES, SQL, S_PAIRS, S_ROWS, _pairs, macro_metrics, q, query, s_rouge, table
from .scratch import scratch_path
from .sources import readers, writers
from .streaming import incremental

__all__ = ["QUERIES", "SQL"]

BASE = "https://e.example"


def page(spark, d, html: str) -> DataFrame:
    """A made-up page for every row of ``pages``; {id} and {url} stand for the row's."""
    return table(spark, d, "pages").select("page_id", "url", P.render(html, id=F.col("page_id"), url=F.col("url")).alias("html"))


# ---- files ----


@query("SELECT doc_id, text, lang, n_chars FROM documents")
def csv_articles(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "n_chars")
    path = scratch_path(spark, "csv")
    writers.write_csv(docs, path)
    return readers.read_articles(spark, path, docs.schema)


@query(r"SELECT doc_id::VARCHAR AS doc_id, regexp_replace(substr(text, 1, 200), '[^\x00-\xff]', '?', 'g') || ' ü' AS text FROM documents")
def csv_latin1(spark, d):
    text = F.concat(F.regexp_replace(F.substring("text", 1, 200), r"[^\x00-\xff]", "?"), F.lit(" ü"))
    path = scratch_path(spark, "latin1")
    writers.write_csv(table(spark, d, "documents").select("doc_id", text.alias("text")), path, encoding="ISO-8859-1")
    return readers.read_articles_any(spark, path)


@query("SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS lang FROM documents")
def csv_strings(spark, d):
    path = scratch_path(spark, "strings")
    writers.write_csv(table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("lang")), path)
    return readers.read_strings(spark, path)


@query("SELECT source AS key, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source")
def json_checkpoint(spark, d):
    """A map of as many keys as there are sources, as one JSON object."""
    counts = table(spark, d, "documents").where("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("n"))
    path = scratch_path(spark, "map")
    counts.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("source", "n")))).alias("value")).write.text(path)
    return readers.read_json_map(spark, path, "bigint", name="n")


@query(f"WITH {S_ROWS} SELECT lang AS language, n AS n_scored, accuracy AS emo_acc, p AS source_priority FROM scores CROSS JOIN (VALUES (0), (1), (2)) v(p)")
def metric_slices(spark, d):
    """The slices of all languages in the three forms of metric files: a bundle, a list, single ones."""
    slices = macro_metrics(spark, d).select(F.struct(F.col("lang").alias("language"), F.col("n").alias("n_scored"), F.col("accuracy").alias("emo_acc")).alias("s"))
    listed = slices.agg(F.collect_list("s").alias("slices"))
    forms = [listed.select(F.to_json(F.struct("slices"))), listed.select(F.to_json("slices")), slices.select(F.to_json("s"))]
    found = []
    for priority, form in enumerate(forms):
        path = scratch_path(spark, "slices")
        form.write.option("maxRecordsPerFile", 1).text(path)
        found.append(readers.read_metric_slices(spark, path, priority))
    return reduce(DataFrame.union, found).select("language", "n_scored", "emo_acc", "source_priority")


@query("SELECT url AS value FROM pages")
def line_list(spark, d):
    path = scratch_path(spark, "lines")
    writers.write_lines(table(spark, d, "pages"), path, "url")
    return spark.read.text(path)


@query("SELECT page_id, url, NULL::VARCHAR AS none FROM pages")
def json_rows(spark, d):
    path = scratch_path(spark, "json")
    writers.write_json(table(spark, d, "pages").select("page_id", "url", F.lit(None).cast("string").alias("none")), path)
    return spark.read.schema("page_id bigint, url string, none string").json(path)


@query("SELECT lang, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY lang")
def slice_bundles(spark, d):
    """Counts by language and source, bundled by language and taken apart again."""
    counts = table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return writers.bundle(counts, ("lang",)).select("lang", F.aggregate("slices", F.lit(0).cast("bigint"), lambda a, x: a + x["n"]).alias("n"), F.size(F.array_distinct(F.transform("slices", lambda x: x["source"]))).cast("bigint").alias("sources"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'second' ELSE 'first' END AS reply FROM documents")
def upserted_rows(spark, d):
    docs, path = table(spark, d, "documents").select("doc_id"), scratch_path(spark, "upsert")
    for version, name, rows in ((1, "first", docs), (2, "second", docs.where("doc_id % 2 = 0"))):
        writers.upsert(rows.select("doc_id", F.lit(name).alias("reply"), F.lit(version).alias("at")), path, "doc_id", "at")
    return writers.latest(spark.read.parquet(path), "doc_id").select("doc_id", "reply")


@query("SELECT doc_id, n FROM documents CROSS JOIN (VALUES (1), (2)) v(n)")
def appended_rows(spark, d):
    path = scratch_path(spark, "append")
    for n in (1, 2):
        writers.append_rows(table(spark, d, "documents").select("doc_id", F.lit(n).alias("n")), path)
    return spark.read.parquet(path)


@query("SELECT doc_id, 'first' AS state FROM documents UNION ALL SELECT doc_id, 'second' FROM documents")
def table_versions(spark, d):
    docs, path = table(spark, d, "documents").select("doc_id"), scratch_path(spark, "versions")
    for version, name in ((1, "first"), (2, "second")):
        writers.write_version(docs.withColumn("state", F.lit(name)), path, version)
    return writers.read_version(spark, path, 1).union(writers.read_version(spark, path))


# ---- columns and keys ----


@query("SELECT '' AS website, doc_id::VARCHAR AS article_url, lang AS language, '' AS headline, text AS article_text FROM documents WHERE doc_id % 5 > 0 AND text IS NOT NULL AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def canonical_columns(spark, d):
    text = F.when(F.col("doc_id") % 5 > 0, F.col("text")).otherwise(" \n")
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("﻿article_link "), F.col("lang").alias("article_language"), text.alias("article_text"), F.col("source"))
    return tables.normalize_columns(docs, S.DATASETS["maithili_1"].renames)


S_HOST = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"


@query(f"SELECT page_id, {S_HOST} AS website, CASE WHEN ends_with('.' || {S_HOST}, '.example.net') THEN 'Bhojpuri' WHEN ends_with('.' || {S_HOST}, '.example.org') THEN 'Maithili' ELSE 'Hindi' END AS language FROM pages")
def site_columns(spark, d):
    return tables.with_site(table(spark, d, "pages").select("page_id", "url"), "url", {"example.net": "Bhojpuri", "example.org": "Maithili"}, "Hindi").drop("url")


@query("SELECT text AS article_text, lang AS headline, source AS summary FROM documents")
def alias_columns(spark, d):
    docs = table(spark, d, "documents").select(F.col("text").alias(" Body"), F.col("lang").alias("TITLE"), F.col("source").alias("gold_summary"))
    return tables.resolve_aliases(docs).select("article_text", "headline", "summary")


@query("SELECT * FROM (VALUES ('extra', 'n_chars'), ('extra', 'source'), ('missing', 'headline')) v(kind, name)")
def schema_difference(spark, d):
    missing, extra = tables.column_difference(table(spark, d, "documents"), ["doc_id", "text", "lang", "headline"])
    return spark.createDataFrame([*(("missing", c) for c in missing), *(("extra", c) for c in extra)], "kind string, name string")


@query("SELECT doc_id, lang, NULL::VARCHAR AS quality FROM documents UNION ALL SELECT doc_id, NULL, quality::VARCHAR FROM labels")
def appended_frames(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    return tables.append_all([table(spark, d, "documents").select("doc_id", "lang"), labels])


@query("SELECT doc_id AS row_key, lang AS generated FROM documents UNION ALL SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END FROM documents")
def generation_fallback(spark, d):
    """No row of the first lookup gets a generation, so the generations stand for it; the second has some."""
    tests = table(spark, d, "documents").select(F.col("doc_id").alias("row_key"))
    made = table(spark, d, "documents").select(F.col("doc_id").alias("row_key"), F.col("lang").alias("generated"))
    found = [tables.or_generations(tables.join_generations(tests, g), made) for g in (made.withColumn("row_key", -1 - F.col("row_key")), made.where("row_key % 2 = 0"))]
    return found[0].union(found[1])


@query("SELECT count(*) AS n, true AS expected FROM documents")
def row_guard(spark, d):
    docs = table(spark, d, "documents")
    n, expected = tables.check_rows(docs, docs.agg(F.count("doc_id")).first()[0])
    return spark.createDataFrame([(n, expected)], "n bigint, expected boolean")


@query("SELECT doc_id, lang || chr(10) || chr(10) || source || chr(10) || '- ' || lang || chr(10) || '- ' || n_chars AS text FROM documents")
def instructions(spark, d):
    text = P.instruction(F.array("lang", "source"), F.array("lang", F.col("n_chars").cast("string")))
    return table(spark, d, "documents").select("doc_id", text.alias("text"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'google/gemma-2-9b-it' WHEN 1 THEN 'ai4bharat/IndicBART' END AS model, CASE page_id % 3 WHEN 0 THEN 'chat_nosys' WHEN 1 THEN 'none' END AS format, 42 AS seed FROM pages")
def registered_models(spark, d):
    key = F.when(F.col("page_id") % 3 == 0, "gemma2").when(F.col("page_id") % 3 == 1, "indicbart_pre").otherwise("other")
    return table(spark, d, "pages").select("page_id", P.registered(key).alias("m")).select("page_id", "m.model", "m.format", F.lit(P.PROTOCOL["seed"]).alias("seed"))


@query("SELECT doc_id, '[' || repeat('#', (n_chars * 30 // 20000)::INT) || repeat('-', 30 - (n_chars * 30 // 20000)::INT) || ']' AS bar, format('{:.1f}%', n_chars / 200.0::DOUBLE) AS share FROM documents WHERE n_chars <= 20000")
def text_bars(spark, d):
    docs = table(spark, d, "documents").where("n_chars <= 20000")
    return docs.select("doc_id", X.text_bar(F.col("n_chars"), F.lit(20000)).alias("bar"), X.percent(F.col("n_chars"), F.lit(20000)).alias("share"))


HEADER = "लेख विचार प्रेषित : विषय - "


@query(f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN repeat('क', 60) || ' ' || doc_id WHEN doc_id % 3 = 1 THEN {q(HEADER)} || 'क ' || doc_id ELSE repeat('ख', 60) || ' ' || doc_id END AS text,
  CASE WHEN doc_id % 3 = 0 THEN 'repaired' WHEN doc_id % 3 = 1 THEN 'unfixable' ELSE 'clean' END AS state FROM documents""")
def stripped_preamble(spark, d):
    """A header before a text, before too short a text (which stays as it is), and none."""
    number = F.concat(F.lit(" "), F.col("doc_id").cast("string"))
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(HEADER + "क" * 60), number)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(HEADER + "क"), number)).otherwise(F.concat(F.lit("ख" * 60), number))
    return table(spark, d, "documents").select("doc_id", X.repair_preamble(text).alias("r")).select("doc_id", "r.text", "r.state")


# ---- pages and crawls ----


@query("SELECT page_id, url || ' second' AS text FROM pages")
def whole_texts(spark, d):
    html = "<html><body><nav>menu</nav><div class='entry-content'><p> {url} </p><script>x</script><div class='related'>no</div><p>second</p></div><p>after</p></body></html>"
    return page(spark, d, html).select("page_id", H.whole_text("html", S.SiteProfile()).alias("text"))


@query("SELECT page_id, 'https://e.example/' || CASE page_id % 3 WHEN 0 THEN 'marked' WHEN 1 THEN 'titled' ELSE 'slug' END || '/' || page_id AS link FROM pages")
def permalinks(spark, d):
    slug = f"<a href='{BASE}/category/x'>c</a><a href='{BASE}/slug/{{id}}'>s</a>"
    titled = f"<h2 class='entry-title'><a href='{BASE}/titled/{{id}}'>t</a></h2>"
    marked = f"<a rel='bookmark' href='{BASE}/marked/{{id}}'>m</a>"
    html = [page(spark, d, slug + rest).where(F.col("page_id") % 3 == i) for i, rest in enumerate((titled + marked, titled, ""))]
    return reduce(DataFrame.union, html).select("page_id", H.permalink("html", BASE).alias("link"))


S_LATIN = "length(regexp_replace(b, '[^A-Za-z]', '', 'g'))"


@query(f"""WITH p AS (SELECT doc_id, i, b, {S_LATIN} * length(b) AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS b, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
  WHERE length(b) > 200 AND {S_LATIN} > 50 AND NOT regexp_matches(b, {q(H.AUTHOR_MARKS)}) AND NOT regexp_matches(lower(b), {q(H.STOP_MARKS)}) AND NOT regexp_matches(lower(b), {q(H.DATA_MARKS)}))
SELECT d.doc_id, (SELECT b FROM p WHERE p.doc_id = d.doc_id ORDER BY s DESC, i LIMIT 1) AS block FROM documents d""")
def largest_blocks(spark, d):
    return table(spark, d, "documents").select("doc_id", H.largest_block(F.split("text", "\n"), S.LATIN).alias("block"))


@query("SELECT DISTINCT 'https://e.example/post-sitemap' || page_id % 5 || '.xml' AS url FROM pages")
def sitemap_children(spark, d):
    index = page(spark, d, "<sitemapindex><sitemap><loc> https://e.example/page-sitemap.xml </loc></sitemap></sitemapindex>")
    posts = table(spark, d, "pages").select(F.concat(F.lit("<loc>https://e.example/post-sitemap"), (F.col("page_id") % 5).cast("string"), F.lit(".xml</loc>")).alias("xml"))
    return readers.sitemap_children(index.select(F.col("html").alias("xml")).union(posts))


@query("SELECT DISTINCT url || '?a=1&b=2' AS url FROM pages")
def sitemap_articles(spark, d):
    """The first candidate holds no address, so the second counts; images go."""
    maps = page(spark, d, "<ns:url><ns:loc><![CDATA[{url}?a=1&b=2]]></ns:loc></ns:url><url><loc>{url}?a=1&amp;b=2</loc></url><url><loc>{url}.jpg</loc></url>").select(F.col("html").alias("xml"))
    return readers.first_sitemap([readers.sitemap_articles(m) for m in (maps.where("xml = ''"), maps)])


@query("SELECT DISTINCT url FROM pages")
def crawled_links(spark, d):
    """A listing of five pages that then gives nothing new."""
    pages = table(spark, d, "pages")
    return reduce(DataFrame.union, annotate.crawl(lambda n: pages.where(F.col("page_id") % 5 == (n - 1) % 5).select("url").distinct()))


@query("SELECT greatest(max(page_id), 1)::INT AS pages FROM pages")
def listing_pages(spark, d):
    return readers.total_pages(page(spark, d, "<a href='/?paged=1'>1</a><a href='/?paged={id}'>last</a>"))


@query("SELECT DISTINCT 'https://e.example/?p=' || page_id % 1000 AS url FROM pages")
def listing_links(spark, d):
    listing = page(spark, d, "{id}").select(F.concat(F.lit("<a href='/?p="), (F.col("page_id") % 1000).cast("string"), F.lit("'>a</a><a href='/about'>b</a>")).alias("html"))
    return readers.article_links(listing, BASE)


@query("SELECT 'https://e.example/' || page_id AS url FROM pages")
def home_page_links(spark, d):
    """Links to other sites, with short names, of taxonomies and repeated ones go."""
    long = "A headline of some length"
    html = f"<a href='{BASE}/{{id}}'>{long}</a><a href='{BASE}/s{{id}}'>short</a><a href='{BASE}/tag/{{id}}'>{long}</a><a href='https://other/{{id}}'>{long}</a><a href='{BASE}/{{id}}'>{long} again</a>"
    return readers.home_links(page(spark, d, html), "e.example")


@query("SELECT page_id, contains(url, 'example') AND NOT regexp_matches(lower(url), 'about|contact|category|tag|author|facebook|twitter|instagram') AS article, regexp_matches(url, '[.](jpg|png|jpeg|gif|webp|pdf)$') AS media FROM pages")
def link_filters(spark, d):
    return table(spark, d, "pages").select("page_id", U.is_article_link("url", F.lit("a name that is long"), "example").alias("article"), U.is_media("url").alias("media"))


# ---- resumable work and streams ----


class _Unsteady:
    """Fails for good on addresses of every third length, and once on those of the next."""

    def __init__(self) -> None:
        self.tried: set[str] = set()

    def __call__(self, url: str) -> str:
        if len(url) % 3 == 0:
            raise annotate.GiveUp
        if len(url) % 3 == 1 and url not in self.tried:
            self.tried.add(url)
            raise ConnectionError(url)
        return f"got {url}"


@query("SELECT page_id, CASE WHEN length(url) % 3 > 0 THEN 'got ' || url END AS html FROM pages")
def fetched_pages(spark, d):
    waits = [annotate.linear_backoff(0.0), annotate.exponential_backoff(0.0, 0.0)]
    halves = [table(spark, d, "pages").where(F.col("page_id") % 2 == i).select("page_id", "url") for i in (0, 1)]
    return reduce(DataFrame.union, [annotate.annotate(rows, annotate.fetcher(_Unsteady(), 3, wait), "url", "html").select("page_id", "html") for rows, wait in zip(halves, waits, strict=True)])


def _generator() -> annotate.Annotator:
    """Fails on a batch that holds an odd length, and alone on every fifth length."""

    def batch(texts: list[str]) -> list[str]:
        if len(texts) > 1 and any(len(t) % 2 for t in texts) or len(texts) == 1 and len(texts[0]) % 5 == 0:
            raise RuntimeError("out of memory")
        return [str(len(t)) for t in texts]

    return annotate.with_fallback(batch)


@query("SELECT doc_id, length(text) % 5 AS remainder, count(*) AS n FROM documents WHERE length(text) % 5 > 0 GROUP BY ALL")
def batch_generations(spark, d):
    """Batches that fail go row by row; what fails alone is empty, or not where its whole batch went through."""
    made = annotate.annotate(table(spark, d, "documents").select("doc_id", "text"), _generator, "text", "reply")
    return made.where("length(text) % 5 > 0").groupBy("doc_id", (F.col("reply").cast("int") % 5).cast("bigint").alias("remainder")).agg(F.count("*").alias("n"))


class _Partial:
    """Replies to texts of even length alone."""

    def __call__(self, texts: list[str | None]) -> list[str | None]:
        return [y if t is not None and len(t) % 2 == 0 else None for t, y in zip(texts, annotate.stub_annotator()(texts), strict=True)]


S_REPLIES = """SELECT doc_id, '{"sentiment": "' || CASE WHEN length(text) % 2 = 1 THEN 'Positive' ELSE 'Negative' END || '"}' AS reply FROM documents"""


@query(S_REPLIES)
def resumed_annotation(spark, d):
    """A pass that fails on some rows, and passes that take up what it left until all rows are there."""
    docs, path = table(spark, d, "documents").select("doc_id", "text"), scratch_path(spark, "replies")
    makers = iter([_Partial, *[annotate.stub_annotator] * 2])
    annotate.passes(lambda: annotate.annotate_pending(docs, path, "doc_id", next(makers), "text").count(), docs.count(), 3)
    return annotate.read_checkpoint(spark, path, "doc_id bigint, reply string")


@query(S_REPLIES)
def annotated_stream(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    source, checkpoint, out = (scratch_path(spark, x) for x in ("stream", "offsets", "out"))
    docs.write.parquet(source)
    incremental.annotate_stream(incremental.read_stream(spark, source, docs.schema), checkpoint, out, "doc_id", annotate.stub_annotator, "text").awaitTermination()
    return spark.read.schema("doc_id bigint, reply string").parquet(out)


@query("SELECT DISTINCT lower(regexp_replace(trim(substr(text, 1, 200), ' ' || chr(9) || chr(10) || chr(13)), '\\s+', ' ', 'g')) AS key FROM documents")
def first_seen_stream(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.lit("2024-01-01").cast("timestamp").alias("at"))
    source, checkpoint, out = (scratch_path(spark, x) for x in ("stream", "offsets", "out"))
    docs.write.parquet(source)
    seen = incremental.first_seen(incremental.read_stream(spark, source, docs.schema), "text", "at")
    incremental.append_stream(seen, out, checkpoint).awaitTermination()
    return spark.read.schema(docs.schema).parquet(out).select(X.folded_prefix_key("text").alias("key"))


# ---- replies and scores ----


@query("""SELECT doc_id, CASE WHEN quality = 1 THEN 'joy' WHEN toxic = 1 THEN 'fear' END AS dominant_emotion, quality = 1 OR toxic = 1 AS accepted, quality = 1 AND toxic = 0 AS complete FROM labels""")
def classified_emotion(spark, d):
    """Scores of joy, none but a stated label, and a label that there isn't; then what may be kept and exported."""
    score = lambda e: (F.col("quality") if e == "joy" else F.lit(0)).cast("double").alias(f"ekman_{e}")
    stated = F.when(F.col("toxic") == 1, " FEAR ").otherwise("none").alias("dominant_emotion")
    emotion = N.parse_classified_emotion(F.concat(F.lit("So: "), F.to_json(F.struct(*map(score, S.EMOTIONS), stated)), F.lit(" that's it")))
    rows = table(spark, d, "labels").select("doc_id", "quality", "toxic", emotion.alias("e"))
    complete = N.is_complete(F.when(F.col("toxic") == 0, "a summary").otherwise(" "), F.col("e"), F.lit("Positive")) & F.col("e.scores").isNotNull()
    return rows.select("doc_id", "e.dominant_emotion", N.accept_classification(F.col("e"), F.lit("positive")).alias("accepted"), complete.alias("complete"))


@query("SELECT doc_id, NOT (toxic = 1 AND quality = 0) AS accepted FROM labels")
def accepted_annotations(spark, d):
    neutral = F.struct(N.one_hot(F.when(F.col("quality") == 1, "joy").otherwise("neutral"), S.EMOTIONS).alias("scores"), F.when(F.col("quality") == 1, "joy").otherwise("neutral").alias("dominant_emotion"))
    return table(spark, d, "labels").select("doc_id", N.accept_annotation(F.when(F.col("toxic") == 0, "a summary"), neutral).alias("accepted"))


@query(s_rouge(1).replace("regexp_extract_all(ref, " + q(f"([^{X.WS}]+)") + ", 1)", "regexp_extract_all(lower(ref), '([a-z0-9]+)', 1)").replace("regexp_extract_all(hyp, " + q(f"([^{X.WS}]+)") + ", 1)", "regexp_extract_all(lower(hyp), '([a-z0-9]+)', 1)"))
def rouge_ascii(spark, d):
    return O.rouge_n(_pairs(spark, d), ["k"], "ref", "hyp", 1, O.ascii_tokens)


def _blanked(spark, d) -> DataFrame:
    return _pairs(spark, d).withColumn("hyp", F.when(F.col("k") % 7 > 0, F.col("hyp")).otherwise(" "))


S_BLANKED = S_PAIRS.replace("b.text AS hyp", "CASE WHEN (a.conv_id * 1000 + a.turn) % 7 > 0 THEN b.text ELSE {} END AS hyp")


@query("WITH one AS (" + s_rouge(1).replace(S_PAIRS, S_BLANKED.format("'खाली'")) + "), two AS (" + s_rouge(2).replace(S_PAIRS, S_BLANKED.format("'खाली'")) + ") SELECT k, round(one.f1, 4) AS rouge1, round(two.f1, 4) AS rouge2 FROM one JOIN two USING (k)")
def instance_scores(spark, d):
    """The rounded table of single items, with a word in the place of empty outputs."""
    return O.instance_table(O.score_pairs(_blanked(spark, d), "k", "ref", "hyp", placeholder="खाली"), ["k"]).select("k", "rouge1", "rouge2")


S_STRIPPED = "trim({0}, ' ' || chr(9) || chr(10) || chr(13))"


@query(f"""WITH {S_BLANKED.format("''")}, p AS (SELECT {S_STRIPPED.format('ref')} AS r, {S_STRIPPED.format('hyp')} AS h FROM pairs),
s AS (SELECT *, CASE WHEN r <> '' AND h <> '' THEN len(list_filter(range(1, least(length(r), length(h)) + 1), lambda i: r[i] = h[i]))::DOUBLE / greatest(length(r), length(h)) ELSE 0.0::DOUBLE END AS f FROM p)
SELECT 'run' AS run, 42 AS seed, count(*) AS n, count(*) FILTER (h = '') AS n_empty, round(avg((h <> '')::INT), 3) AS valid_rate, round(avg(f), 3) AS bertscore_f1, round(avg(f) FILTER (r <> '' AND h <> ''), 3) AS bertscore_f1_nonempty, NULL::DOUBLE AS hit_cap FROM s""")
def run_report(spark, d):
    """A run's manifest, and the results table of it: chosen columns, rounded, a missing one null."""
    pairs = _blanked(spark, d).select(F.col("k").alias("row_key"), "ref", F.col("hyp").alias("generated"))
    metrics = jobs.evaluate_generations(pairs.select("row_key", "ref"), pairs.select("row_key", "generated"), "run", "ref", scorer=O.stub_scorer)[1]
    record = jobs.manifest(metrics, seed=P.PROTOCOL["seed"]).select("run", "seed", "metrics.*")
    return tables.results_table(record, ["run", "seed", "n", "n_empty", "valid_rate", "bertscore_f1", "bertscore_f1_nonempty", "hit_cap"])
