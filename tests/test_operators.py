"""Operators on small frames: golden metrics, lookups, checkpoints, readers and streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sievestone import schemas as S
from sievestone import source_queries
from sievestone.functions import pages
from sievestone.functions import text as X
from sievestone.operators import annotate, cleaning, overlap, profile, tables, validation
from sievestone.operators import classification as C
from sievestone.schemas import DEVANAGARI, SENTIMENTS
from sievestone.plans import jobs
from sievestone.sources import readers, writers
from sievestone.streaming import incremental

# Published confusion matrices and the scores that go with them.
GOLDEN = json.load(open(os.path.join(os.path.dirname(__file__), "fixtures/slices.json")))


def test_golden_scores(spark):
    rows = []
    for i, s in enumerate(GOLDEN):
        for axis, k in (("emo", "emotion"), ("sent", "sentiment")):
            m = s[f"{k}_confusion_matrix"]
            rows += [(i, axis, g, p, n) for g, line in zip(m["labels"], m["matrix"]) for p, n in zip(m["labels"], line)]
    counts = spark.createDataFrame(rows, "slice int, axis string, gold string, pred string, n long")
    for r in C.summary(C.label_margins(counts, ["slice", "axis"]), ["slice", "axis"]).collect():
        s, a = GOLDEN[r["slice"]], r["axis"]
        assert r["accuracy"] == pytest.approx(s.get(f"{a}_acc", s.get(f"{a}_preserved_acc")), abs=1e-12)
        for ours, theirs in (("macro_precision",) * 2, ("macro_recall",) * 2, ("macro_f1",) * 2, ("weighted_f1",) * 2, ("kappa",) * 2):
            assert r[ours] == pytest.approx(s[f"{a}_{theirs}"], abs=1e-12)


def test_kappa_undefined_and_fixed_labels(spark):
    counts = spark.createDataFrame([("s", "positive", "positive", 3)], "k string, gold string, pred string, n long")
    r = C.summary(C.label_margins(counts, ["k"], SENTIMENTS), ["k"]).first()
    assert r["kappa"] is None and r["macro_f1"] == pytest.approx(1 / 3)


def test_js_divergence(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5]), ([0.0, 0.0], [1.0, 0.0])], "p array<double>, q array<double>")
    got = [r[0] for r in df.select(C.js_divergence(F.col("p"), F.col("q"))).collect()]
    assert got[0] == pytest.approx(1) and got[1] == pytest.approx(0) and got[2] is None


def test_drop_reasons_conserve_rows(spark):
    deva = "मैथिली " * 40
    rows = [(1, deva), (2, deva + "x"), (3, "latin " * 60), (4, "छोट"), (5, None), (6, "क" * 500 + "a"), (7, "क" * 500 + "b")]
    df = spark.createDataFrame(rows, "id int, t string")
    got = {r["id"]: r["reason"] for r in cleaning.drop_reasons(df, "t", "id", DEVANAGARI).collect()}
    assert got == {1: "kept", 2: "kept", 3: "low_script", 4: "too_short", 5: "low_script", 6: "kept", 7: "duplicate"}


def test_columns(spark):
    df = spark.createDataFrame([("u", "t"), ("v", None), ("w", " ")], "article_link string, `﻿article_text ` string")
    got = tables.normalize_columns(df, {"article_link": "article_url"})
    assert got.columns == ["website", "article_url", "language", "headline", "article_text"] and got.count() == 1
    assert tables.resolve_aliases(spark.createDataFrame([("a", "b")], "Body string, TITLE string")).columns == ["article_text", "headline"]


def test_unique_keys(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], "id int, k string")
    assert sorted(r["k"] for r in tables.unique_keys(df, "k", "id").collect()) == ["a_0", "a_2", "b_1"]
    assert sorted(r["k"] for r in tables.unique_keys(df.where("id < 3"), "k", "id").collect()) == ["a", "b"]


def test_split_sizes(spark):
    got = {r["split"]: r["count"] for r in tables.split_exact(spark.range(2010).toDF("id"), "id").groupBy("split").count().collect()}
    assert got == {"train": 1608, "val": 201, "test": 201}


def test_stats(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4)], "v int")
    r = profile.nearest_rank_stats(df, F.col("v").cast("bigint")).first()
    assert (r["n"], r["mean"], r["median"], r["p10"], r["p90"]) == (4, 2, 3, 1, 4)
    assert profile.duplicate_rows(spark.createDataFrame([("a",), (None,), (None,)], "k string"), F.col("k")).first()[0] == 1


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", 'say "x"'), ("", "ü")], "t string, u string")
    writers.export_csv(df, str(tmp_path / "x.csv"))
    assert sorted(map(tuple, readers.read_strings(spark, str(tmp_path / "x.csv")).collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "l.csv").write_bytes("t\nü\n".encode("latin-1"))
    assert readers.read_articles_any(spark, str(tmp_path / "l.csv")).first()[0] == "ü"


#: Texts that a CSV reader or writer may trim, take for null or split.
ODD = [" a", "a ", "\n\ta\n", "\r", "a\r\nb", "", " ", None, "\x00", '\x00\n"', "\x1fa", '"', '""', '"a",\n"', "\\", '\\"', ",", "\ufeffa", "a\u2028", "null", "#a"]


def test_csv_keeps_every_character(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(ODD)), "k int, t string")
    writers.write_csv(df, str(tmp_path / "x"))
    assert {r["k"]: r["t"] for r in readers.read_articles(spark, str(tmp_path / "x"), df.schema).collect()} == dict(enumerate(ODD))


def test_latin1_keeps_white_space(spark, tmp_path):
    spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {int(r["doc_id"]): r["text"] for r in source_queries.csv_latin1(spark, str(tmp_path)).collect()}
    assert got == {k: None if t is None else "".join(x if x <= "\xff" else "?" for x in t[:200]) + " ü" for k, t in enumerate(ODD)}


def test_metric_bundles(spark, tmp_path):
    one = {"language": "a", "model": "m", "n_scored": 1, "emo_acc": 0.5, "emotion_per_class": {"joy": {"precision": 1, "recall": 1, "f1-score": 1, "support": 2}, "accuracy": None}}
    for name, doc in (("1", one), ("2", [one, one | {"model": "n"}]), ("3", {"slices": [one | {"model": "o"}]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    got = readers.read_metric_slices(spark, str(tmp_path))
    assert sorted(r["model"] for r in got.collect()) == ["m", "m", "n", "o"]
    assert tables.first_wins(got).count() == 3
    assert {r["class"] for r in C.unpivot_per_class(got).collect()} == {"joy"}


def test_json_map_and_sitemap(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"u": "h", "v": "FETCH_ERROR"}')
    assert readers.read_json_map(spark, str(tmp_path / "c.json"), "string").count() == 2
    assert readers.read_json_map(spark, str(tmp_path / "none.json"), "string").count() == 0
    xml = spark.createDataFrame([("<urlset><url><loc> https://a/1 </loc></url><ns:loc>https://a/2.jpg</ns:loc></urlset>",)], "xml string")
    assert [r[0] for r in readers.sitemap_articles(xml).collect()] == ["https://a/1"]


def test_long_texts_make_short_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    long = spark.range(200).select("id", F.repeat(F.lit("x"), 100_000).alias("t")).coalesce(1)
    rows = annotate.annotate(long, lambda: lambda texts: [str(len(texts))] * len(texts), "t", "n", batch=1000)
    assert max(int(r["n"]) for r in rows.select("n").collect()) <= 40
    for column in (lambda: pages.headline("t"), lambda: overlap.bleu_stats(X.tokens("t"), X.tokens("t")), lambda: overlap.rouge_l(X.tokens("t"), X.tokens("t"))):
        spark.conf.unset(key)
        column()
        assert spark.conf.get(key) == str(2 << 20)


def test_annotation_resumes(spark, tmp_path):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "abc")], "k int, t string")
    done = annotate.annotate_pending(df, str(tmp_path / "ck"), "k", annotate.stub_annotator, "t")
    assert sorted(r["k"] for r in done.collect()) == [1, 3]
    assert annotate.annotate_pending(df, str(tmp_path / "ck"), "k", annotate.stub_annotator, "t").count() == 2


def test_retries():
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError
        return x

    def gone(x):
        raise annotate.GiveUp

    assert annotate.with_retries(flaky, 4, sleep=lambda s: None)(7) == 7 and len(calls) == 3
    assert annotate.with_retries(gone, 4, sleep=lambda s: pytest.fail("waited"))(1) is None
    assert annotate.with_fallback(lambda xs: [1 // x for x in xs])([1, 0]) == [1, ""]


def test_stream_annotates_once(spark, tmp_path):
    schema = "k int, t string"
    src = str(tmp_path / "in")
    for i in range(2):
        spark.createDataFrame([(i, "x" * i), (9, "y")], schema).coalesce(1).write.mode("append").parquet(src)
    rows = incremental.read_stream(spark, src, spark.read.parquet(src).schema)
    incremental.annotate_stream(rows, str(tmp_path / "ck"), str(tmp_path / "out"), "k", annotate.stub_annotator, "t").awaitTermination()
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 9]


def test_a_key_that_most_rows_share(spark):
    rows = [(i, "same text " * 30 if i % 3 else f"some words {i} " * 40, None if i % 5 == 0 else "k") for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, text string, k string")
    want = {}
    for i, t, _ in rows:
        want.setdefault(t.strip()[:500].strip(), i)
    assert sorted(r["id"] for r in cleaning.keep_first(df, [X.prefix_key("text")], ["id"]).collect()) == sorted(want.values())
    linked = {r["id"]: r for r in cleaning.keep_first(df, [F.col("k")], ["id"], link="id").collect()}
    assert len(linked) == 300 and all(r["first_id"] == (0 if r["k"] is None else 1) and r["is_first"] == (i in (0, 1)) for i, r in linked.items())
    reasons = {r["id"]: r["reason"] for r in cleaning.drop_reasons(df, "text", "id", S.LATIN).collect()}
    assert {i for i, x in reasons.items() if x == "kept"} == set(want.values()) and len(reasons) == 300
    empty = df.where("id < 0")
    assert cleaning.keep_first(empty, [F.col("k")], ["id"]).count() == cleaning.drop_reasons(empty, "text", "id", S.LATIN).count() == 0


def test_positions_of_strings_and_nulls(spark):
    rows = [(None if i % 50 == 0 else f"key {i * 7919 % 1000:04d} é", i) for i in range(500)]
    got = tables.positions(spark.createDataFrame(rows, "k string, i int"), "k", "at").collect()
    assert sorted(r["at"] for r in got) == list(range(500))
    keys = [r["k"] for r in sorted(got, key=lambda r: r["at"])]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    assert tables.positions(spark.createDataFrame([], "k string"), "k", "at").count() == 0


def test_repeated_generations_without_an_order(spark):
    tests = spark.createDataFrame([("a",), ("b",)], "row_key string")
    made = spark.createDataFrame([("a", "x"), ("a", "z"), ("a", "y")], "row_key string, generated string").repartition(3)
    assert {r["row_key"]: r["generated"] for r in tables.join_generations(tests, made).collect()} == {"a": "z", "b": ""}


def test_poisson_weights(spark):
    rows = [("r" if i % 2 else "s", i, float(i % 7)) for i in range(4000)]
    df = spark.createDataFrame(rows, "run string, k bigint, m double").repartition(5)
    got = {r["run"]: (r["lo"], r["hi"]) for r in overlap.poisson_ci(df, ["run"], "k", "m", 500).collect()}
    exact = {r["run"]: (r["lo"], r["hi"]) for r in overlap.bootstrap_ci(df, ["run"], "k", ["m"], 500).collect()}
    assert all(abs(a - b) < 0.03 for run in ("r", "s") for a, b in zip(got[run], exact[run]))
    assert got == {r["run"]: (r["lo"], r["hi"]) for r in overlap.poisson_ci(df.repartition(2), ["run"], "k", "m", 500).collect()}  # whatever the partitions


def test_runs_side_by_side(spark):
    items = overlap.score_pairs(spark.createDataFrame([("a", 1, "x y z", "x y"), ("a", 2, "p q", ""), ("b", 1, "x y z", "x y z")], "run string, k int, ref string, hyp string"), ["run", "k"], "ref", "hyp", scorer=overlap.stub_scorer)
    got = {r["run"]: r for r in jobs.run_metrics(items, ["run"], "k", 50).collect()}
    assert (got["a"]["n"], got["a"]["n_empty"], got["b"]["rouge1"], got["b"]["bleu_corpus"]) == (2, 1, 1.0, 0.0)
    assert got["a"]["bertscore_f1"] == got["a"]["bertscore_f1_nonempty"] / 2 == pytest.approx(0.3)


def test_validator_names_the_least_links(spark):
    rows = [(f"https://maithilijindabaad.com/?p={i % 4}", "क" * 300, "x") for i in range(8)] + [("bad", "short", "x"), (None, None, None)]
    report = {r["check_name"]: r for r in validation.validation_report(spark.createDataFrame(rows, "article_link string, article_text string, article_language string"), validation.ValidationProfile()).collect()}
    assert report["duplicate_links"]["examples"] == [f"https://maithilijindabaad.com/?p={i}" for i in range(4)] and report["duplicate_texts"]["affected"] == 1
    assert report["url_format"]["affected"] == 2 and report["required_columns"]["examples"] == []
    assert validation.validation_report(spark.createDataFrame([], "article_text string"), validation.ValidationProfile()).where("check_no = 1").first()["examples"] == ["article_language", "article_link"]


def test_workbook(spark, tmp_path):
    import zipfile

    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f"""<worksheet {space}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>b &amp; c</t></is></c><c r="C1" t="str"><v>n</v></c></row>
<row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>1.50</v></c></row><row><c r="B3" t="s"><v>1</v></c></row></sheetData></worksheet>"""
    with zipfile.ZipFile(tmp_path / "book.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {space}><si><t>a</t></si><si><r><t>क</t></r><r><t> x</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    got = readers.read_excel(spark, f"file://{tmp_path}/book.xlsx")
    assert got.columns == ["a", "b & c", "n"] and [tuple(r) for r in got.collect()] == [("क x", "", "1.50"), ("", "क x", "")]
