"""Text, address, reply and prompt functions on hand-written rows."""

import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievestone import schemas as S
from sievestone.functions import addresses as U
from sievestone.functions import pages as H
from sievestone.functions import prompts as P
from sievestone.functions import replies as N
from sievestone.functions import text as X
from sievestone.operators import overlap as O
from sievestone.operators import profile
from sievestone.operators import validation as V


def on(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[1] for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_white_space_is_unicode(spark):
    texts = [" a\x1c", "\x85a b ", " a​", None]
    assert on(spark, texts, X.strip_ws("t")) == ["a", "a b", "a​", None]
    assert on(spark, texts[:3], X.word_count("t")) == [len(t.split()) for t in texts[:3]]


def test_script_ratios(spark):
    texts = ["कि", "ab\U0001f600क", ""]
    assert on(spark, texts, X.script_ratio_chars("t")) == [1.0, 0.25, 0.0]
    assert on(spark, texts, X.script_ratio_letters("t")) == [2.0, pytest.approx(1 / 3), 0.0]  # a vowel sign is no letter


def test_language_by_markers(spark):
    texts = ["ओ घर गेल छथि अछि", "वह नहीं करते हैं।", "अछि छथि छलाह नहीं", "abc"]
    assert on(spark, texts, X.detect_language("t", S.MAITHILI_HINDI)) == ["Maithili", "Hindi", "Maithili-Hindi Mixed", "Maithili"]
    assert on(spark, texts[2:3], X.foreign_percent("t", S.MAITHILI_HINDI)) == [25.0]


BODY = "मैथिली भाषा " * 10


def test_preamble(spark):
    texts = [
        f"लेख विचार प्रेषित : लेखक श्रोत – नाम, वृहस्पतिवार , साप्ताहिक गतिविधि विषय – {BODY}",
        f"नाम बृहस्पतिवार साप्ताहिक गतिविधि विषय : {BODY}",
        f"साप्ताहिक गतिविधि विषय - {BODY}",
        BODY,
        "लेख विचार प्रेषित : छोट",
    ]
    want = [BODY.strip()] * 3 + [BODY, texts[4]]
    assert on(spark, texts, X.strip_preamble("t")) == want
    assert on(spark, texts, X.repair_preamble("t")["state"]) == ["repaired"] * 3 + ["clean", "unfixable"]


def test_cleaners(spark):
    mixed = "see https://x.y राम\u200b the-end 12।"
    assert on(spark, [mixed], X.clean_to_script("t")) == [": . राम 12।"]  # letters go first, so the address is never seen whole
    assert on(spark, [mixed], X.clean_to_script("t", urls_first=True)) == ["राम 12।"]
    assert on(spark, ["राम #tag आ. Share  this now. घर # x"], X.clean_social("t")) == ["राम आ. घर x"]
    assert on(spark, ['a {"b"}  [c]'], X.clean_brackets("t")) == ["a b c"]
    decomposed = unicodedata.normalize("NFD", "é")
    assert on(spark, [f" {decomposed}​\x07\n x ", " NaN ", None], X.clean_article("t")) == ["é x", "", ""]
    assert on(spark, ["<|assistant|> सारांश: “राम घर” </s>", None], X.clean_output("t")) == ["राम घर", ""]
    assert on(spark, ["hELLO wORLD", ""], X.capitalize("t")) == ["Hello world", ""]


def test_case_is_by_the_character(spark):
    assert on(spark, ["ßA", "ﬁN", "ΑΣ", "ªİ", "ᾳΣ x", "éÀ"], X.capitalize("t")) == ["ẞa", "ﬁn", "Ασ", "ªi", "ᾼσ x", "Éà"]
    assert on(spark, ["ΑΣ İ"], X.folded_prefix_key("t")) == on(spark, ["ΑΣ İ"], X.fingerprint("t")) == ["ασ i"]


def test_flags(spark):
    got = on(spark, ["#x read more <b> ...", None, "क" * 600], X.quality_flags("t"))
    assert got[0] == ["LOW_DEVANAGARI", "HIGH_ENGLISH", "LEFTOVER_HASHTAG", "HASHTAG_TOKEN", "SOCIAL_BOILERPLATE", "HTML_ARTIFACT", "POSSIBLE_TRUNCATION", "BELOW_MIN_LENGTH", "SHORT_ARTICLE", "LOW_UNIQUE_WORDS"]
    assert got[1] == ["LOW_DEVANAGARI", "BELOW_MIN_LENGTH", "SHORT_ARTICLE", "LOW_UNIQUE_WORDS"]
    assert got[2] == ["LOW_UNIQUE_WORDS"]


FURNITURE = ["Share  this", "xFOLLOW US", "sharethis", "TAGS:", "tag", "category :", "all rights  reserved", "alL", "term of use", "also\nread", "क read more", "rea", None, ""]


def test_furniture_and_markup_by_plain_patterns(spark):
    for pattern in (X.BOILERPLATE, X.FLAG_BOILERPLATE, "ab|c+"):
        assert on(spark, FURNITURE, X.has_boilerplate("t", pattern)) == [None if t is None else bool(re.search(f"(?i){pattern}", t)) for t in FURNITURE]
    marks = ["a<b", "<", "&amp", "&amp;", "[caption", "[x", "-->", "->", "<!--", "x..", "x.. \n", "x..y", "क्लिक", "xक्लिक", "a क्लिक ", 'In "x', "In x", None]
    assert on(spark, marks, X.has_markup("t")) == on(spark, marks, F.col("t").rlike(X.HTML_ARTIFACTS))
    assert on(spark, marks, X.is_truncated("t")) == on(spark, marks, F.col("t").rlike(X.TRUNCATION))


def test_tokens_of_all_white_space(spark):
    gaps = [chr(i) for i in range(0x3001) if chr(i).isspace()]
    texts = ["", " ", "a", *[f"{g}a{g}{g}\u200b😀{g}" for g in gaps], "\x00 \x7f", None, " ".join(f"w{i % 19}" for i in range(200)) + " z", " w" * 82 + "".join(f" x{i}" for i in range(18))]
    assert on(spark, texts, X.tokens("t")) == [None if t is None else t.split() for t in texts]
    assert on(spark, texts, X.word_count("t"))[:4] == [0, 0, 1, 2]
    for n in (2, 19, 20):
        assert on(spark, texts, X.has_unique_words("t", n)) == [None if t is None else len(set(t.split())) >= n for t in texts]


def test_stray_symbols_in_order(spark):
    texts = ["b#a😀#क*", "ab-\"c", "", None, "^_`{|}~é"]
    assert on(spark, texts, V.stray_symbols("t", S.LATIN_ACCENTED)) == [["#", "😀", "क", "*"], [], [], None, list("^_`{|}~")]
    assert on(spark, texts, V.stray_symbols("t"))[0] == ["b", "#", "a", "😀", "*"]


def test_texts_are_read_once(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    flags = df.select("doc_id", X.quality_flags("text").alias("flags"))
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert [plan(x).count("LOW_DEVANAGARI") for x in (profile.flag_counts(flags), profile.flag_samples(flags, "doc_id"))] == [1, 1]
    assert [plan(f(df, X.word_count("text"))).count("split(") for f in (profile.describe_words, profile.length_summary)] == [1, 1]


def test_addresses(spark):
    urls = ["/?p=12", "https://m.example/?x=1&p=7", "https://m.example/?p=a", None]
    assert on(spark, urls, U.canonical_article_url("t", "https://m.example")) == ["https://m.example/?p=12", "https://m.example/?p=7", None, None]
    assert on(spark, ["https://a.b:80/c/d?e", "https://a.b", "/x"], U.url_category("t")) == ["c", "", "x"]
    assert on(spark, ["https://a.b:80/c"], U.netloc("t")) == ["a.b:80"]


def test_pages(spark):
    page = '<title>T - Site</title><div class="entry-content"><p>one</p><div class="related"><p>no</p></div><p>two<p>three</div>'
    pages = [page, "<h1></h1><title>x</title>", '<meta property="og:title" content=" og ">', None]
    assert on(spark, pages, H.headline("t", (" - Site",))) == ["T", "", "og", ""]
    assert on(spark, pages[:1], H.paragraphs("t", S.SiteProfile())) == [["one", "two", "three"]]
    card = '<article><h2 class="entry-title"><a href="https://s/x">t</a></h2><a rel="bookmark" href="https://s/y">d</a></article>'
    assert on(spark, [card], H.permalink("t", "https://s/")) == ["https://s/y"]


def test_headline_with_named_entities(spark):
    pages = ["<h1> a&amp;b &amp</h1>", "<h1>&quot;x&#39; &lt;b&gt;&am</h1>", "<title>&amp;quot</title>", None]
    own = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
    assert on(spark, pages, H.headline("t", entities=own)) == ["a&b &amp", "&quot;x&#39; <b>&am", "&quot", ""]
    assert on(spark, pages, H.headline("t")) == ["a&b &", "\"x' <b>&am", "&quot", ""]


def test_paragraph_rules_skip_before_stop(spark):
    long = "क" * 60
    df = spark.createDataFrame([([long, "related", long + "1", "related " + long, long],)], "p array<string>")
    assert df.select(H.body_paragraphs(F.col("p"))).first()[0] == [long, long + "1"]  # the short one is skipped and doesn't stop


EMOTION = '{"ekman_joy": 2, "ekman_sadness": 1, "ekman_anger": 1, "ekman_fear": 0, "ekman_disgust": 0, "ekman_surprise": 0, "ekman_neutral": 0, "dominant_emotion": "fear"}'


def test_replies(spark):
    zero = EMOTION.replace("2", "0").replace("1", "0")
    texts = [EMOTION, f"```json\n{EMOTION}\n```", zero, zero.replace("fear\"}", "none\"}"), '{"ekman_joy": 1}', "no json", "", None]
    kept = on(spark, texts, N.parse_annotated_emotion("t"))
    assert [k["dominant_emotion"] for k in kept] == ["joy", "joy"] + ["neutral"] * 6 and kept[0]["scores"][0] == 0.5
    found = on(spark, texts, N.parse_classified_emotion("t"))
    assert [k["dominant_emotion"] for k in found] == ["joy", "joy", "fear", None, None, None, None, None]
    chat = '<think>{"sentiment": "x"}</think>{"a": 1} {"sentiment": " POSITIVE "} {"b": {"c": 1}}'
    assert on(spark, [chat, "{a} {b}", "{ {x} y", "none"], N.extract_json("t", "sentiment")) == ['{"sentiment": " POSITIVE "}', "{b}", "{x}", "none"]
    assert on(spark, [chat, "x"], N.parse_sentiment("t", "classify")) == ["positive", None]
    assert on(spark, ['{"sentiment": "negative"}', "x"], N.parse_sentiment("t")) == ["Negative", "Neutral"]
    assert on(spark, ['{"sentiment": "negative"}'], N.parse_sentiment("t", "exact")) == ["Neutral"]


def test_replies_are_parsed_once(spark):
    df = spark.createDataFrame([("{}",)], "t string")
    for parse in (N.parse_annotated_emotion, N.parse_classified_emotion):
        assert df.select(parse("t").alias("e"))._jdf.queryExecution().analyzed().toString().count("get_json_object") == 8


def test_prompts(spark):
    assert on(spark, ["a {b} c"], P.render("<{text}|{text}>", text=F.col("t"))) == ["<a {b} c|a {b} c>"]
    spec = on(spark, ["openrouter:m/x:free", "m:x", "y"], P.parse_model_spec("t"))
    assert [(r["provider"], r["model"]) for r in spec] == [("openrouter", "m/x:free"), ("groq", "m:x"), ("groq", "y")]
    assert on(spark, ["x"], P.instruction(F.array(F.lit("p"), F.lit("q")), F.array(F.lit("b")))) == ["p\n\nq\n- b"]


words = st.lists(st.sampled_from("abcd"), max_size=12)


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0, *row]
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j + 1] + 1 if x == y else max(row[j + 2], new[-1]))
        row = new
    assert O.lcs_length(a, b) == row[-1]


def test_overlap_scores(spark):
    df = spark.createDataFrame([(1, "a b c d", "a b c d"), (2, "a b", ""), (3, "a b c", "c a b"), (4, None, None), (5, "x, 3.5 y.", "x, 3.5 z.")], "k int, ref string, hyp string")
    got = {r["k"]: r for r in O.score_pairs(df, "k", "ref", "hyp").collect()}
    assert got[1]["rouge1"] == got[1]["rouge2"] == got[1]["rougeL"] == 1 and got[1]["bleu"] == pytest.approx(1)
    assert got[2]["rouge1"] == got[2]["bleu"] == got[4]["rougeL"] == 0
    assert got[3]["rouge1"] == 1 and got[3]["rouge2"] == 0.5 and got[3]["rougeL"] == pytest.approx(2 / 3)
    assert 0 < got[5]["bleu"] < 1
    native = df.where("k IN (1, 3)").select("k", O.rouge_l_native(X.tokens("ref"), X.tokens("hyp")).alias("n")).orderBy("k").collect()
    assert [r["n"] for r in native] == [4, 2]


def test_pairs_are_scored_row_by_row(spark):
    df = spark.createDataFrame([(1, "a b a c", "a b b a c d"), (2, "a", "a"), (3, "a a a", "a a"), (4, "x", None), (5, "", "y z")], "k int, ref string, hyp string")
    items = O.score_pairs(df, "k", "ref", "hyp")
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Join|Aggregate", plan)
    for n in (1, 2):
        assert {r["k"]: r[f"rouge{n}"] for r in items.collect()} == {r["k"]: r["f1"] for r in O.rouge_n(df, ["k"], "ref", "hyp", n).collect()}


def test_articles_are_cleaned_once(spark):
    df = spark.createDataFrame([("<article><p>" + "a long text. " * 20 + "</p></article>",)], "html string")
    found = H.extract_articles(df, S.SiteProfile((("article", ""),)), script=S.LATIN)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_deep_pages(spark):
    deep = "<div>" * 5000 + "<p>deep <b>text</b></p><a href='/x'>link</a>" + "</div>" * 5000
    df = spark.createDataFrame([(deep,), ("<h1>a</h1>" + "<p>x<div>" * 3000,), (None,), ("",)], "html string")
    got = df.select(H.headline("html").alias("h"), F.size(H.links("html")).alias("n"), H.text_blocks("html").alias("b")).collect()
    assert [r["h"] for r in got] == ["", "a", "", ""] and [r["n"] for r in got] == [1, 0, 0, 0] and got[0]["b"] == ["deep", "text", "link"]


def test_grams_bind_their_tokens(spark):
    df = spark.createDataFrame([("a b c d",), ("a",), ("",), (None,)], "t string")
    grams = lambda n: [r[0] and [g.replace("\x01", "_") for g in r[0]] for r in df.select(O.ngrams(X.tokens("t"), n)).collect()]
    assert grams(1)[:3] == [["a", "b", "c", "d"], ["a"], []] and grams(2)[:3] == [["a_b", "b_c", "c_d"], [], []] and grams(4)[0] == ["a_b_c_d"]
    assert [r[0] for r in df.select(X.has_unique_words("t", 2)).collect()][:3] == [True, False, False]
