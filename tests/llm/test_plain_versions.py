"""Models and placements against plain versions, and all ten queries on a table of awkward rows."""

import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sievestone.llm import boosting, html_extract, langid, packing, quality, toxicity
from sievestone.llm.dom import parse
from sievestone.llm.queries import QUERIES


# ---- plain versions ----


def plain_grams(text):
    words, now = [], ""
    for c in text.lower():
        if c.isalpha():
            now += c
        else:
            words, now = words + [now] * bool(now), ""
    words += [now] * bool(now)
    found = Counter()
    line = "\0" + "\0".join(words) + "\0"
    for i, c in enumerate(line):
        if c != "\0":
            found[ord(c)] += 1
            found[ord(line[i - 1]) | ord(c) << 21 | ord(line[i + 1]) << 42] += 1
        if i + 1 < len(line):
            found[-(ord(c) | ord(line[i + 1]) << 21)] += 1
    return found if words else Counter()


def plain_rank(counts):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))][: langid.PROFILE]


def test_profiles_and_distances(spark):
    rng = random.Random(21)
    letters = {"aa": "abcdeé", "bb": "defghß", "cc": "क़खगघ"}
    text = lambda lang: " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(1, 7))) + rng.choice(("", ".", " 12", "\n")) for _ in range(rng.randint(1, 60)))
    rows = [(i, text(lang), lang) for i, lang in enumerate(list(letters) * 30)]
    rows += [rows[0], (500, None, "aa"), (501, "zz", None), (502, "", "aa")]
    learnt = langid.learn_profiles(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), 10**6)
    profiles = {}
    for lang in letters:
        total = Counter()
        for _, t, x in rows:
            if x == lang and t:
                total += plain_grams(t)
        profiles[lang] = plain_rank(total)
    for lang, (codes, ranks) in zip(learnt.languages, learnt.sorted, strict=True):
        assert [int(c) for c in codes[np.argsort(ranks)]] == profiles[lang]
    for t in [text(lang) for lang in letters for _ in range(20)] + ["", "1 !", "x", "İÜ", "aa bb कख" * 300]:
        own = plain_rank(plain_grams(t))
        far = {lang: sum(abs(p.index(g) - i) if g in p else langid.PROFILE for i, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(far, key=lambda x: (far[x], x))
        want = (best, 1 - far[best] / min(v for k, v in far.items() if k != best)) if own else ("und", 0.0)
        assert learnt.predict(t) == pytest.approx(want) if own else learnt.predict(t) == want


def test_pairwise_ranking(monkeypatch):
    monkeypatch.setattr(quality, "EPOCHS", 12)
    monkeypatch.setattr(quality, "PAIRS", 40)
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(90, 3)), rng.integers(0, 2, 90)
    x[y == 1] += 0.7
    x[5] = x[6]
    ranker = quality.fit(x, y, 0.25)
    step = lambda row: [float(v > c) for v, cuts in zip(row, ranker.cuts) for c in cuts]
    good, bad = ([step(r) for r in x[y == k]] for k in (1, 0))
    draw = np.random.default_rng(7)
    w, seen = [0.0] * len(good[0]), [1e-6] * len(good[0])
    for _ in range(12):
        slope = [-1e-4 * v for v in w]
        for i, j in zip(draw.integers(len(good), size=40), draw.integers(len(bad), size=40)):
            d = [p - q for p, q in zip(good[i], bad[j])]
            lost = 1 / (1 + np.exp(sum(p * q for p, q in zip(d, w))))  # the slope of -log sigmoid of the preference
            slope = [s + lost * v / 40 for s, v in zip(slope, d)]
        seen = [a + b * b for a, b in zip(seen, slope)]
        w = [a + 0.2 * b / c**0.5 for a, b, c in zip(w, slope, seen)]
    assert ranker.weights == pytest.approx(w, abs=1e-4)
    raw = np.array([sum(a * b for a, b in zip(step(r), w)) for r in x])
    weight = np.where(y == 1, 0.75 / y.sum(), 0.25 / (1 - y).sum())
    assert abs(weight[raw < ranker.middle].sum() - 0.25) <= weight.max() + 1e-9
    scores = ranker.score(x)
    assert scores == pytest.approx(1 / (1 + np.exp(-(ranker.slope * (raw - ranker.middle) + np.log(3 / 7)))), abs=1e-4) and scores[5] == scores[6]


def plain_gru(net, px, d):
    h, out = np.zeros(toxicity.HIDDEN), {}
    n = toxicity.HIDDEN
    for t in range(len(px)) if d == "f" else reversed(range(len(px))):
        g = h @ net.p[f"U{d}"]
        z, r = (1 / (1 + np.exp(-(px[t][k * n : (k + 1) * n] + g[k * n : (k + 1) * n]))) for k in (0, 1))
        new = np.tanh(px[t][2 * n :] + r * g[2 * n :])
        h = out[t] = (1 - z) * new + z * h
    return [out[t] for t in range(len(px))]


def test_network_and_scores():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(40)] + ["Idiot!", "--", "é"]
    texts = [" ".join(random.Random(i).choices(words, k=5 + 13 * i)) for i in range(8)]
    labels = np.array([0, 0, 1, 1] * 2)
    scorer = toxicity.fit(texts, labels, 0.4)
    net, inputs = scorer.network, scorer.inputs
    for text in ["", "  ", "one", *texts, " ".join(words * 40)]:
        pieces, logits = text.split(), []
        for a in [0, *range(toxicity.STRIDE, max(1, len(pieces) - (toxicity.WINDOW - toxicity.STRIDE)), toxicity.STRIDE)]:
            own = pieces[a : a + toxicity.WINDOW]
            if not own:
                continue
            x = np.array([inputs.vectors(inputs.parts([toxicity.normal(p)]))[0] for p in own], dtype=np.float64)
            hs = np.concatenate([plain_gru(net, x @ net.p[f"W{d}"] + net.p[f"c{d}"], d) for d in "fb"], axis=1)
            e = np.exp(np.tanh(hs @ net.p["A"] + net.p["a"]) @ net.p["v"])
            logits.append((e / e.sum()) @ hs @ net.p["o"] + net.p["b"][0])
        want = 1 / (1 + np.exp(-(max(logits) - net.shift))) if logits else 0
        assert scorer.score([text])[0] == pytest.approx(want, abs=1e-4)
    assert inputs.vectors(inputs.parts(["é"])).shape == (1, toxicity.WORD_DIM + toxicity.CHAR_DIM + 2)
    parts = inputs.parts(words)
    windows, doc = rng.integers(0, len(words) + 1, size=(50, toxicity.WINDOW)), np.sort(rng.integers(0, 6, 50))
    windows[:, 0] = 1
    y = np.array([1, 0, 1, 0, 1, 0], dtype=np.float32)
    whole = toxicity._batch_gradients(inputs, net, parts, windows, doc, y)
    old, toxicity.BLOCK = toxicity.BLOCK, 7  # a document's windows over several blocks
    try:
        split = toxicity._batch_gradients(inputs, net, parts, windows, doc, y)
    finally:
        toxicity.BLOCK = old
    for a, b in zip(whole, split):
        for k in a:
            assert a[k] == pytest.approx(b[k], abs=2e-4)


def test_decoding_is_the_best_choice():
    page = parse("<div><p>abc</p><ul><li>d<li>efg hij</ul></div><div>k<p>lmn</p></div><p>o")
    nodes, rng = page.nodes, np.random.default_rng(5)
    for _ in range(60):
        logits = rng.normal(size=len(nodes))
        worth = [x * (1 + np.log1p(n.own)) for x, n in zip(logits, nodes)]
        choices = [c for c in product((False, True), repeat=len(nodes)) if c[0] and all(c[n.parent] for i, n in enumerate(nodes) if i and c[i])]
        best = max(sum(w for w, k in zip(worth, c) if k) for c in choices)
        kept = html_extract.decode(page, logits)
        assert tuple(kept) in choices and sum(w for w, k in zip(worth, kept) if k) == pytest.approx(best)


def test_forest():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 4)).round(1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    forest = boosting.fit(x, y, trees=20, depth=3)

    def walk(row):
        total = forest.base
        for feature, split, leaf in forest.trees:
            at = 0
            for _ in range(3):
                i = feature[at]
                at = 2 * at + 1 + (sum(c < row[i] for c in forest.cuts[i]) > split[at])
            total += leaf[at - 7]
        return total

    assert forest.logits(x[:50]) == pytest.approx([walk(r) for r in x[:50]])
    assert ((forest.logits(x) > 0) == y).mean() > 0.95


def plain_packing(lengths, window, most_open):
    held, done, made = [], [], 0  # [free, number, pieces]
    for doc, n in enumerate(lengths):
        a = 0
        while n - a >= window:
            done.append([(doc, a, a + window)])
            a += window
        while a < n:
            fits = [w for w in held if w[0] >= n - a]
            if fits:
                w = min(fits, key=lambda w: (w[0], w[1]))
                w[2].append((doc, a, n))
                w[0] -= n - a
                a = n
                if not w[0]:
                    held.remove(w)
                    done.append(w[2])
            elif len(held) < most_open:
                held.append([window, made, []])
                made += 1
            else:
                w = min(held, key=lambda w: (w[0], w[1]))  # the fullest
                if w[0] >= packing.LEAST_CUT:
                    w[2].append((doc, a, a + w[0]))
                    a += w[0]
                held.remove(w)
                done.append(w[2])
    return done, sorted(held, key=lambda w: (w[0], w[1]))


def test_placement():
    rng = random.Random(9)
    for window, most_open in ((32, 1), (64, 3), (100, 8)):
        lengths = [rng.choice((rng.randint(1, window // 3), rng.randint(1, 3 * window), window, 1)) for _ in range(400)]
        done = []
        packer = packing.Packer(window, most_open, done.append)
        for doc, n in enumerate(lengths):
            packer.place(n, lambda a, b, doc=doc: (doc, a, b))
        want, rest = plain_packing(lengths, window, most_open)
        assert done == want and packer.rest() == [w[2] for w in rest]


# ---- the ten queries ----

# nulls, empty, blank and long texts, repeated rows, special tokens; a column whose name clashes with a result's
TEXTS = [None, "", " \n\t ", "The cat sat, on 3.5 mats.\nAnd slept", "the Cat  sat", "é ﬁ Straße <|endoftext|> 　x" * 40, "dup text of five words", "dup text of five words", "w " * 30000, "\x00 \x01 a,b. İ.", "You are an idiot, moron and fool!"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    rng = random.Random(17)
    word = lambda: "".join(rng.choice(("an", "er", "to", "li", "ka", "so")) for _ in range(rng.randint(1, 3)))
    rows = [(i, t, "en" if i % 2 else None, "src") for i, t in enumerate(TEXTS)]
    rows += [(100 + i, " ".join(word() for _ in range(rng.randint(5, 90))) + (" Idiot moron!" if i % 3 == 0 else "."), ("en", "fr")[i % 2], "src") for i in range(120)]
    rows += [rows[3], (3, "another text under one id", "en", "src"), (None, "a row without an id", "fr", None)]
    labels = [(i, None if i % 7 == 0 else int(i % 3 > 0), None if i % 11 == 0 else int(i % 3 == 0)) for i in [*range(20), 3]] + [(None, 1, 1)] + [(100 + i, int(i % 2), int(i % 3 == 0)) for i in range(120)]
    kinds = {"documents": "doc_id bigint, text string, lang string, source string, score double, label string", "labels": "doc_id bigint, quality bigint, toxic bigint, text string", "pages": "page_id bigint, url string, html string, text string", "benchmark": "item_id bigint, text string, doc_id bigint"}
    pages = [(1, "u", "<body><article><h1>T</h1><p>A paragraph of the text, long enough.</p></article><footer>f</footer></body>"), (2, None, None), (3, "u", ""), (None, "u", "plain"), (1, "u", "<p>a" * 3000)]
    data = {"documents": [(*r, 1.0, "x") for r in rows], "labels": [(*r, "x") for r in labels], "pages": [(*p, "x") for p in pages], "benchmark": [(None, TEXTS[10] + " " + TEXTS[3], 1), (1, None, 1), (2, "dup text of five words", 1)]}
    for name, kind in kinds.items():
        spark.createDataFrame(data[name], kind).repartition(3).write.parquet(f"{path}/{name}.parquet")
        spark.createDataFrame([], kind).write.parquet(f"{path}/none/{name}.parquet")
    return path, rows


COLUMNS = {
    "op1": "doc_id start n_tokens ids_crc32", "op2": "doc_id size text_crc32 law shard slot grown_shard", "op3": "doc_id held_out lang_pred score", "op4": "doc_id held_out score predicted", "op5": "doc_id item_id",
    "op6": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op7": "doc_id held_out score predicted", "op8": "page_id url text n_chars", "op9": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op10": "doc_id fingerprint component_id",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query(spark, tables, name):
    path, rows = tables
    asked = COLUMNS[name.split("_")[0]].split()
    none = QUERIES[name](spark, f"{path}/none")
    assert set(asked) <= set(none.columns) and none.count() == 0
    got = QUERIES[name](spark, path).collect()
    if name.split("_")[0] not in ("op5", "op6", "op8"):
        assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(str(r[0]) for r in rows)
    if "held_out" in asked:
        n, rest = (4, 2) if name.startswith("op3") else (5, 0)
        for r in got:
            assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % n == rest) and 0 <= r["score"] <= 1
            if "predicted" in asked:
                assert r["predicted"] == int(r["score"] >= (0.3 if name.startswith("op4") else 0.5))


def library_ids(name, text, end):
    ids = Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, end], dtype="<u4")


def test_token_query(spark, tables):
    path, rows = tables
    ids = [(i, library_ids("byte_bpe_50k.json", t, 0)) for i, t, *_ in rows]
    want = sorted((-1 if i is None else i, len(x), zlib.crc32(x)) for i, x in ids)
    got = QUERIES["op1_token_orc"](spark, path).orderBy("start").collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:k]) for k in range(len(got))]
    assert [r["doc_id"] for r in got[1:]] == sorted(r["doc_id"] for r in got[1:]) and got[0]["doc_id"] is None


def test_packing_query(spark, tables):
    path, rows = tables
    got = QUERIES["op6_bounded_packing"](spark, path).collect()
    want = Counter()
    for i, t, *_ in rows:
        x = library_ids("word_bpe_49k.json", t, 1)
        want[i] += len(x)
        for r in got:
            if r["doc_id"] == i and i not in (3,):
                assert r["doc_tokens"] == len(x) and r["ids_crc32"] == zlib.crc32(x[r["start"] : r["start"] + r["length"]])
    held = Counter()
    for r in got:
        held[r["doc_id"]] += r["length"]
    assert held == want
    by = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert r["offset"] == by.get(r["sequence_id"], 0)
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by.values()) <= 2048 and sum(want.values()) / (2048 * len(by)) > 0.9


# ---- the pipeline ----


def plain_groups(rows):
    """The rows that stay of near copies: of each group the one with the least id, by all pairs."""
    words = lambda t: [x for x in (t or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").split(" ") if x]
    rows = list(dict.fromkeys((r[0], r[1]) for r in rows))
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    best = {}
    for r, (i, _) in zip(root, rows):
        if i is not None:
            best[r] = min(best.get(r, i), i)
    return {(i, t) for r, (i, t) in zip(root, rows) if best.get(r) == i}


def test_pipeline(spark, tables):
    path, rows = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    key = lambda df: {(r["doc_id"], r["text"]) for r in df.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, after = key(docs), stage(spark, docs, path)
        assert after.columns == docs.columns, name
        docs = corpus_pipeline.materialize(after, name)
        kept = key(docs)
        assert kept <= before and kept, name
        if name == "language":
            assert all(any(c.isalpha() for c in t or "") for _, t in kept)
        if name == "near_dedup":
            assert kept == plain_groups(sorted(before, key=lambda r: (r[0] is None, r[0] or 0))) and docs.count() == len(kept)
        if name == "decontamination":
            assert before - kept == {r for r in before if TEXTS[6] in (r[1] or "")}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert {r["doc_id"] for r in pieces} == {i for i, _ in key(docs)}
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, path).collect()) == Counter(r["doc_id"] for r in pieces)
    assert corpus_pipeline.run(spark, f"{path}/none").count() == 0


def test_near_dedup_of_awkward_rows(spark):
    same = " ".join(f"word{i}" for i in range(40))
    rows = [(5, same), (5, same), (2, same + " end"), (7, None), (8, ""), (9, " "), (None, same), (None, "only here without an id at all"), (None, "only here without an id at all"), (3, "one two"), (3, "a wholly different text under this id")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, i string, row int")
    got = corpus_pipeline.near_dedup(spark, df, "")
    assert got.columns == df.columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter([(2, same + " end"), (7, None), (None, "only here without an id at all"), (3, "one two"), (3, "a wholly different text under this id")])
