"""The operators for training data against brute force on small tables, with the awkward rows in each."""

import hashlib
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievestone.llm import decontaminate, exact_digest, html_extract, langid, packing, quality, sharding, simhash, similar, token_orc, toxicity
from sievestone.llm.dom import blocks, parse
from sievestone.llm.tokens import Encoder

# null, empty, blank, unusual, repeated and long texts; an extra column with a clashing name
ROWS = [(5, "The cat sat, on 3.5 mats.\nAnd slept"), (1, None), (9, ""), (3, "  \n\t "), (7, "the Cat  sat"), (-2, "é ﬁ Straße <|endoftext|> 　x" * 40), (8, "dup text of five words"), (6, "dup text of five words"), (4, "w " * 3000), (10, "\x00 \x01 a,b.")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1.0) for i, t in ROWS], "doc_id bigint, text string, shard string, score double")


@pytest.fixture
def none(docs):
    return docs.where("doc_id > 100")


def library_ids(name, texts, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array([*e.ids, end], dtype="<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("plain", [False, True])
@pytest.mark.parametrize("name,drops", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_pieces_encode_as_the_whole(name, drops, plain, monkeypatch):
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "B", "b.", "the,", "'s", "'S.", "12", "é", "É.", "e\u0301.", "İ.", "\u0958,", "\ufb4b.", "Σ", "!!", "_", "<|endoftext|>", "<|EndOfText|>", "\x1c", "\0", "\x01", "　", "\U0001f600", "\r\n", ". ", ", "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    from sievestone.llm import tokens

    whole = Tokenizer.from_file(public_tokenizers.path(name))
    whole.encode_special_tokens = plain
    for kept, segment in ((400_000, 8_000_000), (500, 3000)):
        monkeypatch.setattr(tokens, "KEPT_PIECES", kept)
        monkeypatch.setattr(tokens, "SEGMENT", segment)
        enc = Encoder(public_tokenizers.path(name), drops, plain)
        got = []
        for rows, ids, n in enc.encode([*texts, None]):
            assert rows == len(n)
            at = np.concatenate([[0], np.cumsum(n)])
            got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
        assert got == [*(e.ids for e in whole.encode_batch(texts, add_special_tokens=False)), []]
    monkeypatch.setattr(tokens, "SEGMENT", 50)
    long, enc = " ".join(texts[:500]), Encoder(public_tokenizers.path(name), drops, plain)
    assert np.concatenate([ids for _, ids, _ in enc.encode([long])]).tolist() == whole.encode(long, add_special_tokens=False).ids


@pytest.mark.parametrize("name,drops", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_every_character_before_a_stop(name, drops):
    texts = [f"a {chr(i)}{'.,'[i % 2]} b" for i in range(0x30000) if not 0xD800 <= i < 0xE000]
    enc = Encoder(public_tokenizers.path(name), drops)
    ids, n = zip(*((ids, n) for _, ids, n in enc.encode(texts)))
    got = np.split(np.concatenate(ids), np.cumsum(np.concatenate(n))[:-1])
    assert all(a.tolist() == e.ids for a, e in zip(got, enc.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True))


def test_token_files(spark, docs, none, tmp_path):
    path = f"file://{tmp_path}/t"
    token_orc.write_token_files(docs, path)
    files = token_orc.read_token_files(spark, path)
    got = token_orc.with_starts(files, files).orderBy("start").collect()
    rows = sorted(ROWS, key=lambda r: r[0])
    want = library_ids("byte_bpe_50k.json", [t for _, t in rows], 0)
    assert [r["doc_id"] for r in got] == [i for i, _ in rows]
    assert [r["ids"] for r in got] == [w.tolist() for w in want]
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([len(w) for w in want])])[:-1].tolist()
    token_orc.write_token_files(none, f"file://{tmp_path}/e")
    assert token_orc.read_token_files(spark, f"file://{tmp_path}/e").count() == 0


def jump(key, n):
    b, j, key = -1, 0, key % 2**64
    while j < n:
        b = j
        key = (key * sharding.MULTIPLIER + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards(spark, docs, none):
    got = sharding.assign_shards(docs, 16).collect()
    for r in got:
        text = (dict(ROWS)[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 1, zlib.crc32(text))
        assert (r["shard"], r["grown_shard"]) == (jump(r["doc_id"], 16), jump(r["doc_id"], 17))
        assert r["grown_shard"] in (r["shard"], 16)
    for s in {r["shard"] for r in got}:
        own = sorted((r for r in got if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own))) and [r["doc_id"] for r in own] == sorted(r["doc_id"] for r in own)
    assert sharding.assign_shards(none, 16).count() == 0
    keys = spark.range(3000).select("id", sharding.jump_hash(F.col("id"), 1000).alias("s")).collect()
    assert all(r["s"] == jump(r["id"], 1000) for r in keys)  # beyond the short walk too


def test_packing(spark, docs, none):
    got = packing.pack_documents(docs.repartition(3), window=64, most_open=2).collect()
    want = dict(zip([i for i, _ in ROWS], library_ids("word_bpe_49k.json", [t for _, t in ROWS], 1)))
    for i, ids in want.items():
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])
        assert sum((r["ids"] for r in own), []) == ids.tolist() and [r["start"] for r in own] == [sum(len(x["ids"]) for x in own[:k]) for k in range(len(own))]
    for s in {r["sequence_id"] for r in got}:
        own = sorted((r for r in got if r["sequence_id"] == s), key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))] and sum(r["length"] for r in own) <= 64
    assert packing.pack_documents(none).count() == 0


def canon(t):
    n = lambda s: unicodedata.normalize("NFKC", s)
    return re.sub(r"\s+", " ", n(n(t or "").casefold())).strip(" ")


def wide(c):
    return f"{xxhash.xxh64_intdigest(c.encode(), 42):016x}{xxhash.xxh64_intdigest(c.encode(), xxhash.xxh64_intdigest(b'wide', 42)):016x}"


def test_digests(spark, docs, none, tmp_path):
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in exact_digest.op9_canonical_digest(spark, f"file://{tmp_path}").collect()}
    order = sorted(ROWS, reverse=True, key=lambda r: r[0])
    assert len(got) == len(ROWS)
    for (i, t), (_, x) in zip(order, order[1:] + order[:1]):
        t, x = t or "", x or ""
        edited = t[: len(t) - len(t) // 3] + x[: len(t) // 3]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (wide(canon(t)), wide(canon(edited)))
        assert (r["near_edited"], r["near_next"]) == (float(canon(t) == canon(edited)), float(canon(t) == canon(x)))
    assert got[8]["group_id"] == 6 and got[8]["group_size"] == 2
    assert exact_digest.fingerprint_documents(none).count() == 0


def test_equal_hashes_are_told_apart(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_digest, "wide_hash", lambda c: F.lit("0"))  # all collide
    got = exact_digest.fingerprint_documents(docs).collect()
    by = {}
    for r in got:
        by.setdefault(canon(dict(ROWS)[r["doc_id"]]), set()).add(r["fingerprint"])
    assert all(len(x) == 1 for x in by.values()) and len(set.union(*by.values())) == len(by)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    got, names = exact_digest.op9_canonical_digest(spark, f"file://{tmp_path}").collect(), {}
    assert len(got) == len(ROWS)
    order = sorted(ROWS, reverse=True, key=lambda r: r[0])
    following = {i: x or "" for (i, _), (_, x) in zip(order, order[1:] + order[:1])}
    for r in got:
        t, x = dict(ROWS)[r["doc_id"]] or "", following[r["doc_id"]]
        edited = t[: len(t) - len(t) // 3] + x[: len(t) // 3]
        for name, text in ((r["fingerprint"], t), (r["edited_fingerprint"], edited)):
            assert names.setdefault(canon(text), name) == name
        assert r["near_edited"] == float(r["fingerprint"] == r["edited_fingerprint"])
    assert len(set(names.values())) == len(names)


def simhash_of(text, k=3):
    w = re.findall("[^ \t-\r]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_masks_cover():
    rng = random.Random(5)
    for radius in (1, 2, 3):
        masks = simhash.covering_masks(radius)
        for _ in range(2000):
            flips = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
            assert any(not m & flips for m in masks)


@pytest.mark.parametrize("limits", [(200, 20_000), (1, 20_000), (1, 3), (1, 1)])
def test_near_components(spark, docs, limits):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(60)) for _ in range(4)]
    texts = [*(t for _, t in ROWS), *base]
    for b in base:
        for _ in range(12):
            w = b.split()
            w[rng.randrange(60)] = "zz"
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in simhash.near_components(df, bucket_limit=limits[0], group_limit=limits[1]).collect()}
    fps = [simhash_of(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and root[i] != root[j]:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert [int(got[i]["fingerprint"], 16) for i in range(len(texts))] == fps
    assert [got[i]["component_id"] for i in range(len(texts))] == root


def test_near_copies(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(5))
    texts = [" ".join(word() for _ in range(200)) for _ in range(30)]
    copies = []
    for t in texts[:10]:
        w = t.split()
        w[rng.randrange(200)] = word()
        copies.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts + copies)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in similar.near_copies(df).collect()}
    assert sum(got[30 + i] == i for i in range(10)) >= 9 and all(got[i] == i for i in range(30))
    assert similar.near_copies(df.where("doc_id < 0")).count() == 0


def test_near_copies_keep_to_the_similarity(spark):
    """Copies with more and more edits: whatever is grouped is linked by texts of similarity 0.8; empty and repeated rows too."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(5))
    texts = [None, "", " "]
    for edits in range(12):
        w = [word() for _ in range(200)]
        texts += [" ".join(w)] * 2
        for at in rng.sample(range(200), edits):
            w[at] = word()
        texts.append(" ".join(w))
    shingles = []
    for t in texts:
        w = (t or "").split()
        shingles.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[3])]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id bigint, text string, id int")
    got = {r["doc_id"]: r["component_id"] for r in similar.near_copies(df).collect()}
    assert got.pop(None) == 3
    assert all(got[i] in (root[i], i) for i in range(len(texts)))
    assert sum(got[i] != root[i] for i in range(len(texts))) <= 1


def similar_roots(texts):
    """The least text of each text's component under a Jaccard similarity of 0.8, and how many pairs are that similar."""
    sets = []
    for t in texts:
        w = [x for x in re.split("[ \t-\r]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root, pairs = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                pairs += 1
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root, pairs


@pytest.mark.parametrize("limits", [(16, 2000), (4, 60), (10_000, 2000)])
def test_large_groups_of_near_copies(spark, limits, monkeypatch):
    """Hundreds of different variants, each of another one: the bucket's size changes nothing."""
    monkeypatch.setattr(similar, "SAMPLED", 8)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(5))
    made = [[word() for _ in range(90)]]
    while len(made) < 400:
        w = list(rng.choice(made))
        for at in rng.sample(range(len(w)), rng.randint(1, 3)):
            w[at] = word()
        made.append(w)
    texts = [" ".join(w) for w in made] + [None, " ", "A\tb", "a \x0b B\n", "a", "a a a a a a", "a a a a a", "é\u3000É", "é\u3000é"]
    root, _ = similar_roots(texts)
    assert 20 < len(set(root)) < 300
    got = {r["doc_id"]: r["component_id"] for r in similar.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), **dict(zip(("pair_limit", "block_limit"), limits))).collect()}
    assert [got[i] for i in range(len(texts))] == root


def test_near_copies_with_added_and_cut_text(spark):
    """Every kind of edit that leaves a similarity of 0.8 is found."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(5))
    made = lambda n: [word() for _ in range(n)]
    texts = []
    for n in (60, 61, 99, 200, 400):
        for w in (made(n), made(n)):
            few, half = n // 10, n // 2
            copies = [w + made(few), w + made(2 * few), made(2 * few) + w, w[:half] + made(few) + w[half:], w[few:], w[:-few], w[:half] + w[half + few :], [word() if i % 40 == 20 else x for i, x in enumerate(w)]]
            for c in copies:
                # each pair with words of its own, so that copies of one text don't stand in for each other
                own = {x: word() for x in {*w, *c}}
                texts += [" ".join(own[x] for x in w), " ".join(own[x] for x in c)]
    root, pairs = similar_roots(texts)
    assert pairs > 60
    got = {r["doc_id"]: r["component_id"] for r in similar.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == root


def test_language(spark, docs, none):
    en, fr = "the cat and the dog went to the house with that thing ", "le chat et le chien sont dans une maison avec des choses "
    rows = [(i, " ".join(random.Random(i).sample((en if i % 2 else fr).split(), 8)), "en" if i % 2 else "fr") for i in range(60)]
    profiles = langid.learn_profiles(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    asked = spark.createDataFrame([(1, en), (2, fr.upper()), (3, None), (4, "123 !?"), (5, "")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in langid.identify(asked, profiles, "doc_id").collect()}
    assert [got[i]["lang_pred"] for i in range(1, 6)] == ["en", "fr", "und", "und", "und"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(none, profiles, "doc_id").count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, langid.Profiles({}), "doc_id").collect()} == {"und"}


def test_most_frequent_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 1)
    rows = [(i, "le chat et le chien", "fr" if i else "en") for i in range(5)]
    assert langid.learn_profiles(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).languages == ["fr"]


def test_profile_distance():
    profiles = langid.Profiles({"a": [1, 2, 3], "b": [3, 2, 1]})
    codes, counts = langid.gram_counts("ab ab")
    assert dict(zip(codes.tolist(), counts.tolist()))[97 | 98 << 21 | 0 << 42] == 2
    assert langid.ranked(np.array([7, 5, 9]), np.array([1, 2, 1])).tolist() == [5, 7, 9]
    assert profiles.predict("zz")[0] == "a"  # equal distances: the first


def test_quality(spark, docs, none):
    rng = random.Random(4)
    prose = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "the", "of"]) + str(rng.randint(0, 99)) for _ in range(50))
    rows = [(i, prose() if i % 4 else prose().upper().replace(" ", "!! "), int(i % 4 > 0)) for i in range(200)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(7, None), (None, 1)], "doc_id bigint, quality int")
    ranker = quality.learn_quality(df, labels, lambda c: c % 2 == 0)
    got = {r["doc_id"]: r for r in quality.score_quality(df, ranker, "doc_id").collect()}
    assert sum(got[i]["predicted"] == y for i, _, y in rows if i % 2) >= 98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in quality.score_quality(docs, ranker, "doc_id").collect())
    assert quality.score_quality(none, ranker, "doc_id").count() == 0
    assert quality.learn_quality(df, labels.where("quality = 1"), lambda c: F.lit(True)) is None
    assert {r["score"] for r in quality.score_quality(docs, None, "doc_id").collect()} == {0.5}


def test_quality_learns_from_all_rows_and_pairs(spark):
    rng = random.Random(8)
    text = lambda y: " ".join(rng.choice(["alpha", "Beta", "g!", "42", "the."][y:]) for _ in range(rng.randint(1, 12)))
    rows = [(i, text(i % 2), i % 2) for i in range(9000)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows + rows[:50]], "doc_id bigint, quality int")
    ranker = quality.learn_quality(df.union(df.limit(20)), labels, lambda c: c < 8900)  # equal rows count once
    x, y = np.array([quality.features(r[1]) for r in rows[:8900]], dtype=np.float32), np.array([r[2] for r in rows[:8900]])
    for j in range(x.shape[1]):
        plain = [sorted(x[y == label, j])[k * 4449 // 9] for label in (1, 0) for k in range(1, 9)]
        assert ranker.cuts[j].tolist() == plain
    z = ranker.basis(x, ranker.cuts).astype(float)
    raw = z @ ranker.weights
    wrong = 1 / (1 + np.exp(raw[y == 1][:, None] - raw[y == 0]))  # all pairs
    slope = (wrong.mean(axis=0) @ z[y == 0] - wrong.mean(axis=1) @ z[y == 1]) / 4450 + 1e-4 * ranker.weights
    assert np.abs(slope).max() < 1e-3
    assert ranker.middle == np.sort(raw)[4449:4451].mean()
    assert ranker.slope == pytest.approx(8 / (np.median(raw[y == 1]) - np.median(raw[y == 0])))
    again = quality.learn_quality(df.orderBy(F.rand(3)).repartition(7), labels, lambda c: c < 8900)
    assert again.weights.tolist() == ranker.weights.tolist() and again.middle == ranker.middle


@pytest.mark.parametrize("senders", [16, 2])  # the tasks' sums sent as they are, and added up before
def test_quality_counts_of_scores(spark, senders, monkeypatch):
    monkeypatch.setattr(quality, "SENDERS", senders)
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 9, (70, quality.WIDTH)).astype(np.float32), np.arange(70) % 3 // 2
    rows = spark.createDataFrame([(int(v), bytearray(r.tobytes())) for v, r in zip(y, x)], "label int, x binary").repartition(3)
    rows = quality.packed(rows).rdd
    cuts, counts = quality.exact_cuts(rows)
    assert counts.tolist() == [47, 23]
    whole = rng.integers(-900, 900, cuts.size)
    scores = quality._Scores(rows, cuts, whole)
    w = whole / quality.GRID
    step = np.array([[float(v > c) for v, own in zip(r, cuts) for c in own] for r in x])
    pairs = [step[i] - step[j] for i in np.flatnonzero(y == 1) for j in np.flatnonzero(y == 0)]
    assert scores.loss() == pytest.approx(np.mean([np.log1p(np.exp(-d @ w)) for d in pairs]) + 5e-5 * w @ w)
    assert scores.slope() == pytest.approx(np.mean([-d / (1 + np.exp(d @ w)) for d in pairs], axis=0) + 1e-4 * w, abs=1e-6)
    assert scores.median(scores.bad) == np.median((step @ w)[y == 0])


def test_masks_find_any_two_substitutions():
    from itertools import combinations

    for changed in combinations(range(10), 2):
        assert any(not {p + s for p in m} & set(changed) for m in decontaminate.MASKS for s in range(10 - m[-1]))


def brute_leaks(text, items):
    tok = lambda t: [x for x in map(decontaminate.normal, (t or "").split()) if x]
    d, found = tok(text), set()
    for key, item in items:
        b = tok(item)
        for start in range(-len(b), len(d)):
            eq = [0 <= start + i < len(d) and d[start + i] == b[i] for i in range(len(b))]
            if len(b) < 10:
                whole = start >= 0 and start + len(b) <= len(d) and len(b) > 0
                if whole and (all(eq) if len(b) < 5 else 5 * sum(eq) >= 4 * len(b)):
                    found.add(key)
                continue
            for i in range(len(b)):
                for j in range(i + 10, len(b) + 1):
                    if start + i >= 0 and start + j <= len(d) and 5 * sum(eq[i:j]) >= 4 * (j - i):
                        found.add(key)
    return found


@pytest.mark.parametrize("tokens", [1_000_000, 30])  # the seeds joined in memory, and as a table
def test_leaks_against_brute_force(spark, docs, none, tokens):
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("xyz")
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((2, 4, 5, 6, 9, 10, 14, 30))]
    odd = [(20, None), (21, ""), (22, "?! --"), (None, items[6][1] + " zz"), (5, items[5][1]), (5, " ".join(word() for _ in range(12))), (23, "solo")]
    texts = ["SOLO!", "solo " * 500]
    for _ in range(150):
        b = rng.choice(items + odd[3:6])[1].split()
        i = rng.randrange(len(b))
        cut = [w if rng.random() > 0.15 else "Q" for w in b[i // 2 :]]
        texts.append(" ".join([word() for _ in range(rng.randint(0, 9))] + [w.upper() + "," for w in cut] + [word() for _ in range(rng.randint(0, 9))]))
    rows = [*enumerate(texts), (900, None), (901, ""), (None, texts[2])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, item_id int")
    bench = spark.createDataFrame([(*r, "t") for r in items + odd], "item_id bigint, text string, x string")
    leaks = decontaminate.find_leaks(df, bench, tokens).collect()
    got = {}
    for r in leaks:
        got.setdefault(r["doc_id"], set()).add(r["item_id"])
        assert r["similarity"] == r["n_equal"] / r["n_tokens"] >= 0.8 and r["at_token"] >= 0
    for i, t in rows:
        assert got.get(i, set()) == brute_leaks(t, items + odd), (i, t)
    assert sorted(leaks, key=str) == sorted(decontaminate.find_leaks(df, bench, 10**9).collect(), key=str)
    kept = decontaminate.without_leaks(df, bench, tokens)
    assert kept.columns == df.columns and sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == sorted((i is None, i or 0) for i, _ in rows if not got.get(i))
    assert decontaminate.find_leaks(none, bench, tokens).count() == 0 and decontaminate.find_leaks(docs, bench.where("item_id > 99"), tokens).count() == 0


def test_toxicity(spark, docs, none):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(("an", "er", "to", "li", "ka", "so")) for _ in range(rng.randint(1, 3)))
    rows = []
    for i in range(400):
        w = [word() for _ in range(rng.randint(5, 120))]
        if toxic := i % 3 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(("Idiot!", "moron", "vexu" + word())))
        rows.append((i, " ".join(w), int(toxic)))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(3, None)], "doc_id bigint, toxic int")
    scorer = toxicity.learn_toxicity(df, labels, lambda c: c % 5 != 0)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(df, scorer, "doc_id").collect()}
    held = [r for r in rows if r[0] % 5 == 0]
    assert sum(got[i]["predicted"] == y for i, _, y in held) >= 0.95 * len(held)
    edge = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, scorer, "doc_id").collect()}
    assert edge[1] == edge[9] == edge[3] == 0 and all(0 <= s <= 1 for s in edge.values())
    long = " ".join(word() for _ in range(9000))
    far = long[:30000] + " idiot moron idiot " + long[30000:]
    assert scorer.score([far])[0] > 0.5  # no prefix is all that is read
    assert toxicity.score_toxicity(none, scorer, "doc_id").count() == 0
    assert {r["score"] for r in toxicity.score_toxicity(docs, None, "doc_id").collect()} == {0.0}


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network(5, rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, idx = rng.normal(size=(20, 5)), rng.integers(1, 20, size=(3, toxicity.WINDOW))
    idx[1, 20:] = 0
    mask, w = (idx > 0).astype(float), np.array([1.0, -2.0, 0.5])
    loss = lambda: (net.forward(net.project(x), idx, mask)[0] * w).sum()
    tapes = {"f": [], "b": []}
    grad, _ = net.backward(net.forward(net.project(x), idx, mask, tapes)[1], w, x, idx, mask, tapes)
    for k, a in net.p.items():
        i = tuple(n - 1 for n in a.shape)
        a[i] += 1e-3
        up = loss()
        a[i] -= 2e-3
        down = loss()
        a[i] += 1e-3
        assert (up - down) / 2e-3 == pytest.approx(float(grad[k][i]), abs=2e-3)


PAGE = """<html><head><title>t</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body><nav><ul><li><a href=/a>Menu</a><li><a href=/b>Other</a></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site for you.</p></div><div class="ad">Buy this great thing now please today.</div><article><h1>Title &amp; more</h1><p><b>First
 paragraph of the text, which is long enough to be one.<br><p>Second   paragraph with &lt;marks&gt; and some more words in it.</article>
<section id="comments"><h2>Comments</h2><div class="comment"><p>I think that this is a fine article, really.</p></div></section><footer>&copy; site</footer></body></html>"""


def test_extraction(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain  text\nonly &amp; so"), (5, "u", "<p>a<p>b</p></div></b>" * 3), (1, "u", PAGE)]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    want = "Title & more\n\nFirst paragraph of the text, which is long enough to be one.\n\nSecond paragraph with <marks> and some more words in it."
    assert [r["text"] for r in got if r["page_id"] == 1] == [want] * 2
    assert {r["page_id"]: r["text"] for r in got if r["page_id"] in (2, 3, 4)} == {2: "", 3: "", 4: "plain text only & so"}


def test_all_siblings_count():
    page = parse("<body>" + "<div>a</div>" * 60 + "<p>b</p>" * 40 + "</body>")
    x = html_extract.node_features(page)
    shares = {n.tag: x[i, -6] for i, n in enumerate(page.nodes) if n.tag in ("div", "p")}
    assert shares == {"div": 0.6, "p": 0.4}


def test_kept_nodes_have_kept_ancestors():
    page = parse(PAGE)
    rng = np.random.default_rng(1)
    for _ in range(50):
        kept = html_extract.decode(page, rng.normal(size=len(page.nodes)))
        assert all(kept[n.parent] for i, n in enumerate(page.nodes) if i and kept[i])
    assert blocks(parse("<p>a<br>b<p>c"), [True] * 3) == ["a b", "c"]


def test_unseen_layouts():
    author, right = html_extract._Author(12345), 0
    for _ in range(60):
        html = author.page()
        page = parse(html)
        right += html_extract.extract([html], html_extract.trained())[0] == "\n\n".join(blocks(page, [n.marked for n in page.nodes]))
    assert right >= 45
