"""Near copies by the Jaccard similarity of word shingles, found by covering SimHash and completed exactly.

First operator 10 at work: texts whose SimHashes are within a few bits are
candidates, their shingles are compared, and those similar enough form groups.
But two texts of similarity 0.8 differ in about ten of 64 bits, for which a
covering scheme would need thousands of tables. So the pairs that it can't
reach, and that don't lie in one group already, are found by prefix filtering
(Chaudhuri et al., "A Primitive Operator for Similarity Joins", 2006): in one
order of all shingles, two similar sets share one of their first members.

All that compares is done on whole texts, so no link between different texts is
lost (but for collisions of 64-bit hashes of shingles).

Defined results: null text counts as empty; texts without a word are alike;
fewer words than a shingle give one shingle of all of them; repeated rows are
in one group; a null id never names a group unless it is alone; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, in_arrow, materialize, pick, runs
from .components import components
from .simhash import fingerprints, links, named_components

#: Part of all distinct shingles of two near copies that both have.
SIMILARITY = 0.8
#: Differing bits up to which SimHashes make two texts candidates.
RADIUS = 3
#: Texts that share a shingle up to which all pairs are candidates, and texts of a larger bucket that a task compares.
PAIR_LIMIT, BLOCK_LIMIT = 64, 500
#: One text in so many is sampled for common shingles; so many of these are told apart at most.
SAMPLED, COMMON_SHINGLES = 16, 100_000
#: Bytes of text whose shingles a task holds at once, and the factor of their hashes.
BYTES_AT_ONCE, MIX = 1 << 20, np.uint64(0x9E3779B97F4A7C15)
#: Ids up to which the texts that they name are found without a shuffle of all texts.
BROADCAST_LIMIT = 1_000_000
#: Parts in which equal texts are counted, so that no counter of one text overflows.
SALTS = 1024


class Common:
    """How often sampled texts have a shingle: rare ones come first in the order of all. A wrong count costs time alone."""

    def __init__(self, hashes: list[int], counts: list[int]) -> None:
        order = np.argsort(np.array(hashes, dtype=np.int64))
        self.hashes = np.array(hashes, dtype=np.int64)[order]
        self.counts = np.array(counts, dtype=np.int64)[order]

    def of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(h), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.counts[at], 0)


def shingle_sets(texts: pa.Array, size: int, common: Common | None = None) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct shingles each text has, and their 64-bit hashes text by text in order, rare ones first.

    Words are operator 10's; the hash of a shingle is a polynomial of its words' hashes and how many they are.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    word, row = split.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    real = pc.not_equal(word, "")
    word, row = word.filter(real).dictionary_encode(), row[real.to_numpy(zero_copy_only=False)]
    hashes = pd.util.hash_array(word.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    each = np.bincount(row, minlength=len(texts))
    # One word of hash zero after every text's end for each that its first shingle lacks.
    wide = np.maximum(each, size)
    first = np.cumsum(wide) - wide
    w = np.zeros(int(wide.sum()), dtype=np.uint64)
    w[first[row] + np.arange(len(row)) - (np.cumsum(each) - each)[row]] = hashes[word.indices.to_numpy()]
    n = wide - size + 1
    row = np.repeat(np.arange(len(texts)), n)
    at = first[row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]
    h = np.minimum(each, size).astype(np.uint64)[row]
    for j in range(size):
        h = h * MIX + w[at + j]
    h = h.view(np.int64)
    order = np.lexsort((h, common.of(h), row) if common else (h, row))
    h, row = h[order], row[order]
    new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))
    return np.bincount(row[new], minlength=len(texts)), h[new]


def _prefixes(size: int, similarity: float, common: Common):
    """(x, text) to (x, m, s): the size of the set, and as many of its first members that it shares one with each similar set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in runs(batch.column("text"), BYTES_AT_ONCE):
                part = batch.slice(i, j - i)
                n, flat = shingle_sets(part.column("text"), size, common)
                # Two such sets share at least that part of each; the margin is for rounding.
                most = n - np.ceil(n * similarity - 1e-9).astype(np.int64) + 1 if similarity else n
                at = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
                ends = np.concatenate([[0], np.cumsum(most)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("x"), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(ends, flat[at < np.repeat(most, n)])], names=["x", "m", "s"])

    return run


def _compare(size: int, similarity: float):
    """Of pairs (u, a, v, b) of ids with texts, the ids of the similar ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in runs(batch.column("a"), BYTES_AT_ONCE):
                part = batch.slice(i, j - i)
                u, v = (part.column(c).to_numpy() for c in "uv")
                _, once, code = np.unique(np.concatenate([u, v]), return_index=True, return_inverse=True)
                n, flat = shingle_sets(pa.concat_arrays([part.column("a"), part.column("b")]).take(pa.array(once)), size)
                sets = np.split(flat, np.cumsum(n)[:-1])
                shared = np.array([len(np.intersect1d(sets[j], sets[k], assume_unique=True)) for j, k in zip(code[: len(u)], code[len(u) :], strict=True)])
                good = shared >= similarity * (n[code[: len(u)]] + n[code[len(u) :]] - shared)
                yield pa.RecordBatch.from_arrays([pa.array(u[good]), pa.array(v[good])], names=["u", "v"])

    return run


def _texts_of(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """One row (x, text) for each of the ``ids`` (x)."""
    met = materialize(ids.distinct(), "met")
    found = texts.join(F.broadcast(met) if met.count() <= BROADCAST_LIMIT else met, "x", "left_semi")
    out = materialize(found.dropDuplicates(["x"]), "found")
    discard(met)
    return out


def _similar(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """Those of the ``pairs`` (u, v) of ids that are similar, by their whole texts."""
    pairs = materialize(pairs.distinct(), "candidates")
    found = _texts_of(pairs.select(F.col("u").alias("x")).union(pairs.select("v")), texts)
    a, b = (found.select(F.col("x").alias(x), F.col("text").alias(t)) for x, t in (("u", "a"), ("v", "b")))
    out = materialize(in_arrow(pairs.join(a, "u").join(b, "v").select("u", "a", "v", "b"), _compare(size, similarity), "u bigint, v bigint"), "similar")
    discard(pairs, found)
    return out


def _by_simhash(texts: DataFrame, key: str, size: int, radius: int) -> DataFrame:
    """Pairs (u, v) of ids of ``texts`` (key, x, text) that connect what SimHashes within ``radius`` connect."""
    keyed = texts.select(F.struct("x", F.pmod(F.xxhash64(key), F.lit(SALTS)).alias("salt")).alias("k"), "text")
    prints = materialize(fingerprints(keyed, size, "k").select("k.x", "fp").distinct(), "fingerprints")
    least = materialize(prints.groupBy("fp").agg(F.min("x").alias("least")), "least")
    same = prints.join(least, "fp").where("x <> least").select(F.col("x").alias("u"), F.col("least").alias("v"))
    near = links(least.select("fp"), radius)
    u, v = (least.select(F.col("fp").alias(f), F.col("least").alias(x)) for f, x in (("u", "x"), ("v", "y")))
    return same.union(near.join(u, "u").join(v, "v").select("x", "y"))


SETS = "x bigint, m int, s array<bigint>"


def _common(texts: DataFrame, size: int) -> Common:
    sampled = in_arrow(texts.where(F.pmod("x", F.lit(SAMPLED)) == 0), _prefixes(size, 0, Common([], [])), SETS).dropDuplicates(["x"]).select(F.explode("s").alias("h"))
    rows = sampled.groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(COMMON_SHINGLES).collect()
    return Common([r["h"] for r in rows], [r["n"] for r in rows])


def _open_buckets(texts: DataFrame, groups: DataFrame, size: int, similarity: float) -> DataFrame:
    """(h, x, m, root, n, hub): the first shingles of texts that texts of another group have too; n texts have it, hub is the least."""
    found = in_arrow(texts, _prefixes(size, similarity, _common(texts, size)), SETS).dropDuplicates(["x"])
    prefixes = materialize(found.join(groups, F.col("x") == F.col("node"), "left").select("x", "m", F.coalesce("root", "x").alias("root"), "s"), "prefixes")
    rows = prefixes.select("x", "m", "root", F.explode("s").alias("h"))
    counted = rows.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("x", "m", "root")).alias("hub"), F.min("root").alias("low"), F.max("root").alias("high"))
    open_ = materialize(counted.where("low < high").select("h", "n", "hub"), "open")
    out = materialize(rows.join(open_, "h"), "buckets")
    discard(prefixes, open_)
    return out


def _by_prefixes(shared: DataFrame, similarity: float, pair_limit: int) -> DataFrame:
    """Candidate pairs (u, v) of different groups: all of small buckets, and of large ones all with the hub."""
    light, heavy = shared.where(F.col("n") <= pair_limit), shared.where(F.col("n") > pair_limit)
    u, v = (light.select("h", *(F.col(c).alias(c + s) for c in ("x", "m", "root"))) for s in "uv")
    pairs = u.join(v, "h").where("xu < xv AND rootu <> rootv").select("xu", "mu", "xv", "mv")
    pairs = pairs.union(heavy.where("x <> hub.x AND root <> hub.root").select("hub.x", "hub.m", "x", "m"))
    # Members behind the prefix that ends first are the only ones that two sets can share besides those found.
    most = F.col("k") + F.ceil(F.greatest("mu", "mv") * similarity - 1e-9) - 1
    alike = pairs.where(F.least("mu", "mv") >= F.greatest("mu", "mv") * similarity - 1e-6).groupBy("xu", "mu", "xv", "mv").agg(F.count("*").alias("k"))
    return alike.where(most >= (F.col("mu") + F.col("mv")) * (similarity / (1 + similarity)) - 1e-6).select(F.col("xu").alias("u"), F.col("xv").alias("v"))


def _forest(size: int, similarity: float):
    """For texts (x, root, text) of one bucket: similar pairs that connect what all of them connect beyond equal roots."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        n, flat = shingle_sets(pa.array(rows["text"], type=pa.string()), size)
        order = np.lexsort((rows["x"].to_numpy(), n))
        sets = np.split(flat, np.cumsum(n)[:-1])
        ids, n = rows["x"].to_numpy()[order], n[order]
        part = np.unique(rows["root"].to_numpy()[order], return_inverse=True)[1]
        start = np.concatenate([[0], np.cumsum(n)])
        names, code = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
        own, edges = np.zeros(len(names), dtype=bool), []
        for i in range(len(ids) - 1):
            # Sets that are longer by more can't be similar.
            end = int(np.searchsorted(n, n[i] / similarity + 1e-6, "right"))
            if end <= i + 1 or (part[i + 1 : end] == part[i]).all():
                continue
            own[code[start[i] : start[i + 1]]] = True
            shared = np.add.reduceat(own[code[start[i + 1] : start[end]]].astype(np.int64), start[i + 1 : end] - start[i + 1])
            own[code[start[i] : start[i + 1]]] = False
            for j in np.flatnonzero(shared >= similarity * (n[i] + n[i + 1 : end] - shared)) + i + 1:
                if part[j] != part[i]:
                    edges.append((ids[i], ids[j]))
                    part[part == part[j]] = part[i]
        return pd.DataFrame(np.array(edges, dtype=np.int64).reshape(-1, 2), columns=["u", "v"])

    return run


def _in_blocks(heavy: DataFrame, groups: DataFrame, texts: DataFrame, size: int, similarity: float, block_limit: int) -> DataFrame:
    """Edges (u, v) that connect what is similar in the buckets ``heavy`` (h, x, n) and in different groups.

    A bucket is dealt into cells of about half the limit, a group in cells of
    its own where it is that large; every two cells meet in a task, save two of
    one group. So the work is the bucket's size times what lies outside its
    largest group.
    """
    half = max(1, block_limit // 2)
    rooted = heavy.join(groups, F.col("x") == F.col("node"), "left").select("h", "x", "n", F.coalesce("root", "x").alias("root"))
    rooted = materialize(rooted, "heavy")
    # Written, so that the joins below have plain shuffles on both sides and a hot bucket's or group's rows can be split.
    sizes = materialize(rooted.groupBy("h", "root").agg(F.count("*").alias("c")), "sizes")
    apart = materialize(sizes.groupBy("h").agg(F.count("*").alias("groups")).where("groups > 1").select("h"), "apart")
    own = F.when(F.col("c") > half, F.col("root"))
    cell = F.when(own.isNull(), F.pmod(F.xxhash64("root"), F.ceil(F.col("n") / half))).otherwise(-1 - F.pmod(F.xxhash64("root", F.pmod(F.xxhash64("x"), F.ceil(F.col("c") / half))), F.lit(1 << 40)))
    dealt = materialize(rooted.join(apart, "h").join(sizes, ["h", "root"]).select("h", "x", "root", own.alias("own"), cell.alias("cell")), "cells")
    cells = dealt.select("h", "own", "cell").distinct()
    a, b = (cells.select("h", F.col("own").alias(o), F.col("cell").alias(c)) for o, c in (("p", "low"), ("q", "high")))
    meet = materialize(a.join(b, "h").where("low <= high AND coalesce(p <> q, true)").select("h", "low", "high").distinct(), "meet")
    met = [dealt.join(meet, [dealt["h"] == meet["h"], dealt["cell"] == meet[c]]).select(meet["h"], "low", "high", "x", "root") for c in ("low", "high")]
    both = met[0].union(met[1].where("low < high"))
    return both.join(_texts_of(dealt.select("x"), texts), "x").groupBy("h", "low", "high").applyInPandas(_forest(size, similarity), "u bigint, v bigint")


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY, key: str = "doc_id", text: str = "text", radius: int = RADIUS, pair_limit: int = PAIR_LIMIT, block_limit: int = BLOCK_LIMIT) -> DataFrame:
    """(key, text_id, component_id) for every row: groups of near copies, linked by a Jaccard similarity of ``similarity``.

    ``text_id`` is the XXH64 (seed 42) of the text and tells rows under one id apart.
    """
    rows = pick(docs, key, text).select(F.col(key), F.xxhash64(F.coalesce(text, F.lit(""))).alias("x"), F.col(text).alias("text"))
    marked = materialize(rows.select(key, F.col("x").alias("id")), "texts")
    texts = rows.select("x", "text")
    first = _similar(_by_simhash(rows, key, shingle, radius), texts, shingle, similarity)
    shared = _open_buckets(texts, components(first), shingle, similarity)
    edges = materialize(first.union(_similar(_by_prefixes(shared, similarity, pair_limit), texts, shingle, similarity)), "edges")
    heavy = shared.where(F.col("n") > pair_limit).select("h", "x", "n")
    if not heavy.isEmpty():
        edges = materialize(edges.union(_in_blocks(heavy, components(edges), texts, shingle, similarity, block_limit)), "edges")
    discard(shared)
    return marked.join(named_components(marked, edges, key), "id").select(key, F.col("id").alias("text_id"), "component_id")
