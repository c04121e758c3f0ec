"""Operator 10: SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: a bit is set where more than half of a document's shingle hashes
(XXH64, seed 42) have it set. Search: Pagh's covering scheme ("Locality-sensitive
Hashing without False Negatives", 2016). Bit i gets a nonzero vector m(i) of
radius + 1 bits; table v keeps the bits with <m(i), v> odd. The at most
``radius`` bits in which two fingerprints differ span too little to meet every
v, so some table agrees on all it keeps: every pair within the radius collides.

Copies share a fingerprint and are searched as one. Up to ``BUCKET_LIMIT``
fingerprints in a bucket are joined pair by pair; up to ``GROUP_LIMIT`` (a few
hundred kB) are compared in one task that emits a spanning forest of their
links, never all pairs; the members of larger buckets meet exactly, in linear
work, at the fingerprints near them (see ``_through_hubs``).

Defined results: null text counts as empty; no word gives fingerprint zero,
which links like any other; fewer words than a shingle give one shingle of all
of them; rows repeated under one id get their own fingerprint; a null id never
names a component unless it is alone; an empty table gives an empty result; a
radius over ``HUB_RADIUS`` is refused, as its tables and hubs grow too many.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pick, table
from .components import components

BITS = 64
#: Fingerprints in a bucket up to which its pairs are joined, and up to which one task compares them.
BUCKET_LIMIT, GROUP_LIMIT = 200, 20_000
#: Radius up to which masks and hubs stay few.
HUB_RADIUS = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def words(text: Column) -> Column:
    """Runs of what isn't ASCII white space, with A to Z in lower case."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "[ \\t-\\r]+"), "")


def _majority(sums: list[str], count: str) -> Column:
    """The word whose bit b is set if more than half of ``count`` hashes had it; each sum holds two 32-bit counts."""
    bits = []
    for b in range(BITS):
        n = F.shiftrightunsigned(sums[b % 32], 32) if b >= 32 else F.col(sums[b]).bitwiseAND(F.lit((1 << 32) - 1))
        bits.append(F.when(n * 2 > F.col(count), F.lit(signed(1 << b))).otherwise(F.lit(0).cast("bigint")))
    return reduce(lambda x, y: x.bitwiseOR(y), bits)


def _bit_sums(hashed: Column, name: str) -> list[Column]:
    pair = F.lit((1 << 32) | 1)
    return [F.sum(F.shiftrightunsigned(hashed, j).bitwiseAND(pair)).alias(f"_{name}{j}") for j in range(32)]


def _shingle(words_: str, at: Column, size: int) -> Column:
    """get() gives null beyond the end and concat_ws skips nulls: a short text is one shingle."""
    return F.concat_ws(" ", *[F.get(words_, at + j) for j in range(size)])


def fingerprints(docs: DataFrame, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): the 64-bit SimHash of every row's whole text.

    Rows are told apart by key and content, which a recomputed task finds again;
    where they repeat, all counts are multiples, the majorities the same, and
    the multiple says how many rows there are.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = pick(docs, key, text).select(F.col(key).alias("_key"), F.xxhash64(body).alias("_a"), F.xxhash64(F.lit("b"), body).alias("_b"), words(F.col(text)).alias("_w"))
    spans = rows.select("_key", "_a", "_b", "_w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("_w") - shingle, F.lit(0)))).alias("_i"))
    hashed = F.when(F.size("_w") > 0, F.xxhash64(_shingle("_w", F.col("_i"), shingle))).otherwise(F.lit(0).cast("bigint"))
    spans = spans.select("_key", "_a", "_b", hashed.alias("_h"), (F.col("_i") == 0).alias("_first"))
    counted = spans.groupBy("_key", "_a", "_b").agg(F.count("*").alias("_n"), F.count_if("_first").alias("_rows"), *_bit_sums(F.col("_h"), "s"))
    found = counted.select("_key", "_rows", _majority([f"_s{j}" for j in range(32)], "_n").alias("fp"))
    return found.select(F.col("_key").alias(key), "fp", F.explode(F.sequence(F.lit(1), F.col("_rows"))).alias("_r")).drop("_r")


def covering_masks(radius: int) -> list[int]:
    """2**(radius + 1) - 1 masks; two words that differ in at most ``radius`` bits agree under one."""
    vectors = (1 << (radius + 1)) - 1

    def masks(step: int) -> list[int]:
        m = [i * step % vectors + 1 for i in range(BITS)]
        return [sum(1 << i for i in range(BITS) if (m[i] & v).bit_count() & 1) for v in range(1, vectors + 1)]

    # With more vectors than bits, the first ones alone would leave a table with a bit or none.
    return masks(1) if vectors <= BITS else max((masks(k) for k in range(1, vectors)), key=lambda x: min(y.bit_count() for y in x))


def _flips(most: int) -> list[int]:
    return [signed(sum(1 << i for i in bits)) for k in range(most + 1) for bits in combinations(range(BITS), k)]


def _through_hubs(points: DataFrame, radius: int) -> DataFrame:
    """Edges that connect exactly what links within ``radius`` connect among ``points`` (fp), in linear work.

    Let a = radius // 2, b = radius - a. For any 64-bit word z, points within a
    of z are within 2a <= radius of each other, and a point within b of z is
    within radius of each of them; any linked pair has such a z between. So all
    that meet at z join the least point within a of it, its hub.
    """
    near = radius // 2
    def around(most: int) -> DataFrame:
        flips = F.explode(F.array(*map(F.lit, _flips(most))))
        return points.select("fp", flips.alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"))

    hubs = around(near).groupBy("z").agg(F.min("fp").alias("hub"))
    return around(radius - near).join(hubs, "z").where("fp <> hub").select(F.col("fp").alias("u"), F.col("hub").alias("v")).distinct()


def _forest(radius: int):
    """For the points of one bucket: the shortest links that connect what all its links connect."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        fp = np.sort(rows["fp"].to_numpy())
        far = BITS + 1
        length, near = np.full(len(fp), far), np.zeros(len(fp), dtype=np.int64)
        todo = np.ones(len(fp), dtype=bool)
        edges, at = [], 0
        for _ in range(len(fp) - 1):
            todo[at] = False
            d = np.bitwise_count((fp ^ fp[at]).view(np.uint64)).astype(np.int64)
            d[d > radius] = far
            closer = todo & (d < length)
            length[closer], near[closer] = d[closer], at
            at = int(np.where(todo, length, far + 1).argmin())
            if length[at] < far:
                edges.append((fp[at], fp[near[at]]))
        return pd.DataFrame(np.array(edges, dtype=np.int64).reshape(-1, 2), columns=["u", "v"])

    return run


def links(points: DataFrame, radius: int, bucket_limit: int = BUCKET_LIMIT, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Edges (u, v) between the distinct ``points`` (fp) with the components of all pairs within ``radius``."""
    if radius > HUB_RADIUS:
        raise ValueError(f"the radius goes up to {HUB_RADIUS}")
    tables = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("kept")) for t, m in enumerate(covering_masks(radius))]
    keyed = points.select("fp", F.inline(F.array(*tables)))
    sizes = keyed.groupBy("t", "kept").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(keyed.join(sizes, ["t", "kept"]), "buckets")
    light = shared.where(F.col("n") <= bucket_limit)
    a, b = (light.select("t", "kept", F.col("fp").alias(x)) for x in "uv")
    edges = a.join(b, ["t", "kept"]).where(f"u < v AND bit_count(u ^ v) <= {radius}").select("u", "v")
    large = shared.where(F.col("n") > bucket_limit)
    if large.isEmpty():
        return edges
    middling = large.where(F.col("n") <= group_limit)
    edges = edges.union(middling.groupBy("t", "kept").applyInPandas(_forest(radius), "u bigint, v bigint"))
    heavy = large.where(F.col("n") > group_limit)
    return edges if heavy.isEmpty() else edges.union(_through_hubs(heavy.select("fp").distinct(), radius))


def named_components(marked: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(id, component_id): the least key of each id's component; ``marked`` has key and id."""
    classes = marked.groupBy("id").agg(F.min(key).alias("least"))
    rooted = components(edges)
    linked = rooted.join(classes, rooted["node"] == classes["id"]).select("id", "root", "least")
    whole = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(linked.join(whole, "root").select("id", "component_id"), "id", "left").select("id", F.coalesce("component_id", "least").alias("component_id"))
    # Written first, so that a join with it has plain shuffles on both sides and a hot id's partition can be split.
    return materialize(named, "classes")


def near_components(docs: DataFrame, shingle: int = 3, radius: int = 3, key: str = "doc_id", text: str = "text", bucket_limit: int = BUCKET_LIMIT, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(key, fingerprint, component_id) for every row."""
    marked = materialize(fingerprints(docs, shingle, key, text).withColumnRenamed("fp", "id"), "fingerprints")
    points = marked.select(F.col("id").alias("fp")).distinct()
    named = named_components(marked, links(points, radius, bucket_limit, group_limit), key)
    return marked.join(named, "id").select(key, F.lower(F.lpad(F.hex("id"), 16, "0")).alias("fingerprint"), "component_id")


def op10_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))
