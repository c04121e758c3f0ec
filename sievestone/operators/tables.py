"""Keys, lookups, splits and report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import addresses as U
from ..functions import text as X
from ..schemas import ALIASES, ARTICLE_COLUMNS, SCORES


def normalize_columns(df: DataFrame, renames: dict[str, str] | None = None, required: Sequence[str] = ARTICLE_COLUMNS) -> DataFrame:
    """Headers stripped of white space and byte-order marks, renamed, missing columns empty, only ``required`` kept.

    Rows without a text are left out, a null text among them.
    """
    clean = {c: c.strip().lstrip("﻿") for c in df.columns}
    df = df.withColumnsRenamed(clean)
    df = df.withColumnsRenamed({a: b for a, b in (renames or {}).items() if a in df.columns and b not in df.columns})
    df = df.withColumns({c: F.lit("") for c in required if c not in df.columns}).select(*required)
    text = required[-1]
    return df.where(F.col(text).isNotNull() & (X.strip_ws(text) != ""))


def resolve_aliases(df: DataFrame, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """Each wanted column from the first of its aliases that the table has, in any case."""
    low = {c.strip().lower(): c for c in df.columns}
    found = {next((low[a] for a in names if a in low), None): want for want, names in aliases.items() if want not in df.columns}
    return df.withColumnsRenamed({k: v for k, v in found.items() if k})


def with_site(df: DataFrame, url: str, languages: dict[str, str], default: str = "") -> DataFrame:
    """Adds website, the address's host, and language, that of the first site in ``languages`` that the host is or belongs to."""
    host = U.netloc(url)
    language = F.lit(default)
    for site, name in reversed(languages.items()):
        language = F.when((host == site) | F.endswith(host, F.lit("." + site)), name).otherwise(language)
    return df.withColumn("website", host).withColumn("language", language)


def column_difference(df: DataFrame, expected: Sequence[str]) -> tuple[list[str], list[str]]:
    """Missing and extra columns, sorted."""
    return sorted(set(expected) - set(df.columns)), sorted(set(df.columns) - set(expected))


def unique_keys(df: DataFrame, key: str, order: str) -> DataFrame:
    """``df`` as it is if its keys are unique; if any repeats, every key gets _<position> in ``order``.

    Positions are counted by range partitions (see ``positions``), so nothing has to fit one task.
    """
    if df.groupBy(key).count().where("count > 1").isEmpty():
        return df
    return positions(df, order, "_at").withColumn(key, F.concat_ws("_", key, "_at")).drop("_at")


#: Ranges for each shuffle partition, so that they spread evenly.
RANGES_EACH = 4


def key_bounds(rows: DataFrame, key: str, parts: int) -> list:
    """Sorted bounds that cut the key's range into up to ``parts`` of about equal counts; it reads the key alone."""
    found = rows.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else None
    return sorted(set(found or []))


def part_of(key: Column, bounds: list) -> Column:
    """How many of the sorted ``bounds`` are at most ``key``, by blocks and then within the block (null: 0)."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    at_most = lambda xs: F.size(F.filter(xs, lambda b: b <= key))
    block = at_most(F.array(*[F.lit(b[0]) for b in blocks]))
    inner = F.get(F.array(*[F.array(*map(F.lit, b)) for b in blocks]), block - 1)
    return F.when(key.isNull() | (block == 0), 0).otherwise((block - 1) * width + at_most(inner))


def _leading(order: Column, kind: str) -> Column:
    """A number that never falls as ``order`` rises: of a string its first seven bytes."""
    if kind != "string":
        return order
    return F.conv(F.rpad(F.hex(F.substring(F.encode(order, "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("bigint")


def positions(df: DataFrame, order: str, name: str) -> DataFrame:
    """0, 1, 2, ... in ``order``, nulls first: ranks within ranges of the key, plus the counts of the ranges before.

    There are a few ranges for each shuffle partition; equal keys are in any order.
    """
    held = df.withColumn("_o", _leading(F.col(order), dict(df.dtypes)[order]))
    bounds = key_bounds(held, "_o", max(32, RANGES_EACH * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    held = held.withColumn("_p", part_of(F.col("_o"), bounds)).drop("_o")
    before = held.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = held.withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy(order)))
    # as many rows as there are ranges
    return ranked.join(F.broadcast(before.select("_p", "_before")), "_p").withColumn(name, F.col("_r") - 1 + F.col("_before")).drop("_p", "_r", "_before")


def ordinal_keys(df: DataFrame, order: str, pattern: str = "mai_%04d", name: str = "row_key") -> DataFrame:
    return positions(df, order, "_at").withColumn(name, F.format_string(pattern, "_at")).drop("_at")


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key: what a dictionary would hold. A grouped maximum, with map-side sums."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_row")).select(key, "_row.*")


def join_generations(tests: DataFrame, generations: DataFrame, key: str = "row_key", generated: str = "generated", order: str | None = None) -> DataFrame:
    """Every test row with its generation, "" where there is none; of repeated generations the last in ``order``.

    A table has no order of its own, so without ``order`` it is the greatest as text: the same one each time.
    """
    last = last_by_key(generations, key, order) if order else generations.groupBy(key).agg(F.max(generated).alias(generated))
    return tests.join(last.select(key, generated), key, "left").withColumn(generated, F.coalesce(generated, F.lit("")))


def or_generations(joined: DataFrame, generations: DataFrame, generated: str = "generated") -> DataFrame:
    """If no test row got a generation, the generation table itself."""
    return generations if joined.where(F.col(generated) != "").isEmpty() else joined


def with_defaults(articles: DataFrame, checkpoint: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Articles with their annotations, and a default in each column where there is none."""
    joined = articles.join(checkpoint.select(key, *defaults), key, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def pending(rows: DataFrame, checkpoint: DataFrame, key: str) -> DataFrame:
    return rows.join(checkpoint.select(key), key, "left_anti")


def matched(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return rows.join(other.select(key), key, "left_semi")


def cached_headlines(articles: DataFrame, cache: DataFrame, url: str = "article_url") -> DataFrame:
    """Articles with headline and fetch_state: cached, failed (to be tried again), pending, or no_url.

    A failure is a state of its own, not a headline.
    """
    failed = F.col("_cached") == "FETCH_ERROR"
    state = F.when(F.coalesce(X.strip_ws(url), F.lit("")) == "", "no_url").when(failed, "failed").when(F.coalesce("_cached", F.lit("")) == "", "pending").otherwise("cached")
    joined = articles.join(cache.select(F.col("url").alias("_url"), F.col("headline").alias("_cached")), X.strip_ws(url) == F.col("_url"), "left")
    return joined.withColumn("fetch_state", state).withColumn("headline", F.when(F.col("fetch_state") == "cached", F.col("_cached")).otherwise("")).drop("_url", "_cached")


def seeded_rank(key: Column | str, seed: int) -> Column:
    """A text by which rows stand in a random order that seed and key alone decide."""
    return F.md5(F.encode(F.concat_ws(":", F.lit(str(seed)), F.col(key) if isinstance(key, str) else key), "UTF-8"))


def split_exact(df: DataFrame, key: str, seed: int = 42, test: float = 0.2) -> DataFrame:
    """``df`` with split: of n rows, ceil(test * n) are held out, the later half of them test, the others val.

    Rows rank by a seeded hash of the key. The sizes are exact; the ranks come from ranges of the hash.
    """
    ranked = positions(df.withColumn("_h", seeded_rank(key, seed)), "_h", "_at")
    n = df.agg(F.count("*").alias("_n"))
    held = F.ceil(F.col("_n") * test)
    ranked = ranked.join(F.broadcast(n))  # one row
    name = F.when(F.col("_at") < F.col("_n") - held, "train").when(F.col("_at") < F.col("_n") - F.ceil(held / 2), "val").otherwise("test")
    return ranked.withColumn("split", name).drop("_h", "_at", "_n")


def seeded_order(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A shuffle that doesn't depend on partitions."""
    return df.orderBy(seeded_rank(key, seed), key)


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows at random; a seed gives the same rows each time."""
    return seeded_order(df, key, seed).limit(n)


def union_sets(frames: Sequence[DataFrame], column: str) -> DataFrame:
    out = frames[0].select(column)
    for f in frames[1:]:
        out = out.union(f.select(column))
    return out.distinct()


def append_all(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of frames whose columns may differ."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def first_wins(slices: DataFrame, keys: Sequence[str] = ("language", "model"), order: Sequence[Column | str] = ("source_priority", "file")) -> DataFrame:
    """One slice for each key: the first by source priority and file."""
    w = W.partitionBy(*keys).orderBy(*order)
    return slices.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def sorted_report(df: DataFrame, keys: Sequence[str] = ("model", "language")) -> DataFrame:
    return df.orderBy(*[F.coalesce(k, F.lit("")) for k in keys])


def comparison_table(slices: DataFrame, keys: Sequence[str] = ("language", "provider", "model")) -> DataFrame:
    """One row a slice: keys, counts and scores, of either generation of the files."""
    older = {"emo_acc": "emo_preserved_acc", "sent_acc": "sent_preserved_acc"}
    score = lambda c: F.coalesce(c, older[c]).alias(c) if c in older and older[c] in slices.columns else F.col(c)
    return slices.select(*keys, "n_scored", "n_missing", *map(score, SCORES))


def results_table(runs: DataFrame, columns: Sequence[str], digits: int = 3) -> DataFrame:
    """Chosen columns of all runs, numbers rounded, missing ones null."""
    kinds = dict(runs.dtypes)
    return runs.select(*[F.lit(None).cast("double").alias(c) if c not in kinds else F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in columns])


def check_rows(df: DataFrame, expected: int) -> tuple[int, bool]:
    """How many rows there are, and whether that is as expected."""
    n = df.count()
    return n, n == expected
