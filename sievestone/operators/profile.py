"""Counts, distributions and length statistics of a corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X


def distribution(df: DataFrame, key: str) -> DataFrame:
    """(key, n, share): counts by key and their share of all rows. The total is a sum over the counts, not over the rows."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.join(F.broadcast(total)).select(key, "n", (F.col("n") / F.col("_total")).alias("share"))  # total is one row


def top_counts(df: DataFrame, key: str, k: int = 20) -> DataFrame:
    """The k commonest keys; ties go by key."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def duplicate_keys(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_rows(df: DataFrame, key: Column) -> DataFrame:
    """One row: how many rows repeat an earlier key; missing keys are equal to each other."""
    per_key = df.groupBy(key.alias("_k")).agg(F.count("*").alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("n_duplicates"))


def length_quantiles(df: DataFrame, value: Column, at: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """One row: n, min, max, mean, and exact quantiles q10 ... by linear interpolation."""
    v = value.cast("double")
    q = [F.percentile(v, p).alias(f"q{round(p * 100)}") for p in at]
    return df.agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), *q)


def nearest_rank_stats(df: DataFrame, value: Column) -> DataFrame:
    """One row: n, mean rounded down, and the values at ranks n//2, n//10 and 9n//10 of the sorted list, from 0.

    Lengths repeat, so the counts by value are sorted, not the rows: each value
    is at all ranks from the rows below it on.
    """
    counts = df.select(value.alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("c"))
    below = F.sum("c").over(W.orderBy("v")) - F.col("c")
    ranked = counts.select("v", "c", below.alias("low"), F.sum("c").over(W.partitionBy()).alias("n"))
    at = lambda rank: F.max(F.when((F.col("low") <= rank) & (F.col("low") + F.col("c") > rank), F.col("v")))
    n = F.col("n")
    return ranked.agg(
        F.max("n").alias("n"), F.floor(F.sum(F.col("v") * F.col("c")) / F.max("n")).alias("mean"),
        at(F.floor(n / 2)).alias("median"), at(F.floor(n / 10)).alias("p10"), at(F.floor(n * 0.9)).alias("p90"),
    )


def bucket(value: Column, edges: Sequence[float]) -> Column:
    """0 below the first edge, 1 from it on, and so on."""
    found = F.lit(0)
    for i, e in enumerate(edges, 1):
        found = F.when(value >= e, i).otherwise(found)
    return found


def histogram(df: DataFrame, value: Column, edges: Sequence[float]) -> DataFrame:
    """(bucket, n) with buckets as ordinals, so that they sort as they should."""
    return df.groupBy(bucket(value, edges).alias("bucket")).agg(F.count("*").alias("n"))


def marker_share_histogram(df: DataFrame, percent: Column) -> DataFrame:
    """Foreign markers: none, below 10, 20 and 60 percent, and the rest."""
    found = F.when(percent == 0, 0).when(percent < 10, 1).when(percent < 20, 2).when(percent < 60, 3).otherwise(4)
    return df.groupBy(found.alias("bucket")).agg(F.count("*").alias("n"))


def script_bands(df: DataFrame, script: Column, latin: Column) -> DataFrame:
    """One row: texts with little, some and much of the script, and with much Latin."""
    return df.agg(F.count_if(script < 0.30).alias("low"), F.count_if((script >= 0.30) & (script < 0.60)).alias("middle"), F.count_if(script >= 0.60).alias("high"), F.count_if(latin > 0.60).alias("latin"))


def _each_flag(df: DataFrame, flags: str, *keys: str) -> DataFrame:
    """A row for each flag. Before a plain explode Spark filters by size, which computes all flags twice."""
    return df.select(*keys, F.explode_outer(flags).alias("flag")).where("flag IS NOT NULL")


def flag_counts(df: DataFrame, flags: str = "flags") -> DataFrame:
    return _each_flag(df, flags).groupBy("flag").agg(F.count("*").alias("n"))


def flag_samples(df: DataFrame, key: str, flags: str = "flags", k: int = 5) -> DataFrame:
    """The first k rows of each flag. Fixed-size partial minima, so that a flag on every row is no hot task."""
    each = _each_flag(df, flags, key)
    salted = each.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(64)))
    first = salted.withColumn("_r", F.row_number().over(W.partitionBy("flag", "_salt").orderBy(key))).where(F.col("_r") <= k)
    return first.withColumn("rank", F.row_number().over(W.partitionBy("flag").orderBy(key))).where(F.col("rank") <= k).select("flag", key, "rank")


def usable(df: DataFrame, text: str) -> DataFrame:
    """One row: rows, null and blank texts, and the percentage that is usable."""
    null, blank = F.count_if(F.col(text).isNull()), F.count_if(F.col(text).isNotNull() & (X.strip_ws(text) == ""))
    n = F.count("*")
    return df.agg(n.alias("n"), null.alias("n_null"), blank.alias("n_blank"), F.when(n > 0, (n - null - blank) * 100.0 / n).otherwise(0.0).alias("usable_pct"))


def length_stats(words: Column, ddof: int = 0) -> list[Column]:
    """Mean, median and standard deviation of word counts, and the shares in 80 to 100 and over 10 words, as aggregates."""
    v = words.cast("double")
    spread = F.stddev_pop(v) if ddof == 0 else F.stddev_samp(v)
    return [F.avg(v).alias("len_mean"), F.median(v).alias("len_median"), spread.alias("len_std"), F.avg((v >= 80).cast("int") * (v <= 100).cast("int")).alias("pct_80_100w"), F.avg((v > 10).cast("int")).alias("pct_over_10w")]


def length_summary(df: DataFrame, words: Column, ddof: int = 0) -> DataFrame:
    """One row of ``length_stats``. Words are counted in a step of their own, not in each aggregate."""
    return df.select(words.alias("_w")).agg(*length_stats(F.col("_w"), ddof))


def rate(holds: Column) -> Column:
    """The mean of a condition; null conditions don't count."""
    return F.avg(holds.cast("double"))


def hit_cap(tokens: Column, cap: int) -> Column:
    return rate(tokens >= cap - 1)


def describe_words(df: DataFrame, words: Column) -> DataFrame:
    """One row: mean, median, least and most, as in ``length_summary``."""
    df, v = df.select(words.cast("double").alias("_w")), F.col("_w")
    return df.agg(F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("p50"), F.min(v).alias("min"), F.max(v).alias("max"))


def cost_estimate(df: DataFrame, dataset: str, text: str, in_price: float = 0.15, out_price: float = 0.60, overhead: int = 200, calls: int = 3, out_tokens: int = 240) -> DataFrame:
    """Articles, tokens in millions and cost by dataset, and for all (dataset null); batch_cost is half."""
    per = df.groupBy(dataset).agg(F.count("*").alias("n"), F.coalesce(F.avg(F.length(text)), F.lit(0.0)).alias("_chars"))
    per = per.select(dataset, "n", (F.col("n") * (F.col("_chars") / 4 + overhead) * calls / 1e6).alias("input_m"), (F.col("n") * out_tokens / 1e6).alias("output_m"))
    total = per.rollup(dataset).agg(F.sum("n").alias("n"), F.sum("input_m").alias("input_m"), F.sum("output_m").alias("output_m"))
    cost = F.col("input_m") * in_price + F.col("output_m") * out_price
    return total.select(dataset, "n", "input_m", "output_m", cost.alias("cost"), (cost / 2).alias("batch_cost"))
