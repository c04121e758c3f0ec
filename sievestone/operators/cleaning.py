"""Filters, keep-first deduplication and the cleaning job's single plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import DEVANAGARI, ScriptProfile


def not_blank(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which all columns are there and hold more than white space."""
    for c in columns:
        df = df.where(F.col(c).isNotNull() & (X.strip_ws(c) != ""))
    return df


def min_length(c: Column | str, n: int, stripped: bool = False) -> Column:
    return F.length(X.strip_ws(c) if stripped else X.col(c)) >= n


def keep_first(df: DataFrame, keys: list[Column], order: list[Column | str], link: str | None = None) -> DataFrame:
    """The first row of each key in ascending ``order``; ``link`` adds first_<link>, the winner's value, and is_first to every row instead.

    The winner is a grouped minimum over 128 bits of the keys, which sums up on
    the map side, so a key that many rows share is no hot task, and long keys
    aren't shuffled. Equal order within a key: any one of these rows.
    """
    named = dict(zip(("_a", "_b"), X.wide_key(*keys), strict=True))
    at = F.struct(*order)
    if not link:
        first = df.withColumns(named).groupBy("_a", "_b").agg(F.min_by(F.struct(*df.columns), at).alias("_row"))
        return first.select("_row.*")
    rows = df.withColumns(named).withColumn("_at", at)
    first = rows.groupBy("_a", "_b").agg(F.min("_at").alias("_first"), F.min_by(link, "_at").alias(f"first_{link}"))
    return rows.join(first, ["_a", "_b"]).withColumn("is_first", F.col("_at") == F.col("_first")).drop("_a", "_b", "_at", "_first")


def drop_reasons(df: DataFrame, text: str, order: str, script: ScriptProfile = DEVANAGARI, least_ratio: float = 0.50, least_chars: int = 200, prefix: int = 500, repair: bool = False) -> DataFrame:
    """``df`` with text repaired (if asked), preamble_state and reason: kept, low_script, too_short or duplicate.

    The filters come before the deduplication, which compares repaired texts and
    keeps the first in ``order``. The winner of each prefix is a grouped minimum,
    which sums up on the map side: a prefix that many rows share is no hot task.
    """
    state = X.repair_preamble(text) if repair else F.struct(F.col(text).alias("text"), F.lit("clean").alias("state"))
    rows = df.withColumn("_fixed", state).withColumn(text, F.col("_fixed.text")).withColumn("preamble_state", F.col("_fixed.state")).drop("_fixed")
    whole = F.coalesce(F.col(text), F.lit(""))
    early = F.when(X.script_ratio_chars(whole, script) < least_ratio, "low_script").when(F.length(whole) < least_chars, "too_short")
    # Rows that are out already join by a number of their own, so that they spread over all tasks and match nothing.
    own = X.wide_key(X.prefix_key(text, prefix))
    rows = rows.withColumn("_early", early).withColumns({"_a": F.when(F.col("_early").isNull(), own[0]).otherwise(F.xxhash64(order)), "_b": F.when(F.col("_early").isNull(), own[1])})
    first = rows.where("_early IS NULL").groupBy("_a", "_b").agg(F.min(order).alias("_first"))
    joined = rows.join(first, ["_a", "_b"], "left")
    reason = F.coalesce("_early", F.when(F.col(order) == F.col("_first"), "kept").otherwise("duplicate"))
    return joined.withColumn("reason", reason).drop("_early", "_a", "_b", "_first")


def cleaning_summary(reasons: DataFrame) -> DataFrame:
    return reasons.groupBy("reason").agg(F.count("*").alias("n"))
