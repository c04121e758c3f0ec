"""Classification metrics: any number of slices in one grouped plan, from confusion counts on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound


def confusion(df: DataFrame, slices: Sequence[str], gold: str, pred: str) -> DataFrame:
    """(slices..., gold, pred, n); rows without a prediction are left out (``missing`` counts them)."""
    return df.where(F.col(pred).isNotNull() & F.col(gold).isNotNull()).groupBy(*slices, F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def missing(df: DataFrame, slices: Sequence[str], pred: str) -> DataFrame:
    return df.groupBy(*slices).agg(F.count_if(F.col(pred).isNotNull()).alias("n_scored"), F.count_if(F.col(pred).isNull()).alias("n_missing"))


def label_margins(counts: DataFrame, slices: Sequence[str], labels: Sequence[str] | None = None) -> DataFrame:
    """(slices..., label, tp, support, predicted) for every label that is gold or predicted, or for the fixed ``labels``.

    Each cell of the confusion table is taken twice, as a row and as a column.
    """
    sides = F.explode(
        F.array(
            F.struct(F.col("gold").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")),
            F.struct(F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp")),
        )
    )
    both = counts.select(*slices, sides.alias("s")).select(*slices, "s.*")
    if labels:
        none = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), *(F.lit(0).cast("bigint").alias(c) for c in ("support", "predicted", "tp"))) for x in labels]))
        both = both.where(F.col("label").isin(list(labels))).union(counts.select(*slices).distinct().select(*slices, none.alias("s")).select(*slices, "s.*"))
    return both.groupBy(*slices, "label").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("tp", "support", "predicted")])


def _over(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def per_class(margins: DataFrame) -> DataFrame:
    """Adds precision, recall and f1; what divides by zero is 0."""
    tp = F.col("tp")
    return margins.withColumns({"precision": _over(tp, F.col("predicted")), "recall": _over(tp, F.col("support")), "f1": _over(2 * tp, F.col("support") + F.col("predicted"))})


def summary(margins: DataFrame, slices: Sequence[str]) -> DataFrame:
    """(slices..., n, accuracy, macro_*, weighted_*, kappa); macro means weigh every label alike, even one without gold rows."""
    rows = per_class(margins)
    n, agree, chance = F.sum("support"), F.sum("tp"), F.sum(F.col("support").cast("double") * F.col("predicted"))
    po, pe = agree / n, chance / (n.cast("double") * n)
    weighted = [_over(F.sum(F.col(m) * F.col("support")), n).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")]
    return rows.groupBy(*slices).agg(n.cast("bigint").alias("n"), po.alias("accuracy"), *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")], *weighted, F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def dense_matrix(counts: DataFrame, slices: Sequence[str]) -> DataFrame:
    """(slices..., labels, matrix): sorted labels, and rows of gold by columns of predicted counts."""
    cells = F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x01", "gold", "pred"), "n")))
    held = counts.groupBy(*slices).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("gold", "pred"))))).alias("labels"), cells.alias("_cells"))
    row = lambda g: F.transform("labels", lambda p: F.coalesce(F.try_element_at("_cells", F.concat_ws("\x01", g, p)), F.lit(0)))
    return held.select(*slices, "labels", F.transform("labels", row).alias("matrix"))


def polarity_flip_rate(gold: Column, pred: Column) -> Column:
    """The share of rows whose polarity is turned round, of all scored rows."""
    flips = ((gold == "positive") & (pred == "negative")) | ((gold == "negative") & (pred == "positive"))
    return F.avg(flips.cast("double"))


def js_divergence(p: Column, q: Column, least: float = 1e-12) -> Column:
    """Jensen-Shannon divergence to base 2 of two arrays, clipped and scaled to sum 1; null if p sums to 0 or less."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)

    def scaled(v: Column) -> Column:
        clipped = F.transform(v, lambda x: F.greatest(x.cast("double"), F.lit(least)))
        return bound(F.struct(clipped.alias("v"), total(clipped).alias("t")), lambda s: F.transform(s["v"], lambda x: x / s["t"]))

    part = F.zip_with(scaled(p), scaled(q), lambda x, y: x * F.log2(2 * x / (x + y)) + y * F.log2(2 * y / (x + y)))
    return F.when(total(F.transform(p, lambda x: x.cast("double"))) > 0, 0.5 * total(part))


def row_scores(df: DataFrame, gold_vector: Column, pred_vector: Column) -> DataFrame:
    """Row-level output: whether each label is right, and the divergence rounded to 4 digits."""
    labels = [F.col(f"gold_{x}") == F.col(f"pred_{x}") for x in ("emotion", "sentiment")]
    return df.withColumns({"emotion_correct": labels[0], "sentiment_correct": labels[1], "js_divergence": F.round(js_divergence(gold_vector, pred_vector), 4)})


def preservation(outputs: DataFrame, sources: DataFrame, aliases: dict[str, str] | None = None, keys: Sequence[str] = ("language", "model"), scores: Sequence[str] = ("accuracy", "kappa")) -> DataFrame:
    """Each score of generated texts beside that of their sources by the same classifier: difference and ratio."""
    named = lambda df: df.withColumn("model", F.coalesce(*[F.when(F.col("model") == a, b) for a, b in aliases.items()], F.col("model"))) if aliases else df
    base = named(sources).select(*keys, *[F.col(s).alias(f"source_{s}") for s in scores])
    joined = named(outputs).join(base, list(keys))
    for s in scores:
        joined = joined.withColumn(f"{s}_difference", F.col(s) - F.col(f"source_{s}")).withColumn(f"{s}_ratio", F.when(F.col(f"source_{s}") != 0, F.col(s) / F.col(f"source_{s}")))
    return joined


def unpivot_per_class(slices: DataFrame, keys: Sequence[str] = ("task", "language", "provider", "model")) -> DataFrame:
    """(keys..., axis, class, precision, recall, f1, support) from the nested per-class maps."""
    parts = []
    for axis in ("emotion", "sentiment"):
        each = slices.select(*keys, F.lit(axis).alias("axis"), F.explode(f"{axis}_per_class").alias("class", "m")).where("m IS NOT NULL AND m.support IS NOT NULL")
        parts.append(each.select(*keys, "axis", "class", "m.precision", "m.recall", F.col("m.`f1-score`").alias("f1"), "m.support"))
    return parts[0].union(parts[1])
