"""The three jobs: clean a corpus, score predictions against gold labels, evaluate generations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import classification as C
from ..operators import overlap as O
from ..operators import profile
from ..operators.cleaning import cleaning_summary, drop_reasons
from ..operators.tables import join_generations
from ..schemas import SENTIMENTS, ScriptProfile
from ..scratch import materialize


def clean_corpus(articles: DataFrame, text: str, order: str, script: ScriptProfile, repair: bool = True) -> tuple[DataFrame, DataFrame]:
    """The kept rows and the summary, both from one frame of reasons."""
    reasons = drop_reasons(articles, text, order, script, repair=repair)
    return reasons.where("reason = 'kept'").drop("reason", "preamble_state"), cleaning_summary(reasons)


def affect_report(rows: DataFrame, slices: list[str]) -> DataFrame:
    """All slices' scores on both axes in one grouped plan each.

    ``rows``: gold_emotion, pred_emotion, gold_sentiment, pred_sentiment, gold_vector, pred_vector.
    Rows without a prediction are left out and counted; a gold sentiment outside
    the label set leaves a row out of the sentiment scores alone.
    """
    emotion = C.summary(C.label_margins(C.confusion(rows, slices, "gold_emotion", "pred_emotion"), slices), slices)
    labelled = rows.where(F.col("gold_sentiment").isin(SENTIMENTS))
    sentiment = C.summary(C.label_margins(C.confusion(labelled, slices, "gold_sentiment", "pred_sentiment"), slices, SENTIMENTS), slices)
    short = {"accuracy": "acc"}
    named = lambda df, axis: df.select(*slices, *[F.col(c).alias(f"{axis}_{short.get(c, c)}") for c in df.columns if c not in (*slices, "n")])
    scored = rows.where(F.col("pred_emotion").isNotNull())
    js = scored.groupBy(*slices).agg(F.avg(C.js_divergence(F.col("gold_vector"), F.col("pred_vector"))).alias("emo_mean_js"), C.polarity_flip_rate(F.col("gold_sentiment"), F.col("pred_sentiment")).alias("sent_polarity_flip_rate"))
    return C.missing(rows, slices, "pred_emotion").join(named(emotion, "emo"), slices, "left").join(js, slices, "left").join(named(sentiment, "sent"), slices, "left")


METRICS = {"bleu": "bleu_sentence", "rouge1": "rouge1", "rouge2": "rouge2", "rougeL": "rougeL", "bertscore_f1": "bertscore_f1"}


def run_metrics(items: DataFrame, runs: list[str], key: str = "row_key", resamples: int = 1000) -> DataFrame:
    """One row a run from per-item scores: grand means with 95 % intervals, corpus BLEU, valid outputs, lengths.

    All runs in one grouped plan for sums and one for intervals, both from a scratch table of the scores.
    bertscore_f1_nonempty is the mean where neither side is empty.
    """
    metrics = [m for m in METRICS if m in items.columns]
    told = F.col("hyp") != "", (F.col("hyp") != "") & (F.col("ref") != "")
    items = materialize(items.select(*runs, key, *metrics, "len", "stats", *[c.alias(n) for c, n in zip(told, ("_made", "_full"), strict=True)]), "scores")
    ci = O.bootstrap_ci(items, runs, key, metrics, resamples)
    wide = ci.groupBy(*runs).pivot("metric", metrics).agg(F.first("mean").alias("mean"), F.first(F.struct("lo", "hi")).alias("ci"))
    scores = wide.select(*runs, *[F.col(f"`{m}_{k}`").alias(f"{METRICS[m]}{s}") for m in metrics for k, s in (("mean", ""), ("ci", "_ci"))])
    model = [F.coalesce(F.avg(F.when(F.col("_full"), F.col("bertscore_f1"))), F.lit(0.0)).alias("bertscore_f1_nonempty")] if "bertscore_f1" in metrics else []
    summed = items.groupBy(*runs).agg(F.count("*").alias("n"), F.count_if(~F.col("_made")).alias("n_empty"), profile.rate(F.col("_made")).alias("valid_rate"), *model, *profile.length_stats(F.col("len")), *O.corpus_sums("stats"))
    whole = summed.select(*[c for c in summed.columns if not c.startswith("_")], *O.corpus_scores()[:2]).withColumn("bleu_corpus", F.col("bleu") / 100).drop("bleu")
    return whole.join(scores, runs)


def evaluate_generations(tests: DataFrame, generations: DataFrame, run: str, ref: str, key: str = "row_key", resamples: int = 1000, order: str | None = None, scorer: Callable[[], O.PairScorer] | None = None, placeholder: str = "") -> tuple[DataFrame, DataFrame]:
    """Per-item scores of one run, and its metrics. Of repeated generations the last in ``order`` counts."""
    joined = join_generations(tests, generations, key, order=order).withColumn("run", F.lit(run))
    items = O.score_pairs(joined, ["run", key], ref, "generated", placeholder=placeholder, scorer=scorer)
    return items, run_metrics(items, ["run"], key, resamples)


def manifest(metrics: DataFrame, **protocol: object) -> DataFrame:
    """The run's record: what it was run with, and its metrics nested."""
    return metrics.select("run", *[F.lit(v).alias(k) for k, v in protocol.items()], F.struct(*[c for c in metrics.columns if c != "run"]).alias("metrics"))
