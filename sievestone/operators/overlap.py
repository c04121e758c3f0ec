"""Text-overlap metrics of generated texts against references."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from itertools import pairwise
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import short_batches


def ngrams(toks: Column, n: int) -> Column:
    """array<string> of the sliding n-grams; their tokens are joined by U+0001, which no token of white space holds."""
    if n == 1:
        return toks

    def of(t: Column) -> Column:
        last = F.size(t) - n
        grams = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(t, i + 1, F.lit(n)), "\x01"))
        return F.when(last >= 0, grams).otherwise(F.array().cast("array<string>"))

    return X.bound(toks, of)


def ascii_tokens(c: Column | str) -> Column:
    """Lower-case runs of a-z and 0-9: every other script vanishes."""
    return F.regexp_extract_all(X.lower(c), F.lit("([a-z0-9]+)"), 1)


def _prf(match: Column, hyp: Column, ref: Column) -> list[Column]:
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = over(match, hyp), over(match, ref)
    return [p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)]


def rouge_orders(df: DataFrame, keys: list[str], ref: str, hyp: str, orders: Sequence[int], tokenizer=X.tokens) -> DataFrame:
    """(keys..., n, precision, recall, f1) of clipped n-gram overlap for every order n; a side without n-grams gives 0.

    Both sides and all orders become one stream of counted n-grams: one shuffle
    by key, order and n-gram, and one of a row per key and order.
    """

    def side(c: str, is_ref: bool) -> Column:
        grams = lambda t: F.array(*[F.struct(F.lit(n).alias("n"), ngrams(t, n).alias("g"), F.lit(is_ref).alias("is_ref")) for n in orders])
        return X.bound(tokenizer(F.coalesce(F.col(c), F.lit(""))), grams)

    both = df.select(*keys, F.explode(F.concat(side(ref, True), side(hyp, False))).alias("side"))
    # explode_outer keeps a key of which neither side has an n-gram
    each = both.select(*keys, "side.n", "side.is_ref", F.explode_outer("side.g").alias("gram"))
    has = F.col("gram").isNotNull()
    counted = each.groupBy(*keys, "n", "gram").agg(F.count_if(has & F.col("is_ref")).alias("r"), F.count_if(has & ~F.col("is_ref")).alias("h"))
    summed = counted.groupBy(*keys, "n").agg(F.sum(F.least("r", "h")).alias("m"), F.sum("h").alias("h"), F.sum("r").alias("r"))
    p, r, f = _prf(F.col("m"), F.col("h"), F.col("r"))
    return summed.select(*keys, "n", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def rouge_n(df: DataFrame, keys: list[str], ref: str, hyp: str, n: int, tokenizer=X.tokens) -> DataFrame:
    """(keys..., precision, recall, f1) of clipped n-gram overlap."""
    return rouge_orders(df, keys, ref, hyp, [n], tokenizer).drop("n")


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming over Python's long integers."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for y in b:
        u = row & at.get(y, 0)
        row = (row + u) | (row - u)
        row &= full | (1 << len(a)) - 1
    return len(a) - (row & full).bit_count()


def rouge_l(ref: Column, hyp: Column) -> Column:
    """struct(precision, recall, f1) by the longest common subsequence of two token arrays."""

    @F.pandas_udf("int")
    def lcs(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in pairs:
            yield pd.Series([lcs_length(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int32")

    short_batches()
    counts = F.struct(lcs(ref, hyp).alias("m"), F.size(hyp).alias("h"), F.size(ref).alias("r"))
    return X.bound(counts, lambda c: F.struct(*[x.alias(n) for x, n in zip(_prf(c["m"], c["h"], c["r"]), ("precision", "recall", "f1"), strict=True)]))


def rouge_scores(ref: Column, hyp: Column) -> Column:
    """struct(rouge1, rouge2, rougeL): the F1 scores of two token arrays, row by row.

    ``rouge_n`` counts n-grams in shuffles; a pair's own are few, and here nothing is shuffled or joined.
    """

    @F.pandas_udf("struct<one:int,two:int,lcs:int>")
    def matches(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in pairs:
            both = [(list(x), list(y)) for x, y in zip(a, b, strict=True)]
            each = [[(Counter(x) & Counter(y)).total(), (Counter(pairwise(x)) & Counter(pairwise(y))).total(), lcs_length(x, y)] for x, y in both]
            yield pd.DataFrame(each, columns=["one", "two", "lcs"], dtype="int32")

    short_batches()
    counts = F.struct(matches(ref, hyp).alias("m"), F.size(hyp).alias("h"), F.size(ref).alias("r"))
    f1 = lambda m, h, r: _prf(m, h, r)[2]
    less = lambda n: F.greatest(n - 1, F.lit(0))
    return X.bound(counts, lambda c: F.struct(f1(c["m"]["one"], c["h"], c["r"]).alias("rouge1"), f1(c["m"]["two"], less(c["h"]), less(c["r"])).alias("rouge2"), f1(c["m"]["lcs"], c["h"], c["r"]).alias("rougeL")))


def rouge_l_native(ref: Column, hyp: Column) -> Column:
    """The LCS length by nested aggregates, without Python; for cross-checks and short texts."""
    zero = F.transform(F.concat(F.array(F.lit(0)), F.transform(hyp, lambda _: F.lit(0))), lambda x: x)

    def row(above: Column, a: Column) -> Column:
        step = lambda acc, j: F.concat(acc, F.array(F.when(F.get(hyp, j) == a, F.get(above, j) + 1).otherwise(F.greatest(F.get(above, j + 1), F.element_at(acc, -1)))))
        return F.when(F.size(hyp) > 0, F.aggregate(F.sequence(F.lit(0), F.size(hyp) - 1), F.array(F.lit(0)), step)).otherwise(above)

    return F.element_at(F.aggregate(ref, zero, row), -1)


def intl_tokens(c: Column | str) -> Column:
    """BLEU's international tokens: symbols apart, and punctuation apart unless between digits."""
    text = F.regexp_replace(X.col(c), r"(\P{N})(\p{P})", "$1 $2 ")
    text = F.regexp_replace(text, r"(\p{P})(\P{N})", " $1 $2")
    return X.tokens(F.regexp_replace(text, r"(\p{S})", " $1 "))


def tokens_13a(c: Column | str) -> Column:
    """BLEU's 13a tokens: ASCII punctuation apart, periods and commas unless between digits, dashes after digits."""
    # The patterns of the public metric.
    text = F.concat(F.lit(" "), X.collapse_ws(X.col(c)), F.lit(" "))
    text = F.regexp_replace(text, r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 ")
    text = F.regexp_replace(text, r"([^0-9])([\.,])", "$1 $2 ")
    text = F.regexp_replace(text, r"([\.,])([^0-9])", " $1 $2")
    return X.tokens(F.regexp_replace(text, r"([0-9])(-)", "$1 $2 "))


STATS = "struct<matches:array<int>,totals:array<int>,hyp_len:int,ref_len:int>"


def count_matches(ref: list, hyp: list) -> dict:
    """Clipped n-gram matches and totals of the hypothesis for orders 1 to 4, and both lengths."""
    grams = lambda toks, n: Counter(zip(*(toks[i:] for i in range(n)), strict=False))
    of = [(grams(ref, n), grams(hyp, n)) for n in range(1, 5)]
    return {"matches": [sum((r & h).values()) for r, h in of], "totals": [max(0, len(hyp) - n + 1) for n in range(1, 5)], "hyp_len": len(hyp), "ref_len": len(ref)}


def bleu_stats(ref: Column, hyp: Column) -> Column:
    """struct(matches, totals, hyp_len, ref_len) of two token arrays."""

    @F.pandas_udf(STATS)
    def stats(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in pairs:
            yield pd.DataFrame([count_matches(list(x), list(y)) for x, y in zip(a, b, strict=True)], columns=["matches", "totals", "hyp_len", "ref_len"])

    short_batches()
    return stats(ref, hyp)


def bleu_score(s: Column, effective: bool = True) -> Column:
    """0 to 100. Exponential smoothing: the k-th order without a match counts 1 / (2**k * total).

    ``effective``: only orders that the hypothesis is long enough for. Nothing in common at order 1: 0.
    """
    # unrolled over the four orders: (sum of logs, orders, smoothing)
    log, orders, smooth = F.lit(0.0), F.lit(0), F.lit(1.0)
    for n in range(4):
        m, t = F.get(s["matches"], F.lit(n)), F.get(s["totals"], F.lit(n))
        smooth = F.when((m == 0) & (t > 0), smooth * 2).otherwise(smooth)
        log = log + F.when(t == 0, 0.0).when(m > 0, F.log(m / t)).otherwise(F.log(1 / (smooth * t)))
        orders = orders + F.when(t > 0, 1).otherwise(0)
    first = F.get(s["matches"], F.lit(0)) > 0
    return F.when(first if effective else first & (orders == 4), 100 * brevity(s) * F.exp(log / (orders if effective else F.lit(4)))).otherwise(0.0)


def brevity(s: Column) -> Column:
    return F.when(s["hyp_len"] >= s["ref_len"], 1.0).when(s["hyp_len"] > 0, F.exp(1 - s["ref_len"] / s["hyp_len"])).otherwise(0.0)


def corpus_sums(stats: str) -> list[Column]:
    """The sums that ``corpus_scores`` needs, as aggregates."""
    of = lambda f, i: F.sum(F.get(F.col(f"{stats}.{f}"), F.lit(i))).alias(f"_{f}{i}")
    lengths = [F.sum(f"{stats}.{side}_len").alias(f"_{side}_len") for side in ("hyp", "ref")]
    return [*[of(f, i) for f in ("matches", "totals") for i in range(4)], *lengths]


def corpus_scores() -> list[Column]:
    """bleu, brevity_penalty and bleu1 ... bleu4 from the sums."""
    four = lambda f: F.array(*[f"_{f}{i}" for i in range(4)]).alias(f)
    s = F.struct(four("matches"), four("totals"), F.col("_hyp_len").alias("hyp_len"), F.col("_ref_len").alias("ref_len"))
    orders = [F.when(F.col(f"_totals{i}") > 0, 100.0 * F.col(f"_matches{i}") / F.col(f"_totals{i}")).otherwise(0.0).alias(f"bleu{i + 1}") for i in range(4)]
    return [bleu_score(s, effective=False).alias("bleu"), brevity(s).alias("brevity_penalty"), *orders]


def corpus_bleu(df: DataFrame, slices: list[str], stats: str) -> DataFrame:
    """(slices..., bleu, brevity_penalty, bleu1 ... bleu4): counts are summed over the corpus first."""
    return df.groupBy(*slices).agg(*corpus_sums(stats)).select(*slices, *corpus_scores())


def bootstrap_ci(df: DataFrame, slices: list[str], key: str, metrics: list[str], resamples: int = 1000, seed: int = 42) -> DataFrame:
    """(slices..., metric, mean, lo, hi): the percentile interval of the mean, the same resamples for every metric.

    Exact for evaluation sets, which a task holds; ``poisson_ci`` is for larger ones.
    """
    tall = df.select(*slices, key, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select(*slices, key, "x.*")
    kinds = dict(df.dtypes)

    def interval(rows: pd.DataFrame) -> pd.DataFrame:
        v = rows.sort_values(key)["value"].to_numpy()
        rng = np.random.default_rng(seed)
        means = [v[rng.integers(0, len(v), len(v))].mean() for _ in range(resamples)]
        return pd.DataFrame([[*rows[[*slices, "metric"]].iloc[0], v.mean(), *np.percentile(means, [2.5, 97.5])]], columns=[*slices, "metric", "mean", "lo", "hi"])

    return tall.groupBy(*slices, "metric").applyInPandas(interval, ", ".join([*(f"{s} {kinds[s]}" for s in slices), "metric string, mean double, lo double, hi double"]))


def poisson_ci(df: DataFrame, slices: list[str], key: str, metric: str, resamples: int = 1000) -> DataFrame:
    """As ``bootstrap_ci``, by Poisson weights from a hash of key and resample: sums only, for any number of rows.

    Rows are dealt into blocks that sum up all resamples at once, so that no row is multiplied.
    """
    kinds = dict(df.dtypes)
    steps = np.cumsum([np.exp(-1) / np.prod(range(1, k + 1)) for k in range(8)])
    mixed = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
    numbers = np.arange(1, resamples + 1, dtype=np.uint64) * mixed[0]

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            by = pdf.groupby(slices, dropna=False, sort=False) if slices else [((), pdf)]
            for name, rows in by:
                total, weight = np.zeros(resamples), np.zeros(resamples)
                for i in range(0, len(rows), 1000):
                    h = rows["_h"].to_numpy()[i : i + 1000].view(np.uint64)[:, None] + numbers
                    for shift, m in ((30, mixed[1]), (27, mixed[2])):
                        h = (h ^ (h >> np.uint64(shift))) * m
                    w = np.searchsorted(steps, (h >> np.uint64(11)) / float(1 << 53), "right")
                    total += rows["_v"].to_numpy()[i : i + 1000] @ w
                    weight += w.sum(0)
                yield pd.DataFrame([[*(name if isinstance(name, tuple) else (name,)), total, weight]], columns=[*slices, "total", "weight"])

    rows = df.where(F.col(metric).isNotNull()).select(*slices, F.xxhash64(key).alias("_h"), F.col(metric).cast("double").alias("_v"))
    parts = rows.mapInPandas(sums, ", ".join([*(f"`{s}` {kinds[s]}" for s in slices), "total array<double>, weight array<double>"]))
    each = parts.select(*slices, F.posexplode(F.arrays_zip("total", "weight")).alias("_b", "s"))
    means = each.groupBy(*slices, "_b").agg((F.sum("s.total") / F.sum("s.weight")).alias("m"))
    return means.groupBy(*slices).agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))


def paired_differences(a: DataFrame, b: DataFrame, key: str, metric: str) -> DataFrame:
    """(key, difference) over the keys that both have."""
    return a.select(key, F.col(metric).alias("_a")).join(b.select(key, F.col(metric).alias("_b")), key).select(key, (F.col("_a") - F.col("_b")).alias("difference"))


def paired_bootstrap(a: DataFrame, b: DataFrame, key: str, metric: str, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """mean, lo, hi of the differences, and whether the interval holds 0: then neither wins."""
    ci = bootstrap_ci(paired_differences(a, b, key, metric), [], key, ["difference"], resamples, seed)
    return ci.withColumn("indistinguishable", (F.col("lo") <= 0) & (F.col("hi") >= 0))


class PairScorer(Protocol):
    """Takes references and outputs, neither empty, and gives a score from 0 to 1 for each. Made once in each task."""

    def __call__(self, refs: list[str], hyps: list[str]) -> list[float]: ...


def stub_scorer() -> PairScorer:
    """A deterministic stand-in for a model that compares meanings: the share of equal characters from the left."""
    return lambda refs, hyps: [sum(map(str.__eq__, r, h)) / max(len(r), len(h)) for r, h in zip(refs, hyps, strict=True)]


def model_score(ref: Column, hyp: Column, make: Callable[[], PairScorer]) -> Column:
    """The scorer's value where neither side is empty, 0 for the rest, which never reach it."""

    @F.pandas_udf("double")
    def score(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        own = make()
        for r, h in pairs:
            full = (r != "") & (h != "")
            out = np.zeros(len(r))
            if full.any():
                out[full.to_numpy()] = own(r[full].tolist(), h[full].tolist())
            yield pd.Series(out)

    short_batches()
    return score(ref, hyp)


def score_pairs(df: DataFrame, keys: str | Sequence[str], ref: str, hyp: str, tokenizer=X.tokens, placeholder: str = "", scorer: Callable[[], PairScorer] | None = None) -> DataFrame:
    """Per-item scores: keys, ref, hyp, rouge1, rouge2, rougeL, bleu, len, stats, and bertscore_f1 with a ``scorer``.

    Empty outputs score 0 and are never dropped; with a ``placeholder`` ROUGE
    sees that in their place. ``tokenizer`` is ROUGE's.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    rows = df.select(*keys, X.strip_ws(F.coalesce(ref, F.lit(""))).alias("ref"), X.strip_ws(F.coalesce(hyp, F.lit(""))).alias("hyp"))
    rows = rows.withColumn("_seen", F.when(F.col("hyp") == "", placeholder).otherwise(F.col("hyp")))
    model = [model_score(F.col("ref"), F.col("hyp"), scorer).alias("bertscore_f1")] if scorer else []
    counted = rows.select("*", bleu_stats(intl_tokens("ref"), intl_tokens("hyp")).alias("stats"), rouge_scores(tokenizer("ref"), tokenizer("_seen")).alias("_rouge"), *model)
    bleu = F.when(F.col("hyp") == "", 0.0).otherwise(X.bound(F.col("stats"), lambda s: bleu_score(s)) / 100)
    return counted.select(*keys, "ref", "hyp", "_rouge.rougeL", bleu.alias("bleu"), X.word_count("hyp").alias("len"), "stats", *["bertscore_f1"] * bool(scorer), "_rouge.rouge1", "_rouge.rouge2")


def instance_table(items: DataFrame, keys: Sequence[str], digits: int = 4) -> DataFrame:
    """(keys..., rouge1, rouge2, rougeL), rounded: the table of single items."""
    return items.select(*keys, *[F.round(c, digits).alias(c) for c in ("rouge1", "rouge2", "rougeL")])
