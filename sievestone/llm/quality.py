"""Operator 4: a quality classifier by Bradley-Terry pairwise ranking.

A document's raw score is linear in steps of features of its whole text. The
weights come from preference pairs, a row labelled 1 over a row labelled 0, by
the logistic loss of the feature difference. The raw score at the quantile that
is the share of label 0 becomes the threshold, which a logistic curve maps to 0.3.

It learns from all labelled rows and all their pairs, in passes over a scratch
table of features. Steps lie at exact quantiles, found by counting the digits of
values. Weights are multiples of 1 / ``GRID``, so raw scores take few values, and
the counts of these give the loss over all pairs, its slope and the threshold.
A task returns sums of whole numbers only, so the order of rows has no effect.

Defined results: null text counts as empty and is scored; rows without a label
aren't learnt from, equal rows count once; with one label or none every score is
0.5; equal scores stay equal; repeated rows are scored alike; extra columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _give_back, discard, in_arrow, materialize, pick, table
from .langid import remainder

#: Bytes of text of each label that ``labelled_texts`` keeps, about.
LEARN_BYTES = 32 << 20
THRESHOLD = 0.3
STEPS = 8
PAIRS = 2048
EPOCHS = 300
#: Weights of ``learn_quality`` are whole numbers over this.
GRID = 1024
#: Slopes of a row are whole numbers over this: 2**29 rows of a label sum exactly in a double.
FINE = 1 << 24
DECAY = 1e-4
#: Steps towards the least loss, which end sooner where they gain less than ``GAIN``.
ROUNDS = 40
GAIN = 1e-6
#: Tasks that send the driver an array of sums; those of more tasks are added up by as many first.
SENDERS = 16
#: Bits of a feature's value that a pass counts, from the highest.
DIGITS = (11, 11, 10)

_MARKS = re.compile(r"[^\w\s.,;:'\"()?-]")
_LOWER = re.compile(r"[a-zà-öø-ÿ]")


def features(text: str | None) -> list[float]:
    """Shares and rates of a whole text; none depends on the language's words."""
    text = text or ""
    words, lines = text.split(), text.split("\n")
    n, c = max(1, len(words)), max(1, len(text))
    distinct = Counter(words)
    common = max(distinct.values(), default=0)
    twice = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return [
        np.log1p(len(words)),
        len(text.encode()) / c,
        sum(map(len, distinct)) / max(1, len(distinct)),
        len(_MARKS.findall(text)) / n,
        upper / c,
        sum(map(text.count, "0123456789")) / c,
        text.count("|") / n,
        text.count("!") / n,
        (text.count("http") + text.count("www.") + text.count("@")) / n,
        len(distinct) / n,
        len(distinct) / n**0.8,
        twice / n,
        pairs / n,
        common / n,
        len(set(lines)) / len(lines),
        len(lines) / n,
        (text.count(".") + text.count("?")) / n,
        sum(map(str.istitle, distinct)) / max(1, len(distinct)),
    ]


class Ranker:
    """Steps at quantiles of each feature, and a weight for each step."""

    def __init__(self, cuts: np.ndarray, weights: np.ndarray, middle: float, slope: float) -> None:
        self.cuts, self.weights, self.middle, self.slope = cuts, weights, middle, slope

    @staticmethod
    def basis(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        return (x[:, :, None] > cuts[None]).reshape(len(x), -1).astype(np.float32)

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.basis(x, self.cuts) @ self.weights
        z = np.clip(self.slope * (raw - self.middle) + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, share_bad: float, seed: int = 7) -> Ranker | None:
    """A ranker from drawn pairs of rows in memory; no query uses it: ``learn_quality`` takes all pairs of all rows."""
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return None
    # Cuts at quantiles of both labels, so that a rare label's range is resolved as well.
    at = np.linspace(0, 1, STEPS + 2)[1:-1]
    cuts = np.concatenate([np.quantile(s, at, axis=0) for s in (good, bad)]).T
    g, b = Ranker.basis(good, cuts), Ranker.basis(bad, cuts)
    rng = np.random.default_rng(seed)
    w, seen = np.zeros(g.shape[1], dtype=np.float32), np.full(g.shape[1], 1e-6, dtype=np.float32)
    for _ in range(EPOCHS):
        d = g[rng.integers(len(g), size=PAIRS)] - b[rng.integers(len(b), size=PAIRS)]
        slope = d.T @ (1 / (1 + np.exp(np.clip(d @ w, -30, 30)))) / PAIRS - 1e-4 * w
        seen += slope * slope
        w += 0.2 * slope / np.sqrt(seen)
    raw = np.concatenate([g @ w, b @ w])
    weight = np.concatenate([np.full(len(g), (1 - share_bad) / len(g)), np.full(len(b), share_bad / len(b))])
    order = np.argsort(raw, kind="stable")
    below = int(np.searchsorted(np.cumsum(weight[order]), share_bad - 1e-9))
    middle = float(raw[order][below : below + 2].mean())
    spread = float(np.median(g @ w) - np.median(b @ w))
    return Ranker(cuts, w, middle, 8 / max(spread, 1e-3))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, keep, rows_each: int, bytes_each: int = LEARN_BYTES) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, label) of rows where ``keep(doc_id)``, and the labels' counts.

    Of each label the first ``rows_each`` by a hash of doc_id, and of these the
    first ``bytes_each`` bytes of text, one row at least. Equal rows count once.
    """
    known = labels.where(keep(F.col("doc_id")) & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("_label"))
    counts = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    first = lambda rows, v, *ties: rows.where(F.col("_label") == v).orderBy(F.xxhash64("doc_id"), "doc_id", *ties).limit(rows_each)
    chosen = first(known, 0).union(first(known, 1))  # 2 * rows_each rows at most
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").withColumn("_x", F.xxhash64("text"))
    # Ids may repeat, and texts be long: what is chosen is bounded again, by hashes and lengths alone.
    sized = rows.select("doc_id", "_label", "_x", F.octet_length("text").cast("bigint").alias("n")).distinct()
    kept, size = [], {0: 0, 1: 0}
    for r in first(sized, 0, "_x").union(first(sized, 1, "_x")).collect():
        if not size[r["_label"]] or size[r["_label"]] + r["n"] <= bytes_each:
            kept.append(r)
        size[r["_label"]] += r["n"]
    picked = docs.sparkSession.createDataFrame(kept, sized.schema).drop("n")
    return rows.join(F.broadcast(picked), ["doc_id", "_label", "_x"]).dropDuplicates(["doc_id", "_label", "_x"]).select("doc_id", "text", "_label"), counts


WIDTH = len(features(""))


def _rows(texts: pa.Array) -> np.ndarray:
    """Features of texts in single precision, as models learn and see them."""
    return np.array([features(t) for t in texts.to_pylist()], dtype=np.float32).reshape(-1, WIDTH)


def _unpacked(x: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.to_pylist()), dtype=np.float32).reshape(-1, WIDTH)


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, _text, x) of each row: a hash and the packed features of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([r.tobytes() for r in _rows(batch.column(2))], type=pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), x], names=["doc_id", "_text", "x"])

    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text"), "text")
    return in_arrow(texts, run, f"doc_id {dict(docs.dtypes)['doc_id']}, _text bigint, x binary")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            block = batch.column(0).to_numpy().astype(np.int8).tobytes(), b"".join(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([b], type=pa.binary()) for b in block], names=["labels", "x"])


def packed(rows: DataFrame) -> DataFrame:
    """Rows (label, x) as a scratch table of blocks (labels, x)."""
    return materialize(in_arrow(rows, _pack, "labels binary, x binary"), "labelled")


def _total(blocks: RDD, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``f(labels, features)`` over all blocks, flat: 0 without any.

    A plain job on one scan, as there are many of them: a query each would fill the driver with plans.
    """

    def summed(part: Callable) -> Callable[[Iterator], Iterator[bytes]]:
        def run(items: Iterator) -> Iterator[bytes]:
            total = None
            for item in items:
                total = part(item) if total is None else total + part(item)
            if total is not None:
                yield zlib.compress(total.tobytes(), 1)  # mostly zeros
            del total
            _give_back()

        return run

    unzip = lambda b: np.frombuffer(zlib.decompress(b))
    sums = blocks.mapPartitions(summed(lambda b: f(np.frombuffer(b[0], np.int8).astype(np.int64), np.frombuffer(b[1], np.float32).reshape(-1, WIDTH))))
    if blocks.getNumPartitions() > SENDERS:
        sums = sums.repartition(SENDERS).mapPartitions(summed(unzip))
    return sum(map(unzip, sums.collect()), np.zeros(1))


def exact_cuts(blocks: RDD) -> tuple[np.ndarray, np.ndarray] | None:
    """The cuts of each feature at quantiles of label 1, then of label 0, and the rows of each label (0, 1).

    The quantile k / n is the value with floor(k (rows - 1) / n) values before it.
    No feature is negative, so their bits as whole numbers are in their order.
    """
    known = np.zeros((2, WIDTH, STEPS), dtype=np.int64)  # the highest bits of each cut, so far
    before = counts = None
    low = 32
    for bits in DIGITS:
        low, size = low - bits, 1 << bits

        def digits(y: np.ndarray, x: np.ndarray, known: np.ndarray = known, low: int = low, bits: int = bits, size: int = size) -> np.ndarray:
            out = np.zeros((2, WIDTH, STEPS * size))
            for label in (0, 1):
                values = x[y == label].view(np.uint32).astype(np.int64)
                for j in range(WIDTH):
                    top = values[:, j] >> (low + bits)
                    at = np.minimum(np.searchsorted(known[label, j], top), STEPS - 1)  # of equal ones the first
                    hit = known[label, j, at] == top
                    out[label, j] += np.bincount(at[hit] * size + (values[hit, j] >> low & size - 1), minlength=STEPS * size)
            return out.ravel()

        found = _total(blocks, digits)
        if len(found) == 1:
            return None
        found = found.reshape(2, WIDTH, STEPS, size)
        if counts is None:
            counts = found[:, 0, 0].sum(axis=1).astype(np.int64)
            if not counts.all():
                return None
            ranks = [[k * (int(n) - 1) // (STEPS + 1) for k in range(1, STEPS + 1)] for n in counts]
            before = np.repeat(np.array(ranks)[:, None], WIDTH, axis=1)
        longer = np.empty_like(known)
        for label, j, k in np.ndindex(known.shape):
            first = int(np.searchsorted(known[label, j], known[label, j, k]))
            ends = np.cumsum(found[label, j, first])
            digit = int(np.searchsorted(ends, before[label, j, k], "right"))
            before[label, j, k] -= int(ends[digit - 1]) if digit else 0
            longer[label, j, k] = known[label, j, k] << bits | digit
        known = longer
    cuts = known.astype(np.uint32).view(np.float32)
    return np.concatenate([cuts[1], cuts[0]], axis=1), counts


class _Scores:
    """How many rows of each label have each raw score under whole-numbered weights."""

    def __init__(self, blocks: RDD, cuts: np.ndarray, whole: np.ndarray) -> None:
        self.blocks, self.cuts, self.whole = blocks, cuts, whole
        self.least = least = int(whole[whole < 0].sum())
        self.size = size = int(whole[whole > 0].sum()) - least + 1

        def count(y: np.ndarray, x: np.ndarray) -> np.ndarray:
            at = (Ranker.basis(x, cuts) @ whole.astype(np.float32)).astype(np.int64) - least  # whole numbers: exact
            return np.bincount(y * size + at, minlength=2 * size).astype(np.float64)

        self.bad, self.good = _total(blocks, count).reshape(2, size)

    def over_pairs(self, kernel: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """At each score s the sum over scores t of ``counts[t] * kernel[s - t + size - 1]``."""
        n = 1 << (3 * self.size - 2).bit_length()
        return np.fft.irfft(np.fft.rfft(kernel, n) * np.fft.rfft(counts, n), n)[self.size - 1 : 2 * self.size - 1]

    def loss(self) -> float:
        """The mean of -log sigmoid(good - bad) over all pairs, and the decay."""
        gap = np.arange(1 - self.size, self.size) / GRID
        lost = self.over_pairs(np.logaddexp(0, -gap), self.bad) @ self.good
        return float(lost / self.good.sum() / self.bad.sum() + DECAY / 2 * np.sum((self.whole / GRID) ** 2))

    def slope(self) -> np.ndarray:
        """The slope of ``loss`` by the weights."""
        gap = np.arange(1 - self.size, self.size) / GRID
        wrong = 1 / (1 + np.exp(np.clip(gap, -30, 30)))  # of a good row that lies ``gap`` above a bad one
        of_good = self.over_pairs(wrong, self.bad) / self.bad.sum()
        of_bad = self.over_pairs(wrong[::-1], self.good) / self.good.sum()
        fine = np.rint(np.clip([of_bad, of_good], 0, 1) * FINE).astype(np.int32)
        cuts, whole, least = self.cuts, self.whole, self.least

        def add(y: np.ndarray, x: np.ndarray) -> np.ndarray:
            z = Ranker.basis(x, cuts)
            at = (z @ whole.astype(np.float32)).astype(np.int64) - least
            pull = fine[y, at].astype(np.float64)
            return np.concatenate([(pull * (y == label)) @ z.astype(np.float64) for label in (0, 1)])

        bad, good = _total(self.blocks, add).reshape(2, -1) / FINE
        return bad / self.bad.sum() - good / self.good.sum() + DECAY * self.whole / GRID

    def median(self, counts: np.ndarray) -> float:
        return self.at(counts, (int(counts.sum()) - 1) // 2, int(counts.sum()) // 2)

    def at(self, counts: np.ndarray, *ranks: int) -> float:
        """The mean of the raw scores with these ranks, from 0."""
        return float((np.searchsorted(np.cumsum(counts), ranks, "right") + self.least).mean() / GRID)


def fit_all(blocks: RDD) -> Ranker | None:
    """A ranker from all pairs of the rows in the blocks: cuts, weights and threshold.

    The weights descend by BFGS steps, which begin with the loss's curvature at
    weights of 0: nowhere is it more.
    """
    found = exact_cuts(blocks)
    if found is None:
        return None
    cuts, (bads, goods) = found
    n = cuts.size

    def products(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        z = Ranker.basis(x, cuts)
        return np.concatenate([(z[y == label].T @ z[y == label]).astype(np.float64).ravel() for label in (0, 1)])

    bad, good = _total(blocks, products).reshape(2, n, n) / np.array([bads, goods])[:, None, None]
    cross = np.outer(bad.diagonal(), good.diagonal())
    start = np.linalg.inv((bad + good - cross - cross.T) / 4 + DECAY * np.eye(n))
    whole, scores, loss = np.zeros(n, dtype=np.int64), None, np.log(2)
    slope = (bad.diagonal() - good.diagonal()) / 2
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(ROUNDS):
        step, kept = -slope, []
        for s, v in reversed(past):
            kept.append(s @ step / (s @ v))
            step = step - kept[-1] * v
        step = start @ step
        for (s, v), a in zip(past, reversed(kept)):
            step = step + (a - v @ step / (s @ v)) * s
        for halved in range(6):
            nearby = np.rint(whole + GRID * step / 2**halved).astype(np.int64)
            tried = _Scores(blocks, cuts, nearby)
            lower = tried.loss()
            if lower < loss:
                break
        else:
            break
        moved, gained = (nearby - whole) / GRID, loss - lower
        whole, scores, loss = nearby, tried, lower
        if gained < GAIN:
            break
        before, slope = slope, scores.slope()
        if moved @ (slope - before) > 0:
            past.append((moved, slope - before))
    scores = scores or _Scores(blocks, cuts, whole)
    middle = scores.at(scores.bad + scores.good, int(bads) - 1, int(bads))
    return Ranker(cuts, (whole / GRID).astype(np.float32), middle, 8 / max(scores.median(scores.good) - scores.median(scores.bad), 1e-3))


def learn_measured(measured: DataFrame, labels: DataFrame, keep) -> Ranker | None:
    """A ranker from all rows of ``measure`` that have a label and where ``keep(doc_id)``."""
    known = labels.where(keep(F.col("doc_id")) & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("label")).distinct()
    blocks = packed(measured.join(known, "doc_id").dropDuplicates(["doc_id", "label", "_text"]).select("label", "x"))
    ranker = fit_all(blocks.rdd)
    discard(blocks)
    return ranker


def learn_quality(docs: DataFrame, labels: DataFrame, keep) -> Ranker | None:
    return learn_measured(measure(docs.where(keep(F.col("doc_id")))), labels, keep)


def score_quality(docs: DataFrame, ranker: Ranker | None, *kept: str, names: tuple[str, str] = ("score", "predicted"), measured: bool = False) -> DataFrame:
    """The columns ``kept`` of ``docs``, the score of its text and the predicted label under ``names``.

    Of a table of ``measure`` the features are taken as they are.
    """
    source, values = ("x", _unpacked) if measured else ("text", _rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = ranker.score(values(batch.column(source))) if ranker and batch.num_rows else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(s, type=pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], names=[*kept, *names])

    kinds = dict(docs.dtypes)
    columns = pick(docs, *dict.fromkeys([*kept, source]))
    return in_arrow(columns, score, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), f"`{names[0]}` double", f"`{names[1]}` int"]))


def op4_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = materialize(measure(table(spark, sf_dir, "documents")), "features")
    held_out = lambda c: remainder(c, 5) == 0
    ranker = learn_measured(measured, table(spark, sf_dir, "labels"), lambda c: ~held_out(c))
    return score_quality(measured, ranker, "doc_id", measured=True).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
