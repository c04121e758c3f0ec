"""Operator 7: toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input joins a word embedding, the mean embedding of its character
3- and 4-grams, and two evidence numbers (shrunken log-odds of the word and of
its most telling n-gram). The network reads windows of WINDOW words that
overlap by WINDOW - STRIDE; a document's score is its highest window's.

Learning, on the driver, from at most ``LEARN_ROWS`` labelled rows of each
label (and about ``quality.LEARN_BYTES`` bytes of their texts), all their
windows and all words that two of them have: one half of them gives vocabulary and evidence, the other trains the
network by backpropagation through time on the documents' labels (a document
is toxic if any window is: noisy-or), so evidence never scores its own source.

Defined results: null text and text without a word score 0; rows without a
label aren't learnt from; with one label or none every score is 0; repeated
rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, pick, table
from .langid import remainder
from .quality import labelled_texts

LEARN_ROWS = 2500
WINDOW, STRIDE = 32, 24
HIDDEN, WORD_DIM, CHAR_DIM, ATTEND = 12, 4, 4, 8
GRAM_BITS, CHAR_BITS = 18, 12
EPOCHS, DOCS_A_BATCH = 5, 48
#: Words in one worker's table of input projections; it starts anew beyond that.
KEPT_WORDS = 200_000
#: Characters looked up at a time, and windows run at a time.
SEGMENT, BLOCK = 1_000_000, 4096
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’…¡¿–—"


def normal(piece: str) -> str:
    return piece.strip(EDGES).lower()


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (GRAM_BITS bits) of all 3- and 4-grams of ^word$, grouped by word, and each word's first one."""
    joined = "".join(f"^{w}$ " for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    word = np.repeat(np.arange(len(words)), sizes + 1)
    at = np.arange(len(codes)) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)
    left = sizes[word] - at  # characters from here to the word's end
    codes = np.concatenate([codes, np.zeros(4, dtype=np.uint64)])
    n = len(word)
    h = codes[:n] * np.uint64(0x9E3779B97F4A7C15) + codes[1 : n + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2 : n + 2] * np.uint64(0x165667B19E3779F9)
    four = h + codes[3 : n + 3] * np.uint64(0x27D4EB2F165667C5) + np.uint64(1)
    # every word has a 3-gram, save the empty one, whose "^$" and the blank after it count as one
    keep3, keep4 = (left >= 3) | ((at == 0) & (sizes[word] == 2)), left >= 4
    owner = np.concatenate([word[keep3], word[keep4]])
    hashed = np.concatenate([h[keep3], four[keep4]])
    hashed ^= hashed >> np.uint64(29)
    hashed = (hashed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - GRAM_BITS)
    order = np.argsort(owner, kind="stable")
    return hashed[order].astype(np.int64), np.searchsorted(owner[order], np.arange(len(words)))


def _evidence(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return np.clip(np.where(odds > 0, odds * toxic / (toxic + 3), odds), -1, 4).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Inputs:
    """Vocabulary, evidence and embeddings: from words to the network's input vectors."""

    def __init__(self, texts: list[str], labels: np.ndarray, rng: np.random.Generator) -> None:
        n_toxic, n_clean = int(labels.sum()), int((1 - labels).sum())
        seen = [Counter(), Counter()]
        held: list[set[str]] = []
        for text, label in zip(texts, labels, strict=True):
            held.append({normal(p) for p in text.split()})
            seen[int(label)].update(held[-1])
        common = [w for w, _ in sorted((seen[0] + seen[1]).items(), key=lambda x: (-x[1], x[0])) if seen[0][w] + seen[1][w] > 1]
        self.number = {w: i + 1 for i, w in enumerate(common)}
        counts = [np.array([0, *(s[w] for w in common)], dtype=np.float64) for s in seen]
        self.word_evidence = _evidence(counts[1], counts[0], n_toxic, n_clean)
        self.word_evidence[0] = 0
        in_docs = np.zeros((2, 1 << GRAM_BITS))
        for words, label in zip(held, labels, strict=True):
            if words:
                in_docs[int(label), np.unique(grams(sorted(words))[0])] += 1
        self.gram_evidence = _evidence(in_docs[1], in_docs[0], n_toxic, n_clean)
        self.gram_evidence[in_docs.sum(0) == 0] = 0
        self.word_table = rng.normal(0, 0.1, (len(common) + 1, WORD_DIM)).astype(np.float32)
        self.char_table = rng.normal(0, 0.1, (1 << CHAR_BITS, CHAR_DIM)).astype(np.float32)

    def parts(self, words: list[str]):
        hashed, first = grams(words)
        ids = np.fromiter((self.number.get(w, 0) for w in words), dtype=np.int64, count=len(words))
        evidence = np.stack([self.word_evidence[ids], np.maximum.reduceat(self.gram_evidence[hashed], first)], axis=1)
        each = np.diff(np.append(first, len(hashed))).astype(np.float32)
        return ids, hashed & ((1 << CHAR_BITS) - 1), first, each, evidence

    def vectors(self, parts) -> np.ndarray:
        ids, chars, first, each, evidence = parts
        mean = np.add.reduceat(self.char_table[chars], first) / each[:, None]
        return np.concatenate([self.word_table[ids], mean, evidence], axis=1).astype(np.float32)


class Network:
    """Two GRUs, one from each side, and attention over their states."""

    def __init__(self, size: int, rng: np.random.Generator) -> None:
        w = lambda *s: (rng.normal(0, 1, s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {f"{k}{d}": v for d in "fb" for k, v in {"W": w(size, 3 * HIDDEN), "c": np.zeros(3 * HIDDEN, dtype=np.float32), "U": w(HIDDEN, 3 * HIDDEN)}.items()}
        self.p |= {"A": w(2 * HIDDEN, ATTEND), "a": np.zeros(ATTEND, dtype=np.float32), "v": w(ATTEND), "o": w(2 * HIDDEN), "b": np.full(1, -2, dtype=np.float32)}
        self.shift = 0.0

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(x @ self.p[f"W{d}"] + self.p[f"c{d}"] for d in "fb")

    def _run(self, px: np.ndarray, idx: np.ndarray, mask: np.ndarray, d: str, tape: list | None) -> np.ndarray:
        """States (window, batch, HIDDEN); a padded place keeps the state before it."""
        u, h = self.p[f"U{d}"], np.zeros((len(idx), HIDDEN), dtype=np.float32)
        out = np.empty((idx.shape[1], len(idx), HIDDEN), dtype=np.float32)
        for t in range(idx.shape[1]) if d == "f" else reversed(range(idx.shape[1])):
            x, g, m = px[idx[:, t]], h @ u, mask[:, t, None]
            zr = _sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
            z = 1 - m * (1 - z)
            new = n + z * (h - n)
            if tape is not None:
                tape.append((t, h, zr, z, n, g[:, 2 * HIDDEN :]))
            h = out[t] = new
        return out

    def forward(self, projected, idx: np.ndarray, mask: np.ndarray, tapes=None):
        """A logit for each window; idx: rows of the projections, mask: 1 where there is a word."""
        hs = np.concatenate([self._run(px, idx, mask, d, tapes[d] if tapes else None) for px, d in zip(projected, "fb", strict=True)], axis=2)
        u = np.tanh(hs @ self.p["A"] + self.p["a"])
        e = np.where(mask.T > 0, u @ self.p["v"], -1e9)
        e = np.exp(e - e.max(0))
        alpha = e / e.sum(0)
        context = np.einsum("tb,tbh->bh", alpha, hs)
        return context @ self.p["o"] + self.p["b"][0], (hs, u, alpha, context)

    def backward(self, kept, d_logit: np.ndarray, x: np.ndarray, idx: np.ndarray, mask: np.ndarray, tapes) -> tuple[dict, np.ndarray]:
        p, (hs, u, alpha, context) = self.p, kept
        grad = {"o": context.T @ d_logit, "b": np.array([d_logit.sum()])}
        d_context = d_logit[:, None] * p["o"]
        d_alpha = np.einsum("bh,tbh->tb", d_context, hs)
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(0))
        d_pre = d_e[:, :, None] * p["v"] * (1 - u * u)
        grad |= {"v": np.einsum("tb,tba->a", d_e, u), "a": d_pre.sum((0, 1)), "A": np.einsum("tbh,tba->ha", hs, d_pre)}
        d_hs = alpha[:, :, None] * d_context + d_pre @ p["A"].T
        d_x = np.zeros_like(x)
        for k, d in enumerate("fb"):
            own, d_u, d_px = d_hs[:, :, k * HIDDEN : (k + 1) * HIDDEN], np.zeros_like(p[f"U{d}"]), np.zeros((len(x), 3 * HIDDEN), dtype=np.float32)
            d_h = np.zeros((len(idx), HIDDEN), dtype=np.float32)
            for t, h, zr, z, n, gn in reversed(tapes[d]):
                d_h = d_h + own[t]
                m, r = mask[:, t, None], zr[:, HIDDEN:]
                d_n = d_h * (1 - z) * (1 - n * n)
                d_z = d_h * (h - n) * m * zr[:, :HIDDEN] * (1 - zr[:, :HIDDEN])
                d_r = d_n * gn * r * (1 - r)
                d_g = np.concatenate([d_z, d_r, d_n * r], axis=1)
                np.add.at(d_px, idx[:, t], np.concatenate([d_z, d_r, d_n], axis=1))
                d_u += h.T @ d_g
                d_h = d_h * z + d_g @ p[f"U{d}"].T
            grad |= {f"U{d}": d_u, f"W{d}": x.T @ d_px, f"c{d}": d_px.sum(0)}
            d_x += d_px @ p[f"W{d}"].T
        return grad, d_x


def window_starts(n: int) -> np.ndarray:
    """Starts of all overlapping windows over n words; the last may be short."""
    return np.arange(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


class _Adam:
    def __init__(self, rate: float) -> None:
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, p: dict, grad: dict) -> None:
        self.t += 1
        for k, g in grad.items():
            self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            self.v[k] = 0.99 * self.v.get(k, 0) + 0.01 * g * g
            p[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-6)).astype(p[k].dtype)


class Scorer:
    def __init__(self, inputs: Inputs, network: Network) -> None:
        self.inputs, self.network = inputs, network
        self._clear()

    def __getstate__(self) -> dict:
        return {"inputs": self.inputs, "network": self.network}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def _clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.projected = [np.zeros((1024, 3 * HIDDEN), dtype=np.float32) for _ in "fb"]  # row 0: padding

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        if fresh := set(pieces).difference(self.rows):
            if len(self.rows) + len(fresh) > KEPT_WORDS:
                self._clear()
                fresh = set(pieces)
            fresh = list(fresh)
            new = self.network.project(self.inputs.vectors(self.inputs.parts([normal(p) for p in fresh])))
            at = len(self.rows) + 1
            while at + len(fresh) > len(self.projected[0]):
                self.projected = [np.concatenate([x, np.zeros_like(x)]) for x in self.projected]
            for x, y in zip(self.projected, new, strict=True):
                x[at : at + len(fresh)] = y
            self.rows.update(zip(fresh, range(at, at + len(fresh))))
        return np.fromiter(map(self.rows.__getitem__, pieces), dtype=np.int64, count=len(pieces))

    def _windows(self, numbers: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A logit for each window from ``starts``; ``ends``: where its document ends."""
        out = np.empty(len(starts), dtype=np.float32)
        for i in range(0, len(starts), BLOCK):
            at = starts[i : i + BLOCK, None] + np.arange(WINDOW)
            mask = at < ends[i : i + BLOCK, None]
            idx = np.where(mask, numbers[np.minimum(at, len(numbers) - 1)], 0)
            out[i : i + BLOCK] = self.network.forward(self.projected, idx, mask.astype(np.float32))[0]
        return out

    def _score(self, docs: list[list[str]]) -> np.ndarray:
        numbers = self._numbers([p for d in docs for p in d])
        sizes = np.array([len(d) for d in docs])
        first = np.cumsum(sizes) - sizes
        scores, full = np.zeros(len(docs)), np.flatnonzero(sizes)
        if len(full):
            own = [window_starts(n) for n in sizes[full]]
            many = np.array([len(s) for s in own])
            starts = np.concatenate(own) + np.repeat(first[full], many)
            logits = self._windows(numbers, starts, np.repeat((first + sizes)[full], many))
            scores[full] = _sigmoid(np.maximum.reduceat(logits, np.cumsum(many) - many) - self.network.shift)
        return scores

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Scores of whole texts. Very long ones are run in parts that overlap as windows do."""
        found, batch, size = [], [], 0
        for text in texts:
            words = (text or "").split()
            most = STRIDE * (SEGMENT // (8 * STRIDE))
            if len(words) > most:
                found.append(self._score(batch))
                batch, size = [], 0
                parts = [words[i : i + most + WINDOW - STRIDE] for i in range(0, max(1, len(words) - (WINDOW - STRIDE)), most)]
                found.append(np.array([max(float(self._score([p])[0]) for p in parts)]))
                continue
            batch.append(words)
            size += len(words)
            if size > most:
                found.append(self._score(batch))
                batch, size = [], 0
        found.append(self._score(batch))
        return np.concatenate(found)


def fit(texts: list[str], labels: np.ndarray, toxic_share: float, seed: int = 11) -> Scorer | None:
    """Learn from texts with 0/1 labels; ``toxic_share``: the share of label 1 outside the sample."""
    half = np.arange(len(texts)) % 2 == 0
    if min(labels[half].sum(), (1 - labels[half]).sum(), labels[~half].sum(), (1 - labels[~half]).sum()) < 1:
        return None
    rng = np.random.default_rng(seed)
    inputs = Inputs([t for t, a in zip(texts, half, strict=True) if a], labels[half], rng)
    network = Network(WORD_DIM + CHAR_DIM + 2, rng)
    docs = [t.split() for t, a in zip(texts, half, strict=True) if not a]
    y = labels[~half].astype(np.float32)
    order = sorted({p for d in docs for p in d})
    parts = inputs.parts([normal(p) for p in order])
    row = {p: i for i, p in enumerate(order)}
    windows: list[np.ndarray] = []
    for d in docs:
        n = np.array([row[p] + 1 for p in d], dtype=np.int32)
        at = window_starts(len(n))[:, None] + np.arange(WINDOW)
        windows.append(np.where(at < len(n), np.append(n, 0)[np.minimum(at, len(n))], 0).astype(np.int32))
    tables = {"word": inputs.word_table, "char": inputs.char_table}
    adam, slow = _Adam(0.01), _Adam(0.01)
    usable = [i for i, d in enumerate(docs) if d]
    for _ in range(max(EPOCHS, min(60, 3000 // max(1, len(usable))))):
        for batch in np.array_split(rng.permutation(usable), -(-len(usable) // DOCS_A_BATCH)):
            doc = np.repeat(np.arange(len(batch)), [len(windows[i]) for i in batch])
            grad, d_tables = _batch_gradients(inputs, network, parts, np.concatenate([windows[i] for i in batch]), doc, y[batch])
            adam.step(network.p, grad)
            slow.step(tables, d_tables)
    scorer = Scorer(inputs, network)
    _place_cut(scorer, docs, y, toxic_share)
    return scorer


def _batch_gradients(inputs: Inputs, network: Network, parts, windows: np.ndarray, doc: np.ndarray, y: np.ndarray) -> tuple[dict, dict]:
    """Gradients of the mean noisy-or loss of documents with labels ``y``; window i belongs to ``doc[i]``.

    Windows are run ``BLOCK`` at a time, so that a document of any length fits;
    with more than one block the logits come from a pass of their own.
    """

    def run(idx: np.ndarray, tapes):
        used, idx = np.unique(idx, return_inverse=True)
        idx = idx.reshape(-1, WINDOW)
        mask = (used[idx] > 0).astype(np.float32)
        own = _subset(parts, np.maximum(used - 1, 0))
        x = inputs.vectors(own)
        return own, x, idx, mask, network.forward(network.project(x), idx, mask, tapes)

    blocks = [slice(i, i + BLOCK) for i in range(0, len(windows), BLOCK)]
    tapes = {"f": [], "b": []}
    first = run(windows[blocks[0]], tapes if len(blocks) == 1 else None)
    logit = np.concatenate([first[4][0], *(run(windows[b], None)[4][0] for b in blocks[1:])])
    total = np.bincount(doc, weights=np.logaddexp(0, logit), minlength=len(y))
    to = np.where(y == 1, -1 / np.expm1(np.clip(total, 1e-6, 50)), 1.0)
    d_logit = (to[doc] * _sigmoid(logit) / len(y)).astype(np.float32)
    grad: dict = {}
    d_word, d_char = np.zeros_like(inputs.word_table), np.zeros_like(inputs.char_table)
    for b in blocks:
        if len(blocks) > 1:
            tapes = {"f": [], "b": []}
            first = run(windows[b], tapes)
        own, x, idx, mask, (_, kept) = first
        g, d_x = network.backward(kept, d_logit[b], x, idx, mask, tapes)
        grad = {k: grad.get(k, 0) + v for k, v in g.items()}
        np.add.at(d_word, own[0], d_x[:, :WORD_DIM])
        np.add.at(d_char, own[1], np.repeat(d_x[:, WORD_DIM : WORD_DIM + CHAR_DIM] / own[3][:, None], own[3].astype(int), axis=0))
    return grad, {"word": d_word, "char": d_char}


def _subset(parts, rows: np.ndarray):
    """``parts`` for some words only."""
    ids, chars, first, each, evidence = parts
    n = each[rows].astype(np.int64)
    new = np.cumsum(n) - n
    return ids[rows], chars[np.repeat(first[rows] - new, n) + np.arange(n.sum())], new, each[rows], evidence[rows]


def _place_cut(scorer: Scorer, docs: list[list[str]], y: np.ndarray, toxic_share: float) -> None:
    """Shift the logits so that 0.5 parts the labels with the least weighted error."""
    s = np.clip(scorer._score(docs), 1e-9, 1 - 1e-9)
    logit = np.log(s / (1 - s))
    weight = np.where(y == 1, toxic_share / y.sum(), (1 - toxic_share) / (1 - y).sum())
    order = np.argsort(logit, kind="stable")
    wrong = np.cumsum(np.where(y == 1, weight, -weight)[order])
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    low = logit[order][best[len(best) // 2]]
    above = logit[order][min(len(order) - 1, best[len(best) // 2] + 1)]
    scorer.network.shift = float((low + above) / 2)


def learn_toxicity(docs: DataFrame, labels: DataFrame, keep, rows_each: int = LEARN_ROWS) -> Scorer | None:
    sample, counts = labelled_texts(docs, labels, "toxic", keep, rows_each)
    rows = sample.select("doc_id", "text", "_label").toPandas().sort_values(["doc_id", "text"])  # 2 * rows_each rows at most
    if not len(rows):
        return None
    return fit([t or "" for t in rows["text"]], rows["_label"].to_numpy(), counts.get(1, 0) / sum(counts.values()))


def score_toxicity(docs: DataFrame, scorer: Scorer | None, *kept: str) -> DataFrame:
    """The columns ``kept`` of ``docs`` with score and predicted, from its text alone."""
    held = docs.sparkSession.sparkContext.broadcast(scorer)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            s = own.score(texts) if own else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(s, type=pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=[*kept, "score", "predicted"])

    kinds = dict(docs.dtypes)
    columns = pick(docs, *dict.fromkeys([*kept, "text"]))
    return in_arrow(columns, score, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "score double", "predicted int"]))


def op7_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = lambda c: remainder(c, 5) == 0
    scorer = learn_toxicity(docs, table(spark, sf_dir, "labels"), lambda c: ~held_out(c))
    return score_toxicity(docs, scorer, "doc_id").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
