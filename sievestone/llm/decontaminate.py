"""Operator 5: benchmark decontamination by spaced seeds.

A seed is a mask over LEAST_OVERLAP token positions that looks at WEIGHT of
them and ignores the rest. The masks are chosen so that, wherever a stretch of
LEAST_OVERLAP tokens differs from an item in up to a fifth of its places, at
least one mask finds all it looks at unchanged. The seeds' hashes of benchmark
items and documents are joined; around every hit the item is laid over the
document and the longest stretch with at least SIMILAR equal tokens is taken.
It is a leak from LEAST_OVERLAP tokens on. A shorter item is a leak where it
stands whole: with at least SIMILAR equal tokens from SHORT tokens on (masks of
that span find it), unchanged below that (one mask over all of it).

Tokens: pieces between white space, without punctuation at either end, in lower
case, as 64-bit hashes; a piece of punctuation alone is none. A benchmark of at
most ``broadcast_tokens`` tokens, counted first, is joined in memory on every
worker; a larger one as a table, after a fixed-size bitmap of its seeds has
dropped the documents' seeds that it can't have.

Defined results: null texts and items have no token and never match; repeated
rows of a document are searched one by one; each distinct item_id and text is
an item of its own, so repeated rows of the benchmark count once and two texts
under one id may give two rows; a null item_id is an id like others; of several
overlaps of a document and an item the longest counts, then the first; empty
tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, materialize, pick, table

LEAST_OVERLAP = 10
SIMILAR = 0.8
WEIGHT = 5
#: Tokens from which a shorter item may differ in some, and the weight of its masks.
SHORT, SHORT_WEIGHT = 5, 3
#: Benchmark tokens up to which its seeds go to all workers (some 25 bytes a seed, three seeds a token).
BROADCAST_TOKENS = 1_000_000
#: Bits by which seeds are told apart before they are joined: for a worker's search, and in the bitmap for a table's.
TABLE_BITS, BITMAP_BITS = 22, 27
#: Pieces whose token a worker keeps within a partition.
KEPT_PIECES = 300_000
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’…¡¿–—"


def choose_masks(span: int = LEAST_OVERLAP, weight: int = WEIGHT, changed: int = LEAST_OVERLAP - int(LEAST_OVERLAP * SIMILAR)) -> list[tuple[int, ...]]:
    """Masks, as offsets from 0, of which one fits between any ``changed`` places of ``span``: the greedy cover."""
    todo = set(combinations(range(span), changed))
    masks = [(0, *m) for m in combinations(range(1, span), weight - 1)]
    meets = {m: {c for c in todo if any(not {p + s for p in m} & set(c) for s in range(span - m[-1]))} for m in masks}
    chosen = []
    while todo:
        best = max(masks, key=lambda m: (len(meets[m] & todo), m))
        chosen.append(best)
        todo -= meets[best]
    return chosen


MASKS = choose_masks()
SHORT_MASKS = choose_masks(SHORT, SHORT_WEIGHT, 1)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], dtype=np.uint64)


def masks_of(n: int) -> list[tuple[int, ...]]:
    """The masks under which an item of n tokens is searched."""
    return MASKS if n >= LEAST_OVERLAP else SHORT_MASKS if n >= SHORT else [tuple(range(n))] if n else []


def normal(piece: str) -> str:
    return piece.strip(EDGES).lower()


def seed_hashes(tokens: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The mask's hash at every place of the tokens where it fits."""
    n = len(tokens) - mask[-1]
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.full(n, np.uint64(mask[-1] * 1_000_003 + sum(1 << p for p in mask)), dtype=np.uint64)
    for p, odd in zip(mask, np.resize(_ODD, len(mask)), strict=True):
        h = (h ^ tokens[p : p + n] * odd) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


class _Tokens(dict):
    """Tokens of raw pieces as odd hashes; 0 for a piece that is none."""

    def __missing__(self, piece: str) -> int:
        token = normal(piece)
        n = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass")) | 1 if token else 0
        if len(self) < KEPT_PIECES:
            self[piece] = n
        return n

    def of(self, text: str | None) -> np.ndarray:
        pieces = (text or "").split()
        n = np.fromiter(map(self.__getitem__, pieces), dtype=np.uint64, count=len(pieces))
        return n[n > 0]


def longest_stretch(equal: np.ndarray) -> tuple[int, int]:
    """The first longest stretch [i, j) with at least SIMILAR of it true."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 5 * (1 - SIMILAR), -5 * SIMILAR).round().astype(np.int64))])
    least = np.minimum.accumulate(total)
    i = np.searchsorted(-least, -total)  # the first place whose sum is no higher
    size = np.arange(len(total)) - i
    j = int(size.argmax())
    return int(i[j]), j


def overlap(tokens: np.ndarray, item: np.ndarray, start: int) -> tuple[int, int, int] | None:
    """(tokens, minus the first one's place, equal tokens) of the leak where the item lies over the document from ``start``."""
    a, b = max(0, start), min(len(tokens), start + len(item))
    equal = tokens[a:b] == item[a - start : b - start]
    if len(item) >= LEAST_OVERLAP:
        i, j = longest_stretch(equal)
        return (j - i, -(a + i), int(equal[i:j].sum())) if j - i >= LEAST_OVERLAP else None
    least = SIMILAR if len(item) >= SHORT else 1
    return (len(item), -a, int(equal.sum())) if len(equal) == len(item) and equal.sum() >= least * len(item) - 1e-9 else None


class Seeds:
    """The seeds of benchmark items, and the search of a document for them."""

    def __init__(self, texts: list[str]) -> None:
        held = _Tokens()
        self.items = [held.of(t) for t in texts]
        hashes, owners, places = [], [], []
        used: dict[tuple[int, ...], None] = {}
        for i, tokens in enumerate(self.items):
            for mask in masks_of(len(tokens)):
                used[mask] = None
                h = seed_hashes(tokens, mask)
                hashes.append(h)
                owners.append(np.full(len(h), i))
                places.append(np.arange(len(h)))
        self.masks = list(used)
        h = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.owners = np.concatenate(owners)[order] if hashes else order
        self.places = np.concatenate(places)[order] if hashes else order
        self.may = np.zeros(1 << TABLE_BITS, dtype=bool)
        self.may[(self.hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def _hits(self, tokens: np.ndarray) -> set[tuple[int, int]]:
        """(item, where the item would begin in the document) of every seed hit."""
        found: set[tuple[int, int]] = set()
        for mask in self.masks:
            h = seed_hashes(tokens, mask)
            at = np.flatnonzero(self.may[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
            low, high = (np.searchsorted(self.hashes, h[at], side) for side in ("left", "right"))
            for a, i, j in zip(at[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist(), strict=True):
                found.update((int(o), a - int(p)) for o, p in zip(self.owners[i:j], self.places[i:j], strict=True))
        return found

    def search(self, tokens: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item's number, first token in the document, tokens, equal tokens) of the longest leak of each item."""
        best: dict[int, tuple[int, int, int]] = {}
        for owner, start in self._hits(tokens):
            if now := overlap(tokens, self.items[owner], start):
                best[owner] = max(best.get(owner, now), now)
        return [(k, -s, n, e) for k, (n, s, e) in sorted(best.items())]

    def leaks(self, tokens: np.ndarray) -> bool:
        return any(overlap(tokens, self.items[owner], start) for owner, start in self._hits(tokens))


LEAK = "item_id bigint, at_token bigint, n_tokens bigint, n_equal bigint, similarity double"
_NAMES = ["at_token", "n_tokens", "n_equal", "similarity"]


def _leak_columns(found: list[tuple[int, int, int]]) -> list[pa.Array]:
    at, n, equal = (np.array([x[i] for x in found], dtype=np.int64) for i in range(3))
    return [pa.array(at), pa.array(n), pa.array(equal), pa.array(equal / np.maximum(n, 1))]


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, text) of all distinct items that have a text."""
    return pick(benchmark, "item_id", "text").select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).where("text IS NOT NULL").distinct()


def _held(benchmark: DataFrame, broadcast_tokens: int):
    """The items' ids and the broadcast seeds, where there are few enough tokens; else None."""
    items = _items(benchmark)
    if (items.agg(F.sum(F.size(F.split("text", "\\s+")))).first()[0] or 0) > broadcast_tokens:
        return None
    rows = sorted(items.collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1]))  # broadcast_tokens tokens at most
    return [r[0] for r in rows], benchmark.sparkSession.sparkContext.broadcast(Seeds([r[1] for r in rows]))


def _rows(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """(doc_id, item_id, at_token, n_tokens, n_equal, similarity): a row for each document and item that it leaks."""
    held = _held(benchmark, broadcast_tokens)
    if held is None:
        return _joined(_rows(docs), benchmark).select("doc_id", *(c.split()[0] for c in LEAK.split(", ")))
    names, seeds = held

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens()
        for batch in batches:
            found = [(i, *leak) for i, t in enumerate(batch.column(1).to_pylist()) for leak in seeds.value.search(tokens.of(t))]
            row = pa.array([x[0] for x in found], type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array([names[x[1]] for x in found], type=pa.int64()), *_leak_columns([x[2:] for x in found])], names=["doc_id", "item_id", *_NAMES])

    return in_arrow(_rows(docs), search, f"doc_id bigint, {LEAK}")


def _batch(columns: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=names)


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens = _Tokens()
    for batch in batches:
        hashes, items, places = [], [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = tokens.of(text)
            for mask in masks_of(len(own)):
                h = seed_hashes(own, mask)
                hashes.append(h.view(np.int64))
                items.append(np.full(len(h), item, dtype=np.int64))
                places.append(np.arange(len(h), dtype=np.int32))
        if hashes:
            yield _batch([hashes, items, places], ["h", "item", "place"])


@cache
def _all_masks() -> list[tuple[int, ...]]:
    return list(dict.fromkeys(m for n in range(1, LEAST_OVERLAP + 1) for m in masks_of(n)))


def _joined(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The leaks of ``rows`` (doc_id, text), found by a join of the seeds as tables; with x, the XXH64 of the text.

    Equal rows are searched as one and come out as often as they are there.
    """
    spark = rows.sparkSession
    items = materialize(_items(benchmark).select(F.xxhash64(F.col("item_id").isNull(), "item_id", "text").alias("item"), "item_id", "text"), "items")
    seeds = materialize(in_arrow(items.select("item", "text"), _item_seeds, "h bigint, item bigint, place int"), "seeds")
    place = F.shiftrightunsigned("h", 64 - BITMAP_BITS)
    # 2**BITMAP_BITS bits, whatever the benchmark's size
    parts = seeds.groupBy(F.bitmap_bucket_number(place).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    bits = np.zeros((1 << BITMAP_BITS >> 3) + 4096, dtype=np.uint8)
    for r in parts:  # bucket 0 has position 0 alone; the others have 32,768 each, from 1 on
        own = np.frombuffer(r["bits"], dtype=np.uint8)
        at = max(0, r["n"] - 1) * len(own)
        bits[at : at + len(own)] |= own
    held = spark.sparkContext.broadcast(bits)

    def document_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, may = _Tokens(), held.value
        for batch in batches:
            row, hashes, places = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                own = tokens.of(text)
                for mask in _all_masks():
                    h = seed_hashes(own, mask)
                    bit = np.maximum((h >> np.uint64(64 - BITMAP_BITS)).astype(np.int64) - 1, 0)
                    at = np.flatnonzero(may[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                    row.append(np.full(len(at), i))
                    hashes.append(h[at].view(np.int64))
                    places.append(at.astype(np.int32))
            if row:
                of = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(np.concatenate(hashes)), pa.array(np.concatenate(places))], names=["doc_id", "x", "h", "at"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens()
        for batch in batches:
            starts, texts, own = (batch.column(c).to_pylist() for c in ("start", "text", "item_text"))
            found = [overlap(tokens.of(t), tokens.of(i), s) for t, i, s in zip(texts, own, starts, strict=True)]
            good = pa.array([f is not None for f in found], type=pa.bool_())
            kept = [(-f[1], f[0], f[2]) for f in found if f]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(good) for c in ("doc_id", "x", "copies", "item", "item_id")), *_leak_columns(kept)], names=["doc_id", "x", "copies", "item", "item_id", *_NAMES])

    told = rows.select("doc_id", F.xxhash64("text").alias("x"), "text").where("text IS NOT NULL")
    hits = in_arrow(told, document_seeds, "doc_id bigint, x bigint, h bigint, at int")
    near = materialize(hits.join(seeds, "h").select("doc_id", "x", "item", (F.col("at") - F.col("place")).alias("start")).distinct(), "hits")
    texts = told.groupBy(F.col("doc_id").alias("i"), F.col("x").alias("t")).agg(F.min("text").alias("text"), F.count("*").alias("copies"))
    both = near.join(texts, near["doc_id"].eqNullSafe(texts["i"]) & (near["x"] == texts["t"]))
    both = both.select("doc_id", "x", "copies", "item", "start", "text").join(items.select("item", "item_id", F.col("text").alias("item_text")), "item")
    found = in_arrow(both.select("doc_id", "x", "copies", "item", "item_id", "start", "text", "item_text"), verify, f"doc_id bigint, x bigint, copies bigint, item bigint, {LEAK}")
    best = F.max(F.struct("n_tokens", (-F.col("at_token")).alias("before"), "n_equal")).alias("best")
    longest = found.groupBy("doc_id", "x", "copies", "item", "item_id").agg(best).withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return longest.select("doc_id", "x", "item_id", (-F.col("best.before")).alias("at_token"), "best.n_tokens", "best.n_equal", (F.col("best.n_equal") / F.col("best.n_tokens")).alias("similarity"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """The rows of ``docs``, all columns, that leak no item of the benchmark."""
    held = _held(benchmark, broadcast_tokens)
    if held is None:
        leaks = materialize(_joined(_rows(docs), benchmark).select(F.col("doc_id").alias("leak_id"), "x").distinct(), "leaks")
        packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("bigint").alias("i"), F.xxhash64(F.col("text").cast("string")).alias("t"))
        return packed.join(leaks, packed["i"].eqNullSafe(leaks["leak_id"]) & (packed["t"] == leaks["x"]), "left_anti").select("row.*")
    seeds = held[1]

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens()
        for batch in batches:
            yield batch.filter(pa.array([not seeds.value.leaks(tokens.of(t)) for t in batch.column("text").to_pylist()], type=pa.bool_()))

    return in_arrow(docs, clean, docs.schema)


def op5_spaced_seed_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
