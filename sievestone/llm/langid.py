"""Operator 3: language identification by rank-order n-gram profiles.

After Cavnar and Trenkle, "N-Gram-Based Text Categorization" (1994): a profile
ranks the most frequent n-grams (1 to 3 letters, words padded by a blank); a
document goes to the language whose profile is nearest by the out-of-place
distance, the sum over the document's n-grams of how far their ranks differ,
or PROFILE for one that the profile lacks.

Defined results: null text or text without a letter is ``und`` with score 0;
equal counts rank by n-gram code; equal distances go to the first language in
order; without a learnable row every text is ``und``; repeated rows are scored
alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import in_arrow, pick, table

PROFILE = 300
#: Documents of each language, about, that profiles are learnt from.
LEARN_DOCS = 3000
#: Languages, the most frequent, that profiles are learnt of.
LANGUAGES = 1000
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the 1- to 3-grams of a text and their counts; 21 bits a letter, 0 between words."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    codes = np.where(_letters()[codes], codes, 0)
    codes = np.concatenate([[0], codes, [0]])
    codes = codes[(codes != 0) | (np.concatenate([[1], codes[:-1]]) != 0)]
    if len(codes) < 2 or not codes.any():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    three = (a | b << 21 | c << 42)[b != 0]
    two = codes[:-1] | codes[1:] << 21
    return np.unique(np.concatenate([codes[codes != 0], -two, three]), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The PROFILE most frequent codes, most frequent first."""
    if len(codes) > PROFILE:
        least = np.partition(counts, len(counts) - PROFILE)[len(counts) - PROFILE]
        kept = counts >= least
        codes, counts = codes[kept], counts[kept]
    return codes[np.lexsort((codes, -counts))][:PROFILE]


class Profiles:
    def __init__(self, grams: dict[str, list[int]]) -> None:
        self.languages = sorted(grams)
        self.sorted = []
        for name in self.languages:
            codes = np.array(grams[name], dtype=np.int64)
            order = np.argsort(codes)
            self.sorted.append((codes[order], order))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranked(*gram_counts(text)) if text and self.languages else []
        if not len(own):
            return UNKNOWN, 0.0
        at = np.arange(len(own))
        far = []
        for codes, ranks in self.sorted:
            i = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            far.append(int(np.where(codes[i] == own, np.abs(ranks[i] - at), PROFILE).sum()))
        best = int(np.argmin(far))
        others = [x for i, x in enumerate(far) if i != best]
        score = 1 - far[best] / min(others) if others and min(others) else float(not others)
        return self.languages[best], score


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by: dict[str, list] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(gram_counts(text))
        for lang, parts in by.items():
            codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(codes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), type=pa.string()), pa.array(codes), pa.array(counts)], names=["lang", "gram", "n"])


def learn_profiles(rows: DataFrame, learn_docs: int = LEARN_DOCS) -> Profiles:
    """From ``rows`` (doc_id, text, lang): about ``learn_docs`` of each of the ``LANGUAGES`` most frequent languages, chosen by a hash of doc_id."""
    known = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    shares = {r["lang"]: min(1.0, learn_docs / r["n"]) for r in counts.collect()}
    if not shares:
        return Profiles({})
    share = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])[F.col("lang")]
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)  # null for other languages
    counts = in_arrow(sample.select("lang", "text"), _count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    grams: dict[str, list[int]] = {}
    for r in counts.withColumn("rank", rank).where(F.col("rank") <= PROFILE).orderBy("lang", "rank").collect():  # languages x PROFILE rows
        grams.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(grams)


def identify(docs: DataFrame, profiles: Profiles, *kept: str, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``kept`` of ``docs``, the language of its text and the score under ``names``."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([x for x, _ in found], type=pa.string()), pa.array([s for _, s in found], type=pa.float64())], names=[*kept, *names])

    kinds = dict(docs.dtypes)
    columns = pick(docs, *dict.fromkeys([*kept, "text"]))
    return in_arrow(columns, predict, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), f"`{names[0]}` string", f"`{names[1]}` double"]))


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text modulo ``n`` (a null key counts as empty text)."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % n


def op3_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    profiles = learn_profiles(docs.where(~held_out).select("doc_id", "text", "lang"))
    return identify(docs, profiles, "doc_id").select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
