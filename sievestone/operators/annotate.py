"""Expensive per-row work (model calls, fetches, generation) over pending rows, resumable by key."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import short_batches
from .tables import pending


class Annotator(Protocol):
    """Takes a batch of texts and gives a value for each; a failed row is None. Made once in each task."""

    def __call__(self, texts: list[str]) -> list[str | None]: ...


def linear_backoff(base: float) -> Callable[[int], float]:
    return lambda attempt: base * attempt


def exponential_backoff(base: float, jitter: float = 1.0) -> Callable[[int], float]:
    return lambda attempt: base * 2 ** (attempt - 1) + random.uniform(0, jitter)


class GiveUp(Exception):
    """Raised by a call that mustn't be tried again, such as a page that is gone."""


def with_retries(call: Callable, attempts: int = 4, wait: Callable[[int], float] = linear_backoff(5), sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call``, tried again after a failure; None in the end, and at once after GiveUp."""

    def tried(x):
        for attempt in range(1, attempts + 1):
            try:
                return call(x)
            except GiveUp:
                return None
            except Exception:  # a call may fail in any way; what fails for good is left pending
                if attempt < attempts:
                    sleep(wait(attempt))
        return None

    return tried


def with_fallback(batch: Callable[[list], list], single: Callable | None = None) -> Callable[[list], list]:
    """``batch``; if it fails, its rows one by one, and "" for a row that fails alone."""

    def run(xs: list) -> list:
        try:
            return batch(xs)
        except Exception:
            one = with_retries(single or (lambda x: batch([x])[0]), attempts=1)
            return [y if (y := one(x)) is not None else "" for x in xs]

    return run


def annotate(rows: DataFrame, make: Callable[[], Annotator], text: str, out: str, batch: int = 4, max_seconds: float = 0, out_type: T.DataType | None = None) -> DataFrame:
    """``rows`` with ``out`` for every row, in batches within each task; past ``max_seconds`` no batch starts and the rest is null.

    The number of partitions is the number of calls at a time; a lost task is run again.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, began = make(), time.monotonic()
        for pdf in frames:
            values: list = []
            texts = pdf[text].tolist()
            for i in range(0, len(texts), batch):
                late = max_seconds and time.monotonic() - began > max_seconds
                part = texts[i : i + batch]
                values += [None] * len(part) if late else own(part)
            yield pdf.assign(**{out: pd.Series(values, index=pdf.index, dtype=object)})

    short_batches(rows.sparkSession)
    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField(out, out_type or T.StringType())]))


def read_checkpoint(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The checkpoint's rows; none if there isn't one yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return spark.createDataFrame([], schema)
        raise


def annotate_pending(rows: DataFrame, path: str, key: str, make: Callable[[], Annotator], text: str, out: str = "reply", batch: int = 4, max_seconds: float = 0) -> DataFrame:
    """Annotate what the checkpoint at ``path`` lacks, append what succeeded, and return the checkpoint.

    Each pass appends files by the commit protocol: no rewrite, nothing half-written.
    """
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[key]
    schema = f"{key} {kind}, {out} string"
    todo = pending(rows, read_checkpoint(spark, path, schema), key)
    done = annotate(todo.select(key, text), make, text, out, batch, max_seconds).where(F.col(out).isNotNull())
    done.select(key, out).write.mode("append").parquet(path)
    return read_checkpoint(spark, path, schema)


def passes(run: Callable[[], int], expected: int, most: int = 300) -> int:
    """Run passes until ``run`` tells that ``expected`` rows are there, or ``most`` times; how many it took."""
    for n in range(1, most + 1):
        if run() >= expected:
            return n
    return most


def crawl(listing: Callable[[int], DataFrame], empty_pages: int = 3, most_pages: int = 10_000) -> Iterator[DataFrame]:
    """Listing pages one after another, until ``empty_pages`` in a row give nothing new."""
    empty, seen = 0, None
    for page in range(1, most_pages + 1):
        found = listing(page)
        new = found if seen is None else found.join(seen, found.columns[0], "left_anti")
        if new.isEmpty():
            empty += 1
            if empty >= empty_pages:
                return
            continue
        empty, seen = 0, new if seen is None else seen.union(new)
        yield new


def stub_annotator() -> Annotator:
    """A deterministic stand-in for a model: a sentiment from the parity of the text's length."""
    return lambda texts: [None if t is None else '{"sentiment": "%s"}' % ("Positive" if len(t) % 2 else "Negative") for t in texts]


def fetcher(get: Callable[[str], str], attempts: int = 3, wait: Callable[[int], float] = linear_backoff(1)) -> Callable[[], Annotator]:
    """Makes an annotator that fetches addresses by ``get``; a page that is gone raises GiveUp there."""
    return lambda: lambda urls: [with_retries(get, attempts, wait)(u) for u in urls]
