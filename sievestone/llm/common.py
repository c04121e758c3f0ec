"""What the operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..operators.tables import key_bounds, part_of
from ..scratch import discard, materialize, scratch_path
from ..session import BATCH_BYTES, short_batches

__all__ = ["discard", "in_arrow", "key_bounds", "materialize", "part_of", "pick", "runs", "scratch_path", "shuffle_width", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables under ``sf_dir``, which may be any path Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of the input never clash with ours."""
    return df.select(*[df[n] for n in names])


def _give_back() -> None:
    """Return a worker's free memory to the machine, as it waits for other tasks with all that it ever took."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def in_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``df.mapInArrow`` with batches bounded in bytes and not in rows alone, by a setting of the session."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        _give_back()

    short_batches(df.sparkSession, batch_bytes)
    return df.mapInArrow(run, schema)


def runs(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows (first, behind the last) of about ``most`` bytes of text, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b
