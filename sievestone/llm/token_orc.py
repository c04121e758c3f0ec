"""Operator 1: token ids as ORC files, and reading them back.

Documents are range-partitioned by id, encoded and written in order: one file a
partition, ids as ORC integers (run-length encoded), a row index every
``ROWS_INDEXED`` rows and a Bloom filter on the document id, so that a reader
takes stripes in parallel and skips those that can't hold the ids it wants.

Defined results: null text is empty and gives the end id alone; a null id sorts
first; rows repeated under one id follow one another; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import in_arrow, key_bounds, part_of, pick, scratch_path, shuffle_width, table
from .tokens import SEGMENT, default_path, encoder

ROWS_INDEXED = 1000
ORC = {"compression": "zstd", "orc.stripe.size": str(16 << 20), "orc.row.index.stride": str(ROWS_INDEXED), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
SCHEMA = "doc_id bigint, shard int, local_start bigint, n_tokens bigint, ids array<int>"


def write_token_files(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, drops_blanks: bool = False, plain_specials: bool = False) -> None:
    """Write ``docs`` (doc_id, text) as token ids to ORC files under ``path``, in ascending doc_id order.

    ``vocabulary`` names a public tokenizer or is a path of a tokenizer file.
    ``plain_specials``: strings of special tokens in a text are ordinary text.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary if "/" in vocabulary else default_path(vocabulary), drops_blanks, plain_specials)
        shard, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, row = batch.column(0), 0
            for rows, ids, lengths in enc.encode(batch.column(1)):
                ends = np.cumsum(lengths + 1)
                out = np.insert(ids, np.cumsum(lengths), end_id).astype(np.int32)
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(row, rows),
                        pa.array(np.full(rows, shard, dtype=np.int32)),
                        pa.array(start + offsets[:-1].astype(np.int64)),
                        pa.array(lengths + 1),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(out)),
                    ],
                    names=["doc_id", "shard", "local_start", "n_tokens", "ids"],
                )
                row += rows
                start += int(ends[-1])

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    # The ranges come from the ids alone, so that texts are read and shuffled once.
    bounds = key_bounds(rows.select("doc_id"), "doc_id", shuffle_width(docs.sparkSession))
    ordered = rows.repartitionById(len(bounds) + 1, part_of(F.col("doc_id"), bounds)).sortWithinPartitions("doc_id")
    in_arrow(ordered, encode, SCHEMA, SEGMENT).write.options(**ORC).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows: doc_id, shard, local_start, n_tokens, ids. Filters on doc_id reach the stripes."""
    return spark.read.schema(SCHEMA).orc(path)


def file_starts(files: DataFrame) -> DataFrame:
    """(shard, base): the ids in all files before. It has as many rows as there are files."""
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    return totals.select("shard", F.coalesce(before, F.lit(0)).alias("base"))


def with_starts(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``start``, the ids of all documents before, to rows that have shard and local_start."""
    return rows.join(F.broadcast(file_starts(files)), "shard").withColumn("start", F.col("base") + F.col("local_start"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        offsets = ids.offsets.to_numpy()
        values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<u4")
        crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        counts = np.diff(offsets).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(counts), pa.array(crc, type=pa.int64())], names=["doc_id", "shard", "local_start", "n_tokens", "ids_crc32"])


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path)
    files = read_token_files(spark, path)
    digests = in_arrow(files.select("doc_id", "shard", "local_start", "ids"), _digests, "doc_id bigint, shard int, local_start bigint, n_tokens bigint, ids_crc32 bigint")
    return with_starts(digests, files).select("doc_id", "start", "n_tokens", "ids_crc32")
