"""Incremental jobs on Structured Streaming: annotation of new rows, first-seen deduplication, windowed counts.

The reference behaviour has no event time; the windowed counts are an addition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..operators.annotate import Annotator, annotate_pending


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_a_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def annotate_stream(rows: DataFrame, checkpoint: str, out: str, key: str, make: Callable[[], Annotator], text: str) -> StreamingQuery:
    """Annotates each micro-batch's rows that ``out`` lacks: a batch that is run again adds nothing twice."""

    def batch(df: DataFrame, _: int) -> None:
        annotate_pending(df.dropDuplicates([key]), out, key, make, text)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(rows: DataFrame, text: str, event_time: str, late: str = "1 day") -> DataFrame:
    """The first arrival of each folded prefix within the watermark."""
    return rows.withColumn("_key", X.folded_prefix_key(text)).withWatermark(event_time, late).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def windowed_counts(events: DataFrame, event_time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(event_time, late).groupBy(F.window(event_time, width), key).agg(F.count("*").alias("n"))


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
