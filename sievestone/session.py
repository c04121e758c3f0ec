"""A session with the engine's defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


#: Bytes in an Arrow batch that goes to a Python worker, about: long texts make short batches.
BATCH_BYTES = 2 << 20


def short_batches(spark: SparkSession | None = None, batch_bytes: int = BATCH_BYTES) -> None:
    """Bound Arrow batches in bytes and not in rows alone, by a setting of the session: 10,000 long texts are too many at once."""
    if spark := spark or SparkSession.getActiveSession():
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))


def session(name: str = "sievestone", **conf: str) -> SparkSession:
    """UTC, ANSI, adaptive execution and Arrow; ``conf`` overrides (underscores stand for dots)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()
