"""Writers: delimited tables, text lists, JSON documents and keyed checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", encoding: str = "UTF-8") -> None:
    """Many files, each with a header; quotes doubled, white space at the ends kept, an empty string quoted, null not."""
    df.write.mode(mode).options(header="true", quote='"', escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false", encoding=encoding).csv(path)


def export_csv(df: DataFrame, file: str) -> None:
    """One local file with a byte-order mark, row by row through the driver: for tables that a person opens."""
    import csv

    with open(file, "w", newline="", encoding="utf-8-sig") as out:
        writer = csv.writer(out)
        writer.writerow(df.columns)
        for row in df.toLocalIterator():
            writer.writerow(["" if v is None else v for v in row])


def append_rows(df: DataFrame, path: str) -> None:
    """Rows added to what is there: files by the commit protocol, never a rewrite."""
    df.write.mode("append").parquet(path)


def write_lines(df: DataFrame, path: str, column: str, order: bool = True) -> None:
    lines = df.select(F.col(column).cast("string").alias("value"))
    (lines.orderBy("value") if order else lines).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    """A JSON document a row, nested columns as they are."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def bundle(slices: DataFrame, keys: tuple[str, ...] = ("model", "provider", "task")) -> DataFrame:
    """(keys..., slices): the slices of each model as one nested document."""
    others = [c for c in slices.columns if c not in keys]
    return slices.groupBy(*keys).agg(F.collect_list(F.struct(*others)).alias("slices"))


def upsert(df: DataFrame, path: str, key: str, order: str) -> None:
    """Rows added under a version, so that ``latest`` finds the last of each key; nothing is rewritten."""
    append_rows(df.withColumn("_version", F.col(order)), path)


def latest(df: DataFrame, key: str) -> DataFrame:
    others = [c for c in df.columns if c not in (key, "_version")]
    return df.groupBy(key).agg(F.max_by(F.struct(*others), "_version").alias("_r")).select(key, "_r.*")


def write_version(df: DataFrame, path: str, version: int) -> None:
    """The table as a version of its own beside the earlier ones: nothing that is there is touched."""
    df.write.mode("error").parquet(f"{path.rstrip('/')}/version={version}")


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of a table, the highest if none is named."""
    rows = spark.read.parquet(path)
    chosen = version if version is not None else rows.agg(F.max("version")).first()[0]
    return rows.where(F.col("version") == chosen).drop("version")
