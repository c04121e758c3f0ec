"""A corpus from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir), docs being what the stage before kept,
written as Parquet and read again. All but the last return the columns of
``documents``, whatever they are called. Null and empty texts are scored as
empty, repeated rows alike (near_dedup keeps one of them), and an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievestone.llm.common import discard, materialize, table
from sievestone.llm.decontaminate import without_leaks
from sievestone.llm.langid import UNKNOWN, identify, learn_profiles
from sievestone.llm.packing import pack_documents
from sievestone.llm.quality import learn_quality, score_quality
from sievestone.llm.similar import near_copies

#: Lead over the next language from which a prediction overrules the declared language.
SURE = 0.25


def unused(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, each with as many _ behind it as it takes to differ from all columns."""
    return tuple(next(n + "_" * i for i in range(len(docs.columns) + 1) if n + "_" * i not in docs.columns) for n in names)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be label 1; it learns from all labels.

    A score of just the threshold counts as label 1; without labels of both kinds all documents stay.
    """
    ranker = learn_quality(docs, table(spark, sf_dir, "labels"), lambda doc_id: F.lit(True))
    names = unused(docs, "score", "predicted")
    return score_quality(docs, ranker, *docs.columns, names=names).where(F.col(names[1]) == 1).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, save those whose text surely is in another one than they declare.

    Text without a letter has no known language; a null declaration contradicts none.
    """
    names = unused(docs, "found", "lead")
    found = identify(docs, learn_profiles(docs.select("doc_id", "text", "lang")), *docs.columns, names=names)
    agrees = F.col("lang").isNull() | (F.col("lang") == F.col(names[0])) | (F.col(names[1]) < SURE)
    return found.where((F.col(names[0]) != UNKNOWN) & agrees).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least doc_id.

    Of rows with one id and text one stays. A null id yields to any other; rows
    of a group without any id stay, one for each text.
    """
    first = near_copies(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "text_id").distinct()
    key = lambda text_id: (F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("doc_id").isNull().alias("none"), text_id.alias("t"))
    # The rows packed, so that no name of theirs clashes; one shuffle serves the join and the repeated rows.
    packed = docs.select(F.struct(*docs.columns).alias("row"), *key(F.xxhash64(F.coalesce("text", F.lit("")))))
    return packed.join(first.select(*key(F.col("text_id"))), ["i", "none", "t"], "left_semi").dropDuplicates(["i", "none", "t"]).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 token ids."""
    return pack_documents(docs, lean=True)


STAGES = [("quality", quality), ("language", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again; those that the next one has read go."""
    docs, done = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        discard(*done)
        done = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
