"""Operator 9: canonical exact digests, in DataFrame and SQL functions only.

Canonical form: Unicode compatibility normalisation, full case folding,
normalisation again, runs of white space to one blank, trimmed. (Spark has no
normalisation function of its own; its ``reflect`` SQL function calls the ICU
library that Spark ships for collations, inside the JVM.) Fingerprint: two
chained XXH64 of the canonical form, 128 bits. Rows are grouped by fingerprint
and canonical text, so equal hashes are told apart by their bytes; a further
text under a hash gets a fingerprint with its number after a dash. Rows find their
group again by hash and SHA-256.

Defined results: null text is empty, empty texts form one group; repeated rows
are ordered by text; null ids come last in descending order; with one row the
next document is the row itself; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import key_bounds, materialize, part_of, pick, shuffle_width, table

#: Parts of the id range for each shuffle partition, so that parts spread evenly.
PARTS_EACH = 4
NON_ASCII = "[^\\x00-\\x7F]"
BLANKS = "[\\s\\x1c-\\x1f\\x85\\p{Z}]+"


def canonical(text: Column) -> Column:
    """The canonical form of a text that isn't null."""
    icu = lambda kind, name, x: F.reflect(F.lit(f"com.ibm.icu.{kind}"), F.lit(name), x, F.lit(True))
    composed = lambda x: icu("text.Normalizer", "compose", x)
    folded = composed(icu("lang.UCharacter", "foldCase", composed(text)))
    # On ASCII the four steps come to lower().
    return F.trim(F.regexp_replace(F.when(text.rlike(NON_ASCII), folded).otherwise(F.lower(text)), BLANKS, " "))


def wide_hash(text: Column) -> Column:
    """32 hex digits: XXH64 with seed 42, and XXH64 seeded by that of a fixed word."""
    part = lambda h: F.lpad(F.hex(h), 16, "0")
    return F.lower(F.concat(part(F.xxhash64(text)), part(F.xxhash64(F.lit("wide"), text))))


def with_next(rows: DataFrame, key: str, carried: str, alias: str) -> DataFrame:
    """Add the ``carried`` string of the next row in descending order of ``key``; after the last comes the first.

    The id range is cut into parts of about equal counts, which are sorted each
    on its own: one shuffle of the texts. Each part also gets a copy of the row
    that follows its last. Only the bounds and each part's largest id, as many
    as there are parts, pass through the driver.
    """
    ids = rows.select(key)
    parts = PARTS_EACH * shuffle_width(rows.sparkSession)
    bounds = key_bounds(ids, key, parts)
    placed = ids.withColumn("_part", part_of(F.col(key), bounds))
    heads = sorted(placed.groupBy("_part").agg(F.max(key)).collect())
    if not heads:
        return rows.withColumn(alias, F.col(carried))
    spark = rows.sparkSession
    above = [heads[(i + 1) % len(heads)][0] for i in range(len(heads))]
    copies = spark.createDataFrame([(h[1], a) for h, a in zip(heads, above, strict=True)], f"_head {dict(rows.dtypes)[key]}, _above int")
    dealt = rows.withColumn("_part", part_of(F.col(key), bounds)).join(F.broadcast(copies), F.col(key).eqNullSafe(F.col("_head")), "left")
    dealt = dealt.drop("_head").withColumn("_to", F.explode(F.when(F.col("_above").isNull(), F.array(F.struct(F.col("_part").alias("p"), F.lit(False).alias("copy")))).otherwise(F.array(F.struct(F.col("_part").alias("p"), F.lit(False).alias("copy")), F.struct(F.col("_above").alias("p"), F.lit(True).alias("copy"))))))
    dealt = dealt.select(*rows.columns, F.col("_to.p").alias("_part"), F.col("_to.copy").alias("_copy"))
    order = W.partitionBy("_part").orderBy("_copy", F.col(key).desc_nulls_last(), carried)
    return dealt.withColumn(alias, F.lead(carried).over(order)).where("NOT _copy").select(*rows.columns, alias)


def group_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, check, nth, group_id, group_size): one row per distinct canonical text.

    Grouping on (bucket, canonical text) compares bytes inside equal buckets; it
    sums on the map side first, so a text that a third of all rows share
    reaches the shuffle once a task.
    """
    texts = pick(docs, key, text).select(key, canonical(F.coalesce(F.col(text), F.lit(""))).alias("_c"))
    groups = texts.groupBy(wide_hash(F.col("_c")).alias("bucket"), "_c").agg(F.min(key).alias("group_id"), F.count("*").alias("group_size"))
    groups = materialize(groups.select("bucket", F.sha2("_c", 256).alias("check"), "group_id", "group_size"), "groups")
    if groups.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return groups.withColumn("nth", F.lit(0))
    return groups.withColumn("nth", F.row_number().over(W.partitionBy("bucket").orderBy("check")) - 1)


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, group_id, group_size): equal canonical texts, and only they, share a fingerprint."""
    body = canonical(F.coalesce(F.col(text), F.lit("")))
    rows = pick(docs, key, text).select(key, body.alias("_c")).select(key, wide_hash(F.col("_c")).alias("bucket"), F.sha2("_c", 256).alias("check"))
    return _named(rows, group_texts(docs, key, text)).drop("bucket", "check")


def _name() -> Column:
    return F.when(F.col("nth") > 0, F.concat_ws("-", "bucket", "nth")).otherwise(F.col("bucket"))


def _named(rows: DataFrame, groups: DataFrame) -> DataFrame:
    return rows.join(groups, ["bucket", "check"]).withColumn("fingerprint", _name()).drop("nth")


def _names_of_others(others: DataFrame, groups: DataFrame) -> DataFrame:
    """(bucket, check, name) for texts (bucket, check) of which the groups needn't have any: numbers go on behind theirs."""
    known = groups.groupBy("bucket").agg((F.max("nth") + 1).alias("_from"))
    new = others.distinct().join(groups.select("bucket", "check"), ["bucket", "check"], "left_anti").join(known, "bucket", "left")
    rank = F.row_number().over(W.partitionBy("bucket").orderBy("check")) - 1
    new = new.withColumn("nth", rank + F.coalesce("_from", F.lit(0)))
    return groups.select("bucket", "check", "nth").union(new.select("bucket", "check", "nth")).select("bucket", "check", _name().alias("name"))


def op9_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    pairs = with_next(rows, "doc_id", "text", "next_text").select("doc_id", n.cast("bigint").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"), canonical(F.col("text")).alias("c"), canonical(edited).alias("e"), canonical(F.col("next_text")).alias("x"))
    digests = pairs.select(
        "doc_id", "n_chars", "edited_sha256",
        wide_hash(F.col("c")).alias("bucket"), F.sha2("c", 256).alias("check"), wide_hash(F.col("e")).alias("edited_bucket"), F.sha2("e", 256).alias("edited_check"),
        F.expr("c = e").cast("double").alias("near_edited"), F.expr("c = x").cast("double").alias("near_next"),
    )
    digests, groups = materialize(digests, "digests"), group_texts(docs)
    # A name stands for one canonical text, so equal texts and equal names are the same.
    others = _names_of_others(digests.select(F.col("edited_bucket").alias("bucket"), F.col("edited_check").alias("check")), groups)
    others = others.select(F.col("bucket").alias("edited_bucket"), F.col("check").alias("edited_check"), F.col("name").alias("edited_fingerprint"))
    named = _named(digests, groups).join(others, ["edited_bucket", "edited_check"])
    return named.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "group_id", "group_size")
