"""Operator 2: jump consistent hashing of stable keys to shards, in DataFrame functions only.

The jump hash (Lamping and Veach, "A fast, minimal memory, consistent hash
algorithm", 2014) walks a linear congruential sequence seeded by the key; the
last jump below the shard count is the shard. Appending a shard moves 1/(n+1)
of the keys, all of them into the new shard, and needs no ring table.

Defined results: null keys hash as 0; repeated rows each get a slot of their
own; null text counts as empty (size 1, crc 0); an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, pick, shuffle_width, table

# Fixed values of the published algorithm: the multiplier of its generator.
MULTIPLIER = 2862933555777941757
#: Steps that nearly every key needs at most; keys that need more take the exact long walk.
SHORT_WALK = 24


def _next(key: Column) -> Column:
    """key * MULTIPLIER + 1 modulo 2**64, in limbs of 22, 22 and 20 bits that never overflow."""
    low, top = (1 << 22) - 1, (1 << 20) - 1
    a0, a1, a2 = MULTIPLIER & low, MULTIPLIER >> 22 & low, MULTIPLIER >> 44
    k0 = key.bitwiseAND(F.lit(low))
    k1 = F.shiftrightunsigned(key, 22).bitwiseAND(F.lit(low))
    k2 = F.shiftrightunsigned(key, 44)
    cross = k0 * a1 + k1 * a0
    lower = k0 * a0 + 1 + F.shiftleft(cross.bitwiseAND(F.lit(low)), 22)
    upper = F.shiftright(cross, 22) + k0 * a2 + k1 * a1 + k2 * a0 + F.shiftright(lower, 44)
    return F.shiftleft(upper.bitwiseAND(F.lit(top)), 44).bitwiseOR(lower.bitwiseAND(F.lit((1 << 44) - 1)))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to ``shards`` - 1, of a BIGINT key (a null key counts as 0)."""

    def state(k: Column, b: Column, j: Column) -> Column:
        return F.struct(k.alias("k"), b.alias("b"), j.alias("j"))

    def step(s: Column, _: Column) -> Column:
        k = _next(s["k"])
        j = ((s["j"] + 1).cast("double") * (float(1 << 31) / (F.shiftrightunsigned(k, 33) + 1).cast("double"))).cast("bigint")
        return F.when(s["j"] < shards, state(k, s["j"], j)).otherwise(s)

    def walk(start: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)

    start = state(F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint")), F.lit(-1).cast("bigint"), F.lit(0).cast("bigint"))
    short = walk(start, min(shards, SHORT_WALK))
    if shards <= SHORT_WALK:  # every jump moves on by one shard at least
        return short["b"].cast("int")
    return F.when(short["j"] >= shards, short["b"]).otherwise(walk(start, shards)["b"]).cast("int")


def stable_key(column: Column, kind: str) -> Column:
    """Whole numbers are keys as they are; anything else is hashed to 64 bits first."""
    return column.cast("bigint") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(column.cast("string"))


def number_in_shards(rows: DataFrame, shard: str, order: str, slot: str) -> DataFrame:
    """Add ``slot``: 0, 1, 2, ... within each shard in the order of ``order``.

    A range shuffle by (shard, order) lays the shards out one after another over
    many partitions, so no shard has to fit a task. What a row's place in its
    partition lacks to its slot depends on (partition, shard) alone; that table
    has at most partitions + shards rows.
    """
    spark = rows.sparkSession
    laid = rows.repartitionByRange(max(8, shuffle_width(spark)), shard, order).sortWithinPartitions(shard, order)
    place = F.monotonically_increasing_id()
    laid = materialize(laid.withColumn("_part", F.shiftright(place, 33)).withColumn("_at", place.bitwiseAND(F.lit((1 << 33) - 1))), "laid")
    held = laid.groupBy("_part", shard).agg(F.count("*").alias("_n"))
    by_part = W.partitionBy("_part").orderBy(shard).rowsBetween(W.unboundedPreceding, -1)
    by_shard = W.partitionBy(shard).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    base = held.select("_part", shard, (F.coalesce(F.sum("_n").over(by_shard), zero) - F.coalesce(F.sum("_n").over(by_part), zero)).alias("_base"))
    # Bounded by partitions + shards, never by the rows: safe to broadcast.
    return laid.join(F.broadcast(base), ["_part", shard]).withColumn(slot, F.col("_at") + F.col("_base")).drop("_part", "_at", "_base")


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot and grown_shard."""
    kind = dict(docs.dtypes)[key]
    rows = pick(docs, key, text)
    hashed = stable_key(F.col(key), kind)
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    digest = rows.select(
        key,
        (F.octet_length(body).cast("bigint") + 1).alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_hash(hashed, shards).alias("shard"),
        jump_hash(hashed, shards + 1).alias("grown_shard"),
    )
    # Kept once without the texts, so that the range shuffle's sampling doesn't read them again.
    numbered = number_in_shards(materialize(digest, "shards"), "shard", key, "slot")
    return numbered.select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op2_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), 16)


OP2_SQL = f"""
WITH RECURSIVE bits(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS v FROM bits WHERE k = 8),
sized AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
), digest AS (
  SELECT doc_id, octet_length(b) + 1 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(b), '..'), lambda p: ('0x' || p)::BIGINT)),
        lambda c, y: xor(c // 256, v[(xor(c, y) % 256 + 1)::INT]::BIGINT)), 4294967295::BIGINT) AS text_crc32
  FROM sized, crc_table
), walk(doc_id, n, k, b, j) AS (
  SELECT doc_id, n, ((coalesce(doc_id, 0)::HUGEINT + 18446744073709551616) % 18446744073709551616)::HUGEINT, -1::BIGINT, 0::BIGINT
  FROM documents, (VALUES (16), (17)) v(n)
  UNION ALL
  SELECT doc_id, n, k2, j, trunc((j + 1)::DOUBLE * (2147483648::DOUBLE / ((k2 // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, (k * {MULTIPLIER}::HUGEINT + 1) % 18446744073709551616 AS k2 FROM walk WHERE j < n)
), placed AS (
  SELECT a.doc_id, a.b::INT AS shard, c.b::INT AS grown_shard
  FROM walk a JOIN walk c ON a.doc_id = c.doc_id AND a.n = 16 AND c.n = 17 AND a.j >= 16 AND c.j >= 17
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard
FROM digest JOIN placed USING (doc_id)
"""
