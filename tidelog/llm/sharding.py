"""Sharding by weighted rendezvous hashing of stable record keys, in DataFrame functions alone.

Every (key, shard) pair gets a uniform number u from 52 bits of an MD5 digest
and the score ``-weight / ln(u)``; a record goes to the shard of its highest
score (the lowest shard on a tie). The key and the shards' weights alone decide,
so a further shard only takes records into itself, about its share of them.

Slots number a shard's records from 0 without gaps. Records that agree in all
columns that count are first folded into one row with their number, so neither
a repeated record nor a shard of any size meets in one task: a shard is cut into
a fixed number of buckets, each bucket is numbered by itself, and the buckets'
sums give where each begins.

Edge cases: a null key is a key of its own; a null text has no bytes and CRC-32
0; equal records get adjoining slots; an empty table gives an empty result;
further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Buckets in which each shard is numbered; bounds the table of bucket sums at buckets x shards rows.
BUCKETS = 1024


def uniform(key: F.Column, shard: int) -> F.Column:
    """A number in (0, 1) from 52 bits of the MD5 digest of key and shard."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def rendezvous(key: F.Column, weights: Sequence[float]) -> F.Column:
    """The shard of a key among shards 0 to len(weights) - 1; a null key counts as a key of its own.

    Equal weights need no logarithm: the score grows with u.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one for each shard")
    key = F.coalesce(key.cast("string"), F.lit("\x00null"))
    equal = len(set(weights)) == 1
    scored = [
        F.struct((uniform(key, i) if equal else F.lit(-float(w)) / F.log(uniform(key, i))).alias("s"), F.lit(-i).alias("i"))
        for i, w in enumerate(weights)
    ]
    best = F.greatest(*scored) if len(scored) > 1 else scored[0]
    return (-best["i"]).cast("int")


def shard_records(docs: DataFrame, key: str, text: str, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """Shard and slot of every record; grown: the weights of a later, larger set of shards."""
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(key).alias("key"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    same = ["key", "size", "text_crc32"]
    folded = narrow.groupBy(*same).agg(F.count(F.lit(1)).alias("n"))
    placed = folded.withColumn("shard", rendezvous(F.col("key"), weights))
    spelled = F.concat(F.coalesce(F.col("key").cast("string"), F.lit("\x00null")), F.lit(":"), F.col("size"), F.lit(":"), F.col("text_crc32"))
    digits = F.substring(F.md5(spelled.cast("binary")), 1, 6)
    placed = placed.withColumn("bucket", F.conv(digits, 16, 10).cast("int") % BUCKETS)
    sums = placed.groupBy("shard", "bucket").agg(F.sum("n").alias("m"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("shard", "bucket", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy(*same).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("ahead", F.coalesce(F.sum("n").over(within), F.lit(0)))
    # starts has at most BUCKETS rows a shard, whatever the input
    first = F.col("start") + F.col("ahead")
    grown_shard = rendezvous(F.col("key"), grown) if grown else F.lit(None).cast("int")
    return placed.join(F.broadcast(starts), ["shard", "bucket"]).select(
        F.col("key").alias(key),
        "size",
        "text_crc32",
        "shard",
        F.explode(F.sequence(first, first + F.col("n") - 1)).alias("slot"),
        grown_shard.alias("grown_shard"),
    )


def op3_rendezvous_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents over shards 0 to 7 under the law ``key``, and their shards once there are nine."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shard_records(docs, "doc_id", "text", [1.0] * 8, [1.0] * 9)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def oracle() -> str:
    """The same in DuckDB; CRC-32 goes byte by byte through its table."""
    score = "('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0) || 'null') || ':' || s), 1, 13))::BIGINT"
    return f"""
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM range(256) r(i))),
raw AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
crcs AS (
  SELECT doc_id, octet_length(encode(text)) + 1 AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(encode(text)) + 1), lambda i: ('0x' || hex(encode(text))[2 * i - 1 : 2 * i])::BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM raw, crc_table),
numbered AS (SELECT *, row_number() OVER () AS rid FROM crcs),
scores AS (SELECT rid, s, {score} AS score FROM numbered, range(9) r(s)),
chosen AS (
  SELECT rid, arg_max(s, score) FILTER (s < 8) AS shard, arg_max(s, score) AS grown_shard FROM scores GROUP BY rid),
placed AS (
  SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0) || 'null') || ':' || size || ':' || text_crc32), 1, 6))::BIGINT % {BUCKETS} AS bucket
  FROM numbered JOIN chosen USING (rid))
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard::INT AS grown_shard
FROM placed
"""
