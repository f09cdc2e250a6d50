"""Sharding by weighted rendezvous hashing. DataFrame functions only.

Every (record key, shard) pair has a fixed number in (0, 1]; a record goes to the shard with the smallest
`-ln(number) / weight`. A shard's score for a record does not depend on the other shards, so a new shard only takes
records into itself and a removed one only gives its own away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barwright.llm.tables import written


def hash52(*parts: Column) -> Column:
    """The first 13 hexadecimal digits of an MD5, as a number below 2**52."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("long")


def score(key: Column, shard: int, weight: float, equal: bool) -> Column:
    """Smallest wins. With equal weights the order of the hashes alone decides, without logarithms."""
    h = hash52(key, F.lit(str(shard)))
    return -h if equal else -F.log((h + 1).cast("double") / F.lit(float(2**52))) / F.lit(float(weight))


def shard_of(key: Column, weights: list[float]) -> Column:
    """The winning (score, shard) of a record key. Shards of weight 0 get nothing; ties go to the lower shard."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be nonnegative, with one above 0")
    equal = len({*weights}) == 1
    all_ = [F.struct(score(key, k, w, equal).alias("score"), F.lit(k).alias("shard")) for k, w in enumerate(weights) if w > 0]
    return F.least(*all_) if len(all_) > 1 else all_[0]


def record_key(column: Column) -> Column:
    """A key as text; null is a key of its own, and so are rows without one: they share a shard."""
    return F.coalesce(column.cast("string"), F.lit("null"))


def shard_documents(docs: DataFrame, weights: list[float], *, grown_by: float | None = 1.0, bucket_rows: int = 50_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; one row for each input row, repeated rows included.

    `slot` numbers the rows of a shard from 0 without gaps, in the order of a hash of (doc_id, size, crc). Equal rows
    are counted before the shuffle and expanded after it, so no group of copies meets in one task. Numbering runs inside
    hash ranges of a shard (about `bucket_rows` distinct rows each), shifted by the counts of the ranges before.
    Null text: size 8 and crc 0. Empty table: no rows.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    grouped = written(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies")), "rows")
    ranges = max(1, -(-grouped.count() // (bucket_rows * len(weights))))
    key = record_key(F.col("doc_id"))
    placed = grouped.select(
        "*", shard_of(key, weights).alias("best"),
        hash52(key, F.col("size"), F.col("text_crc32")).alias("place"),
    )
    if grown_by:
        equal = len({*weights}) == 1
        if equal and grown_by != weights[0]:
            raise ValueError("a shard added to equal ones must have their weight")
        new = score(key, len(weights), grown_by, equal)
        grown = F.when(new < F.col("best.score"), F.lit(len(weights))).otherwise(F.col("best.shard"))
    else:
        grown = F.lit(None).cast("int")
    placed = placed.select(
        "doc_id", "size", "text_crc32", "copies", "place", F.col("best.shard").alias("shard"), grown.alias("grown_shard"),
        (F.col("place") / F.lit(2**52 / ranges)).cast("int").alias("range"),
    )
    counts = placed.groupBy("shard", "range").agg(F.sum("copies").alias("n"))
    before = W.partitionBy("shard").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = W.partitionBy("shard", "range").orderBy("place", "doc_id", "size", "text_crc32")
    inside = order.rowsBetween(W.unboundedPreceding, -1)
    return (
        placed.withColumn("inside", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
        .join(counts, ["shard", "range"])
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
            (F.col("base") + F.col("inside") + F.col("copy")).cast("long").alias("slot"),
            F.col("grown_shard").cast("int").alias("grown_shard"),
        )
    )


SHARDS = 24
