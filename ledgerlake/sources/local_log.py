"""A durable log of topics on Parquet: contiguous offsets, checksummed bodies, cursors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.storage import staged

#: Longest body of a message, in bytes.
LONGEST = 128 << 20


def frame(messages: DataFrame, depths: DataFrame | None = None) -> DataFrame:
    """messages (topic, key, body, seq) with offsets that go on from each topic's depth, and the body's crc32.

    Bodies over LONGEST are an error. Messages are dealt by ranges of (topic, seq) and staged, so a topic, however large, is
    spread over tasks; an offset is the rank in a range plus the counts of the ranges before, which are small.
    """
    dealt = messages.repartitionByRange("topic", "seq").withColumn("_part", F.spark_partition_id())
    rows = staged(dealt, "ranges")
    counts = rows.groupBy("topic", "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("topic").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("topic", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("topic", "_part").orderBy("seq")) - 1 + F.col("_before")
    rows = rows.join(counts, ["topic", "_part"])
    rows = rows if depths is None else rows.join(depths, "topic", "left")
    base = F.lit(0) if depths is None else F.coalesce("depth", F.lit(0))
    body = F.when(F.octet_length("body") > LONGEST, F.raise_error(F.lit("message body over the limit")).cast("string")).otherwise(F.col("body"))
    return rows.select("topic", (base + at).cast("long").alias("offset"), "key", body.alias("body"), F.crc32(F.col("body").cast("binary")).alias("crc"))


def publish(messages: DataFrame, path: str, depths: DataFrame | None = None) -> None:
    frame(messages, depths).write.mode("append").partitionBy("topic").parquet(path)


def depths(log: DataFrame) -> DataFrame:
    return log.groupBy("topic").agg((F.max("offset") + 1).alias("depth"))


def consume(log: DataFrame, cursors: DataFrame) -> DataFrame:
    """Messages past each topic's cursor, all of a topic without one."""
    return log.join(cursors, "topic", "left").where("cursor IS NULL OR offset > cursor").drop("cursor")


def damage(log: DataFrame) -> DataFrame:
    """Messages whose body doesn't have its checksum, and offsets that follow a gap: what recovery would cut off.

    An offset looks for the one before it by a join on both, so a large topic is spread over tasks.
    """
    before = log.select("topic", (F.col("offset") + 1).alias("offset")).distinct().withColumn("_follows", F.lit(True))
    rows = log.join(before, ["topic", "offset"], "left")
    code = F.when(F.crc32(F.col("body").cast("binary")) != F.col("crc"), "checksum").when((F.col("offset") != 0) & F.col("_follows").isNull(), "gap")
    return rows.withColumn("damage", code).where("damage IS NOT NULL").select("topic", "offset", "damage")
