"""Source and target by canonical row hashes: drift reports, checksums and reseeding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions import hashing, lsn, names

SAMPLE = 20


def row_image(columns: list[str]) -> Column:
    """name=value with a zero byte after each, in name order; <NULL> for null. No Python for flat rows."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("<NULL>")), F.lit("\0")) for c in sorted(columns)]
    return F.concat(*parts) if parts else F.lit("")


def snapshot(table: DataFrame, key: str, excluded: tuple[str, ...] = (), where: Column | None = None) -> DataFrame:
    """(pk, row_hash) of a table; excluded columns and rows outside the filter never leave the scan."""
    rows = table if where is None else table.where(F.coalesce(where, F.lit(False)))
    columns = [c for c in table.columns if c not in excluded]
    return rows.select(F.col(key).cast("string").alias("pk"), hashing.md5_60(row_image(columns)).alias("row_hash"))


def table_checksum(snapshot: DataFrame) -> DataFrame:
    """Row count, XOR and sum of key-bound row hashes: the same in any order, so it needs no sort at any size."""
    bound = hashing.md5_60(F.concat_ws("|", "pk", F.col("row_hash").cast("string")))
    return snapshot.select(bound.alias("h")).agg(F.count("*").alias("row_count"), F.bit_xor("h").alias("xor_hash"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("sum_hash"))


def drift_rows(source: DataFrame, target: DataFrame) -> DataFrame:
    """(pk, drift) of missing, extra and mismatched rows: one full outer join, equal rows dropped."""
    joined = source.select("pk", F.col("row_hash").alias("s")).join(target.select("pk", F.col("row_hash").alias("t")), "pk", "full_outer")
    drift = F.when(F.col("t").isNull(), "missing").when(F.col("s").isNull(), "extra").when(F.col("s") != F.col("t"), "mismatched")
    return joined.select("pk", drift.alias("drift")).where("drift IS NOT NULL")


def compare(source: DataFrame, target: DataFrame, source_lsn: str, target_lsn: str) -> DataFrame:
    """One row: counts of each drift, whether the target's watermark reaches the source's, and whether both converged."""
    joined = source.select("pk", F.col("row_hash").alias("s")).join(target.select("pk", F.col("row_hash").alias("t")), "pk", "full_outer")
    out = joined.agg(
        F.count("s").alias("source_rows"), F.count("t").alias("target_rows"), F.count_if(F.col("t").isNull()).alias("missing"), F.count_if(F.col("s").isNull()).alias("extra"),
        F.count_if(F.col("s") != F.col("t")).alias("mismatched"),
    )
    reached = F.coalesce(lsn.parse(F.lit(target_lsn)) >= lsn.parse(F.lit(source_lsn)), F.lit(False))
    out = out.withColumn("watermark_reached", reached)
    converged = (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("mismatched") == 0) & F.col("watermark_reached")
    digest = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("source_rows", "target_rows", "missing", "extra", "mismatched")], F.lit(source_lsn), F.lit(target_lsn)), 256)
    return out.withColumn("converged", converged).withColumn("evidence_sha256", digest)


def drift_sample(drift: DataFrame, k: int = SAMPLE) -> DataFrame:
    """The first k keys of each drift in byte order. A top-k report: the rank's filter becomes a limit of k rows a group in
    every task before the shuffle, so no task gets a whole group."""
    at = F.row_number().over(Window.partitionBy("drift").orderBy("pk"))
    return drift.withColumn("position", at).where(F.col("position") <= k)


def reseed(source: DataFrame, target: DataFrame, where: Column, columns: list[str]) -> DataFrame:
    """target with the rows of the filter replaced by the source's; rows for which it is null stay, as SQL's delete leaves them."""
    keep = target.where(~F.coalesce(where, F.lit(False)))
    return keep.unionByName(source.where(F.coalesce(where, F.lit(False))).select(*columns), allowMissingColumns=True)


def fan_in_compare(stream: DataFrame, lake: DataFrame, keys: list[str], fields: list[str], warnings: tuple[str, ...] = ("duplicate_replay_count",)) -> DataFrame:
    """Fields that differ between stream and lake summaries of the same keys, nulls equal to nulls, with a severity."""
    s = stream.select(*keys, F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))]).alias("s"))
    t = lake.select(*keys, F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))]).alias("t"))
    rows = s.join(t, keys, "full_outer").select(*keys, F.explode(F.array(*map(F.lit, fields))).alias("field"), "s", "t")
    rows = rows.select(*keys, "field", F.col("s")[F.col("field")].alias("stream_value"), F.col("t")[F.col("field")].alias("lake_value"))
    return rows.where(~F.col("stream_value").eqNullSafe(F.col("lake_value"))).withColumn("severity", F.when(F.col("field").isin(*warnings), "warning").otherwise("blocker"))


def consistency_violations(epochs: DataFrame, sources: DataFrame, partitions: DataFrame) -> DataFrame:
    """(epoch_id, violation, subject) of an epoch summary against itself, before it is compared with another.

    epochs: epoch_id, state and source counts; sources: epoch_id, source_id, state, commit_lsn; partitions: epoch_id,
    source_id, partition_id, first_lsn, last_lsn.
    """
    c = F.col
    counts = c("complete_source_count") + c("missing_source_count") + c("quarantined_source_count")
    per = sources.groupBy("epoch_id").agg(
        F.count("*").alias("n"), F.count_if(c("state") == "complete").alias("s_complete"), F.count_if(c("state").isin("missing", "lagging")).alias("s_missing"), F.count_if(c("state") == "quarantined").alias("s_quarantined")
    )
    zero = lambda x: F.coalesce(x, F.lit(0))
    rows = epochs.join(per, "epoch_id", "left")
    clean = (c("missing_source_count") == 0) & (c("quarantined_source_count") == 0) & (c("complete_source_count") == c("required_source_count"))
    state = (
        F.when(c("state") == "complete", clean).when(c("state") == "complete_with_gaps", (c("missing_source_count") > 0) & (c("quarantined_source_count") == 0)).when(c("state") == "quarantined", c("quarantined_source_count") > 0).otherwise(True)
    )
    rollup = (zero("s_complete") == c("complete_source_count")) & (zero("s_missing") == c("missing_source_count")) & (zero("s_quarantined") == c("quarantined_source_count"))
    codes = F.array_compact(F.array(
        F.when(counts != c("required_source_count"), F.lit("source_counts")), F.when(zero("n") != c("required_source_count"), F.lit("source_rows")), F.when(~rollup, F.lit("source_rollup")), F.when(~state, F.lit("state")),
    ))
    head = rows.select("epoch_id", F.explode(codes).alias("violation"), F.lit("").alias("subject"))
    bad_lsn = sources.where(c("commit_lsn").isNotNull() & ~F.coalesce(lsn.parse(c("commit_lsn")) > 0, F.lit(False))).select("epoch_id", F.lit("source_lsn").alias("violation"), c("source_id").alias("subject"))
    name = F.concat_ws(":", "source_id", c("partition_id").cast("string"))
    first, last = lsn.parse(c("first_lsn")), lsn.parse(c("last_lsn"))
    window = F.coalesce((first > 0) & (first <= last), F.lit(False))
    each = F.array_compact(F.array(F.when(~names.clean(c("source_id")), F.lit("partition_source")), F.when(~window, F.lit("partition_window"))))
    of_partitions = partitions.select("epoch_id", F.explode(each).alias("violation"), name.alias("subject"))
    twice = partitions.groupBy("epoch_id", "source_id", "partition_id").count().where("count > 1").select("epoch_id", F.lit("repeated_partition").alias("violation"), name.alias("subject"))
    return head.unionByName(bad_lsn).unionByName(of_partitions).unionByName(twice)
