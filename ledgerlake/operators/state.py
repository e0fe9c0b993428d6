"""Checkpoints, partition watermarks, acknowledgements, snapshots and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States that a snapshot run may go to from each state, besides staying there.
SNAPSHOT_MOVES = {
    "planned": ("slot_created",),
    "slot_created": ("snapshot_exported", "copying_table", "failed_recoverable"),
    "snapshot_exported": ("copying_table", "failed_recoverable"),
    "copying_table": ("copy_complete", "failed_recoverable"),
    "copy_complete": ("stream_handoff_ready", "failed_recoverable"),
    "stream_handoff_ready": ("streaming", "verified", "failed_recoverable"),
    "streaming": ("verified", "failed_recoverable"),
    "verified": ("failed_recoverable",),
    "failed_recoverable": ("planned", "slot_created", "snapshot_exported", "copying_table"),
}


def merge_checkpoints(updates: DataFrame) -> DataFrame:
    """The highest of each field of each flow; nulls count as absent."""
    fields = ("last_seen", "durable", "applied")
    return updates.groupBy("flow_id").agg(*[F.max(f).alias(f) for f in fields])


def rewinds(updates: DataFrame) -> DataFrame:
    """Updates (flow_id, seq, fields) in which a field lies below what it reached before."""
    before = Window.partitionBy("flow_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    found = F.array_compact(F.array(*[F.when(F.col(f) < F.max(f).over(before), F.lit(f)) for f in ("last_seen", "durable", "applied")]))
    return updates.select("flow_id", "seq", found.alias("found")).select("flow_id", "seq", F.explode("found").alias("field"))


def order_violations(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.where("applied > durable OR durable > last_seen")


def lag(checkpoints: DataFrame) -> DataFrame:
    apart = lambda a, b: F.greatest(F.col(a) - F.col(b), F.lit(0))
    return checkpoints.select("flow_id", apart("last_seen", "durable").alias("publish_lag_bytes"), apart("durable", "applied").alias("apply_lag_bytes"), apart("last_seen", "applied").alias("total_lag_bytes"))


def expected_partitions(flows: DataFrame, n: int) -> DataFrame:
    return flows.select("flow_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("partition_id"))


def missing_partitions(checkpoints: DataFrame, n: int) -> DataFrame:
    return expected_partitions(checkpoints.select("flow_id").distinct(), n).join(checkpoints.select("flow_id", "partition_id"), ["flow_id", "partition_id"], "left_anti")


def watermarks(checkpoints: DataFrame, n: int) -> DataFrame:
    """Per flow: the low watermarks over all n partitions, withheld (null) while any is missing."""
    per = checkpoints.where(F.col("partition_id").between(0, n - 1)).groupBy("flow_id").agg(
        F.countDistinct("partition_id").alias("present"), F.min("durable").alias("d"), F.min("applied").alias("a"), F.max("applied").alias("max_applied"), F.sum(F.greatest(F.col("durable") - F.col("applied"), F.lit(0))).alias("lag_bytes")
    )
    full = F.col("present") == n
    return per.select("flow_id", full.alias("complete"), (n - F.col("present")).alias("missing"), F.when(full, F.col("d")).alias("global_durable"), F.when(full, F.col("a")).alias("global_applied"), "max_applied", "lag_bytes")


def blocking_partitions(checkpoints: DataFrame, n: int) -> DataFrame:
    """Partitions that hold the low watermark back."""
    marks = watermarks(checkpoints, n)
    return checkpoints.join(marks, "flow_id").where("applied = global_applied AND applied < max_applied").select("flow_id", "partition_id", "applied", "max_applied")


def partition_health(checkpoints: DataFrame, n: int) -> DataFrame:
    """Status of each expected partition: missing, lagging or ready."""
    rows = expected_partitions(checkpoints.select("flow_id").distinct(), n).join(checkpoints, ["flow_id", "partition_id"], "left")
    status = F.when(F.col("durable").isNull(), "missing").when(F.col("applied") < F.col("durable"), "lagging").otherwise("ready")
    return rows.select("flow_id", "partition_id", status.alias("status"))


def skew(loads: DataFrame) -> DataFrame:
    """Per epoch over partition totals: lowest, highest, sum, ratio in basis points, hottest and coolest partitions."""
    total = loads.groupBy("epoch_id", "partition_id").agg(F.sum("event_count").alias("n"))
    ends = total.groupBy("epoch_id").agg(F.min("n").alias("min_events"), F.max("n").alias("max_events"), F.sum("n").alias("total_events"))
    at = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") == F.col(c), F.col("partition_id")))).cast("array<string>"), ",")
    out = total.join(ends, "epoch_id").groupBy("epoch_id", "min_events", "max_events", "total_events").agg(at("max_events").alias("hottest"), at("min_events").alias("coolest"))
    return out.withColumn("ratio_bp", F.when(F.col("min_events") > 0, F.floor(F.col("max_events") * 10000 / F.col("min_events")).cast("long")))


def rebalance(loads: DataFrame, percent: int) -> DataFrame:
    """Per epoch at most one move from the last hottest to the first coolest partition, of half the difference, where the
    hottest passes the coolest by more than percent."""
    total = loads.groupBy("epoch_id", "partition_id").agg(F.sum("event_count").alias("n"))
    out = total.groupBy("epoch_id").agg(
        F.max("n").alias("max_events"), F.min("n").alias("min_events"), F.max_by("partition_id", F.struct("n", "partition_id")).alias("from_partition"), F.min_by("partition_id", F.struct("n", "partition_id")).alias("to_partition")
    )
    return out.where(F.col("max_events") * 100 > F.col("min_events") * (100 + percent)).select("epoch_id", "from_partition", "to_partition", F.floor((F.col("max_events") - F.col("min_events")) / 2).cast("long").alias("move_events"))


def ack_gaps(acks: DataFrame) -> DataFrame:
    """Acknowledgements (consumer, topic, seq, offset) against the cursor before: applied, repeated or a gap."""
    before = Window.partitionBy("consumer", "topic").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    cursor = F.coalesce(F.max("offset").over(before), F.lit(-1))
    return acks.withColumn("result", F.when(F.col("offset") <= cursor, "repeated").when(F.col("offset") == cursor + 1, "applied").otherwise("non_contiguous"))


def snapshot_violations(runs: DataFrame) -> DataFrame:
    """Steps (run_id, seq, state, copied_rows, consistent_lsn) that the state machine forbids."""
    by = Window.partitionBy("run_id").orderBy("seq")
    prev = lambda c: F.lag(c).over(by)
    allowed = F.create_map(*[x for k, v in SNAPSHOT_MOVES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    rows = runs.withColumns({"was": prev("state"), "was_rows": prev("copied_rows"), "was_lsn": prev("consistent_lsn")})
    codes = F.array_compact(F.array(
        F.when((F.col("was") != F.col("state")) & ~F.array_contains(F.element_at(allowed, F.col("was")), F.col("state")), F.lit("transition")),
        F.when(F.col("copied_rows") < F.col("was_rows"), F.lit("copied_rows")), F.when(F.col("consistent_lsn") != F.col("was_lsn"), F.lit("consistent_lsn")),
    ))
    return rows.select("run_id", "seq", F.explode(codes).alias("violation"))


def handoff_readiness(required: DataFrame, progress: DataFrame, boundary: int) -> DataFrame:
    """Whether every relation's copy is complete at the boundary LSN, and how many are not."""
    joined = required.join(progress, "relation", "left")
    done = F.coalesce((F.col("state") == "copy_complete") & (F.col("consistent_lsn") == boundary), F.lit(False))
    return joined.agg(F.count("*").alias("relations"), F.count_if(done).alias("ready_relations"), F.coalesce(F.sum(F.when(done, F.col("copied_rows"))), F.lit(0)).alias("copied_rows"), F.min(done).alias("ready"))


def quarantine_upsert(existing: DataFrame, failures: DataFrame) -> DataFrame:
    """Quarantine rows after more failures: attempts add up, the first and last time widen."""
    both = existing.unionByName(failures)
    return both.groupBy("transaction_id").agg(F.sum("attempts").alias("attempts"), F.min("first_seen_ms").alias("first_seen_ms"), F.max("last_seen_ms").alias("last_seen_ms"), F.max_by("error", "last_seen_ms").alias("error"))


def ddl_release(barriers: DataFrame, acks: DataFrame) -> DataFrame:
    """Per barrier: required sinks acknowledged, pending and rejected, others unexpected, and whether changes may go on.

    barriers: barrier_id, barrier_lsn, required_sinks (array); acks: barrier_id, sink, accepted, ack_lsn.
    """
    need = barriers.select("barrier_id", "barrier_lsn", F.explode("required_sinks").alias("sink"), F.lit(True).alias("required"))
    joined = need.join(acks, ["barrier_id", "sink"], "full_outer").join(barriers.select("barrier_id", F.col("barrier_lsn").alias("at")), "barrier_id")
    good = F.coalesce(F.col("accepted") & (F.col("ack_lsn") >= F.col("at")), F.lit(False))
    status = F.when(F.col("required").isNull(), "unexpected").when(F.col("accepted").isNull(), "pending").when(good, "acked").otherwise("rejected")
    names = lambda x: F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == x, F.col("sink")))), ",")
    out = joined.withColumn("status", status).groupBy("barrier_id").agg(*[names(x).alias(x) for x in ("acked", "pending", "rejected", "unexpected")])
    return out.withColumn("release_dml", (F.col("acked") != "") & (F.col("pending") == "") & (F.col("rejected") == "") & (F.col("unexpected") == ""))


def ack_conflicts(acks: DataFrame) -> DataFrame:
    """Acknowledgements (barrier_id, sink, seq, ack_lsn, accepted) that go back, or decide one LSN anew."""
    by = Window.partitionBy("barrier_id", "sink").orderBy("seq")
    was, decided = F.lag("ack_lsn").over(by), F.lag("accepted").over(by)
    code = F.when(F.col("ack_lsn") < was, "rewind").when((F.col("ack_lsn") == was) & (F.col("accepted") != decided), "conflict")
    return acks.withColumn("violation", code).where("violation IS NOT NULL").select("barrier_id", "sink", "seq", "violation")


def source_ack(published: DataFrame, expected: Column, durable: Column) -> DataFrame:
    """Per transaction: whether all messages were acknowledged by one destination and the durable LSN reaches the commit."""
    per = published.groupBy("transaction_id").agg(F.count("*").alias("acks"), F.countDistinct("destination").alias("destinations"), F.max("lsn").alias("lsn"), F.max("expected").alias("expected"))
    return per.select("transaction_id", ((F.col("acks") == expected) & (F.col("destinations") == 1) & (durable >= F.col("lsn"))).alias("may_acknowledge"))
