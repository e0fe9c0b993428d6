"""Fleet, safety and health analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Safety rules as (code, points, critical) with the condition they test.
RULES = [
    ("slot_missing", 35, True, "NOT slot_present"), ("wrong_plugin", 35, True, "plugin <> 'pgoutput'"), ("slot_invalidated", 35, True, "invalidated"), ("wal_lost", 35, True, "wal_status = 'lost'"),
    ("restart_ahead", 10, False, "restart_lsn > confirmed_lsn"), ("wal_unreserved", 20, False, "wal_status = 'unreserved'"), ("safe_wal_exhausted", 20, False, "safe_wal_bytes <= 0"), ("low_headroom", 20, False, "headroom_seconds <= 86400"),
    ("unsafe_tables", 25, True, "unsafe_tables > 0"), ("table_notes", 5, False, "table_notes > 0"), ("conflicts", 35, True, "conflicts > 0"), ("apply_errors", 15, False, "apply_errors > 0"),
    ("wraparound_critical", 35, True, "wraparound_percent >= 90"), ("wraparound", 20, False, "wraparound_percent >= 75 AND wraparound_percent < 90"), ("xmin_pinned", 20, False, "xmin_pinners > 0"), ("failover_disabled", 15, False, "NOT failover"),
    ("failover_not_synced", 15, False, "failover AND NOT failover_synced"), ("inspection_incomplete", 10, False, "NOT inspection_complete"),
]


def safety_factors(sources: DataFrame) -> DataFrame:
    """A row for each rule that a source's inspection breaks; an inactive slot counts where nothing else does."""
    made = [F.when(F.expr(cond), F.struct(F.lit(code).alias("code"), F.lit(points).alias("points"), F.lit(critical).alias("critical"))) for code, points, critical, cond in RULES]
    found = F.array_compact(F.array(*made))
    idle = F.struct(F.lit("slot_inactive").alias("code"), F.lit(10).alias("points"), F.lit(False).alias("critical"))
    with_idle = F.when((F.size(found) == 0) & ~F.col("active"), F.array(idle)).otherwise(found)
    return sources.select("source_id", F.inline(with_idle))


def safety_scores(sources: DataFrame, factors: DataFrame) -> DataFrame:
    per = factors.groupBy("source_id").agg(F.least(F.sum("points"), F.lit(100)).alias("lost"), F.max("critical").alias("critical"))
    out = sources.select("source_id").join(per, "source_id", "left").withColumn("score", 100 - F.coalesce("lost", F.lit(0)))
    status = F.when(F.col("critical"), "blocked").when(F.col("lost").isNull(), "healthy").otherwise("degraded")
    grade = F.when(F.col("score") >= 90, "A").when(F.col("score") >= 75, "B").when(F.col("score") >= 60, "C").when(F.col("score") >= 40, "D").otherwise("F")
    return out.select("source_id", "score", status.alias("status"), grade.alias("grade"))


def slot_issues(sources: DataFrame) -> DataFrame:
    """Issues of a slot; a missing slot has no other."""
    rest = F.array_compact(F.array(F.when(F.col("plugin") != "pgoutput", "plugin"), F.when(F.col("invalidated"), "invalidated"), F.when(F.col("wal_status").isin("lost", "unreserved"), F.col("wal_status")), F.when(F.col("safe_wal_bytes") <= 0, "safe_wal")))
    return sources.select("source_id", F.explode(F.when(~F.col("slot_present"), F.array(F.lit("missing"))).otherwise(rest)).alias("issue"))


def wal_headroom(samples: DataFrame) -> DataFrame:
    """Write rate between a source's samples (seq, lsn, seconds, safe_bytes) and the seconds left; null where unknowable."""
    by = Window.partitionBy("source_id").orderBy("seq")
    moved, gap = F.greatest(F.col("lsn") - F.lag("lsn").over(by), F.lit(0)), F.col("seconds") - F.lag("seconds").over(by)
    rate = F.when(gap > 0, F.floor(moved / gap).cast("long"))
    out = samples.withColumn("bytes_per_second", rate).where("bytes_per_second IS NOT NULL")
    left = F.when((F.col("bytes_per_second") > 0) & (F.col("safe_bytes") > 0), F.floor(F.col("safe_bytes") / F.col("bytes_per_second")).cast("long"))
    return out.select("source_id", "seq", "bytes_per_second", left.alias("headroom_seconds"))


def table_preflight(tables: DataFrame) -> DataFrame:
    """Whether updates and deletes of a table can be replicated: full or index identity, or default with a primary key."""
    safe = F.col("replica_identity").isin("full", "index") | ((F.col("replica_identity") == "default") & F.col("has_primary_key"))
    return tables.select("relation", safe.alias("safe"), F.when(~safe, "no_identity").when(F.col("wide_columns") > 0, "unchanged_values_possible").alias("note"))


def schema_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.select("relation", F.col("fingerprint").alias("was")).join(after.select("relation", F.col("fingerprint").alias("is")), "relation").where("was <> is").select("relation", "was", "is")


def fleet_report(flows: DataFrame) -> DataFrame:
    """One row over flows (flow_id, source_id, dataset_id, mode, lake_state)."""
    verdict = F.when(F.count_if(F.col("lake_state") == "quarantined") > 0, "blocked").when(F.count_if(F.col("lake_state") == "complete_with_gaps") > 0, "gaps").otherwise("ready")
    return flows.agg(F.count("*").alias("flows"), F.countDistinct("source_id").alias("sources"), F.countDistinct("dataset_id").alias("datasets"), F.count_if(F.col("mode") == "strict").alias("strict"), F.count_if(F.col("mode") == "partitioned").alias("partitioned"), verdict.alias("lake_verdict"))


def fleet_scorecard(scores: DataFrame) -> DataFrame:
    count = lambda x: F.count_if(F.col("status") == x)
    out = scores.agg(count("healthy").alias("ready"), count("blocked").alias("blocked"), count("degraded").alias("review"), F.floor(F.sum("score") / F.count("*")).cast("long").alias("mean_score"))
    return out.withColumn("verdict", F.when(F.col("blocked") > 0, "blocked").when(F.col("review") > 0, "review").otherwise("ready"))


def identity_audit(flows: DataFrame) -> DataFrame:
    """Flow identities that several configurations share."""
    return flows.groupBy("flow_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("config")), ",").alias("configs")).where("n > 1")


def flow_health(flows: DataFrame) -> DataFrame:
    """healthy, degraded or blocked with the issues; flows: lag_bytes, missing_partitions, quarantined, validation."""
    issues = F.array_compact(F.array(F.when(F.col("quarantined") > 0, "quarantine"), F.when(F.col("validation") == "mismatch", "validation"), F.when(F.col("missing_partitions") > 0, "partitions"), F.when(F.col("lag_bytes") > 0, "lag")))
    status = F.when((F.col("quarantined") > 0) | (F.col("validation") == "mismatch"), "blocked").when(F.size(issues) > 0, "degraded").otherwise("healthy")
    return flows.select("flow_id", status.alias("status"), F.array_join(issues, ",").alias("issues"))


def checksum_status(source: Column, target: Column, source_rows: Column, target_rows: Column) -> Column:
    return F.when(source.isNull() | target.isNull(), "unknown").when((source == target) & (source_rows == target_rows), "match").otherwise("mismatch")


def queue_admission(frames: DataFrame, most_frames: int, most_bytes: int) -> DataFrame:
    """Frames (queue, seq, size) admitted in order while neither cap is passed by what is queued with them."""
    by = Window.partitionBy("queue").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    ok = (F.count("*").over(by) <= most_frames) & (F.sum("size").over(by) <= most_bytes)
    return frames.withColumn("admission", F.when(ok, "admitted").otherwise("backpressure"))


def drain_violations(frames: DataFrame) -> DataFrame:
    """Frames (queue, seq, lsn, boundary, size) of a drained batch that go back in LSN or repeat a boundary."""
    by = Window.partitionBy("queue").orderBy("seq")
    back = F.col("lsn") < F.lag("lsn").over(by)
    again = F.row_number().over(Window.partitionBy("queue", "boundary").orderBy("seq")) > 1
    return frames.withColumn("violation", F.when(back, "lsn_regression").when(again, "repeated_boundary")).where("violation IS NOT NULL").select("queue", "seq", "violation")


def validation_violations(events: DataFrame) -> DataFrame:
    codes = F.array_compact(F.array(F.when(~F.col("digest").rlike("^[0-9a-f]{64}$"), "digest"), F.when(F.col("tables") <= 0, "tables"), F.when(F.col("rows") < 0, "rows"), F.when(F.col("applied") > F.col("durable"), "watermark")))
    return events.select("event_id", F.explode(codes).alias("violation"))


def latest_events(events: DataFrame) -> DataFrame:
    """The last event of each flow by time."""
    return events.groupBy("flow_id").agg(F.max_by(F.struct("event_id", "completed_ms"), F.struct("completed_ms", "event_id")).alias("e")).select("flow_id", "e.event_id", "e.completed_ms")


def boundary_status(flows: DataFrame) -> DataFrame:
    """clean where the source is durable, the target reaches it, nothing is in quarantine and partitions are complete."""
    clean = (F.col("durable") > 0) & (F.col("applied") >= F.col("durable")) & (F.col("quarantined") == 0) & (F.col("missing_partitions") == 0)
    return flows.select("flow_id", F.when(clean, "clean").otherwise("open").alias("boundary"))


def health_violations(states: DataFrame) -> DataFrame:
    """Health reports (phase, readiness, accepting_work, reason_code) that no runtime may give: states that don't go
    together, malformed reasons, and missing ones where readiness asks for one."""
    phase, ready, accepting = F.col("phase"), F.col("readiness"), F.col("accepting_work")
    running = F.when(ready.isin("ready", "degraded"), accepting).when(ready.isin("backpressured", "blocked"), ~accepting).otherwise(False)
    valid = F.when(phase == "running", running).when(phase == "failed", (ready == "blocked") & ~accepting).otherwise((ready == "not_ready") & ~accepting)
    needs = ready.isin("degraded", "backpressured", "blocked") & F.col("reason_code").isNull()
    found = F.array_compact(F.array(F.when(~valid, F.lit("state")), F.when(~F.col("reason_code").rlike("^[a-z0-9_]+$"), F.lit("reason_code")), F.when(needs, F.lit("missing_reason"))))
    return states.select("*", F.explode(found).alias("violation"))


#: Kinds of schema change by what they mean for replay. Compatible ones need a configured table.
COMPATIBLE = ("add_nullable_column", "widen_type", "increase_varchar")
MAPPED = ("rename_column", "rename_table", "unknown")


def ddl_compatibility(kind: Column, configured: Column, allow_unknown: Column) -> Column:
    known = F.when(configured, "compatible").otherwise("blocked_by_policy")
    return F.when(kind.isin(*COMPATIBLE), known).when(kind == "add_table", F.when(allow_unknown, "compatible").otherwise("blocked_by_policy")).when(kind.isin(*MAPPED), "requires_mapping").otherwise("destructive_or_ambiguous")


def ddl_decision(mode: Column, compatibility: Column) -> Column:
    """What a plan does with a change: policy blocks come first, then compatible changes by mode; review mode blocks nothing else."""
    by_mode = F.when(mode == "auto_safe", "auto_apply").when(mode == "staged_rollout", "stage_then_apply").otherwise("manual_review")
    rest = F.when((mode == "manual_review") | (compatibility == "requires_mapping"), "manual_review").otherwise("block")
    return F.when(compatibility == "blocked_by_policy", "block").when(compatibility == "compatible", by_mode).otherwise(rest)
