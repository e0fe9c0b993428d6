"""What to do after a failure: scenarios and guidance as small tables, and the metrics a runtime shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Scenario code and the decision it calls for.
SCENARIOS = {
    "writer_crash_before_data_file_commit": "retry_data_file_intents",
    "writer_crash_after_data_before_epoch_metadata": "discover_durable_raw_cdc_objects_and_checkpoint_receipts_then_publish_metadata",
    "writer_crash_after_epoch_metadata": "discover_existing_epoch_metadata_before_publish",
    "conflicting_duplicate_on_replay": "quarantine_and_block_epoch",
    "verification_mismatch_after_commit": "hold_spark_consumption_until_fanin_verify_matches",
}
#: Epoch state and guidance code.
GUIDANCE = {
    "open": "epoch_not_sealed", "sealing": "epoch_not_sealed", "complete": "epoch_complete", "complete_with_gaps": "explicit_gap_acceptance_required", "quarantined": "quarantine_repair_required",
    "reseeding": "source_reseed_required", "failed_recoverable": "writer_replay_required",
}
#: Gauges of a runtime.
GAUGES = ("live", "ready", "pending_work", "restarts_total", "failures_total", "last_success_unixtime", "last_durable_lsn_bytes")


def scenarios(spark: SparkSession, epochs: DataFrame) -> DataFrame:
    """A row for each epoch and scenario."""
    table = spark.createDataFrame(list(SCENARIOS.items()), "scenario string, decision string")
    return epochs.select("epoch_id").crossJoin(F.broadcast(table))


def guidance(state: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, code in GUIDANCE.items():
        out = F.when(state == name, code).otherwise(out)
    return out


def observed_scenario(files: Column, receipts: Column, metadata: Column, conflicts: Column, verified: Column) -> Column:
    """The scenario that an epoch's evidence shows, or null: files planned and written, receipts, ledger rows, conflicts."""
    return (
        F.when(conflicts > 0, "conflicting_duplicate_on_replay").when(receipts < files, "writer_crash_before_data_file_commit").when(metadata == 0, "writer_crash_after_data_before_epoch_metadata")
        .when(~verified, "verification_mismatch_after_commit").when(metadata > 1, "writer_crash_after_epoch_metadata")
    )


def gauges(runtimes: DataFrame) -> DataFrame:
    """runtimes (service, source_id, dataset_id and a column for each gauge) as (service, source_id, dataset_id, metric, value)."""
    each = F.array(*[F.struct(F.lit(f"cdc_runtime_{g}").alias("metric"), F.col(g).cast("double").alias("value")) for g in GAUGES])
    return runtimes.select("service", "source_id", "dataset_id", F.inline(each))


def unmatched_changes(changes: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """Updates and deletes that would meet no row: nothing before them in the log, or a delete, and nothing in the target."""
    by = Window.partitionBy(*key).orderBy("lsn", "total_order")
    rows = changes.withColumn("before", F.lag("operation").over(by)).where("operation IN ('update', 'delete') AND (before IS NULL OR before = 'delete')")
    have = target.select(*key, F.lit(True).alias("have"))
    joined = rows.join(have, key, "left")
    return joined.where("before = 'delete' OR have IS NULL").select(*key, "idempotency_key", "operation")
