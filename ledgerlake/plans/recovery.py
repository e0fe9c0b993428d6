"""Queries of recovery, metrics and what is left of ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.operators import lake, recovery, views
from ledgerlake.plans.lake import SOURCES, _summary, _summary_sql
from ledgerlake.plans.registry import query
from ledgerlake.plans.streams import _stream
from ledgerlake.storage import ManifestTable, fresh_dir
from ledgerlake.streaming import ingest

_SCENARIOS = ", ".join(f"('{a}', '{b}')" for a, b in recovery.SCENARIOS.items())


@query("r35_recovery_scenarios", f"SELECT epoch_id, scenario, decision FROM (SELECT DISTINCT epoch_id FROM {{changes}}) CROSS JOIN (VALUES {_SCENARIOS}) v(scenario, decision)")
def _(t):
    return recovery.scenarios(t.spark, t("changes").select("epoch_id").distinct())


@query("r35_recovery_guidance", f"SELECT epoch_id, state, 'explicit_gap_acceptance_required' AS code FROM ({_summary_sql('nobody', 'publish_with_gaps')}) UNION ALL SELECT epoch_id, state, 'epoch_not_sealed' FROM ({_summary_sql('nobody', 'wait_all_required')}) UNION ALL SELECT epoch_id, state, 'quarantine_repair_required' FROM ({_summary_sql('quarantined', 'wait_all_required')})")
def _(t):
    out = None
    for bad, policy in (("nobody", "publish_with_gaps"), ("nobody", "wait_all_required"), ("quarantined", "wait_all_required")):
        s = _summary(t, bad, policy).select("epoch_id", "state", recovery.guidance(F.col("state")).alias("code"))
        out = s if out is None else out.unionByName(s)
    return out


@query("m1_runtime_gauges", """SELECT 'apply' AS service, source_id, dataset_id, 'cdc_runtime_' || g AS metric, CAST(CASE g WHEN 'live' THEN 1 WHEN 'ready' THEN CASE WHEN quarantined = 0 THEN 1 ELSE 0 END WHEN 'pending_work' THEN lag_bytes WHEN 'last_durable_lsn_bytes' THEN durable ELSE 0 END AS DOUBLE) AS value
  FROM {flows} CROSS JOIN (VALUES ('live'), ('ready'), ('pending_work'), ('restarts_total'), ('failures_total'), ('last_success_unixtime'), ('last_durable_lsn_bytes')) v(g)""")
def _(t):
    zero = F.lit(0)
    return recovery.gauges(t("flows").select(
        F.lit("apply").alias("service"), "source_id", "dataset_id", F.lit(1).alias("live"), F.when(F.col("quarantined") == 0, 1).otherwise(0).alias("ready"), F.col("lag_bytes").alias("pending_work"),
        zero.alias("restarts_total"), zero.alias("failures_total"), zero.alias("last_success_unixtime"), F.col("durable").alias("last_durable_lsn_bytes"),
    ))


@query("r16_unmatched_changes", """SELECT source_id, relation, record_key, idempotency_key, operation FROM (SELECT *, lag(operation) OVER (PARTITION BY source_id, relation, record_key ORDER BY lsn, total_order) AS b FROM {log}) e
  WHERE operation IN ('update', 'delete') AND (b = 'delete' OR (b IS NULL AND NOT EXISTS (SELECT 1 FROM {target} t WHERE t.source_id = e.source_id AND t.relation = e.relation AND t.record_key = e.record_key)))""")
def _(t):
    return recovery.unmatched_changes(t("log"), t("target"), views.KEY)


@query("o4_sorted_ledger", f"SELECT epoch_id, string_agg(source_id, ',' ORDER BY source_id) AS source_ids FROM ({SOURCES}) GROUP BY ALL")
def _(t):
    return lake.epoch_sources(t("changes")).groupBy("epoch_id").agg(F.array_join(F.array_sort(F.collect_list("source_id")), ",").alias("source_ids"))


@query("o8_dashboard_order", f"SELECT state, source_id FROM (SELECT 'complete' AS state, source_id FROM ({SOURCES}) WHERE epoch_id = 'epoch-2026-08-16T00') ORDER BY state, source_id")
def _(t):
    return lake.epoch_sources(t("changes").where("epoch_id = 'epoch-2026-08-16T00'")).select(F.lit("complete").alias("state"), "source_id").orderBy("state", "source_id")


@query("t10_streamed_abort", """SELECT transaction_id, total_order FROM {subtransactions} s WHERE transaction_id IN (SELECT transaction_id FROM {commits}) AND NOT EXISTS (SELECT 1 FROM {aborted} a WHERE a.transaction_id = s.transaction_id AND (a.subtransaction_id IS NULL OR a.subtransaction_id = s.subtransaction_id))""")
def _(t):
    from ledgerlake.operators import protocol

    table, bad = ManifestTable(t.spark, fresh_dir(t.spark, "segments"), "lsn"), ManifestTable(t.spark, fresh_dir(t.spark, "bad"))
    rows = t("subtransactions").select(F.col("subtransaction_id").cast("string").alias("source_id"), "transaction_id", F.col("total_order").cast("long").alias("lsn"), "subtransaction_id", "total_order", "payload")
    ingest.ingest(_stream(t, rows, 3, "segments", 2), table, bad, fresh_dir(t.spark, "progress"))
    return protocol.assemble(table.read(), t("commits"), t("aborted")).select("transaction_id", "total_order")
