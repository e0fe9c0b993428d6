"""Queries of current state, versions and verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.operators import lake, verify, views
from ledgerlake.plans.lake import GATED, _summary
from ledgerlake.plans.registry import query
from ledgerlake.plans.synth import EPOCHS

PART = "PARTITION BY source_id, relation, record_key ORDER BY lsn, total_order"
LATEST = f"SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY source_id, relation, record_key ORDER BY lsn DESC, total_order DESC) AS k FROM {{log}} WHERE operation IN ('insert', 'update', 'delete') AND record_key IS NOT NULL) WHERE k = 1"
STATE_COLUMNS = "source_id, relation, record_key, epoch_id, transaction_id, lsn, commit_timestamp_ms, total_order, idempotency_key, payload"


def _gate(t, epoch: str):
    s = _summary(t, "nobody", "publish_with_gaps")
    return s.drop("checksum_status"), s.select("epoch_id", "checksum_status"), epoch


@query("w1_latest_row", LATEST)
def _(t):
    return views.latest(views.usable(t("log")))


@query("r21_current_state", f"SELECT {STATE_COLUMNS} FROM ({LATEST}) WHERE operation <> 'delete' AND epoch_id = '{EPOCHS[0]}' AND epoch_id IN ({GATED})")
def _(t):
    epochs, verification, epoch = _gate(t, EPOCHS[0])
    rows = lake.gated(t("log"), epochs, verification, epoch, accept_gaps=True)
    empty = t("target").where("false")
    return views.merge_current(empty, rows)


MERGED = f"""SELECT {STATE_COLUMNS} FROM (SELECT t.* FROM {{target}} t LEFT JOIN ({LATEST}) n USING (source_id, relation, record_key) WHERE n.lsn IS NULL OR (n.lsn, n.total_order) < (t.lsn, t.total_order))
  UNION ALL SELECT n.source_id, n.relation, n.record_key, n.epoch_id, n.transaction_id, n.lsn, n.commit_timestamp_ms, n.total_order, n.idempotency_key, n.payload FROM ({LATEST}) n LEFT JOIN {{target}} t USING (source_id, relation, record_key)
  WHERE n.operation <> 'delete' AND (t.lsn IS NULL OR (n.lsn, n.total_order) >= (t.lsn, t.total_order))"""


@query("j3_merge_current_state", MERGED)
def _(t):
    return views.merge_current(t("target"), t("log"))


@query("w2_first_change", f"SELECT source_id, relation, record_key, idempotency_key, operation FROM (SELECT *, row_number() OVER ({PART}) AS k FROM {{log}}) WHERE k = 1")
def _(t):
    first = F.min_by(F.struct("idempotency_key", "operation"), F.struct("lsn", "total_order")).alias("f")
    return views.usable(t("log")).groupBy(*views.KEY).agg(first).select(*views.KEY, "f.*")


@query("w3_next_commit_ts", f"SELECT idempotency_key, next_ts FROM (SELECT *, lead(commit_timestamp_ms) OVER ({PART}) AS next_ts FROM {{log}}) WHERE operation <> 'delete'")
def _(t):
    return views.versions(t("log")).select("idempotency_key", "next_ts")


@query("w4_next_operation", f"SELECT idempotency_key, next_operation FROM (SELECT *, lead(operation) OVER ({PART}) AS next_operation FROM {{log}}) WHERE operation <> 'delete'")
def _(t):
    return views.versions(t("log")).select("idempotency_key", "next_operation")


VERSION_COLUMNS = "source_id, relation, record_key, epoch_id, transaction_id, lsn, total_order, valid_from, valid_to, is_current, idempotency_key, close_epoch_id, payload"
FIRST = f"SELECT * FROM (SELECT *, row_number() OVER ({PART}) AS k FROM {{log}}) WHERE k = 1"
OPENED = f"""SELECT n.*, (SELECT min(b.valid_from) FROM {{versions_before}} b WHERE b.source_id = n.source_id AND b.relation = n.relation AND b.record_key = n.record_key AND (b.lsn > n.lsn OR (b.lsn = n.lsn AND b.total_order > n.total_order))) AS next_existing
  FROM (SELECT *, lead(commit_timestamp_ms) OVER ({PART}) AS next_ts FROM {{log}}) n WHERE operation <> 'delete'"""
SCD2 = f"""SELECT {VERSION_COLUMNS} FROM (
  SELECT b.source_id, b.relation, b.record_key, b.epoch_id, b.transaction_id, b.lsn, b.total_order, b.valid_from, CASE WHEN f.lsn IS NULL THEN b.valid_to ELSE f.commit_timestamp_ms END AS valid_to, f.lsn IS NULL AS is_current,
    b.idempotency_key, CASE WHEN f.lsn IS NULL THEN b.close_epoch_id ELSE f.epoch_id END AS close_epoch_id, b.payload
  FROM {{versions_before}} b LEFT JOIN ({FIRST}) f ON f.source_id = b.source_id AND f.relation = b.relation AND f.record_key = b.record_key AND (f.lsn > b.lsn OR (f.lsn = b.lsn AND f.total_order > b.total_order))
  UNION ALL SELECT source_id, relation, record_key, epoch_id, transaction_id, lsn, total_order, commit_timestamp_ms, least(coalesce(next_ts, next_existing), coalesce(next_existing, next_ts)), next_ts IS NULL AND next_existing IS NULL, idempotency_key, NULL, payload FROM ({OPENED}))"""


@query("r22_scd2", SCD2)
def _(t):
    return views.merge_versions(t("versions_before"), t("log"))


@query("j4_closed_versions", f"SELECT record_key, source_id, valid_to, close_epoch_id FROM ({SCD2}) WHERE close_epoch_id IS NOT NULL")
def _(t):
    return views.merge_versions(t("versions_before"), t("log")).where("close_epoch_id IS NOT NULL").select("record_key", "source_id", "valid_to", "close_epoch_id")


@query("j5_next_existing_version", f"SELECT idempotency_key, next_existing FROM ({OPENED}) WHERE next_existing IS NOT NULL")
def _(t):
    found = views.next_existing(t("log").where("operation <> 'delete'"), t("versions_before"))
    return found.where("next_existing IS NOT NULL").select("idempotency_key", "next_existing")


@query("j6_versions_to_open", "SELECT idempotency_key FROM {log} WHERE operation <> 'delete' AND idempotency_key NOT IN (SELECT idempotency_key FROM {log} WHERE lsn % 64 = 0)")
def _(t):
    return t("log").where("operation <> 'delete'").join(t("log").where("lsn % 64 = 0").select("idempotency_key"), "idempotency_key", "left_anti").select("idempotency_key")


@query("r22_scd2_replayed", SCD2)
def _(t):
    once = views.merge_versions(t("versions_before"), t("log"))
    return views.merge_versions(once, t("log"))


@query("r16_folded_images", """SELECT source_id, relation, record_key, amount, status FROM (SELECT source_id, relation, record_key, arg_max(operation, (lsn, total_order)) AS operation, arg_max(amount, lsn) FILTER (amount IS NOT NULL) AS amount, arg_max(status, lsn) FILTER (status IS NOT NULL) AS status
  FROM (SELECT * REPLACE (CASE WHEN lsn % 48 = 0 THEN NULL ELSE amount END AS amount, CASE WHEN lsn % 80 = 0 THEN NULL ELSE status END AS status) FROM {changes}) GROUP BY ALL) WHERE operation <> 'delete'""")
def _(t):
    rows = t("changes").withColumns({"amount": F.expr("CASE WHEN lsn % 48 = 0 THEN NULL ELSE amount END"), "status": F.expr("CASE WHEN lsn % 80 = 0 THEN NULL ELSE status END")})
    return views.fold_images(rows, ["amount", "status"])


@query("h19_interval_violations", f"SELECT source_id, relation, record_key, idempotency_key, valid_from, valid_to FROM ({SCD2}) WHERE valid_to < valid_from")
def _(t):
    return views.interval_violations(views.merge_versions(t("versions_before"), t("log")))


# -- verification ---------------------------------------------------------------------------------

_IMAGE = "'balance=' || balance || chr(0) || 'c_custkey=' || c_custkey || chr(0) || 'c_name=' || c_name || chr(0) || 'c_nationkey=' || c_nationkey || chr(0)"
SNAP = f"SELECT CAST(c_custkey AS VARCHAR) AS pk, CAST('0x' || substr(md5({_IMAGE}), 1, 15) AS BIGINT) AS row_hash FROM {{{{{{0}}}}}}"
S, T_ = SNAP.format("customer_source").replace("{{", "{").replace("}}", "}"), SNAP.format("customer_target").replace("{{", "{").replace("}}", "}")
JOINED = f"(SELECT coalesce(s.pk, t.pk) AS pk, s.row_hash AS s, t.row_hash AS t FROM ({S}) s FULL JOIN ({T_}) t ON s.pk = t.pk)"
DRIFT = f"SELECT pk, CASE WHEN t IS NULL THEN 'missing' WHEN s IS NULL THEN 'extra' ELSE 'mismatched' END AS drift FROM {JOINED} WHERE s IS DISTINCT FROM t"
LSNS = ("0/16B6C50", "0/16B6D00")


def _snaps(t):
    return verify.snapshot(t("customer_source"), "c_custkey", ("c_mktsegment",)), verify.snapshot(t("customer_target"), "c_custkey", ("c_mktsegment",))


@query("s13_snapshot_scan", S)
def _(t):
    return _snaps(t)[0]


@query("r34_table_checksum", f"SELECT count(*) AS row_count, bit_xor(h) AS xor_hash, CAST(sum(CAST(h AS HUGEINT)) AS VARCHAR) AS sum_hash FROM (SELECT CAST('0x' || substr(md5(pk || '|' || row_hash), 1, 15) AS BIGINT) AS h FROM ({S}))")
def _(t):
    return verify.table_checksum(_snaps(t)[0])


@query("j7_snapshot_drift", DRIFT)
def _(t):
    return verify.drift_rows(*_snaps(t))


@query("r33_compare_snapshots", f"""SELECT *, false AS converged, sha256(concat_ws('|', source_rows, target_rows, missing, extra, mismatched, '{LSNS[0]}', '{LSNS[1]}')) AS evidence_sha256 FROM (SELECT count(s) AS source_rows, count(t) AS target_rows,
  count(*) FILTER (t IS NULL) AS missing, count(*) FILTER (s IS NULL) AS extra, count(*) FILTER (s <> t) AS mismatched, true AS watermark_reached FROM {JOINED})""")
def _(t):
    return verify.compare(*_snaps(t), *LSNS)


@query("u1_source_except_target", f"SELECT pk FROM ({S}) EXCEPT SELECT pk FROM ({T_})")
def _(t):
    s, x = _snaps(t)
    return s.select("pk").join(x.select("pk"), "pk", "left_anti")


@query("u2_keys_with_other_hash", f"SELECT pk FROM {JOINED} WHERE s <> t")
def _(t):
    s, x = _snaps(t)
    return s.join(x.withColumnRenamed("row_hash", "other"), "pk").where("row_hash <> other").select("pk")


@query("o5_drift_sample", f"SELECT pk, drift, CAST(k AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY drift ORDER BY pk) AS k FROM ({DRIFT})) WHERE k <= 20")
def _(t):
    return verify.drift_sample(verify.drift_rows(*_snaps(t)))


@query("s14_reseed", """SELECT c_custkey, c_name, c_nationkey, c_mktsegment, balance FROM {customer_target} WHERE coalesce(NOT (CASE WHEN c_nationkey = 9 THEN NULL ELSE c_nationkey < 5 END), true)
  UNION ALL SELECT c_custkey, c_name, c_nationkey, c_mktsegment, balance FROM {customer_source} WHERE CASE WHEN c_nationkey = 9 THEN NULL ELSE c_nationkey < 5 END""")
def _(t):
    where = F.when(F.col("c_nationkey") == 9, F.lit(None).cast("boolean")).otherwise(F.col("c_nationkey") < 5)
    source = t("customer_source")
    return verify.reseed(source, t("customer_target"), where, source.columns)


@query("r32_fanin_verify", """SELECT source_id, field, stream_value, lake_value, 'blocker' AS severity FROM (SELECT source_id, count(*) AS n, CAST(sum(amount) AS BIGINT) AS total FROM {changes} GROUP BY ALL) s, LATERAL (
  SELECT 'changes' AS field, CAST(n AS VARCHAR) AS stream_value, CAST(n + CASE WHEN source_id = 'store-002' THEN 1 ELSE 0 END AS VARCHAR) AS lake_value UNION ALL SELECT 'total', CAST(total AS VARCHAR), CAST(total AS VARCHAR)) v WHERE stream_value <> lake_value""")
def _(t):
    s = t("changes").groupBy("source_id").agg(F.count("*").alias("changes"), F.sum("amount").alias("total"))
    other = s.withColumn("changes", F.col("changes") + F.when(F.col("source_id") == "store-002", 1).otherwise(0))
    return verify.fan_in_compare(s, other, ["source_id"], ["changes", "total"])


@query("r32_internal_consistency", """WITH s AS (SELECT epoch_id, count(*) AS n, count(*) FILTER (state = 'complete') AS a, count(*) FILTER (state IN ('missing', 'lagging')) AS b, count(*) FILTER (state = 'quarantined') AS q FROM {epoch_sources_stated} GROUP BY ALL)
  SELECT epoch_id, 'source_counts' AS violation, '' AS subject FROM {epoch_rows} WHERE complete_source_count + missing_source_count + quarantined_source_count <> required_source_count
  UNION ALL SELECT e.epoch_id, 'source_rows', '' FROM {epoch_rows} e LEFT JOIN s ON s.epoch_id = e.epoch_id WHERE coalesce(n, 0) <> required_source_count
  UNION ALL SELECT e.epoch_id, 'source_rollup', '' FROM {epoch_rows} e LEFT JOIN s ON s.epoch_id = e.epoch_id WHERE coalesce(a, 0) <> complete_source_count OR coalesce(b, 0) <> missing_source_count OR coalesce(q, 0) <> quarantined_source_count
  UNION ALL SELECT epoch_id, 'state', '' FROM {epoch_rows} WHERE NOT CASE state WHEN 'complete' THEN missing_source_count = 0 AND quarantined_source_count = 0 AND complete_source_count = required_source_count WHEN 'complete_with_gaps' THEN missing_source_count > 0 AND quarantined_source_count = 0 WHEN 'quarantined' THEN quarantined_source_count > 0 ELSE true END
  UNION ALL SELECT epoch_id, 'source_lsn', source_id FROM {epoch_sources_stated} WHERE commit_lsn IN ('0/0', 'nonsense')
  UNION ALL SELECT epoch_id, 'partition_source', source_id || ':' || partition_id FROM {epoch_partitions_stated} WHERE source_id = '' OR trim(source_id) <> source_id
  UNION ALL SELECT epoch_id, 'partition_window', source_id || ':' || partition_id FROM {epoch_partitions_stated} WHERE first_lsn IS NULL OR first_lsn = '0/0' OR first_lsn > last_lsn
  UNION ALL SELECT epoch_id, 'repeated_partition', source_id || ':' || partition_id FROM {epoch_partitions_stated} GROUP BY ALL HAVING count(*) > 1""")
def _(t):
    return verify.consistency_violations(t("epoch_rows"), t("epoch_sources_stated"), t("epoch_partitions_stated"))


@query("j16_null_safe_key", "SELECT count(*) AS pairs FROM {moves} a JOIN {moves} b ON a.key_after IS NOT DISTINCT FROM b.key_after AND a.transaction_id = b.transaction_id")
def _(t):
    m = t("moves")
    b = m.select(F.col("transaction_id").alias("other"), F.col("key_after").alias("key"))
    return m.join(b, (F.col("transaction_id") == F.col("other")) & F.col("key_after").eqNullSafe(F.col("key"))).agg(F.count("*").alias("pairs"))


@query("o3_rows_by_key_text", "SELECT pk, CAST(row_number() OVER (PARTITION BY substr(pk, 1, 2) ORDER BY pk) AS INTEGER) AS position FROM (SELECT CAST(c_custkey AS VARCHAR) AS pk FROM {customer})")
def _(t):
    from pyspark.sql import Window

    pk = t("customer").select(F.col("c_custkey").cast("string").alias("pk"))
    return pk.withColumn("position", F.row_number().over(Window.partitionBy(F.substring("pk", 1, 2)).orderBy("pk")))
