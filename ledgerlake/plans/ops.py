"""Queries of fleets, safety and health, and of scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.functions import hashing, lsn, names
from ledgerlake.operators import ops
from ledgerlake.plans.registry import query
from ledgerlake.sources import test_decoding

_RULES = " UNION ALL ".join(f"SELECT source_id, '{c}' AS code, {p} AS points, {str(k).lower()} AS critical FROM {{slots}} WHERE {w}" for c, p, k, w in ops.RULES)
FACTORS = f"SELECT * FROM ({_RULES}) UNION ALL SELECT source_id, 'slot_inactive', 10, false FROM {{slots}} WHERE NOT active AND source_id NOT IN (SELECT source_id FROM ({_RULES}))"
SCORES = f"""SELECT source_id, CAST(100 - lost AS BIGINT) AS score, CASE WHEN critical THEN 'blocked' WHEN n = 0 THEN 'healthy' ELSE 'degraded' END AS status, CASE WHEN 100 - lost >= 90 THEN 'A' WHEN 100 - lost >= 75 THEN 'B' WHEN 100 - lost >= 60 THEN 'C' WHEN 100 - lost >= 40 THEN 'D' ELSE 'F' END AS grade
  FROM (SELECT s.source_id, least(coalesce(sum(points), 0), 100) AS lost, bool_or(coalesce(critical, false)) AS critical, count(code) AS n FROM {{slots}} s LEFT JOIN ({FACTORS}) f ON f.source_id = s.source_id GROUP BY ALL)"""


@query("a22_safety_factors", FACTORS)
def _(t):
    return ops.safety_factors(t("slots"))


@query("a21_source_safety_score", SCORES)
def _(t):
    return ops.safety_scores(t("slots"), ops.safety_factors(t("slots")))


@query("a19_fleet_scorecard", f"SELECT count(*) FILTER (status = 'healthy') AS ready, count(*) FILTER (status = 'blocked') AS blocked, count(*) FILTER (status = 'degraded') AS review, CAST(floor(sum(score) / count(*)) AS BIGINT) AS mean_score, CASE WHEN count(*) FILTER (status = 'blocked') > 0 THEN 'blocked' WHEN count(*) FILTER (status = 'degraded') > 0 THEN 'review' ELSE 'ready' END AS verdict FROM ({SCORES})")
def _(t):
    return ops.fleet_scorecard(ops.safety_scores(t("slots"), ops.safety_factors(t("slots"))))


@query("a31_slot_status_issues", """SELECT source_id, 'missing' AS issue FROM {slots} WHERE NOT slot_present UNION ALL SELECT source_id, 'plugin' FROM {slots} WHERE slot_present AND plugin <> 'pgoutput' UNION ALL SELECT source_id, 'invalidated' FROM {slots} WHERE slot_present AND invalidated
  UNION ALL SELECT source_id, wal_status FROM {slots} WHERE slot_present AND wal_status IN ('lost', 'unreserved') UNION ALL SELECT source_id, 'safe_wal' FROM {slots} WHERE slot_present AND safe_wal_bytes <= 0""")
def _(t):
    return ops.slot_issues(t("slots"))


@query("a30_wal_headroom", """SELECT source_id, seq, r AS bytes_per_second, CASE WHEN r > 0 AND safe_bytes > 0 THEN safe_bytes // r END AS headroom_seconds
  FROM (SELECT *, CASE WHEN lag(lsn) OVER w IS NOT NULL THEN greatest(lsn - lag(lsn) OVER w, 0) END // (seconds - lag(seconds) OVER w) AS r FROM {wal_samples} WINDOW w AS (PARTITION BY source_id ORDER BY seq)) WHERE r IS NOT NULL""")
def _(t):
    return ops.wal_headroom(t("wal_samples"))


@query("a32_table_preflight", "SELECT relation, s AS safe, CASE WHEN NOT s THEN 'no_identity' WHEN wide_columns > 0 THEN 'unchanged_values_possible' END AS note FROM (SELECT *, replica_identity IN ('full', 'index') OR (replica_identity = 'default' AND has_primary_key) AS s FROM {relations})")
def _(t):
    return ops.table_preflight(t("relations"))


@query("a34_schema_drift", "SELECT a.relation, a.fingerprint AS was, b.fingerprint AS \"is\" FROM {relations} a JOIN {relations_after} b ON a.relation = b.relation WHERE a.fingerprint <> b.fingerprint")
def _(t):
    return ops.schema_drift(t("relations"), t("relations_after"))


@query("a18_fleet_report", "SELECT count(*) AS flows, count(DISTINCT source_id) AS sources, count(DISTINCT dataset_id) AS datasets, count(*) FILTER (mode = 'strict') AS strict, count(*) FILTER (mode = 'partitioned') AS partitioned, CASE WHEN count(*) FILTER (lake_state = 'quarantined') > 0 THEN 'blocked' WHEN count(*) FILTER (lake_state = 'complete_with_gaps') > 0 THEN 'gaps' ELSE 'ready' END AS lake_verdict FROM {flows}")
def _(t):
    return ops.fleet_report(t("flows"))


@query("a20_identity_audit", "SELECT flow_id, count(*) AS n, string_agg(config, ',' ORDER BY config) AS configs FROM {flows} GROUP BY ALL HAVING count(*) > 1")
def _(t):
    return ops.identity_audit(t("flows"))


@query("a27_flow_health", """SELECT config AS flow_id, CASE WHEN quarantined > 0 OR validation = 'mismatch' THEN 'blocked' WHEN missing_partitions > 0 OR lag_bytes > 0 THEN 'degraded' ELSE 'healthy' END AS status,
  concat_ws(',', CASE WHEN quarantined > 0 THEN 'quarantine' END, CASE WHEN validation = 'mismatch' THEN 'validation' END, CASE WHEN missing_partitions > 0 THEN 'partitions' END, CASE WHEN lag_bytes > 0 THEN 'lag' END) AS issues FROM {flows}""")
def _(t):
    return ops.flow_health(t("flows").drop("flow_id").withColumnRenamed("config", "flow_id"))


@query("a33_transaction_boundary_status", "SELECT config AS flow_id, CASE WHEN durable > 0 AND applied >= durable AND quarantined = 0 AND missing_partitions = 0 THEN 'clean' ELSE 'open' END AS boundary FROM {flows}")
def _(t):
    return ops.boundary_status(t("flows").drop("flow_id").withColumnRenamed("config", "flow_id"))


@query("a38_checksum_status", "SELECT config, CASE WHEN validation = 'unknown' THEN 'unknown' WHEN validation = 'mismatch' THEN 'mismatch' ELSE 'match' END AS status FROM {flows}")
def _(t):
    a = F.when(F.col("validation") != "unknown", F.col("durable"))
    b = F.when(F.col("validation") == "mismatch", F.col("durable") + 1).otherwise(F.col("durable"))
    return t("flows").select("config", ops.checksum_status(a, b, F.lit(1), F.lit(1)).alias("status"))


@query("a36_queue_admission", "SELECT queue, seq, CASE WHEN count(*) OVER w <= 200 AND sum(size) OVER w <= 60000 THEN 'admitted' ELSE 'backpressure' END AS admission FROM {frames} WINDOW w AS (PARTITION BY queue ORDER BY seq ROWS UNBOUNDED PRECEDING)")
def _(t):
    return ops.queue_admission(t("frames"), 200, 60000).select("queue", "seq", "admission")


@query("t7_backpressure", "SELECT queue, count(*) FILTER (a) AS admitted FROM (SELECT queue, count(*) OVER w <= 200 AND sum(size) OVER w <= 60000 AS a FROM {frames} WINDOW w AS (PARTITION BY queue ORDER BY seq ROWS UNBOUNDED PRECEDING)) GROUP BY ALL")
def _(t):
    return ops.queue_admission(t("frames"), 200, 60000).groupBy("queue").agg(F.count_if(F.col("admission") == "admitted").alias("admitted"))


@query("a35_drain_batch_order", "SELECT queue, seq, CASE WHEN lsn < l THEN 'lsn_regression' ELSE 'repeated_boundary' END AS violation FROM (SELECT *, lag(lsn) OVER (PARTITION BY queue ORDER BY seq) AS l, row_number() OVER (PARTITION BY queue, boundary ORDER BY seq) AS k FROM {frames}) WHERE lsn < l OR k > 1")
def _(t):
    return ops.drain_violations(t("frames"))


@query("a37_validation_event", "SELECT event_id, 'digest' AS violation FROM {validations} WHERE digest = 'short' UNION ALL SELECT event_id, 'tables' FROM {validations} WHERE tables <= 0 UNION ALL SELECT event_id, 'rows' FROM {validations} WHERE rows < 0 UNION ALL SELECT event_id, 'watermark' FROM {validations} WHERE applied > durable")
def _(t):
    return ops.validation_violations(t("validations"))


@query("o7_latest_event", "SELECT flow_id, event_id, completed_ms FROM (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY completed_ms DESC, event_id DESC) AS k FROM {validations}) WHERE k = 1")
def _(t):
    return ops.latest_events(t("validations"))


@query("o6_unsafe_table_sample", "SELECT relation FROM {relations} WHERE NOT (replica_identity IN ('full', 'index') OR (replica_identity = 'default' AND has_primary_key)) ORDER BY relation LIMIT 5")
def _(t):
    return ops.table_preflight(t("relations")).where("NOT safe").select("relation").orderBy("relation").limit(5)


@query("o9_ready_transaction", "SELECT min(transaction_id) AS transaction_id FROM {txns}")
def _(t):
    return t("txns").agg(F.min("transaction_id").alias("transaction_id"))


_VALID = "CASE phase WHEN 'running' THEN (readiness IN ('ready', 'degraded') AND accepting_work) OR (readiness IN ('backpressured', 'blocked') AND NOT accepting_work) WHEN 'failed' THEN readiness = 'blocked' AND NOT accepting_work ELSE readiness = 'not_ready' AND NOT accepting_work END"


@query("r42_runtime_health", f"""SELECT event_id, 'state' AS violation FROM {{runtime}} WHERE NOT ({_VALID}) UNION ALL SELECT event_id, 'reason_code' FROM {{runtime}} WHERE reason_code = 'Bad Code'
  UNION ALL SELECT event_id, 'missing_reason' FROM {{runtime}} WHERE reason_code IS NULL AND readiness IN ('degraded', 'backpressured', 'blocked')""")
def _(t):
    return ops.health_violations(t("runtime")).select("event_id", "violation")


@query("r15_ddl_plan_decision", """SELECT event_id, c AS compatibility, CASE WHEN c = 'blocked_by_policy' THEN 'block' WHEN c = 'compatible' AND apply_mode = 'auto_safe' THEN 'auto_apply' WHEN c = 'compatible' AND apply_mode = 'staged_rollout' THEN 'stage_then_apply' WHEN c = 'compatible' OR apply_mode = 'manual_review' OR c = 'requires_mapping' THEN 'manual_review' ELSE 'block' END AS decision
  FROM (SELECT *, CASE WHEN kind IN ('add_nullable_column', 'widen_type', 'increase_varchar') THEN CASE WHEN configured THEN 'compatible' ELSE 'blocked_by_policy' END WHEN kind = 'add_table' THEN CASE WHEN allow_unknown THEN 'compatible' ELSE 'blocked_by_policy' END
    WHEN kind IN ('rename_column', 'rename_table', 'unknown') THEN 'requires_mapping' ELSE 'destructive_or_ambiguous' END AS c FROM {ddl_plan})""")
def _(t):
    rows = t("ddl_plan").withColumn("compatibility", ops.ddl_compatibility(F.col("kind"), F.col("configured"), F.col("allow_unknown")))
    return rows.select("event_id", "compatibility", ops.ddl_decision(F.col("apply_mode"), F.col("compatibility")).alias("decision"))


# -- scalar functions -----------------------------------------------------------------------------


@query("f1_parse_lsn", "SELECT event_id, coalesce(event_id % 7 NOT IN (3, 4, 5), false) AS valid, CASE WHEN event_id % 7 NOT IN (3, 4, 5) THEN lsn END AS number FROM {lsn_texts}")
def _(t):
    return t("lsn_texts").select("event_id", lsn.is_lsn(F.col("text")).alias("valid"), lsn.parse(F.col("text")).cast("long").alias("number"))


@query("f2_parse_lsn_lenient", "SELECT event_id, CASE WHEN event_id % 7 NOT IN (3, 4, 5) THEN lsn ELSE 0 END AS number FROM {lsn_texts}")
def _(t):
    return t("lsn_texts").select("event_id", lsn.parse_lenient(F.col("text")).cast("long").alias("number"))


@query("f3_format_lsn", "SELECT transaction_id, upper(to_hex(lsn >> 32)) || '/' || upper(to_hex(lsn & 4294967295)) AS text FROM {txns}")
def _(t):
    return t("txns").select("transaction_id", lsn.fmt(F.col("lsn")).alias("text"))


@query("f3_canonical_lsn", "SELECT event_id, upper(to_hex(lsn >> 32)) || '/' || upper(to_hex(lsn & 4294967295)) AS text FROM {lsn_texts} WHERE event_id % 7 NOT IN (3, 4, 5)")
def _(t):
    return t("lsn_texts").select("event_id", lsn.canonical(F.col("text")).alias("text")).where("text IS NOT NULL")


@query("f4_lsn_diff_bytes", "SELECT flow_id, seq, greatest(durable - applied, 0) AS bytes FROM {checkpoint_updates}")
def _(t):
    return t("checkpoint_updates").select("flow_id", "seq", lsn.behind(F.col("durable"), F.col("applied")).alias("bytes"))


@query("f5_timestamp_millis", "SELECT transaction_id, strftime(make_timestamp(commit_timestamp_ms * 1000), '%Y-%m-%dT%H:%M:%S') AS text FROM {txns}")
def _(t):
    return t("txns").select("transaction_id", F.date_format(F.timestamp_millis("commit_timestamp_ms"), "yyyy-MM-dd'T'HH:mm:ss").alias("text"))


@query("f6_split_lsn", "SELECT transaction_id, split_part(commit_lsn, '/', 1) AS high, split_part(commit_lsn, '/', 2) AS low FROM {txns}")
def _(t):
    half = lambda k: F.try_element_at(F.split("commit_lsn", "/"), F.lit(k))
    return t("txns").select("transaction_id", half(1).alias("high"), half(2).alias("low"))


@query("f8_identifier", "SELECT c_custkey, CASE WHEN x = '' THEN 'unnamed' ELSE x END AS name FROM (SELECT c_custkey, trim(regexp_replace(lower('#' || c_name || ' ' || c_mktsegment || '!'), '[^a-z0-9]', '_', 'g'), '_') AS x FROM {customer})")
def _(t):
    return t("customer").select("c_custkey", names.identifier(F.concat(F.lit("#"), "c_name", F.lit(" "), "c_mktsegment", F.lit("!"))).alias("name"))


@query("f9_epoch_slug", "SELECT DISTINCT regexp_replace(lower(c_mktsegment || ' x'), '[^a-z0-9]', '-', 'g') AS slug FROM {customer}")
def _(t):
    return t("customer").select(names.slug(F.concat("c_mktsegment", F.lit(" x"))).alias("slug")).distinct()


@query("f10_padded", "SELECT transaction_id, lpad(CAST(lsn % 1000 AS VARCHAR), 4, '0') AS four, lpad(lower(to_hex(lsn)), 16, '0') AS sixteen FROM {txns}")
def _(t):
    return t("txns").select("transaction_id", F.lpad((F.col("lsn") % 1000).cast("string"), 4, "0").alias("four"), F.format_string("%016x", "lsn").alias("sixteen"))


@query("f11_md5_60", "SELECT transaction_id, CAST('0x' || substr(md5(transaction_id), 1, 15) AS BIGINT) AS hash FROM {txns}")
def _(t):
    return t("txns").select("transaction_id", hashing.md5_60(F.col("transaction_id")).alias("hash"))


@query("f11_xxh3_64")
def _(t):
    return t("txns").select("transaction_id", hashing.xxh3_64("transaction_id").alias("hash"))


@query("f12_sha256", "SELECT transaction_id, sha256(transaction_id) AS digest FROM {txns}")
def _(t):
    return t("txns").select("transaction_id", F.sha2("transaction_id", 256).alias("digest"))


@query("f13_crc32")
def _(t):
    return t("txns").select("transaction_id", F.crc32("transaction_id").alias("crc"))


@query("f14_canonical_json")
def _(t):
    return t("events").select("event_id", hashing.canonical_json("props").alias("canonical"))


@query("f15_json_payload", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM {events}")
def _(t):
    return t("events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("f16_hex", "SELECT transaction_id, hex(transaction_id) AS encoded, transaction_id AS decoded FROM {txns}")
def _(t):
    h = F.hex(F.encode("transaction_id", "UTF-8"))
    return t("txns").select("transaction_id", h.alias("encoded"), F.decode(F.unhex(h), "UTF-8").alias("decoded"))


@query("f17_digest_uuid", "SELECT transaction_id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(d, 17, 1))::BIGINT % 4 + 1 AS INTEGER), 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS uuid FROM (SELECT transaction_id, sha256(transaction_id) AS d FROM {txns})")
def _(t):
    return t("txns").select("transaction_id", hashing.digest_uuid(F.sha2("transaction_id", 256)).alias("uuid"))


@query("f19_xor_fold", "SELECT relation, bit_xor(envelope_checksum) AS folded FROM {changes} GROUP BY ALL")
def _(t):
    return t("changes").groupBy("relation").agg(F.bit_xor("envelope_checksum").alias("folded"))


@query("f20_ratio_bp", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey * 10000 // (o_orderkey % 7) END AS ratio FROM {orders}")
def _(t):
    return t("orders").select("o_orderkey", names.ratio_bp(F.col("o_custkey"), F.col("o_orderkey") % 7).alias("ratio"))


@query("f21_parse_lsn_or_raise_error", "SELECT transaction_id, lsn AS number FROM {txns}")
def _(t):
    return t("txns").select("transaction_id", lsn.parse_strict(F.col("commit_lsn")).cast("long").alias("number"))


@query("f22_idempotency_key", "SELECT idempotency_key FROM {changes}")
def _(t):
    return t("changes").select(names.idempotency_key(F.col("source_id"), F.col("commit_lsn"), F.col("transaction_id"), F.col("total_order")).alias("idempotency_key"))


@query("f22_boundary_key", "SELECT source_id || ':postgres:retail:' || transaction_id || ':' || commit_lsn AS boundary FROM {txns}")
def _(t):
    return t("txns").select(names.boundary_key(*[F.col(c) for c in ("source_id", "database_id", "dataset_id", "transaction_id")], lsn.canonical(F.col("commit_lsn"))).alias("boundary"))


@query("f23_redaction", "SELECT transaction_id, 'postgres://app:***@' || source_id || '/db' AS url, '&lt;' || source_id || '&gt;' AS html FROM {txns}")
def _(t):
    url = F.concat(F.lit("postgres://app:secret@"), "source_id", F.lit("/db"))
    return t("txns").select("transaction_id", names.redacted_url(url).alias("url"), names.escaped_html(F.concat(F.lit("<"), "source_id", F.lit(">"))).alias("html"))


# -- sources --------------------------------------------------------------------------------------


@query("s2_parse_test_decoding", "SELECT relation, operation, record_key, CAST(amount AS VARCHAR) AS amount, status FROM {changes} WHERE operation <> 'delete'")
def _(t):
    line = F.concat(
        F.lit("table "), "relation", F.lit(": "), F.upper("operation"), F.lit(": id[text]:'"), "record_key", F.lit("' amount[bigint]:"), F.col("amount").cast("string"), F.lit(" status[text]:'"), "status", F.lit("'")
    )
    parsed = test_decoding.parse(t("changes").where("operation <> 'delete'").select(line.alias("line")), "line")
    value = lambda k: F.filter("columns", lambda c: c["name"] == k)[0]["value"]
    return parsed.select("relation", "operation", value("id").alias("record_key"), value("amount").alias("amount"), value("status").alias("status"))
