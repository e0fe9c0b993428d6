"""Queries of the raw log and the epoch ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.functions import hashing
from ledgerlake.operators import lake
from ledgerlake.plans.registry import query
from ledgerlake.plans.synth import EPOCHS
from ledgerlake.storage import staged

_ONE = "SELECT epoch_id, {keys}source_id, transaction_id, lsn, min(commit_lsn) AS commit_lsn, count(*) AS n, min(envelope_checksum) AS sum FROM {{changes}} GROUP BY epoch_id, {keys}source_id, transaction_id, lsn"
ONE, BY_TABLE = _ONE.format(keys=""), _ONE.format(keys="relation, ")
SOURCES = f"SELECT epoch_id, source_id, count(*) AS transaction_count, CAST(sum(n) AS BIGINT) AS change_count, bit_xor(sum) AS checksum_rollup, arg_min(commit_lsn, lsn) AS first_lsn, arg_max(commit_lsn, lsn) AS last_lsn FROM ({ONE}) GROUP BY ALL"
TABLES = f"SELECT epoch_id, relation, count(*) AS transaction_count, CAST(sum(n) AS BIGINT) AS change_count, bit_xor(sum) AS checksum_rollup FROM ({BY_TABLE}) GROUP BY ALL"
PARTITIONS = """SELECT epoch_id, source_id, partition_id, count(*) AS transaction_count, CAST(sum(event_count) AS BIGINT) AS event_count, bit_xor(partition_checksum) AS checksum_rollup,
  arg_min(commit_lsn, lsn) AS first_lsn, arg_max(commit_lsn, lsn) AS last_lsn FROM {manifest_partitions} GROUP BY ALL"""
TOTALS = f"SELECT epoch_id, count(*) AS transaction_count, CAST(sum(n) AS BIGINT) AS change_count, bit_xor(sum) AS checksum_rollup FROM ({ONE}) GROUP BY ALL"
CLASSIFIED = """SELECT source_id, transaction_id, lsn, arrival_seq, CASE WHEN row_number() OVER k = 1 THEN 'admitted' WHEN envelope_checksum = first_value(envelope_checksum) OVER k THEN 'duplicate' ELSE 'conflict' END AS disposition
  FROM {arrivals} WINDOW k AS (PARTITION BY source_id, database_id, dataset_id, transaction_id, lsn ORDER BY arrival_seq)"""


@query("a1_epoch_totals", TOTALS)
def _(t):
    return lake.epoch_totals(t("changes"))


@query("a2_epoch_sources", SOURCES)
def _(t):
    return lake.epoch_sources(t("changes"))


@query("a3_epoch_tables", TABLES)
def _(t):
    return lake.epoch_tables(t("changes"))


@query("a3_epoch_tables_per_change", "SELECT epoch_id, relation, count(DISTINCT (source_id, transaction_id, lsn)) AS transaction_count, count(*) AS change_count, bit_xor(envelope_checksum) AS checksum_rollup FROM {changes} GROUP BY ALL")
def _(t):
    return lake.epoch_tables(t("changes"), per_change=True)


@query("a4_epoch_partitions", PARTITIONS)
def _(t):
    return lake.epoch_partitions(t("manifest_partitions"))


FNV = """list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(range(0, strlen(source_id)), lambda k: CAST(ascii(source_id[k + 1]) AS BIGINT))), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"""
FILES = f"""SELECT epoch_id, relation, CAST(bucket AS INTEGER) AS source_bucket, string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS source_ids, count(*) AS transaction_count, CAST(sum(n) AS BIGINT) AS change_count, bit_xor(sum) AS checksum_rollup,
  arg_min(commit_lsn, lsn) AS first_lsn, arg_max(commit_lsn, lsn) AS last_lsn, 'retail__' || replace(relation, '.', '__') || '__raw_cdc/epoch_id=' || epoch_id || '/source_bucket=' || lpad(CAST(bucket AS VARCHAR), 4, '0') || '/part-00000.parquet' AS object_key
  FROM (SELECT *, {FNV} % 16 AS bucket FROM ({BY_TABLE})) GROUP BY epoch_id, relation, bucket"""


@query("a5_data_files", FILES)
def _(t):
    return lake.data_files(t("changes"))


@query("a6_lsn_window", "SELECT relation, arg_min(commit_lsn, lsn) AS first_lsn, arg_max(commit_lsn, lsn) AS last_lsn FROM {changes} GROUP BY ALL")
def _(t):
    return t("changes").groupBy("relation").agg(*lake.lsn_window())


@query("a7_committer_topology", f"SELECT epoch_id, relation, count(*) AS file_count, count(DISTINCT source_bucket) AS bucket_count FROM ({FILES}) GROUP BY ALL")
def _(t):
    return lake.committers(lake.data_files(t("changes")))


OBSERVED = f"SELECT * FROM ({SOURCES}) WHERE epoch_id = '{EPOCHS[0]}'"
COMPLETION = f"""SELECT r.source_id, CASE WHEN q.source_id IS NOT NULL THEN 'quarantined' WHEN o.source_id IS NULL THEN 'missing' ELSE 'complete' END AS state, coalesce(transaction_count, 0) AS transaction_count,
  coalesce(change_count, 0) AS change_count, coalesce(checksum_rollup, 0) AS checksum_rollup FROM {{required}} r LEFT JOIN ({OBSERVED}) o ON o.source_id = r.source_id LEFT JOIN {{quarantined}} q ON q.source_id = r.source_id"""


def _completion(t):
    observed = lake.epoch_sources(t("changes").where(F.col("epoch_id") == EPOCHS[0]))
    return lake.source_completion(observed, t("required"), t("quarantined"))


@query("j8_source_completion", COMPLETION)
def _(t):
    return _completion(t)


@query("u3_observed_and_gap_sources", f"SELECT source_id, 'observed' AS kind FROM ({OBSERVED}) UNION ALL SELECT source_id, 'gap' FROM {{required}} WHERE source_id NOT IN (SELECT source_id FROM ({OBSERVED}))")
def _(t):
    seen = t("changes").where(F.col("epoch_id") == EPOCHS[0]).select("source_id").distinct()
    gaps = t("required").join(seen, "source_id", "left_anti")
    return seen.withColumn("kind", F.lit("observed")).unionByName(gaps.withColumn("kind", F.lit("gap")))


@query("u4_required_and_window_sources", "SELECT source_id FROM {required} UNION SELECT source_id FROM {changes}")
def _(t):
    return t("required").select("source_id").union(t("changes").select("source_id")).distinct()


@query("a8_source_completeness_counts", f"SELECT count(*) AS required_source_count, count(*) FILTER (state = 'complete') AS complete_source_count, count(*) FILTER (state = 'missing') AS missing_source_count, count(*) FILTER (state = 'quarantined') AS quarantined_source_count FROM ({COMPLETION})")
def _(t):
    return lake.completeness_counts(_completion(t))


@query("a9_partition_evidence", f"""SELECT source_id, count(*) AS partition_count, arg_min(first_lsn, n1) AS first_lsn, arg_max(last_lsn, n2) AS last_lsn, CAST(sum(transaction_count) AS BIGINT) AS transaction_count, CAST(sum(event_count) AS BIGINT) AS event_count, bit_xor(checksum_rollup) AS checksum_xor
  FROM (SELECT p.*, n1, n2 FROM ({PARTITIONS}) p JOIN (SELECT epoch_id, source_id, partition_id, min(lsn) AS n1, max(lsn) AS n2 FROM {{manifest_partitions}} GROUP BY ALL) USING (epoch_id, source_id, partition_id)) GROUP BY source_id""")
def _(t):
    p = t("manifest_partitions").groupBy("epoch_id", "source_id", "partition_id").agg(
        F.count("*").alias("transaction_count"), F.sum("event_count").alias("event_count"), F.bit_xor("partition_checksum").alias("rollup"), *lake.lsn_window(), F.min("lsn").alias("n1"), F.max("lsn").alias("n2")
    )
    return p.groupBy("source_id").agg(
        F.count("*").alias("partition_count"), F.min_by("first_lsn", "n1").alias("first_lsn"), F.max_by("last_lsn", "n2").alias("last_lsn"), F.sum("transaction_count").alias("transaction_count"),
        F.sum("event_count").alias("event_count"), F.bit_xor("rollup").alias("checksum_xor"),
    )


STATE = """CASE WHEN quarantined_source_count > 0 THEN 'quarantined' WHEN missing_source_count = 0 THEN 'complete' WHEN policy = 'publish_with_gaps' THEN 'complete_with_gaps' WHEN policy = 'quarantine_on_gap' THEN 'quarantined' ELSE 'open' END"""


def _summary_sql(quarantined: str, policy: str) -> str:
    return f"""SELECT *, CASE WHEN state IN ('complete', 'complete_with_gaps') THEN 'match' ELSE 'pending' END AS checksum_status, 'verify:retail:' || epoch_id || ':' || lpad(lower(to_hex(checksum_rollup)), 16, '0') AS verification_id
    FROM (SELECT *, {STATE} AS state FROM (SELECT e.epoch_id, transaction_count, change_count, checksum_rollup, count(*) AS required_source_count, count(*) FILTER (q.source_id IS NULL AND s.source_id IS NOT NULL) AS complete_source_count,
      count(*) FILTER (q.source_id IS NULL AND s.source_id IS NULL) AS missing_source_count, count(q.source_id) AS quarantined_source_count, '{policy}' AS policy
    FROM ({TOTALS}) e CROSS JOIN {{required}} r LEFT JOIN (SELECT DISTINCT epoch_id, source_id FROM {{changes}}) s ON s.epoch_id = e.epoch_id AND s.source_id = r.source_id LEFT JOIN {{{quarantined}}} q ON q.source_id = r.source_id GROUP BY ALL))"""


def _summary(t, bad: str, policy: str):
    """The epochs' summary; totals and seen sources come from one aggregate of the change log."""
    return lake.epoch_summary(staged(lake.transactions(t("changes")), "transactions"), t("required"), t(bad), policy)


@query("r25_epoch_state", _summary_sql("quarantined", "wait_all_required"))
def _(t):
    return _summary(t, "quarantined", "wait_all_required")


@query("r28_epoch_summary", _summary_sql("nobody", "publish_with_gaps"))
def _(t):
    return _summary(t, "nobody", "publish_with_gaps")


@query("t3_straggler_policy", _summary_sql("nobody", "quarantine_on_gap"))
def _(t):
    return _summary(t, "nobody", "quarantine_on_gap")


_EXPECTED = "CASE WHEN quarantined_source_count > 0 THEN 'quarantined' WHEN missing_source_count = 0 THEN 'complete' WHEN policy = 'publish_with_gaps' THEN 'complete_with_gaps' ELSE 'open' END"


def _decision_sql(accept: bool) -> str:
    gaps = "" if accept else "WHEN state = 'complete_with_gaps' THEN 'gaps_not_accepted' "
    return f"""SELECT epoch_id, CASE reason WHEN 'none' THEN 'consume' ELSE 'hold' END AS decision, reason FROM (SELECT epoch_id, CASE WHEN NOT (length(manifest_digest) = 64 AND regexp_full_match(manifest_digest, '[0-9a-f]+')) THEN 'manifest_digest' WHEN misnamed THEN 'verification_identity' WHEN verification_epoch_id <> epoch_id THEN 'boundary' WHEN complete_source_count + missing_source_count + quarantined_source_count <> required_source_count THEN 'rollup'
      WHEN state = 'complete' AND missing_source_count > 0 THEN 'completeness' WHEN state <> {_EXPECTED} THEN 'state' WHEN transaction_count = 0 THEN 'empty' WHEN verified_required_source_count <> required_source_count OR verified_missing_source_count <> missing_source_count THEN 'verification_counts' WHEN state NOT IN ('complete', 'complete_with_gaps') THEN 'not_consumable_state' {gaps}WHEN checksum_status <> 'match' THEN 'verification' ELSE 'none' END AS reason FROM {{epoch_rows}})"""


def _decided(t, accept: bool):
    right = lake.verification_id(F.lit("retail"), F.col("epoch_id"), F.col("checksum_rollup"))
    rows = t("epoch_rows").withColumn("verification_id", F.when(F.col("misnamed"), F.concat(right, F.lit("0"))).otherwise(right))
    return lake.consumer_decision(rows, accept_gaps=accept).select("epoch_id", "decision", "reason")


@query("r24_consumer_gate", _decision_sql(False))
def _(t):
    return _decided(t, False)


@query("r24_consumer_gate_with_gaps", _decision_sql(True))
def _(t):
    return _decided(t, True)


@query("r31_quarantine_rows", f"SELECT '{EPOCHS[0]}' AS epoch_id, source_id, CASE WHEN transaction_count = 0 THEN 'source_gap_quarantined' ELSE 'source_evidence_quarantined' END AS reason FROM ({COMPLETION}) WHERE state = 'quarantined'")
def _(t):
    return lake.quarantine_rows(_completion(t), EPOCHS[0])


@query("w8_first_seen_dedup", CLASSIFIED)
def _(t):
    return lake.classify_arrivals(t("arrivals")).select("source_id", "transaction_id", "lsn", "arrival_seq", "disposition")


@query("r26_admitted", f"SELECT source_id, transaction_id, lsn, arrival_seq FROM ({CLASSIFIED}) WHERE disposition = 'admitted'")
def _(t):
    return lake.admitted(t("arrivals")).select("source_id", "transaction_id", "lsn", "arrival_seq")


@query("r26_conflicts", "SELECT source_id, database_id, dataset_id, transaction_id, lsn, count(*) AS arrivals, 'conflicting_checksum' AS reason FROM {arrivals} GROUP BY ALL HAVING min(envelope_checksum) <> max(envelope_checksum)")
def _(t):
    return lake.conflicting_keys(t("arrivals"))


@query("a17_duplicate_replay_evidence", f"SELECT count(*) FILTER (disposition = 'admitted') AS unique_transactions, count(*) FILTER (disposition = 'duplicate') AS duplicate_transactions, count(*) FILTER (disposition = 'conflict') AS conflicts, count(*) FILTER (disposition = 'conflict') = 0 AS replay_safe FROM ({CLASSIFIED})")
def _(t):
    return lake.replay_evidence(t("arrivals"))


@query("j15_already_applied", "SELECT transaction_id, arrival_seq FROM {arrivals} a WHERE NOT EXISTS (SELECT 1 FROM {txns} x WHERE x.transaction_id = a.transaction_id AND x.lsn = a.lsn AND x.source_id = a.source_id AND x.lsn % 32 = 0)")
def _(t):
    return lake.not_applied(t("arrivals"), t("txns").where("lsn % 32 = 0")).select("transaction_id", "arrival_seq")


@query("p5_scope_filter", "SELECT source_id, count(*) AS in_scope FROM {changes} WHERE dataset_id = 'retail' AND source_id IN (SELECT source_id FROM {required} WHERE source_id < 'store-005') GROUP BY ALL")
def _(t):
    rows = lake.admission(t("changes"), "retail", t("required").where("source_id < 'store-005'"))
    return rows.where("admission = 'admitted'").groupBy("source_id").agg(F.count("*").alias("in_scope"))


@query("p5_admission_counts", "SELECT CASE WHEN dataset_id <> 'retail' THEN 'skipped' WHEN source_id NOT IN (SELECT source_id FROM {required} WHERE source_id < 'store-005') THEN 'out_of_scope' ELSE 'admitted' END AS admission, count(*) AS n FROM {sent_txns} GROUP BY ALL")
def _(t):
    return lake.admission(t("sent_txns"), "retail", t("required").where("source_id < 'store-005'")).groupBy("admission").agg(F.count("*").alias("n"))


LINES = f"""SELECT epoch_id, 0 AS rank, source_id AS key, 0 AS number, 'source=' || concat_ws('|', epoch_id, source_id, first_lsn, last_lsn, transaction_count, change_count, checksum_rollup) || chr(10) AS line FROM ({SOURCES})
  UNION ALL SELECT epoch_id, 1, relation, 0, 'table=' || concat_ws('|', epoch_id, relation, transaction_count, change_count, checksum_rollup) || chr(10) FROM ({TABLES})
  UNION ALL SELECT epoch_id, 2, source_id, partition_id, 'partition=' || concat_ws('|', epoch_id, source_id, partition_id, first_lsn, last_lsn, transaction_count, event_count, checksum_rollup) || chr(10) FROM ({PARTITIONS})"""


@query("r30_epoch_manifest_digest", f"SELECT epoch_id, sha256('raw_cdc_epoch_manifest_v1' || chr(10) || string_agg(line, '' ORDER BY rank, key, number)) AS manifest_digest FROM ({LINES}) GROUP BY ALL")
def _(t):
    one = staged(lake.transactions(t("changes")), "transactions")
    return lake.manifest_digest(lake.epoch_sources(one), lake.epoch_tables(one), lake.epoch_partitions(t("manifest_partitions")))


_F = lambda n, v: f"'{n}:' || strlen({v}) || ':' || {v} || chr(10)"
_BLOCK = f"{_F('source', 's')} || {_F('required', 'r')} || {_F('start_lsn', 'a')} || {_F('end_lsn', 'b')}"


@query("r29_deterministic_epoch_id", f"""SELECT 'epoch-retail-' || substr(sha256({_F("dataset", "'retail'")} || {_F("policy", "'publish_with_gaps:30000'")} || string_agg({_BLOCK}, '' ORDER BY s)), 1, 16) AS epoch_id
  FROM (SELECT coalesce(q.source_id, o.source_id) AS s, CASE WHEN q.source_id IS NULL THEN 'false' ELSE 'true' END AS r, coalesce(first_lsn, '<none>') AS a, coalesce(last_lsn, '<none>') AS b FROM {{required}} q FULL JOIN ({OBSERVED}) o ON o.source_id = q.source_id)""")
def _(t):
    windows = lake.epoch_sources(t("changes").where(F.col("epoch_id") == EPOCHS[0])).select("source_id", F.col("first_lsn").alias("start_lsn"), F.col("last_lsn").alias("end_lsn"))
    return lake.deterministic_epoch_id("retail", "publish_with_gaps:30000", t("required"), windows)


RAW = """SELECT source_id, relation, transaction_id, upper(to_hex((lsn - 8) >> 32)) || '/' || upper(to_hex((lsn - 8) & 4294967295)) AS begin_lsn, commit_lsn, total_order, operation, record_key, idempotency_key, envelope_checksum, CAST(partition_id AS VARCHAR) AS partition_key,
  CASE WHEN operation IN ('update', 'delete') THEN CAST(to_json([{'name': 'id', 'value': {'kind': 'text', 'value': record_key}}]) AS VARCHAR) ELSE '[]' END AS payload_before_json,
  CASE WHEN operation = 'delete' THEN '[]' ELSE CAST(to_json([{'name': 'id', 'value': {'kind': 'text', 'value': record_key}}, {'name': 'amount', 'value': {'kind': 'text', 'value': CAST(amount AS VARCHAR)}}, {'name': 'status', 'value': {'kind': 'text', 'value': status}}]) AS VARCHAR) END AS payload_after_json FROM {changes}"""


@query("p4_raw_cdc_row_intent", RAW)
def _(t):
    return lake.raw_rows(t("changes")).select(
        "source_id", "relation", "transaction_id", "begin_lsn", "commit_lsn", "total_order", "operation", "record_key", "idempotency_key", "envelope_checksum", "partition_key", "payload_before_json", "payload_after_json"
    )


@query("s11_raw_file_plan_violations", f"SELECT epoch_id, relation, source_bucket, 'row_count' AS violation FROM ({FILES}) WHERE relation = 'public.orders' AND source_bucket % 2 = 0")
def _(t):
    raw = lake.raw_rows(t("changes"))
    files = lake.data_files(t("changes")).withColumn("change_count", F.col("change_count") + F.when((F.col("relation") == "public.orders") & (F.col("source_bucket") % 2 == 0), 1).otherwise(0))
    return lake.file_plan_violations(raw, files)


OPS = """SELECT epoch_id, relation, record_key, idempotency_key, CAST(row_number() OVER (PARTITION BY idempotency_key ORDER BY k) - 1 AS INTEGER) AS step, target, action FROM (
  SELECT *, 1 AS k, 'raw' AS target, 'append' AS action FROM {changes} UNION ALL SELECT *, 2, 'current', CASE operation WHEN 'delete' THEN 'delete' ELSE 'upsert' END FROM {changes}
  UNION ALL SELECT *, 3, 'scd2', 'close' FROM {changes} WHERE operation IN ('update', 'delete') UNION ALL SELECT *, 4, 'scd2', 'insert' FROM {changes} WHERE operation IN ('insert', 'update'))"""


@query("r19_plan_commit", OPS)
def _(t):
    return lake.commit_operations(t("changes"))


@query("u5_write_operations", f"SELECT epoch_id, target, action, count(*) AS operations FROM ({OPS}) GROUP BY ALL")
def _(t):
    return lake.commit_operations(t("changes")).groupBy("epoch_id", "target", "action").agg(F.count("*").alias("operations"))


STEPS = f"""SELECT epoch_id, CAST(row_number() OVER (PARTITION BY epoch_id ORDER BY object_key) + 9 AS INTEGER) AS sequence, object_key AS step FROM ({FILES})
  UNION ALL SELECT epoch_id, CAST(greatest(100, (count(*) + 10 + 9) // 10 * 10) + k * 10 AS INTEGER), step FROM ({FILES}) CROSS JOIN (VALUES (0, 'epoch_sources'), (1, 'epoch_tables'), (2, 'epoch_partitions'), (3, 'quarantine'), (4, 'verification'), (5, 'epochs')) v(k, step) GROUP BY epoch_id, k, step"""


@query("r35_commit_steps", STEPS)
def _(t):
    return lake.commit_steps(lake.data_files(t("changes")))


@query("j11_commit_receipts", f"""SELECT object_key, CASE WHEN source_bucket % 3 = 0 THEN 'missing' WHEN source_bucket % 3 = 1 THEN 'committed' ELSE 'mismatched' END AS status FROM ({FILES}) UNION ALL SELECT 'raw/unknown.parquet', 'unexpected'""")
def _(t):
    files = lake.data_files(t("changes"))
    receipts = files.where("source_bucket % 3 <> 0").select("object_key", (F.col("change_count") + F.when(F.col("source_bucket") % 3 == 2, 1).otherwise(0)).alias("record_count"))
    extra = t.spark.range(1).select(F.lit("raw/unknown.parquet").alias("object_key"), F.lit(1).cast("long").alias("record_count"))
    return lake.receipts_status(files, receipts.unionByName(extra))


@query("r36_commit_ready", f"SELECT epoch_id, count(*) AS planned, count(*) FILTER (source_bucket % 3 <> 0) AS committed, count(*) FILTER (source_bucket % 3 = 0) = 0 AS ready FROM ({FILES}) GROUP BY ALL")
def _(t):
    files = lake.data_files(t("changes"))
    receipts = files.where("source_bucket % 3 <> 0").select("object_key", F.lit(1).alias("got"))
    return files.join(receipts, "object_key", "left").groupBy("epoch_id").agg(F.count("*").alias("planned"), F.count("got").alias("committed"), (F.count_if(F.col("got").isNull()) == 0).alias("ready"))


@query("j12_planned_and_completed_files", f"SELECT object_key, 'not_completed' AS difference FROM ({FILES}) WHERE source_bucket % 4 = 1 UNION ALL SELECT 'raw/other.parquet', 'not_planned'")
def _(t):
    files = lake.data_files(t("changes")).select("object_key", "source_bucket")
    done = files.where("source_bucket % 4 <> 1").select("object_key", F.lit(1).alias("done")).unionByName(t.spark.range(1).select(F.lit("raw/other.parquet").alias("object_key"), F.lit(1).alias("done")))
    joined = files.join(done, "object_key", "full_outer")
    return joined.where("source_bucket IS NULL OR done IS NULL").select("object_key", F.when(F.col("done").isNull(), "not_completed").otherwise("not_planned").alias("difference"))


#: Ledger rows with every fault that their check tells: by source, relation and partition.
_FAULTY_SOURCES = f"""SELECT epoch_id, CASE source_id WHEN 'store-002' THEN 'store-002 ' ELSE source_id END AS source_id, transaction_count, change_count, checksum_rollup, CASE source_id WHEN 'store-003' THEN last_lsn ELSE first_lsn END AS first_lsn,
  CASE source_id WHEN 'store-003' THEN first_lsn WHEN 'store-004' THEN '0/0' WHEN 'store-005' THEN 'nonsense' ELSE last_lsn END AS last_lsn FROM ({SOURCES}) WHERE source_id <> 'store-001' UNION ALL SELECT epoch_id, source_id, 0, 0, 0, first_lsn, last_lsn FROM ({SOURCES}) WHERE source_id = 'store-006' UNION ALL SELECT 'epoch-x', source_id, 0, 0, 0, first_lsn, last_lsn FROM ({SOURCES}) WHERE source_id = 'store-007' AND epoch_id = '{EPOCHS[0]}'"""
_FAULTY_TABLES = f"SELECT epoch_id, relation, change_count FROM ({TABLES}) UNION ALL SELECT epoch_id, relation, 1 FROM ({TABLES}) WHERE relation = 'public.orders' UNION ALL SELECT epoch_id, '', 0 FROM ({TABLES}) WHERE relation = 'public.orders'"
_FAULTY_PARTITIONS = f"SELECT epoch_id, source_id, partition_id, event_count, first_lsn, last_lsn FROM ({PARTITIONS}) UNION ALL SELECT epoch_id, source_id, partition_id, 0, first_lsn, last_lsn FROM ({PARTITIONS}) WHERE source_id = 'store-003' AND partition_id = 3"
_PARSED = "CASE WHEN regexp_full_match({0}, '[0-9A-F]{{1,8}}/[0-9A-F]{{1,8}}') THEN CAST('0x' || split_part({0}, '/', 1) AS BIGINT) * 4294967296 + CAST('0x' || split_part({0}, '/', 2) AS BIGINT) END".format


def _ledger_sql(kind: str, rows: str, key: str, window: bool) -> str:
    name = f"'{kind}:' || {key}"
    first = key.split(" ")[0]
    parts = [
        f"SELECT epoch_id, 'duplicate_row' AS violation, {name} AS subject FROM ({rows}) GROUP BY ALL HAVING count(*) > 1", f"SELECT epoch_id, 'unclean_field', {name} FROM ({rows}) WHERE {first} = '' OR trim({first}) <> {first}",
        f"SELECT epoch_id, 'epoch_boundary', {name} FROM ({rows}) WHERE epoch_id NOT IN (SELECT epoch_id FROM {{changes}})",
    ]
    if window:
        a, b = _PARSED("first_lsn"), _PARSED("last_lsn")
        parts.append(f"SELECT epoch_id, 'lsn_window', {name} FROM ({rows}) WHERE NOT coalesce({a} > 0 AND {a} <= {b}, false)")
    return " UNION ALL ".join(parts)


@query("p12_epoch_metadata_violations", f"""{_ledger_sql('source', _FAULTY_SOURCES, 'source_id', True)} UNION ALL {_ledger_sql('table', _FAULTY_TABLES, 'relation', False)} UNION ALL {_ledger_sql('partition', _FAULTY_PARTITIONS, "source_id || ':' || partition_id", True)}
  UNION ALL SELECT DISTINCT epoch_id, 'orphan_partition', source_id FROM ({_FAULTY_PARTITIONS}) p WHERE NOT EXISTS (SELECT 1 FROM ({_FAULTY_SOURCES}) s WHERE s.epoch_id = p.epoch_id AND s.source_id = p.source_id)
  UNION ALL SELECT epoch_id, 'rollup', w FROM (SELECT e.epoch_id, unnest([CASE WHEN s.t <> e.transaction_count THEN 'source:transaction_count' END, CASE WHEN s.c <> e.change_count THEN 'source:change_count' END, CASE WHEN s.x <> e.checksum_rollup THEN 'source:checksum_rollup' END, CASE WHEN k.c <> e.change_count THEN 'table:change_count' END, CASE WHEN p.c <> e.change_count THEN 'partition:change_count' END]) AS w
    FROM ({TOTALS}) e JOIN (SELECT epoch_id, sum(transaction_count) AS t, sum(change_count) AS c, bit_xor(checksum_rollup) AS x FROM ({_FAULTY_SOURCES}) GROUP BY ALL) s USING (epoch_id) JOIN (SELECT epoch_id, sum(change_count) AS c FROM ({_FAULTY_TABLES}) GROUP BY ALL) k USING (epoch_id) JOIN (SELECT epoch_id, sum(event_count) AS c FROM ({_FAULTY_PARTITIONS}) GROUP BY ALL) p USING (epoch_id)) WHERE w IS NOT NULL""")
def _(t):
    one = staged(lake.transactions(t("changes")), "transactions")
    whole, zero = lake.epoch_sources(one), F.lit(0).cast("long")
    source, none = F.col("source_id"), {"transaction_count": zero, "change_count": zero, "checksum_rollup": zero}
    swapped = {"first_lsn": F.when(source == "store-003", F.col("last_lsn")).otherwise(F.col("first_lsn")), "last_lsn": F.when(source == "store-003", F.col("first_lsn")).when(source == "store-004", "0/0").when(source == "store-005", "nonsense").otherwise(F.col("last_lsn"))}
    sources = whole.where("source_id <> 'store-001'").withColumns({**swapped, "source_id": F.when(source == "store-002", "store-002 ").otherwise(source)})
    sources = sources.unionByName(whole.where("source_id = 'store-006'").withColumns(none)).unionByName(whole.where((source == "store-007") & (F.col("epoch_id") == EPOCHS[0])).withColumns({**none, "epoch_id": F.lit("epoch-x")}))
    tables = lake.epoch_tables(one).select("epoch_id", "relation", "change_count")
    orders = tables.where("relation = 'public.orders'")
    tables = tables.unionByName(orders.withColumn("change_count", F.lit(1).cast("long"))).unionByName(orders.withColumns({"relation": F.lit(""), "change_count": zero}))
    partitions = lake.epoch_partitions(t("manifest_partitions"))
    partitions = partitions.unionByName(partitions.where("source_id = 'store-003' AND partition_id = 3").withColumn("event_count", zero))
    return lake.epoch_metadata_violations(lake.epoch_totals(one), sources, tables, partitions)


@query("a28_maintenance_plan", "SELECT table_name, count(*) AS file_count, count(*) FILTER (size_bytes < 33554432) AS small_file_count, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, count(*) FILTER (size_bytes < 33554432) >= 5 AS compact, greatest(1, CAST(ceil(sum(size_bytes) / 268435456) AS BIGINT)) AS target_files FROM {files} GROUP BY ALL")
def _(t):
    return lake.maintenance_plan(t("files"))


@query("a29_orphan_candidates", "SELECT table_name, object_key, size_bytes, modified_ms FROM {files} WHERE object_key LIKE '%.parquet' AND modified_ms <= 1500000000 - 86400000 AND object_key NOT IN (SELECT object_key FROM {files} WHERE size_bytes % 16000 = 0) AND object_key NOT IN (SELECT object_key FROM {files} WHERE modified_ms % 700000 = 0)")
def _(t):
    f = t("files")
    return lake.orphan_candidates(f, f.where("size_bytes % 16000 = 0"), f.where("modified_ms % 700000 = 0"), 1500000000)


GATED = f"SELECT epoch_id FROM ({_summary_sql('nobody', 'publish_with_gaps')}) WHERE state = 'complete_with_gaps' AND checksum_status = 'match'"


@query("j1_consumable_epochs", GATED)
def _(t):
    s = _summary(t, "nobody", "publish_with_gaps")
    return lake.consumable(s.drop("checksum_status"), s.select("epoch_id", "checksum_status"), accept_gaps=True).select("epoch_id")


@query("r23_epoch_gate", f"SELECT 'ready' AS gate FROM ({GATED}) WHERE epoch_id = '{EPOCHS[0]}'")
def _(t):
    s = _summary(t, "nobody", "publish_with_gaps")
    return lake.gate(s.drop("checksum_status"), s.select("epoch_id", "checksum_status"), EPOCHS[0], accept_gaps=True)


@query("j14_dashboard_gate", f"SELECT epoch_id, state, transaction_count, change_count, 'ready' AS release_decision FROM ({_summary_sql('nobody', 'publish_with_gaps')}) WHERE epoch_id = '{EPOCHS[0]}'")
def _(t):
    s = _summary(t, "nobody", "publish_with_gaps")
    gate = lake.gate(s.drop("checksum_status"), s.select("epoch_id", "checksum_status"), EPOCHS[0], accept_gaps=True)
    return s.where(F.col("epoch_id") == EPOCHS[0]).crossJoin(F.broadcast(gate)).select("epoch_id", "state", "transaction_count", "change_count", F.col("gate").alias("release_decision"))


@query("j2_gated_raw_rows", f"SELECT relation, operation, count(*) AS n FROM {{changes}} WHERE epoch_id = '{EPOCHS[1]}' GROUP BY ALL")
def _(t):
    s = _summary(t, "nobody", "publish_with_gaps")
    rows = lake.gated(t("changes"), s.drop("checksum_status"), s.select("epoch_id", "checksum_status"), EPOCHS[1], accept_gaps=True)
    return rows.groupBy("relation", "operation").agg(F.count("*").alias("n"))


@query("r27_plan_raw_cdc_epoch", f"""SELECT f.epoch_id, relation, source_bucket, f.transaction_count, f.change_count, f.checksum_rollup, state FROM ({FILES}) f JOIN ({_summary_sql('nobody', 'wait_all_required')}) s ON s.epoch_id = f.epoch_id""")
def _(t):
    first = lake.admitted(t("arrivals")).select("source_id", "transaction_id", "lsn", "envelope_checksum")
    one = lake.transactions(t("changes")).join(first, ["source_id", "transaction_id", "lsn", "envelope_checksum"], "left_semi")
    one = staged(one, "transactions")
    s = lake.epoch_summary(one, t("required"), t("nobody"), "wait_all_required").select("epoch_id", "state")
    return lake.data_files(one).join(s, "epoch_id").select("epoch_id", "relation", "source_bucket", "transaction_count", "change_count", "checksum_rollup", "state")


@query("f7_fnv_bucket", f"SELECT source_id, CAST({FNV} AS BIGINT) AS fnv, CAST({FNV} % 16 AS INTEGER) AS bucket FROM (SELECT DISTINCT source_id FROM {{changes}})")
def _(t):
    return t("changes").select("source_id").distinct().select("source_id", hashing.fnv1a_32(F.col("source_id")).alias("fnv"), hashing.bucket(F.col("source_id"), 16).alias("bucket"))
