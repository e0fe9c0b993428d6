"""Inputs made of the test tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

INPUTS = {
    "txns": """SELECT source_id, database_id, dataset_id, transaction_id, lsn, min(commit_lsn) AS commit_lsn, min(commit_timestamp_ms) AS commit_timestamp_ms,
        min(envelope_checksum) AS envelope_checksum, min(epoch_id) AS epoch_id, min(arrival_seq) AS arrival_seq, lsn - 8 AS begin_lsn
        FROM {changes} GROUP BY source_id, database_id, dataset_id, transaction_id, lsn""",
    "required": "SELECT concat('store-', lpad(CAST(n_nationkey AS STRING), 3, '0')) AS source_id FROM {nation} WHERE n_nationkey < 10",
    "quarantined": "SELECT concat('store-', lpad(CAST(n_nationkey AS STRING), 3, '0')) AS source_id FROM {nation} WHERE n_nationkey = 3",
    "nobody": "SELECT concat('store-', CAST(n_nationkey AS STRING)) AS source_id FROM {nation} WHERE n_nationkey < 0",
    "manifest_partitions": """SELECT epoch_id, source_id, transaction_id, lsn, commit_lsn, partition_id, count(*) AS event_count,
        CAST(sum(total_order * 1000003 + partition_id * 97) AS BIGINT) AS partition_checksum
        FROM {changes} GROUP BY epoch_id, source_id, transaction_id, lsn, commit_lsn, partition_id""",
    # current state: targets that hold an earlier and a later part of the log, so that changes win, lose and tie
    "log": "SELECT source_id, relation, record_key, operation, epoch_id, transaction_id, lsn, commit_timestamp_ms, total_order, idempotency_key, concat(status, ':', CAST(amount AS STRING)) AS payload FROM {changes}",
    "old_log": "SELECT * FROM {log} WHERE lsn % 48 = 0 AND operation <> 'delete'",
    "target": """SELECT source_id, relation, record_key, 'epoch-0' AS epoch_id, transaction_id, CASE WHEN ascii(right(record_key, 1)) % 5 = 0 THEN lsn + 100000000 ELSE lsn END AS lsn, commit_timestamp_ms, total_order, idempotency_key, payload
        FROM (SELECT *, row_number() OVER (PARTITION BY source_id, relation, record_key ORDER BY lsn, total_order) AS k FROM {old_log}) t WHERE k = 1""",
    "versions_before": """SELECT source_id, relation, record_key, 'epoch-0' AS epoch_id, concat('before-', record_key) AS transaction_id,
        CASE WHEN ascii(right(record_key, 1)) % 3 = 0 THEN lsn + 8 ELSE lsn - 8 END AS lsn, 1 AS total_order,
        CASE WHEN ascii(right(record_key, 1)) % 3 = 0 THEN commit_timestamp_ms + 1 - CASE WHEN ascii(right(record_key, 1)) % 6 = 0 THEN 9999999 ELSE 0 END ELSE commit_timestamp_ms - 60000 END AS valid_from, CAST(NULL AS BIGINT) AS valid_to, true AS is_current,
        concat('before:', record_key) AS idempotency_key, CAST(NULL AS STRING) AS close_epoch_id, payload
        FROM (SELECT *, row_number() OVER (PARTITION BY source_id, relation, record_key ORDER BY lsn, total_order) AS k FROM {log}) t WHERE k = CASE WHEN ascii(right(record_key, 1)) % 3 = 0 THEN 2 ELSE 1 END""",
    # verification
    "customer_target": """SELECT c_custkey, c_name, c_nationkey, c_mktsegment, CAST(floor(c_acctbal) AS BIGINT) + CASE WHEN c_custkey % 37 = 0 THEN 1 ELSE 0 END AS balance FROM {customer} WHERE c_custkey % 50 <> 0
        UNION ALL SELECT c_custkey + 1000000, c_name, c_nationkey, c_mktsegment, CAST(0 AS BIGINT) FROM {customer} WHERE c_custkey % 61 = 0""",
    "customer_source": "SELECT c_custkey, c_name, c_nationkey, c_mktsegment, CAST(floor(c_acctbal) AS BIGINT) AS balance FROM {customer}",
    # state
    "checkpoint_updates": """SELECT concat('flow-', CAST(o_custkey % 50 AS STRING)) AS flow_id, o_orderkey AS seq, o_orderkey * 16 + 32 AS last_seen,
        o_orderkey * 16 + 16 - CASE WHEN o_orderkey % 71 = 0 THEN 16000 ELSE 0 END AS durable, o_orderkey * 16 - CASE WHEN o_orderkey % 113 = 0 THEN 32000 ELSE 0 END AS applied FROM {orders}""",
    "partition_checkpoints": """SELECT concat('flow-', CAST(l_partkey % 40 AS STRING)) AS flow_id, CAST(l_suppkey % 8 AS INT) AS partition_id, max(l_orderkey) * 16 AS durable,
        coalesce(max(CASE WHEN l_linenumber < 3 THEN l_orderkey END), 0) * 16 AS applied FROM {lineitem} WHERE NOT (l_partkey % 40 % 7 = 0 AND l_suppkey % 8 = 3) GROUP BY l_partkey % 40, l_suppkey % 8""",
    "acks": """SELECT concat('consumer-', CAST(user_id % 4 AS STRING)) AS consumer, event_type AS topic, event_id AS seq,
        CAST(row_number() OVER (PARTITION BY user_id % 4, event_type ORDER BY event_id) AS BIGINT) - 1 - CASE WHEN event_id % 31 = 0 THEN 2 ELSE 0 END + CASE WHEN event_id % 101 = 0 THEN 3 ELSE 0 END AS "offset" FROM {events}""".replace('"offset"', "offset_"),
    "snapshot_runs": """SELECT concat('run-', CAST(c_custkey AS STRING)) AS run_id, n_nationkey AS seq,
        CASE WHEN n_nationkey = 0 THEN 'planned' WHEN n_nationkey = 1 THEN 'slot_created' WHEN n_nationkey = 2 THEN CASE WHEN c_custkey % 11 = 0 THEN 'streaming' ELSE 'copying_table' END WHEN n_nationkey = 3 THEN 'copying_table' WHEN n_nationkey = 4 THEN 'copy_complete' ELSE 'stream_handoff_ready' END AS state,
        CAST(n_nationkey * 100 - CASE WHEN c_custkey % 13 = 0 AND n_nationkey = 3 THEN 250 ELSE 0 END AS BIGINT) AS copied_rows, CAST(7 + CASE WHEN c_custkey % 17 = 0 AND n_nationkey >= 4 THEN 1 ELSE 0 END AS BIGINT) AS consistent_lsn
        FROM {customer} JOIN {nation} ON n_nationkey < 6""",
    "barrier_acks": """SELECT concat('barrier-', CAST(s_suppkey AS STRING)) AS barrier_id, CASE n_nationkey WHEN 0 THEN 'target_postgres' WHEN 1 THEN 'raw_cdc_lake' ELSE 'spark_views' END AS sink,
        (s_suppkey + n_nationkey) % 9 <> 0 AS accepted, CAST(1000 + s_suppkey - CASE WHEN (s_suppkey + n_nationkey) % 7 = 0 THEN 5 ELSE 0 END AS BIGINT) AS ack_lsn
        FROM {supplier} JOIN {nation} ON n_nationkey < 3 WHERE (s_suppkey * 3 + n_nationkey) % 5 <> 0""",
    "barrier_needs": """SELECT concat('barrier-', CAST(s_suppkey AS STRING)) AS barrier_id, CAST(1000 + s_suppkey AS BIGINT) AS barrier_lsn, CASE n_nationkey WHEN 0 THEN 'target_postgres' ELSE 'raw_cdc_lake' END AS sink
        FROM {supplier} JOIN {nation} ON n_nationkey < 2""",
    "ack_history": """SELECT concat('barrier-', CAST(o_custkey % 20 AS STRING)) AS barrier_id, o_orderpriority AS sink, o_orderkey AS seq, CAST(floor(o_orderkey / 3) AS BIGINT) * 16 - CASE WHEN o_orderkey % 41 = 0 THEN 4000 ELSE 0 END AS ack_lsn, o_orderkey % 5 <> 0 AS accepted FROM {orders}""",
    "published": """SELECT transaction_id, lsn, CASE WHEN lsn % 1040 = 0 AND total_order = 1 THEN 'broker-b' ELSE 'broker-a' END AS destination, CAST(CASE WHEN lsn % 1136 = 0 THEN 9 ELSE n END AS BIGINT) AS expected
        FROM (SELECT *, count(*) OVER (PARTITION BY transaction_id) AS n FROM {changes}) t""",
    "failures": """SELECT concat('tx-', CAST(event_id % 500 AS STRING)) AS transaction_id, CAST(1 AS BIGINT) AS attempts, event_id AS first_seen_ms, event_id AS last_seen_ms, event_type AS error FROM {events} WHERE event_id % 3 = 0""",
    "old_failures": """SELECT concat('tx-', CAST(event_id AS STRING)) AS transaction_id, CAST(2 AS BIGINT) AS attempts, event_id - 100 AS first_seen_ms, event_id - 50 AS last_seen_ms, 'before' AS error FROM {events} WHERE event_id < 100""",
    "ddl": """SELECT concat('ord-', CAST(o_orderkey AS STRING)) AS transaction_id, CAST(1 + o_orderkey % 3 AS INT) AS total_order, concat('public.t', CAST(o_custkey % 5 AS STRING)) AS relation,
        CASE o_orderkey % 6 WHEN 0 THEN 'add_column' WHEN 1 THEN 'drop_column' WHEN 2 THEN 'rename' WHEN 3 THEN 'unspecified' WHEN 4 THEN 'other' ELSE 'alter_type' END AS kind, o_custkey % 2 = 0 AS auto,
        CAST(o_orderkey AS BIGINT) AS fingerprint_before, CAST(o_orderkey + CASE WHEN o_orderkey % 19 = 0 THEN 0 ELSE 1 END AS BIGINT) AS fingerprint_after FROM {orders} WHERE o_orderkey % 4 = 0
        UNION ALL SELECT concat('ord-', CAST(o_orderkey AS STRING)), 7, concat('public.t', CAST(o_custkey % 5 AS STRING)), 'add_column', true, CAST(o_orderkey + 1 AS BIGINT), CAST(o_orderkey + 2 AS BIGINT) FROM {orders} WHERE o_orderkey % 8 = 0""",
    "schema_versions": """SELECT concat('ord-', CAST(o_orderkey AS STRING)) AS transaction_id, concat('public.t', CAST(o_custkey % 5 AS STRING)) AS relation, CAST(o_orderkey + CASE WHEN o_orderkey % 8 = 0 THEN 2 WHEN o_orderkey % 20 = 0 THEN 9 ELSE 1 END AS BIGINT) AS version FROM {orders} WHERE o_orderkey % 4 = 0""",
    "moves": """SELECT concat('tx-', CAST(event_id AS STRING)) AS transaction_id, 1 AS total_order, concat('key-', CAST(event_id AS STRING)) AS idempotency_key, CAST(user_id AS STRING) AS key_before,
        CASE WHEN event_id % 5 = 0 THEN CAST(NULL AS STRING) WHEN event_id % 3 = 0 THEN CAST(user_id + 1 AS STRING) ELSE CAST(user_id AS STRING) END AS key_after FROM {events}""",
    "routed": """SELECT idempotency_key, record_key, CASE WHEN lsn % 80 = 0 THEN CAST(NULL AS STRING) ELSE record_key END AS partition_key FROM {changes}""",
    # operations
    "slots": """SELECT concat('source-', CAST(s_suppkey AS STRING)) AS source_id, s_suppkey % 29 <> 0 AS slot_present, CASE WHEN s_suppkey % 23 = 0 THEN 'other' ELSE 'pgoutput' END AS plugin, s_suppkey % 31 = 0 AS invalidated,
        CASE s_suppkey % 17 WHEN 0 THEN 'lost' WHEN 1 THEN 'unreserved' ELSE 'reserved' END AS wal_status, s_suppkey * 10 AS restart_lsn, s_suppkey * 10 + 5 - CASE WHEN s_suppkey % 13 = 0 THEN 9 ELSE 0 END AS confirmed_lsn,
        s_suppkey % 19 - 1 AS safe_wal_bytes, (s_suppkey % 11) * 20000 AS headroom_seconds, CASE WHEN s_suppkey % 12 = 0 THEN 2 ELSE 0 END AS unsafe_tables, s_suppkey % 2 AS table_notes, CASE WHEN s_suppkey % 37 = 0 THEN 1 ELSE 0 END AS conflicts,
        CASE WHEN s_suppkey % 10 = 0 THEN 1 ELSE 0 END AS apply_errors, s_suppkey % 100 AS wraparound_percent, CASE WHEN s_suppkey % 9 = 0 THEN 1 ELSE 0 END AS xmin_pinners, s_suppkey % 3 <> 0 AS failover, s_suppkey % 14 <> 1 AS failover_synced, s_suppkey % 21 <> 2 AS inspection_complete, s_suppkey % 4 <> 0 AS active FROM {supplier}""",
    "wal_samples": """SELECT concat('source-', CAST(o_custkey % 30 AS STRING)) AS source_id, o_orderkey AS seq, o_orderkey * 4096 - CASE WHEN o_orderkey % 53 = 0 THEN 900000000 ELSE 0 END AS lsn, o_orderkey * 2 AS seconds, (o_orderkey % 50) * 1000000 AS safe_bytes FROM {orders}""",
    "relations": """SELECT concat('public.p', CAST(p_partkey AS STRING)) AS relation, CASE p_partkey % 4 WHEN 0 THEN 'default' WHEN 1 THEN 'full' WHEN 2 THEN 'index' ELSE 'nothing' END AS replica_identity, p_partkey % 3 <> 0 AS has_primary_key, p_partkey % 5 AS wide_columns, p_partkey * 7 AS fingerprint FROM {part}""",
    "relations_after": "SELECT relation, replica_identity, has_primary_key, wide_columns, CASE WHEN fingerprint % 77 = 0 THEN fingerprint + 1 ELSE fingerprint END AS fingerprint FROM {relations}",
    "flows": """SELECT concat('store-', CAST(c_custkey % 997 AS STRING), ':', c_mktsegment) AS flow_id, concat('store-', CAST(c_custkey % 997 AS STRING)) AS source_id, c_mktsegment AS dataset_id, CASE c_nationkey % 3 WHEN 0 THEN 'strict' WHEN 1 THEN 'chunked' ELSE 'partitioned' END AS mode,
        CASE WHEN c_custkey % 97 = 0 THEN 'complete_with_gaps' ELSE 'complete' END AS lake_state, concat('config-', CAST(c_custkey AS STRING)) AS config, CAST(c_custkey * 16 AS BIGINT) AS durable, CAST(c_custkey * 16 - CASE WHEN c_custkey % 6 = 0 THEN 16 ELSE 0 END AS BIGINT) AS applied,
        CASE WHEN c_custkey % 6 = 0 THEN 16 ELSE 0 END AS lag_bytes, CASE WHEN c_custkey % 25 = 0 THEN 1 ELSE 0 END AS missing_partitions, CASE WHEN c_custkey % 40 = 0 THEN 1 ELSE 0 END AS quarantined, CASE WHEN c_custkey % 33 = 0 THEN 'mismatch' WHEN c_custkey % 7 = 0 THEN 'unknown' ELSE 'match' END AS validation FROM {customer}""",
    "frames": """SELECT concat('queue-', CAST(user_id % 16 AS STRING)) AS queue, event_id AS seq, event_id * 16 - CASE WHEN event_id % 43 = 0 THEN 5000 ELSE 0 END AS lsn, concat('b-', CAST(event_id - CASE WHEN event_id % 59 = 0 THEN 160 ELSE 0 END AS STRING)) AS boundary, CAST(1 + event_id % 900 AS BIGINT) AS size FROM {events}""",
    "validations": """SELECT event_id, concat('flow-', CAST(user_id AS STRING)) AS flow_id, CASE WHEN event_id % 21 = 0 THEN 'short' ELSE repeat('a1', 32) END AS digest, event_id % 15 AS tables, event_id % 33 - 1 AS rows, event_id AS applied, event_id - CASE WHEN event_id % 27 = 0 THEN 1 ELSE 0 END AS durable, event_id % 7777 AS completed_ms FROM {events}""",
    "files": """SELECT concat('raw.', l_shipmode_like) AS table_name, concat('raw/', l_shipmode_like, '/', CAST(l_suppkey AS STRING), CASE WHEN l_suppkey % 9 = 0 THEN '.tmp' ELSE '.parquet' END) AS object_key, CAST(sum(l_partkey) AS BIGINT) * 4000 AS size_bytes, CAST(max(l_orderkey) AS BIGINT) * 100000 AS modified_ms
        FROM (SELECT concat(l_returnflag, l_linestatus) AS l_shipmode_like, l_suppkey, l_partkey, l_orderkey FROM {lineitem}) t GROUP BY l_shipmode_like, l_suppkey""",
    "lsn_texts": """SELECT event_id, CASE event_id % 7 WHEN 0 THEN commit_lsn WHEN 1 THEN concat('0000', commit_lsn) WHEN 2 THEN lower(commit_lsn) WHEN 3 THEN 'nonsense' WHEN 4 THEN '1/' WHEN 5 THEN CAST(NULL AS STRING) ELSE commit_lsn END AS text, lsn
        FROM (SELECT lsn AS event_id, commit_lsn, lsn FROM {txns}) t""",
    "epoch_rows": """SELECT concat('epoch-', CAST(c_custkey AS STRING)) AS epoch_id, 10 AS required_source_count, 10 - m - q + CASE WHEN c_custkey % 17 = 0 THEN 1 ELSE 0 END AS complete_source_count, m AS missing_source_count, q AS quarantined_source_count,
        policy, CASE WHEN c_custkey % 7 = 0 THEN 'complete' WHEN q > 0 THEN 'quarantined' WHEN m = 0 THEN 'complete' WHEN policy = 'publish_with_gaps' THEN 'complete_with_gaps' ELSE 'open' END AS state, c_custkey % 11 AS transaction_count,
        c_custkey * 1000003 AS checksum_rollup, CASE WHEN c_custkey % 13 = 0 THEN 'mismatch' ELSE 'match' END AS checksum_status, c_custkey % 19 = 0 AS misnamed,
        concat('epoch-', CAST(c_custkey + CASE WHEN c_custkey % 23 = 0 THEN 1 ELSE 0 END AS STRING)) AS verification_epoch_id, CASE WHEN c_custkey % 29 = 0 THEN 'ab12' WHEN c_custkey % 31 = 0 THEN repeat('XY', 32) ELSE repeat('0f', 32) END AS manifest_digest,
        10 + CASE WHEN c_custkey % 37 = 0 THEN 1 ELSE 0 END AS verified_required_source_count, m + CASE WHEN c_custkey % 41 = 0 THEN 1 ELSE 0 END AS verified_missing_source_count
        FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 0 END AS m, CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS q, CASE WHEN c_custkey % 2 = 0 THEN 'publish_with_gaps' ELSE 'wait_all_required' END AS policy FROM {customer}) t""",
    "runtime": """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'starting' WHEN 1 THEN 'running' WHEN 2 THEN 'draining' WHEN 3 THEN 'stopped' ELSE 'failed' END AS phase,
        CASE user_id % 5 WHEN 0 THEN 'ready' WHEN 1 THEN 'degraded' WHEN 2 THEN 'backpressured' WHEN 3 THEN 'blocked' ELSE 'not_ready' END AS readiness, event_id % 2 = 0 AS accepting_work,
        CASE event_id % 3 WHEN 0 THEN 'lag_high' WHEN 1 THEN 'Bad Code' ELSE CAST(NULL AS STRING) END AS reason_code FROM {events}""",
    "ddl_plan": """SELECT event_id, CASE event_id % 12 WHEN 0 THEN 'add_nullable_column' WHEN 1 THEN 'add_table' WHEN 2 THEN 'widen_type' WHEN 3 THEN 'increase_varchar' WHEN 4 THEN 'drop_column' WHEN 5 THEN 'rename_column'
        WHEN 6 THEN 'rename_table' WHEN 7 THEN 'narrow_type' WHEN 8 THEN 'change_primary_key' WHEN 9 THEN 'change_partition_key' WHEN 10 THEN 'add_not_null_column' ELSE 'unknown' END AS kind,
        user_id % 2 = 0 AS configured, user_id % 3 = 0 AS allow_unknown, CASE user_id % 4 WHEN 0 THEN 'auto_safe' WHEN 1 THEN 'staged_rollout' WHEN 2 THEN 'manual_review' ELSE 'other' END AS apply_mode FROM {events}""",
    "subtransactions": """SELECT concat('ord-', CAST(l_orderkey AS STRING)) AS transaction_id, l_linenumber * 10 + 0 AS total_order, CAST(l_suppkey % 3 AS INT) AS subtransaction_id, l_partkey AS payload FROM (SELECT l_orderkey, l_suppkey, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS INT) AS l_linenumber FROM {lineitem}) t""",
    "commits": "SELECT concat('ord-', CAST(o_orderkey AS STRING)) AS transaction_id FROM {orders} WHERE o_orderkey % 10 <> 0",
    "aborted": """SELECT concat('ord-', CAST(o_orderkey AS STRING)) AS transaction_id, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE CAST(NULL AS INT) END AS subtransaction_id FROM {orders} WHERE o_orderkey % 9 = 0 OR o_orderkey % 11 = 0""",
    # envelopes, manifests, chunks and markers with every fault that validation tells, planted by LSN
    "sent_txns": """SELECT CASE WHEN lsn % 304 = 0 THEN concat(source_id, ' ') ELSE source_id END AS source_id, CASE WHEN lsn % 336 = 0 THEN '' ELSE database_id END AS database_id, CASE WHEN lsn % 368 = 0 THEN concat(' ', dataset_id) ELSE dataset_id END AS dataset_id,
        CASE WHEN lsn % 544 = 0 THEN concat(transaction_id, ' ') ELSE transaction_id END AS transaction_id, CASE WHEN lsn % 176 = 0 THEN CAST(0 AS BIGINT) ELSE lsn END AS lsn,
        CASE WHEN lsn % 464 = 0 THEN CAST(0 AS BIGINT) WHEN lsn % 496 = 0 THEN lsn + 1 WHEN lsn % 400 = 0 THEN CAST(NULL AS BIGINT) ELSE begin_lsn END AS begin_lsn, CASE WHEN lsn % 112 = 0 THEN CAST(0 AS BIGINT) ELSE commit_timestamp_ms END AS commit_timestamp_ms, CASE WHEN lsn % 592 = 0 THEN 2 ELSE 1 END AS protocol_version FROM {txns}""",
    "sent_changes": """SELECT transaction_id, CASE WHEN lsn % 208 = 0 AND total_order = 2 THEN 1 ELSE total_order END AS total_order, CASE WHEN lsn % 432 = 0 THEN concat(idempotency_key, ' ') WHEN lsn % 656 = 0 THEN '' ELSE idempotency_key END AS idempotency_key,
        CASE WHEN lsn % 688 = 0 THEN concat(transaction_id, 'x') ELSE transaction_id END AS change_transaction_id FROM {changes}""",
    "sent_ddl": "SELECT transaction_id, total_order + CASE WHEN fingerprint_before % 48 = 0 THEN 0 ELSE 1000 END AS total_order FROM {ddl}",
    "sent_versions": """SELECT DISTINCT transaction_id, CASE WHEN lsn % 784 = 0 THEN ' ' ELSE relation END AS relation, CASE WHEN lsn % 752 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS version FROM {changes}
        UNION ALL SELECT transaction_id, relation, CAST(1 AS BIGINT) AS version FROM {changes} WHERE total_order = 1 AND lsn % 848 = 0""",
    "plan_chunks": "SELECT transaction_id, lsn, commit_timestamp_ms, partition_id AS chunk_id, count(*) AS event_count, min(total_order) AS first_total_order, max(total_order) AS last_total_order FROM {changes} GROUP BY transaction_id, lsn, commit_timestamp_ms, partition_id",
    "sent_chunks": """SELECT transaction_id, CASE WHEN lsn % 592 = 0 THEN 0 ELSE chunk_id END AS chunk_id, CASE WHEN lsn % 272 = 0 AND chunk_id % 2 = 0 THEN CAST(0 AS BIGINT) WHEN lsn % 656 = 0 THEN event_count + 5 ELSE event_count END AS event_count,
        CASE WHEN lsn % 368 = 0 AND first_total_order = 1 THEN 0 WHEN lsn % 496 = 0 THEN last_total_order + 1 ELSE first_total_order END AS first_total_order, CASE WHEN lsn % 464 = 0 THEN 0 ELSE last_total_order END AS last_total_order FROM {plan_chunks}""",
    "sent_manifests": """SELECT CASE WHEN lsn % 752 = 0 THEN concat(transaction_id, ' ') ELSE transaction_id END AS transaction_id, CASE WHEN lsn % 176 = 0 THEN CAST(0 AS BIGINT) ELSE lsn END AS lsn, CASE WHEN lsn % 112 = 0 THEN CAST(0 AS BIGINT) ELSE commit_timestamp_ms END AS commit_timestamp_ms,
        CASE WHEN lsn % 688 = 0 THEN CAST(0 AS BIGINT) WHEN lsn % 304 = 0 THEN n - 1 ELSE n END AS global_event_count, CASE WHEN lsn % 432 = 0 THEN 'unspecified' WHEN lsn % 528 = 0 THEN CAST(NULL AS STRING) WHEN lsn % 32 = 0 THEN 'strict_chunked' ELSE 'partitioned' END AS boundary_mode
        FROM (SELECT transaction_id, lsn, commit_timestamp_ms, count(*) AS n FROM {changes} GROUP BY transaction_id, lsn, commit_timestamp_ms) t""",
    "sent_tables": """SELECT transaction_id, relation, CASE WHEN lsn % 848 = 0 THEN n + 1 WHEN lsn % 1040 = 0 THEN CAST(0 AS BIGINT) ELSE n END AS event_count FROM (SELECT transaction_id, lsn, relation, count(*) AS n FROM {changes} GROUP BY transaction_id, lsn, relation) t
        UNION ALL SELECT transaction_id, relation, CAST(1 AS BIGINT) AS event_count FROM {changes} WHERE total_order = 1 AND lsn % 912 = 0""",
    "epoch_chunks": """SELECT transaction_id, chunk_id, event_count + CASE WHEN lsn % 496 = 0 THEN 1 ELSE 0 END AS event_count, first_total_order + CASE WHEN lsn % 592 = 0 THEN 1000 ELSE 0 END AS first_total_order, last_total_order + CASE WHEN lsn % 656 = 0 THEN 1000 ELSE 0 END AS last_total_order FROM {plan_chunks}""",
    "epoch_manifests": """SELECT CASE WHEN lsn % 752 = 0 THEN concat(transaction_id, '?') ELSE transaction_id END AS transaction_id, lsn + CASE WHEN lsn % 272 = 0 THEN 8 ELSE 0 END AS lsn, commit_timestamp_ms + CASE WHEN lsn % 368 = 0 THEN 1 ELSE 0 END AS commit_timestamp_ms, n + CASE WHEN lsn % 464 = 0 THEN 1 ELSE 0 END AS global_event_count
        FROM (SELECT transaction_id, lsn, commit_timestamp_ms, count(*) AS n FROM {changes} GROUP BY transaction_id, lsn, commit_timestamp_ms) t""",
    "delivered": """SELECT transaction_id, partition_id + CASE WHEN lsn % 464 = 0 THEN 100 ELSE 0 END AS chunk_id, CASE WHEN lsn % 496 = 0 THEN concat(transaction_id, '?') ELSE transaction_id END AS change_transaction_id, total_order + CASE WHEN lsn % 592 = 0 THEN 1 ELSE 0 END AS total_order,
        CASE WHEN lsn % 656 = 0 THEN concat(idempotency_key, '?') ELSE idempotency_key END AS idempotency_key FROM {changes} WHERE NOT (lsn % 272 = 0 AND total_order = 1)
        UNION ALL SELECT transaction_id, partition_id AS chunk_id, transaction_id AS change_transaction_id, total_order, idempotency_key FROM {changes} WHERE lsn % 368 = 0 AND total_order = 1""",
    "tampered": "SELECT source_id, database_id, dataset_id, transaction_id, lsn, commit_timestamp_ms, total_order, relation, operation, record_key, amount + CASE WHEN lsn % 272 = 0 AND total_order = 1 THEN 1 ELSE 0 END AS amount, status, idempotency_key FROM {changes} WHERE NOT (lsn % 368 = 0 AND total_order = 2) AND lsn % 464 <> 0",
    # cells of images: what is the key's, the amount's and the status's kind, and which images there are
    "cells": """SELECT transaction_id, total_order, idempotency_key, relation, CASE WHEN lsn % 240 = 0 THEN 'truncate' WHEN lsn % 272 = 0 THEN 'merge' ELSE operation END AS operation, lsn % 304 <> 0 AND operation <> 'insert' AS has_before, lsn % 336 <> 0 AND operation <> 'delete' AS has_after, record_key, CAST(amount AS STRING) AS amount, status,
        CASE WHEN lsn % 112 = 0 THEN 'null' WHEN lsn % 176 = 0 THEN 'unchanged' WHEN lsn % 208 = 0 THEN 'binary' ELSE 'text' END AS key_kind, CASE WHEN lsn % 368 = 0 THEN 'unchanged' ELSE 'text' END AS before_key_kind, lsn % 400 <> 0 AS has_key, lsn % 48 = 0 AS key_moved,
        CASE WHEN lsn % 80 = 0 THEN 'unchanged' WHEN lsn % 64 = 0 THEN 'null' ELSE 'text' END AS amount_kind, CASE WHEN lsn % 32 = 0 THEN 'unchanged' ELSE 'text' END AS status_kind FROM {changes}""",
    # source and partition rows of the epochs in epoch_rows, in keeping with their counts but where a fault is planted
    "epoch_sources_stated": """SELECT epoch_id, concat('store-', CAST(n_nationkey AS STRING)) AS source_id, CASE WHEN n_nationkey < missing_source_count THEN CASE WHEN n_nationkey = 0 THEN 'missing' ELSE 'lagging' END WHEN n_nationkey < missing_source_count + quarantined_source_count THEN 'quarantined' ELSE 'complete' END AS state,
        CASE WHEN n_nationkey = 5 AND transaction_count = 3 THEN '0/0' WHEN n_nationkey = 6 AND transaction_count = 4 THEN 'nonsense' WHEN n_nationkey = 7 THEN CAST(NULL AS STRING) ELSE '0/16B6C50' END AS commit_lsn
        FROM {epoch_rows} JOIN {nation} ON n_nationkey < required_source_count - CASE WHEN transaction_count = 9 THEN 1 ELSE 0 END""",
    "epoch_partitions_stated": """SELECT epoch_id, CASE WHEN transaction_count = 2 AND n_nationkey = 0 THEN ' store-0' WHEN transaction_count = 2 AND n_nationkey = 1 THEN '' ELSE concat('store-', CAST(n_nationkey AS STRING)) END AS source_id, CASE WHEN transaction_count = 5 THEN 0 ELSE n_nationkey % 2 END AS partition_id,
        CASE WHEN transaction_count = 6 AND n_nationkey = 1 THEN CAST(NULL AS STRING) WHEN transaction_count = 7 AND n_nationkey = 2 THEN '0/0' WHEN transaction_count = 8 THEN '0/20' ELSE '0/10' END AS first_lsn, '0/18' AS last_lsn FROM {epoch_rows} JOIN {nation} ON n_nationkey < 3
        UNION ALL SELECT epoch_id, 'store-0' AS source_id, 0 AS partition_id, '0/10' AS first_lsn, '0/18' AS last_lsn FROM {epoch_rows} WHERE transaction_count = 10""",
}
