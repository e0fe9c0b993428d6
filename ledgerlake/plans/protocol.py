"""Queries of envelopes, chunks, barriers and schema changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.functions import names
from ledgerlake.operators import images, protocol
from ledgerlake.plans.registry import query
from ledgerlake.storage import staged

MD5 = "CAST('0x' || substr(md5({0}), 1, 15) AS BIGINT)".format


@query("s3_assemble_transactions", "SELECT transaction_id, total_order, payload, CAST(row_number() OVER (PARTITION BY transaction_id ORDER BY total_order) AS INTEGER) AS dense_order FROM {subtransactions} WHERE transaction_id IN (SELECT transaction_id FROM {commits})")
def _(t):
    return protocol.assemble(t("subtransactions"), t("commits")).select("transaction_id", "total_order", "payload", "dense_order")


@query("s4_assemble_streamed", """SELECT transaction_id, total_order, payload, CAST(row_number() OVER (PARTITION BY transaction_id ORDER BY total_order) AS INTEGER) AS dense_order FROM {subtransactions} s WHERE transaction_id IN (SELECT transaction_id FROM {commits})
  AND NOT EXISTS (SELECT 1 FROM {aborted} a WHERE a.transaction_id = s.transaction_id AND (a.subtransaction_id IS NULL OR a.subtransaction_id = s.subtransaction_id))""")
def _(t):
    return protocol.assemble(t("subtransactions"), t("commits"), t("aborted")).select("transaction_id", "total_order", "payload", "dense_order")


@query("w5_dense_order_compaction", "SELECT transaction_id, total_order * 10 AS sparse_order, CAST(row_number() OVER (PARTITION BY source_id, transaction_id, lsn ORDER BY total_order) AS INTEGER) AS dense_order FROM {changes}")
def _(t):
    from pyspark.sql import Window

    by = Window.partitionBy("source_id", "transaction_id", "lsn").orderBy("total_order")
    return t("changes").select("transaction_id", (F.col("total_order") * 10).alias("sparse_order"), F.row_number().over(by).alias("dense_order"))


def _codes(table: str, keys: str, *codes: tuple[str, str]) -> str:
    """A row for each code whose condition holds, in SQL."""
    cases = ", ".join(f"CASE WHEN {cond} THEN '{code}' END" for code, cond in codes)
    return f"SELECT {keys}, violation FROM (SELECT {keys}, unnest([{cases}]) AS violation FROM {table}) WHERE violation IS NOT NULL"


def _dirty(c: str) -> tuple[str, str]:
    return f"unclean_{c}", f"{c} = '' OR trim({c}) <> {c}"


_SENT_EVENTS = "SELECT transaction_id, total_order, idempotency_key, change_transaction_id FROM {sent_changes} UNION ALL SELECT transaction_id, total_order, 'ddl', transaction_id FROM {sent_ddl}"


@query("p6_validate_envelope", f"""{_codes("{sent_txns}", "transaction_id", ("protocol_version", "protocol_version <> 1"), *map(_dirty, ("source_id", "database_id", "dataset_id", "transaction_id")), ("non_positive_timestamp", "commit_timestamp_ms <= 0"), ("zero_lsn", "lsn = 0"), ("zero_begin_lsn", "begin_lsn = 0"), ("begin_after_commit", "begin_lsn > lsn"))}
  UNION ALL SELECT transaction_id, 'repeated_event_order' FROM ({_SENT_EVENTS}) GROUP BY ALL HAVING count(*) > count(DISTINCT total_order)
  UNION ALL SELECT DISTINCT transaction_id, 'unclean_idempotency_key' FROM ({_SENT_EVENTS}) WHERE idempotency_key = '' OR trim(idempotency_key) <> idempotency_key UNION ALL SELECT DISTINCT transaction_id, 'change_transaction' FROM ({_SENT_EVENTS}) WHERE change_transaction_id <> transaction_id
  UNION ALL SELECT transaction_id, 'repeated_schema_version' FROM {{sent_versions}} GROUP BY ALL HAVING count(*) > count(DISTINCT relation) UNION ALL SELECT DISTINCT transaction_id, 'zero_schema_version' FROM {{sent_versions}} WHERE version = 0 UNION ALL SELECT DISTINCT transaction_id, 'unclean_relation' FROM {{sent_versions}} WHERE trim(relation) = ''""")
def _(t):
    return protocol.envelope_violations(t("sent_txns"), t("sent_changes"), t("sent_ddl"), t("sent_versions"))


def _content_sql(table: str) -> str:
    digest = MD5("concat_ws('|', total_order, relation, operation, record_key, amount, status, idempotency_key)")
    return f"SELECT transaction_id, lsn, {MD5("concat_ws('|', source_id, database_id, dataset_id, transaction_id, lsn, commit_timestamp_ms, n, x)")} AS checksum FROM (SELECT source_id, database_id, dataset_id, transaction_id, lsn, commit_timestamp_ms, count(*) AS n, bit_xor({digest}) AS x FROM {{{table}}} GROUP BY ALL)"


@query("p7_verify_checksum", f"SELECT s.transaction_id, s.checksum, a.checksum AS actual_checksum FROM ({_content_sql('changes')}) s LEFT JOIN ({_content_sql('tampered')}) a ON a.transaction_id = s.transaction_id AND a.lsn = s.lsn WHERE s.checksum IS DISTINCT FROM a.checksum")
def _(t):
    return protocol.checksum_violations(protocol.content_checksums(t("changes")), t("tampered"))


@query("a15_affected_tables", "SELECT transaction_id, relation, count(*) AS event_count FROM {changes} GROUP BY ALL")
def _(t):
    return protocol.affected_tables(t("changes"))


CHUNKS = f"SELECT transaction_id, partition_id AS chunk_id, count(*) AS event_count, min(total_order) AS first_total_order, max(total_order) AS last_total_order, bit_xor({MD5('idempotency_key')}) AS checksum FROM {{changes}} GROUP BY ALL"
STRICT = f"""SELECT transaction_id, chunk_id, count(*) AS event_count, min(total_order) AS first_total_order, max(total_order) AS last_total_order, bit_xor({MD5('idempotency_key')}) AS checksum
  FROM (SELECT *, CAST((row_number() OVER (PARTITION BY transaction_id ORDER BY total_order) - 1) // 3 AS INTEGER) AS chunk_id FROM {{changes}}) GROUP BY ALL"""
CHUNK_SUM = MD5("chunk_id || ':' || event_count || ':' || checksum")
MANIFESTS = f"SELECT transaction_id, CAST(sum(event_count) AS BIGINT) AS global_event_count, count(*) AS chunk_count, min(first_total_order) AS first_total_order, max(last_total_order) AS last_total_order, bit_xor({CHUNK_SUM}) AS manifest_checksum, '%s' AS boundary_mode FROM (%s) GROUP BY ALL"


@query("r4_plan_partitioned", CHUNKS)
def _(t):
    return protocol.partition_chunks(t("changes"))


@query("r5_plan_strict_chunked", STRICT)
def _(t):
    return protocol.strict_chunks(t("changes"), 3)


@query("w6_strict_chunk_id", "SELECT idempotency_key, CAST((row_number() OVER (PARTITION BY transaction_id ORDER BY total_order) - 1) // 3 AS INTEGER) AS chunk_id FROM {changes}")
def _(t):
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("transaction_id").orderBy("total_order"))
    return t("changes").select("idempotency_key", F.floor((at - 1) / 3).cast("int").alias("chunk_id"))


@query("r4_partitioned_manifests", MANIFESTS % ("partitioned", CHUNKS))
def _(t):
    return protocol.manifests(protocol.partition_chunks(t("changes")), "partitioned")


@query("r5_strict_manifests", MANIFESTS % ("strict_chunked", STRICT))
def _(t):
    return protocol.manifests(protocol.strict_chunks(t("changes"), 3), "strict_chunked")


_OF_CHUNKS = """SELECT transaction_id, count(*) AS n, count(DISTINCT chunk_id) AS n_ids, sum(event_count) AS events, min(first_total_order) AS low, min(last_total_order) AS least_last, max(last_total_order) AS high, min(event_count) AS least,
  bool_or(first_total_order > last_total_order) AS turned, bool_or(event_count > last_total_order - first_total_order + 1) AS crowded FROM {sent_chunks} GROUP BY ALL"""
_OF_TABLES = "SELECT transaction_id, count(*) AS t, count(DISTINCT relation) AS t_ids, sum(event_count) AS t_events, min(event_count) AS t_least FROM {sent_tables} GROUP BY ALL"


@query("p8_validate_manifest", _codes(f"(SELECT m.*, c.* EXCLUDE (transaction_id), x.* EXCLUDE (transaction_id) FROM {{sent_manifests}} m LEFT JOIN ({_OF_CHUNKS}) c ON c.transaction_id = m.transaction_id LEFT JOIN ({_OF_TABLES}) x ON x.transaction_id = m.transaction_id)", "transaction_id",
    _dirty("transaction_id"), ("zero_lsn", "lsn = 0"), ("zero_event_count", "global_event_count = 0"), ("non_positive_timestamp", "commit_timestamp_ms <= 0"), ("boundary_mode", "coalesce(boundary_mode, '') NOT IN ('strict_chunked', 'partitioned')"), ("no_partitions", "n IS NULL"),
    ("repeated_partition", "n > n_ids"), ("zero_first_order", "low = 0"), ("zero_last_order", "least_last = 0"), ("reversed_range", "turned"), ("empty_partition", "least = 0"), ("count_past_range", "crowded"), ("order_past_end", "high > global_event_count"), ("event_count", "events <> global_event_count"),
    ("first_event_missing", "low <> 1"), ("no_affected_tables", "t IS NULL"), ("repeated_affected_table", "t > t_ids"), ("empty_affected_table", "t_least = 0"), ("affected_event_count", "t_events <> global_event_count")))
def _(t):
    return protocol.manifest_violations(t("sent_manifests"), t("sent_chunks"), t("sent_tables"))


@query("p9_validate_epoch_manifest", f"""{_codes('''(SELECT m.*, x.lsn AS l, x.commit_timestamp_ms AS ms, c.n, e.events FROM {epoch_manifests} m LEFT JOIN {txns} x ON x.transaction_id = m.transaction_id LEFT JOIN (SELECT transaction_id, count(*) AS n FROM {changes} GROUP BY ALL) c ON c.transaction_id = m.transaction_id
    LEFT JOIN (SELECT transaction_id, sum(event_count) AS events FROM {epoch_chunks} GROUP BY ALL) e ON e.transaction_id = m.transaction_id)''', "transaction_id", ("no_envelope", "l IS NULL"), ("lsn", "lsn <> l"), ("timestamp", "commit_timestamp_ms <> ms"), ("change_count", "l IS NOT NULL AND global_event_count <> coalesce(n, 0)"), ("partition_count", "global_event_count <> coalesce(events, 0)"))}
  UNION ALL SELECT DISTINCT transaction_id, 'first_order_absent' FROM {{epoch_chunks}} k WHERE NOT EXISTS (SELECT 1 FROM {{changes}} c WHERE c.transaction_id = k.transaction_id AND c.total_order = k.first_total_order)
  UNION ALL SELECT DISTINCT transaction_id, 'last_order_absent' FROM {{epoch_chunks}} k WHERE NOT EXISTS (SELECT 1 FROM {{changes}} c WHERE c.transaction_id = k.transaction_id AND c.total_order = k.last_total_order)""")
def _(t):
    return protocol.epoch_manifest_violations(t("epoch_manifests"), t("epoch_chunks"), t("txns"), t("changes"))


_DELIVERED = f"SELECT transaction_id, chunk_id, count(*) AS n, count(DISTINCT total_order) AS n_orders, min(total_order) AS low, max(total_order) AS high, bit_xor({MD5('idempotency_key')}) AS x, bool_or(change_transaction_id <> transaction_id) AS strange FROM {{delivered}} GROUP BY ALL"


@query("p10_validate_chunk", _codes(f"(SELECT d.*, m.event_count, m.first_total_order, m.last_total_order, m.checksum FROM ({_DELIVERED}) d LEFT JOIN ({CHUNKS}) m ON m.transaction_id = d.transaction_id AND m.chunk_id = d.chunk_id)", "transaction_id, chunk_id",
    ("unknown_chunk", "event_count IS NULL"), ("event_count", "n <> event_count"), ("order_range", "low <> first_total_order OR high <> last_total_order"), ("checksum", "x <> checksum"), ("repeated_order", "n > n_orders"), ("change_transaction", "strange")))
def _(t):
    return protocol.chunk_violations(protocol.partition_chunks(t("changes")), t("delivered"))


NUMBER = "CAST(split_part(transaction_id, '-', 2) AS BIGINT)"
LOST = f"{NUMBER} % 29 = 0 AND chunk_id % 2 = 0"
BAD = f"{NUMBER} % 31 = 0 AND chunk_id % 3 = 0"
UNMARKED = f"{NUMBER} % 37 = 0"
BARRIER = f"""SELECT transaction_id, expected_chunks, missing_chunks, CAST(0 AS BIGINT) AS unexpected_chunks, corrupt_chunks, CASE WHEN {UNMARKED} THEN 'held_commit_marker_missing' WHEN missing_chunks > 0 THEN 'held_chunks_missing' WHEN corrupt_chunks > 0 THEN 'rejected' ELSE 'globally_visible' END AS decision
  FROM (SELECT transaction_id, count(*) AS expected_chunks, count(*) FILTER ({LOST}) AS missing_chunks, count(*) FILTER (NOT ({LOST}) AND {BAD}) AS corrupt_chunks FROM ({CHUNKS}) GROUP BY ALL)"""


def _barrier(t):
    """Chunks are planned once and written: manifests, arrivals and markers are all made of them."""
    chunks = staged(protocol.partition_chunks(t("changes")), "chunks")
    arrived = chunks.where(f"NOT ({LOST})").withColumn("checksum", F.col("checksum") + F.when(F.expr(BAD), 1).otherwise(0))
    arrived = arrived.unionByName(arrived.where("chunk_id = 1"))  # delivered again
    return protocol.barrier(chunks, arrived, chunks.select("transaction_id").distinct().where(f"NOT ({UNMARKED})"))


@query("r7_barrier_visibility", BARRIER)
def _(t):
    return _barrier(t)


@query("j9_missing_chunks", f"SELECT transaction_id, chunk_id FROM ({CHUNKS}) WHERE {LOST}")
def _(t):
    chunks = protocol.partition_chunks(t("changes"))
    return chunks.select("transaction_id", "chunk_id").join(chunks.where(f"NOT ({LOST})").select("transaction_id", "chunk_id"), ["transaction_id", "chunk_id"], "left_anti")


@query("p10_corrupt_chunks", f"SELECT transaction_id, corrupt_chunks FROM ({BARRIER}) WHERE corrupt_chunks > 0")
def _(t):
    return _barrier(t).where("corrupt_chunks > 0").select("transaction_id", "corrupt_chunks")


@query("a23_barrier_pending_stats", f"SELECT decision, count(*) AS transactions, CAST(sum(missing_chunks) AS BIGINT) AS missing_chunks FROM ({BARRIER}) GROUP BY ALL")
def _(t):
    return _barrier(t).groupBy("decision").agg(F.count("*").alias("transactions"), F.sum("missing_chunks").alias("missing_chunks"))


@query("r6_reconstruct_barrier", f"""SELECT idempotency_key, CAST(row_number() OVER (PARTITION BY transaction_id ORDER BY total_order) AS INTEGER) AS apply_position, false AS repeated FROM {{changes}} WHERE transaction_id IN (SELECT transaction_id FROM ({BARRIER}) WHERE decision = 'globally_visible')""")
def _(t):
    visible = _barrier(t).where("decision = 'globally_visible'")
    return protocol.reconstruct(t("changes"), visible).select("idempotency_key", "apply_position", "repeated")


@query("o2_operation_order", "SELECT operation, CASE operation WHEN 'delete' THEN 0 WHEN 'update' THEN 1 WHEN 'insert' THEN 2 END AS operation_rank, count(*) AS n FROM {changes} GROUP BY ALL")
def _(t):
    return t("changes").groupBy("operation", protocol.operation_rank(F.col("operation")).alias("operation_rank")).agg(F.count("*").alias("n"))


@query("o1_total_order", "SELECT transaction_id, string_agg(idempotency_key, ',' ORDER BY total_order) AS ordered FROM {changes} GROUP BY ALL")
def _(t):
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("total_order", "idempotency_key"))), lambda x: x["idempotency_key"])
    return t("changes").groupBy("transaction_id").agg(F.array_join(ordered, ",").alias("ordered"))


_BOUND = f"(SELECT m.*, x.lsn, x.commit_timestamp_ms FROM ({MANIFESTS % ('partitioned', CHUNKS)}) m JOIN {{txns}} x ON x.transaction_id = m.transaction_id)"
#: Faults of markers, by LSN: column, what it becomes.
_FAULTS = {
    "transaction_id": "CASE WHEN lsn % 688 = 0 THEN concat(transaction_id, '?') WHEN lsn % 752 = 0 THEN concat(transaction_id, ' ') ELSE transaction_id END", "lsn": "CASE WHEN lsn % 272 = 0 THEN lsn + 16 WHEN lsn % 784 = 0 THEN 0 ELSE lsn END",
    "commit_timestamp_ms": "CASE WHEN lsn % 368 = 0 THEN commit_timestamp_ms + 1 WHEN lsn % 848 = 0 THEN 0 ELSE commit_timestamp_ms END", "global_event_count": "CASE WHEN lsn % 464 = 0 THEN global_event_count + 1 WHEN lsn % 656 = 0 THEN 0 ELSE global_event_count END",
    "chunk_count": "CASE WHEN lsn % 496 = 0 THEN chunk_count + 1 WHEN lsn % 528 = 0 THEN 0 ELSE chunk_count END", "manifest_checksum": "CASE WHEN lsn % 592 = 0 THEN manifest_checksum + 1 WHEN lsn % 560 = 0 THEN 0 ELSE manifest_checksum END",
}
_MARKERS = f"(SELECT {', '.join(f'{e} AS {c}' for c, e in _FAULTS.items())} FROM {_BOUND})"


@query("p11_validate_commit_marker", _codes(f"(SELECT k.*, m.lsn AS l, m.commit_timestamp_ms AS ms, m.global_event_count AS n, m.chunk_count AS c, m.manifest_checksum AS x FROM {_MARKERS} k LEFT JOIN {_BOUND} m ON m.transaction_id = k.transaction_id)", "transaction_id",
    _dirty("transaction_id"), ("zero_lsn", "lsn = 0"), ("zero_timestamp", "commit_timestamp_ms <= 0"), ("zero_event_count", "global_event_count = 0"), ("zero_partition_count", "chunk_count = 0"), ("zero_manifest_checksum", "manifest_checksum = 0"), ("no_manifest", "l IS NULL"),
    ("lsn", "lsn <> l"), ("timestamp", "commit_timestamp_ms <> ms"), ("event_count", "global_event_count <> n"), ("partition_count", "chunk_count <> c"), ("manifest_checksum", "manifest_checksum <> x")))
def _(t):
    m = protocol.manifests(protocol.partition_chunks(t("changes")), "partitioned", t("txns"))
    return protocol.marker_violations(m.selectExpr(*[f"{e} AS {c}" for c, e in _FAULTS.items()]), m)


@query("r8_partition_local_view", f"SELECT transaction_id, chunk_id, event_count, CAST(sum(event_count) OVER w AS BIGINT) AS global_event_count, count(*) OVER w = 1 AS transaction_complete FROM ({CHUNKS}) WINDOW w AS (PARTITION BY transaction_id)")
def _(t):
    return protocol.local_views(protocol.partition_chunks(t("changes")))


DDL_N = "(SELECT transaction_id, count(*) AS ddl FROM {ddl} GROUP BY ALL)"


@query("r9_boundary_kind", f"SELECT CASE WHEN ddl IS NULL THEN 'partition_parallel_dml' ELSE 'ddl_barrier_required' END AS decision, count(*) AS transactions FROM {{txns}} LEFT JOIN {DDL_N} USING (transaction_id) GROUP BY ALL")
def _(t):
    dml = t("changes").groupBy("transaction_id").agg(F.count("*").alias("dml"))
    ddl = t("ddl").groupBy("transaction_id").agg(F.count("*").alias("ddl"))
    joined = dml.join(ddl, "transaction_id", "left").select(protocol.boundary_decision(F.col("dml"), F.coalesce("ddl", F.lit(0))).alias("decision"))
    return joined.groupBy("decision").agg(F.count("*").alias("transactions"))


@query("r10_dml_replay_after_ddl", "SELECT transaction_id, count(*) AS changes FROM {changes} WHERE transaction_id IN (SELECT transaction_id FROM {ddl}) GROUP BY ALL")
def _(t):
    return t("changes").join(t("ddl").select("transaction_id"), "transaction_id", "left_semi").groupBy("transaction_id").agg(F.count("*").alias("changes"))


@query("u6_dml_and_ddl_orders", "SELECT transaction_id, total_order, 'dml' AS kind FROM {changes} WHERE transaction_id IN (SELECT transaction_id FROM {ddl}) UNION ALL SELECT transaction_id, total_order, 'ddl' FROM {ddl}")
def _(t):
    dml = t("changes").join(t("ddl").select("transaction_id"), "transaction_id", "left_semi").select("transaction_id", "total_order", F.lit("dml").alias("kind"))
    return dml.unionByName(t("ddl").select("transaction_id", "total_order", F.lit("ddl").alias("kind")))




@query("r1_partition_for_key", f"SELECT idempotency_key, CAST({MD5('record_key')} % 8 AS INTEGER) AS target_partition FROM {{changes}}")
def _(t):
    return t("changes").select("idempotency_key", protocol.partition_for_key(F.col("record_key"), 8).alias("target_partition"))


for _policy, _null in (("quarantine", "NULL"), ("dead_letter", "7"), ("singleton", "0"), ("derive", f"{MD5('record_key')} % 8")):

    @query(f"r2_route_{_policy}", f"SELECT idempotency_key, CAST(CASE WHEN partition_key IS NULL THEN {_null} ELSE {MD5('partition_key')} % 8 END AS INTEGER) AS target_partition FROM {{routed}}")
    def _(t, policy=_policy):
        return protocol.route(t("routed"), 8, policy).select("idempotency_key", "target_partition")


MOVES = f"""SELECT transaction_id, total_order, operation, CAST({MD5("coalesce(k, '')")} % 8 AS INTEGER) AS target_partition, idempotency_key || suffix AS idempotency_key FROM (
  SELECT *, 'delete' AS operation, key_before AS k, ':move_delete' AS suffix FROM {{moves}} UNION ALL SELECT *, 'insert', key_after, ':move_insert' FROM {{moves}}) WHERE key_before IS DISTINCT FROM key_after"""


@query("r3_key_change_moves", MOVES)
def _(t):
    return protocol.emit_moves(t("moves"), 8)


@query("u7_move_fan_out", f"SELECT operation, count(*) AS n FROM ({MOVES}) GROUP BY ALL")
def _(t):
    return protocol.emit_moves(t("moves"), 8).groupBy("operation").agg(F.count("*").alias("n"))


@query("r41_messages", f"""SELECT transaction_id, topic, key, CAST(sequence AS INTEGER) AS sequence FROM (SELECT transaction_id, 'cdc.' || source_id || '.retail.partition.' || chunk_id AS topic, source_id || ':' || transaction_id AS key, row_number() OVER (PARTITION BY transaction_id ORDER BY chunk_id) AS sequence FROM ({CHUNKS}) JOIN {{txns}} USING (transaction_id)
  UNION ALL SELECT transaction_id, 'cdc.' || source_id || '.retail.' || kind, source_id || ':' || transaction_id, n + k FROM (SELECT transaction_id, count(*) AS n FROM ({CHUNKS}) GROUP BY ALL) JOIN {{txns}} USING (transaction_id) CROSS JOIN (VALUES (1, 'manifest'), (2, 'commit')) v(k, kind))""")
def _(t):
    return protocol.messages(t("txns"), protocol.partition_chunks(t("changes")), "partitioned").drop("kind", "chunk_id")


_HEAD = "transaction_id || '|' || source_id || '|' || commit_lsn || '|' || coalesce(ddl, 0) || '|' || CASE WHEN coalesce(ddl, 0) > 0 THEN 'ddl_barrier_required|true' ELSE 'partition_parallel_dml|false' END"


@query("r41_message_headers", f"""WITH h AS (SELECT t.*, ddl FROM {{txns}} t LEFT JOIN (SELECT transaction_id, count(*) AS ddl FROM {{ddl}} GROUP BY ALL) USING (transaction_id)), c AS ({CHUNKS}), m AS ({MANIFESTS % ('partitioned', CHUNKS)})
  SELECT transaction_id, 'partition_chunk|' || {_HEAD} || '|' || chunk_id || '|' || event_count || '|' || checksum AS headers FROM c JOIN h USING (transaction_id)
  UNION ALL SELECT transaction_id, kind || '|' || {_HEAD} || '|' || global_event_count || '|' || chunk_count || '|' || manifest_checksum FROM m JOIN h USING (transaction_id) CROSS JOIN (VALUES ('manifest'), ('commit_marker')) v(kind)""")
def _(t):
    chunks = staged(protocol.partition_chunks(t("changes")), "chunks")
    made = protocol.message_headers(protocol.messages(t("txns"), chunks, "partitioned"), t("txns"), chunks, protocol.manifests(chunks, "partitioned"), t("ddl"))
    get = lambda k: F.col("headers")[k]
    told = ("message_kind", "transaction_id", "source_id", "commit_lsn", "ddl_event_count", "partitioned_scale_decision", "requires_ddl_barrier", "partition_id", "partition_event_count", "partition_checksum", "global_event_count", "partition_count", "manifest_checksum")
    return made.select("transaction_id", F.concat_ws("|", *map(get, told)).alias("headers"))


DISPOSITION = "CASE WHEN kind = 'add_column' AND auto THEN 'auto_apply' WHEN kind IN ('unspecified', 'other') THEN 'unsupported' ELSE 'manual_review' END"


@query("r11_classify_ddl", f"SELECT kind, auto, {DISPOSITION} AS disposition, count(*) AS n FROM {{ddl}} GROUP BY ALL")
def _(t):
    return t("ddl").groupBy("kind", "auto", protocol.ddl_disposition(F.col("kind"), F.col("auto")).alias("disposition")).agg(F.count("*").alias("n"))


@query("a24_ddl_policy_summary", f"SELECT count(*) FILTER (d = 'auto_apply') AS auto_apply, count(*) FILTER (d = 'manual_review') AS manual_review, count(*) FILTER (d = 'unsupported') AS unsupported, count(*) FILTER (d <> 'unsupported') AS ack_required FROM (SELECT {DISPOSITION} AS d FROM {{ddl}})")
def _(t):
    return protocol.ddl_policy_summary(t("ddl"))


@query("r12_ddl_policy_sha256", f"SELECT transaction_id, sha256(min(transaction_id) || chr(10) || string_agg(total_order || '|' || relation || '|' || kind || '|' || fingerprint_before || '|' || fingerprint_after || '|' || {DISPOSITION}, chr(10) ORDER BY total_order)) AS policy_sha256 FROM {{ddl}} GROUP BY ALL")
def _(t):
    return protocol.ddl_policy_digest(t("ddl"))


@query("r13_validate_ddl_event", "SELECT transaction_id, relation, 'unchanged_fingerprint' AS violation FROM {ddl} WHERE fingerprint_before = fingerprint_after UNION ALL SELECT transaction_id, relation, 'fingerprint_after' FROM {ddl} WHERE fingerprint_after = 0 UNION ALL SELECT transaction_id, relation, 'auto_kind' FROM {ddl} WHERE auto AND kind <> 'add_column'")
def _(t):
    return protocol.ddl_event_violations(t("ddl"))


@query("r14_ddl_schema_evidence", "SELECT transaction_id, relation, f AS fingerprint, version FROM (SELECT transaction_id, relation, arg_max(fingerprint_after, total_order) AS f FROM {ddl} GROUP BY ALL) LEFT JOIN {schema_versions} USING (transaction_id, relation) WHERE f IS DISTINCT FROM version")
def _(t):
    return protocol.schema_evidence_violations(t("ddl"), t("schema_versions"))


def _images(t):
    """The cells as images: before holds the key alone, after all columns."""
    rows = t("cells")
    data = F.col("record_key").cast("binary")
    key = lambda text, kind: images.cell("id", text, kind, data, is_key=True)
    before = images.image(key(F.concat(F.lit("before:"), "record_key"), F.col("before_key_kind")))
    rest = [images.cell("amount", F.col("amount"), F.col("amount_kind")), images.cell("status", F.col("status"), F.col("status_kind"))]
    text = F.when(F.col("key_moved"), F.concat(F.lit("after:"), "record_key")).otherwise(F.concat(F.lit("before:"), "record_key"))
    after = F.when(F.col("has_key"), images.image(key(text, F.col("key_kind")), *rest)).otherwise(images.image(*rest))
    return rows.withColumns({"before": F.when(F.col("has_before"), before), "after": F.when(F.col("has_after"), after)})


_AFTER_KEY = "CASE WHEN key_moved THEN 'after:' || record_key ELSE 'before:' || record_key END"


@query("p1_project_row", f"""SELECT idempotency_key, CASE WHEN has_after THEN (CASE WHEN has_key THEN 'id=' || key_kind || ':' || (CASE key_kind WHEN 'text' THEN {_AFTER_KEY} WHEN 'binary' THEN '<binary:' || strlen(record_key) || '>' ELSE '' END) || ';' ELSE '' END)
  || 'status=' || status_kind || ':' || CASE status_kind WHEN 'text' THEN status ELSE '' END END AS shown FROM {{cells}}""")
def _(t):
    kept = images.project(F.col("after"), ["amount"])
    shown = F.array_join(F.transform(kept, lambda c: F.concat(c["name"], F.lit("="), c["kind"], F.lit(":"), F.coalesce(c["value"], F.lit("")))), ";")
    return _images(t).select("idempotency_key", shown.alias("shown"))


@query("p2_record_key", f"""SELECT idempotency_key, CASE WHEN has_after THEN (CASE key_kind WHEN 'text' THEN {_AFTER_KEY} WHEN 'binary' THEN '<binary:' || strlen(record_key) || '>' ELSE '' END) ELSE (CASE before_key_kind WHEN 'text' THEN 'before:' || record_key ELSE '' END) END AS record_key
  FROM {{cells}} WHERE CASE WHEN has_after THEN has_key ELSE has_before END""")
def _(t):
    rows = _images(t).where(F.when(F.col("has_after"), F.col("has_key")).otherwise(F.col("has_before")))  # the others are an error
    return rows.select("idempotency_key", images.record_key(F.col("before"), F.col("after"), "id").alias("record_key"))


@query("p3_partition_key_value", "SELECT idempotency_key, CASE WHEN has_after THEN (CASE status_kind WHEN 'text' THEN status ELSE '' END) END AS partition_key FROM {cells}")
def _(t):
    return _images(t).select("idempotency_key", images.partition_key(F.col("before"), F.col("after"), "status").alias("partition_key"))


_LOOKS = "operation IN ('update', 'delete')"
_KEYS = "CASE WHEN operation = 'delete' THEN has_before ELSE has_before OR has_key END"
_KEY_KIND = "CASE WHEN operation = 'delete' OR has_before THEN before_key_kind ELSE key_kind END"
_MOVED = "(has_key AND has_before AND (before_key_kind <> key_kind OR (key_kind = 'text' AND key_moved)))"
_SENT = f"({_MOVED} OR amount_kind <> 'unchanged' OR status_kind <> 'unchanged')"
_SET = f"concat_ws(',', CASE WHEN operation = 'insert' AND has_key OR operation = 'update' AND {_MOVED} THEN 'id' END, CASE WHEN operation = 'insert' OR status_kind <> 'unchanged' THEN 'status' END)"


@query("r16_plan_apply", f"""SELECT idempotency_key, error, CASE WHEN error IS NOT NULL THEN 'error' WHEN operation = 'update' AND relation = 'public.events' AND cols = '' THEN 'no_op' ELSE operation END AS action, CASE WHEN error IS NULL AND operation IN ('insert', 'update') AND NOT (operation = 'update' AND relation = 'public.events' AND cols = '') THEN cols END AS set_columns,
    CASE WHEN error IS NULL AND {_LOOKS} AND NOT (operation = 'update' AND relation = 'public.events' AND cols = '') THEN coalesce(CASE WHEN operation = 'delete' OR has_before THEN CASE before_key_kind WHEN 'text' THEN 'before:' || record_key ELSE '' END ELSE CASE key_kind WHEN 'text' THEN {_AFTER_KEY} WHEN 'binary' THEN '<binary:' || strlen(record_key) || '>' ELSE '' END END, '') END AS key_value
  FROM (SELECT *, CASE WHEN relation = 'public.events' THEN {_SET} ELSE concat_ws(',', CASE WHEN operation = 'insert' AND has_key OR operation = 'update' AND {_MOVED} THEN 'id' END, CASE WHEN operation = 'insert' OR amount_kind <> 'unchanged' THEN 'amount' END, CASE WHEN operation = 'insert' OR status_kind <> 'unchanged' THEN 'status' END) END AS cols,
    CASE WHEN transaction_id IN (SELECT transaction_id FROM {{ddl}}) THEN 'ddl_barrier_required' WHEN NOT EXISTS (SELECT 1 FROM {{sent_versions}} v WHERE v.transaction_id = c.transaction_id AND v.relation = c.relation) THEN 'schema_version_missing' WHEN operation = 'merge' THEN 'unsupported_operation'
      WHEN operation IN ('insert', 'update') AND NOT has_after THEN 'missing_after_image' WHEN operation = 'delete' AND NOT has_before THEN 'missing_before_image' WHEN {_LOOKS} AND {_KEYS} AND {_KEY_KIND} = 'unchanged' THEN 'unchanged_key' WHEN {_LOOKS} AND NOT ({_KEYS}) THEN 'missing_key'
      WHEN operation = 'update' AND NOT {_SENT} THEN 'no_mutable_columns' END AS error FROM {{cells}} c)""")
def _(t):
    plan = images.plan_apply(_images(t), {"public.events": ["amount"]}, t("sent_versions"), t("ddl"))
    cols = F.array_join(F.transform("set_columns", lambda c: c["name"]), ",")
    value = F.when(F.col("key_columns").isNotNull(), F.coalesce(F.col("key_columns")[0]["value"], F.lit("")))
    return plan.select("idempotency_key", "error", "action", cols.alias("set_columns"), value.alias("key_value"))


@query("p14_clean_field", "SELECT transaction_id, false AS clean FROM {txns} WHERE lsn % 80 = 0 UNION ALL SELECT transaction_id, true FROM {txns} WHERE lsn % 80 <> 0")
def _(t):
    padded = F.when(F.col("lsn") % 80 == 0, F.concat(F.lit(" "), "source_id")).otherwise(F.col("source_id"))
    return t("txns").select("transaction_id", names.clean(padded).alias("clean"))


@query("r20_visibility_boundary", f"SELECT transaction_id, CASE WHEN chunk_count = 1 THEN 'strict_envelope' ELSE 'partition_manifest_barrier' END AS boundary FROM ({MANIFESTS % ('partitioned', CHUNKS)})")
def _(t):
    m = protocol.manifests(protocol.partition_chunks(t("changes")), "partitioned")
    return m.select("transaction_id", F.when(F.col("chunk_count") == 1, "strict_envelope").when(F.col("boundary_mode") == "strict_chunked", "strict_chunk_manifest_barrier").otherwise("partition_manifest_barrier").alias("boundary"))


