"""Queries of checkpoints, watermarks, acknowledgements, snapshots and quarantine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.operators import state
from ledgerlake.plans.registry import query

N = 8


@query("d14_merge_checkpoint", "SELECT flow_id, max(last_seen) AS last_seen, max(durable) AS durable, max(applied) AS applied FROM {checkpoint_updates} GROUP BY ALL")
def _(t):
    return state.merge_checkpoints(t("checkpoint_updates"))


_BEFORE = "OVER (PARTITION BY flow_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
REWINDS = " UNION ALL ".join(f"SELECT flow_id, seq, '{f}' AS field FROM (SELECT *, max({f}) {_BEFORE} AS m FROM {{checkpoint_updates}}) WHERE {f} < m" for f in ("last_seen", "durable", "applied"))


@query("w9_rewind_detection", REWINDS)
def _(t):
    return state.rewinds(t("checkpoint_updates"))


@query("p13_checkpoint_order", "SELECT flow_id, seq FROM {checkpoint_updates} WHERE applied > durable OR durable > last_seen")
def _(t):
    return state.order_violations(t("checkpoint_updates")).select("flow_id", "seq")


@query("a16_checkpoint_lag", "SELECT flow_id, greatest(last_seen - durable, 0) AS publish_lag_bytes, greatest(durable - applied, 0) AS apply_lag_bytes, greatest(last_seen - applied, 0) AS total_lag_bytes FROM (SELECT flow_id, max(last_seen) AS last_seen, max(durable) AS durable, max(applied) AS applied FROM {checkpoint_updates} GROUP BY ALL)")
def _(t):
    return state.lag(state.merge_checkpoints(t("checkpoint_updates")))


MARKS = """SELECT flow_id, n = 8 AS complete, 8 - n AS missing, CASE WHEN n = 8 THEN d END AS global_durable, CASE WHEN n = 8 THEN a END AS global_applied, max_applied, lag_bytes
  FROM (SELECT flow_id, count(DISTINCT partition_id) AS n, min(durable) AS d, min(applied) AS a, max(applied) AS max_applied, CAST(sum(greatest(durable - applied, 0)) AS BIGINT) AS lag_bytes FROM {partition_checkpoints} WHERE partition_id BETWEEN 0 AND 7 GROUP BY ALL)"""
EXPECTED = "(SELECT flow_id, CAST(k AS INTEGER) AS partition_id FROM (SELECT DISTINCT flow_id FROM {partition_checkpoints}) CROSS JOIN range(8) r(k))"


@query("a12_partition_watermarks", MARKS)
def _(t):
    return state.watermarks(t("partition_checkpoints"), N)


@query("t1_low_watermark", f"SELECT flow_id, global_applied FROM ({MARKS}) WHERE complete")
def _(t):
    return state.watermarks(t("partition_checkpoints"), N).where("complete").select("flow_id", "global_applied")


@query("w7_global_low_watermark", "SELECT flow_id, partition_id, applied, min(applied) OVER (PARTITION BY flow_id) AS low FROM {partition_checkpoints}")
def _(t):
    from pyspark.sql import Window

    return t("partition_checkpoints").select("flow_id", "partition_id", "applied", F.min("applied").over(Window.partitionBy("flow_id")).alias("low"))


@query("a12_blocking_partitions", f"SELECT flow_id, partition_id, applied, max_applied FROM {{partition_checkpoints}} JOIN ({MARKS}) USING (flow_id) WHERE applied = global_applied AND applied < max_applied")
def _(t):
    return state.blocking_partitions(t("partition_checkpoints"), N)


@query("j13_missing_partitions", f"SELECT flow_id, partition_id FROM {EXPECTED} EXCEPT SELECT flow_id, partition_id FROM {{partition_checkpoints}}")
def _(t):
    return state.missing_partitions(t("partition_checkpoints"), N)


@query("a13_partition_health", f"SELECT flow_id, partition_id, CASE WHEN durable IS NULL THEN 'missing' WHEN applied < durable THEN 'lagging' ELSE 'ready' END AS status FROM {EXPECTED} LEFT JOIN {{partition_checkpoints}} USING (flow_id, partition_id)")
def _(t):
    return state.partition_health(t("partition_checkpoints"), N)


@query("a11_watermark_rollup", f"SELECT min(global_applied) AS global_low, max(max_applied) AS highest, count(*) FILTER (complete) AS complete_flows, count(*) FILTER (NOT complete) AS incomplete_flows FROM ({MARKS})")
def _(t):
    m = state.watermarks(t("partition_checkpoints"), N)
    return m.agg(F.min("global_applied").alias("global_low"), F.max("max_applied").alias("highest"), F.count_if("complete").alias("complete_flows"), F.count_if(~F.col("complete")).alias("incomplete_flows"))


_LOADS = "SELECT epoch_id, partition_id, CAST(sum(event_count) AS BIGINT) AS n FROM {manifest_partitions} GROUP BY ALL"


@query("a10_partition_skew", f"""SELECT epoch_id, lo AS min_events, hi AS max_events, total AS total_events, string_agg(partition_id, ',' ORDER BY partition_id) FILTER (n = hi) AS hottest, string_agg(partition_id, ',' ORDER BY partition_id) FILTER (n = lo) AS coolest,
  CASE WHEN lo > 0 THEN hi * 10000 // lo END AS ratio_bp FROM (SELECT *, min(n) OVER w AS lo, max(n) OVER w AS hi, CAST(sum(n) OVER w AS BIGINT) AS total FROM ({_LOADS}) WINDOW w AS (PARTITION BY epoch_id)) GROUP BY ALL""")
def _(t):
    return state.skew(t("manifest_partitions"))


@query("a14_rebalance_plan", f"""SELECT epoch_id, f AS from_partition, g AS to_partition, (hi - lo) // 2 AS move_events FROM (SELECT epoch_id, max(n) AS hi, min(n) AS lo, arg_max(partition_id, (n, partition_id)) AS f, arg_min(partition_id, (n, partition_id)) AS g FROM ({_LOADS}) GROUP BY ALL) WHERE hi * 100 > lo * 101""")
def _(t):
    return state.rebalance(t("manifest_partitions"), 1)


ACKS = """SELECT consumer, topic, seq, offset_, CASE WHEN offset_ <= c THEN 'repeated' WHEN offset_ = c + 1 THEN 'applied' ELSE 'non_contiguous' END AS result
  FROM (SELECT *, coalesce(max(offset_) OVER (PARTITION BY consumer, topic ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS c FROM {acks})"""


def _acks(t):
    return state.ack_gaps(t("acks").withColumnRenamed("offset_", "offset")).withColumnRenamed("offset", "offset_")


@query("w10_ack_gap", ACKS)
def _(t):
    return _acks(t)


@query("s7_ack_contiguous", f"SELECT consumer, result, count(*) AS n FROM ({ACKS}) GROUP BY ALL")
def _(t):
    return _acks(t).groupBy("consumer", "result").agg(F.count("*").alias("n"))


@query("s9_inspect_stream", "SELECT consumer, topic, depth, coalesce(cursor_at, -1) AS cursor_at, depth - 1 - coalesce(cursor_at, -1) AS lag FROM (SELECT consumer, topic, count(*) AS depth, max(offset_) FILTER (seq % 3 = 0 AND offset_ >= 0) AS cursor_at FROM {acks} GROUP BY ALL)")
def _(t):
    depth = t("acks").groupBy("consumer", "topic").agg(F.count("*").alias("depth"))
    cursor = t("acks").where("seq % 3 = 0 AND offset_ >= 0").groupBy("consumer", "topic").agg(F.max("offset_").alias("c"))
    joined = depth.join(cursor, ["consumer", "topic"], "left").withColumn("cursor_at", F.coalesce("c", F.lit(-1).cast("long")))
    return joined.select("consumer", "topic", "depth", "cursor_at", (F.col("depth") - 1 - F.col("cursor_at")).alias("lag"))


_MOVES = " OR ".join(f"(was = '{a}' AND state = '{b}')" for a, bs in state.SNAPSHOT_MOVES.items() for b in bs)


@query("r37_snapshot_state_machine", f"""WITH s AS (SELECT *, lag(state) OVER w AS was, lag(copied_rows) OVER w AS r, lag(consistent_lsn) OVER w AS l FROM {{snapshot_runs}} WINDOW w AS (PARTITION BY run_id ORDER BY seq))
  SELECT run_id, seq, 'transition' AS violation FROM s WHERE was <> state AND NOT ({_MOVES}) UNION ALL SELECT run_id, seq, 'copied_rows' FROM s WHERE copied_rows < r UNION ALL SELECT run_id, seq, 'consistent_lsn' FROM s WHERE consistent_lsn <> l""")
def _(t):
    return state.snapshot_violations(t("snapshot_runs"))


@query("a26_snapshot_handoff_readiness", "SELECT count(*) AS relations, count(*) FILTER (p_partkey % 3 <> 0 AND p_partkey % 10 <> 0) AS ready_relations, CAST(coalesce(sum(p_partkey) FILTER (p_partkey % 3 <> 0 AND p_partkey % 10 <> 0), 0) AS BIGINT) AS copied_rows, false AS ready FROM {part}")
def _(t):
    p = t("part").select(F.col("p_partkey").cast("string").alias("relation"), "p_partkey")
    progress = p.where("p_partkey % 10 <> 0").select("relation", F.lit("copy_complete").alias("state"), F.when(F.col("p_partkey") % 3 == 0, 8).otherwise(7).alias("consistent_lsn"), F.col("p_partkey").cast("long").alias("copied_rows"))
    return state.handoff_readiness(p.select("relation"), progress, 7)


@query("r18_quarantine", "SELECT transaction_id, CAST(sum(attempts) AS BIGINT) AS attempts, min(first_seen_ms) AS first_seen_ms, max(last_seen_ms) AS last_seen_ms, arg_max(error, last_seen_ms) AS error FROM (SELECT * FROM {old_failures} UNION ALL SELECT * FROM {failures}) GROUP BY ALL")
def _(t):
    return state.quarantine_upsert(t("old_failures"), t("failures"))


_STATUS = """SELECT b.barrier_id, coalesce(n.sink, a.sink) AS sink, CASE WHEN n.sink IS NULL THEN 'unexpected' WHEN a.sink IS NULL THEN 'pending' WHEN a.accepted AND a.ack_lsn >= b.barrier_lsn THEN 'acked' ELSE 'rejected' END AS status
  FROM {barrier_needs} n FULL JOIN {barrier_acks} a ON a.barrier_id = n.barrier_id AND a.sink = n.sink JOIN (SELECT DISTINCT barrier_id, barrier_lsn FROM {barrier_needs}) b ON b.barrier_id = coalesce(n.barrier_id, a.barrier_id)"""
_LIST = "coalesce(string_agg(sink, ',' ORDER BY sink) FILTER (status = '{0}'), '') AS {0}".format
RELEASE = f"SELECT *, acked <> '' AND pending = '' AND rejected = '' AND unexpected = '' AS release_dml FROM (SELECT barrier_id, {_LIST('acked')}, {_LIST('pending')}, {_LIST('rejected')}, {_LIST('unexpected')} FROM ({_STATUS}) GROUP BY ALL)"


def _release(t):
    barriers = t("barrier_needs").groupBy("barrier_id", "barrier_lsn").agg(F.collect_list("sink").alias("required_sinks"))
    return state.ddl_release(barriers, t("barrier_acks"))


@query("a25_ddl_release_summary", RELEASE)
def _(t):
    return _release(t)


@query("j10_barrier_acks", f"SELECT status, count(*) AS n FROM ({_STATUS}) GROUP BY ALL")
def _(t):
    r = _release(t)
    size = lambda c: F.when(F.col(c) == "", 0).otherwise(F.size(F.split(c, ",")))
    each = F.array(*[F.struct(F.lit(c).alias("status"), size(c).cast("long").alias("n")) for c in ("acked", "pending", "rejected", "unexpected")])
    return r.select(F.inline(each)).groupBy("status").agg(F.sum("n").alias("n")).where("n > 0")


@query("r39_dml_release_at_boundary", f"SELECT barrier_id, release_dml AND CAST(substr(barrier_id, 9) AS BIGINT) % 2 = 0 AS released FROM ({RELEASE})")
def _(t):
    at = t("barrier_needs").select("barrier_id", F.col("barrier_lsn")).distinct().withColumn("commit_lsn", F.col("barrier_lsn") + F.expr("CAST(substr(barrier_id, 9) AS BIGINT)") % 2)
    return _release(t).join(at, "barrier_id").select("barrier_id", (F.col("release_dml") & (F.col("barrier_lsn") == F.col("commit_lsn"))).alias("released"))


@query("r38_ddl_ack_rewind", """SELECT barrier_id, sink, seq, CASE WHEN ack_lsn < l THEN 'rewind' ELSE 'conflict' END AS violation FROM (SELECT *, lag(ack_lsn) OVER w AS l, lag(accepted) OVER w AS d FROM {ack_history} WINDOW w AS (PARTITION BY barrier_id, sink ORDER BY seq)) WHERE ack_lsn < l OR (ack_lsn = l AND accepted <> d)""")
def _(t):
    return state.ack_conflicts(t("ack_history"))


@query("r40_source_ack_boundary", "SELECT transaction_id, count(*) = max(expected) AND count(DISTINCT destination) = 1 AND max(lsn) <= 8589960000 AS may_acknowledge FROM {published} GROUP BY ALL")
def _(t):
    return state.source_ack(t("published"), F.col("expected"), F.lit(8589960000))


@query("t4_exactly_once", "SELECT transaction_id, min(arrival_seq) AS first_arrival FROM {arrivals} GROUP BY ALL")
def _(t):
    from ledgerlake.operators import lake

    return lake.admitted(t("arrivals")).select("transaction_id", F.col("arrival_seq").alias("first_arrival"))
