"""Queries that drain streams, and of logs and tables that are published once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.operators import protocol
from ledgerlake.plans.protocol import CHUNKS, LOST, NUMBER, UNMARKED
from ledgerlake.plans.registry import query
from ledgerlake.sources import local_log
from ledgerlake.storage import ManifestTable, fresh_dir, staged
from ledgerlake.streaming import ingest


def _stream(t, df, files: int, name: str, per_trigger: int):
    """df as a stream of files: written to the shared folder, then read a few files at a time."""
    path = fresh_dir(t.spark, name)
    df.repartition(files).write.parquet(path)
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def _tables(t):
    """A table whose commits know their LSN range, its quarantine, and a folder for progress."""
    return ManifestTable(t.spark, fresh_dir(t.spark, "table"), "lsn"), ManifestTable(t.spark, fresh_dir(t.spark, "bad")), fresh_dir(t.spark, "progress")


_TXN = "SELECT source_id, transaction_id, lsn FROM {txns}"


@query("t4_streamed_exactly_once", _TXN)
def _(t):
    table, bad, progress = _tables(t)
    ingest.ingest(_stream(t, t("arrivals"), 4, "arrivals", 2), table, bad, progress)
    return table.read().select("source_id", "transaction_id", "lsn")


@query("t4_streamed_conflicts", "SELECT transaction_id, arrival_seq FROM {arrivals} WHERE arrival_seq >= 3000000000")
def _(t):
    table, bad, progress = _tables(t)
    ordered = t("arrivals").repartitionByRange(4, "arrival_seq")
    path = fresh_dir(t.spark, "arrivals")
    for k, some in enumerate((ordered.where("arrival_seq < 3000000000"), ordered.where("arrival_seq >= 3000000000"))):
        some.write.mode("append").parquet(path)
        stream = t.spark.readStream.schema(ordered.schema).option("maxFilesPerTrigger", 2).parquet(path)
        ingest.ingest(stream, table, bad, progress, checksum="envelope_checksum", order="arrival_seq")
    return bad.read().select("transaction_id", "arrival_seq")


@query("t9_failure_quarantine", "SELECT transaction_id, arrival_seq FROM {arrivals} WHERE lsn % 272 = 0")
def _(t):
    table, bad, progress = _tables(t)
    ingest.ingest(_stream(t, t("arrivals"), 2, "arrivals", 1), table, bad, progress, valid="lsn % 272 <> 0")
    return bad.read().select("transaction_id", "arrival_seq")


AGAIN = f"{NUMBER} % 41 = 0 AND chunk_id % 2 = 1"


@query("t5_barrier_stream", f"""SELECT transaction_id, CASE WHEN again THEN 'conflicting_redelivery' WHEN unmarked THEN 'held_commit_marker_missing' WHEN missing > 0 THEN 'held_chunks_missing' ELSE 'globally_visible' END AS decision
  FROM (SELECT transaction_id, bool_or({AGAIN} AND NOT ({LOST})) AS again, bool_or({UNMARKED}) AS unmarked, count(*) FILTER ({LOST}) AS missing FROM ({CHUNKS}) GROUP BY ALL)""")
def _(t):
    chunks = staged(protocol.partition_chunks(t("changes")), "chunks")
    none, long = F.lit(None).cast("int"), F.lit(None).cast("long")
    counts = chunks.groupBy("transaction_id").agg(F.count("*").cast("int").alias("chunk_count"))
    chunk = chunks.where(f"NOT ({LOST})").select("transaction_id", F.lit("chunk").alias("kind"), "chunk_id", "checksum", none.alias("chunk_count"))
    messages = (
        chunk.unionByName(chunk.where(AGAIN).withColumn("checksum", F.col("checksum") + 1))  # delivered again, with another checksum
        .unionByName(chunk.where("chunk_id = 0"))
        .unionByName(counts.select("transaction_id", F.lit("manifest").alias("kind"), none.alias("chunk_id"), long.alias("checksum"), "chunk_count"))
        .unionByName(counts.where(f"NOT ({UNMARKED})").select("transaction_id", F.lit("commit").alias("kind"), none.alias("chunk_id"), long.alias("checksum"), none.alias("chunk_count")))
    )
    # conflicts have to come before the transaction is visible, so markers travel in the last file
    path = fresh_dir(t.spark, "messages")
    for k, kinds in enumerate(("kind = 'chunk'", "kind = 'manifest'", "kind = 'commit'")):
        messages.where(kinds).coalesce(2 if k == 0 else 1).write.mode("append").parquet(path)
    out = ManifestTable(t.spark, fresh_dir(t.spark, "decisions"))
    stream = t.spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(path)
    ingest.drain(ingest.barrier(stream), lambda batch, k: out.append(batch.withColumn("batch", F.lit(k)), str(k)) and None, fresh_dir(t.spark, "progress"), "update")
    return out.read().groupBy("transaction_id").agg(F.max_by("decision", "batch").alias("decision"))


@query("t8_bounded_run", "SELECT count(*) AS n FROM {events}")
def _(t):
    table, bad, progress = _tables(t)
    events = t("events").select(F.lit("events").alias("source_id"), F.col("event_id").cast("string").alias("transaction_id"), F.col("event_id").alias("lsn"))
    ingest.ingest(_stream(t, events, 3, "events", 1), table, bad, progress)
    return table.read().agg(F.count("*").alias("n"))


@query("t7_stream_backpressure", "SELECT count(*) AS n, 4 AS batches, true AS bounded FROM {events}")
def _(t):
    """Four files, one a batch: what a batch leaves waits at the source, and none is larger than a file."""
    table = ManifestTable(t.spark, fresh_dir(t.spark, "table"))
    events = t("events").repartitionByRange(4, "event_id")
    path = fresh_dir(t.spark, "events")
    events.write.parquet(path)
    most = t.spark.read.parquet(path).groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    stream = t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    ingest.drain(stream, lambda batch, k: table.append(batch.select("event_id"), str(k)) and None, fresh_dir(t.spark, "progress"))
    return table.manifest().where("rows > 0").agg(F.sum("rows").alias("n"), F.count("*").cast("int").alias("batches"), (F.max("rows") <= most).alias("bounded"))


@query("t2_epoch_labels", "SELECT date_trunc('hour', ts) AS epoch, count(*) AS n FROM {events} GROUP BY ALL")
def _(t):
    return t("events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("epoch")).agg(F.count("*").alias("n"))


_PROGRESS = "SELECT a.epoch_id, count(DISTINCT a.source_id) AS complete_source_count, (SELECT count(*) FROM {{required}} WHERE source_id < 'store-008') - count(DISTINCT a.source_id) AS missing_source_count FROM {{arrivals}} a WHERE a.source_id IN (SELECT source_id FROM {{required}} WHERE source_id < 'store-008'){0} GROUP BY ALL".format


@query("t2_streamed_epochs", f"SELECT *, CASE WHEN missing_source_count = 0 THEN 'complete' ELSE 'open' END AS state FROM ({_PROGRESS('')})")
def _(t):
    table = ManifestTable(t.spark, fresh_dir(t.spark, "progress-table"))
    ingest.epoch_progress(_stream(t, t("arrivals"), 3, "arrivals", 1), table, fresh_dir(t.spark, "progress"))
    return ingest.epoch_states(table, t("required").where("source_id < 'store-008'"), "wait_all_required")


@query("t3_late_source_stream", f"""SELECT 'before' AS moment, *, 'complete_with_gaps' AS state FROM ({_PROGRESS(" AND a.source_id <> 'store-007'")}) UNION ALL SELECT 'after', *, 'complete' FROM ({_PROGRESS('')})""")
def _(t):
    """One store comes after the others: the epochs have a gap, and are complete once it is there."""
    table, path, progress = ManifestTable(t.spark, fresh_dir(t.spark, "progress-table")), fresh_dir(t.spark, "arrivals"), fresh_dir(t.spark, "progress")
    out = None
    for moment, some in (("before", "source_id <> 'store-007'"), ("after", "source_id = 'store-007'")):
        t("arrivals").where(some).coalesce(2).write.mode("append").parquet(path)
        ingest.epoch_progress(t.spark.readStream.schema(t("arrivals").schema).parquet(path), table, progress)
        found = staged(ingest.epoch_states(table, t("required").where("source_id < 'store-008'"), "publish_with_gaps"), "states")
        found = found.select(F.lit(moment).alias("moment"), "*")
        out = found if out is None else out.unionByName(found)
    return out


@query("t6_acknowledged_after_durable", "SELECT transaction_id FROM {txns} WHERE lsn <= 8589942592")
def _(t):
    durable = t.spark.range(1).select(F.lit(8589942592).alias("durable"))
    return t("txns").join(F.broadcast(durable), F.col("lsn") <= F.col("durable")).select("transaction_id")


@query("t6_stream_acknowledgement", "SELECT source_id, transaction_id, lsn, 'after' AS moment FROM {txns} UNION ALL SELECT 'none', 'none', 0, 'during'")
def _(t):
    """The sink breaks between publishing and acknowledging: nothing is acknowledged then, and all exactly once after a restart."""
    table, acks, progress = ManifestTable(t.spark, fresh_dir(t.spark, "table")), ManifestTable(t.spark, fresh_dir(t.spark, "acks")), fresh_dir(t.spark, "progress")
    rows = t("txns").select(*ingest.KEY)
    path = fresh_dir(t.spark, "txns")
    rows.repartition(2).write.parquet(path)
    stream = lambda: t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)

    def broken(batch, batch_id):
        raise ConnectionError("the broker is gone")

    try:
        ingest.acknowledged(stream(), table, acks, progress, publish=broken)
    except Exception:  # noqa: BLE001  the stream's wrapper of the error above
        during = acks.manifest().count()
    ingest.acknowledged(stream(), table, acks, progress)
    none = t.spark.range(1).select(F.lit("none").alias("source_id"), F.lit("none").alias("transaction_id"), F.lit(during).cast("long").alias("lsn"), F.lit("during").alias("moment"))
    return acks.read().select(*ingest.KEY, F.lit("after").alias("moment")).unionByName(none)


def _log(t):
    messages = t("changes").select(F.col("status").alias("topic"), F.col("record_key").alias("key"), F.col("idempotency_key").alias("body"), F.struct("arrival_seq", "total_order", "idempotency_key").alias("seq"))
    path = fresh_dir(t.spark, "log")
    local_log.publish(messages, path)
    return t.spark.read.parquet(path)


@query("s6_local_log", "SELECT status AS topic, count(*) AS depth, count(*) - 1 AS last_offset FROM {changes} GROUP BY ALL")
def _(t):
    return _log(t).groupBy("topic").agg(F.count("*").alias("depth"), F.max("offset").alias("last_offset"))


@query("s6_local_log_consume", """SELECT topic, "offset", key, body FROM (SELECT status AS topic, row_number() OVER (PARTITION BY status ORDER BY arrival_seq, total_order, idempotency_key) - 1 AS "offset", record_key AS key, idempotency_key AS body, count(*) OVER (PARTITION BY status) AS n FROM {changes}) WHERE topic IN ('O', 'view') OR "offset" > n // 2""")
def _(t):
    log = _log(t)
    cursors = log.groupBy("topic").agg(F.floor(F.count("*") / 2).alias("cursor")).where("topic NOT IN ('O', 'view')")  # two topics have no cursor yet
    return local_log.consume(log, cursors).select("topic", "offset", "key", "body")


@query("s8_log_damage", "SELECT event_type AS topic, k AS \"offset\", 'checksum' AS damage FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS k FROM {events}) WHERE k % 100 = 7")
def _(t):
    log = local_log.frame(t("events").select(F.col("event_type").alias("topic"), F.lit("k").alias("key"), F.col("props").alias("body"), F.col("event_id").alias("seq")))
    return local_log.damage(log.withColumn("body", F.when(F.col("offset") % 100 == 7, F.concat("body", F.lit("!"))).otherwise(F.col("body"))))


@query("s12_idempotent_append", "SELECT 'committed' AS first, 'already_committed' AS again, (SELECT count(*) FROM {orders}) AS n")
def _(t):
    table = ManifestTable(t.spark, fresh_dir(t.spark, "orders"))
    rows = t("orders").select("o_orderkey")
    first, again = table.append(rows, "a"), table.append(rows, "a")
    return table.read().agg(F.count("*").alias("n")).select(F.lit(first).alias("first"), F.lit(again).alias("again"), "n")


@query("r17_apply_transactional", "SELECT transaction_id, 1 AS applied FROM {txns} WHERE lsn % 112 <> 0")
def _(t):
    """Transactions go to the target in two batches, the second one twice and with what the first had; those that break are set aside."""
    table, bad = ManifestTable(t.spark, fresh_dir(t.spark, "applied"), "lsn"), ManifestTable(t.spark, fresh_dir(t.spark, "bad"))
    rows = t("txns").select(*ingest.KEY)
    path, progress = fresh_dir(t.spark, "txns"), fresh_dir(t.spark, "progress")
    for some in ("lsn % 32 = 0", "true", "true"):
        rows.where(some).coalesce(1).write.mode("append").parquet(path)
        ingest.ingest(t.spark.readStream.schema(rows.schema).parquet(path), table, bad, progress, valid="lsn % 112 <> 0")
    return table.read().groupBy("transaction_id").agg(F.count("*").cast("int").alias("applied"))
