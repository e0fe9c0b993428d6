"""Exactly-once ingestion: a micro-batch is deduplicated, checked, published by one manifest row, and only then acknowledged."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerlake.operators import lake
from ledgerlake.storage import ManifestTable

KEY = ["source_id", "transaction_id", "lsn"]
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def drain(stream: DataFrame, one: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Give each micro-batch of stream to one until nothing is left. How much a batch takes is the source's setting
    (maxFilesPerTrigger, maxOffsetsPerTrigger): what is not taken waits at the source, and nothing else is in flight."""
    conf = stream.sparkSession.conf
    before = conf.get(NO_DATA)
    conf.set(NO_DATA, "false")  # a batch without data, made to let state time out, would be followed by another one for ever
    try:
        query = stream.writeStream.outputMode(mode).foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(NO_DATA, before)  # the stream has its own copy by now
    query.awaitTermination()
    return query


def ingest(stream: DataFrame, table: ManifestTable, quarantine: ManifestTable, checkpoint: str, valid: str = "true", checksum: str | None = None, order: str = "lsn") -> None:
    """Drain stream into table, each KEY once, the first by order; rows for which valid doesn't hold go to quarantine instead.

    With a checksum column, rows whose checksum isn't that of their KEY's first go to quarantine too; others that come again
    are dropped. A batch that runs again after a failure has the same id and is published once. What earlier batches brought
    is left out by a join with those of them whose LSN range (the table's range_column) touches the batch's, so there is no
    state that a watermark would have to forget, and a batch does not read the whole history.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        good = F.coalesce(F.expr(valid), F.lit(False))
        first = Window.partitionBy(*KEY).orderBy(order)
        mark = F.col(checksum) if checksum else F.lit(0)
        rows = batch.where(good).withColumn("_at", F.row_number().over(first)).withColumn("_sum", F.first(mark).over(first))
        if batch_id and not table.committed(str(batch_id)):
            span = batch.agg(F.min("lsn").alias("low"), F.max("lsn").alias("high")).first()
            old = table.read(span["low"], span["high"]).select(*KEY, (F.col(checksum) if checksum else F.lit(0)).alias("_old")) if span["low"] is not None else table.read().select(*KEY, F.lit(0).alias("_old"))
            rows = rows.join(old, KEY, "left")
        else:
            rows = rows.withColumn("_old", F.lit(None).cast(rows.schema["_sum"].dataType))
        conflict = mark != F.coalesce("_old", "_sum")
        aside = batch.where(~good)
        if checksum:
            aside = aside.unionByName(rows.where(conflict).select(*batch.columns))
        quarantine.append(aside, str(batch_id))
        table.append(rows.where(F.col("_old").isNull() & (F.col("_at") == 1)).select(*batch.columns), str(batch_id))

    drain(stream, one, checkpoint)


def acknowledged(stream: DataFrame, table: ManifestTable, acks: ManifestTable, checkpoint: str, publish: Callable[[DataFrame, int], None] | None = None) -> None:
    """Publish each batch to table and then, once that is durable, its transactions (KEY) to acks.

    A failure between the two leaves the batch unacknowledged: it runs again under its id, the table takes it once, and its
    acknowledgement follows. publish runs after the table's commit and may fail (tests do).
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        table.append(batch, str(batch_id))
        if publish:
            publish(batch, batch_id)
        durable = table.read().where(F.col("commit") == str(batch_id))
        acks.append(durable.select(*KEY).distinct(), str(batch_id))

    drain(stream, one, checkpoint)


def epoch_progress(stream: DataFrame, table: ManifestTable, checkpoint: str) -> None:
    """Count a stream's transactions by epoch and source: an epoch is a label, sealed by its sources and not by time.

    Each batch publishes the groups that it changed with their counts so far; late rows change their epoch's again. The
    state is a row for each epoch and source.
    """
    counted = stream.groupBy("epoch_id", "source_id").agg(F.count("*").alias("transaction_count"), F.max("lsn").alias("last_lsn"))
    drain(counted, lambda batch, k: table.append(batch.withColumn("batch", F.lit(k)), str(k)) and None, checkpoint, "update")


def epoch_states(table: ManifestTable, required: DataFrame, policy: str) -> DataFrame:
    """(epoch_id, complete_source_count, missing_source_count, state) by what epoch_progress has published so far."""
    seen = table.read().select("epoch_id", "source_id").distinct()
    need = required.select("source_id").crossJoin(seen.select("epoch_id").distinct())
    joined = need.join(seen.withColumn("seen", F.lit(True)), ["epoch_id", "source_id"], "left").groupBy("epoch_id").agg(F.count("seen").alias("complete_source_count"), F.count_if(F.col("seen").isNull()).alias("missing_source_count"))
    return joined.withColumn("state", lake.epoch_state(F.col("missing_source_count"), F.lit(0), F.lit(policy)))


STATE = "expected int, marked boolean, chunks string, decision string"
OUT = "transaction_id string, expected_chunks int, arrived_chunks int, decision string"
#: How long a decided transaction is remembered, so that messages delivered again are known; later ones meet the applied ledger.
REMEMBERED_MS = 3_600_000
DECIDED = ("globally_visible", "conflicting_redelivery")


#: States that a stream's transactions share by the hash of their ids.
BUCKETS = 256
BUCKET_STATE = "transactions binary"
Held = tuple[int, bool, dict[str, int], str]


def _decide(held: Held, messages: Iterable[tuple[str, float, int | str, float]]) -> tuple[Held, int]:
    """What is held of a transaction (expected chunks, whether it is marked, checksums by chunk, decision) after messages
    (kind, chunk_id, checksum, chunk_count), and its number of chunks. A decided one stays as it is."""
    expected, marked, seen, decision = held
    if decision in DECIDED:
        return held, expected
    conflict = False
    for kind, chunk, checksum, count in messages:
        if kind == "chunk":
            conflict |= seen.setdefault(str(int(chunk)), int(checksum)) != int(checksum)
        elif kind == "manifest":
            expected = int(count)
        else:
            marked |= kind == "commit"
    whole = len(seen) >= expected >= 0
    decision = "conflicting_redelivery" if conflict else "held_commit_marker_missing" if not marked else "globally_visible" if whole else "held_chunks_missing"
    return (expected, marked, seen, decision), len(seen)


def _remembered(held: Held, count: int) -> Held:
    """Of a decided transaction the chunks are forgotten at once, the decision after a while."""
    return (count, True, {}, held[3]) if held[3] in DECIDED else held


def _messages(batch: pd.DataFrame) -> Iterator[tuple[str, float, int | str, float]]:
    return zip(*(batch[c].tolist() for c in ("kind", "chunk_id", "checksum", "chunk_count")), strict=True)


def _barrier(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One transaction and its own state."""
    if state.hasTimedOut:
        state.remove()
        return
    expected, marked, chunks, decision = state.get if state.exists else (-1, False, "{}", "")
    held, count = _decide((expected, marked, json.loads(chunks), decision), (m for batch in batches for m in _messages(batch)))
    kept = _remembered(held, count)
    state.update((kept[0], kept[1], json.dumps(kept[2]), kept[3]))
    if held[3] in DECIDED:
        state.setTimeoutDuration(REMEMBERED_MS)
    yield pd.DataFrame({"transaction_id": [key[0]], "expected_chunks": [held[0]], "arrived_chunks": [count], "decision": [held[3]]})


def _bucket(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """All transactions of a bucket: in its state each is what is held of it and when it may be forgotten (0: not yet)."""
    now = state.getCurrentProcessingTimeMs()
    stored = json.loads(zlib.decompress(bytes(state.get[0]))) if state.exists else []
    held = {tx: (tuple(rest), until) for tx, until, *rest in stored if not 0 < until <= now}
    came: dict[str | None, list] = {}
    if not state.hasTimedOut:
        for batch in batches:
            for tx, message in zip(batch["transaction_id"].tolist(), _messages(batch), strict=True):
                came.setdefault(tx, []).append(message)
    rows = []
    for tx, messages in came.items():
        found, count = _decide(held[tx][0] if tx in held else (-1, False, {}, ""), messages)
        held[tx] = _remembered(found, count), now + REMEMBERED_MS if found[3] in DECIDED else 0
        rows.append((tx, found[0], count, found[3]))
    if held:
        state.update((zlib.compress(json.dumps([(tx, until, *x) for tx, (x, until) in held.items()]).encode(), 1),))
        if ends := [until for _, until in held.values() if until]:
            state.setTimeoutDuration(max(1, min(ends) - now))
    elif state.exists:
        state.remove()
    if rows:
        yield pd.DataFrame(rows, columns=["transaction_id", "expected_chunks", "arrived_chunks", "decision"])


def barrier(messages: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The visibility of each transaction after each batch of its messages, in any order and repeated at will.

    messages: transaction_id, kind (chunk, manifest or commit), chunk_id, checksum, chunk_count. A chunk that comes again
    with another checksum is a conflict. The state of an open transaction is its chunks' checksums, bounded by its manifest;
    a decided one keeps its decision alone, for REMEMBERED_MS.

    A call of Python for each transaction and batch costs far more than its messages do, so transactions share states by
    bucket; a batch rewrites those buckets that it touches. With 0 buckets each transaction has a state of its own, for
    streams whose batches touch few of very many. The number of buckets belongs to a stream's checkpoint.
    """
    # checksums travel as text: in a batch with nulls pandas would make them floating-point numbers, alike when they are near
    messages = messages.withColumn("checksum", F.col("checksum").cast("string"))
    if not buckets:
        return messages.groupBy("transaction_id").applyInPandasWithState(_barrier, OUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)
    dealt = messages.withColumn("bucket", F.expr(f"pmod(xxhash64(transaction_id), {buckets})"))
    return dealt.groupBy("bucket").applyInPandasWithState(_bucket, OUT, BUCKET_STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """An extension beyond the change log: events by window and type, late ones within the watermark counted."""
    return events.withWatermark("at", late).groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"))
