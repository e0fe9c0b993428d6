"""Raw change log, replay ledger, epoch rollups, completeness ledger and the gates that readers pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions import hashing, lsn, names

#: The raw change log's columns, in order, with their types.
RAW_COLUMNS = {
    "source_id": "string", "source_bucket": "int", "database_id": "string", "dataset_id": "string", "relation": "string", "transaction_id": "string",
    "begin_lsn": "string", "commit_lsn": "string", "commit_timestamp_ms": "bigint", "total_order": "int", "operation": "string", "record_key": "string",
    "idempotency_key": "string", "schema_fingerprint": "bigint", "schema_version": "bigint", "ddl_barrier_id": "string", "ddl_release_gate": "string",
    "ddl_schema_fingerprint_before": "bigint", "ddl_schema_fingerprint_after": "bigint", "envelope_checksum": "bigint", "manifest_id": "string",
    "manifest_boundary_mode": "string", "manifest_global_event_count": "int", "manifest_participating_partition_count": "int", "partition_key": "string",
    "epoch_id": "string", "ingested_at": "string", "payload_before_json": "string", "payload_after_json": "string",
}
TRANSACTION = ["source_id", "database_id", "dataset_id", "transaction_id", "lsn"]
BUCKETS = 16


# -- dedup ----------------------------------------------------------------------------------------


def classify_arrivals(arrivals: DataFrame) -> DataFrame:
    """arrivals with disposition: admitted (the first of its transaction), duplicate (the same checksum again), conflict.

    The key has the LSN's number, so spellings of one LSN are one key. One shuffle by transaction; no key gathers more
    than its own replays.
    """
    by_key = Window.partitionBy(*TRANSACTION).orderBy("arrival_seq")
    first = F.first("envelope_checksum").over(by_key)
    disposition = F.when(F.row_number().over(by_key) == 1, "admitted").when(F.col("envelope_checksum") == first, "duplicate").otherwise("conflict")
    return arrivals.withColumn("disposition", disposition)


def admitted(arrivals: DataFrame) -> DataFrame:
    """The first arrival of each transaction: a partial aggregate instead of a sort, as the rest isn't wanted."""
    others = [c for c in arrivals.columns if c not in TRANSACTION]
    first = F.min_by(F.struct(*others), "arrival_seq").alias("first")
    return arrivals.groupBy(*TRANSACTION).agg(first).select(*TRANSACTION, "first.*").select(*arrivals.columns)


def conflicting_keys(arrivals: DataFrame) -> DataFrame:
    """Transactions that arrived with several checksums; they go to quarantine."""
    sums = arrivals.groupBy(*TRANSACTION).agg(F.min("envelope_checksum").alias("low"), F.max("envelope_checksum").alias("high"), F.count("*").alias("arrivals"))
    return sums.where("low <> high").select(*TRANSACTION, F.col("arrivals"), F.lit("conflicting_checksum").alias("reason"))


def replay_evidence(arrivals: DataFrame) -> DataFrame:
    """Counts of admitted, repeated and conflicting arrivals, and whether a replay is safe; counted, not assumed."""
    sums = arrivals.groupBy(*TRANSACTION, "envelope_checksum").agg(F.count("*").alias("n"), F.min("arrival_seq").alias("first"))
    per = sums.groupBy(*TRANSACTION).agg(F.sum("n").alias("n"), F.min_by("n", "first").alias("same"))  # those of the first arrival's checksum
    zero = F.lit(0).cast("long")
    out = per.agg(F.count("*").alias("unique_transactions"), F.coalesce(F.sum(F.col("same") - 1), zero).alias("duplicate_transactions"), F.coalesce(F.sum(F.col("n") - F.col("same")), zero).alias("conflicts"))
    return out.withColumn("replay_safe", F.col("conflicts") == 0)


def not_applied(envelopes: DataFrame, applied: DataFrame) -> DataFrame:
    """Envelopes whose transaction isn't in the applied ledger."""
    return envelopes.join(applied.select(*TRANSACTION), TRANSACTION, "left_anti")


def admission(envelopes: DataFrame, dataset: str, required: DataFrame | None = None) -> DataFrame:
    """envelopes with admission: skipped (of another dataset; these are counted), out_of_scope (of a source that a non-empty
    required set lacks; passed over in silence) or admitted."""
    rows, outside = envelopes, F.lit(False)
    if required is not None:
        rows = rows.join(required.select("source_id").distinct().withColumn("wanted", F.lit(True)), "source_id", "left")
        outside = F.col("wanted").isNull() & F.lit(bool(required.take(1)))
    code = F.when(~F.col("dataset_id").eqNullSafe(F.lit(dataset)), "skipped").when(outside, "out_of_scope").otherwise("admitted")
    return rows.withColumn("admission", code).drop("wanted")


# -- rollups --------------------------------------------------------------------------------------


def transactions(changes: DataFrame) -> DataFrame:
    """The one aggregate that rollups of an epoch share: a row for each transaction and relation, with its changes (n) and checksum.

    epoch_totals, epoch_sources, epoch_tables and data_files read changes or this alike; staged, it is made once for all.
    """
    one = changes.groupBy("epoch_id", *TRANSACTION, "commit_lsn", "relation").agg(F.count("*").alias("n"), F.first("envelope_checksum").alias("envelope_checksum"))
    return one


def _events(rows: DataFrame) -> Column:
    """How many changes some rows of changes, or of transactions, stand for."""
    return F.sum("n") if "n" in rows.columns else F.count("*")


def lsn_window(column: str = "commit_lsn") -> list[Column]:
    """First and last LSN by number, as they were spelt."""
    return [F.min_by(column, "lsn").alias("first_lsn"), F.max_by(column, "lsn").alias("last_lsn")]


def epoch_totals(changes: DataFrame) -> DataFrame:
    """Per epoch: transactions, changes, and the XOR of checksums, each transaction's once."""
    one = changes.groupBy("epoch_id", *TRANSACTION).agg(_events(changes).alias("n"), F.first("envelope_checksum").alias("sum"))
    return one.groupBy("epoch_id").agg(F.count("*").alias("transaction_count"), F.sum("n").alias("change_count"), F.bit_xor("sum").alias("checksum_rollup"))


def epoch_sources(changes: DataFrame) -> DataFrame:
    """Per source: transactions, changes, checksum rollup and LSN window. An envelope has one spelling of its LSN, so that
    is part of the key, and the level that reads all changes is a hash aggregate without strings to carry."""
    one = changes.groupBy("epoch_id", *TRANSACTION, "commit_lsn").agg(_events(changes).alias("n"), F.first("envelope_checksum").alias("sum"))
    return one.groupBy("epoch_id", "source_id").agg(F.count("*").alias("transaction_count"), F.sum("n").alias("change_count"), F.bit_xor("sum").alias("checksum_rollup"), *lsn_window())


def epoch_tables(changes: DataFrame, per_change: bool = False) -> DataFrame:
    """Per relation: transactions, changes, and the XOR of checksums once a transaction, or once a change where per_change."""
    keys = ["epoch_id", "relation"]
    if per_change:
        return changes.groupBy(*keys).agg(F.countDistinct(F.struct(*TRANSACTION)).alias("transaction_count"), F.count("*").alias("change_count"), F.bit_xor("envelope_checksum").alias("checksum_rollup"))
    one = changes.groupBy(*keys, *TRANSACTION).agg(_events(changes).alias("n"), F.first("envelope_checksum").alias("sum"))
    return one.groupBy(*keys).agg(F.count("*").alias("transaction_count"), F.sum("n").alias("change_count"), F.bit_xor("sum").alias("checksum_rollup"))


def epoch_partitions(manifest_partitions: DataFrame) -> DataFrame:
    """Per source and partition, over manifest partitions: transactions, events, XOR of partition checksums, LSN window."""
    return manifest_partitions.groupBy("epoch_id", "source_id", "partition_id").agg(
        F.count("*").alias("transaction_count"), F.sum("event_count").alias("event_count"), F.bit_xor("partition_checksum").alias("checksum_rollup"), *lsn_window()
    )


def data_files(changes: DataFrame, dataset: str = "retail", buckets: int = BUCKETS) -> DataFrame:
    """The planned files, one for each epoch, relation and source bucket.

    Three levels: transactions, then sources, then buckets; the bucket's hash is computed for sources only, not for changes.
    """
    keys = ["epoch_id", "relation"]
    one = changes.groupBy(*keys, *TRANSACTION, "commit_lsn").agg(_events(changes).alias("n"), F.first("envelope_checksum").alias("sum"))
    per = one.groupBy(*keys, "source_id").agg(F.count("*").alias("t"), F.sum("n").alias("n"), F.bit_xor("sum").alias("sum"), *lsn_window(), F.min("lsn").alias("low"), F.max("lsn").alias("high"))
    files = per.withColumn("source_bucket", hashing.bucket(F.col("source_id"), buckets)).groupBy(*keys, "source_bucket").agg(
        F.array_join(F.sort_array(F.collect_set("source_id")), ",").alias("source_ids"), F.sum("t").alias("transaction_count"), F.sum("n").alias("change_count"), F.bit_xor("sum").alias("checksum_rollup"),
        F.min_by("first_lsn", "low").alias("first_lsn"), F.max_by("last_lsn", "high").alias("last_lsn"),
    )
    part = lambda k: names.identifier(F.split_part("relation", F.lit("."), F.lit(k)))
    table = F.concat_ws("__", names.identifier(F.lit(dataset)), part(1), part(2), F.lit("raw_cdc"))
    key = F.concat(table, F.lit("/epoch_id="), F.col("epoch_id"), F.lit("/source_bucket="), F.lpad(F.col("source_bucket").cast("string"), 4, "0"), F.lit("/part-00000.parquet"))
    return files.withColumn("object_key", key)


def committers(files: DataFrame) -> DataFrame:
    """Per table: files and distinct buckets."""
    return files.groupBy("epoch_id", "relation").agg(F.count("*").alias("file_count"), F.countDistinct("source_bucket").alias("bucket_count"))


# -- epoch ledger ---------------------------------------------------------------------------------


def source_completion(observed: DataFrame, required: DataFrame, quarantined: DataFrame) -> DataFrame:
    """Required sources with complete, missing or quarantined; sources outside a non-empty required set are left out.

    observed has source_id and rollups, required and quarantined a source_id each.
    """
    bad = quarantined.select("source_id", F.lit(True).alias("bad"))
    joined = required.select("source_id").join(observed, "source_id", "left").join(bad, "source_id", "left")
    state = F.when(F.col("bad"), "quarantined").when(F.col("transaction_count").isNull(), "missing").otherwise("complete")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return joined.select("source_id", state.alias("state"), zero("transaction_count").alias("transaction_count"), zero("change_count").alias("change_count"), zero("checksum_rollup").alias("checksum_rollup"))


def completeness_counts(sources: DataFrame) -> DataFrame:
    count = lambda x: F.count_if(F.col("state").isin(*x))
    return sources.agg(
        F.count("*").alias("required_source_count"), count(["complete"]).alias("complete_source_count"), count(["missing", "lagging"]).alias("missing_source_count"), count(["quarantined"]).alias("quarantined_source_count")
    )


def epoch_state(missing: Column, quarantined: Column, policy: Column) -> Column:
    """quarantined before complete; a gap by the straggler policy: wait_all_required, publish_with_gaps or quarantine_on_gap."""
    gap = F.when(policy == "publish_with_gaps", "complete_with_gaps").when(policy == "quarantine_on_gap", "quarantined").otherwise("open")
    return F.when(quarantined > 0, "quarantined").when(missing == 0, "complete").otherwise(gap)


def verification_status(state: Column) -> Column:
    return F.when(state.isin("complete", "complete_with_gaps"), "match").otherwise("pending")


def verification_id(dataset: Column, epoch: Column, rollup: Column) -> Column:
    return F.concat(F.lit("verify:"), dataset, F.lit(":"), epoch, F.lit(":"), F.lower(F.lpad(F.hex(rollup), 16, "0")))


def epoch_summary(changes: DataFrame, required: DataFrame, quarantined: DataFrame, policy: str) -> DataFrame:
    """One row for each epoch: totals, completeness, state and verification."""
    totals = epoch_totals(changes)
    epochs = totals.select("epoch_id")
    need = required.select("source_id").crossJoin(epochs)  # each epoch answers for each required source
    seen = changes.select("epoch_id", "source_id").distinct().withColumn("seen", F.lit(True))
    states = need.join(seen, ["epoch_id", "source_id"], "left").join(quarantined.select("source_id", F.lit(True).alias("bad")), "source_id", "left")
    state = F.when(F.col("bad"), "quarantined").when(F.col("seen"), "complete").otherwise("missing")
    counts = states.withColumn("state", state).groupBy("epoch_id").agg(
        F.count("*").alias("required_source_count"), F.count_if(F.col("state") == "complete").alias("complete_source_count"),
        F.count_if(F.col("state") == "missing").alias("missing_source_count"), F.count_if(F.col("state") == "quarantined").alias("quarantined_source_count"),
    )
    out = totals.join(counts, "epoch_id").withColumn("policy", F.lit(policy))
    out = out.withColumn("state", epoch_state(F.col("missing_source_count"), F.col("quarantined_source_count"), F.col("policy")))
    return out.withColumn("checksum_status", verification_status(F.col("state"))).withColumn("verification_id", verification_id(F.lit("retail"), F.col("epoch_id"), F.col("checksum_rollup")))


def quarantine_rows(sources: DataFrame, epoch_id: str) -> DataFrame:
    """A row for each quarantined source."""
    reason = F.when(F.col("transaction_count") == 0, "source_gap_quarantined").otherwise("source_evidence_quarantined")
    return sources.where("state = 'quarantined'").select(F.lit(epoch_id).alias("epoch_id"), "source_id", reason.alias("reason"))


def deterministic_epoch_id(dataset: str, policy: str, required: DataFrame, windows: DataFrame) -> DataFrame:
    """epoch-{slug}-{16 digits}: a digest of length-prefixed fields of the dataset, the policy and every source.

    policy is wait_all_required, publish_with_gaps:{grace_ms} or quarantine_on_gap; required has source_id, windows
    source_id, start_lsn and end_lsn, a source at most once. Rows number the configured sources, in any order.
    """
    field = lambda name, v: F.concat(F.lit(f"{name}:"), F.octet_length(v).cast("string"), F.lit(":"), v, F.lit("\n"))
    both = required.select("source_id", F.lit("true").alias("required")).join(windows, "source_id", "full_outer")
    held = lambda c: F.coalesce(F.col(c), F.lit("<none>"))
    block = F.concat(field("source", F.col("source_id")), field("required", F.coalesce("required", F.lit("false"))), field("start_lsn", held("start_lsn")), field("end_lsn", held("end_lsn")))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("source_id", block.alias("block")))), lambda x: x["block"])
    text = F.concat(field("dataset", F.lit(dataset)), field("policy", F.lit(policy)), F.array_join(blocks, ""))
    slug = F.trim(names.slug(F.lit(dataset)), F.lit("-"))
    return both.agg(F.concat(F.lit("epoch-"), F.when(slug == "", "dataset").otherwise(slug), F.lit("-"), F.substring(F.sha2(text, 256), 1, 16)).alias("epoch_id"))


def manifest_digest(sources: DataFrame, tables: DataFrame, partitions: DataFrame) -> DataFrame:
    """SHA-256 over the ledger lines of an epoch: sources, tables, then partitions, each in the order of its key.

    The lines number sources, tables and partitions, not changes.
    """

    def lines(rank: int, kind: str, df: DataFrame, key: str, *rest: str) -> DataFrame:
        number = F.col("partition_id").cast("int") if kind == "partition" else F.lit(0)
        line = F.concat(F.lit(f"{kind}="), F.concat_ws("|", "epoch_id", key, *[F.col(c).cast("string") for c in rest]), F.lit("\n"))
        return df.select("epoch_id", F.struct(F.lit(rank).alias("rank"), F.col(key).alias("key"), number.alias("number"), line.alias("line")).alias("line"))

    every = (
        lines(0, "source", sources, "source_id", "first_lsn", "last_lsn", "transaction_count", "change_count", "checksum_rollup")
        .unionByName(lines(1, "table", tables, "relation", "transaction_count", "change_count", "checksum_rollup"))
        .unionByName(lines(2, "partition", partitions, "source_id", "partition_id", "first_lsn", "last_lsn", "transaction_count", "event_count", "checksum_rollup"))
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x["line"]), "")
    return every.groupBy("epoch_id").agg(F.sha2(F.concat(F.lit("raw_cdc_epoch_manifest_v1\n"), text), 256).alias("manifest_digest"))


# -- gates ----------------------------------------------------------------------------------------


def consumable(epochs: DataFrame, verification: DataFrame, accept_gaps: bool = False, unsafe: bool = False) -> DataFrame:
    """Epochs that readers may use: verified, and complete or with accepted gaps; unsafe overrides both."""
    gaps = (F.col("state") == "complete_with_gaps") & (F.col("policy") == "publish_with_gaps") & F.lit(accept_gaps)
    ok = ((F.col("state") == "complete") | gaps | F.lit(unsafe)) & ((F.col("checksum_status") == "match") | F.lit(unsafe))
    return epochs.join(verification.select("epoch_id", "checksum_status"), "epoch_id").where(ok)


def gate(epochs: DataFrame, verification: DataFrame, epoch_id: str, accept_gaps: bool = False, unsafe: bool = False) -> DataFrame:
    """One row 'ready' if exactly one consumable row of the epoch exists, so a repeated verification blocks too; else an error."""
    found = consumable(epochs, verification, accept_gaps, unsafe).where(F.col("epoch_id") == epoch_id)
    message = f"epoch {epoch_id} is not consumable: verification must match and gaps must be accepted"
    return found.agg(F.when(F.count("*") == 1, F.lit("ready")).otherwise(F.raise_error(F.lit(message))).alias("gate"))


def gated(raw: DataFrame, epochs: DataFrame, verification: DataFrame, epoch_id: str, accept_gaps: bool = False, unsafe: bool = False) -> DataFrame:
    """The raw rows of an epoch behind its gate: the literal prunes partitions, the one-row gate joins without a shuffle."""
    ready = gate(epochs, verification, epoch_id, accept_gaps, unsafe)
    return raw.where(F.col("epoch_id") == epoch_id).crossJoin(F.broadcast(ready)).where("gate = 'ready'").drop("gate")


def consumer_decision(epochs: DataFrame, accept_gaps: bool = False) -> DataFrame:
    """decision and the first reason against it of the full gate: identity, boundary, rollups, completeness, state,
    verification's counts, gaps, verification.

    epochs carry their counts, state, policy and manifest_digest, and their verification row's epoch
    (verification_epoch_id), id, counts (verified_required_source_count, verified_missing_source_count) and status.
    """
    counts = F.col("complete_source_count") + F.col("missing_source_count") + F.col("quarantined_source_count")
    expected = epoch_state(F.col("missing_source_count"), F.col("quarantined_source_count"), F.col("policy"))
    ladder = [
        (~names.clean(F.col("epoch_id")), "identity"),
        (~F.coalesce(F.col("manifest_digest").rlike("^[0-9a-f]{64}$"), F.lit(False)), "manifest_digest"),
        (F.col("verification_id") != verification_id(F.lit("retail"), F.col("epoch_id"), F.col("checksum_rollup")), "verification_identity"),
        (~F.col("verification_epoch_id").eqNullSafe(F.col("epoch_id")), "boundary"),
        (counts != F.col("required_source_count"), "rollup"),
        ((F.col("state") == "complete") & ((F.col("required_source_count") == 0) | (F.col("missing_source_count") > 0)), "completeness"),
        (F.col("state") != expected, "state"),
        (F.col("transaction_count") == 0, "empty"),
        ((F.col("verified_required_source_count") != F.col("required_source_count")) | (F.col("verified_missing_source_count") != F.col("missing_source_count")), "verification_counts"),
        (~F.col("state").isin("complete", "complete_with_gaps"), "not_consumable_state"),
        ((F.col("state") == "complete_with_gaps") & F.lit(not accept_gaps), "gaps_not_accepted"),
        (F.col("checksum_status") != "match", "verification"),
    ]
    reason = reduce(lambda acc, x: acc.when(*x) if acc is not None else F.when(*x), ladder, None).otherwise(F.lit("none"))
    return epochs.withColumn("reason", reason).withColumn("decision", F.when(F.col("reason") == "none", "consume").otherwise("hold"))


# -- raw log, plan, files -------------------------------------------------------------------------


def raw_rows(changes: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Changes as rows of the raw log; payloads are arrays of named, kinded values, '[]' where an image is absent."""
    value = lambda name, c: F.named_struct(F.lit("name"), F.lit(name), F.lit("value"), F.named_struct(F.lit("kind"), F.when(c.isNull(), "null").otherwise("text"), F.lit("value"), c))
    image = F.to_json(F.array(value("id", F.col("record_key")), value("amount", F.col("amount").cast("string")), value("status", F.col("status"))))
    before = F.when(F.col("operation").isin("update", "delete"), F.to_json(F.array(value("id", F.col("record_key"))))).otherwise("[]")
    have = {
        "source_bucket": hashing.bucket(F.col("source_id"), buckets), "begin_lsn": lsn.fmt(F.col("lsn") - 8), "partition_key": F.col("partition_id").cast("string"),
        "ingested_at": F.date_format(F.timestamp_millis("commit_timestamp_ms"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), "payload_before_json": before,
        "payload_after_json": F.when(F.col("operation") == "delete", "[]").otherwise(image),
    }
    return changes.select(*[(have.get(c, F.col(c) if c in changes.columns else F.lit(None))).cast(t).alias(c) for c, t in RAW_COLUMNS.items()])


def write_raw(raw: DataFrame, path: str) -> None:
    """Write or rewrite whole epochs: partitions of the same epoch and bucket are replaced, so a replay changes nothing."""
    (raw.repartition("epoch_id", "source_bucket").sortWithinPartitions("relation", "commit_timestamp_ms", "total_order")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch_id", "source_bucket").parquet(path))


def file_plan_violations(raw: DataFrame, files: DataFrame) -> DataFrame:
    """Planned files whose row count or checksum rollup the rows to write don't have; empty before a good write."""
    one = raw.groupBy("epoch_id", "relation", "source_bucket", "source_id", "transaction_id").agg(F.count("*").alias("n"), F.min("envelope_checksum").alias("low"), F.max("envelope_checksum").alias("high"))
    got = one.groupBy("epoch_id", "relation", "source_bucket").agg(F.sum("n").alias("rows"), F.bit_xor("low").alias("rollup"), F.max(F.col("low") != F.col("high")).alias("mixed"))
    joined = files.join(got, ["epoch_id", "relation", "source_bucket"], "full_outer")
    code = F.when(F.col("rows").isNull(), "missing_rows").when(F.col("change_count").isNull(), "unplanned_rows").when(F.col("rows") != F.col("change_count"), "row_count").when(F.col("mixed"), "mixed_checksum").when(F.col("rollup") != F.col("checksum_rollup"), "checksum_rollup")
    return joined.withColumn("violation", code).where("violation IS NOT NULL").select("epoch_id", "relation", "source_bucket", "violation")


def commit_operations(changes: DataFrame) -> DataFrame:
    """The write operations of each change: one raw append, the current-state one, and those that close and open versions."""
    op = lambda kind, action: F.struct(F.lit(kind).alias("target"), F.lit(action).alias("action"))
    current = F.when(F.col("operation") == "delete", op("current", "delete")).when(F.col("operation") == "truncate", op("current", "truncate")).otherwise(op("current", "upsert"))
    is_ = lambda *x: F.col("operation").isin(*x)
    close = F.when(is_("update", "delete"), op("scd2", "close")).when(is_("truncate"), op("scd2", "truncate"))
    insert = F.when(is_("insert", "update"), op("scd2", "insert"))
    ops = F.array_compact(F.array(op("raw", "append"), current, close, insert))
    return changes.select("epoch_id", "relation", "record_key", "idempotency_key", F.posexplode(ops).alias("step", "op")).select("epoch_id", "relation", "record_key", "idempotency_key", "step", "op.target", "op.action")


def commit_steps(files: DataFrame) -> DataFrame:
    """Steps of an epoch's commit in order: data files from 10 on, then the ledger's tables, the epoch row last of all."""
    ranked = files.select("epoch_id", F.col("object_key").alias("step"), (F.row_number().over(Window.partitionBy("epoch_id").orderBy("object_key")) + 9).alias("sequence"))
    # fixed values: the ledger's tables in the order of their commit
    ledger = ["epoch_sources", "epoch_tables", "epoch_partitions", "quarantine", "verification", "epochs"]
    epochs = files.select("epoch_id").distinct()
    rest = epochs.select("epoch_id", F.posexplode(F.array(*map(F.lit, ledger))).alias("k", "step")).join(ranked.groupBy("epoch_id").agg(F.max("sequence").alias("top")), "epoch_id")
    base = F.greatest(F.lit(100), F.ceil((F.col("top") + 1) / 10).cast("int") * 10)
    return ranked.select("epoch_id", "sequence", "step").unionByName(rest.select("epoch_id", (base + F.col("k") * 10).cast("int").alias("sequence"), "step"))


def receipts_status(files: DataFrame, receipts: DataFrame) -> DataFrame:
    """Planned files against receipts, both ways: committed, missing, mismatched or unexpected."""
    joined = files.select("epoch_id", "object_key", "change_count").join(receipts.select("object_key", "record_count"), "object_key", "full_outer")
    status = F.when(F.col("change_count").isNull(), "unexpected").when(F.col("record_count").isNull(), "missing").when(F.col("record_count") != F.col("change_count"), "mismatched").otherwise("committed")
    return joined.select("object_key", status.alias("status"))


def epoch_metadata_violations(epochs: DataFrame, sources: DataFrame, tables: DataFrame, partitions: DataFrame) -> DataFrame:
    """(epoch_id, violation, subject) of ledger rows: blank fields, windows, repeated rows, unknown epochs and sources, rollups.

    sources: epoch_id, source_id, first_lsn, last_lsn and rollups; tables: epoch_id, relation, change_count; partitions:
    epoch_id, source_id, partition_id, first_lsn, last_lsn, event_count; epochs: epoch_id, transaction_count, change_count,
    checksum_rollup. Rollups of a kind without a row in an epoch are not compared.
    """
    found = lambda df, code, subject: df.select("epoch_id", F.lit(code).alias("violation"), subject.cast("string").alias("subject"))
    kinds = [("source", sources, ["source_id"]), ("table", tables, ["relation"]), ("partition", partitions, ["source_id", "partition_id"])]
    known, out = epochs.select("epoch_id"), []
    for kind, df, keys in kinds:
        name = F.concat_ws(":", F.lit(kind), *[F.col(k).cast("string") for k in keys])
        out.append(found(df.groupBy("epoch_id", *keys).count().where("count > 1"), "duplicate_row", name))
        out.append(found(df.where(~names.clean(F.col("epoch_id")) | ~names.clean(F.col(keys[0]))), "unclean_field", name))
        out.append(found(df.join(known, "epoch_id", "left_anti"), "epoch_boundary", name))
        if "first_lsn" in df.columns:
            first, last = lsn.parse(F.col("first_lsn")), lsn.parse(F.col("last_lsn"))
            out.append(found(df.where(~F.coalesce((first > 0) & (first <= last), F.lit(False))), "lsn_window", name))
    orphan = partitions.join(sources.select("epoch_id", "source_id"), ["epoch_id", "source_id"], "left_anti")
    out.append(found(orphan.select("epoch_id", "source_id").distinct(), "orphan_partition", F.col("source_id")))
    total = lambda df, n, *more: df.groupBy("epoch_id").agg(F.sum(n).alias("c"), *more)
    of_sources = total(sources, "change_count", F.sum("transaction_count").alias("t"), F.bit_xor("checksum_rollup").alias("x"))
    for kind, df, fields in (("source", of_sources, {"t": "transaction_count", "c": "change_count", "x": "checksum_rollup"}), ("table", total(tables, "change_count"), {"c": "change_count"}), ("partition", total(partitions, "event_count"), {"c": "change_count"})):
        differs = F.array_compact(F.array(*[F.when(~F.col(a).eqNullSafe(F.col(b)), F.lit(f"{kind}:{b}")) for a, b in fields.items()]))
        out.append(found(epochs.join(df, "epoch_id").select("epoch_id", F.explode(differs).alias("which")), "rollup", F.col("which")))
    return reduce(DataFrame.unionByName, out)


# -- maintenance ----------------------------------------------------------------------------------

SMALL_FILE, TARGET_FILE, LEAST_FILES = 32 << 20, 256 << 20, 5


def maintenance_plan(files: DataFrame) -> DataFrame:
    """Per table: files, small files, bytes, whether to compact and into how many files. files: table_name, size_bytes."""
    small = F.count_if(F.col("size_bytes") < SMALL_FILE)
    out = files.groupBy("table_name").agg(F.count("*").alias("file_count"), small.alias("small_file_count"), F.sum("size_bytes").alias("total_bytes"))
    return out.withColumn("compact", F.col("small_file_count") >= LEAST_FILES).withColumn("target_files", F.greatest(F.lit(1), F.ceil(F.col("total_bytes") / TARGET_FILE)).cast("long"))


def orphan_candidates(objects: DataFrame, referenced: DataFrame, pending: DataFrame, now_ms: int, age_ms: int = 86_400_000) -> DataFrame:
    """Old Parquet objects that nothing refers to. objects: object_key, modified_ms; the others: object_key."""
    old = objects.where(F.col("object_key").endswith(".parquet") & (F.col("modified_ms") <= now_ms - age_ms))
    return old.join(referenced.select("object_key"), "object_key", "left_anti").join(pending.select("object_key"), "object_key", "left_anti")
