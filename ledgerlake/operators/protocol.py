"""Transactions as envelopes: validation, routing, chunks, manifests, barriers and schema changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions import hashing, names

TXN = ["source_id", "database_id", "dataset_id", "transaction_id", "lsn"]
#: Rank of operations of one order.
RANKS = {"delete": 0, "update": 1, "insert": 2, "truncate": 3}


def operation_rank(op: Column) -> Column:
    out = F.lit(9)
    for name, k in RANKS.items():
        out = F.when(op == name, k).otherwise(out)
    return out


def violations(rows: DataFrame, keys: list[str], codes: list[tuple[str, Column]]) -> DataFrame:
    """A row for each code whose condition holds; a null condition doesn't."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in codes]))
    return rows.select(*keys, F.explode(found).alias("violation"))


# -- assembly and validation ----------------------------------------------------------------------


def assemble(events: DataFrame, commits: DataFrame, aborted: DataFrame | None = None) -> DataFrame:
    """Changes of committed transactions with dense orders 1..n; two changes of one order are an error.

    events: transaction_id, total_order, subtransaction_id and payload; commits: transaction_id. Changes of aborted
    (transaction_id, subtransaction_id) pairs go; a pair without a subtransaction takes the whole transaction.
    """
    rows = events.join(commits.select("transaction_id"), "transaction_id", "left_semi")
    if aborted is not None:
        whole = aborted.where("subtransaction_id IS NULL").select("transaction_id")
        part = aborted.where("subtransaction_id IS NOT NULL").select("transaction_id", "subtransaction_id")
        rows = rows.join(whole, "transaction_id", "left_anti").join(part, ["transaction_id", "subtransaction_id"], "left_anti")
    by = Window.partitionBy("transaction_id").orderBy("total_order")
    repeated = F.raise_error(F.concat(F.lit("repeated order in transaction "), "transaction_id")).cast("int")
    return rows.withColumn("dense_order", F.when(F.lag("total_order").over(by) == F.col("total_order"), repeated).otherwise(F.row_number().over(by)))


def envelopes(changes: DataFrame) -> DataFrame:
    """One row for each transaction, its changes an array in order. Only what needs the nested form should ask for it."""
    rest = [c for c in changes.columns if c not in (*TXN, "commit_lsn", "commit_timestamp_ms", "envelope_checksum", "epoch_id", "arrival_seq")]
    change = F.struct("total_order", *[c for c in rest if c != "total_order"])
    head = [F.first(c).alias(c) for c in ("commit_lsn", "commit_timestamp_ms", "envelope_checksum", "epoch_id", "arrival_seq")]
    return changes.groupBy(*TXN).agg(*head, F.sort_array(F.collect_list(change)).alias("changes"))


def _unclean(column: str) -> tuple[str, Column]:
    return f"unclean_{column}", ~names.clean(F.col(column))


def envelope_violations(txns: DataFrame, changes: DataFrame, ddl: DataFrame | None = None, versions: DataFrame | None = None) -> DataFrame:
    """(transaction_id, violation) of envelopes: version, identities, time, LSNs, then their changes and schema versions.

    txns: source_id, database_id, dataset_id, transaction_id, lsn, begin_lsn (null where unknown), commit_timestamp_ms,
    protocol_version. changes: transaction_id (the envelope's), change_transaction_id, total_order, idempotency_key. ddl:
    transaction_id, total_order; orders are unique across both. versions: transaction_id, relation, version. All events of
    a transaction are counted by order and then as a whole in one exchange; repartitioning says that both levels share it.
    """
    flag = lambda bad: F.when(bad, 1).otherwise(0)
    events = changes.select("transaction_id", "total_order", flag(~names.clean(F.col("idempotency_key"))).alias("unclean"), flag(~F.col("change_transaction_id").eqNullSafe(F.col("transaction_id"))).alias("foreign"))
    if ddl is not None:
        events = events.unionByName(ddl.select("transaction_id", "total_order", F.lit(0).alias("unclean"), F.lit(0).alias("foreign")))
    orders = events.repartition("transaction_id").groupBy("transaction_id", "total_order").agg(F.count("*").alias("n"), F.max("unclean").alias("unclean"), F.max("foreign").alias("foreign"))
    per = orders.groupBy("transaction_id").agg(F.max("n").alias("n"), F.max("unclean").alias("unclean"), F.max("foreign").alias("foreign"))
    found = violations(per, ["transaction_id"], [("change_transaction", F.col("foreign") > 0), ("unclean_idempotency_key", F.col("unclean") > 0), ("repeated_event_order", F.col("n") > 1)])
    head = violations(txns, ["transaction_id"], [
        ("protocol_version", ~F.col("protocol_version").eqNullSafe(F.lit(1))), *map(_unclean, ("source_id", "database_id", "dataset_id", "transaction_id")),
        ("non_positive_timestamp", F.col("commit_timestamp_ms") <= 0), ("zero_lsn", F.col("lsn") == 0), ("zero_begin_lsn", F.col("begin_lsn") == 0), ("begin_after_commit", F.col("begin_lsn") > F.col("lsn")),
    ])
    out = head.unionByName(found)
    if versions is not None:
        each = versions.repartition("transaction_id").groupBy("transaction_id", "relation").agg(F.count("*").alias("n"), F.min("version").alias("low"))
        whole = each.groupBy("transaction_id").agg(F.max("n").alias("n"), F.min("low").alias("low"), F.max(~names.clean(F.col("relation"))).alias("unclean"))
        out = out.unionByName(violations(whole, ["transaction_id"], [("repeated_schema_version", F.col("n") > 1), ("zero_schema_version", F.col("low") == 0), ("unclean_relation", F.col("unclean"))]))
    return out


#: What a change's digest is made of, its order first, so that changes cannot trade places.
CONTENT = ["total_order", "relation", "operation", "record_key", "amount", "status", "idempotency_key"]


def content_checksums(changes: DataFrame, content: list[str] | None = None) -> DataFrame:
    """TXN, commit_timestamp_ms and checksum: of the header, the number of changes and the XOR of their order-bound digests.

    The checksum itself is left out of what it covers. Changes are combined before the shuffle; none is gathered.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("<NULL>"))
    digest = hashing.md5_60(F.concat_ws("|", *map(text, content or CONTENT)))
    per = changes.groupBy(*TXN, "commit_timestamp_ms").agg(F.count("*").alias("n"), F.bit_xor(digest).alias("x"))
    return per.select(*TXN, "commit_timestamp_ms", hashing.md5_60(F.concat_ws("|", *map(text, [*TXN, "commit_timestamp_ms", "n", "x"]))).alias("checksum"))


def checksum_violations(stated: DataFrame, changes: DataFrame, content: list[str] | None = None) -> DataFrame:
    """Transactions whose stated checksum (TXN, checksum) isn't that of their changes, with the actual one, null without any."""
    actual = content_checksums(changes, content).select(*TXN, F.col("checksum").alias("actual_checksum"))
    joined = stated.select(*TXN, "checksum").join(actual, TXN, "left")
    return joined.where(~F.col("checksum").eqNullSafe(F.col("actual_checksum"))).select("transaction_id", "checksum", "actual_checksum")


def affected_tables(changes: DataFrame) -> DataFrame:
    return changes.groupBy("transaction_id", "relation").agg(F.count("*").alias("event_count"))


# -- routing and chunks ---------------------------------------------------------------------------


def partition_for_key(key: Column, n: int) -> Column:
    return F.pmod(hashing.md5_60(key), F.lit(n)).cast("int")


def route(changes: DataFrame, n: int, null_key: str, key: str = "partition_key") -> DataFrame:
    """changes with target_partition by policy for null keys: quarantine (null), dead_letter (n - 1), singleton (0), derive."""
    fallback = {"quarantine": F.lit(None).cast("int"), "dead_letter": F.lit(n - 1), "singleton": F.lit(0), "derive": partition_for_key(F.col("record_key"), n)}[null_key]
    return changes.withColumn("target_partition", F.when(F.col(key).isNull(), fallback).otherwise(partition_for_key(F.col(key), n)))


def emit_moves(updates: DataFrame, n: int) -> DataFrame:
    """Updates whose partition key changed as a delete at the old and an insert at the new partition.

    updates: transaction_id, total_order, idempotency_key, key_before, key_after. A null key is a value like others here.
    """
    changed = updates.where(~F.col("key_before").eqNullSafe(F.col("key_after")))
    half = lambda op, key, suffix: F.struct(F.lit(op).alias("operation"), partition_for_key(F.coalesce(key, F.lit("")), n).alias("target_partition"), F.concat("idempotency_key", F.lit(suffix)).alias("idempotency_key"))
    return changed.select("transaction_id", "total_order", F.inline(F.array(half("delete", F.col("key_before"), ":move_delete"), half("insert", F.col("key_after"), ":move_insert"))))


def partition_chunks(changes: DataFrame) -> DataFrame:
    """Chunks of a transaction by partition: event count, order range, checksum."""
    return changes.groupBy("transaction_id", F.col("partition_id").alias("chunk_id")).agg(
        F.count("*").alias("event_count"), F.min("total_order").alias("first_total_order"), F.max("total_order").alias("last_total_order"), F.bit_xor(hashing.md5_60(F.col("idempotency_key"))).alias("checksum")
    )


def strict_chunks(changes: DataFrame, most: int) -> DataFrame:
    """Chunks of a transaction by position, at most ``most`` changes each."""
    at = F.row_number().over(Window.partitionBy("transaction_id").orderBy("total_order"))
    return partition_chunks(changes.withColumn("partition_id", F.floor((at - 1) / most).cast("int")))


MODES = ("strict_chunked", "partitioned")


def manifests(chunks: DataFrame, mode: str, txns: DataFrame | None = None) -> DataFrame:
    """One row for each transaction: events, chunks, order range and a checksum over its chunks; from txns (transaction_id,
    lsn, commit_timestamp_ms) its boundary too."""
    out = chunks.groupBy("transaction_id").agg(
        F.sum("event_count").alias("global_event_count"), F.count("*").alias("chunk_count"), F.min("first_total_order").alias("first_total_order"), F.max("last_total_order").alias("last_total_order"),
        F.bit_xor(hashing.md5_60(F.concat_ws(":", F.col("chunk_id").cast("string"), F.col("event_count").cast("string"), F.col("checksum").cast("string")))).alias("manifest_checksum"),
    ).withColumn("boundary_mode", F.lit(mode))
    return out if txns is None else out.join(txns.select("transaction_id", "lsn", "commit_timestamp_ms"), "transaction_id")


def manifest_violations(manifests: DataFrame, chunks: DataFrame, tables: DataFrame) -> DataFrame:
    """(transaction_id, violation) of manifests against themselves.

    manifests: transaction_id, lsn, commit_timestamp_ms, global_event_count, boundary_mode; chunks: transaction_id,
    chunk_id, event_count, first_total_order, last_total_order; tables: transaction_id, relation, event_count.
    """
    n, first, last = (F.col(c) for c in ("event_count", "first_total_order", "last_total_order"))
    each = chunks.repartition("transaction_id").groupBy("transaction_id", "chunk_id").agg(
        F.count("*").alias("copies"), F.sum(n).alias("events"), F.min(first).alias("low"), F.min(last).alias("least_last"), F.max(last).alias("high"), F.min(n).alias("least"),
        F.max(first > last).alias("reversed"), F.max(n > last - first + 1).alias("crowded"),
    )
    per = each.groupBy("transaction_id").agg(
        F.max("copies").alias("copies"), F.sum("events").alias("events"), F.min("low").alias("low"), F.min("least_last").alias("least_last"), F.max("high").alias("high"), F.min("least").alias("least"),
        F.max("reversed").alias("reversed"), F.max("crowded").alias("crowded"),
    )
    named = tables.repartition("transaction_id").groupBy("transaction_id", "relation").agg(F.count("*").alias("same"), F.sum("event_count").alias("of_table"), F.min("event_count").alias("least_of"))
    named = named.groupBy("transaction_id").agg(F.max("same").alias("same"), F.sum("of_table").alias("of_tables"), F.min("least_of").alias("least_of"))
    rows = manifests.select("transaction_id", "lsn", "commit_timestamp_ms", "global_event_count", "boundary_mode").join(per, "transaction_id", "left").join(named, "transaction_id", "left")
    return violations(rows, ["transaction_id"], [
        _unclean("transaction_id"), ("zero_lsn", F.col("lsn") == 0), ("zero_event_count", F.col("global_event_count") == 0), ("non_positive_timestamp", F.col("commit_timestamp_ms") <= 0),
        ("boundary_mode", ~F.coalesce(F.col("boundary_mode").isin(*MODES), F.lit(False))), ("no_partitions", F.col("copies").isNull()), ("repeated_partition", F.col("copies") > 1), ("zero_first_order", F.col("low") == 0),
        ("zero_last_order", F.col("least_last") == 0), ("reversed_range", F.col("reversed")), ("empty_partition", F.col("least") == 0), ("count_past_range", F.col("crowded")),
        ("order_past_end", F.col("high") > F.col("global_event_count")), ("event_count", F.col("events") != F.col("global_event_count")), ("first_event_missing", F.col("low") != 1),
        ("no_affected_tables", F.col("same").isNull()), ("repeated_affected_table", F.col("same") > 1), ("empty_affected_table", F.col("least_of") == 0), ("affected_event_count", F.col("of_tables") != F.col("global_event_count")),
    ])


def epoch_manifest_violations(manifests: DataFrame, chunks: DataFrame, txns: DataFrame, changes: DataFrame) -> DataFrame:
    """(transaction_id, violation) of manifests against the envelopes that they are about.

    txns: transaction_id, lsn, commit_timestamp_ms; changes: transaction_id, total_order; the first and the last order of
    every chunk have to be among the changes. Two marks a chunk are joined with the changes, not the changes with ranges.
    """
    counted = changes.groupBy("transaction_id").agg(F.count("*").alias("n"))
    of = txns.select("transaction_id", F.col("lsn").alias("txn_lsn"), F.col("commit_timestamp_ms").alias("txn_ms")).join(counted, "transaction_id", "left")
    total = chunks.groupBy("transaction_id").agg(F.sum("event_count").alias("events"))
    rows = manifests.select("transaction_id", "lsn", "commit_timestamp_ms", "global_event_count").join(of, "transaction_id", "left").join(total, "transaction_id", "left")
    known = F.col("txn_lsn").isNotNull()
    head = violations(rows, ["transaction_id"], [
        ("no_envelope", ~known), ("lsn", known & (F.col("lsn") != F.col("txn_lsn"))), ("timestamp", known & (F.col("commit_timestamp_ms") != F.col("txn_ms"))),
        ("change_count", known & (F.col("global_event_count") != F.coalesce("n", F.lit(0)))), ("partition_count", F.coalesce("events", F.lit(0)) != F.col("global_event_count")),
    ])
    ends = F.array(F.struct(F.lit("first_order_absent").alias("violation"), F.col("first_total_order").alias("total_order")), F.struct(F.lit("last_order_absent").alias("violation"), F.col("last_total_order").alias("total_order")))
    marks = chunks.join(txns.select("transaction_id"), "transaction_id", "left_semi").select("transaction_id", F.inline(ends))
    absent = marks.join(changes.select("transaction_id", "total_order"), ["transaction_id", "total_order"], "left_anti")
    return head.unionByName(absent.select("transaction_id", "violation").distinct())


def chunk_violations(manifest_chunks: DataFrame, delivered: DataFrame) -> DataFrame:
    """(transaction_id, chunk_id, violation) of delivered chunks, judged by their rows, against the manifest's.

    manifest_chunks: transaction_id, chunk_id, event_count, first_total_order, last_total_order, checksum; delivered, a row
    for each change: transaction_id, chunk_id, change_transaction_id, total_order, idempotency_key.
    """
    foreign = F.when(F.col("change_transaction_id").eqNullSafe(F.col("transaction_id")), 0).otherwise(1)
    rows = delivered.repartition("transaction_id", "chunk_id").groupBy("transaction_id", "chunk_id", "total_order").agg(
        F.count("*").alias("same"), F.max(foreign).alias("foreign"), F.bit_xor(hashing.md5_60(F.col("idempotency_key"))).alias("x")
    )
    got = rows.groupBy("transaction_id", "chunk_id").agg(
        F.sum("same").alias("n"), F.max("same").alias("same"), F.max("foreign").alias("foreign"), F.min("total_order").alias("low"), F.max("total_order").alias("high"), F.bit_xor("x").alias("x")
    )
    joined = got.join(manifest_chunks.select("transaction_id", "chunk_id", "event_count", "first_total_order", "last_total_order", "checksum"), ["transaction_id", "chunk_id"], "left")
    return violations(joined, ["transaction_id", "chunk_id"], [
        ("unknown_chunk", F.col("event_count").isNull()), ("event_count", F.col("n") != F.col("event_count")), ("order_range", (F.col("low") != F.col("first_total_order")) | (F.col("high") != F.col("last_total_order"))),
        ("checksum", F.col("x") != F.col("checksum")), ("repeated_order", F.col("same") > 1), ("change_transaction", F.col("foreign") > 0),
    ])


def barrier(manifest_chunks: DataFrame, arrived: DataFrame, markers: DataFrame) -> DataFrame:
    """Visibility of each transaction: a missing commit marker counts before missing chunks.

    manifest_chunks: transaction_id, chunk_id, event_count, checksum; arrived: the same of chunks that came, once each;
    markers: transaction_id.
    """
    got = arrived.select("transaction_id", "chunk_id", F.col("event_count").alias("n"), F.col("checksum").alias("sum")).dropDuplicates()
    joined = manifest_chunks.join(got, ["transaction_id", "chunk_id"], "full_outer")
    state = joined.groupBy("transaction_id").agg(
        F.count("event_count").alias("expected_chunks"), F.count_if(F.col("n").isNull()).alias("missing_chunks"), F.count_if(F.col("event_count").isNull()).alias("unexpected_chunks"),
        F.count_if((F.col("n") != F.col("event_count")) | (F.col("sum") != F.col("checksum"))).alias("corrupt_chunks"),
    )
    out = state.join(markers.select("transaction_id", F.lit(True).alias("marked")), "transaction_id", "left")
    decision = F.when(F.col("marked").isNull(), "held_commit_marker_missing").when(F.col("missing_chunks") > 0, "held_chunks_missing").when(F.col("unexpected_chunks") + F.col("corrupt_chunks") > 0, "rejected").otherwise("globally_visible")
    return out.select("transaction_id", "expected_chunks", "missing_chunks", "unexpected_chunks", "corrupt_chunks", decision.alias("decision"))


def reconstruct(changes: DataFrame, visible: DataFrame) -> DataFrame:
    """Changes of visible transactions in the order of application, and codes for repeated (order, operation) pairs."""
    rows = changes.join(visible.select("transaction_id"), "transaction_id", "left_semi").withColumn("operation_rank", operation_rank(F.col("operation")))
    by = Window.partitionBy("transaction_id").orderBy("total_order", "operation_rank", "idempotency_key")
    pair = F.struct("total_order", "operation")
    # pairs that are equal follow on each other, so the neighbours in the one order tell
    repeated = F.coalesce((F.lag(pair).over(by) == pair) | (F.lead(pair).over(by) == pair), F.lit(False))
    return rows.withColumn("apply_position", F.row_number().over(by)).withColumn("repeated", repeated)


#: What a marker states besides its transaction, with the code of a mismatch.
MARKED = {"lsn": "lsn", "commit_timestamp_ms": "timestamp", "global_event_count": "event_count", "chunk_count": "partition_count", "manifest_checksum": "manifest_checksum"}


def marker_violations(markers: DataFrame, manifests: DataFrame) -> DataFrame:
    """(transaction_id, violation) of commit markers: fields that are blank or zero, then each of MARKED that isn't the manifest's."""
    theirs = manifests.select("transaction_id", *[F.col(c).alias(f"m_{c}") for c in MARKED])
    rows = markers.select("transaction_id", *MARKED).join(theirs, "transaction_id", "left")
    known = F.col("m_lsn").isNotNull()
    zero = [(f"zero_{code}", F.col(c) <= 0 if c == "commit_timestamp_ms" else F.col(c) == 0) for c, code in MARKED.items()]
    return violations(rows, ["transaction_id"], [_unclean("transaction_id"), *zero, ("no_manifest", ~known), *[(code, known & (F.col(c) != F.col(f"m_{c}"))) for c, code in MARKED.items()]])


def local_views(chunks: DataFrame) -> DataFrame:
    """Each partition's view of its transactions; complete only where the transaction is in one partition."""
    all_ = chunks.groupBy("transaction_id").agg(F.sum("event_count").alias("global_event_count"), F.count("*").alias("partition_count"))
    complete = (F.col("event_count") == F.col("global_event_count")) & (F.col("partition_count") == 1)
    return chunks.join(all_, "transaction_id").select("transaction_id", "chunk_id", "event_count", "global_event_count", complete.alias("transaction_complete"))


def boundary_decision(dml: Column, ddl: Column) -> Column:
    return F.when((dml == 0) & (ddl == 0), "empty_transaction").when(ddl == 0, "partition_parallel_dml").otherwise("ddl_barrier_required")


def messages(txns: DataFrame, chunks: DataFrame, mode: str) -> DataFrame:
    """Stream messages of transactions: one strict envelope, or chunks, then a manifest, then a commit marker."""
    topic = lambda suffix: F.concat_ws(".", F.lit("cdc"), "source_id", "dataset_id", suffix)
    key = F.concat_ws(":", "source_id", "transaction_id")
    if mode == "strict":
        return txns.select("transaction_id", topic(F.lit("strict")).alias("topic"), key.alias("key"), F.lit(1).alias("sequence"), F.lit("envelope").alias("kind"), F.lit(None).cast("int").alias("chunk_id"))
    part = chunks.join(txns.select("transaction_id", "source_id", "dataset_id"), "transaction_id")
    name = F.concat(F.lit("partition."), F.col("chunk_id").cast("string")) if mode == "partitioned" else F.lit("strict")
    some = part.select("transaction_id", topic(name).alias("topic"), key.alias("key"), F.row_number().over(Window.partitionBy("transaction_id").orderBy("chunk_id")).alias("sequence"), F.lit("chunk").alias("kind"), "chunk_id")
    last = part.groupBy("transaction_id", "source_id", "dataset_id").agg(F.count("*").cast("int").alias("n"))
    tail = last.select("transaction_id", "source_id", "dataset_id", F.posexplode(F.array(F.lit("manifest"), F.lit("commit"))).alias("k", "kind"), "n")
    return some.unionByName(tail.select("transaction_id", topic(F.col("kind")).alias("topic"), key.alias("key"), (F.col("n") + F.col("k") + 1).alias("sequence"), "kind", F.lit(None).cast("int").alias("chunk_id")))


def message_headers(messages: DataFrame, txns: DataFrame, chunks: DataFrame, manifests: DataFrame, ddl: DataFrame) -> DataFrame:
    """messages (transaction_id, topic, sequence, kind, chunk_id) with headers: a map of what consumers route by.

    Every message names its protocol version, transaction and boundary and whether schema changes ask for a barrier;
    chunks add their partition, count and checksum, markers what the manifest says.
    """
    text = lambda c: F.col(c).cast("string")
    events = ddl.groupBy("transaction_id").agg(F.count("*").alias("ddl_event_count"))
    dml = chunks.groupBy("transaction_id").agg(F.sum("event_count").alias("dml"))
    head = txns.join(events, "transaction_id", "left").join(dml, "transaction_id", "left").withColumn("ddl_event_count", F.coalesce("ddl_event_count", F.lit(0)))
    decision = boundary_decision(F.coalesce("dml", F.lit(0)), F.col("ddl_event_count"))
    head = head.select("transaction_id", F.map_from_arrays(
        F.array(*map(F.lit, ("protocol_version", "source_id", "dataset_id", "database_id", "transaction_id", "commit_lsn", "commit_timestamp_ms", "ddl_event_count", "partitioned_scale_decision", "requires_ddl_barrier"))),
        F.array(F.lit("1"), text("source_id"), text("dataset_id"), text("database_id"), text("transaction_id"), text("commit_lsn"), text("commit_timestamp_ms"), text("ddl_event_count"), decision, (F.col("ddl_event_count") > 0).cast("string")),
    ).alias("head"))
    of_chunk = chunks.select("transaction_id", "chunk_id", F.create_map(F.lit("message_kind"), F.lit("partition_chunk"), F.lit("partition_id"), text("chunk_id"), F.lit("partition_event_count"), text("event_count"), F.lit("partition_checksum"), text("checksum")).alias("of_chunk"))
    told = [F.lit("global_event_count"), text("global_event_count"), F.lit("partition_count"), text("chunk_count"), F.lit("manifest_checksum"), text("manifest_checksum")]
    of_manifest = manifests.select("transaction_id", F.create_map(*told).alias("of_manifest"))
    rows = messages.join(head, "transaction_id").join(of_chunk, ["transaction_id", "chunk_id"], "left").join(of_manifest, "transaction_id", "left")
    named = F.create_map(F.lit("message_kind"), F.when(F.col("kind") == "commit", "commit_marker").otherwise(F.col("kind")))
    more = F.when(F.col("kind") == "chunk", F.col("of_chunk")).otherwise(F.map_concat(named, "of_manifest"))
    return rows.select("transaction_id", "topic", "sequence", F.map_concat("head", more).alias("headers"))


# -- schema changes -------------------------------------------------------------------------------


def ddl_disposition(kind: Column, auto: Column) -> Column:
    return F.when((kind == "add_column") & auto, "auto_apply").when(kind.isin("unspecified", "other"), "unsupported").otherwise("manual_review")


def ddl_policy_summary(events: DataFrame) -> DataFrame:
    d = events.withColumn("disposition", ddl_disposition(F.col("kind"), F.col("auto")))
    count = lambda x: F.count_if(F.col("disposition") == x)
    return d.agg(count("auto_apply").alias("auto_apply"), count("manual_review").alias("manual_review"), count("unsupported").alias("unsupported"), F.count_if(F.col("disposition") != "unsupported").alias("ack_required"))


def ddl_policy_digest(events: DataFrame) -> DataFrame:
    """SHA-256 of each transaction's schema changes in order."""
    row = F.struct("total_order", F.concat_ws("|", F.col("total_order").cast("string"), "relation", "kind", F.col("fingerprint_before").cast("string"), F.col("fingerprint_after").cast("string"), ddl_disposition(F.col("kind"), F.col("auto"))).alias("row"))
    rows = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["row"])
    return events.groupBy("transaction_id").agg(F.sha2(F.concat_ws("\n", F.first("transaction_id"), F.array_join(rows, "\n")), 256).alias("policy_sha256"))


def ddl_event_violations(events: DataFrame) -> DataFrame:
    return violations(events, ["transaction_id", "relation"], [
        ("order", F.col("total_order") <= 0), ("relation", ~names.clean(F.col("relation"))), ("fingerprint_after", F.col("fingerprint_after") == 0),
        ("unchanged_fingerprint", F.col("fingerprint_before") == F.col("fingerprint_after")), ("auto_kind", F.col("auto") & (F.col("kind") != "add_column")),
    ])


def schema_evidence_violations(events: DataFrame, versions: DataFrame) -> DataFrame:
    """Relations whose last schema change isn't the version the envelope states."""
    last = events.groupBy("transaction_id", "relation").agg(F.max_by("fingerprint_after", "total_order").alias("fingerprint"))
    joined = last.join(versions.select("transaction_id", "relation", F.col("version")), ["transaction_id", "relation"], "left")
    return joined.where(~F.col("fingerprint").eqNullSafe(F.col("version")))
