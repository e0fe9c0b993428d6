"""Images, envelopes, commits and streams in the cases that the tables of the queries don't hold."""

import random
import zlib

import pandas as pd
import pytest
import xxhash
from paths import SMALL
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerlake.functions import hashing
from ledgerlake.operators import images, lake, protocol, views
from ledgerlake.plans.all_queries import QUERIES
from ledgerlake.sources import kafka, local_log
from ledgerlake.storage import ManifestTable
from ledgerlake.streaming import ingest

VERSIONS = "source_id string, relation string, record_key string, epoch_id string, transaction_id string, lsn long, total_order int, valid_from long, valid_to long, is_current boolean, idempotency_key string, close_epoch_id string, payload string"
LOG = "source_id string, relation string, record_key string, operation string, epoch_id string, transaction_id string, lsn long, commit_timestamp_ms long, total_order int, idempotency_key string, payload string"


def test_functions_that_only_python_can_recompute(spark):
    rows = QUERIES["f11_xxh3_64"](spark, SMALL).collect()
    assert len(rows) > 100 and all(r["hash"] % (1 << 64) == xxhash.xxh3_64_intdigest(r["transaction_id"].encode()) for r in rows)
    assert all(r["crc"] == zlib.crc32(r["transaction_id"].encode()) for r in QUERIES["f13_crc32"](spark, SMALL).collect())
    import json

    props = {r["event_id"]: r["props"] for r in spark.read.parquet(f"{SMALL}/events.parquet").collect()}
    rows = QUERIES["f14_canonical_json"](spark, SMALL).collect()
    assert len(rows) == len(props) and all(r["canonical"] == hashing.canonical_json_text(json.loads(props[r["event_id"]])) for r in rows)
    nested = spark.createDataFrame([('{"b": [1, null, {"z": "ü", "a": true}], "a": {}}',), (None,)], "t string").select(hashing.canonical_json("t").alias("c")).collect()
    assert [r["c"] for r in nested] == ['{"a":{},"b":[1,<NULL>,{"a":true,"z":"ü"}]}', None]


def test_two_changes_of_one_order_are_an_error(spark):
    events = lambda orders: spark.createDataFrame([("tx", k, 1, 0) for k in orders], "transaction_id string, total_order int, subtransaction_id int, payload int")
    commits = spark.createDataFrame([("tx",)], "transaction_id string")
    assert sorted(r["dense_order"] for r in protocol.assemble(events([30, 10, 20]), commits).collect()) == [1, 2, 3]
    with pytest.raises(PySparkException):
        protocol.assemble(events([10, 20, 20]), commits).collect()


def image_row(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()])


def test_keys_and_kinds(spark):
    key = images.image(images.cell("id", F.lit("7"), is_key=True), images.cell("note", F.lit(None).cast("string")))
    none = F.lit(None).cast(images.IMAGE)
    got = image_row(spark, a=images.record_key(none, key, "id"), b=images.record_key(key, none, "note"), c=images.partition_key(none, key, "store")).first()
    assert tuple(got) == ("7", "", None)
    for bad in (images.record_key(none, none, "id"), images.record_key(none, key, "other"), images.value_text(images.cell("x", F.lit("1"), F.lit("strange")))):
        with pytest.raises(PySparkException):
            image_row(spark, a=bad).collect()
    assert image_row(spark, a=images.project(key, ["id"])).first()[0] == [("note", "null", None)]


def test_apply_plan_of_inserts_without_columns_and_truncations(spark):
    cells = images.image(images.cell("id", F.lit("1"), is_key=True), images.cell("owned", F.lit("x")))
    none = F.lit(None).cast(images.IMAGE)
    rows = [("insert", none, images.image()), ("insert", none, cells), ("truncate", none, none), ("update", none, images.image(images.cell("owned", F.lit("y")))), (None, none, none)]
    df = None
    for k, (op, before, after) in enumerate(rows):
        one = spark.range(1).select(F.lit(k).alias("k"), F.lit("tx").alias("transaction_id"), F.lit("r").alias("relation"), F.lit(op).cast("string").alias("operation"), before.alias("before"), after.alias("after"))
        df = one if df is None else df.unionByName(one)
    plan = {r["k"]: r for r in images.plan_apply(df, {"r": ["owned"]}).collect()}
    assert [plan[k]["action"] for k in range(5)] == ["insert_defaults", "insert", "truncate", "error", "error"]
    assert [plan[k]["error"] for k in (3, 4)] == ["missing_key", "unsupported_operation"]
    assert [c["name"] for c in plan[1]["set_columns"]] == ["id"] and plan[2]["set_columns"] is None and not plan[2]["must_match"]


def test_replay_evidence_against_classified_arrivals(spark):
    rng = random.Random(1)
    rows = [("s", "d", "x", f"t{rng.randint(0, 20)}", 8, rng.randint(0, 2), k) for k in range(150)]
    arrivals = spark.createDataFrame(rows, "source_id string, database_id string, dataset_id string, transaction_id string, lsn long, envelope_checksum long, arrival_seq long")
    d = [r["disposition"] for r in lake.classify_arrivals(arrivals).collect()]
    assert tuple(lake.replay_evidence(arrivals).first()) == (d.count("admitted"), d.count("duplicate"), d.count("conflict"), False)
    assert tuple(lake.replay_evidence(arrivals.where("false")).first()) == (0, 0, 0, True)


def test_rollups_of_the_shared_aggregate_are_those_of_the_changes(spark):
    from ledgerlake.plans.registry import Inputs

    changes = Inputs(spark, SMALL)("changes")
    one = lake.transactions(changes).cache()
    for rollup in (lake.epoch_totals, lake.epoch_sources, lake.epoch_tables, lake.data_files):
        assert sorted(map(str, rollup(changes).collect())) == sorted(map(str, rollup(one).collect()))


def state_of(versions):
    return sorted((r["idempotency_key"], r["valid_to"], r["is_current"]) for r in versions.collect())


def test_a_version_amid_an_epochs_changes(spark):
    target = spark.createDataFrame([("s", "r", "k", "e0", "t0", 20, 1, 20, None, True, "old", None, "p")], VERSIONS)
    rows = [("s", "r", "k", "update", "e1", f"t{n}", n, n, 1, f"new{n}", "p") for n in (10, 30)]
    changes = spark.createDataFrame(rows, LOG)
    assert state_of(views.merge_versions(target, changes)) == [("new10", 20, False), ("new30", None, True), ("old", None, True)]
    closed = views.merge_versions(target, changes, straddling=True)
    assert state_of(closed) == [("new10", 20, False), ("new30", None, True), ("old", 30, False)]
    assert state_of(views.merge_versions(closed, changes, straddling=True)) == state_of(closed)


def test_next_existing_version_against_every_pair(spark):
    rng = random.Random(2)
    place = lambda: (rng.choice("ab"), rng.randint(0, 6), rng.randint(1, 2))
    opened = [(k, *place()) for k in range(60)]
    target = [(*place(), rng.randint(0, 99)) for _ in range(40)]
    o = spark.createDataFrame([("s", "r", key, n, order, k) for k, key, n, order in opened], "source_id string, relation string, record_key string, lsn long, total_order int, id int")
    t = spark.createDataFrame([("s", "r", *x) for x in target], "source_id string, relation string, record_key string, lsn long, total_order int, valid_from long")
    want = {k: min((v for y, m, other, v in target if y == key and (m, other) > (n, order)), default=None) for k, key, n, order in opened}
    assert {r["id"]: r["next_existing"] for r in views.next_existing(o, t).collect()} == want


def test_offsets_of_a_large_topic_go_on_over_ranges(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 50 == 0, "small").otherwise("large").alias("topic"), F.lit("k").alias("key"), F.col("id").cast("string").alias("body"), ((F.col("id") * 7919) % 5003).alias("seq"))
    log = local_log.frame(rows, spark.createDataFrame([("small", 100)], "topic string, depth long")).collect()
    for topic, base in (("small", 100), ("large", 0)):
        mine = sorted((r["offset"], int(r["body"]) * 7919 % 5003) for r in log if r["topic"] == topic)
        assert [o for o, _ in mine] == list(range(base, base + len(mine))) and [s for _, s in mine] == sorted(s for _, s in mine)


def test_ambiguous_commits_are_reconciled(spark, tmp_path, monkeypatch):
    table = ManifestTable(spark, str(tmp_path / "t"), "id")
    publish = ManifestTable._publish

    def lost_answer(self, *args):
        publish(self, *args)
        raise TimeoutError("no answer")

    def refused(self, *args):
        raise TimeoutError("refused")

    monkeypatch.setattr(ManifestTable, "_publish", lost_answer)
    assert table.append(spark.range(3), "a") == "already_committed" and table.read().count() == 3
    monkeypatch.setattr(ManifestTable, "_publish", refused)
    with pytest.raises(TimeoutError):
        table.append(spark.range(10, 15), "b")
    assert table.read().count() == 3
    monkeypatch.setattr(ManifestTable, "_publish", publish)
    assert table.append(spark.range(10, 15), "b") == "committed"
    assert table.read().count() == 8 and table.read(11, 12).count() == 5 and table.read(4, 9).count() == 0
    told = {r["commit_id"]: r for r in table.manifest().collect()}
    assert (told["b"]["rows"], told["b"]["low"], told["b"]["high"], told["b"]["snapshot_id"]) == (5, 10, 14, table.snapshot_id("b")) and told["a"]["snapshot_id"] != told["b"]["snapshot_id"]


class State:
    """A group's state, kept between calls."""

    def __init__(self):
        self.value, self.hasTimedOut, self.timeout = None, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_barrier_state_is_forgotten():
    state = State()

    def send(*messages):
        df = pd.DataFrame([{"kind": k, "chunk_id": c, "checksum": s, "chunk_count": n} for k, c, s, n in messages])
        return [r["decision"] for out in ingest._barrier(("tx",), iter([df]), state) for _, r in out.iterrows()]

    assert send(("chunk", 0, 11, None), ("commit", None, None, None)) == ["held_chunks_missing"]
    assert send(("chunk", 0, 11, None), ("manifest", None, None, 2)) == ["held_chunks_missing"]
    assert '"0": 11' in state.value[2] and state.timeout is None
    assert send(("chunk", 1, 12, None)) == ["globally_visible"] and state.value[2] == "{}" and state.timeout == ingest.REMEMBERED_MS
    assert send(("chunk", 1, 12, None)) == ["globally_visible"]
    state.hasTimedOut = True
    assert send() == [] and not state.exists
    state.hasTimedOut = False
    assert send(("manifest", None, None, 1), ("chunk", 0, 1, None), ("chunk", 0, 2, None)) == ["conflicting_redelivery"]


def test_barrier_transactions_share_states(spark, tmp_path):
    rows, want = [], {}
    for k in range(600):
        tx = f"tx-{k}"
        rows += [(tx, "chunk", c, 2**59 + k, None) for c in range(3) if k % 3 or c < 2] + [(tx, "manifest", None, None, 3)]
        rows += [(tx, "chunk", 0, 2**59 + k + 1, None)] if k % 7 == 0 else []
        rows += [(tx, "commit", None, None, None)] if k % 5 else []
        want[tx] = "conflicting_redelivery" if k % 7 == 0 else "held_commit_marker_missing" if k % 5 == 0 else "held_chunks_missing" if k % 3 == 0 else "globally_visible"
    df = spark.createDataFrame(rows, "transaction_id string, kind string, chunk_id int, checksum long, chunk_count int")
    for _ in range(2):  # all is delivered twice
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/messages")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/messages")
    found = []
    ended = ingest.drain(ingest.barrier(stream), lambda batch, k: found.append({r["transaction_id"]: r["decision"] for r in batch.collect()}), f"{tmp_path}/progress", "update")
    assert found == [want, want]
    assert 0 < ended.lastProgress["stateOperators"][0]["numRowsTotal"] <= ingest.BUCKETS


def test_barrier_bucket_decides_and_forgets_as_one_transaction_does():
    rng, shared, alone = random.Random(4), State(), {f"tx-{k}": State() for k in range(20)}
    shared.getCurrentProcessingTimeMs = lambda: now
    for now in range(1, 30):
        sent = [(rng.choice(list(alone)), *rng.choice([("chunk", rng.randint(0, 2), rng.randint(10, 10 + (rng.random() < 0.1)), None), ("manifest", None, None, 3), ("commit", None, None, None)])) for _ in range(30)]
        df = pd.DataFrame(sent, columns=["transaction_id", "kind", "chunk_id", "checksum", "chunk_count"])
        df["checksum"] = [None if x[3] is None else str(x[3]) for x in sent]
        got = pd.concat(ingest._bucket((0,), iter([df[:11], df[11:]]), shared))
        each = pd.concat(out for tx, some in df.groupby("transaction_id") for out in ingest._barrier((tx,), iter([some]), alone[tx]))
        assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, each.to_numpy().tolist()))
    assert set(each["decision"]) >= {"globally_visible", "conflicting_redelivery"}
    decided = {tx for tx, state in alone.items() if state.get[3] in ingest.DECIDED}
    now, shared.hasTimedOut = 30 + ingest.REMEMBERED_MS, True
    assert list(ingest._bucket((0,), iter([]), shared)) == [] and shared.exists == (len(decided) < len(alone))
    shared.hasTimedOut = False
    again = pd.DataFrame([(tx, "commit", None, None, None) for tx in sorted(decided)], columns=df.columns)
    assert set(pd.concat(ingest._bucket((0,), iter([again]), shared))["decision"]) == {"held_chunks_missing"}


def test_manifests_of_good_transactions_break_no_rule(spark):
    rows = [("s", "d", "x", "tx", 16, "0/10", 5, k + 1, k % 2, "r", f"key-{k}") for k in range(5)]
    changes = spark.createDataFrame(rows, "source_id string, database_id string, dataset_id string, transaction_id string, lsn long, commit_lsn string, commit_timestamp_ms long, total_order int, partition_id int, relation string, idempotency_key string")
    txns = changes.select("transaction_id", "lsn", "commit_timestamp_ms").distinct()
    chunks = protocol.partition_chunks(changes)
    manifests = protocol.manifests(chunks, "partitioned", txns)
    assert protocol.manifest_violations(manifests, chunks, protocol.affected_tables(changes)).count() == 0
    assert protocol.epoch_manifest_violations(manifests, chunks, txns, changes).count() == 0
    assert protocol.marker_violations(manifests, manifests).count() == 0
    delivered = changes.select("transaction_id", F.col("partition_id").alias("chunk_id"), F.col("transaction_id").alias("change_transaction_id"), "total_order", "idempotency_key")
    assert protocol.chunk_violations(chunks, delivered).count() == 0
    stated = protocol.content_checksums(changes, ["total_order", "relation", "idempotency_key"])
    assert protocol.checksum_violations(stated, changes, ["total_order", "relation", "idempotency_key"]).count() == 0


class Recorder:
    """Takes what a reader or writer is told, and gives itself back."""

    def __init__(self):
        self.told, self.kind = {}, None

    readStream = writeStream = property(lambda self: self)

    def format(self, kind):
        self.kind = kind
        return self

    def options(self, **given):
        self.told.update(given)
        return self

    def select(self, *columns):
        return self

    load = start = lambda self: self


def test_broker_options_reach_the_connector(spark):
    reader = kafka.read(Recorder(), "host:1", ["cdc.a", "cdc.b"], 7)
    assert (reader.kind, reader.told["subscribe"], reader.told["maxOffsetsPerTrigger"], reader.told["kafka.bootstrap.servers"]) == ("kafka", "cdc.a,cdc.b", 7, "host:1")
    writer = kafka.write(Recorder(), "host:1", "/progress")
    assert (writer.kind, writer.told["kafka.acks"], writer.told["checkpointLocation"]) == ("kafka", "all", "/progress")
