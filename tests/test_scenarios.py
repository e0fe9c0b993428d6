"""Failure scenarios with small inputs and the decisions expected of them."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerlake import config
from ledgerlake.operators import lake, protocol, recovery, state, verify
from ledgerlake.sources import local_log, test_decoding
from ledgerlake.storage import ManifestTable

CHANGE = "source_id string, database_id string, dataset_id string, transaction_id string, lsn long, commit_lsn string, envelope_checksum long, epoch_id string, relation string, arrival_seq long"
STORES = [f"store-{k:04d}" for k in range(1, 13)]


def fleet(spark, stores, seq=0, checksum=0):
    rows = []
    for s in stores:
        k = int(s[-4:])
        lsn = 0x16B6C50 + 16 * k
        rows.append((s, "postgres", "retail", f"tx-{k}", lsn, f"0/{lsn:X}", 1000 + k + checksum, "epoch-1", "public.sales", seq + k))
    return spark.createDataFrame(rows, CHANGE)


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "source_id string")


@pytest.mark.parametrize(("online", "policy", "want"), [(12, "wait_all_required", "complete"), (9, "publish_with_gaps", "complete_with_gaps"), (9, "wait_all_required", "open"), (9, "quarantine_on_gap", "quarantined")])
def test_fleet_fan_in(spark, online, policy, want):
    got = lake.epoch_summary(fleet(spark, STORES[:online]), ids(spark, STORES), ids(spark, []), policy).first()
    assert (got["state"], got["complete_source_count"], got["missing_source_count"], got["transaction_count"]) == (want, online, 12 - online, online)
    assert got["checksum_status"] == ("match" if want.startswith("complete") else "pending")


def test_late_stores_replays_and_conflicts(spark):
    first, late = fleet(spark, STORES[:9]), fleet(spark, STORES[9:])
    arrivals = first.unionByName(late).unionByName(fleet(spark, STORES, seq=100)).unionByName(fleet(spark, STORES, seq=200))
    got = lake.admitted(arrivals)
    assert lake.epoch_summary(got, ids(spark, STORES), ids(spark, []), "wait_all_required").first()["state"] == "complete"
    assert lake.epoch_totals(got).first() == lake.epoch_totals(first.unionByName(late)).first()
    assert lake.conflicting_keys(arrivals).count() == 0
    evidence = lake.replay_evidence(arrivals.unionByName(fleet(spark, STORES[:2], seq=300, checksum=9))).first()
    assert tuple(evidence) == (12, 24, 2, False)


def test_epoch_identity_depends_on_windows_not_on_order(spark):
    rows = [("a", "0/16B6C00", "0/16B6C50"), ("b", "0/16B6D00", "0/16B6D20")]
    windows = lambda r: spark.createDataFrame(r, "source_id string, start_lsn string, end_lsn string")
    one = lambda r, policy="wait_all_required": lake.deterministic_epoch_id("retail", policy, ids(spark, ["a", "b"]), windows(r)).first()[0]
    assert one(rows) == one(rows[::-1]) != one(rows, "publish_with_gaps:5")
    assert one(rows) != one([rows[0], ("b", "0/16B6D00", "0/16B6D21")]) and one(rows).startswith("epoch-retail-")


def test_verification_id(spark):
    assert spark.range(1).select(lake.verification_id(F.lit("retail"), F.lit("epoch-1"), F.lit(99).cast("long"))).first()[0] == "verify:retail:epoch-1:0000000000000063"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 4), min_size=1, max_size=12), st.integers(1, 5))
def test_chunks_reconstruct_their_transaction(spark, partitions, most):
    rows = [("tx", k + 1, p, "insert", f"key-{k}", "public.sales") for k, p in enumerate(partitions)]
    changes = spark.createDataFrame(rows, "transaction_id string, total_order int, partition_id int, operation string, idempotency_key string, relation string")
    txns = spark.createDataFrame([("tx", 16, 1)], "transaction_id string, lsn long, commit_timestamp_ms long")
    for chunks in (protocol.partition_chunks(changes), protocol.strict_chunks(changes, most)):
        manifest = protocol.manifests(chunks, "partitioned", txns)
        assert manifest.first()["global_event_count"] == len(rows) and protocol.manifest_violations(manifest, chunks, protocol.affected_tables(changes)).count() == 0
        decided = protocol.barrier(chunks, chunks, changes.select("transaction_id").distinct())
        assert [r["decision"] for r in decided.collect()] == ["globally_visible"]
        back = protocol.reconstruct(changes, decided).orderBy("apply_position").collect()
        assert [r["idempotency_key"] for r in back] == [r[4] for r in rows] and not any(r["repeated"] for r in back)


@pytest.mark.parametrize("n", [1, 3, 8])
def test_watermarks(spark, n):
    rows = [("f", k, 100 + k, 50 + k) for k in range(n)]
    frame = lambda r: spark.createDataFrame(r, "flow_id string, partition_id int, durable long, applied long")
    full = state.watermarks(frame(rows), n).first()
    assert (full["complete"], full["global_durable"], full["global_applied"]) == (True, 100, 50)
    if n > 1:
        part = state.watermarks(frame(rows[1:]), n).first()
        assert (part["complete"], part["missing"], part["global_durable"]) == (False, 1, None)


def test_recovery(spark):
    cases = [((3, 2, 0, 0, False), "writer_crash_before_data_file_commit"), ((3, 3, 0, 0, False), "writer_crash_after_data_before_epoch_metadata"), ((3, 3, 2, 0, True), "writer_crash_after_epoch_metadata"), ((3, 3, 1, 1, True), "conflicting_duplicate_on_replay"), ((3, 3, 1, 0, False), "verification_mismatch_after_commit"), ((3, 3, 1, 0, True), None)]
    for (files, receipts, metadata, conflicts, verified), want in cases:
        found = spark.range(1).select(recovery.observed_scenario(F.lit(files), F.lit(receipts), F.lit(metadata), F.lit(conflicts), F.lit(verified))).first()[0]
        assert found == want


def test_a_commit_is_published_once_and_a_broken_one_is_invisible(spark, tmp_path):
    table = ManifestTable(spark, str(tmp_path / "t"))
    assert [table.append(spark.range(3), "a"), table.append(spark.range(9), "a")] == ["committed", "already_committed"]
    spark.range(7).write.parquet(str(tmp_path / "t/data/commit=broken"))
    assert table.read().count() == 3
    table.append(spark.range(2), "broken")
    assert table.read().count() == 5


def test_log_frames(spark):
    rows = spark.createDataFrame([("t", "k", "a", 1), ("t", "k", "b", 2), ("u", "k", "c", 1)], "topic string, key string, body string, seq int")
    log = local_log.frame(rows, spark.createDataFrame([("t", 5)], "topic string, depth long"))
    assert sorted((r["topic"], r["offset"]) for r in log.collect()) == [("t", 5), ("t", 6), ("u", 0)]
    cursors = spark.createDataFrame([("t", 5)], "topic string, cursor long")
    assert sorted((r["topic"], r["offset"]) for r in local_log.consume(log, cursors).collect()) == [("t", 6), ("u", 0)]
    assert local_log.damage(local_log.frame(rows)).count() == 0


def test_decoding_lines(spark):
    lines = ["BEGIN 529", "table public.sales: UPDATE: old-key: id[integer]:1 new-tuple: id[integer]:2 note[text]:'it''s' gone[text]:null", "table public.sales: DELETE: id[integer]:7", "COMMIT 529", "what"]
    got = test_decoding.parse(spark.createDataFrame([(x,) for x in lines], "line string"), "line").collect()
    assert [r["kind"] for r in got] == ["begin", "change", "change", "commit", "unknown"] and got[0]["transaction"] == "529"
    assert [(c["name"], c["type_oid"], c["value"]) for c in got[1]["columns"]] == [("id", 23, "2"), ("note", 25, "it's"), ("gone", 25, None)]
    assert [c["value"] for c in got[1]["before"]] == ["1"] and got[2]["operation"] == "delete"


def test_reseed_keeps_rows_for_which_the_filter_is_null(spark):
    target = spark.createDataFrame([(1, 1), (2, None), (3, 9)], "id long, x long")
    source = spark.createDataFrame([(1, 2), (4, 1), (5, None)], "id long, x long")
    got = verify.reseed(source, target, F.col("x") < 5, ["id", "x"]).collect()
    assert sorted((r["id"], r["x"]) for r in got if r["x"] is not None) == [(1, 2), (3, 9), (4, 1)] and [r["id"] for r in got if r["x"] is None] == [2]


def test_fan_in_message_over_the_limit_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(local_log, "LONGEST", 3)
    with pytest.raises(PySparkException):
        local_log.frame(spark.createDataFrame([("t", "k", "abcd", 1)], "topic string, key string, body string, seq int")).collect()


def test_configuration():
    d = config.parse({"dataset": {"id": "retail", "mode": "partitioned_scale_mode", "partition": {"partition_count": 16, "key_column": "store_id"}, "tables": [{"schema": "public", "name": "sales", "verify": {"primary_key": "id", "excluded_columns": ["updated_at"]}}]}})
    assert d.tables[0].relation == "public.sales" and d.null_key_policy == "quarantine"
    with pytest.raises(ValueError):
        config.Dataset("x", "partitioned_scale_mode")
    with pytest.raises(ValueError):
        config.Dataset("x", null_key_policy="guess")
