"""Golden rows, replays, late epochs and the gate."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerlake.operators import lake, views

LOG = "source_id string, relation string, record_key string, operation string, epoch_id string, transaction_id string, lsn long, commit_timestamp_ms long, total_order int, idempotency_key string, payload string"
VERSIONS = "source_id string, relation string, record_key string, epoch_id string, transaction_id string, lsn long, total_order int, valid_from long, valid_to long, is_current boolean, idempotency_key string, close_epoch_id string, payload string"
EPOCH = "epoch-2026-08-16T00"


def row(source, txn, lsn, order, op, key, payload, epoch=EPOCH):
    return (source, "public.sales", key, op, epoch, txn, lsn, lsn * 1000, order, f"{source}:{txn}:{order}", payload)


def golden(spark):
    return spark.createDataFrame(
        [
            row("store-001", "tx-001", 0x10, 1, "insert", "sale-100", "25.00 open"), row("store-001", "tx-002", 0x20, 2, "update", "sale-100", "30.00 paid"),
            row("store-002", "tx-003", 0x30, 3, "insert", "sale-200", "14.00 open"), row("store-002", "tx-004", 0x40, 4, "delete", "sale-200", None),
        ],
        LOG,
    )


def empty_state(spark):
    return spark.createDataFrame([], LOG).drop("operation")


def state(df):
    return sorted((r["record_key"], r["transaction_id"], r["payload"]) for r in df.collect())


def versions(df):
    return sorted((r["record_key"], r["valid_from"], r["valid_to"], r["is_current"]) for r in df.collect())


def test_golden_current_state(spark):
    assert state(views.merge_current(empty_state(spark), golden(spark))) == [("sale-100", "tx-002", "30.00 paid")]


def test_golden_versions(spark):
    got = views.merge_versions(spark.createDataFrame([], VERSIONS), golden(spark))
    assert versions(got) == [("sale-100", 16000, 32000, False), ("sale-100", 32000, None, True), ("sale-200", 48000, 64000, False)]
    assert versions(views.merge_versions(got, golden(spark))) == versions(got)


def test_stale_changes_lose_and_ties_win(spark):
    one = views.merge_current(empty_state(spark), golden(spark))
    old = spark.createDataFrame([row("store-001", "tx-000", 0x08, 9, "update", "sale-100", "old")], LOG)
    tie = spark.createDataFrame([row("store-001", "tx-002b", 0x20, 2, "update", "sale-100", "tie")], LOG)
    assert state(views.merge_current(one, old)) == state(one)
    assert state(views.merge_current(one, tie)) == [("sale-100", "tx-002b", "tie")]


def test_older_epoch_that_comes_late_fits_in_between(spark):
    late = spark.createDataFrame([row("store-001", "tx-2", 0x20, 1, "update", "k", "b", "epoch-2")], LOG)
    early = spark.createDataFrame([row("store-001", "tx-1", 0x10, 1, "insert", "k", "a", "epoch-1")], LOG)
    none = spark.createDataFrame([], VERSIONS)
    in_order = views.merge_versions(views.merge_versions(none, early), late)
    reversed_ = views.merge_versions(views.merge_versions(none, late), early)
    assert versions(in_order) == versions(reversed_) == [("k", 16000, 32000, False), ("k", 32000, None, True)]


def test_merged_versions_against_every_pair(spark):
    rng = random.Random(5)
    key = lambda: (rng.choice(["s", "s", None]), "r", rng.choice("ab"))
    changes = []
    for n, order in sorted({(rng.randint(0, 9), rng.randint(1, 3)) for _ in range(60)}):  # a place of the log is one change's
        changes.append((*key(), rng.choice(["insert", "update", "delete"]), "e1", f"t{n}", n, rng.randint(0, 99), order, rng.choice([None, f"c{n}.{order}"]), "new"))
    keys = [(c[:3], c[9]) for c in changes if rng.random() < 0.4]
    target = [(*k, rng.choice(["e0", "e1"]), "t", rng.randint(0, 9), rng.randint(1, 3), rng.randint(0, 99), None, rng.random() < 0.7, i, None, "old") for k, i in [*keys, *((key(), f"o{n}") for n in range(30))]]
    same = lambda a, b: None not in a[:3] and a[:3] == b[:3]
    want = []
    for t in target:
        first = min((c for c in changes if same(t, c)), key=lambda c: (c[6], c[8]), default=None)
        closes = t[9] and first and first[4] != t[3] and (first[6], first[8]) > t[5:7]
        want.append((*t[:8], first[7], False, t[10], first[4], t[12]) if closes else t)
    for c in changes:
        if c[3] != "delete" and not any(same(c, t) and c[9] is not None and c[9] == t[10] for t in target):
            after = min((x for x in changes if x[:3] == c[:3] and (x[6], x[8]) > (c[6], c[8])), key=lambda x: (x[6], x[8]), default=None)
            ends = ([after[7]] if after else []) + [t[7] for t in target if t[:3] == c[:3] and t[5:7] > (c[6], c[8])]
            want.append((*c[:3], c[4], c[5], c[6], c[8], c[7], min(ends, default=None), not ends, c[9], None, c[10]))
    got = views.merge_versions(spark.createDataFrame(target, VERSIONS), spark.createDataFrame(changes, LOG))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_replayed_merge_moves_each_table_once(spark):
    target, log = spark.createDataFrame([], VERSIONS), golden(spark)
    again = views.merge_versions(views.merge_versions(target, log), log)
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3  # the versions' and the log's, which its second merge finds again
    assert "Join" not in plan


def test_current_state_is_current_versions(spark):
    current = views.merge_current(empty_state(spark), golden(spark))
    kept = views.merge_versions(spark.createDataFrame([], VERSIONS), golden(spark)).where("is_current")
    assert state(current) == state(kept)


def test_truncate_is_ignored_unless_asked_for(spark):
    cut = golden(spark).unionByName(spark.createDataFrame([row("store-001", "tx-9", 0x90, 1, "truncate", None, None)], LOG))
    assert len(state(views.merge_current(empty_state(spark), cut))) == 1
    assert state(views.merge_current(empty_state(spark), cut, honor_truncate=True)) == []


def epochs(spark, state, policy="wait_all_required"):
    return spark.createDataFrame([(EPOCH, state, policy)], "epoch_id string, state string, policy string")


@pytest.mark.parametrize(
    ("state", "policy", "status", "times", "gaps", "unsafe", "ready"),
    [
        ("complete", "wait_all_required", "match", 1, False, False, True), ("complete", "wait_all_required", "pending", 1, False, False, False), ("complete", "wait_all_required", "match", 2, False, False, False),
        ("complete_with_gaps", "publish_with_gaps", "match", 1, False, False, False), ("complete_with_gaps", "publish_with_gaps", "match", 1, True, False, True),
        ("complete_with_gaps", "wait_all_required", "match", 1, True, False, False), ("open", "wait_all_required", "pending", 1, False, True, True), ("quarantined", "wait_all_required", "match", 1, True, False, False),
    ],
)
def test_gate(spark, state, policy, status, times, gaps, unsafe, ready):
    verification = spark.createDataFrame([(EPOCH, status)] * times, "epoch_id string, checksum_status string")
    found = lake.gate(epochs(spark, state, policy), verification, EPOCH, gaps, unsafe)
    if ready:
        assert found.collect()[0][0] == "ready"
    else:
        with pytest.raises(PySparkException):
            found.collect()


def test_rollups_do_not_depend_on_order_and_replay_changes_nothing(spark, tmp_path):
    from paths import SMALL
    from ledgerlake.plans.registry import Inputs

    changes = Inputs(spark, SMALL)("changes")
    a = lake.epoch_sources(changes).orderBy("epoch_id", "source_id").collect()
    b = lake.epoch_sources(changes.orderBy(F.rand(3))).orderBy("epoch_id", "source_id").collect()
    assert a == b
    raw, path = lake.raw_rows(changes), str(tmp_path / "raw")
    lake.write_raw(raw, path)
    lake.write_raw(raw, path)
    assert spark.read.parquet(path).count() == raw.count()
    assert lake.file_plan_violations(raw, lake.data_files(changes)).count() == 0
