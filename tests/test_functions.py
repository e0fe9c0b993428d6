"""Column functions against plain Python."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlake.functions import hashing, lsn, names


def test_lsn_round_trip_and_malformed(spark):
    values = [0, 1, 16, 4294967295, 4294967296, 23817296, (1 << 63) - 1]
    df = spark.createDataFrame([(v, f"{v >> 32:X}/{v & 0xFFFFFFFF:X}") for v in values], "n long, text string")
    for r in df.select("n", "text", lsn.fmt(F.col("n")).alias("f"), lsn.parse(F.col("text")).cast("long").alias("p")).collect():
        assert r["f"] == r["text"] and r["p"] == r["n"]
    bad = spark.createDataFrame([(x,) for x in ("", "/", "1/", "/1", "G/1", "1/1/1", None)], "text string")
    got = bad.select(lsn.parse(F.col("text")).alias("p"), lsn.parse_lenient(F.col("text")).alias("l")).collect()
    assert all(r["p"] is None and r["l"] == 0 for r in got)
    top = spark.createDataFrame([("FFFFFFFF/FFFFFFFF",)], "text string").select(lsn.parse(F.col("text")).alias("p")).first()[0]
    assert int(top) == (1 << 64) - 1


def fnv(text):
    h = 2166136261
    for b in text.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h


def test_fnv(spark):
    texts = ["", "a", "store-001", "ünïcode", "x" * 300]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", hashing.fnv1a_32(F.col("t")).alias("h")).collect()
    assert {r["t"]: r["h"] for r in rows} == {x: fnv(x) for x in texts}


def test_names(spark):
    rows = spark.createDataFrame([("Public.Sales 1!",), ("!!",), ("",)], "t string").select(names.identifier(F.col("t")).alias("i"), names.slug(F.col("t")).alias("s"), names.clean(F.col("t")).alias("c")).collect()
    assert [tuple(r) for r in rows] == [("public_sales_1", "public-sales-1-", True), ("unnamed", "--", True), ("unnamed", "", False)]


json_values = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text(max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=2), x, max_size=3), max_leaves=8)


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.text(max_size=3), json_values, max_size=4))
def test_canonical_json_does_not_depend_on_key_order(value):
    assert hashing.canonical_json_text(value) == hashing.canonical_json_text(dict(reversed(value.items())))
