import duckdb
import pytest
from cases import ODD
from paths import SMALL

import __spark_entry__
import corpus_pipeline
from ledgerlake.llm import queries
from ledgerlake.plans import synth


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in synth.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, tmp_path, name):
    path = str(tmp_path / "out")
    queries.QUERIES[name](spark, SMALL).write.parquet(path)
    got = f"'{path}/*.parquet'"
    assert duck.sql(f"SELECT count(*) FROM {got}").fetchall()[0][0] > 0 or name == "op2_decontamination"
    if name in queries.ORACLES:
        duck.execute(f"CREATE OR REPLACE TEMP TABLE want AS {queries.ORACLES[name]}")
        want = {r[0]: r[1] for r in duck.sql("DESCRIBE want").fetchall()}
        assert want == {r[0]: r[1] for r in duck.sql(f"DESCRIBE SELECT * FROM {got}").fetchall()}
        columns = ", ".join(want)
        for a, b in (("want", got), (got, "want")):
            assert duck.sql(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b} LIMIT 3").fetchall() == []


def test_names():
    found = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in found if k.startswith("op")} and "pipeline" in found
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secret_scan", "packing"]


#: Enough labels for the toxicity model to find its terms.
MORE = "/root/testdata/sf0.01"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{MORE}/documents.parquet").cache()
    bad = docs.limit(1).selectExpr("doc_id + 900000 AS doc_id", "concat('token = abcdef123456 ', text) AS text", "lang", "source", "n_chars")
    item = spark.read.parquet(f"{MORE}/benchmark.parquet").first()["text"]
    leak = docs.limit(1).selectExpr("doc_id + 900001 AS doc_id", f"concat('so it goes on here. ', '{item}', ' and on') AS text", "lang", "source", "n_chars")
    toxic = docs.limit(1).selectExpr("doc_id + 900002 AS doc_id", "'you idiot moron, what a pathetic worthless stupid scum you are, trash' AS text", "lang", "source", "n_chars")
    now = docs.unionByName(bad).unionByName(leak).unionByName(toxic)
    sizes = [now.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        then = now
        now = corpus_pipeline.written(stage(spark, now, MORE), f"test-{name}")
        assert now.columns == docs.columns
        left = {r["doc_id"] for r in now.select("doc_id").collect()}
        gone = {r["doc_id"] for r in then.select("doc_id").collect()} - left
        assert (900002 in gone) == (name == "toxicity") and (900001 in gone) == (name == "decontamination")
        sizes.append(now.count())
        if name == "toxicity":
            labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{MORE}/labels.parquet").collect()}
            clean, toxic = ([d for d, y in labels.items() if y == x] for x in (0, 1))
            assert sum(d in left for d in clean) >= 0.95 * len(clean) and sum(d in gone for d in toxic) >= 0.9 * len(toxic)
    # an eighth of the documents is toxic, and near duplicates and benchmark items are as many as their own tests say
    after = dict(zip(["all", *[name for name, _ in corpus_pipeline.STAGES]], sizes, strict=False))
    assert after["secret_scan"] == after["decontamination"] > 0.95 * after["near_dedup"] and after["near_dedup"] > 0.88 * after["toxicity"] and after["toxicity"] > 0.85 * after["all"]
    text = [r["text"] for r in now.where("doc_id = 900000").collect()]
    assert all(t.startswith("<SECRET:assign> ") for t in text)
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, MORE)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in now.select("doc_id").collect()}


def test_stages_take_odd_rows_and_empty_tables(spark, odd, docs):
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, SMALL)
        if name == "packing":
            assert got.select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
        else:
            assert got.columns == odd.columns and got.count() >= len(ODD) - 2
        assert stage(spark, docs([]), SMALL).count() == 0
