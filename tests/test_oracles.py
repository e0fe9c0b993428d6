"""Every query against its SQL in another engine, over the smallest tables."""

import duckdb
import pytest
from paths import SMALL

from ledgerlake.plans import synth
from ledgerlake.plans.all_queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in synth.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, tmp_path, name):
    path = str(tmp_path / "out")
    QUERIES[name](spark, SMALL).write.parquet(path)
    if name not in ORACLES:
        assert spark.read.parquet(path).count() > 0
        return
    duck.execute(f"CREATE OR REPLACE TEMP TABLE want AS {ORACLES[name]}")
    duck.execute(f"CREATE OR REPLACE TEMP VIEW got AS SELECT * FROM '{path}/*.parquet'")
    want = {r[0]: r[1] for r in duck.sql("DESCRIBE want").fetchall()}
    assert want == {r[0]: r[1] for r in duck.sql("DESCRIBE got").fetchall()}
    columns = ", ".join(f'"{c}"' for c in want)
    for a, b in (("want", "got"), ("got", "want")):
        assert duck.sql(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b} LIMIT 3").fetchall() == []
