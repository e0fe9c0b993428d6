"""Queries over named inputs, each with an oracle in DuckDB's SQL.

An input is a test table, the change log of synth, or SQL that both engines read alike; SQL names its inputs in braces.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.plans import synth
from ledgerlake.plans.inputs import INPUTS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_NAME = re.compile(r"\{(\w+)\}")


class Inputs:
    """Inputs by name, as DataFrames of one session and folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in synth.TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                self._made[name] = self.sql(synth.spark_sql(name) if name in ("changes", "arrivals") else INPUTS[name])
        return self._made[name]

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: self(n) for n in dict.fromkeys(_NAME.findall(text))})


def oracle(text: str) -> str:
    """text with its inputs as common table expressions in front."""
    done: dict[str, str] = {}

    def need(sql: str) -> None:
        for n in dict.fromkeys(_NAME.findall(sql)):
            if n in synth.TABLES or n in done:
                continue
            body = synth.duck_sql(n) if n in ("changes", "arrivals") else INPUTS[n]
            if n not in ("changes", "arrivals"):
                need(body)
            done[n] = _NAME.sub(r"\1", body) if n not in ("changes", "arrivals") else body

    need(text)
    body = _NAME.sub(r"\1", text).strip()
    ctes = ", ".join(f"{n} AS ({sql})" for n, sql in done.items())
    if not ctes:
        return body
    return f"WITH {ctes}, {body[5:]}" if body.startswith("WITH ") else f"WITH {ctes} {body}"


def query(name: str, sql: str | None = None) -> Callable:
    """Register f(inputs) as a query; sql is its oracle."""

    def put(f: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return f

    return put
