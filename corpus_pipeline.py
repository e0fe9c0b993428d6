"""A corpus through five stages: toxicity, near duplicates, benchmark decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the columns
of documents; the last returns the packed pieces. Null and empty texts pass all stages (their toxicity is the share of toxic
labels, they are like nothing, hold nothing and have no secret) and become one piece of the end id alone. Equal rows are judged
alike, and of those of one doc_id all stay or all go; rows of null doc_id stay where their text may. An empty table gives an
empty one. Ties: the least doc_id of near duplicates stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import decontamination, near_dedup, packing, secrets, toxicity
from ledgerlake.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; the model is fitted on the labels of docs that are not held out."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    return toxicity.without_toxic(docs, model)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each component of near duplicates."""
    return near_dedup.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with placeholders for secrets."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, with their ids, in sequences of 2048 tokens."""
    return packing.pack_documents(docs, keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]

#: Scores, tokens and packing have no form in SQL; tests hold each stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
