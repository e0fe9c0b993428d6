"""The broker as source and sink. The connector is a separate jar; without it these raise Spark's own error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, servers: str, topics: list[str], most_per_trigger: int = 100_000) -> DataFrame:
    """Messages as (topic, key, body, partition, offset); most_per_trigger is the backpressure."""
    raw = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics), "maxOffsetsPerTrigger": most_per_trigger, "failOnDataLoss": "true"}).load()
    return raw.select("topic", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("body"), "partition", "offset")


def write(messages: DataFrame, servers: str, checkpoint: str):
    """A started query that publishes (topic, key, body) with an idempotent producer and acknowledgements of all replicas."""
    rows = messages.select("topic", "key", F.col("body").alias("value"))
    return rows.writeStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "kafka.acks": "all", "kafka.enable.idempotence": "true", "checkpointLocation": checkpoint}).start()
