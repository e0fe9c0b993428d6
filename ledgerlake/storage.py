"""Tables that are published by one manifest row, in a folder that driver and executors share."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all runs in one process (tests), a folder set here; an error on a cluster."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(os.path.join(tempfile.gettempdir(), "checkpoints"))  # one process has one disk
        found = context.getCheckpointDir()
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/ledgerlake-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: for what several branches of a plan read."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class ManifestTable:
    """Data files in a folder for each commit, and a manifest that tells which commits count.

    A commit writes its rows, then one manifest row: its id, the snapshot id that follows from it, its rows, and the range of
    range_column where the table has one. A commit whose id is in the manifest is not written again; one that broke off
    before its manifest row is invisible and is overwritten. Readers take the files of published commits alone.
    """

    MANIFEST = "commit_id string, snapshot_id string, rows long, low long, high long"

    def __init__(self, spark: SparkSession, path: str, range_column: str | None = None) -> None:
        self.spark, self.path, self.range_column = spark, path.rstrip("/"), range_column

    def _exists(self, path: str) -> bool:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)

    def committed(self, commit_id: str) -> bool:
        return self._exists(f"{self.path}/manifest/commit={commit_id}/_SUCCESS")

    def snapshot_id(self, commit_id: str) -> str:
        """A version 5 UUID made of the digest of path and commit: a replayed commit has the snapshot id of the first try."""
        digest = hashlib.sha256(f"{len(self.path)}:{self.path}{len(commit_id)}:{commit_id}".encode()).digest()
        return str(uuid.UUID(bytes=digest[:16], version=5))

    def append(self, rows: DataFrame, commit_id: str) -> str:
        """committed, or already_committed where the id was published before.

        An error while the manifest row is written leaves open whether it counts: the manifest is read anew, and what it
        says goes. Where it lacks the commit the error is raised, and the same commit may be tried again.
        """
        if self.committed(commit_id):
            return "already_committed"
        data = f"{self.path}/data/commit={commit_id}"
        rows.write.mode("overwrite").parquet(data)
        try:
            self._publish(data, commit_id, rows.schema)
        except Exception:
            if not self.committed(commit_id):
                raise
            return "already_committed"
        return "committed"

    def _publish(self, data: str, commit_id: str, schema: StructType) -> None:
        c = self.range_column
        low, high = (F.min(c), F.max(c)) if c else (F.lit(None), F.lit(None))
        about = self.spark.read.schema(schema).parquet(data).agg(F.count("*").alias("rows"), low.cast("long").alias("low"), high.cast("long").alias("high"))
        row = about.select(F.lit(commit_id).alias("commit_id"), F.lit(self.snapshot_id(commit_id)).alias("snapshot_id"), "rows", "low", "high")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/commit={commit_id}")

    def manifest(self) -> DataFrame:
        """A row for each published commit."""
        if not self._exists(f"{self.path}/manifest"):
            return self.spark.createDataFrame([], self.MANIFEST)
        return self.spark.read.schema(self.MANIFEST).option("recursiveFileLookup", "true").parquet(f"{self.path}/manifest")

    def read(self, low: int | None = None, high: int | None = None) -> DataFrame:
        """Rows of published commits, with their commit id; with low and high only of commits whose range touches theirs.

        The driver gets the ids of those commits: for a range, as many as overlap it, not all that ever were.
        """
        found = self.manifest()
        if low is not None:
            found = found.where(F.coalesce((F.col("low") <= high) & (F.col("high") >= low), F.lit(False)))
        paths = [f"{self.path}/data/commit={r['commit_id']}" for r in found.select("commit_id").toLocalIterator()]
        if not paths:
            some = self.spark.read.option("basePath", f"{self.path}/data").parquet(f"{self.path}/data/*")
            return some.withColumn("commit", F.col("commit").cast("string")).where("false")
        data = self.spark.read.option("basePath", f"{self.path}/data").parquet(*paths)
        return data.withColumn("commit", F.col("commit").cast("string"))
