"""Current state and slowly changing versions, merged without MERGE INTO."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["source_id", "relation", "record_key"]
ROW = ["epoch_id", "transaction_id", "lsn", "commit_timestamp_ms", "total_order", "idempotency_key", "payload"]


def usable(changes: DataFrame) -> DataFrame:
    """Row changes that the views read; truncations and rows without a key don't count."""
    return changes.where(F.col("operation").isin("insert", "update", "delete") & F.col("record_key").isNotNull())


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each record by LSN, then order. A maximum, not a sort: it is combined before the shuffle."""
    rest = [c for c in changes.columns if c not in KEY]
    best = F.max_by(F.struct(*rest), F.struct("lsn", "total_order")).alias("best")
    return changes.groupBy(*KEY).agg(best).select(*KEY, "best.*").select(*changes.columns)


def merge_current(target: DataFrame, changes: DataFrame, honor_truncate: bool = False) -> DataFrame:
    """target after an epoch's changes: a change not older than the target's row replaces or deletes it, others are stale.

    target has KEY and ROW; changes also operation. With honor_truncate a truncation removes a relation's earlier rows.
    """
    new = latest(usable(changes)).select(*KEY, "operation", *ROW)
    t, n = target.select(*KEY, F.struct(*ROW).alias("old")), new.select(*KEY, "operation", F.struct(*ROW).alias("new"))
    joined = t.join(n, KEY, "full_outer")
    newer = F.col("old").isNull() | (F.struct(F.col("new.lsn"), F.col("new.total_order")) >= F.struct(F.col("old.lsn"), F.col("old.total_order")))
    wins = F.col("new").isNotNull() & newer
    kept = joined.where(~(wins & (F.col("operation") == "delete"))).withColumn("row", F.when(wins, F.col("new")).otherwise(F.col("old")))
    out = kept.where("row IS NOT NULL").select(*KEY, "row.*")
    if honor_truncate:
        cut = changes.where("operation = 'truncate'").groupBy("source_id", "relation").agg(F.max(F.struct("lsn", "total_order")).alias("cut"))
        out = out.join(cut, ["source_id", "relation"], "left").where("cut IS NULL OR struct(lsn, total_order) > cut").drop("cut")
    return out


def versions(changes: DataFrame) -> DataFrame:
    """Versions that an epoch's changes open, each to its record's next change; deletes close and open nothing."""
    by = Window.partitionBy(*KEY).orderBy("lsn", "total_order")
    seq = usable(changes).withColumn("next_ts", F.lead("commit_timestamp_ms").over(by)).withColumn("next_operation", F.lead("operation").over(by))
    return seq.where("operation <> 'delete'")


VERSION = [*KEY, "epoch_id", "transaction_id", "lsn", "total_order", "valid_from", "valid_to", "is_current", "idempotency_key", "close_epoch_id", "payload"]


def next_existing(opened: DataFrame, target: DataFrame) -> DataFrame:
    """opened with next_existing: the least valid_from of target's versions of its record that come later in the log.

    Both sides go through one window a record, later rows first; a running minimum takes the place of a join by range. Of
    equal positions the opened row comes first, so that only later ones count.
    """
    rest = [c for c in opened.columns if c not in KEY]
    mine = opened.select(*KEY, "lsn", "total_order", F.lit(0).alias("side"), F.lit(None).cast("long").alias("valid_from"), F.struct(*rest).alias("row"))
    theirs = target.select(*KEY, "lsn", "total_order", F.lit(1).alias("side"), F.col("valid_from"), F.lit(None).cast(mine.schema["row"].dataType).alias("row"))
    by = Window.partitionBy(*KEY).orderBy(F.desc("lsn"), F.desc("total_order"), "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = mine.unionByName(theirs).withColumn("next_existing", F.min("valid_from").over(by))
    return both.where("side = 0").select(*KEY, "row.*", "next_existing").select(*opened.columns, "next_existing")


def merge_versions(target: DataFrame, changes: DataFrame, straddling: bool = False) -> DataFrame:
    """target (VERSION) after an epoch's changes.

    Current versions of other epochs close at a record's first change of the epoch where that is later than they are; new
    versions open unless their idempotency key is there already, up to their next change in the epoch or the next version
    in the target, whichever is earlier. So a replayed epoch changes nothing, and an older one that comes late fits in
    between. A version amid an epoch's changes, whose first change is earlier and another later, stays current beside the
    last one that opens; with straddling it closes at the first change that is later than it is.

    Both tables go through one shuffle by record, the versions as rows of the log beside the changes; windows take the place
    of joins. Versions that lie by record already, such as an earlier merge's, are not moved again.
    """
    told = ["epoch_id", "transaction_id", "lsn", "total_order", "idempotency_key", "payload"]
    record = [f"record.{c}" for c in KEY]  # a union lies by record where both sides' columns are alike to their qualifiers, so they get new names
    by = [F.col(f"`{c}`") for c in record]
    none, named = F.lit(None).cast, [F.col(c).alias(n) for c, n in zip(KEY, record, strict=True)]
    mine = usable(changes).select(*named, *told, F.col("commit_timestamp_ms").alias("at"), "operation", none("long").alias("valid_to"), none("boolean").alias("is_current"), none("string").alias("close_epoch_id"), F.lit(0).alias("side"))
    theirs = target.select(*named, *told, F.col("valid_from").alias("at"), none("string").alias("operation"), "valid_to", "is_current", "close_epoch_id", F.lit(1).alias("side"))
    both = theirs.repartition(*by).unionByName(mine.repartition(*by))
    change, version = F.col("side") == 0, F.col("side") == 1
    known = reduce(and_, (c.isNotNull() for c in by))  # as in a join, a null is like nothing
    there = F.max(F.when(version & known & F.col("idempotency_key").isNotNull(), True)).over(Window.partitionBy(*by, "idempotency_key"))
    both = both.withColumn("there", F.coalesce(there, F.lit(False)))
    later = Window.partitionBy(*by).orderBy(F.desc("lsn"), F.desc("total_order"), "side")  # of equal positions changes come first, so that only later versions count
    before, here = later.rowsBetween(Window.unboundedPreceding, -1), later.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumns({"next": F.last(F.when(change, F.struct("at")), ignorenulls=True).over(before), "next_existing": F.min(F.when(version, F.col("at"))).over(here)})
    position = F.struct("epoch_id", "lsn", "total_order", "at")
    if straddling:
        versions_first = Window.partitionBy(*by).orderBy(F.desc("lsn"), F.desc("total_order"), F.desc("side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        first = F.last(F.when(change, position), ignorenulls=True).over(versions_first)
    else:
        first = F.when(known, F.min_by(position, F.when(change, F.struct("lsn", "total_order"))).over(Window.partitionBy(*by)))
    both = both.withColumn("first", first)
    closes = F.col("is_current") & F.col("first").isNotNull() & (F.col("epoch_id") != F.col("first.epoch_id")) & (F.struct("first.lsn", "first.total_order") > F.struct("lsn", "total_order"))
    closes = F.coalesce(closes, F.lit(False))
    end = F.least("next.at", "next_existing")  # nulls don't count
    return both.where(version | ((F.col("operation") != "delete") & ~F.col("there"))).select(
        *[c.alias(n) for c, n in zip(by, KEY, strict=True)], "epoch_id", "transaction_id", "lsn", "total_order", F.col("at").alias("valid_from"),
        F.when(change, end).when(closes, F.col("first.at")).otherwise(F.col("valid_to")).alias("valid_to"), F.when(change, end.isNull()).otherwise(F.col("is_current") & ~closes).alias("is_current"),
        "idempotency_key", F.when(closes, F.col("first.epoch_id")).otherwise(F.col("close_epoch_id")).alias("close_epoch_id"), "payload",
    )


def interval_violations(versions: DataFrame) -> DataFrame:
    """Versions that end before they begin: timestamps that don't follow the log's order."""
    return versions.where("valid_to < valid_from").select(*KEY, "idempotency_key", "valid_from", "valid_to")


def fold_images(changes: DataFrame, columns: list[str]) -> DataFrame:
    """The last image of each record, with each column's last value that isn't an unchanged marker (null here) carried on."""
    rest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("lsn", "total_order"))).alias(c) for c in columns]
    return changes.groupBy(*KEY).agg(F.max_by("operation", F.struct("lsn", "total_order")).alias("operation"), *rest).where("operation <> 'delete'").drop("operation")
