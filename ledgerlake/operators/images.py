"""Row images of changes: projection, keys, and what an update, insert or delete does to the target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Type of an image: its columns in order. Kinds are null, text, binary and unchanged (a value that the source didn't send).
IMAGE = "array<struct<name:string,kind:string,text:string,bytes:binary,is_key:boolean>>"
KINDS = ("null", "text", "binary", "unchanged", "unspecified")


def cell(name: str, text: Column, kind: Column | None = None, data: Column | None = None, is_key: bool = False) -> Column:
    """One column of an image; without a kind, null or text by its value."""
    how = F.when(text.isNull(), "null").otherwise("text") if kind is None else kind
    return F.struct(
        F.lit(name).alias("name"), how.alias("kind"), F.when(how == "text", text).alias("text"), F.when(how == "binary", F.lit(None).cast("binary") if data is None else data).alias("bytes"), F.lit(is_key).alias("is_key")
    )


def image(*cells: Column) -> Column:
    return F.array(*cells).cast(IMAGE)


def value_text(c: Column) -> Column:
    """A cell's value as text: empty for null and unchanged ones, <binary:N> for N bytes; an error for an unknown kind."""
    unknown = F.raise_error(F.concat(F.lit("unknown kind of value: "), F.coalesce(c["kind"], F.lit("none")))).cast("string")
    return F.when(c["kind"] == "text", c["text"]).when(c["kind"] == "binary", F.concat(F.lit("<binary:"), F.octet_length(c["bytes"]).cast("string"), F.lit(">"))).when(c["kind"].isin("null", "unchanged", "unspecified"), F.lit("")).otherwise(unknown)


def project(image: Column, excluded: list[str]) -> Column:
    """An image without the excluded columns, the others in order, as (name, kind, value); value is null but for text and binary."""
    kept = F.filter(image, lambda c: ~c["name"].isin(*excluded)) if excluded else image
    shown = lambda c: F.when(c["kind"].isin("text", "binary"), value_text(c))
    kind = lambda c: F.when(c["kind"] == "unspecified", "null").otherwise(c["kind"])
    return F.transform(kept, lambda c: F.struct(c["name"].alias("name"), kind(c).alias("kind"), shown(c).alias("value")))


def _named(image: Column, name: str) -> Column:
    """The first cell of that name, or null."""
    return F.try_element_at(F.filter(image, lambda c: c["name"] == name), F.lit(1))


def record_key(before: Column, after: Column, key: str) -> Column:
    """The key column's text from the image after, else the one before; an error without an image or without the column."""
    c = _named(F.coalesce(after, before), key)
    missing = F.raise_error(F.when(F.coalesce(after, before).isNull(), "no image").otherwise(f"no key column {key}")).cast("string")
    return F.when(c.isNull(), missing).otherwise(value_text(c))


def partition_key(before: Column, after: Column, column: str) -> Column:
    """The partition column's text from the same image as the key, null where the image lacks it."""
    c = _named(F.coalesce(after, before), column)
    return F.when(c.isNotNull(), value_text(c))


def plan_apply(changes: DataFrame, owned: dict[str, list[str]] | None = None, versions: DataFrame | None = None, ddl: DataFrame | None = None) -> DataFrame:
    """What each change does to the target: changes with action, error, set_columns, key_columns and must_match.

    changes: transaction_id, relation, operation, before and after (IMAGE, null where absent). action is insert,
    insert_defaults (no column is the source's to set), update, delete, truncate, no_op (only columns that the target owns)
    or error. owned: columns of a relation that the target owns. versions (transaction_id, relation): the relations whose
    schema an envelope states; any other's change is an error. ddl (transaction_id): transactions whose schema changes have
    to pass a barrier first. Updates set the columns sent that aren't keys, and keys that changed; they and deletes look
    their row up by the keys of the image before, updates without one by those after, and have to meet a row.
    """
    own = F.lit(None).cast("array<string>")
    for relation, columns in sorted((owned or {}).items()):
        own = F.when(F.col("relation") == relation, F.array(*map(F.lit, columns))).otherwise(own)
    own = F.coalesce(own, F.array().cast("array<string>"))
    rows = changes
    stated, blocked = F.lit(True), F.lit(False)
    if versions is not None:
        rows = rows.join(versions.select("transaction_id", "relation").distinct().withColumn("stated", F.lit(True)), ["transaction_id", "relation"], "left")
        stated = F.coalesce("stated", F.lit(False))
    if ddl is not None:
        rows = rows.join(ddl.select("transaction_id").distinct().withColumn("barrier", F.lit(True)), "transaction_id", "left")
        blocked = F.coalesce("barrier", F.lit(False))
    op, before, after = F.col("operation"), F.col("before"), F.col("after")
    key_image = F.when(op == "delete", before).otherwise(F.coalesce(before, after))
    keys = F.filter(key_image, lambda c: c["is_key"])
    moved = lambda c: c["is_key"] & F.exists(keys, lambda k: (k["name"] == c["name"]) & ~(k["kind"].eqNullSafe(c["kind"]) & k["text"].eqNullSafe(c["text"]) & k["bytes"].eqNullSafe(c["bytes"])))
    sent = F.filter(after, lambda c: (~c["is_key"] & (c["kind"] != "unchanged")) | moved(c))
    free = lambda cells: F.filter(cells, lambda c: ~F.array_contains(own, c["name"]))
    setting = F.when(op == "insert", free(after)).when(op == "update", free(sent))
    looks = op.isin("update", "delete")
    error = (
        F.when(blocked, "ddl_barrier_required").when(~stated, "schema_version_missing").when(~F.coalesce(op.isin("insert", "update", "delete", "truncate"), F.lit(False)), "unsupported_operation")
        .when(op.isin("insert", "update") & after.isNull(), "missing_after_image").when((op == "delete") & before.isNull(), "missing_before_image")
        .when(looks & F.exists(keys, lambda c: c["kind"] == "unchanged"), "unchanged_key").when(looks & (F.size(keys) == 0), "missing_key").when((op == "update") & (F.size(sent) == 0), "no_mutable_columns")
    )
    empty = F.size(setting) == 0
    action = F.when(F.col("error").isNotNull(), "error").when((op == "insert") & empty, "insert_defaults").when((op == "update") & empty, "no_op").otherwise(op)
    named = lambda cells: F.transform(cells, lambda c: F.struct(c["name"].alias("name"), F.when(c["kind"].isin("text", "binary"), value_text(c)).alias("value")))
    out = rows.withColumn("error", error).withColumn("action", action)
    acts = lambda *x: F.col("action").isin(*x)
    out = out.withColumns({
        "set_columns": F.when(acts("insert", "update"), named(setting)), "key_columns": F.when(acts("update", "delete"), named(keys)), "must_match": acts("update", "delete"),
    })
    return out.drop("stated", "barrier")
