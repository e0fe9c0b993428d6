"""Text lines of a logical decoding plugin: BEGIN x, COMMIT x, and row changes with typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COLUMN = r"[A-Za-z_][A-Za-z0-9_]*\[[^\]]+\]:(?:'(?:[^']|'')*'|[^ ]+)"
#: Type numbers of the types named in the lines.
TYPE_OIDS = {"boolean": 16, "bytea": 17, "bigint": 20, "smallint": 21, "integer": 23, "text": 25, "json": 114, "numeric": 1700, "uuid": 2950, "jsonb": 3802, "timestamp with time zone": 1184}


def _after(text: Column, mark: str) -> Column:
    """What follows the first mark in text."""
    return F.substr(text, F.locate(mark, text) + len(mark), F.length(text))


def _columns(text: Column) -> Column:
    """Columns of an image as structs of name, type, type number, value; quotes doubled inside a value are one.

    One pass of the pattern finds the columns; name, type and value are cut out of each by position.
    """
    oids = F.create_map(*[x for k, v in TYPE_OIDS.items() for x in (F.lit(k), F.lit(v))])

    def column(c: Column) -> Column:
        name, rest = F.substring_index(c, "[", 1), _after(c, "[")
        kind, raw = F.substring_index(rest, "]:", 1), _after(rest, "]:")
        value = F.when(raw.startswith("'"), F.replace(F.substr(raw, F.lit(2), F.length(raw) - 2), F.lit("''"), F.lit("'"))).when(raw != "null", raw)
        return F.struct(name.alias("name"), kind.alias("type"), F.try_element_at(oids, kind).alias("type_oid"), value.alias("value"))

    return F.transform(F.regexp_extract_all(text, F.lit(_COLUMN), F.lit(0)), column)


def parse(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with kind (begin, commit, change or unknown), transaction, relation, operation, before (of an old-key part) and columns.

    What a line is follows from its beginning; only changes are searched for columns, and only those with an old key for one.
    """
    c = F.col(line)
    rest = F.substr(c, F.lit(7), F.length(c))  # after "table "
    relation = F.substring_index(rest, ": ", 1)
    told = _after(rest, ": ")
    operation = F.substring_index(told, ":", 1)
    change = F.coalesce(c.startswith("table ") & F.contains(rest, F.lit(": ")) & operation.isin("INSERT", "UPDATE", "DELETE", "TRUNCATE"), F.lit(False))
    body = _after(told, ":")
    keyed = F.contains(body, F.lit("old-key: "))
    old = F.when(change & keyed, F.substring_index(_after(body, "old-key: "), " new-tuple: ", 1)).otherwise("")
    new = F.when(change, F.when(F.contains(body, F.lit("new-tuple: ")), _after(body, "new-tuple: ")).otherwise(body)).otherwise("")
    number = lambda word: F.when(c.startswith(f"{word} "), F.regexp_extract(c, rf"^{word} ([0-9]+)", 1))
    begun, done = number("BEGIN"), number("COMMIT")
    kind = F.when(begun != "", "begin").when(done != "", "commit").when(change, "change").otherwise("unknown")
    text = lambda x: F.when(x != "", x)
    return lines.select(
        "*", kind.alias("kind"), text(F.coalesce(begun, done)).alias("transaction"), F.when(change, relation).alias("relation"),
        F.when(change, F.lower(operation)).alias("operation"), _columns(old).alias("before"), _columns(new).alias("columns"),
    )
