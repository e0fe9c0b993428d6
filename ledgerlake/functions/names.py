"""Identifiers, slugs and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def identifier(text: Column) -> Column:
    """Lower-case letters and digits, other characters as underscores, none at the ends; 'unnamed' where nothing is left."""
    out = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]", "_"), F.lit("_"))
    return F.when(out == "", F.lit("unnamed")).otherwise(out)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "-")


def clean(text: Column) -> Column:
    """Neither blank nor with white space around it."""
    return F.coalesce((text != "") & (F.trim(text) == text), F.lit(False))


def idempotency_key(source: Column, lsn: Column, transaction: Column, order: Column) -> Column:
    return F.concat_ws(":", source, lsn, transaction, order.cast("string"))


def boundary_key(source: Column, database: Column, dataset: Column, transaction: Column, lsn: Column) -> Column:
    return F.concat_ws(":", source, database, dataset, transaction, lsn)


def redacted_url(text: Column) -> Column:
    """The password of a URL's user part as ***."""
    return F.regexp_replace(text, r"(://[^:/@\s]+):[^@/\s]*@", "$1:***@")


def escaped_html(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for raw, safe in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def ratio_bp(top: Column, bottom: Column) -> Column:
    """top / bottom in basis points, rounded down; null for a zero bottom."""
    return F.when(bottom != 0, F.floor(top * 10000 / bottom).cast("long"))
