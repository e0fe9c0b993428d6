"""Hashes with the same result in any SQL engine, and the 64-bit ones that need a vectorised function."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of 32-bit FNV-1a.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619


def md5_60(text: Column) -> Column:
    """The first 60 bits of MD5 as a non-negative integer: the default checksum, which plain SQL can recompute."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def fnv1a_32(text: Column) -> Column:
    """32-bit FNV-1a over the UTF-8 bytes."""
    digits = F.hex(F.encode(text, "UTF-8"))
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(text), F.lit(1))), lambda k: F.conv(F.substr(digits, k * 2 - 1, F.lit(2)), 16, 10).cast("long"))
    some = F.when(F.octet_length(text) > 0, steps).otherwise(F.array().cast("array<long>"))
    return F.aggregate(some, F.lit(FNV_OFFSET).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(4294967295)))


def bucket(text: Column, n: int) -> Column:
    return (fnv1a_32(text) % n).cast("int")


@F.pandas_udf(T.LongType())
def xxh3_64(text: pd.Series) -> pd.Series:
    """XXH3 in its 64-bit form as a bit pattern, for parity with stored checksums; not built into the engine."""
    import xxhash

    return text.map(lambda t: None if t is None else int.from_bytes(xxhash.xxh3_64_digest(t.encode()), "big", signed=True))


def canonical_json_text(value: object) -> str:
    """A JSON value with sorted keys and <NULL> for null, without spaces."""
    if value is None:
        return "<NULL>"
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_json_text(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical_json_text, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """canonical_json_text of JSON documents; flat rows need no Python, see operators.verify.row_image."""
    return text.map(lambda t: None if t is None else canonical_json_text(json.loads(t)))


def digest_uuid(digest: Column) -> Column:
    """A version 5 UUID made of the first 32 hexadecimal digits of a digest."""
    nibble = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1).cast("int"))
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), nibble, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))
