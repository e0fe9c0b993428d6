"""Log sequence numbers: text HIGH/LOW in hexadecimal, and the 64-bit number they stand for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHAPE = r"^\+?0*[0-9A-Fa-f]{1,8}/\+?0*[0-9A-Fa-f]{1,8}$"
NUMERIC = "decimal(38,0)"


def _half(lsn: Column, k: int) -> Column:
    digits = F.regexp_replace(F.split_part(lsn, F.lit("/"), F.lit(k)), r"^\+", "")
    return F.conv(digits, 16, 10).cast(NUMERIC)


def is_lsn(lsn: Column) -> Column:
    return F.coalesce(lsn.rlike(SHAPE), F.lit(False))


def parse(lsn: Column) -> Column:
    """The number, as a decimal because the upper half of the range passes a signed 64-bit integer; null where malformed."""
    return F.when(is_lsn(lsn), (_half(lsn, 1) * F.lit(4294967296).cast("decimal(20,0)") + _half(lsn, 2)).cast(NUMERIC))


def parse_strict(lsn: Column) -> Column:
    """As parse, but an error where malformed."""
    return F.when(is_lsn(lsn), parse(lsn)).otherwise(F.raise_error(F.concat(F.lit("malformed LSN: "), F.coalesce(lsn, F.lit("null")))).cast(NUMERIC))


def parse_lenient(lsn: Column) -> Column:
    """As parse, but 0 where malformed or null."""
    return F.coalesce(parse(lsn), F.lit(0).cast(NUMERIC))


def fmt(number: Column) -> Column:
    """Upper-case hexadecimal halves without padding, of a 64-bit integer."""
    return F.concat(F.hex(F.shiftrightunsigned(number, 32)), F.lit("/"), F.hex(number.bitwiseAND(F.lit(4294967295))))


def canonical(lsn: Column) -> Column:
    """The text form that fmt gives, of any accepted spelling; null where malformed."""
    half = lambda k: F.regexp_replace(F.upper(F.regexp_replace(F.split_part(lsn, F.lit("/"), F.lit(k)), r"^\+", "")), "^0+(?=.)", "")
    return F.when(is_lsn(lsn), F.concat(half(1), F.lit("/"), half(2)))


def behind(ahead: Column, back: Column) -> Column:
    """Bytes that back lies behind ahead, never below 0."""
    return F.greatest(ahead - back, F.lit(0))
