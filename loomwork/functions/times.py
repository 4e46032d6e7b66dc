"""Stamps as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A stamp with its zone, by date, T and time; letter case is free. A fixed format.
STAMP = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-](?:[01]\d|2[0-3]):[0-5]\d)$"


def instant(ts: Column) -> Column:
    """The instant of a valid RFC 3339 stamp (T and zone required), else null."""
    plain = F.upper(F.regexp_replace(ts, r"(\.\d{6})\d+", "$1"))
    # a leap second is the second before it, and then one more
    leap = plain.rlike(r"^[^T]+T\d{2}:\d{2}:60")
    at = F.try_to_timestamp(F.when(leap, F.regexp_replace(plain, r"^([^T]+T\d{2}:\d{2}):60", "$1:59")).otherwise(plain))
    return F.when(ts.rlike(STAMP), F.when(leap, at + F.expr("interval 1 second")).otherwise(at))
