"""Time functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats in the order in which they are tried, of the three parsers.
FIRST = ("yyyy/M/d H:m:s", "yyyy-M-d H:m:s", "yyyy/M/d", "yyyy-M-d")
SECOND = ("yyyy/M/d H:m:s", "yyyy-M-d H:m:s", "yyyy/M/d H:m", "yyyy-M-d")
ANY = ("yyyy/M/d H:m:s", "yyyy-M-d H:m:s", "yyyy/M/d H:m", "yyyy-M-d H:m", "yyyy/M/d", "yyyy-M-d")


def parsed(c: Column, formats: tuple[str, ...] = ANY) -> Column:
    """Time of a string in the first format that fits; NULL if none does."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in formats])


def whole_days(a: Column, b: Column) -> Column:
    """Whole days of 24 hours between two times."""
    return F.floor((b.cast("double") - a.cast("double")) / 86400).cast("int")


def media_seconds(c: Column) -> Column:
    """Seconds of HH:MM:SS,mmm (or with a dot); 0 for anything else."""
    part = lambda i: F.regexp_extract(F.trim(c), r"^(\d+):(\d+):(\d+)[,.](\d+)$", i).try_cast("double")
    return F.coalesce(part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000, F.lit(0.0))
