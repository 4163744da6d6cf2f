"""Times as columns, alike in every session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: an ISO-8601 time that says its offset.
OFFSET = r"^\d{4}-?\d\d-?\d\d[T ]\d\d(:?\d\d(:?\d\d([.,]\d+)?)?)?(Z|[+-]\d\d(:?\d\d(:?\d\d)?)?)$"


def utc(instant: Column) -> Column:
    """An instant as a timestamp without zone, in UTC."""
    seconds = F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(20,0)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def iso_millis(instant: Column) -> Column:
    """ISO-8601 in UTC with milliseconds and the offset written out."""
    return F.concat(F.date_format(utc(instant), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+00:00"))


def has_offset(c: Column) -> Column:
    """Whether a text is a time that exists and says its offset; null stays null."""
    day = F.regexp_replace(F.substring(c, 1, 10), r"^(\d{4})(\d\d)(\d\d).*$", "$1-$2-$3")
    clock = F.regexp_extract(c, r"[T ](\d\d):?(\d\d)?:?(\d\d)?", 0)
    fits = F.coalesce(F.try_to_date(day, "yyyy-MM-dd").isNotNull() & ~clock.rlike(r"^[T ](2[4-9]|[3-9])|^[T ]\d\d:?[6-9]|^[T ]\d\d:?\d\d:?[6-9]"), F.lit(False))
    return F.when(c.isNotNull(), c.rlike(OFFSET) & fits)
