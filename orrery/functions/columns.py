"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def norm_symbol(c: Column) -> Column:
    """Symbols compare after trimming spaces and upper-casing; a blank one is null."""
    s = F.upper(F.trim(c))
    return F.when(s != "", s)


def micros(c: Column) -> Column:
    """Microseconds since the epoch of a timestamp, whatever the session's time zone."""
    return F.unix_micros(c)


def date_micros(c: Column) -> Column:
    """Microseconds since the epoch of 00:00 UTC of a date."""
    return F.unix_date(c).cast("long") * F.lit(DAY_MICROS)


def micros_day(c: Column) -> Column:
    """Days since the epoch of a count of microseconds, rounded down before 1970 too."""
    return F.floor(c / F.lit(DAY_MICROS)).cast("int")
