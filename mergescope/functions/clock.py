"""Time column expressions; the session time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_utc(x: Column) -> Column:
    """Timestamp of an ISO string; text that does not parse becomes NULL."""
    return F.try_to_timestamp(x.cast("string"))


def month_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def day_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def hours_between(start: Column, end: Column) -> Column:
    """Elapsed hours as a double."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros.cast("double") / F.lit(3.6e9)


def period_of(ts: Column, cutoff: str, until: str = "before", after: str = "after") -> Column:
    """Label rows up to and including the cutoff instant, and the rest."""
    return F.when(ts.isNotNull(), F.when(ts <= F.lit(cutoff).cast("timestamp"), until).otherwise(after))
