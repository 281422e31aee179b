"""Calendar expressions on ISO texts.  None of them depends on the session time zone."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000

ISO_DAY = r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$"


def lenient_day(text: Column) -> Column:
    """Date of a ``YYYY-MM-DD`` text; days up to 31 pass in any month and run into the next.

    ``2025-02-30`` is 2 March 2025.  Anything else is NULL.
    """
    month_start = F.concat(F.substring(text, 1, 8), F.lit("01")).try_cast("date")
    day = F.substring(text, 9, 2).try_cast("int")
    return F.when(text.rlike(ISO_DAY), F.date_add(month_start, day - 1))


def iso_from_parts(text: Column, month_at: int, day_at: int, year_at: int) -> Column:
    """Re-cut a delimited date text to ``YYYY-MM-DD`` by position, without validation."""
    return F.concat(
        F.substring(text, year_at, 4), F.lit("-"),
        F.substring(text, month_at, 2), F.lit("-"),
        F.substring(text, day_at, 2))


def instant_micros(as_of: datetime | None) -> Column:
    """Microseconds since the epoch of ``as_of`` (naive = UTC); None = time of the query."""
    if as_of is None:
        return F.unix_micros(F.current_timestamp())
    moment = as_of if as_of.tzinfo else as_of.replace(tzinfo=timezone.utc)
    since = moment - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return F.lit((since.days * 86_400 + since.seconds) * 1_000_000 + since.microseconds)


def micros_until(day: Column, as_of: datetime | None) -> Column:
    """Signed microseconds from ``as_of`` to the midnight (UTC) that starts ``day``."""
    return F.unix_date(day).cast("bigint") * MICROS_PER_DAY - instant_micros(as_of)


def whole_days(micros: Column) -> Column:
    """Days in a span, cut towards zero."""
    return (micros / F.lit(float(MICROS_PER_DAY))).cast("int")
