"""Dates and ages. Every 'now' is an explicit ``as_of``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names of feed dates.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun",
          "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def moment(as_of: datetime | str | Column) -> Column:
    """``as_of`` as a TIMESTAMP_NTZ column."""
    if isinstance(as_of, Column):
        return as_of
    text = as_of.replace(tzinfo=None).isoformat() if isinstance(as_of, datetime) else as_of
    return F.lit(text).cast("timestamp_ntz")


def parse_iso(ts: Column | str) -> Column:
    """Wall clock of an ISO string, any offset discarded; null if invalid."""
    t = _col(ts)
    return F.when(F.rlike(t, F.lit(r"^\d{4}-\d{2}-\d{2}")), t.try_cast("timestamp_ntz"))


def age_micros(ts: Column | str, as_of: datetime | str | Column) -> Column:
    return F.timestamp_diff("MICROSECOND", parse_iso(ts), moment(as_of))


def is_stale(ts: Column | str, as_of, warn_seconds: int) -> Column:
    """Older than the warning age; never for an unstamped row."""
    return F.coalesce(age_micros(ts, as_of) > warn_seconds * 1_000_000, F.lit(False))


def epoch(ts: Column | str) -> Column:
    """Whole seconds since 1970, 0 for empty or invalid text."""
    start = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.coalesce(F.timestamp_diff("SECOND", start, parse_iso(ts)), F.lit(0))


def is_recent(ts: Column | str, as_of) -> Column:
    """Under seven whole days old."""
    days = F.floor(age_micros(ts, as_of) / F.lit(86_400_000_000))
    return F.coalesce(days < 7, F.lit(False))


def time_ago(ts: Column | str, as_of) -> Column:
    """Age in words; text that is no date is returned as it is."""
    t = _col(ts)
    seconds = F.timestamp_diff("SECOND", parse_iso(t), moment(as_of))

    def words(count: Column, unit: str) -> Column:
        n = F.floor(count).cast("string")
        return F.concat(n, F.lit(f" {unit}"), F.when(n == "1", "").otherwise("s"), F.lit(" ago"))

    days = F.floor(seconds / 86_400)
    shown = (
        F.when(seconds < 3_600, words(F.greatest(F.floor(seconds / 60), F.lit(1)), "min"))
        .when(seconds < 86_400, words(seconds / 3_600, "hour"))
        .when(days < 7, words(days, "day"))
        .when(days < 30, words(days / 7, "week"))
        .when(days < 365, words(days / 30, "month"))
        .otherwise(words(days / 365, "year"))
    )
    return (
        F.when(F.coalesce(t, F.lit("")) == "", F.lit(""))
        .when(seconds.isNull(), t)
        .otherwise(shown)
    )


def date_prefix(ts: Column | str) -> Column:
    """First ten characters, null for missing or empty text."""
    return F.nullif(F.substring(_col(ts), 1, 10), F.lit(""))


def epoch_millis_date(millis: Column | str) -> Column:
    """UTC date of epoch milliseconds; null for null or zero."""
    days = F.floor(F.nullif(_col(millis).cast("double"), F.lit(0.0)) / 86_400_000)
    return F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")).cast("string")


def utc_date(ts: Column | str) -> Column:
    """UTC date of an ISO string, its offset applied; null if invalid."""
    t = _col(ts)
    pattern = r"[T ]\d{2}.*([+-])(\d{2}):?(\d{2})$"
    sign = F.when(F.regexp_extract(t, pattern, 1) == "-", -1).otherwise(1)
    hours = F.coalesce(F.regexp_extract(t, pattern, 2).try_cast("int"), F.lit(0))
    minutes = F.coalesce(F.regexp_extract(t, pattern, 3).try_cast("int"), F.lit(0))
    offset = F.make_dt_interval(F.lit(0), hours * sign, minutes * sign)
    return F.substring((parse_iso(t) - offset).cast("string"), 1, 10)


def feed_date(ts: Column | str) -> Column:
    """Date parts of an RFC-2822 stamp, without zone conversion."""
    parts = F.split(F.btrim(F.regexp_replace(_col(ts), r"\s+", " ")), " ")
    number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.get(parts, F.lit(2)))
    day = F.get(parts, F.lit(1))
    padded = F.when(F.length(day) < 2, F.lpad(day, 2, "0")).otherwise(day)
    date = F.concat_ws("-", F.get(parts, F.lit(3)), F.lpad(number.cast("string"), 2, "0"), padded)
    return F.when((F.size(parts) >= 4) & (number > 0), date)
