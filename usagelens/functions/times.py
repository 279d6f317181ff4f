"""Instants, local calendar columns and time differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ISO-8601 calendar date, optional time of day, optional offset.
_ISO = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?([Zz]|[+-]\d{2}(:?\d{2})?)?)?$"
)
# The usual case, date and whole time: Spark reads it as it is, but for the missing or small Z.
_WHOLE = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})?\z"
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def parse_ts(text: Column) -> Column:
    """Instant of an ISO-8601 text. Without an offset it is UTC; anything else is null."""
    t = F.trim(text)
    offset = F.substring(t, -6, 1).isin("+", "-")
    whole = F.when(offset, t).otherwise(F.concat(F.rtrim(t, F.lit("Zz")), F.lit("Z")))
    return F.when(t.rlike(_WHOLE), whole.try_cast("timestamp")).otherwise(_parse_any(t))


def _parse_any(t: Column) -> Column:
    full = F.regexp_replace(t, r"^(\d{4}-\d{2}-\d{2})$", "$1T00:00:00")
    full = F.regexp_replace(full, r"^(\S{10})[T ](\d{2})(?=[Zz+-]|$)", "$1T$2:00")
    full = F.regexp_replace(full, r"^(\S{10})[T ](\d{2}:\d{2})(?=[Zz+-]|$)", "$1T$2:00")
    full = F.regexp_replace(full, r"^(\S{19}),", "$1.")
    full = F.regexp_replace(full, r"^(.{19}.*[+-]\d{2})$", "$1:00")
    full = F.regexp_replace(full, r"^(.{19}.*[+-]\d{2})(\d{2})$", "$1:$2")
    full = F.regexp_replace(full, "[Zz]$", "")
    zoned = F.when(full.rlike(r"[+-]\d{2}:\d{2}$"), full).otherwise(F.concat(full, F.lit("Z")))
    return F.when(t.rlike(_ISO), zoned.try_cast("timestamp"))


def wall_clock(ts: Column, tz: str) -> Column:
    """Local wall clock of an instant, whatever zone the session uses."""
    return F.convert_timezone(F.current_timezone(), F.lit(tz), ts.cast("timestamp_ntz"))


def local_calendar(ts: Column, tz: str) -> dict[str, Column]:
    """Local time, date, hour and weekday (Monday = 0) of an instant."""
    local = wall_clock(ts, tz)
    return {
        "ts_local": local,
        "date_local": F.to_date(local).cast("string"),
        "hour_local": F.hour(local).cast("bigint"),
        "weekday_local": F.weekday(local).cast("bigint"),
    }


def rounded_ms(first: Column, last: Column) -> Column:
    """Whole milliseconds from one instant to another, ties to even, null if either is."""
    return F.rint((F.unix_micros(last) - F.unix_micros(first)) / F.lit(1000.0)).cast("bigint")


def log_lag_ms(received: Column, created: Column) -> Column:
    """How far the log line trails the request; a sentinel for upstream changes, not a latency."""
    return rounded_ms(created, received)


def duration_ms(first: Column, last: Column) -> Column:
    return rounded_ms(first, last)


def weekday_note(weekday: Column, n_users: Column) -> Column:
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    return F.concat(
        F.get(names, weekday.cast("int")),
        F.lit(" (weekday_local="),
        weekday.cast("string"),
        F.lit("), "),
        n_users.cast("string"),
        F.lit(" users"),
    )
