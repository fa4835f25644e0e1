"""Times as text: RFC 3339, file names, ages and cut-offs, as column functions that no session's time zone changes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_DATE_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})\z"
_FILE_TIME = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}T)([0-9]{2})-([0-9]{2})-([0-9]{2})"


def parse_rfc3339(text: Column) -> Column:
    """The instant that a text names; null where it names none. A zone is demanded, up to 18 hours away; fractions beyond
    microseconds are cut off, and leap seconds are null."""
    return F.when(text.rlike(_DATE_TIME), F.try_to_timestamp(F.upper(text)))


def format_rfc3339(at: Column) -> Column:
    """An instant in UTC with milliseconds, what is below them cut off."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def age_micros(at: Column, now: Column) -> Column:
    return F.unix_micros(now) - F.unix_micros(at)


def is_stale(updated: Column, now: Column, timeout_seconds: Column | int) -> Column:
    """Whether the last update is as old as the timeout allows or older; updates ahead of now are not stale, nor are missing ones."""
    age = age_micros(updated, now)
    timeout = (F.lit(timeout_seconds) if isinstance(timeout_seconds, int) else timeout_seconds).cast("long") * 1_000_000
    return F.coalesce((age >= 0) & (age >= timeout), F.lit(False))


def file_time(name: Column) -> Column:
    """The instant (UTC) that begins a file's name, as 2024-01-31T23-59-58; null where none does."""
    return parse_rfc3339(F.when(name.rlike(_FILE_TIME), F.regexp_replace(F.substr(name, F.lit(1), F.lit(19)), _FILE_TIME, "$1$2:$3:$4Z")))


def is_expired(name: Column, now: Column, days: int, suffix: str = ".md") -> Column:
    """Whether a file, by the time in its name, is as old as the cut-off or older; names without a time or suffix stay."""
    return F.coalesce(name.endswith(suffix) & (age_micros(file_time(name), now) >= days * 86_400_000_000), F.lit(False))
