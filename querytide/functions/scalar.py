"""Scalar expressions as plain functions from columns to columns."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from querytide.params import BLOCKED_REASONS


def utc_time(text: Column) -> Column:
    """ISO text with `Z` or an offset -> zone-less UTC; NULL when it cannot be read."""
    return text.try_cast("timestamp").cast("timestamp_ntz")


def as_utc(moment: datetime) -> datetime:
    """A Python time as zone-less UTC; a time without a zone is taken to be UTC already."""
    return moment if moment.tzinfo is None else moment.astimezone(UTC).replace(tzinfo=None)


def utc_literal(moment: datetime) -> Column:
    """A Python time as a column. It goes over as text, because a plain literal would be read
    in the time zone of the driver's machine."""
    return F.lit(as_utc(moment).isoformat(sep=" ")).cast("timestamp_ntz")


def is_blocked(reason: Column, codes: Iterable[str] = BLOCKED_REASONS) -> Column:
    return F.coalesce(reason, F.lit("")).isin(*codes)


def or_empty(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def normalised_domain(domain: Column) -> Column:
    """Optional clean-up; by default domains are kept as logged."""
    return F.rtrim(F.lower(F.trim(domain)), F.lit("."))


def arrival_key(time: Column, seq: Column) -> Column:
    """One number ordering rows from oldest to newest; seq 0 is the newest of equal times.

    A struct would order the same way, but its maximum needs a sort-based aggregate; a
    decimal stays in the hash aggregate.
    """
    micros = F.unix_micros(time.cast("timestamp")).cast("decimal(19,0)")
    return micros * F.lit("10000000000000000000").cast("decimal(20,0)") - seq.cast("decimal(19,0)")


def clock_time(hhmm: str) -> tuple[int, int]:
    hour, minute = hhmm.split(":")
    return int(hour), int(minute)


def local_instant(day: Column, hhmm: str, timezone: str) -> Column:
    """Wall-clock HH:MM of a local date -> zone-less UTC instant.

    Like all zone conversions here it needs a session zone of UTC (`session.pin_utc`); the
    functions used look the zone up once per query and not once per row.
    """
    hour, minute = clock_time(hhmm)
    seconds = F.unix_date(day).cast("bigint") * 86400 + (hour * 3600 + minute * 60)
    return F.to_utc_timestamp(F.timestamp_seconds(seconds), timezone).cast("timestamp_ntz")


def local_time(time: Column, timezone: str) -> Column:
    return F.from_utc_timestamp(time.cast("timestamp"), timezone)


def local_date(time: Column, timezone: str) -> Column:
    return local_time(time, timezone).cast("date")


def local_hhmm(time: Column, timezone: str) -> Column:
    return F.date_format(local_time(time, timezone), "HH:mm")


def in_off_hours(
    time: Column, day: Column, start: str, end: str, timezone: str, wrap: bool = False
) -> Column:
    """Half-open local time range on the report date.

    A start after the end selects nothing unless `wrap` moves the start to the day before.
    """
    start_day = F.date_sub(day, 1) if wrap and clock_time(start) > clock_time(end) else day
    return (time >= local_instant(start_day, start, timezone)) & (
        time < local_instant(day, end, timezone)
    )


def z_score(value: Column, mean: Column, stddev: Column) -> Column:
    """Distance from the mean in deviations; relative change when there is no deviation."""
    return (
        F.when(stddev > 0, (value - mean) / stddev)
        .when(mean > 0, (value - mean) / mean)
        .otherwise(F.lit(0.0))
    )


def is_anomalous(
    value: Column, mean: Column, stddev: Column, z_limit: float, ratio_limit: float
) -> Column:
    return (F.abs(z_score(value, mean, stddev)) >= z_limit) | (value >= mean * ratio_limit)


def os_label(name: Column, flavor: Column) -> Column:
    text = F.trim(F.concat_ws(" ", name, flavor))
    return F.when(text == "", F.lit("unknown")).otherwise(text)


def iso_date(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def storage_key(day: Column) -> Column:
    return F.date_format(day, "yyyy/MM/dd")


def long_date(day: Column) -> Column:
    return F.date_format(day, "EEEE, MMMM d, yyyy")


def blocked_percent(blocked: Column, total: Column) -> Column:
    """Share of blocked queries as text with one decimal; safe for empty days."""
    share = F.when(total > 0, F.coalesce(blocked, F.lit(0)) / total * 100).otherwise(F.lit(0.0))
    return F.concat(F.format_number(share, 1), F.lit("%"))
