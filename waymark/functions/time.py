"""Times: instants are timestamp_ntz in UTC, zones IANA names or labels such as UTC+09:00."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that Spark takes for a zone; those left out stand for no zone.
ZONES = sorted(available_timezones() - {"Factory", "localtime", "ROC"})
_OFFSET = r"^UTC[+-](0\d|1[0-4]):[0-5]\d$"


def known_zone(zone: Column) -> Column:
    """The zone, or UTC where its name isn't one (Spark would fail on it)."""
    return F.when(zone.isin(ZONES) | zone.rlike(_OFFSET), zone).otherwise(F.lit("UTC"))


def to_local(ts: Column, zone: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), known_zone(zone), ts.cast("timestamp_ntz"))


def local_date(ts: Column, zone: Column) -> Column:
    return F.to_date(to_local(ts, zone))


def local_hour(ts: Column, zone: Column) -> Column:
    return F.hour(to_local(ts, zone))


def local_weekday(ts: Column, zone: Column) -> Column:
    """0 on Monday to 6 on Sunday."""
    return F.weekday(to_local(ts, zone))


def local_midnight_utc(day: Column, zone: Column) -> Column:
    """The instant at which the local day begins."""
    return F.convert_timezone(known_zone(zone), F.lit("UTC"), day.cast("timestamp_ntz"))


def epoch(ts: Column) -> Column:
    """Whole seconds of an instant in UTC."""
    return F.unix_timestamp(ts.cast("timestamp_ntz").cast("timestamp"))


def truncate_time(ts: Column, minutes: int = 15) -> Column:
    step = minutes * 60
    return F.timestamp_seconds(F.floor(epoch(ts) / step) * step).cast("timestamp_ntz")


def offset_label(seconds: Column) -> Column:
    """UTC+09:00 for 32400, UTC for 0."""
    a = F.abs(seconds)
    return F.when(seconds == 0, F.lit("UTC")).otherwise(F.format_string("UTC%s%02d:%02d", F.when(seconds < 0, "-").otherwise("+"), F.floor(a / 3600).cast("int"), (F.floor(a / 60) % 60).cast("int")))


def overlaps(start: Column, end: Column, from_, to) -> Column:
    return (end >= from_) & (start <= to)


def garmin_time(seconds: Column) -> Column:
    """Seconds since 1989-12-31 as an instant."""
    return F.timestamp_seconds(seconds + 631065600).cast("timestamp_ntz")
