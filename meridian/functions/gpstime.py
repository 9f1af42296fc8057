"""GPS time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The GPS epoch in Unix seconds, seconds of a week, weeks and seconds of a rollover.
GPS_EPOCH, WEEK, ROLLOVER = 315964800, 604800, 1024
ROLLOVER_SECONDS = ROLLOVER * WEEK
#: Leap seconds above this from before this time tell of a missed rollover (2017-01-01).
WKRO_LEAP, WKRO_BEFORE = 17, 1483228800


def posix2gps(t: Column, leap: Column) -> tuple[Column, Column, Column]:
    """(GPS seconds, week, time of week) of Unix seconds."""
    gps = t - F.lit(GPS_EPOCH) + leap
    return gps, F.floor(gps / F.lit(WEEK)), gps % F.lit(WEEK)


def gps2utc(week: Column, tow: Column, leap: Column, rollovers: Column) -> Column:
    """Unix seconds; a ten-bit week gets the rollovers seen."""
    full = F.when(week < ROLLOVER, week + rollovers * ROLLOVER).otherwise(week)
    return full * F.lit(WEEK) + tow + F.lit(GPS_EPOCH) - leap


def fix_wkro(t: Column, leap: Column) -> Column:
    """Unix seconds, put right by a rollover where the leap seconds tell that one was missed."""
    return F.when((leap > WKRO_LEAP) & (t < WKRO_BEFORE), t + F.lit(ROLLOVER_SECONDS)).otherwise(t)


def isotime(seconds: Column) -> Column:
    """ISO-8601 text with milliseconds of Unix seconds."""
    return F.date_format(F.timestamp_millis(F.round(seconds * 1000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def from_isotime(text: Column) -> Column:
    """Unix seconds of ISO-8601 text."""
    return F.unix_micros(F.to_timestamp(text)) / F.lit(1e6)
