"""Three timestamp encodings, each to (instant, wall clock). Session time zone UTC is assumed for instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def offset_minutes(x: Column) -> Column:
    """Minutes east of UTC for ``±HHMM`` or ``±HH:MM``, ``Z`` as 0; null if malformed."""
    t = F.replace(F.trim(x), F.lit(":"), F.lit(""))
    sign = F.when(F.substring(t, 1, 1) == "-", -1).otherwise(1)
    minutes = sign * (F.substring(t, 2, 2).try_cast("int") * 60 + F.substring(t, 4, 2).try_cast("int"))
    return F.when(t == "Z", 0).when(t.rlike(r"^[+-]\d{4}$"), minutes)


def to_utc(local: Column, minutes: Column) -> Column:
    """The instant of a wall clock at an offset."""
    return (local - F.make_dt_interval(mins=minutes)).cast("timestamp")


def _parsed(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")


def spaced(x: Column) -> tuple[Column, Column]:
    """``2017-01-27 16:09:39 -0400``. With a bad offset the wall clock stays and the instant is null."""
    local = _parsed(F.substring(x, 1, 19), "yyyy-MM-dd HH:mm:ss")
    return to_utc(local, offset_minutes(F.substring(x, 20, 10))), local


def split_12h(date: Column, time: Column, half: Column, offset: Column) -> tuple[Column, Column]:
    """Date, 12-hour time, AM/PM and offset in columns of their own."""
    text = F.concat_ws(" ", F.trim(date), F.trim(time), F.upper(F.trim(half)))
    local = _parsed(text, "yyyy-MM-dd h:mm:ss a")
    return to_utc(local, offset_minutes(offset)), local


def iso(x: Column) -> tuple[Column, Column]:
    """``2021-05-01T09:30:00+03:00`` or with ``Z``; fractions of a second are dropped."""
    local = _parsed(F.substring(x, 1, 19), "yyyy-MM-dd'T'HH:mm:ss")
    return to_utc(local, offset_minutes(F.regexp_replace(F.substring(x, 20, 30), r"^\.\d+", ""))), local


def plus_seconds(x: Column, seconds: Column) -> Column:
    """A wall clock moved by seconds (fractions allowed)."""
    return x + F.make_dt_interval(secs=seconds)
