"""Dates as column expressions: time stamps without zone, seconds counted from 0001-01-01."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: seconds from 0001-01-01 to 1970-01-01 in the proleptic Gregorian calendar.
EPOCH_SECONDS = 62135596800


def seconds_since_year_one(ts: Column) -> Column:
    micros = F.unix_micros(ts.cast("timestamp"))
    return micros / 1e6 + EPOCH_SECONDS


def from_seconds(seconds: Column) -> Column:
    return F.timestamp_micros(((seconds - EPOCH_SECONDS) * 1e6).cast("long")).cast("timestamp_ntz")


def from_parts(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Missing month and day count as 1, missing parts of the day as 0."""
    one, zero = F.lit(1), F.lit(0)
    return F.make_timestamp_ntz(year, F.coalesce(month, one), F.coalesce(day, one), F.coalesce(hour, zero), F.coalesce(minute, zero), F.coalesce(second, F.lit(0.0)).cast("decimal(8,6)"))


def parse_iso(text: Column) -> Column:
    """Calendar (2020-03-01) or ordinal (2020-061) dates with time; a zone offset is applied."""
    ordinal = F.regexp_extract(text, r"^(\d{4})-(\d{3})(?!\d)", 2)
    day = F.date_format(F.date_add(F.to_date(F.concat(F.substring(text, 1, 4), F.lit("-01-01"))), F.try_to_number(F.when(ordinal != "", ordinal), F.lit("999")).cast("int") - 1), "yyyy-MM-dd")
    plain = F.when(ordinal != "", F.concat(day, F.substr(text, F.lit(9)))).otherwise(text)
    return F.try_to_timestamp(plain).cast("timestamp_ntz")


def iso(ts: Column, precision: int = 6) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss" + ("." + "S" * precision if precision else "")), F.lit("Z"))


def ordinal_day(ts: Column) -> Column:
    return F.dayofyear(ts)


def from_ordinal(year: Column, day: Column) -> Column:
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), day - 1)


def leap(year: Column) -> Column:
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))


#: Seconds in a unit of time.
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def shifted(ts: Column, amount: Column, unit: str = "s") -> Column:
    return F.timestamp_micros(F.unix_micros(ts.cast("timestamp")) + (amount * (UNITS[unit] * 1000000)).cast("long")).cast("timestamp_ntz")
