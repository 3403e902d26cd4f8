"""Dates: seconds since an epoch, decimal years, YYYYMMDD integers, seasons; all are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_to_timestamp(seconds: Column, year: int = 1985) -> Column:
    """Over the whole range of timestamps: whole days go apart, since an interval takes at most 10**12 seconds as such."""
    s = seconds.cast("decimal(20,6)")
    days = F.floor(s / 86400).cast("long")
    return F.lit(f"{year}-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=days.cast("int"), secs=s - days * 86400)


def to_text(ts: Column) -> Column:
    """YYYY-MM-DD hh:mm:ss.mmm; years of more than four digits have no sign, unlike in Spark's patterns, nor have those before the year 0 an era."""
    y = F.year(ts)
    return F.concat(F.when(y.between(0, 9999), F.lpad(y.cast("string"), 4, "0")).otherwise(y.cast("string")), F.date_format(ts, "-MM-dd HH:mm:ss.SSS"))


def timestamp_to_seconds(ts: Column, year: int = 1985) -> Column:
    """Whole seconds since the start of a year."""
    return F.timestamp_diff("SECOND", F.lit(f"{year}-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def number_to_date(n: Column) -> Column:
    return F.make_date(F.floor(n / 10000).cast("int"), (F.floor(n / 100) % 100).cast("int"), (n % 100).cast("int"))


def date_to_number(d: Column) -> Column:
    return F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)


def number_to_year(n: Column) -> Column:
    """YYYYMMDD to a decimal year: months are twelfths, days are parts of 365.25."""
    y, m, d = F.floor(n / 10000), F.floor(n / 100) % 100, n % 100
    return y + (m - 1) / 12 + d / 365.25


def year_to_month(t: Column) -> tuple[Column, Column]:
    """(year, month) of a decimal year; the first instant of a year is January."""
    y = F.floor(t)
    return y, F.greatest(F.ceil((t - y) * 12), F.lit(1))


def year_to_number(t: Column) -> Column:
    """The 15th of the decimal year's month, as YYYYMMDD."""
    y, m = year_to_month(t)
    return y * 10000 + m * 100 + 15


def month_to_year(y: Column, m: Column) -> Column:
    """The middle of a month as a decimal year."""
    return y + (m - 0.5) / 12


def month_to_year_day(y: Column, m: Column) -> Column:
    """The middle of a month by days: 15.22 of 365.25."""
    return y + (m - 1) / 12 + 15.22 / 365.25


def with_day(n: Column, day: int) -> Column:
    return F.floor(n / 100).cast("long") * 100 + day


def season(d: Column) -> tuple[Column, Column]:
    """(year, first month) of the season MAM, JJA, SON or DJF; a December belongs to the season of the year after."""
    m = F.month(d)
    first = F.when(m.isin(12, 1, 2), 12).otherwise(F.floor(m / 3) * 3).cast("int")
    return F.year(d) + F.when(m == 12, 1).otherwise(0), first


def modified_julian_day(d: Column) -> Column:
    return F.datediff(d, F.lit("1858-11-17").cast("date"))


def record_seconds(mjd: Column, *seconds: Column) -> Column:
    """Seconds since 1985 from a modified Julian day and seconds of the day, as altimeter records hold them."""
    total = sum(seconds[1:], seconds[0])
    return (mjd - 46066) * 86400 + total


def serial_to_seconds(days: Column, year_start: float = 730486.0) -> Column:
    """Serial days (day 1 is 0000-01-01) to seconds since 2000-01-01."""
    return (days - year_start) * 86400


def century(yy: Column) -> Column:
    """Two-digit years of record headers: all are of the 1900s."""
    return F.when(yy <= 99, yy + 1900).otherwise(yy)


def mean_longitudes(days: Column) -> dict[str, Column]:
    """Mean longitudes of moon s, sun h, lunar perigee p and node n in degrees, for days since 2000-01-01 12:00 (published linear rates)."""
    # Degrees at the epoch and degrees a day.
    rates = {"s": (218.3164477, 13.17639648), "h": (280.4662556, 0.98564736), "p": (83.3532465, 0.11140353), "n": (125.0445479, -0.05295377)}
    return {k: F.pmod(F.lit(a) + F.lit(b) * days, F.lit(360.0)) for k, (a, b) in rates.items()}


def parts(ts: Column) -> dict[str, Column]:
    """Year to second of a time, and its serial day number (day 1 is the first of year 0)."""
    whole = {k: f(ts) for k, f in (("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("hour", F.hour), ("minute", F.minute), ("second", F.second))}
    of_day = whole["hour"] * 3600 + whole["minute"] * 60 + whole["second"]
    return whole | {"serial": F.datediff(ts.cast("date"), F.lit("0001-01-01").cast("date")) + 1 + 366 + of_day / 86400.0}


def month_to_date(y: Column, m: Column, day: int = 15) -> Column:
    return F.make_date(y.cast("int"), m.cast("int"), F.lit(day))


def year_to_date(t: Column, day: int = 15) -> Column:
    """The middle of the decimal year's month."""
    return month_to_date(*year_to_month(t), day)


def season_month(d: Column, k: int) -> Column:
    """YYYYMM of the first, second or third month (k = 1, 2, 3) of a day's season; January and February belong to the season that began in the December before."""
    m = F.month(d)
    first = F.add_months(F.trunc(d, "month"), -(m % 3))
    at = F.add_months(first, k - 1)
    return F.year(at) * 100 + F.month(at)


def from_modified_julian_day(mjd: Column) -> Column:
    return F.date_add(F.lit("1858-11-17").cast("date"), mjd.cast("int"))


def sexagesimal(x: Column) -> tuple[Column, Column, Column]:
    """(degrees with the sign, minutes, seconds) of decimal degrees."""
    whole = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    minutes = F.abs(x - whole) * 60
    return whole, F.floor(minutes), (minutes - F.floor(minutes)) * 60
