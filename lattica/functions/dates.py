"""Calendars, Julian days, time strings and Easter, as expressions over whole numbers where possible."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Julian day of the Unix epoch.
UNIX_JD = 2440587.5


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("bigint")


def gregorian_to_jdn(y: Column, m: Column, d: Column) -> Column:
    """Number of the Julian day that begins at noon of a Gregorian date."""
    a = _div(14 - m, 12)
    yy, mm = y + 4800 - a, m + 12 * a - 3
    return d + _div(153 * mm + 2, 5) + 365 * yy + _div(yy, 4) - _div(yy, 100) + _div(yy, 400) - 32045


def julian_to_jdn(y: Column, m: Column, d: Column) -> Column:
    a = _div(14 - m, 12)
    yy, mm = y + 4800 - a, m + 12 * a - 3
    return d + _div(153 * mm + 2, 5) + 365 * yy + _div(yy, 4) - 32083


def common_to_jdn(y: Column, m: Column, d: Column) -> Column:
    """Julian calendar to 4 October 1582, Gregorian from then on."""
    late = (y * 10000 + m * 100 + d) >= 15821015
    return F.when(late, gregorian_to_jdn(y, m, d)).otherwise(julian_to_jdn(y, m, d))


def _from_shifted(c: Column, b: Column | None) -> Column:
    d = _div(4 * c + 3, 1461)
    e = c - _div(1461 * d, 4)
    m = _div(5 * e + 2, 153)
    century = 100 * b if b is not None else F.lit(0)
    return F.struct((century + d - 4800 + _div(m, 10)).alias("year"), (m + 3 - 12 * _div(m, 10)).alias("month"), (e - _div(153 * m + 2, 5) + 1).alias("day"))


def jdn_to_gregorian(j: Column) -> Column:
    """Struct (year, month, day)."""
    a = j + 32044
    b = _div(4 * a + 3, 146097)
    return _from_shifted(a - _div(146097 * b, 4), b)


def jdn_to_julian(j: Column) -> Column:
    return _from_shifted(j + 32082, None)


def islamic_to_jdn(y: Column, m: Column, d: Column) -> Column:
    """Tabular Islamic calendar (civil epoch)."""
    return d + F.ceil(29.5 * (m - 1)).cast("bigint") + (y - 1) * 354 + _div(3 + 11 * y, 30) + 1948439


def jdn_to_islamic(j: Column) -> Column:
    y = _div(30 * (j - 1948440) + 10646, 10631)
    m = F.least(F.lit(12), F.ceil((j - (29 + islamic_to_jdn(y, F.lit(1), F.lit(1)))) / 29.5).cast("bigint") + 1)
    return F.struct(y.alias("year"), m.alias("month"), (j - islamic_to_jdn(y, m, F.lit(1)) + 1).alias("day"))


def egyptian_to_jdn(y: Column, m: Column, d: Column) -> Column:
    """Years of 365 days from the era of Nabonassar (26 February 747 BC)."""
    return 1448638 + 365 * (y - 1) + 30 * (m - 1) + d - 1


def jdn_to_egyptian(j: Column) -> Column:
    k = j - 1448638
    r = F.pmod(k, F.lit(365))
    return F.struct((_div(k, 365) + 1).alias("year"), (_div(r, 30) + 1).alias("month"), (F.pmod(r, F.lit(30)) + 1).alias("day"))


def jdn_to_mayan(j: Column) -> Column:
    """Long count (baktun, katun, tun, uinal, kin) of a Julian day number."""
    k = j - 584283
    return F.struct(_div(k, 144000).alias("baktun"), F.pmod(_div(k, 7200), F.lit(20)).alias("katun"), F.pmod(_div(k, 360), F.lit(20)).alias("tun"), F.pmod(_div(k, 20), F.lit(18)).alias("uinal"), F.pmod(k, F.lit(20)).alias("kin"))


def mayan_to_jdn(baktun: Column, katun: Column, tun: Column, uinal: Column, kin: Column) -> Column:
    return 584283 + baktun * 144000 + katun * 7200 + tun * 360 + uinal * 20 + kin


def latin_date(y: int, m: int, d: int) -> str:
    """A date of the common calendar in the Roman way of counting to the next kalends, nones or ides.

    The day that a leap year puts into February is simply counted.
    """
    # Names of the months, and of the days that are counted to, as the day itself and as a goal.
    months = ("Ianuarias", "Februarias", "Martias", "Apriles", "Maias", "Iunias", "Iulias", "Augustas", "Septembres", "Octobres", "Novembres", "Decembres")
    goals = {"Kalendas": "Kalendis", "Nonas": "Nonis", "Idus": "Idibus"}
    nones, ides = (7, 15) if m in (3, 5, 7, 10) else (5, 13)
    leap = y % 4 == 0 and (y % 100 != 0 or y % 400 == 0 or y < 1583)
    length = 29 if m == 2 and leap else (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[m - 1]
    if d == 1:
        left, goal, month = 1, "Kalendas", m
    elif d <= nones:
        left, goal, month = nones - d + 1, "Nonas", m
    elif d <= ides:
        left, goal, month = ides - d + 1, "Idus", m
    else:
        left, goal, month = length - d + 2, "Kalendas", m % 12 + 1
    if left == 1:
        return f"{goals[goal]} {months[month - 1]}"
    return f"pridie {goal} {months[month - 1]}" if left == 2 else f"a.d. {_roman(left)} {goal} {months[month - 1]}"


def _roman(n: int) -> str:
    out = ""
    for v, r in ((10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        while n >= v:
            out, n = out + r, n - v
    return out


def hebrew_new_year(y: int) -> int:
    """Julian day number of 1 Tishri of a Hebrew year."""
    last, this, after = (_hebrew_delay(z) for z in (y - 1, y, y + 1))
    return 347998 + this + (2 if after - this == 356 else 1 if this - last == 382 else 0)


def _hebrew_delay(y: int) -> int:
    months = (235 * y - 234) // 19
    day = 29 * months + (12084 + 13753 * months) // 25920
    return day + 1 if 3 * (day + 1) % 7 < 3 else day


def hebrew_to_jdn(y: int, m: int, d: int) -> int:
    """Month 1 is Nisan, 7 is Tishri."""
    leap = (7 * y + 1) % 19 < 7
    length = hebrew_new_year(y + 1) - hebrew_new_year(y)

    def days(k):
        if k in (2, 4, 6, 10, 13) or k == 12 and not leap:
            return 29
        if k == 8:
            return 30 if length % 10 == 5 else 29
        if k == 9:
            return 29 if length % 10 == 3 else 30
        return 30

    last = 13 if leap else 12
    before = [*range(7, m)] if m >= 7 else [*range(7, last + 1), *range(1, m)]
    return hebrew_new_year(y) + sum(map(days, before)) + d - 1


def easter(y: Column) -> Column:
    """Struct (month, day) of Easter Sunday of a Gregorian year."""
    a, b, c = F.pmod(y, F.lit(19)), _div(y, 100), F.pmod(y, F.lit(100))
    h = F.pmod(19 * a + b - _div(b, 4) - _div(b - _div(b + 8, 25) + 1, 3) + 15, F.lit(30))
    l = F.pmod(32 + 2 * F.pmod(b, F.lit(4)) + 2 * _div(c, 4) - h - F.pmod(c, F.lit(4)), F.lit(7))
    m = _div(a + 11 * h + 22 * l, 451)
    s = h + l - 7 * m + 114
    return F.struct(_div(s, 31).alias("month"), (F.pmod(s, F.lit(31)) + 1).alias("day"))


def jd(ts: Column) -> Column:
    """Julian date of a timestamp (UTC)."""
    return F.unix_micros(ts.cast("timestamp")) / 86400e6 + UNIX_JD


def cjd(ts: Column) -> Column:
    """Chronological Julian date: whole at midnight."""
    return jd(ts) + 0.5


def timestamp_of_jd(j: Column) -> Column:
    return F.timestamp_micros(F.round((j - UNIX_JD) * 86400e6).cast("bigint"))


def ctime(ts: Column) -> Column:
    return F.date_format(ts, "EEE MMM dd HH:mm:ss yyyy")


def tai_from_date(ts: Column, epoch: str = "1977-01-01 00:00:00") -> Column:
    """Seconds of atomic time since an epoch, leap seconds since 1977 counted."""
    return (F.unix_micros(ts.cast("timestamp")) - F.unix_micros(F.lit(epoch).cast("timestamp"))) / 1e6 + leap_seconds(ts) - 15


def date_from_tai(seconds: Column, epoch: str = "1977-01-01 00:00:00") -> Column:
    """The timestamp of so many seconds of atomic time since an epoch."""
    plain = F.timestamp_micros((F.unix_micros(F.lit(epoch).cast("timestamp")) + seconds * 1e6).cast("bigint"))
    return F.timestamp_micros((F.unix_micros(plain) - (leap_seconds(plain) - 15) * 1_000_000).cast("bigint"))


# Days from which TAI - UTC is one second more, beginning with 10 s.
LEAP_DAYS = (
    "1972-01-01", "1972-07-01", "1973-01-01", "1974-01-01", "1975-01-01", "1976-01-01", "1977-01-01", "1978-01-01", "1979-01-01", "1980-01-01",
    "1981-07-01", "1982-07-01", "1983-07-01", "1985-07-01", "1988-01-01", "1990-01-01", "1991-01-01", "1992-07-01", "1993-07-01", "1994-07-01",
    "1996-01-01", "1997-07-01", "1999-01-01", "2006-01-01", "2009-01-01", "2012-07-01", "2015-07-01", "2017-01-01",
)


def leap_seconds(ts: Column) -> Column:
    """TAI - UTC in whole seconds, from 1972."""
    return F.lit(9) + sum(((ts >= F.lit(d).cast("timestamp")).cast("int") for d in LEAP_DAYS), F.lit(0))


def leap_seconds_at(mjd: float) -> float:
    day = dt.date(1858, 11, 17) + dt.timedelta(days=int(np.floor(mjd)))
    return 9 + sum(day >= dt.date.fromisoformat(d) for d in LEAP_DAYS)
