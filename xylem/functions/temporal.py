"""Dates, times and durations as columns.

A date, dateTime or time is its checked lexical form (so a missing offset stays missing); a duration is a number of seconds
or of months. Times lie on 1972-12-31; values without an offset have the implicit one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from xylem.functions import scalars as S

_DATE, _TIME, _ZONE = r"^(-?\d{4,})-(\d\d)-(\d\d)", r"(?:^|T)(\d\d):(\d\d):(\d\d(?:\.\d+)?)", r"(Z|[+-]\d\d:\d\d)$"
DURATION = r"^(-?)P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"


def checked(text: Column, kind: str) -> Column:
    """The text, or an error where it hasn't the type's form."""
    return S.let(text, lambda t: F.when(S.castable(t, f"xs:{kind}"), t).otherwise(F.raise_error(F.concat(F.lit("not a valid "), F.lit(f"xs:{kind}: "), t)).cast("string")))


def part(text: Column, kind: str, name: str) -> Column:
    """year, month, day, hours, minutes or seconds, as a number."""
    if name in ("year", "month", "day"):
        if kind == "time":
            return F.lit({"year": 1972.0, "month": 12.0, "day": 31.0}[name])
        return F.regexp_extract(text, _DATE, ("year", "month", "day").index(name) + 1).try_cast("double")
    if kind == "date":
        return F.lit(0.0)
    return F.regexp_extract(text, _TIME, ("hours", "minutes", "seconds").index(name) + 1).try_cast("double")


def zone(text: Column) -> Column:
    """Its lexical offset, or ''."""
    return F.regexp_extract(F.regexp_replace(text, r"^-?\d{4,}-\d\d-\d\d", ""), _ZONE, 1)


def offset(text: Column) -> Column:
    """Minutes east of UTC; null without an offset."""

    def read(z: Column) -> Column:
        minutes = F.substring(z, 2, 2).try_cast("int") * 60 + F.substring(z, 5, 2).try_cast("int")
        return F.when(z == "", F.lit(None).cast("int")).when(z == "Z", 0).when(z.startswith("-"), -minutes).otherwise(minutes)

    return S.let(zone(text), read)


def days(y: Column, m: Column, d: Column) -> Column:
    """Days from 1970-01-01 in the proleptic Gregorian calendar."""
    months = S.let(m, lambda m: F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5))

    def count(y: Column) -> Column:
        of_era = y % 400 + F.when(y % 400 < 0, 400).otherwise(0)
        return F.floor(y / 400) * 146097 + of_era * 365 + F.floor(of_era / 4) - F.floor(of_era / 100) + months + d - 1 - 719468

    return S.let(y - F.when(m <= 2, 1).otherwise(0), count)


def civil(z: Column) -> Column:
    """A struct of year, month and day."""
    let = S.let

    def of_era(era_doe: Column) -> Column:
        era, doe = era_doe["era"], era_doe["doe"]
        yoe = F.floor((doe - F.floor(doe / 1460) + F.floor(doe / 36524) - F.floor(doe / 146096)) / 365)
        return let(yoe, lambda yoe: let(doe - (365 * yoe + F.floor(yoe / 4) - F.floor(yoe / 100)), lambda doy: let(F.floor((5 * doy + 2) / 153), lambda mp: date(era, yoe, doy, mp))))

    def date(era: Column, yoe: Column, doy: Column, mp: Column) -> Column:
        year = yoe + era * 400 + F.when(mp >= 10, 1).otherwise(0)
        return F.struct(year.alias("y"), (mp + F.when(mp < 10, 3).otherwise(-9)).alias("m"), (doy - F.floor((153 * mp + 2) / 5) + 1).alias("d"))

    return let(z + 719468, lambda z: let(F.floor(z / 146097), lambda era: let(F.struct(era.alias("era"), (z - era * 146097).alias("doe")), of_era)))


def local_seconds(text: Column, kind: str) -> Column:

    def read(t: Column) -> Column:
        p = lambda n: part(t, kind, n)
        return days(p("year"), p("month"), p("day")) * 86400 + p("hours") * 3600 + p("minutes") * 60 + p("seconds")

    return S.let(text, read)


def seconds(text: Column, kind: str, implicit: int = 0) -> Column:
    """The instant, in seconds from 1970-01-01T00:00:00Z."""
    return S.let(text, lambda t: local_seconds(t, kind) - F.coalesce(offset(t), F.lit(implicit)) * 60)


def _two(x: Column) -> Column:
    return F.lpad(x.cast("long").cast("string"), 2, "0")


def write(secs: Column, kind: str, tail: Column) -> Column:
    """Lexical form of local seconds with an offset's text."""

    def clock(rest: Column) -> Column:
        s = rest % 60
        return F.concat(_two(F.floor(rest / 3600)), F.lit(":"), _two(F.floor(rest % 3600 / 60)), F.lit(":"), F.when(s < 10, "0").otherwise(""), S.format_number(F.round(s, 6)))

    def calendar(c: Column) -> Column:
        year = F.abs(c["y"]).cast("long").cast("string")
        return F.concat(F.when(c["y"] < 0, "-").otherwise(""), F.lpad(year, F.greatest(F.lit(4), F.length(year)), F.lit("0")), F.lit("-"), _two(c["m"]), F.lit("-"), _two(c["d"]))

    def both(s: Column) -> Column:
        day, time = S.let(civil(F.floor(s / 86400)), calendar), S.let(s - F.floor(s / 86400) * 86400, clock)
        return F.concat(*{"date": [day], "time": [time], "dateTime": [day, F.lit("T"), time]}[kind], tail)

    return S.let(secs, both)


def add_seconds(text: Column, kind: str, amount: Column) -> Column:
    return S.let(text, lambda t: write(local_seconds(t, kind) + amount, kind, zone(t)))


def add_months(text: Column, kind: str, months: Column) -> Column:
    """The day is cut to the month's last."""

    def moved(t: Column) -> Column:
        p = lambda n: part(t, kind, n)

        def at(ym: Column) -> Column:
            y, m = ym["y"], ym["m"]
            leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
            last = F.when(m.isin(4.0, 6.0, 9.0, 11.0), 30).when(m != 2, 31).when(leap, 29).otherwise(28)
            return days(y, m, F.least(p("day"), last)) * 86400 + p("hours") * 3600 + p("minutes") * 60 + p("seconds")

        total = lambda n: F.struct(F.floor(n / 12).alias("y"), (n - F.floor(n / 12) * 12 + 1).alias("m"))
        return write(S.let(S.let(p("year") * 12 + p("month") - 1 + months, total), at), kind, zone(t))

    return S.let(text, moved)


def duration(text: Column, kind: str) -> Column:
    """Seconds of a dayTimeDuration, months of a yearMonthDuration; an error for another form."""

    def read(t: Column) -> Column:
        n = lambda i: F.coalesce(F.regexp_extract(t, DURATION, i).try_cast("double"), F.lit(0.0))
        size = n(4) * 86400 + n(5) * 3600 + n(6) * 60 + n(7) if kind == "dayTimeDuration" else n(2) * 12 + n(3)
        value = size * F.when(t.startswith("-"), -1.0).otherwise(1.0)
        return F.when(S.castable(t, f"xs:{kind}"), value).otherwise(F.raise_error(F.concat(F.lit(f"not a valid xs:{kind}: "), t)).cast("double"))

    return S.let(text, read)


def duration_part(x: Column, name: str) -> Column:
    """years and months of months; days, hours, minutes and seconds of seconds; signed."""
    a = F.abs(x)
    size = {"years": F.floor(a / 12), "months": a % 12, "days": F.floor(a / 86400), "hours": F.floor(a % 86400 / 3600), "minutes": F.floor(a % 3600 / 60), "seconds": a % 60}[name].cast("double")
    return F.when(x < 0, -size).otherwise(size)


def write_duration(x: Column, kind: str) -> Column:
    return S.let(x, lambda y: _span(y, kind))


def _span(x: Column, kind: str) -> Column:
    sign, n = F.when(x < 0, "-P").otherwise("P"), lambda k: F.abs(duration_part(x, k))
    unit = lambda k, u: F.when(n(k) != 0, F.concat(S.format_number(n(k)), F.lit(u))).otherwise("")
    if kind == "yearMonthDuration":
        return F.when(x == 0, "P0M").otherwise(F.concat(sign, unit("years", "Y"), unit("months", "M")))
    time = F.concat(unit("hours", "H"), unit("minutes", "M"), unit("seconds", "S"))
    return F.when(x == 0, "PT0S").otherwise(F.concat(sign, unit("days", "D"), S.let(time, lambda t: F.when(t != "", F.concat(F.lit("T"), t)).otherwise(""))))
