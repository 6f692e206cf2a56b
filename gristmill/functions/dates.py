"""Dates as they come in feeds and headers, to epoch milliseconds; calendar folders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.sources.crawl_tables import millis

#: Hours of the named zones of RFC 822 (fixed values).
ZONES = (("UT", 0), ("GMT", 0), ("Z", 0), ("EST", -5), ("EDT", -4), ("CST", -6), ("CDT", -5), ("MST", -7), ("MDT", -6), ("PST", -8), ("PDT", -7))


def _offset_ms(zone: Column) -> Column:
    """``Z``, ``+02:00``, ``-0530`` or a zone name as milliseconds; null for anything else."""
    names = F.create_map(*[F.lit(x) for name, hours in ZONES for x in (name, hours * 3_600_000)])
    sign = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    number = sign * (F.substring(digits, 1, 2).try_cast("int") * 3_600_000 + F.substring(digits, 3, 2).try_cast("int") * 60_000)
    return F.when(zone.rlike("^[+-][0-9]{2}:?[0-9]{2}$"), number).otherwise(F.try_element_at(names, F.upper(zone)))


def _local(text: Column, pattern: str) -> Column:
    return millis(F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz"))


def w3c(text: Column) -> Column:
    """``2024``, ``2024-02``, ``2024-02-03`` and instants with a zone; null for anything else."""
    t = F.trim(text)
    parts = r"^([0-9]{4})(?:-([0-9]{2})(?:-([0-9]{2})(?:[Tt ]([0-9]{2}:[0-9]{2})(?::([0-9]{2})(?:\.([0-9]{1,3})[0-9]*)?)?(Z|z|[+-][0-9]{2}:?[0-9]{2})?)?)?)?$"
    get = lambda n, default: F.when(F.regexp_extract(t, parts, n) == "", default).otherwise(F.regexp_extract(t, parts, n))
    day = F.try_to_date(F.concat_ws("-", get(1, "x"), get(2, "01"), get(3, "01")), "yyyy-MM-dd")
    clock = get(4, "00:00")
    in_day = F.substring(clock, 1, 2).try_cast("int") * 3_600_000 + F.substring(clock, 4, 2).try_cast("int") * 60_000 + get(5, "0").try_cast("int") * 1000 + F.rpad(get(6, "0"), 3, "0").try_cast("int")
    days = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long")
    return F.when(t.rlike(parts), days * 86_400_000 + in_day - _offset_ms(F.upper(get(7, "Z"))))


def rfc822(text: Column) -> Column:
    """``Tue, 06 Feb 2024 10:11:12 +0100``; the weekday is not looked at, a year of two digits is from 1950 to 2049."""
    parts = r"^(?:[A-Za-z]{3,9},?\s+)?([0-9]{1,2})\s+([A-Za-z]{3})[a-z]*\s+([0-9]{2}|[0-9]{4})\s+([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?\s*([A-Za-z]{1,3}|[+-][0-9]{4})?$"
    t = F.trim(text)
    get = lambda n: F.regexp_extract(t, parts, n)
    month = (F.instr(F.lit("JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"), F.upper(get(2))) + 2) / 3
    short = get(3).try_cast("int")
    year = F.when(F.length(get(3)) == 2, short + F.when(short < 50, 2000).otherwise(1900)).otherwise(short)
    day = F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("int").cast("string"), 2, "0"), F.lpad(get(1), 2, "0")), "yyyy-MM-dd")
    in_day = get(4).try_cast("int") * 3_600_000 + get(5).try_cast("int") * 60_000 + F.coalesce(get(6).try_cast("int"), F.lit(0)) * 1000
    zone = F.when(get(7) == "", "Z").otherwise(get(7))
    return F.when(t.rlike(parts), F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000 + in_day - _offset_ms(zone))


def any_date(text: Column) -> Column:
    return F.coalesce(w3c(text), rfc822(text))


def iso_week(day: Column) -> Column:
    """``2024-W05``."""
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), day).cast("int"), F.weekofyear(day))
