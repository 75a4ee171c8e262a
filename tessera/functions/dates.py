"""Partial dates: a year, with a month, with a day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(x: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD to (year, month, day), the rest null; null for any other text and for days that don't exist."""
    part = lambda k: F.nullif(F.regexp_extract(x, r"^([0-9]{4})(?:-([0-9]{2})(?:-([0-9]{2}))?)?$", k), F.lit("")).cast("int")
    y, m, d = part(1), part(2), part(3)
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    good = (y > 0) & F.coalesce(m.between(1, 12), F.lit(True)) & F.coalesce((d >= 1) & (d <= last), F.lit(True))
    return F.when(good, F.struct(y.alias("year"), m.alias("month"), d.alias("day")))


def date_agreement(a: Column, b: Column) -> Column:
    """0 unknown or different years, 1 year, 2 month, 3 day."""
    return F.when(a.isNull() | b.isNull() | (a["year"] != b["year"]), 0).when(F.coalesce(a["month"] == b["month"], F.lit(False)), F.when(F.coalesce(a["day"] == b["day"], F.lit(False)), 3).otherwise(2)).otherwise(1)


def agreed_date(date: Column) -> Column:
    """Aggregate: the finest date on which all agree; null where years differ, coarser where months or days do."""
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c))
    year, month = one(date["year"]), one(date["month"])
    return F.when(year.isNotNull(), F.struct(year.alias("year"), month.alias("month"), F.when(month.isNotNull(), one(date["day"])).alias("day")))


def fresh(observed: Column, now: Column, seconds: int) -> Column:
    """Observed less than so many seconds before now."""
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(observed) < seconds, F.lit(False))


def minutes_left(until: Column, now: Column) -> Column:
    return F.expr("0") + F.floor((until - now + 59) / 60)
