"""Date expressions over text columns; what can't be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_compact(c: Column) -> Column:
    """``20240131`` (maybe with ``.0`` behind it) as a date."""
    return F.to_date(F.try_to_timestamp(F.regexp_replace(F.trim(c.cast("string")), r"\.0$", ""), F.lit("yyyyMMdd")))


def normalize_date(c: Column) -> Column:
    """Dates written compactly, with dashes, slashes or the marks 年月日, a time behind them or not, as ISO text."""
    text = F.trim(c.cast("string"))
    apart = r"^(\d{4})\s*[-/.年]\s*(\d{1,2})\s*[-/.月]\s*(\d{1,2})"
    parts = F.concat_ws("-", F.regexp_extract(text, apart, 1), F.lpad(F.regexp_extract(text, apart, 2), 2, "0"), F.lpad(F.regexp_extract(text, apart, 3), 2, "0"))
    compact = F.regexp_extract(text, r"^(\d{8})(?:\.0)?(?:\D|$)", 1)
    iso = F.when(text.rlike(apart), F.to_date(F.try_to_timestamp(parts, F.lit("yyyy-MM-dd")))).otherwise(F.to_date(F.try_to_timestamp(compact, F.lit("yyyyMMdd"))))
    return F.date_format(iso, "yyyy-MM-dd")


def first_date(*columns: Column) -> Column:
    """The first of several columns that can be read as a date, as ISO text."""
    return F.coalesce(*[normalize_date(c) for c in columns])


def date_gap(a: Column, b: Column) -> Column:
    """Days between two dates, without a sign."""
    return F.abs(F.datediff(a, b))


def week_end_friday(d: Column) -> Column:
    """The Friday on which the week of a date ends."""
    return F.next_day(F.date_sub(d, 1), "FRI")
