"""Dates and period keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def packed_date(column: Column | str) -> Column:
    """First eight characters as yyyyMMdd; NULL when they are no date."""
    return F.try_to_date(F.substring(_c(column), 1, 8), "yyyyMMdd")


def packed_timestamp(column: Column | str) -> Column:
    """yyyyMMddHHmmss; NULL when it is no timestamp."""
    return F.try_to_timestamp(_c(column), F.lit("yyyyMMddHHmmss"))


def month_key(column: Column | str) -> Column:
    return F.date_format(_c(column), "yyyy-MM")


def quarter_key(column: Column | str) -> Column:
    c = _c(column)
    return F.concat(F.year(c).cast("string"), F.lit("-Q"), F.quarter(c).cast("string"))


def year_key(column: Column | str) -> Column:
    return F.year(_c(column)).cast("string")


def period_keys(column: Column | str) -> Column:
    """One struct per granularity; explode it to compare at year, quarter and month level in one pass."""
    return F.array(
        *[
            F.struct(F.lit(name).alias("granularity"), key(column).alias("period"))
            for name, key in (("year", year_key), ("quarter", quarter_key), ("month", month_key))
        ]
    )


def date_in_name(column: Column | str) -> Column:
    """The first eight-digit run in a file name, as a date."""
    return F.try_to_date(F.nullif(F.regexp_extract(_c(column), r"(\d{8})", 1), F.lit("")), "yyyyMMdd")


def in_season(column: Column | str, windows: Sequence[tuple[int, int]]) -> Column:
    """True in any of the month windows; a window may wrap around the year's end."""
    month, flag = F.month(_c(column)), F.lit(False)
    for first, last in windows:
        inside = month.between(first, last) if first <= last else (month >= first) | (month <= last)
        flag = flag | inside
    return flag


def season_year(column: Column | str, windows: Sequence[tuple[int, int]]) -> Column:
    """The year a season belongs to: the months after the wrap count to the year the season began in."""
    c, year = _c(column), F.year(_c(column))
    for first, last in windows:
        if first > last:
            year = F.when(F.month(c) <= last, year - 1).otherwise(year)
    return year


def season_days(windows: Sequence[tuple[int, int]]) -> int:
    """Days in all windows of a year, each month counted as 30; a window may run over the turn of the year."""
    return sum(30 * ((last - first) % 12 + 1) for first, last in windows)


def season_increment(column: Column | str, windows: Sequence[tuple[int, int]], annual: float) -> Column:
    """The part of an annual volume that a day brings in: evenly spread over the windows, zero outside."""
    days = season_days(windows)
    return F.when(in_season(column, windows), F.lit(annual / days if days else 0.0)).otherwise(0.0)
