"""Calendar months written YYYYMM, as Column expressions and as plain integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_index(period: Column | str) -> Column:
    """Months since year 0: consecutive months have consecutive numbers."""
    p = _col(period)
    return (F.floor(p / 100) * 12 + p % 100 - 1).cast("int")


def index_of_date(day: Column | str) -> Column:
    d = _col(day)
    return (F.year(d) * 12 + F.month(d) - 1).cast("int")


def period_of_index(index: Column | str) -> Column:
    i = _col(index)
    return (F.floor(i / 12) * 100 + i % 12 + 1).cast("int")


def first_day(period: Column | str) -> Column:
    p = _col(period)
    return F.make_date(F.floor(p / 100).cast("int"), (p % 100).cast("int"), F.lit(1))


def last_day(period: Column | str) -> Column:
    return F.last_day(first_day(period))


def period_add(period: Column | str, months: Column | int) -> Column:
    return period_of_index(month_index(period) + months)


def period_diff(later: Column | str, earlier: Column | str) -> Column:
    return month_index(later) - month_index(earlier)


def is_period(period: Column | str) -> Column:
    """True for a number that is a month of the years 1 to 9999."""
    p = _col(period)
    return F.coalesce((p % 100).between(1, 12) & p.between(101, 999912), F.lit(False))


def month_label(period: Column | str) -> Column:
    """`March 2024`."""
    return F.date_format(first_day(period), "MMMM yyyy")


def month_boundaries(start: Column | str, end: Column | str) -> Column:
    """Month boundaries crossed from one date to another (31 January to 29 February: one)."""
    return index_of_date(end) - index_of_date(start)


def to_index(period: int) -> int:
    return period // 100 * 12 + period % 100 - 1


def to_period(index: int) -> int:
    return index // 12 * 100 + index % 12 + 1
