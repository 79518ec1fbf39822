"""Seasons of a July-to-June year as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cycle_year(day: Column) -> Column:
    """The calendar year in which the day's July-to-June year begins."""
    return F.year(day) - F.when(F.month(day) < 7, 1).otherwise(0)


def season_bounds(year: Column, first_month: int, n_months: int) -> tuple[Column, Column]:
    """First day of a season of a July-to-June year, and the day after its last; months before July are next year's."""
    start = F.make_date(year + F.lit(1 if first_month < 7 else 0), F.lit(first_month), F.lit(1))
    return start, F.to_date(F.add_months(start, n_months))


def season_day(day: Column, first_month: int) -> Column:
    """Days since the last first of ``first_month``: a day's place in its season, comparable between years."""
    start = F.make_date(F.year(day) - F.when(F.month(day) < first_month, 1).otherwise(0), F.lit(first_month), F.lit(1))
    return F.datediff(F.to_date(day), start)


def consecutive_months(text: Column) -> Column:
    """Whether a comma-separated list of months, each 1 to 12, goes on by one from each to the next (December to January too)."""
    months = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("int"))
    valid = F.forall(months, lambda m: F.coalesce(m.between(1, 12), F.lit(False)))
    later = F.slice(months, 2, F.greatest(F.size(months) - 1, F.lit(0)))
    steps = F.forall(F.zip_with(F.slice(months, 1, F.greatest(F.size(months) - 1, F.lit(0))), later, lambda a, b: F.pmod(b - a, F.lit(12)) == 1), lambda x: x)
    return valid & steps
