"""Months and quarters as integer ordinals: year * 12 + month - 1 and year * 4 + quarter - 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_ordinal(day: Column) -> Column:
    return (F.year(day) * 12 + F.month(day) - 1).cast("int")


def quarter_ordinal(day: Column) -> Column:
    return (F.year(day) * 4 + F.quarter(day) - 1).cast("int")


def quarter_of_month(month: Column) -> Column:
    return F.floor(month / F.lit(3.0)).cast("int")


def month_start(month: Column) -> Column:
    return F.make_date(F.floor(month / F.lit(12.0)).cast("int"), F.pmod(month, F.lit(12)) + 1, F.lit(1))


def month_end(day: Column) -> Column:
    return F.last_day(day)


def quarter_end(day: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))


def quarter_label(quarter: Column) -> Column:
    return F.format_string("%dQ%d", F.floor(quarter / F.lit(4.0)).cast("int"), (F.pmod(quarter, F.lit(4)) + 1).cast("int"))


def target_quarter(origin_quarter: Column, horizon: Column, nowcast: bool = True) -> Column:
    """Nowcasts call the origin's own quarter horizon 1; otherwise the horizon counts from the last data quarter."""
    return origin_quarter + horizon - (1 if nowcast else 0)


def required_months(origin_month: Column, horizon: Column) -> Column:
    """Months to forecast so that the last target quarter is complete."""
    last = (quarter_of_month(origin_month) + horizon - 1) * 3 + 2
    return F.greatest(last - origin_month, F.lit(0))


def origin_group(month_number: Column) -> Column:
    """The label by the remainder of the calendar month."""
    return F.when(month_number % 3 == 1, "+0 months").when(month_number % 3 == 2, "+1 month").otherwise("+2 months")
