"""Calendar expressions: period labels, week endings, date grids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Names in calendar order.
DAY_NAMES = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July",
               "August", "September", "October", "November", "December"]


def month_label(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM")


def monday_week_label(moment: Column) -> Column:
    """Year and week of year, weeks starting on Monday, days before the first
    Monday in week 00 (the C library's %Y-%W)."""
    week = F.floor((F.dayofyear(moment) + 6 - F.weekday(moment)) / 7).cast("int")
    return F.format_string("%04d-%02d", F.year(moment), week)


def period_label(moment: Column, period: str) -> Column:
    if period == "daily":
        return F.date_format(moment, "yyyy-MM-dd")
    if period == "weekly":
        return monday_week_label(moment)
    if period == "monthly":
        return month_label(moment)
    raise ValueError(f"unknown period: {period}")


def week_ending_sunday(moment: Column) -> Column:
    day = F.to_date(moment)
    return F.date_add(day, 6 - F.weekday(day))


def month_start(moment: Column) -> Column:
    return F.trunc(F.to_date(moment), "month")


def month_index(moment: Column) -> Column:
    """Months since year zero, for whole-month differences."""
    return F.year(moment) * 12 + F.month(moment)


def day_number(moment: Column) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(moment) - 1


def pick_name(index: Column, names: list[str]) -> Column:
    """Name at a zero-based position of a fixed list."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))
