"""Column helpers shared by all operators: rounding, guarded ratios, predicates."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, functions as F

CANCELLED = "Cancelled"
DELIVERED = "Delivered"


def rnd(value: Column | str, digits: int) -> Column:
    """Round half away from zero, ignoring noise in the last bits of a double sum.

    The inner rounding settles sums whose last bits depend on row order, so a
    value that is a tie in decimal rounds the same way on every run.
    """
    inner = 6 if digits <= 3 else digits + 4
    return F.round(F.round(_col(value), inner), digits)


def money(value: Column | str) -> Column:
    return rnd(value, 2)


def ratio(numerator: Column, denominator: Column, default: float | None = None) -> Column:
    """numerator / denominator where the denominator is positive, else the default."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(default).cast("double"))


def zero_as_missing(value: Column) -> Column:
    """NULL for zero: several rules treat a zero price or cost as not given."""
    return F.nullif(value, F.lit(0).cast("double"))


def effective_cost(cost: Column | str = "cost_price", price: Column | str = "unit_price") -> Column:
    """Cost of one unit; a missing or zero cost is taken as 70% of the price."""
    return F.coalesce(zero_as_missing(_col(cost)), _col(price) * F.lit(0.7))


def not_cancelled(status: Column | str = "order_status") -> Column:
    """True unless cancelled; a null status is excluded, as in SQL."""
    return _col(status) != CANCELLED


def delivered(status: Column | str = "order_status") -> Column:
    return _col(status) == DELIVERED


def instant(value: date | datetime | str | Column) -> Column:
    """A moment in time as a column: literals and subquery columns alike."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.lit(value).cast("timestamp_ntz")
    if isinstance(value, datetime):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value.isoformat()).cast("timestamp_ntz")


def anchor(frame: DataFrame, as_of: date | datetime | str | Column | None = None,
           column: str = "order_date") -> Column:
    """The reporting moment: the given one, else the latest date in the frame.

    The default is a scalar subquery, so nothing is collected to the driver.
    """
    if as_of is not None:
        return instant(as_of)
    return frame.agg(F.max(column)).scalar()


def days_before(moment: Column, days: int) -> Column:
    return moment - F.expr(f"INTERVAL {int(days)} DAYS")


def whole_days(later: Column, earlier: Column) -> Column:
    """Elapsed whole days between two moments, rounded down."""
    return F.floor(F.timestamp_diff("SECOND", earlier, later) / F.lit(86400)).cast("int")


def safe_cast(value: Column | str, dtype: str, default: object) -> Column:
    """Cast, falling back to a default where the value is missing or malformed."""
    return F.coalesce(_col(value).try_cast(dtype), F.lit(default).cast(dtype))


def share_of(value: Column, total: Column, digits: int = 2) -> Column:
    """Percentage of a total; zero where the total is not positive."""
    return rnd(F.when(total > 0, value / total * 100).otherwise(F.lit(0.0)), digits)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
