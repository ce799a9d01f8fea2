"""Dense demand series in long form: (series_id, ds, y).

Sales are folded to one row per key and day before anything else, so every
per-series window below holds at most one row per calendar day, whatever the
sales volume of a key. Gaps are filled from each row to the next one, which
needs no grid join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import calendar as cal
from ..functions.columns import anchor, days_before, not_cancelled
from .ordered import materialise, tasks_for


def product_points(sales: DataFrame, key: str = "product_id", positive: bool = False) -> DataFrame:
    """Units per key and day with sales, cancelled orders left out."""
    kept = sales.where(not_cancelled())
    if positive:
        kept = kept.where((F.col("quantity") > 0) & (F.col("total_amount") > 0))
    return kept.groupBy(F.col(key).alias("series_id"), F.to_date("order_date").alias("ds")).agg(
        F.sum("quantity").alias("y"))


def category_points(sales: DataFrame, products: DataFrame, positive: bool = False) -> DataFrame:
    """Units per category and day: products are folded by day before the lookup."""
    per_product = product_points(sales, positive=positive).withColumnRenamed("series_id", "product_id")
    return (per_product.join(products.select("product_id", "category"), "product_id")
            .groupBy(F.col("category").alias("series_id"), "ds").agg(F.sum("y").alias("y")))


def fill_gaps(points: DataFrame, first: Column | None = None, last: Column | None = None, step: int = 1) -> DataFrame:
    """Zero rows between the points of each series, and out to fixed ends if given."""
    by_series = Window.partitionBy("series_id").orderBy("ds")
    ds = F.col("ds")
    placed = points.withColumns({"_before": F.lag("ds").over(by_series), "_after": F.lead("ds").over(by_series)})
    start = ds if first is None else F.when(F.col("_before").isNull(), first).otherwise(ds)
    end = F.coalesce(F.date_sub("_after", step), ds if last is None else last)
    days = F.sequence(start, end, F.expr(f"INTERVAL {step} DAYS"))
    return (placed.withColumn("_day", F.explode(days))
            .select("series_id", F.col("_day").alias("ds"),
                    F.when(F.col("_day") == ds, F.col("y")).otherwise(F.lit(0)).alias("y")))


def dealt_by_days(points: DataFrame, days: int, rows_per_task: int | None = None) -> DataFrame:
    """Points dealt by series to as many tasks as their rows ask for once each may have become ``days`` rows.

    The planner only sees the few bytes of the points and would put them all into one task.
    """
    stored = materialise(points)
    return stored.repartition(tasks_for(stored, rows_per_task, days), "series_id")


def demand_daily(sales: DataFrame, days: int = 90, as_of=None, products: DataFrame | None = None, dealt: bool = False) -> DataFrame:
    """Daily demand from ``days`` ago to the reporting date, for keys that sold in it.

    ``dealt`` spreads the series over tasks by the rows they will have (``dealt_by_days``).
    """
    moment = anchor(sales, as_of)
    since = days_before(moment, days)
    recent = sales.where(F.col("order_date") >= since)
    points = product_points(recent) if products is None else category_points(recent, products)
    if dealt:
        points = dealt_by_days(points, days + 1)
    return fill_gaps(points, F.to_date(since), F.to_date(moment))


def demand_daily_span(sales: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Daily demand from each key's first to last positive sale."""
    points = product_points(sales, positive=True) if products is None else category_points(sales, products, True)
    return fill_gaps(points)


def to_weeks(points: DataFrame) -> DataFrame:
    return points.groupBy("series_id", cal.week_ending_sunday(F.col("ds")).alias("ds")).agg(F.sum("y").alias("y"))


def demand_weekly(sales: DataFrame, products: DataFrame | None = None, keep_zero: bool = True) -> DataFrame:
    """Demand per week ending Sunday, with empty weeks kept as zero or dropped."""
    points = product_points(sales, positive=True) if products is None else category_points(sales, products, True)
    weeks = to_weeks(points)
    return fill_gaps(weeks, step=7) if keep_zero else weeks.where(F.col("y") > 0)


def indexed(history: DataFrame) -> DataFrame:
    """Row number from 0 and length of each series."""
    by_series = Window.partitionBy("series_id")
    return history.withColumns({
        "i": F.row_number().over(by_series.orderBy("ds")) - 1, "n": F.count(F.lit(1)).over(by_series)})


def split_last(history: DataFrame, periods: int) -> DataFrame:
    """Mark the last periods of each series as test."""
    marked = indexed(history)
    return marked.withColumn("is_test", F.col("i") >= F.col("n") - periods)


def split_ratio(history: DataFrame, ratio: float = 0.8) -> DataFrame:
    """Mark everything after the first share of each series as test."""
    marked = indexed(history)
    return marked.withColumn("is_test", F.col("i") >= F.floor(F.col("n") * ratio))
