"""Per-product summary that daily batches add to: units and latest sale per product and day.

A batch of new order lines is folded to one row per product and day and stored under its batch id; a batch written
again replaces itself. Alerts and stock reports read the few folded rows instead of the facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import days_before, not_cancelled


def product_days(sales: DataFrame) -> DataFrame:
    """(product_id, day, units, last_sale) of sales that were not cancelled."""
    return sales.where(not_cancelled()).groupBy("product_id", F.to_date("order_date").alias("day")).agg(
        F.sum("quantity").alias("units"), F.max("order_date").alias("last_sale"))


def store_batch(sales: DataFrame, path: str, batch: int) -> None:
    """Fold the order lines of one batch into the stored summary."""
    product_days(sales).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def stored_days(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows; a day that several batches add to has a row of each."""
    return spark.read.parquet(path).drop("batch")


def compact(spark: SparkSession, path: str, target: str) -> None:
    """All batches folded into one, at a new place."""
    folded = stored_days(spark, path).groupBy("product_id", "day").agg(
        F.sum("units").alias("units"), F.max("last_sale").alias("last_sale"))
    folded.write.mode("overwrite").parquet(f"{target}/batch=0")


def product_summary(days: DataFrame, as_of: Column, window: int = 30) -> DataFrame:
    """(product_id, last_sale, sold): latest sale, and units since the day ``window`` days before ``as_of``.

    The window begins with a whole day. ``sold`` is null for a product without sales in it.
    """
    first = F.to_date(days_before(as_of, window))
    return days.groupBy("product_id").agg(
        F.max("last_sale").alias("last_sale"), F.sum(F.when(F.col("day") >= first, F.col("units"))).alias("sold"))
