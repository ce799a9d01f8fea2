"""Building the stored tables: seeding, merging, back-filling, writing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordered import with_scalars


def _floor_int(value: Column, least: int) -> Column:
    return F.greatest(F.floor(value), F.lit(least)).cast("int")


def seed_stock_levels(products: DataFrame, sales: DataFrame) -> DataFrame:
    """Opening and current stock and reorder rules from the quantity ordered."""
    ordered = sales.groupBy("product_id").agg(F.sum("quantity").alias("_q"))
    initial = _floor_int(F.coalesce("_q", F.lit(0)) * 0.3, 50)
    base = products.select("product_id").join(ordered, "product_id", "left").withColumn("initial_stock", initial)
    stock = base.withColumn("current_stock", _floor_int(F.col("initial_stock") * 0.4, 20))
    return stock.select(
        "product_id", "initial_stock", "current_stock",
        _floor_int(F.col("initial_stock") * 0.2, 10).alias("reorder_threshold"),
        _floor_int(F.col("initial_stock") * 0.5, 25).alias("reorder_quantity"),
        F.when(F.col("current_stock") > 10, "In Stock").otherwise("Low Stock").alias("stock_status"))


def seed_line_profit(sales: DataFrame, cost_share: float = 0.6) -> DataFrame:
    """Profit of a line at an assumed cost share; margin only on positive revenue."""
    profit = F.col("total_amount") - F.col("unit_price") * cost_share * F.col("quantity") - F.col("shipping_cost")
    margin = F.when(F.col("total_amount") > 0, profit / F.col("total_amount") * 100).otherwise(F.lit(0.0))
    return sales.withColumns({"profit": profit, "profit_margin": margin})


def upsert(stored: DataFrame, incoming: DataFrame, key: str, sequence: str) -> DataFrame:
    """Merge by key; the row with the highest load sequence wins.

    ``max_by`` folds on the map side. Write the result to a new location and
    swap, since plain parquet has no merge.
    """
    columns = [c for c in stored.columns if c != key]
    merged = stored.unionByName(incoming.select(*stored.columns))
    last = F.max_by(F.struct(*columns), F.col(sequence)).alias("_last")
    return merged.groupBy(key).agg(last).select(key, *[F.col(f"_last.{c}").alias(c) for c in columns])


def attach_inventory(products: DataFrame, inventory: DataFrame) -> DataFrame:
    """Stock columns from inventory where a product has a record; missing values take defaults."""
    mapped = inventory.select(
        "product_id", F.coalesce("initial_stock", F.lit(0)).alias("_initial"),
        F.coalesce("current_stock", F.lit(0)).alias("_current"),
        F.coalesce("reorder_level", F.lit(10)).alias("_level"),
        F.coalesce("restock_quantity", F.lit(50)).alias("_restock"))
    joined = products.join(mapped, "product_id", "left")
    targets = {"initial_stock": "_initial", "current_stock": "_current", "reorder_threshold": "_level",
               "reorder_quantity": "_restock"}
    return joined.withColumns({t: F.coalesce(F.col(s), F.col(t)) for t, s in targets.items()}).select(*products.columns)


def backfill_unit_price(products: DataFrame, items: DataFrame, order: Sequence[str]) -> DataFrame:
    """First known item price, in an explicit order, for products priced zero."""
    first = items.where(F.col("unit_price").isNotNull()).groupBy("product_id").agg(
        F.min_by("unit_price", F.struct(*order)).alias("_price"))
    price = F.when(F.col("unit_price") == 0, F.coalesce("_price", F.col("unit_price"))).otherwise(F.col("unit_price"))
    return products.join(first, "product_id", "left").withColumn("unit_price", price).drop("_price")


def opening_stock_buffer(products: DataFrame, sales: DataFrame, buffer: int = 100) -> DataFrame:
    """Opening stock as everything sold plus a buffer."""
    sold = sales.groupBy("product_id").agg(F.sum("quantity").alias("_q"))
    units = F.coalesce("_q", F.lit(0))
    return products.select("product_id").join(sold, "product_id", "left").select(
        "product_id", (units + buffer).alias("initial_stock"), (units + buffer - units).alias("current_stock"))


def load_summary(tables: dict[str, DataFrame], products: DataFrame) -> DataFrame:
    """Row counts per table and low and empty stock counts."""
    stock = products.agg(
        F.count(F.when(F.col("current_stock") <= F.col("reorder_threshold"), 1)).alias("low_stock"),
        F.count(F.when(F.col("current_stock") == 0, 1)).alias("out_of_stock"))
    out = None
    for name, frame in tables.items():
        row = frame.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = row if out is None else out.unionByName(row)
    return with_scalars(out, stock)


def write_sales(sales: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Sales as parquet by order month, so date filters prune folders.

    Rows are spread by month and a salt, so a month that holds most of the rows
    is written by several tasks.
    """
    shards = int(sales.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    month = F.date_format("order_date", "yyyy-MM")
    salt = F.pmod(F.xxhash64(*sales.columns), F.lit(shards))
    (sales.withColumn("order_month", month).repartition("order_month", salt)
     .write.mode(mode).partitionBy("order_month").parquet(path))


def write_bucketed(frame: DataFrame, table: str, key: str, buckets: int) -> None:
    """Saved table bucketed and sorted by key: joins and sums on it need no shuffle."""
    frame.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)


def write_exports(frame: DataFrame, path: str, by: str | None = None, fmt: str = "csv") -> None:
    """Report export, one folder per value of ``by`` (forecasts by category)."""
    writer = frame.write.mode("overwrite").format(fmt).option("header", True)
    (writer.partitionBy(by) if by else writer).save(path)
