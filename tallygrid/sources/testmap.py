"""The star-schema test tables read as the canonical retail tables.

``Tables`` gives the Spark side; ``facts`` gives the same mapping as a SQL
prefix, so an oracle query reads exactly the same facts.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.ordered import dealt, tasks_for


class Tables:
    """Lazily built canonical tables over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def orders(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("order_date"),
            F.col("o_custkey").alias("customer_id"), F.col("o_orderpriority").alias("payment_method"),
            order_status(F.col("o_orderstatus")).alias("order_status"))

    @cached_property
    def order_items(self) -> DataFrame:
        price, disc, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
        total = price * (1 - disc) * (1 + tax)
        profit = total - price * cost_ratio(F.col("l_partkey"))
        returned = F.col("l_returnflag") == "R"
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"),
            F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("seller_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            (price / F.col("l_quantity")).alias("unit_price"),
            (price * disc).alias("discount"), (price * (1 - disc) * tax).alias("tax"),
            F.lit(0.0).alias("shipping_cost"), total.alias("total_amount"), profit.alias("profit"),
            F.when(total > 0, profit / total * 100).otherwise(F.lit(0.0)).alias("profit_margin"),
            F.col("l_shipdate").alias("delivery_date"), returned.alias("returned"),
            F.when(returned, total).otherwise(F.lit(0.0)).alias("refund_amount"))

    @cached_property
    def sales(self) -> DataFrame:
        return dealt(self.order_items, self.tasks, "order_id").join(self.orders, "order_id")

    @cached_property
    def tasks(self) -> int:
        """Tasks over which the lines are dealt in shuffles."""
        return tasks_for(self.raw("lineitem"))

    @cached_property
    def catalog(self) -> DataFrame:
        """Product attributes without stock: a plain projection, no fact scan."""
        price = F.col("p_retailprice")
        return self.raw("part").select(
            F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"), F.col("p_brand").alias("brand"),
            price.alias("unit_price"), (price * cost_ratio(F.col("p_partkey"))).alias("cost_price"),
            (F.col("p_partkey") % 37 != 0).alias("is_active"))

    @cached_property
    def products(self) -> DataFrame:
        sold = (self.raw("lineitem").groupBy(F.col("l_partkey").alias("product_id"))
                .agg(F.sum("l_quantity").alias("_sold")))
        initial = F.greatest(F.floor(F.coalesce("_sold", F.lit(0.0)) * 0.3), F.lit(50)).cast("int")
        stocked = self.catalog.join(sold, "product_id", "left").withColumn("initial_stock", initial)
        current = F.floor(F.col("initial_stock") * (F.col("product_id") % 11) / 10).cast("int")
        return stocked.select(
            "product_id", "product_name", "category", "brand", "unit_price", "cost_price",
            current.alias("current_stock"), "initial_stock",
            F.greatest(F.floor(F.col("initial_stock") * 0.2), F.lit(10)).cast("int").alias("reorder_threshold"),
            F.greatest(F.floor(F.col("initial_stock") * 0.5), F.lit(25)).cast("int").alias("reorder_quantity"),
            F.when(current > 10, "In Stock").otherwise("Low Stock").alias("stock_status"), "is_active")

    @cached_property
    def customers(self) -> DataFrame:
        nation = self.raw("nation").join(
            self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return (self.raw("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
                .select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"),
                        F.col("c_mktsegment").alias("customer_type"), F.lit(None).cast("string").alias("city"),
                        F.col("n_name").alias("state"), F.col("r_name").alias("country"),
                        F.lit(True).alias("is_active")))

    @cached_property
    def sellers(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("seller_id"), F.col("s_name").alias("seller_name"),
            F.lit(True).alias("is_active"))

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events")

    @cached_property
    def as_of(self) -> Column:
        """Latest order date, read from the orders table alone."""
        return self.orders.agg(F.max("order_date")).scalar()


def cost_ratio(product_id: Column) -> Column:
    return F.lit(0.5) + F.lit(0.08) * (product_id % 10)


def order_status(code: Column) -> Column:
    return (F.when(code == "F", "Delivered").when(code == "O", "Shipped")
            .when(code == "P", "Cancelled"))


_ORDERS = """
orders_c AS (
  SELECT o_orderkey AS order_id, o_orderdate AS order_date, o_custkey AS customer_id,
         o_orderpriority AS payment_method,
         CASE o_orderstatus WHEN 'F' THEN 'Delivered' WHEN 'O' THEN 'Shipped'
                            WHEN 'P' THEN 'Cancelled' END AS order_status
  FROM orders)"""
_ITEMS = """
items AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS product_id,
         l_suppkey AS seller_id, CAST(l_quantity AS INTEGER) AS quantity,
         l_extendedprice / l_quantity AS unit_price, l_extendedprice * l_discount AS discount,
         l_extendedprice * (1 - l_discount) * l_tax AS tax, CAST(0 AS DOUBLE) AS shipping_cost,
         l_extendedprice * (1 - l_discount) * (1 + l_tax) AS total_amount,
         l_extendedprice * (1 - l_discount) * (1 + l_tax)
           - l_extendedprice * (0.5::DOUBLE + 0.08::DOUBLE * (l_partkey % 10)) AS profit,
         l_shipdate AS delivery_date, l_returnflag = 'R' AS returned
  FROM lineitem)"""
_SALES = """
sales AS (
  SELECT items.*, order_date, customer_id, payment_method, order_status,
         CASE WHEN total_amount > 0 THEN profit / total_amount * 100 ELSE 0 END AS profit_margin
  FROM items JOIN orders_c USING (order_id))"""
_CATALOG = """
catalog AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category, p_brand AS brand,
         p_retailprice AS unit_price,
         p_retailprice * (0.5::DOUBLE + 0.08::DOUBLE * (p_partkey % 10)) AS cost_price,
         p_partkey % 37 <> 0 AS is_active
  FROM part)"""
_PRODUCTS = """
stocked AS (
  SELECT catalog.*, CAST(greatest(floor(coalesce(sold, 0) * 0.3::DOUBLE), 50) AS INTEGER) AS initial_stock
  FROM catalog LEFT JOIN (SELECT l_partkey AS product_id, sum(l_quantity) AS sold
                          FROM lineitem GROUP BY 1) USING (product_id)),
products AS (
  SELECT *, CAST(floor(initial_stock * (product_id % 11) / 10) AS INTEGER) AS current_stock,
         CAST(greatest(floor(initial_stock * 0.2::DOUBLE), 10) AS INTEGER) AS reorder_threshold,
         CAST(greatest(floor(initial_stock * 0.5::DOUBLE), 25) AS INTEGER) AS reorder_quantity,
         CASE WHEN floor(initial_stock * (product_id % 11) / 10) > 10
              THEN 'In Stock' ELSE 'Low Stock' END AS stock_status
  FROM stocked)"""
_CUSTOMERS = """
customers AS (
  SELECT c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS customer_type,
         CAST(NULL AS VARCHAR) AS city, n_name AS state, r_name AS country
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
sellers AS (SELECT s_suppkey AS seller_id, s_name AS seller_name FROM supplier),
clock AS (SELECT max(o_orderdate) AS now FROM orders)"""

FACTS = "WITH " + ",".join([_ORDERS, _ITEMS, _SALES, _CATALOG, _PRODUCTS, _CUSTOMERS])


def facts(body: str) -> str:
    """Prefix a SQL body with the canonical tables.

    The body is a SELECT, or further named queries followed by a SELECT.
    """
    text = body.strip()
    starts_with_select = text[:6].upper() == "SELECT"
    return FACTS + ("\n" if starts_with_select else ",\n") + text


def rounded(expression: str, digits: int = 2) -> str:
    """SQL twin of :func:`tallygrid.functions.columns.rnd`."""
    inner = 6 if digits <= 3 else digits + 4
    return f"CAST(round(CAST(({expression}) AS DECIMAL(38,{inner})), {digits}) AS DOUBLE)"
