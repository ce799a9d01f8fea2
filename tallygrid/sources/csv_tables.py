"""Readers for the raw CSV files.

Files are read as text with their header and cast by rule, never inferred, so a
bad value becomes a default or null instead of changing a column's type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import safe_cast

# Raw header to canonical name, per file.
CUSTOMER_COLUMNS = {
    "CustomerID": "customer_id", "CustomerName": "customer_name", "Customer_Type": "customer_type",
    "City": "city", "State": "state", "Country": "country"}
PRODUCT_COLUMNS = {
    "ProductID": "product_id", "ProductName": "product_name", "Category": "category",
    "Brand": "brand", "Cost_Price": "cost_price"}
INVENTORY_COLUMNS = {
    "ProductID": "product_id", "Initial_Stock": "initial_stock", "Current_Stock": "current_stock",
    "Reorder_Level": "reorder_level", "Restock_Quantity": "restock_quantity", "Stock_Status": "stock_status"}
ORDER_COLUMNS = {
    "OrderID": "order_id", "OrderDate": "order_date", "CustomerID": "customer_id",
    "PaymentMethod": "payment_method", "OrderStatus": "order_status", "Delivery_Date": "delivery_date",
    "Created_At": "created_at", "Updated_At": "updated_at"}
ITEM_COLUMNS = {
    "OrderID": "order_id", "ProductID": "product_id", "SellerID": "seller_id", "Quantity": "quantity",
    "UnitPrice": "unit_price", "Discount": "discount", "Tax": "tax", "ShippingCost": "shipping_cost",
    "TotalAmount": "total_amount", "Profit": "profit", "Profit_Margin": "profit_margin",
    "Returned": "returned", "Refund_Amount": "refund_amount"}
SELLER_COLUMNS = {
    "SellerID": "seller_id", "SellerName": "seller_name", "SellerRating": "seller_rating", "Location": "location"}
CORRUPT = "corrupt_record"
TRUE_WORDS = ["true", "1", "yes"]


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with every column as text. A line with too few or too many fields is kept whole in ``CORRUPT``."""
    names = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    return (spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
            .schema(schema).csv(path))


def malformed_lines(raw: DataFrame) -> DataFrame:
    """Lines of a raw file that don't have the header's number of fields. A count needs them written or cached first."""
    return raw.where(F.col(CORRUPT).isNotNull()).select(*raw.columns)


def _renamed(raw: DataFrame, names: dict[str, str]) -> DataFrame:
    return raw.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in raw.columns if c != CORRUPT])


def _number(column: str) -> Column:
    return safe_cast(column, "double", 0.0)


def _count(column: str, least: int = 0) -> Column:
    return F.greatest(_number(column).cast("int"), F.lit(least))


def is_true(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin(TRUE_WORDS), F.lit(False))


def customers_from_raw(raw: DataFrame) -> DataFrame:
    return _renamed(raw, CUSTOMER_COLUMNS).na.fill(
        {"customer_name": "Unknown Customer", "customer_type": "New", "country": "USA"})


def products_from_raw(raw: DataFrame, markup: float = 1.3) -> DataFrame:
    """Bad costs become zero; the list price is cost plus markup."""
    named = _renamed(raw, PRODUCT_COLUMNS).na.fill({"product_name": "Unknown Product"})
    return named.withColumn("cost_price", _number("cost_price")).withColumn(
        "unit_price", F.col("cost_price") * markup)


def inventory_from_raw(raw: DataFrame) -> DataFrame:
    named = _renamed(raw, INVENTORY_COLUMNS)
    counts = {c: _count(c) for c in ("initial_stock", "current_stock", "reorder_level", "restock_quantity")}
    return named.withColumns(counts).na.fill({"stock_status": "Unknown"})


def orders_from_raw(raw: DataFrame) -> DataFrame:
    """Dates that do not parse become null."""
    return _renamed(raw, ORDER_COLUMNS).withColumns({
        c: F.try_to_timestamp(F.col(c)) for c in ("order_date", "delivery_date")})


def order_items_from_raw(raw: DataFrame) -> DataFrame:
    named = _renamed(raw, ITEM_COLUMNS)
    money = {c: _number(c) for c in ("unit_price", "discount", "tax", "shipping_cost", "total_amount", "profit",
                                     "profit_margin", "refund_amount") if c in named.columns}
    cleaned = named.withColumns({**money, "quantity": _count("quantity", 1)})
    return cleaned.withColumn("returned", is_true(F.col("returned"))) if "returned" in named.columns else cleaned


def sellers_from_raw(raw: DataFrame) -> DataFrame:
    """Name from the id part after the first dash when the file has no name column."""
    named = _renamed(raw, SELLER_COLUMNS)
    if "seller_name" in named.columns:
        return named
    key = F.col("seller_id").cast("string")
    part = F.when(key.contains("-"), F.split_part(key, F.lit("-"), F.lit(2))).otherwise(key)
    return named.withColumn("seller_name", F.concat(F.lit("Seller "), part))


def ingest_customers(spark: SparkSession, path: str) -> DataFrame:
    return customers_from_raw(read_raw(spark, path))


def ingest_products(spark: SparkSession, path: str) -> DataFrame:
    return products_from_raw(read_raw(spark, path))


def ingest_inventory(spark: SparkSession, path: str) -> DataFrame:
    return inventory_from_raw(read_raw(spark, path))


def ingest_orders(spark: SparkSession, path: str) -> DataFrame:
    return orders_from_raw(read_raw(spark, path))


def ingest_order_items(spark: SparkSession, path: str) -> DataFrame:
    return order_items_from_raw(read_raw(spark, path))


def ingest_sellers(spark: SparkSession, path: str) -> DataFrame:
    return sellers_from_raw(read_raw(spark, path))
