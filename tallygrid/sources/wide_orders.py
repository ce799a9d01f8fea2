"""One wide order file split into tables, and uploads with varying headers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import safe_cast
from .csv_tables import read_raw

# Columns a wide order file must have.
WIDE_COLUMNS = [
    "OrderID", "OrderDate", "CustomerID", "CustomerName", "ProductID", "ProductName", "Category", "Brand",
    "Quantity", "UnitPrice", "Discount", "Tax", "ShippingCost", "TotalAmount", "PaymentMethod", "OrderStatus",
    "City", "State", "Country", "SellerID"]

# Accepted headers (lower case) for each upload column.
UPLOAD_ALIASES = {
    "order_date": ["orderdate", "date", "order_date"],
    "quantity": ["quantity", "qty", "units"],
    "category": ["category", "product_category", "cat"],
    "product_id": ["product_id", "productid"],
    "order_status": ["order_status", "orderstatus"],
}
UPLOAD_REQUIRED = ["order_date", "quantity", "category"]


def missing_columns(frame: DataFrame, wanted: Sequence[str] = WIDE_COLUMNS) -> list[str]:
    return [c for c in wanted if c not in frame.columns]


def first_per_key(frame: DataFrame, key: str, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The earliest row of each key in an explicit order.

    ``min_by`` combines on the map side, so a hot key never gathers in one window.
    """
    first = F.min_by(F.struct(*columns), F.struct(*order)).alias("_first")
    return frame.groupBy(key).agg(first).select(key, *[F.col(f"_first.{c}").alias(c) for c in columns])


def split_wide(wide: DataFrame, order: Sequence[str] = ("OrderDate", "OrderID", "UnitPrice", "TotalAmount")
               ) -> dict[str, DataFrame]:
    """Products, customers, sellers and orders of a wide order table."""
    absent = missing_columns(wide)
    if absent:
        raise ValueError(f"Missing required columns: {absent}")
    products = first_per_key(wide, "ProductID", ["ProductName", "Category", "Brand", "UnitPrice"], order).select(
        F.col("ProductID").alias("product_id"), F.col("ProductName").alias("product_name"),
        F.col("Category").alias("category"), F.col("Brand").alias("brand"),
        F.col("UnitPrice").cast("double").alias("unit_price"), F.lit(0).alias("current_stock"))
    customers = first_per_key(wide, "CustomerID", ["CustomerName", "City", "State", "Country"], order).select(
        F.col("CustomerID").alias("customer_id"), F.col("CustomerName").alias("customer_name"),
        F.col("City").alias("city"), F.col("State").alias("state"), F.col("Country").alias("country"))
    sellers = wide.select(F.col("SellerID").alias("seller_id")).distinct()
    money = {"Discount": "discount", "Tax": "tax", "ShippingCost": "shipping_cost", "UnitPrice": "unit_price",
             "TotalAmount": "total_amount"}
    orders = wide.select(
        F.col("OrderID").alias("order_id"), F.col("OrderDate").try_cast("timestamp").alias("order_date"),
        F.col("CustomerID").alias("customer_id"), F.col("ProductID").alias("product_id"),
        F.col("SellerID").alias("seller_id"), F.col("Quantity").try_cast("int").alias("quantity"),
        *[safe_cast(raw, "double", 0.0).alias(name) for raw, name in money.items()],
        F.col("PaymentMethod").alias("payment_method"), F.col("OrderStatus").alias("order_status"))
    return {"products": products, "customers": customers, "sellers": sellers, "orders": orders}


def load_denormalised(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return split_wide(read_raw(spark, path))


def missing_upload_columns(columns: Sequence[str]) -> list[str]:
    present = {c.strip().lower() for c in columns}
    return [name for name in UPLOAD_REQUIRED if not present & set(UPLOAD_ALIASES[name])]


def prepare_upload(frame: DataFrame) -> DataFrame:
    """Canonical columns from any accepted header; cancelled orders dropped, null status kept."""
    absent = missing_upload_columns(frame.columns)
    if absent:
        raise ValueError(f"Missing required columns: {absent}")
    by_lower = {c.strip().lower(): c for c in frame.columns}
    chosen = {}
    for name, aliases in UPLOAD_ALIASES.items():
        found = next((by_lower[a] for a in aliases if a in by_lower), None)
        if found is not None:
            chosen[name] = F.col(f"`{found}`")
    chosen["order_date"] = chosen["order_date"].try_cast("timestamp")
    chosen["quantity"] = chosen["quantity"].try_cast("double")
    out = frame.select(*[column.alias(name) for name, column in chosen.items()])
    if "order_status" in chosen:
        out = out.where(F.coalesce("order_status", F.lit("")) != "Cancelled")
    return out


def upload_report(prepared: DataFrame) -> DataFrame:
    """Rows, date range and categories found in an upload."""
    categories = prepared.groupBy("category").agg(
        F.count(F.lit(1)).alias("rows"), F.min("order_date").alias("lo"), F.max("order_date").alias("hi"))
    return categories.agg(
        F.sum("rows").alias("records_processed"), F.to_date(F.min("lo")).alias("first_date"),
        F.to_date(F.max("hi")).alias("last_date"), F.array_sort(F.collect_list("category")).alias("categories"))
