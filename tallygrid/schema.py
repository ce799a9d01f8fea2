"""Canonical table schemas."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


S, I, D, B, TS = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()

PRODUCTS = _struct(
    ("product_id", S), ("product_name", S), ("category", S), ("brand", S),
    ("unit_price", D), ("cost_price", D), ("current_stock", I), ("initial_stock", I),
    ("reorder_threshold", I), ("reorder_quantity", I), ("stock_status", S), ("is_active", B))

CUSTOMERS = _struct(
    ("customer_id", S), ("customer_name", S), ("customer_type", S), ("city", S),
    ("state", S), ("country", S), ("is_active", B))

SELLERS = _struct(("seller_id", S), ("seller_name", S), ("is_active", B))

SALES = _struct(
    ("order_id", S), ("line_no", I), ("order_date", TS), ("customer_id", S), ("product_id", S),
    ("seller_id", S), ("quantity", I), ("unit_price", D), ("discount", D), ("tax", D),
    ("shipping_cost", D), ("total_amount", D), ("profit", D), ("profit_margin", D),
    ("payment_method", S), ("order_status", S), ("delivery_date", TS), ("returned", B),
    ("refund_amount", D))

MOVEMENTS = _struct(
    ("product_id", S), ("movement_type", S), ("quantity", I), ("reason", S), ("created_at", TS))

AFFECTED_PRODUCT = _struct(("product_id", S), ("current_stock", I), ("reorder_threshold", I))

# Payload per event family; fields a producer leaves out stay null.
ORDER_DATA = _struct(("order_id", S), ("product_id", S), ("quantity", I), ("total_amount", D), ("customer_id", S))
STOCK_DATA = _struct(
    ("product_id", S), ("product_name", S), ("previous_stock", I), ("current_stock", I),
    ("reorder_threshold", I), ("stock_change", I))
ALERT_DATA = _struct(
    ("alert_level", S), ("title", S), ("message", S), ("affected_products", T.ArrayType(AFFECTED_PRODUCT)))
FORECAST_DATA = _struct(
    ("category", S), ("forecast_horizon_days", I), ("predicted_demand", D),
    ("confidence_interval", _struct(("lower", D), ("upper", D))))
ANALYTICS_DATA = _struct(
    ("period", S), ("period_start", TS), ("period_end", TS), ("metrics", T.MapType(S, D)))
FAMILIES = {"order": ORDER_DATA, "stock": STOCK_DATA, "alert": ALERT_DATA, "forecast": FORECAST_DATA,
            "analytics": ANALYTICS_DATA}

# The envelope on the wire; ``data`` is the payload as JSON text.
ENVELOPE = _struct(
    ("event_id", S), ("event_type", S), ("timestamp", TS), ("source", S), ("version", S), ("data", S),
    ("correlation_id", S), ("user_id", S))

# Event types.
EVENT_TYPES = [
    "order.created", "order.updated", "order.cancelled", "order.delivered",
    "stock.updated", "stock.low", "stock.out", "stock.replenished",
    "alert.low_stock", "alert.dead_stock", "alert.reorder_needed", "alert.stockout_risk",
    "forecast.generated", "forecast.updated", "model.retrained",
    "analytics.daily_summary", "analytics.weekly_summary", "analytics.monthly_report"]
