"""Event envelopes: JSON text to columns and back, typed builders, routing.

Everything here is a projection, so the same functions serve batch and stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import ENVELOPE, EVENT_TYPES, FAMILIES

# Envelope defaults.
SOURCE, VERSION = "inventory-manager", "1.0"

# Topic and channel per event-type prefix.
TOPICS = {"order.": "inventory.orders", "stock.": "inventory.stock", "alert.": "inventory.alerts",
          "forecast.": "inventory.forecasts", "model.": "inventory.forecasts", "analytics.": "inventory.alerts"}
DEFAULT_TOPIC = "inventory.alerts"
CHANNELS = {"order.": "orders", "stock.": "stock", "alert.": "alerts", "forecast.": "forecasts",
            "model.": "forecasts", "analytics.": "analytics"}
ALL = "all"


def parse_events(raw: DataFrame, value: str = "value") -> DataFrame:
    """Envelope columns from JSON text. Rows that are no valid event have ``is_valid`` false and keep the text."""
    # parsed once into a struct, then its fields are read
    parsed = raw.select(F.col(value).cast("string").alias("raw")).withColumn("e", F.from_json("raw", ENVELOPE))
    e = F.col("e")
    known = F.coalesce(e["event_type"].isin(EVENT_TYPES), F.lit(False))
    return parsed.select(
        "raw", known.alias("is_valid"), e["event_id"].alias("event_id"), e["event_type"].alias("event_type"),
        e["timestamp"].alias("timestamp"), F.coalesce(e["source"], F.lit(SOURCE)).alias("source"),
        F.coalesce(e["version"], F.lit(VERSION)).alias("version"), F.coalesce(e["data"], F.lit("{}")).alias("data"),
        e["correlation_id"].alias("correlation_id"), e["user_id"].alias("user_id"))


def valid_events(parsed: DataFrame) -> DataFrame:
    return parsed.where("is_valid").drop("raw", "is_valid")


def quarantined(parsed: DataFrame) -> DataFrame:
    return parsed.where(~F.col("is_valid")).select("raw")


def decode(events: DataFrame, family: str) -> DataFrame:
    """Events of one family with their payload as typed columns under ``payload``."""
    return events.where(F.col("event_type").startswith(family + ".")).withColumn(
        "payload", F.from_json("data", FAMILIES[family]))


def encode_events(events: DataFrame) -> DataFrame:
    """Key, topic and JSON text of each event, ready for a message sink."""
    names = ["event_id", "event_type", "timestamp", "source", "version", "correlation_id", "user_id"]
    head = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    # the payload is JSON already: it goes in as an object, not as quoted text
    body = F.concat(F.substring(head, 1, F.length(head) - 1), F.lit(',"data":'), F.coalesce("data", F.lit("{}")), F.lit("}"))
    return events.select(partition_key().alias("key"), route_topic(F.col("event_type")).alias("topic"), body.alias("value"))


def _by_prefix(event_type: Column, table: dict[str, str], default: str | None) -> Column:
    picked = F.lit(default).cast("string")
    for prefix, target in table.items():
        picked = F.when(event_type.startswith(prefix), target).otherwise(picked)
    return picked


def route_topic(event_type: Column) -> Column:
    """Topic of an event type; analytics and unknown types share the alerts topic."""
    return _by_prefix(event_type, TOPICS, DEFAULT_TOPIC)


def channel(event_type: Column) -> Column:
    """Subscription channel; analytics has its own, an unknown type has none."""
    return _by_prefix(event_type, CHANNELS, None)


def partition_key(explicit: Column | None = None) -> Column:
    """Explicit key, else the payload's product, else the event id."""
    product = F.get_json_object("data", "$.product_id")
    chosen = [product, F.col("event_id")] if explicit is None else [explicit, product, F.col("event_id")]
    return F.coalesce(*chosen)


def channel_filter(events: DataFrame, name: str) -> DataFrame:
    """Events a subscriber of the channel sees; ``all`` sees every event."""
    return events if name == ALL else events.where(channel(F.col("event_type")) == name)


def event_channel_stats(events: DataFrame) -> DataFrame:
    """Events per channel, with a row for all of them."""
    seen = F.explode(F.filter(F.array(channel(F.col("event_type")), F.lit(ALL)), lambda c: c.isNotNull()))
    return events.select(seen.alias("channel")).groupBy("channel").agg(F.count(F.lit(1)).alias("events"))


def make_events(frame: DataFrame, event_type: Column | str, timestamp: Column, payload: Column,
                correlation_id: Column | None = None) -> DataFrame:
    """Events from rows. The id is a digest of type, time and payload, so a retried task makes the same event."""
    kind = F.lit(event_type) if isinstance(event_type, str) else event_type
    data = F.to_json(payload)
    built = frame.select(kind.alias("event_type"), timestamp.alias("timestamp"), data.alias("data"),
                         (F.lit(None).cast("string") if correlation_id is None else correlation_id).alias("correlation_id"))
    digest = F.sha2(F.concat_ws("|", "event_type", F.col("timestamp").cast("string"), "data"), 256)
    return built.select(digest.alias("event_id"), "event_type", "timestamp", F.lit(SOURCE).alias("source"),
                        F.lit(VERSION).alias("version"), "data", "correlation_id", F.lit(None).cast("string").alias("user_id"))


def _text(column: str) -> Column:
    return F.col(column).cast("string").alias(column)


def order_events(orders: DataFrame, event_type: Column | str = "order.created", timestamp: str = "order_date") -> DataFrame:
    payload = F.struct(_text("order_id"), _text("product_id"), "quantity", "total_amount", _text("customer_id"))
    return make_events(orders, event_type, F.col(timestamp), payload)


def stock_events(changes: DataFrame, event_type: Column | str = "stock.updated", timestamp: str = "changed_at") -> DataFrame:
    payload = F.struct(_text("product_id"), "product_name", "previous_stock", "current_stock", "reorder_threshold",
                       (F.col("current_stock") - F.col("previous_stock")).alias("stock_change"))
    return make_events(changes, event_type, F.col(timestamp), payload)


def alert_events(alerts: DataFrame, event_type: Column | str, timestamp: Column) -> DataFrame:
    """Alerts from columns level, title, message and affected_products."""
    payload = F.struct(F.col("alert_level"), "title", "message", "affected_products")
    return make_events(alerts, event_type, timestamp, payload)


def forecast_events(totals: DataFrame, timestamp: Column, event_type: str = "forecast.generated") -> DataFrame:
    """From horizon totals: series, horizon, total and interval."""
    payload = F.struct(
        F.col("series_id").cast("string").alias("category"), F.col("horizon_days").alias("forecast_horizon_days"),
        F.col("total_forecast").alias("predicted_demand"),
        F.struct(F.col("lower_total").alias("lower"), F.col("upper_total").alias("upper")).alias("confidence_interval"))
    return make_events(totals, event_type, timestamp, payload)


def analytics_events(summary: DataFrame, event_type: str, metrics: list[str]) -> DataFrame:
    """From summary rows with period, period_start and period_end."""
    values = F.create_map(*[part for m in metrics for part in (F.lit(m), F.col(m).cast("double"))])
    day = "yyyy-MM-dd'T'HH:mm:ss"
    payload = F.struct("period", F.date_format("period_start", day).alias("period_start"),
                       F.date_format("period_end", day).alias("period_end"), values.alias("metrics"))
    return make_events(summary, event_type, F.col("period_end").cast("timestamp"), payload)


def threshold_broadcast(messages: DataFrame, timestamp: Column) -> DataFrame:
    """Operator messages as alert events: a warning is a low-stock alert, other levels ask for reorder."""
    kind = F.when(F.col("alert_level") == "warning", "alert.low_stock").otherwise("alert.reorder_needed")
    none = F.array().cast("array<struct<product_id:string,current_stock:int,reorder_threshold:int>>")
    return alert_events(messages.withColumn("affected_products", none), kind, timestamp)


def stock_change_records(changes: DataFrame) -> DataFrame:
    """The record broadcast with a stock update."""
    return changes.select("product_id", "product_name", "previous_stock", "current_stock",
                          (F.col("current_stock") - F.col("previous_stock")).alias("change"),
                          F.coalesce("reason", F.lit("manual_update")).alias("reason"))


def stock_transition(previous: Column, current: Column, threshold: Column) -> Column:
    """Event type of a level change: out at zero, low when falling into the band, replenished on a rise."""
    return (F.when((current <= 0) & (previous > 0), "stock.out")
            .when(current > previous, "stock.replenished")
            .when((current > 0) & (current <= threshold) & (current < previous), "stock.low"))


def alert_feed(dead: DataFrame, inventory: DataFrame, as_of: Column, risk_days: int = 7) -> DataFrame:
    """Alert events from batch metrics: dead stock, reorder needed, and stock-out risk."""
    def events(frame: DataFrame, kind: str, **fields: Column) -> DataFrame:
        payload = F.struct(_text("product_id"), *[c.alias(n) for n, c in fields.items()])
        return make_events(frame, kind, as_of.cast("timestamp"), payload)

    return (events(dead, "alert.dead_stock", days_since_sale=F.col("days_since_sale"), value=F.col("stock_value"))
            .unionByName(events(inventory.where("low_stock_alert"), "alert.reorder_needed",
                                recommended_quantity=F.col("recommended_reorder_quantity")))
            .unionByName(events(inventory.where((F.col("days_until_stockout") > 0) & (F.col("days_until_stockout") <= risk_days)),
                                "alert.stockout_risk", days_until_stockout=F.col("days_until_stockout"))))
