"""Named event and streaming queries.

The events table stands in for the event stream: its five kinds map to event
families. Stream queries replay the table through a real streaming job.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.columns import rnd
from ..operators import inventory, summary
from ..operators.ordered import dealt, materialise
from ..session import ensure_checkpoint_dir
from ..streaming import envelope as ops, jobs, windows
from .inventory import _DEAD, _STOCKOUT, _VELOCITY
from .registry import query, rounded as R

# Event kinds of the test table to event types.
KINDS = {"view": "stock.updated", "click": "analytics.daily_summary", "signup": "forecast.generated",
         "error": "alert.low_stock", "purchase": "order.created"}


def _typed(events):
    kind = F.lit(None).cast("string")
    for source, target in KINDS.items():
        kind = F.when(F.col("event_type") == source, target).otherwise(kind)
    product = F.when(F.col("event_id") % 10 != 0, F.get_json_object("props", "$.k"))
    return events.select(
        F.col("event_id").alias("id"), F.col("event_id").cast("string").alias("event_id"),
        F.when(F.col("event_id") % 89 == 0, "other.thing").otherwise(kind).alias("event_type"),
        F.col("ts").cast("timestamp").alias("timestamp"), F.lit(None).cast("string").alias("source"),
        F.lit(None).cast("string").alias("version"), F.to_json(F.struct(product.alias("product_id"), "value")).alias("data"),
        F.lit(None).cast("string").alias("correlation_id"), F.col("user_id").cast("string").alias("user_id"), "value")


def _raw(events):
    """Wire text of each event; some rows are cut off mid-record."""
    typed = _typed(events)
    product = F.get_json_object("data", "$.product_id")
    body = F.to_json(F.struct("event_id", "event_type", "timestamp", F.struct(product.alias("product_id"), "value").alias("data"), "user_id"))
    return typed.select(F.when(F.col("id") % 97 == 0, F.lit('{"event_id": "')).otherwise(body).alias("value"))


_EV = """
  ev AS (SELECT event_id AS id, event_id::VARCHAR AS event_id, ts, value, user_id,
                CASE WHEN event_id % 89 = 0 THEN 'other.thing' ELSE CASE event_type """ + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + """ END END AS event_type,
                CASE WHEN event_id % 10 <> 0 THEN json_extract_string(props, '$.k') END AS product FROM events),
  pa AS (SELECT *, id % 97 <> 0 AND id % 89 <> 0 AS ok FROM ev)"""
_TOPIC = """CASE WHEN event_type LIKE 'order.%' THEN 'inventory.orders' WHEN event_type LIKE 'stock.%' THEN 'inventory.stock'
  WHEN event_type LIKE 'forecast.%' OR event_type LIKE 'model.%' THEN 'inventory.forecasts' ELSE 'inventory.alerts' END"""
_CHANNEL = """CASE WHEN event_type LIKE 'order.%' THEN 'orders' WHEN event_type LIKE 'stock.%' THEN 'stock'
  WHEN event_type LIKE 'alert.%' THEN 'alerts' WHEN event_type LIKE 'forecast.%' OR event_type LIKE 'model.%' THEN 'forecasts'
  WHEN event_type LIKE 'analytics.%' THEN 'analytics' END"""

query("parse_events", f"""WITH {_EV}
  SELECT event_id, event_type, product, 'inventory-manager' AS source, '1.0' AS version, user_id::VARCHAR AS user_id,
         strftime(ts, '%Y-%m-%d %H:%M') AS minute FROM pa WHERE ok""", bare=True)(
    lambda t: ops.valid_events(ops.parse_events(_raw(t.events))).select(
        "event_id", "event_type", F.get_json_object("data", "$.product_id").alias("product"), "source", "version", "user_id",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm").alias("minute")))
query("quarantined_events", f"""WITH {_EV} SELECT count(*) AS rows, count(*) FILTER (id % 97 = 0) AS cut FROM pa WHERE NOT ok""", bare=True)(
    lambda t: ops.quarantined(ops.parse_events(_raw(t.events))).agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("raw") == '{"event_id": "', 1)).alias("cut")))
query("encode_events", f"""WITH {_EV}
  SELECT coalesce(product, event_id) AS key, {_TOPIC} AS topic, event_id, event_type, {R('value', 4)} AS value FROM ev WHERE id % 89 <> 0""", bare=True)(
    lambda t: (lambda wire: ops.valid_events(ops.parse_events(wire)).join(
        wire.select(F.get_json_object("value", "$.event_id").alias("event_id"), "key", "topic"), "event_id").select(
        "key", "topic", "event_id", "event_type", rnd(F.get_json_object("data", "$.value").cast("double"), 4).alias("value")))(
        ops.encode_events(_typed(t.events))))
query("route_topic", f"WITH {_EV} SELECT event_type, {_TOPIC} AS topic, count(*) AS events FROM ev GROUP BY 1, 2", bare=True)(
    lambda t: _typed(t.events).groupBy("event_type", ops.route_topic(F.col("event_type")).alias("topic")).agg(
        F.count(F.lit(1)).alias("events")))
query("partition_key", f"""WITH {_EV}
  SELECT event_id, CASE WHEN id % 7 = 0 THEN 'u' || user_id ELSE coalesce(product, event_id) END AS key FROM ev""", bare=True)(
    lambda t: _typed(t.events).select("event_id", ops.partition_key(
        F.when(F.col("id") % 7 == 0, F.concat(F.lit("u"), F.col("user_id")))).alias("key")))
query("channel_filter", f"WITH {_EV} SELECT event_id, event_type FROM ev WHERE {_CHANNEL} = 'stock'", bare=True)(
    lambda t: ops.channel_filter(_typed(t.events), "stock").select("event_id", "event_type"))
query("event_channel_stats", f"""WITH {_EV}, c AS (SELECT {_CHANNEL} AS channel FROM ev)
  SELECT channel, count(*) AS events FROM c WHERE channel IS NOT NULL GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM c""", bare=True)(
    lambda t: ops.event_channel_stats(_typed(t.events)))


def _payload(events, family, *names):
    return ops.decode(events, family).select("event_type", *[F.col(f"payload.{n}").alias(n) for n in names])


query("order_events", f"""
  SELECT 'order.created' AS event_type, order_id::VARCHAR AS order_id, product_id::VARCHAR AS product_id, quantity,
         {R('total_amount')} AS total_amount, customer_id::VARCHAR AS customer_id FROM sales""")(
    lambda t: _payload(ops.order_events(t.sales), "order", "order_id", "product_id", "quantity", "total_amount", "customer_id").withColumn(
        "total_amount", rnd("total_amount", 2)))


def _changes(t):
    return t.products.select("product_id", "product_name", F.col("initial_stock").alias("previous_stock"), "current_stock",
                             "reorder_threshold", F.when(F.col("product_id") % 2 == 0, "recount").alias("reason"),
                             t.as_of.cast("timestamp").alias("changed_at"))


query("stock_events", """
  SELECT 'stock.updated' AS event_type, product_id::VARCHAR AS product_id, product_name, initial_stock AS previous_stock,
         current_stock, reorder_threshold, current_stock - initial_stock AS stock_change FROM products""")(
    lambda t: _payload(ops.stock_events(_changes(t)), "stock", "product_id", "product_name", "previous_stock", "current_stock",
                       "reorder_threshold", "stock_change"))
query("stock_change_records", """
  SELECT product_id, product_name, initial_stock AS previous_stock, current_stock, current_stock - initial_stock AS change,
         CASE WHEN product_id % 2 = 0 THEN 'recount' ELSE 'manual_update' END AS reason FROM products""")(
    lambda t: ops.stock_change_records(_changes(t)))


def _messages(t):
    out = F.col("current_stock") == 0
    affected = F.array(F.struct(F.col("product_id").cast("string").alias("product_id"), "current_stock", "reorder_threshold"))
    return inventory.inventory_alerts(t.products).select(
        F.when(out, "critical").otherwise("warning").alias("alert_level"),
        F.when(out, "Out of stock").otherwise("Low stock").alias("title"), F.col("product_name").alias("message"),
        affected.alias("affected_products"))


query("alert_events", """
  SELECT 'alert.low_stock' AS event_type, CASE WHEN current_stock = 0 THEN 'critical' ELSE 'warning' END AS alert_level,
         CASE WHEN current_stock = 0 THEN 'Out of stock' ELSE 'Low stock' END AS title, product_name AS message,
         product_id::VARCHAR AS product_id, current_stock FROM products WHERE is_active AND current_stock <= reorder_threshold""")(
    lambda t: ops.decode(ops.alert_events(_messages(t), "alert.low_stock", t.as_of.cast("timestamp")), "alert").select(
        "event_type", "payload.alert_level", "payload.title", "payload.message",
        F.col("payload.affected_products")[0]["product_id"].alias("product_id"),
        F.col("payload.affected_products")[0]["current_stock"].alias("current_stock")))
query("threshold_broadcast", """
  SELECT CASE WHEN current_stock = 0 THEN 'alert.reorder_needed' ELSE 'alert.low_stock' END AS event_type,
         CASE WHEN current_stock = 0 THEN 'critical' ELSE 'warning' END AS alert_level, count(*) AS alerts
  FROM products WHERE is_active AND current_stock <= reorder_threshold GROUP BY 1, 2""")(
    lambda t: _payload(ops.threshold_broadcast(_messages(t), t.as_of.cast("timestamp")), "alert", "alert_level").groupBy(
        "event_type", "alert_level").agg(F.count(F.lit(1)).alias("alerts")))


def _totals(t):
    sold = t.sales.join(t.catalog.select("product_id", "category"), "product_id").groupBy("category").agg(
        F.sum("quantity").cast("double").alias("total_forecast"))
    return sold.select(F.col("category").alias("series_id"), F.lit(30).alias("horizon_days"), "total_forecast",
                       (F.col("total_forecast") * 0.5).alias("lower_total"), (F.col("total_forecast") * 2).alias("upper_total"))


query("forecast_events", """
  SELECT 'forecast.generated' AS event_type, category, 30 AS forecast_horizon_days, CAST(sum(quantity) AS DOUBLE) AS predicted_demand,
         sum(quantity) * 0.5::DOUBLE AS lower, sum(quantity) * 2::DOUBLE AS upper FROM sales JOIN catalog USING (product_id) GROUP BY 2""")(
    lambda t: ops.decode(ops.forecast_events(_totals(t), t.as_of.cast("timestamp")), "forecast").select(
        "event_type", "payload.category", "payload.forecast_horizon_days", "payload.predicted_demand",
        "payload.confidence_interval.lower", "payload.confidence_interval.upper"))


def _period_summary(t):
    daily = t.sales.groupBy(F.to_date("order_date").alias("period_start")).agg(
        F.sum("quantity").alias("units"), F.count(F.lit(1)).alias("orders"))
    return daily.select(F.lit("daily").alias("period"), "period_start", F.date_add("period_start", 1).alias("period_end"), "units", "orders")


query("analytics_events", """
  SELECT 'analytics.daily_summary' AS event_type, 'daily' AS period, CAST(order_date AS DATE) AS day,
         CAST(sum(quantity) AS DOUBLE) AS units, CAST(count(*) AS DOUBLE) AS orders FROM sales GROUP BY 3""")(
    lambda t: ops.decode(ops.analytics_events(_period_summary(t), "analytics.daily_summary", ["units", "orders"]), "analytics").select(
        "event_type", "payload.period", F.to_date("payload.period_start").alias("day"),
        F.col("payload.metrics")["units"].alias("units"), F.col("payload.metrics")["orders"].alias("orders")))


def _alert_feed(t):
    """All alerts from one summary of the sales and one read of the products."""
    days, products = materialise(summary.product_summary(summary.product_days(t.sales), t.as_of)), materialise(t.products)
    return ops.alert_feed(inventory.dead_from(days, products, t.as_of), inventory.inventory_from(days, products), t.as_of)


query("alert_feed", _DEAD + "," + _VELOCITY + f""",
  pi AS (SELECT product_id, {_STOCKOUT} AS days, current_stock <= reorder_threshold AS low,
                greatest(reorder_quantity, CAST(floor({R('v * 30', 4)}) AS INTEGER)) AS qty FROM products JOIN velocity USING (product_id))
  SELECT 'alert.dead_stock' AS event_type, product_id::VARCHAR AS product_id, CAST(days_since_sale AS INTEGER) AS detail FROM dead
  UNION ALL SELECT 'alert.reorder_needed', product_id::VARCHAR, qty FROM pi WHERE low
  UNION ALL SELECT 'alert.stockout_risk', product_id::VARCHAR, days FROM pi WHERE days > 0 AND days <= 7""")(
    lambda t: _alert_feed(t).select(
        "event_type", F.get_json_object("data", "$.product_id").alias("product_id"),
        F.coalesce(*[F.get_json_object("data", f"$.{n}") for n in ("days_since_sale", "recommended_quantity", "days_until_stockout")])
        .cast("int").alias("detail")))


def _timed(t):
    return t.events.select("event_id", F.col("ts").alias("timestamp"), "event_type", "value")


def _windowed(bucket: str) -> str:
    return f"""
      SELECT {bucket} AS period_start, event_type, count(*) AS events, {R('sum(value)', 4)} AS total, {R('max(value)', 4)} AS largest
      FROM events GROUP BY 1, 2"""


def _rounded(frame):
    return frame.select("period_start", "event_type", "events", rnd("total", 4).alias("total"), rnd("largest", 4).alias("largest"))


_BUCKETS = {"daily_summary": (windows.daily_summary, "CAST(ts AS DATE)"),
            "weekly_summary": (windows.weekly_summary, "CAST(date_trunc('week', ts) AS DATE)"),
            "monthly_report": (windows.monthly_report, "CAST(date_trunc('month', ts) AS DATE)")}
for _name, (_build, _bucket) in _BUCKETS.items():
    query(f"windowed_{_name}", _windowed(_bucket), bare=True)(lambda t, b=_build: _rounded(b(_timed(t))))


def _scratch(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4()}"


def _stream(t, table: str):
    """A table file as a file stream."""
    return (t.spark.readStream.schema(t.raw(table).schema).option("pathGlobFilter", f"{table}.parquet").parquet(t.folder))


def _replayed(stream, keys):
    """Run an update-mode job over what is available and read its newest rows."""
    spark, place = stream.sparkSession, _scratch(stream.sparkSession)
    jobs.run_available(stream, jobs.write_batches(f"{place}/out"), f"{place}/checkpoint")
    return jobs.latest_by_key(spark, f"{place}/out", keys)


for _name, (_build, _bucket) in _BUCKETS.items():
    query(f"stream_{_name}", _windowed(_bucket), bare=True)(
        lambda t, b=_build: _rounded(_replayed(b(_stream(t, "events").select(
            "event_id", F.col("ts").alias("timestamp"), "event_type", "value")), ["period_start", "event_type"])))


def _doubled(t):
    """Every fifth event sent again an hour later."""
    base = _timed(t)
    again = base.where(F.col("event_id") % 5 == 0).withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 1 HOUR"))
    return base.unionByName(again)


query("dedupe_events", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS minute, event_type FROM events", bare=True)(
    lambda t: windows.dedupe_events(_doubled(t)).select(
        "event_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm").alias("minute"), "event_type"))


def _stream_dedupe(t):
    base = _stream(t, "events").select("event_id", F.col("ts").alias("timestamp"), "event_type")
    twice = base.withColumn("copy", F.explode(F.when(F.col("event_id") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    place = _scratch(t.spark)
    jobs.run_available(windows.dedupe_events(twice, delay="40 days"), jobs.write_batches(f"{place}/out"), f"{place}/checkpoint", "append")
    return t.spark.read.parquet(f"{place}/out").select("event_id", "event_type")


query("stream_dedupe_events", "SELECT event_id, event_type FROM events", bare=True)(_stream_dedupe)
query("late_events", """
  SELECT event_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 2 DAY""", bare=True)(
    lambda t: windows.late_events(_timed(t), F.lit("2024-01-20 00:00:00").cast("timestamp"), "2 DAYS").select("event_id", "event_type"))

_RUNNING = """
  SELECT product_id, count(quantity) AS orders, CAST(initial_stock - coalesce(sum(quantity), 0) AS BIGINT) AS stock, reorder_threshold
  FROM products LEFT JOIN (SELECT product_id, quantity FROM items) USING (product_id) GROUP BY product_id, initial_stock, reorder_threshold"""
query("running_stock", _RUNNING)(lambda t: jobs.stock_after(jobs.running_stock(t.order_items), t.products))
query("stream_running_stock", _RUNNING)(
    lambda t: jobs.stock_after(_replayed(jobs.running_stock(_stream(t, "lineitem").select(
        F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("int").alias("quantity"))), ["product_id"]), t.products))


def _levels(t):
    return t.products.select("product_id", "product_name", "reorder_threshold", F.col("initial_stock").alias("stock"))


def _transitions(t):
    moves = dealt(t.sales, t.tasks, "product_id", "order_id").groupBy("product_id", "order_id", F.col("order_date").alias("changed_at")).agg(
        (-F.sum("quantity")).alias("quantity"))
    return jobs.transitions(jobs.level_changes(moves, _levels(t), ["order_id"]))


query("stock_transition_alerts", """
  m AS (SELECT product_id, order_id, order_date, CAST(-sum(quantity) AS BIGINT) AS quantity FROM sales GROUP BY 1, 2, 3),
  l AS (SELECT product_id, quantity, reorder_threshold, initial_stock + sum(quantity) OVER (PARTITION BY product_id
               ORDER BY order_date, order_id ROWS UNBOUNDED PRECEDING) AS cur FROM m JOIN products USING (product_id)),
  k AS (SELECT product_id, CAST(cur AS INTEGER) AS current_stock, CAST(cur - quantity AS INTEGER) AS previous_stock,
               CASE WHEN cur <= 0 AND cur - quantity > 0 THEN 'stock.out' WHEN quantity > 0 THEN 'stock.replenished'
                    WHEN cur > 0 AND cur <= reorder_threshold AND quantity < 0 THEN 'stock.low' END AS event_type FROM l)
  SELECT event_type, product_id::VARCHAR AS product_id, previous_stock, current_stock FROM k WHERE event_type IS NOT NULL""")(
    lambda t: _payload(_transitions(t), "stock", "product_id", "previous_stock", "current_stock"))


def _stream_transitions(t):
    """The same job over the line stream; lines carry no order date, so the ship date gives the order."""
    place = _scratch(t.spark)
    moves = _stream(t, "lineitem").select(
        F.col("l_partkey").alias("product_id"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"),
        (-F.col("l_quantity")).cast("int").alias("quantity"), F.col("l_shipdate").cast("timestamp").alias("changed_at"))
    jobs.stock_alerts(moves, _levels(t), ["order_id", "line_no", "quantity"], f"{place}/alerts", f"{place}/checkpoint")
    return _payload(t.spark.read.parquet(f"{place}/alerts"), "stock", "product_id", "previous_stock", "current_stock")


query("stream_stock_transition_alerts", """
  l AS (SELECT product_id, -quantity AS q, reorder_threshold, initial_stock - sum(quantity) OVER (PARTITION BY product_id
               ORDER BY delivery_date, order_id, line_no, -quantity ROWS UNBOUNDED PRECEDING) AS cur FROM items JOIN products USING (product_id)),
  k AS (SELECT product_id, CAST(cur AS INTEGER) AS current_stock, CAST(cur - q AS INTEGER) AS previous_stock,
               CASE WHEN cur <= 0 AND cur - q > 0 THEN 'stock.out' WHEN q > 0 THEN 'stock.replenished'
                    WHEN cur > 0 AND cur <= reorder_threshold AND q < 0 THEN 'stock.low' END AS event_type FROM l)
  SELECT event_type, product_id::VARCHAR AS product_id, previous_stock, current_stock FROM k WHERE event_type IS NOT NULL""")(
    _stream_transitions)
