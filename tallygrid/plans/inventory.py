"""Named inventory queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inventory as ops
from ..operators.ordered import dealt
from ..operators.sales import top_products
from .registry import query, rounded as R

_LIVE = "order_status <> 'Cancelled'"
_COST = "coalesce(nullif(cost_price, 0), unit_price * 0.7::DOUBLE)"
_DAYS = "CAST(floor(epoch(now - last_sale) / 86400) AS INTEGER)"
_LAST = f"last_sales AS (SELECT product_id, max(order_date) AS last_sale FROM sales WHERE {_LIVE} GROUP BY 1)"
_VELOCITY = f"""
  velocity AS (
    SELECT product_id, {R('coalesce(sum(quantity), 0) / 30')} AS v
    FROM catalog LEFT JOIN (SELECT product_id, quantity FROM sales, clock
      WHERE {_LIVE} AND order_date >= now - INTERVAL 30 DAY) USING (product_id) GROUP BY 1)"""
_STOCKOUT = """CASE WHEN current_stock <= 0 THEN 0
  WHEN v > 0 THEN CAST(floor(current_stock / v) AS INTEGER) END"""


def _velocity(days: int) -> str:
    return f"""
      SELECT product_id, {R(f'coalesce(sum(quantity), 0) / {days}')} AS velocity
      FROM catalog LEFT JOIN (SELECT product_id, quantity FROM sales, clock
        WHERE {_LIVE} AND order_date >= now - INTERVAL {days} DAY) USING (product_id) GROUP BY 1"""


query("current_stock", "SELECT product_id, current_stock FROM products")(lambda t: ops.current_stock(t.products))
query("stock_velocity", _velocity(30))(lambda t: ops.stock_velocity(t.sales, t.catalog, 30, t.as_of))
query("rolling_avg_demand", _velocity(7))(lambda t: ops.rolling_avg_demand(t.sales, t.catalog, 7, t.as_of))

_YEAR = """
  yearly AS (SELECT product_id, sum(quantity) AS sold FROM sales, clock
             WHERE order_status = 'Delivered' AND order_date >= now - INTERVAL 365 DAY GROUP BY 1)"""
_TURN = f"""CASE WHEN current_stock * {_COST} > 0
  THEN {R(f'coalesce(sold, 0) * {_COST} / (current_stock * {_COST})')} ELSE 0 END"""
query("inventory_turnover", _YEAR + f"""
  SELECT product_id, {_TURN} AS turnover FROM products LEFT JOIN yearly USING (product_id)""")(
    lambda t: ops.inventory_turnover(t.sales, t.products, 365, t.as_of))
query("days_since_last_sale", _LAST + f"""
  SELECT product_id, coalesce({_DAYS}, -1) AS days_since_sale
  FROM catalog LEFT JOIN last_sales USING (product_id), clock""")(
    lambda t: ops.days_since_last_sale(t.sales, t.catalog, t.as_of))
query("last_sale_dates", _LAST + " SELECT product_id, CAST(last_sale AS DATE) AS last_sale FROM last_sales")(
    lambda t: ops.last_sale_dates(t.sales).select("product_id", F.to_date("last_sale").alias("last_sale")))
query("days_until_stockout", _VELOCITY + f"""
  SELECT product_id, {_STOCKOUT} AS days_until_stockout FROM products JOIN velocity USING (product_id)""")(
    lambda t: ops.days_until_stockout(t.sales, t.products, t.as_of))

_HALVES = f"""
  halves AS (
    SELECT product_id,
           CAST(coalesce(sum(quantity) FILTER (order_date >= now - INTERVAL 30 DAY), 0) AS BIGINT) AS recent,
           CAST(coalesce(sum(quantity) FILTER (order_date < now - INTERVAL 30 DAY
                AND order_date >= now - INTERVAL 60 DAY), 0) AS BIGINT) AS prior
    FROM catalog LEFT JOIN (SELECT product_id, quantity, order_date, now FROM sales, clock WHERE {_LIVE}) USING (product_id)
    GROUP BY 1)"""
_TRENDED = """CASE WHEN prior = 0 THEN CASE WHEN recent = 0 THEN 'Stable' ELSE 'Increasing' END
  WHEN (recent - prior) / prior > 0.1::DOUBLE THEN 'Increasing'
  WHEN (recent - prior) / prior < -0.1::DOUBLE THEN 'Declining' ELSE 'Stable' END"""
query("demand_trend", _HALVES + f"""
  SELECT product_id, recent AS recent_demand, prior AS prior_demand, {_TRENDED} AS demand_trend FROM halves""")(
    lambda t: ops.demand_trend(t.sales, t.catalog, t.as_of))

_DONE = """
  done AS (SELECT product_id, sum(total_amount) AS r, sum(profit) AS p FROM sales
           WHERE order_status = 'Delivered' GROUP BY 1)"""
query("revenue_contribution", _DONE + f"""
  SELECT product_id, {R('coalesce(r, 0) / (SELECT sum(r) FROM done) * 100')} AS revenue_pct
  FROM catalog LEFT JOIN done USING (product_id)""")(lambda t: ops.revenue_contribution(t.sales, t.catalog))
query("profit_contribution", _DONE + f"""
  SELECT product_id, {R('coalesce(p, 0)')} AS profit FROM catalog LEFT JOIN done USING (product_id)""")(
    lambda t: ops.profit_contribution(t.sales, t.catalog))
query("product_metrics", ",".join([_VELOCITY, _HALVES, _YEAR, _DONE, _LAST]) + f"""
  SELECT product_id, product_name, category, current_stock, reorder_threshold, reorder_quantity, is_active,
         v AS stock_velocity, {_STOCKOUT} AS days_until_stockout, coalesce({_DAYS}, -1) AS days_since_last_sale,
         {_TURN} AS inventory_turnover, {_TRENDED} AS demand_trend,
         {R('coalesce(r, 0) / (SELECT sum(r) FROM done) * 100')} AS revenue_contribution,
         {R('coalesce(p, 0)')} AS profit_contribution, current_stock <= reorder_threshold AS low_stock_alert
  FROM products JOIN velocity USING (product_id) JOIN halves USING (product_id)
  LEFT JOIN yearly USING (product_id) LEFT JOIN done USING (product_id) LEFT JOIN last_sales USING (product_id), clock""")(
    lambda t: ops.product_metrics(t.sales, t.products, t.as_of))

_DEAD = _LAST + f""",
  dead0 AS (
    SELECT products.*, last_sale, {_DAYS} AS days, current_stock * {_COST} AS value
    FROM products LEFT JOIN last_sales USING (product_id), clock
    WHERE is_active AND current_stock > 0 AND (last_sale IS NULL OR last_sale < now - INTERVAL 90 DAY)),
  dead AS (
    SELECT product_id, product_name, category, brand, current_stock,
           coalesce(strftime(last_sale, '%Y-%m-%d'), 'Never') AS last_sale_date, days AS days_since_sale,
           {R('value')} AS stock_value, unit_price,
           CASE WHEN days IS NULL THEN '{ops.NEVER_SOLD}' WHEN days > 180 AND value > 1000 THEN '{ops.LIQUIDATE}'
                WHEN days > 180 THEN '{ops.REMOVE}' WHEN days > 120 THEN '{ops.CLEARANCE}'
                WHEN days > 90 AND value > 500 THEN '{ops.BUNDLE}' WHEN days > 90 THEN '{ops.DISCOUNT}'
                ELSE '{ops.MONITOR}' END AS recommended_action FROM dead0)"""
_SLOW = f"""
  moving AS (SELECT product_id, sum(quantity) / 30 AS v FROM sales, clock
             WHERE {_LIVE} AND order_date >= now - INTERVAL 30 DAY GROUP BY 1),
  slow AS (
    SELECT product_id, product_name, category, current_stock, {R('v', 3)} AS velocity,
           CASE WHEN floor(current_stock / v) < 10000 THEN CAST(floor(current_stock / v) AS BIGINT) END AS days_of_stock,
           {R(f'current_stock * {_COST}')} AS stock_value, '{ops.SLOW_ACTION}' AS recommended_action
    FROM products JOIN moving USING (product_id)
    WHERE is_active AND current_stock > 0 AND v > 0 AND v < LIMIT_V::DOUBLE)"""
query("inventory_status", _DEAD + """
  SELECT count(*) AS total_products,
         count(*) FILTER (current_stock <= reorder_threshold AND current_stock > 0) AS low_stock_count,
         count(*) FILTER (current_stock = 0) AS out_of_stock_count,
         count(*) FILTER (current_stock <> 0) AS in_stock_count,
         (SELECT count(*) FROM dead) AS dead_stock_count FROM products WHERE is_active""")(
    lambda t: ops.inventory_status(t.sales, t.products, t.as_of))
query("product_inventory", _VELOCITY + f"""
  SELECT product_id, product_name, current_stock, reorder_threshold AS reorder_point, v AS stock_velocity,
         {_STOCKOUT} AS days_until_stockout, current_stock <= reorder_threshold AS low_stock_alert,
         greatest(reorder_quantity, CAST(floor({R('v * 30', 4)}) AS INTEGER)) AS recommended_reorder_quantity
  FROM products JOIN velocity USING (product_id)""")(lambda t: ops.product_inventory(t.sales, t.products, t.as_of))


def _low(limit: str) -> str:
    return _VELOCITY + f"""
      SELECT product_id, product_name, category, current_stock, reorder_threshold AS reorder_point, v AS stock_velocity,
             CASE WHEN current_stock < reorder_threshold / 2 THEN 'High' ELSE 'Medium' END AS priority
      FROM products JOIN velocity USING (product_id) WHERE is_active AND current_stock > 0 AND current_stock <= {limit}"""


query("low_stock", _low("reorder_threshold"))(lambda t: ops.low_stock(t.sales, t.products, None, t.as_of))
query("low_stock_threshold", _low("40"))(lambda t: ops.low_stock(t.sales, t.products, 40, t.as_of))
query("inventory_alerts", """
  SELECT product_id, product_name, current_stock, reorder_threshold, 'low_stock' AS alert_type
  FROM products WHERE is_active AND current_stock <= reorder_threshold""")(lambda t: ops.inventory_alerts(t.products))
query("apply_orders", """
  SELECT product_id, initial_stock, count(quantity) AS movements,
         CAST(initial_stock - coalesce(sum(quantity), 0) AS BIGINT) AS stock_after
  FROM products LEFT JOIN (SELECT product_id, quantity FROM sales) USING (product_id) GROUP BY 1, 2""")(
    lambda t: ops.apply_movements(t.products, ops.sale_movements(t.sales)))


def _ledger(t):
    moves = ops.sale_movements(t.sales)
    # the test lines have no unique key: whole rows of equal keys are one movement
    merged = dealt(moves, t.tasks, "product_id", "order_id").groupBy("product_id", "movement_type", "reason", "created_at", "order_id").agg(
        F.sum("quantity").alias("quantity"))
    return ops.stock_ledger(merged, t.products, ["order_id"]).select(
        "product_id", "order_id", "quantity", "stock_after")


query("stock_ledger", """
  m AS (SELECT product_id, order_id, order_date, CAST(-sum(quantity) AS BIGINT) AS quantity FROM sales GROUP BY 1, 2, 3)
  SELECT product_id, order_id, quantity,
         CAST(initial_stock + sum(quantity) OVER (PARTITION BY product_id ORDER BY order_date, order_id
              ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stock_after
  FROM m JOIN products USING (product_id)""")(_ledger)

query("dead_stock", _DEAD + " SELECT * FROM dead")(lambda t: ops.dead_stock(t.sales, t.products, 90, t.as_of))
query("dead_stock_actions", _DEAD + """
  SELECT recommended_action, count(*) AS products FROM dead GROUP BY 1""")(
    lambda t: ops.dead_stock(t.sales, t.products, 90, t.as_of).groupBy("recommended_action").agg(
        F.count(F.lit(1)).alias("products")))
query("dead_stock_action_docs", _LAST + f"""
  SELECT product_id, {_DAYS} AS days_since_sale,
         CASE WHEN {_DAYS} IS NULL OR {_DAYS} >= 270 THEN 'Liquidate or write off'
              WHEN {_DAYS} >= 180 THEN 'Deep discount or bundle' WHEN {_DAYS} >= 120 THEN 'Consider markdown/promotion'
              WHEN {_DAYS} >= 90 THEN 'Monitor closely' END AS action
  FROM catalog LEFT JOIN last_sales USING (product_id), clock""")(
    lambda t: t.catalog.join(ops.last_sale_dates(t.sales), "product_id", "left").select(
        "product_id", ops.whole_days(t.as_of, F.col("last_sale")).alias("days_since_sale")).withColumn(
        "action", ops.dead_stock_action_docs(F.col("days_since_sale"))))
# the test products all sell briskly, so a wider velocity limit gives the query rows
query("slow_moving", _SLOW.replace("LIMIT_V", "0.4").lstrip() + " SELECT * FROM slow")(
    lambda t: ops.slow_moving(t.sales, t.products, 0.4, 30, t.as_of))
query("dead_stock_summary", _DEAD + "," + _SLOW.replace("LIMIT_V", "0.4") + f""",
  s AS (SELECT (SELECT count(*) FROM products WHERE is_active AND current_stock > 0) AS total_active_products,
               (SELECT count(*) FROM dead) AS dead_count, (SELECT coalesce(sum(stock_value), 0) FROM dead) AS dv,
               (SELECT count(*) FROM slow) AS slow_count, (SELECT coalesce(sum(stock_value), 0) FROM slow) AS sv)
  SELECT total_active_products, dead_count, {R('dv')} AS dead_value, slow_count, {R('sv')} AS slow_value,
         {R('dead_count / total_active_products * 100', 1)} AS dead_pct,
         {R('slow_count / total_active_products * 100', 1)} AS slow_pct,
         {R('dv + sv')} AS at_risk_value, 90 AS threshold_days FROM s""")(
    lambda t: ops.dead_stock_summary(t.sales, t.products, 90, t.as_of, 0.4))
query("dead_stock_by_category", _DEAD + f"""
  SELECT coalesce(category, 'Unknown') AS category, count(*) AS product_count, {R('sum(stock_value)')} AS total_value,
         CAST(sum(current_stock) AS BIGINT) AS total_units FROM dead GROUP BY 1""")(
    lambda t: ops.dead_stock_by_category(t.sales, t.products, 90, t.as_of))
query("clearance_candidates", _DEAD + f""",
  c AS (SELECT *, CASE WHEN days_since_sale IS NULL OR days_since_sale > 180 THEN 70
                       WHEN days_since_sale > 120 THEN 50 ELSE 30 END AS suggested_discount
        FROM dead WHERE stock_value >= 100)
  SELECT *, {R('unit_price * (1 - suggested_discount / 100)')} AS clearance_price FROM c
  ORDER BY suggested_discount DESC, stock_value DESC, product_id LIMIT 50""")(
    lambda t: ops.clearance_candidates(t.sales, t.products, as_of=t.as_of))
_END = f"""
  ends AS (SELECT product_id, max(order_date) AS last_sale FROM sales GROUP BY 1),
  ended AS (SELECT products.*, {_DAYS} AS days FROM products LEFT JOIN ends USING (product_id), clock)"""
query("dead_stock_from_data_end", _END + f"""
  SELECT product_id, product_name, category, current_stock, days AS days_since_sale,
         {R('current_stock * coalesce(cost_price, 0)')} AS stock_value
  FROM ended WHERE current_stock > 0 AND (days IS NULL OR days >= 90)""")(
    lambda t: ops.dead_stock_from_data_end(t.sales, t.products, 90, t.as_of))
query("at_risk_60_90", _END + f"""
  SELECT category, count(*) FILTER (current_stock > 0) AS stocked,
         count(*) FILTER (current_stock > 0 AND (days IS NULL OR days >= 90)) AS dead,
         count(*) FILTER (days >= 60 AND days < 90) AS at_risk,
         {R('count(*) FILTER (current_stock > 0 AND (days IS NULL OR days >= 90)) / count(*) FILTER (current_stock > 0) * 100', 1)} AS dead_pct
  FROM ended GROUP BY 1""")(lambda t: ops.at_risk_60_90(t.sales, t.products, t.as_of))
query("never_sold_since", """
  SELECT product_id, product_name, category FROM catalog WHERE product_id NOT IN (
    SELECT product_id FROM sales, clock WHERE order_date >= now - INTERVAL 90 DAY)""")(
    lambda t: ops.never_sold_since(t.sales, t.catalog, 90, t.as_of))
query("stock_value", f"""
  s AS (SELECT count(*) AS total_products, count(*) FILTER (current_stock > 0) AS in_stock,
               count(*) FILTER (current_stock = 0) AS out_of_stock,
               count(*) FILTER (current_stock > 0 AND current_stock <= reorder_threshold) AS low_stock,
               {R('sum(current_stock * cost_price)')} AS inventory_value FROM products)
  SELECT *, {R('in_stock / total_products * 100', 1)} AS in_stock_pct,
         {R('out_of_stock / total_products * 100', 1)} AS out_of_stock_pct,
         {R('low_stock / total_products * 100', 1)} AS low_stock_pct FROM s""")(lambda t: ops.stock_value(t.products))
query("stock_status_counts", "SELECT stock_status, count(*) AS products FROM products GROUP BY 1")(
    lambda t: ops.stock_status_counts(t.products))

_PLAN = f"""
  pd AS (SELECT product_id, order_date, sum(quantity) AS q FROM sales GROUP BY 1, 2),
  ps AS (SELECT product_id, avg(q) AS mean, stddev_samp(q) AS std,
                sum(q) FILTER (order_date >= now - INTERVAL 30 DAY) AS q30,
                sum(q) FILTER (order_date >= now - INTERVAL 90 DAY) AS q90 FROM pd, clock GROUP BY 1),
  pb AS (SELECT products.*, coalesce(q30, 0) / 30 AS v30, coalesce(q90, 0) / 90 AS v90,
                coalesce(mean, 0) AS mean, coalesce(std, 0) AS std FROM products LEFT JOIN ps USING (product_id)),
  planned AS (
    SELECT *, CASE WHEN v30 > 0 THEN current_stock / v30 END AS cover, 1.65::DOUBLE * sqrt(7::DOUBLE) * std AS safety,
           {R('mean * 7 + 1.65::DOUBLE * sqrt(7::DOUBLE) * std', 0)} AS point,
           CASE WHEN mean > 0 AND cost_price > 0
                THEN {R('sqrt(2 * (mean * 365) * 50 / (cost_price * 0.25::DOUBLE))', 0)}
                ELSE CAST(reorder_quantity AS DOUBLE) END AS eoq FROM pb)"""
query("velocity_30_90", _PLAN + f"""
  SELECT product_id, current_stock, {R('v30', 4)} AS velocity_30d, {R('v90', 4)} AS velocity_90d,
         {R('cover')} AS days_of_stock FROM planned""")(lambda t: ops.velocity_30_90(t.sales, t.products, t.as_of))
query("demand_variability", _PLAN + f"""
  SELECT product_id, {R('mean', 4)} AS avg_daily_demand, {R('std', 4)} AS std_daily_demand FROM planned""")(
    lambda t: ops.demand_variability(t.sales, t.products, t.as_of))
query("reorder_point", _PLAN + f"""
  SELECT product_id, reorder_threshold, {R('safety', 4)} AS safety_stock, point AS optimal_reorder_point,
         point - reorder_threshold AS rop_gap, abs(point - reorder_threshold) > 5 AS needs_adjustment FROM planned""")(
    lambda t: ops.reorder_point(t.sales, t.products, t.as_of))
query("eoq", _PLAN + " SELECT product_id, reorder_quantity, eoq FROM planned")(
    lambda t: ops.eoq(t.sales, t.products, t.as_of))
query("stockout_risk", _PLAN + """
  SELECT CASE WHEN cover <= 7 THEN 'Critical' WHEN cover <= 14 THEN 'High' WHEN cover <= 28 THEN 'Medium'
              ELSE 'Low' END AS stockout_risk, count(*) AS products FROM planned GROUP BY 1""")(
    lambda t: ops.stockout_risk(t.sales, t.products, t.as_of))
query("turnover_days_of_stock", f"""
  span AS (SELECT greatest(datediff('day', min(order_date), max(order_date)), 1) AS days FROM sales),
  u AS (SELECT products.*, coalesce(units, 0) AS units FROM products
        LEFT JOIN (SELECT product_id, sum(quantity) AS units FROM sales GROUP BY 1) USING (product_id)),
  f AS (SELECT CASE WHEN current_stock > 0 THEN units / current_stock ELSE 0 END AS turnover,
               CASE WHEN units > 0 THEN current_stock * days / units END AS cover FROM u, span),
  l AS (SELECT 'turnover' AS measure, turnover AS x FROM f WHERE turnover > 0
        UNION ALL SELECT 'days_of_stock', cover FROM f WHERE cover > 0 AND cover < 365)
  SELECT measure, count(*) AS products, {R('avg(x)', 4)} AS mean, {R('quantile_cont(x, 0.5)', 4)} AS median,
         (SELECT count(*) FROM u WHERE units = 0) AS products_without_sales FROM l GROUP BY 1""")(
    lambda t: ops.turnover_days_of_stock(t.sales, t.products))
query("left_fill_metrics", f"""
  SELECT product_id, category, CAST(coalesce(sum(quantity), 0) AS BIGINT) AS units_sold,
         {R('coalesce(sum(total_amount), 0)')} AS revenue
  FROM catalog LEFT JOIN (SELECT product_id, quantity, total_amount FROM sales) USING (product_id) GROUP BY 1, 2""")(
    lambda t: ops.left_fill_metrics(t.sales, t.catalog))
query("enrich_by_lookup", f"""
  SELECT product_id, product_name, category, {R('r')} AS revenue
  FROM (SELECT product_id, sum(total_amount) AS r FROM sales GROUP BY 1) LEFT JOIN catalog USING (product_id)""")(
    lambda t: t.sales.groupBy("product_id").agg(F.sum("total_amount").alias("r")).join(
        t.catalog.select("product_id", "product_name", "category"), "product_id", "left").select(
        "product_id", "product_name", "category", ops.money("r").alias("revenue")))
query("dashboard_summary", _DEAD + f"""
  SELECT {R("coalesce(sum(total_amount) FILTER (order_date >= date_trunc('month', now)), 0)")} AS total_revenue_mtd,
         {R("coalesce(sum(total_amount) FILTER (order_date >= date_trunc('year', now)), 0)")} AS total_revenue_ytd,
         count(*) AS total_orders, {R('sum(total_amount) / count(*)')} AS avg_order_value,
         (SELECT count(*) FROM products WHERE is_active AND current_stock <= reorder_threshold) AS low_stock_alerts,
         (SELECT {R('coalesce(sum(stock_value), 0)')} FROM dead) AS dead_stock_value
  FROM sales, clock WHERE order_status = 'Delivered'""")(lambda t: ops.dashboard_summary(t.sales, t.products, t.as_of))
query("dashboard_top_products", f"""
  SELECT product_id, product_name, {R('sum(total_amount)')} AS revenue FROM sales JOIN catalog USING (product_id)
  WHERE order_status = 'Delivered' GROUP BY 1, 2 ORDER BY revenue DESC, product_id LIMIT 5""")(
    lambda t: top_products(t.sales, t.catalog, "revenue", 5).select("product_id", "product_name", F.col("value").alias("revenue")))
