"""Named sales, product and category queries."""

from __future__ import annotations

from ..operators import sales as ops
from ..operators.ordered import materialise
from .registry import query, rounded as R

YEAR, MONTH = 1998, 6


def _top(metric: str, source: str) -> str:
    return f"""
      SELECT product_id, product_name, category, {R(f'CAST(sum({source}) AS DOUBLE)')} AS value
      FROM sales JOIN catalog USING (product_id) WHERE order_status = 'Delivered'
      GROUP BY ALL ORDER BY value DESC, product_id LIMIT 10"""


for _metric, _source in ops.METRIC_COLUMNS.items():
    query(f"top_products_{_metric}", _top(_metric, _source))(
        lambda t, m=_metric: ops.top_products(t.sales, t.catalog, m))

query("top_products_velocity", f"""
  SELECT product_id, product_name, category, {R('coalesce(sold, 0) / 30')} AS value
  FROM catalog LEFT JOIN (
    SELECT product_id, sum(quantity) AS sold FROM sales, clock
    WHERE order_status <> 'Cancelled' AND order_date >= now - INTERVAL 30 DAY GROUP BY 1) USING (product_id)
  ORDER BY value DESC, product_id LIMIT 10""")(
    lambda t: ops.top_products(t.sales, t.catalog, "velocity", as_of=t.as_of))


def _trend(label: str, days: int) -> str:
    return f"""
      SELECT strftime(order_date, '{label}') AS period, {R('sum(total_amount)')} AS total_sales,
             count(*) AS order_rows, {R('sum(profit)')} AS total_profit,
             {R('avg(total_amount)')} AS avg_order_value
      FROM sales, clock WHERE order_status = 'Delivered' AND order_date >= now - INTERVAL {days} DAY GROUP BY 1"""


for _period, _label, _days in (("daily", "%Y-%m-%d", 30), ("weekly", "%Y-%W", 365), ("monthly", "%Y-%m", 365)):
    query(f"sales_trends_{_period}", _trend(_label, _days))(
        lambda t, p=_period, d=_days: ops.sales_trends(t.sales, p, d, t.as_of))

query("sales_trends_all_status", f"""
  SELECT strftime(order_date, '%Y-%m-%d') AS period, {R('sum(total_amount)')} AS total_sales,
         count(*) AS order_rows, {R('avg(total_amount)')} AS avg_order_value
  FROM sales, clock WHERE order_date >= now - INTERVAL 30 DAY GROUP BY 1""")(
    lambda t: ops.sales_trends_all_status(t.sales, 30, t.as_of))

_MONTHLY = f"""
  m AS (SELECT strftime(order_date, '%Y-%m') AS month, sum(total_amount) AS r, sum(profit) AS p,
               count(*) AS n, CAST(sum(quantity) AS BIGINT) AS u
        FROM sales WHERE order_status = 'Delivered' GROUP BY 1 ORDER BY 1 DESC LIMIT 12),
  g AS (SELECT *, lag(r) OVER (ORDER BY month) AS pr, lag(p) OVER (ORDER BY month) AS pp FROM m),
  trend AS (
    SELECT month, {R('r')} AS revenue, {R('p')} AS profit,
           CASE WHEN p < 0 THEN {R('-p')} ELSE 0 END AS loss,
           CASE WHEN r > 0 THEN {R('p / r * 100')} ELSE 0 END AS profit_margin,
           n AS order_rows, u AS units_sold, {R('r / n')} AS avg_order_value,
           CASE WHEN pr > 0 THEN {R('(r - pr) / pr * 100')} END AS revenue_growth_pct,
           CASE WHEN pp <> 0 THEN {R('(p - pp) / abs(pp) * 100')} END AS profit_growth_pct FROM g)"""
query("monthly_sales_trend", _MONTHLY + " SELECT * FROM trend")(lambda t: ops.monthly_sales_trend(t.sales))
query("monthly_summary", _MONTHLY + f"""
  SELECT {R('sum(revenue)')} AS total_revenue, {R('sum(profit)')} AS total_profit,
         {R('sum(revenue) / count(*)')} AS avg_monthly_revenue,
         {R('sum(profit) / sum(revenue) * 100')} AS avg_profit_margin, count(*) AS months_analyzed
  FROM trend""")(lambda t: ops.monthly_summary(t.sales))

_IN_MONTH = """order_status = 'Delivered' AND order_date >= DATE '1998-06-01' AND order_date < DATE '1998-07-01'"""
_PAIR = """
  pair AS (
    SELECT sum(total_amount) FILTER (m6) AS r, sum(profit) FILTER (m6) AS p,
           CAST(sum(quantity) FILTER (m6) AS BIGINT) AS u, count(*) FILTER (m6) AS n,
           sum(total_amount) FILTER (NOT m6) AS pr, sum(profit) FILTER (NOT m6) AS pp
    FROM (SELECT *, order_date >= DATE '1998-06-01' AS m6 FROM sales
          WHERE order_status = 'Delivered' AND order_date >= DATE '1998-05-01'
            AND order_date < DATE '1998-07-01'))"""
query("monthly_report_summary", _PAIR + f"""
  SELECT 1998 AS year, 6 AS month, 'June' AS month_name, {R('r')} AS total_revenue, {R('p')} AS total_profit,
         CASE WHEN p < 0 THEN {R('-p')} ELSE 0 END AS total_loss, {R('p / r * 100')} AS profit_margin,
         n AS total_orders, u AS total_units_sold, {R('r / n')} AS avg_order_value,
         {R('r - pr')} AS revenue_change, {R('(r - pr) / pr * 100')} AS revenue_growth_pct,
         {R('p - pp')} AS profit_change, {R('(p - pp) / abs(pp) * 100')} AS profit_growth_pct,
         {R('pr')} AS prev_month_revenue, {R('pp')} AS prev_month_profit
  FROM pair""")(lambda t: ops.monthly_report_summary(t.sales, YEAR, MONTH))

for _name, _dir, _best in (("monthly_report_top", "DESC", True), ("monthly_report_worst", "ASC", False)):
    query(_name, f"""
      SELECT product_id, product_name, category, {R('sum(total_amount)')} AS revenue,
             {R('sum(profit)')} AS profit, CAST(sum(quantity) AS BIGINT) AS units_sold
      FROM sales JOIN catalog USING (product_id) WHERE {_IN_MONTH}
      GROUP BY product_id, product_name, category ORDER BY revenue {_dir}, product_id LIMIT 10""")(
        lambda t, b=_best: ops.monthly_report_products(t.sales, t.catalog, YEAR, MONTH, b))

query("monthly_report_categories", f"""
  c AS (SELECT category, sum(total_amount) AS r, sum(profit) AS p, count(*) AS orders
        FROM sales JOIN catalog USING (product_id) WHERE {_IN_MONTH} GROUP BY 1)
  SELECT category, {R('r')} AS revenue, {R('p')} AS profit, orders,
         {R('r / sum(r) OVER () * 100')} AS revenue_share FROM c""")(
    lambda t: ops.monthly_report_categories(t.sales, t.catalog, YEAR, MONTH))
query("monthly_report_daily", f"""
  SELECT CAST(order_date AS DATE) AS date, {R('sum(total_amount)')} AS revenue,
         {R('sum(profit)')} AS profit, count(*) AS orders
  FROM sales WHERE {_IN_MONTH} GROUP BY 1""")(lambda t: ops.monthly_report_daily(t.sales, YEAR, MONTH))
query("monthly_report_advice", _PAIR + f""",
  gr AS (SELECT p, (r - pr) / pr * 100 AS g FROM pair),
  lead_product AS (SELECT product_id, any_value(product_name) AS product_name, {R('sum(total_amount)')} AS revenue
         FROM sales JOIN catalog USING (product_id) WHERE {_IN_MONTH}
         GROUP BY product_id ORDER BY revenue DESC, product_id LIMIT 1)
  SELECT 'critical' AS type, format('Month operated at a loss of ${{:,.2f}}. Review pricing and costs.', {R('-p')}) AS message
  FROM gr WHERE p < 0
  UNION ALL SELECT 'warning', format('Revenue declined {{:,.1f}}% from previous month. Consider promotional activities.', {R('abs(g)', 1)})
  FROM gr WHERE g < -10
  UNION ALL SELECT 'success', format('Strong revenue growth of {{:,.1f}}%. Consider increasing inventory for top performers.', {R('g', 1)})
  FROM gr WHERE g > 20
  UNION ALL SELECT 'info', format('Top performer: {{}} generated ${{:,.2f}} revenue.', product_name, revenue)
  FROM lead_product""")(lambda t: ops.monthly_report_advice(t.sales, t.catalog, YEAR, MONTH))

_PERF = f"""
  perf AS (
    SELECT product_id, any_value(product_name) AS product_name, any_value(category) AS category,
           sum(total_amount) AS raw_revenue, {R('sum(total_amount)')} AS revenue, {R('sum(profit)')} AS profit,
           CAST(sum(quantity) AS BIGINT) AS units_sold,
           {R('sum(profit) / sum(total_amount) * 100')} AS profit_margin,
           {R('sum(profit) / sum(total_amount) * 100', 6)} AS margin, count(*) AS order_rows
    FROM sales JOIN catalog USING (product_id) WHERE order_status = 'Delivered' GROUP BY product_id)"""


def _ranked(order_best: str, order_worst: str, best: str = "true", worst: str = "true") -> str:
    return _PERF + f"""
      SELECT * EXCLUDE (raw_revenue, margin) FROM (
        (SELECT 'best' AS ranking, * FROM perf WHERE {best} ORDER BY {order_best} DESC, product_id LIMIT 10)
        UNION ALL
        (SELECT 'worst' AS ranking, * FROM perf WHERE {worst} ORDER BY {order_worst}, product_id LIMIT 10))"""


query("product_performance", _ranked("revenue", "revenue"))(lambda t: ops.product_performance(t.sales, t.catalog))
query("margin_performance", _ranked("margin", "margin", "raw_revenue > 1000", "raw_revenue > 100"))(
    lambda t: ops.margin_performance(t.sales, t.catalog))

query("performance_advice", _PERF + """,
  shown AS (
    (SELECT 'best_performers' AS topic FROM perf LIMIT 10) UNION ALL (SELECT 'worst_performers' FROM perf LIMIT 10)
    UNION ALL (SELECT 'margin_optimization' FROM perf WHERE raw_revenue > 1000 LIMIT 10)
    UNION ALL (SELECT 'margin_optimization' FROM perf WHERE raw_revenue > 100 LIMIT 10)),
  counted AS (SELECT topic, CAST(count(*) AS INTEGER) AS n FROM shown GROUP BY 1)
  SELECT topic, item, advice, coalesce(n, 0) AS n FROM (VALUES """ + ", ".join(
    f"('{kind}', {i + 1}, '{text}')" for kind, texts in ops.PERFORMANCE_ADVICE.items() for i, text in enumerate(texts))
    + ") v(topic, item, advice) LEFT JOIN counted USING (topic)")(
    lambda t: ops.performance_advice(ops.product_performance(t.sales, t.catalog), ops.margin_performance(t.sales, t.catalog))
    .withColumnRenamed("products", "n").withColumn("n", ops.F.col("n").cast("int")))

query("category_performance", f"""
  c AS (SELECT category, sum(total_amount) AS r, sum(profit) AS p, CAST(sum(quantity) AS BIGINT) AS units_sold,
               count(*) AS order_rows, count(DISTINCT product_id) AS product_count
        FROM sales JOIN catalog USING (product_id) WHERE order_status = 'Delivered' GROUP BY 1)
  SELECT category, {R('r')} AS revenue, {R('p')} AS profit, units_sold, order_rows, product_count,
         {R('r / sum(r) OVER () * 100')} AS revenue_share,
         CASE WHEN sum(p) OVER () > 0 THEN {R('p / sum(p) OVER () * 100')} ELSE 0 END AS profit_share,
         {R('p / r * 100')} AS profit_margin, {R('r / order_rows')} AS avg_order_value FROM c""")(
    lambda t: ops.category_performance(t.sales, t.catalog))
query("sales_by_dow", f"""
  SELECT CAST(dayofweek(order_date) AS INTEGER) AS day_number, dayname(order_date) AS day,
         {R('sum(total_amount)')} AS revenue, {R('sum(profit)')} AS profit, count(*) AS order_rows,
         {R('avg(total_amount)')} AS avg_order_value
  FROM sales WHERE order_status = 'Delivered' GROUP BY 1, 2""")(lambda t: ops.sales_by_dow(t.sales))
query("revenue_profit_trend", f"""
  SELECT strftime(order_date, '%Y-%m') AS period, {R('sum(total_amount)')} AS revenue, {R('sum(profit)')} AS profit,
         {R('sum(profit) / sum(total_amount) * 100')} AS profit_margin, count(*) AS orders
  FROM sales WHERE order_status = 'Delivered' GROUP BY 1 ORDER BY 1 DESC LIMIT 30""")(
    lambda t: ops.revenue_profit_trend(t.sales))
query("available_months", f"""
  SELECT CAST(year(order_date) AS INTEGER) AS year, CAST(month(order_date) AS INTEGER) AS month,
         count(*) AS order_rows, {R('sum(total_amount)')} AS revenue, monthname(any_value(order_date)) AS month_name,
         monthname(any_value(order_date)) || ' ' || year(any_value(order_date)) AS display
  FROM sales WHERE order_status = 'Delivered' GROUP BY 1, 2""")(lambda t: ops.available_months(t.sales))
query("dataset_overview", """
  SELECT count(*) AS order_rows, count(DISTINCT customer_id) AS unique_customers,
         CAST(min(order_date) AS DATE) AS first_date, CAST(max(order_date) AS DATE) AS last_date,
         CAST(datediff('day', min(order_date), max(order_date)) AS INTEGER) AS duration_days,
         (SELECT count(DISTINCT product_id) FROM items) AS unique_products,
         (SELECT count(DISTINCT seller_id) FROM items) AS unique_sellers,
         (SELECT count(DISTINCT category) FROM catalog) AS categories FROM orders_c""")(
    lambda t: ops.dataset_overview(t.orders, t.order_items, t.catalog))


def _counts(table: str, column: str, limit: str = "") -> str:
    return f"""
      SELECT {column} AS value, count(*) AS rows, {R('count(*) / sum(count(*)) OVER () * 100')} AS pct
      FROM {table} WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY rows DESC, value {limit}"""


query("value_counts_status", _counts("orders_c", "order_status"))(lambda t: ops.value_counts(t.orders, "order_status"))
query("value_counts_payment", _counts("orders_c", "payment_method"))(
    lambda t: ops.value_counts(t.orders, "payment_method"))
query("value_counts_category", _counts("catalog", "category"))(lambda t: ops.value_counts(t.catalog, "category"))
query("value_counts_customer_type", _counts("customers", "customer_type"))(
    lambda t: ops.value_counts(t.customers, "customer_type"))
query("value_counts_state", _counts("customers", "state", "LIMIT 10"))(
    lambda t: ops.value_counts(t.customers, "state", 10))

query("histogram", f"""
  b AS (SELECT min(total_amount) AS lo, max(total_amount) AS hi FROM items)
  SELECT CAST(least(floor((total_amount - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS rows,
         {R('any_value(lo) + least(floor((total_amount - lo) / ((hi - lo) / 20)), 19) * ((any_value(hi) - any_value(lo)) / 20)', 4)} AS bin_start,
         {R('any_value(lo) + (least(floor((total_amount - lo) / ((hi - lo) / 20)), 19) + 1) * ((any_value(hi) - any_value(lo)) / 20)', 4)} AS bin_end
  FROM items, b GROUP BY least(floor((total_amount - lo) / ((hi - lo) / 20)), 19)""")(
    lambda t: ops.histogram(t.order_items, "total_amount", 20))

_STATS = ["quantity", "unit_price", "total_amount", "profit", "profit_margin"]
query("summary_stats", " UNION ALL ".join(f"""
  SELECT '{c}' AS measure, count({c}) AS count, {R(f'avg({c})', 4)} AS mean, {R(f'stddev_samp({c})', 4)} AS std,
         {R(f'min({c})', 4)} AS min, {R(f'max({c})', 4)} AS max, {R(f'quantile_cont({c}, 0.25)', 4)} AS q25,
         {R(f'quantile_cont({c}, 0.5)', 4)} AS median, {R(f'quantile_cont({c}, 0.75)', 4)} AS q75
  FROM sales""" for c in _STATS))(lambda t: ops.summary_stats(materialise(t.sales.select(*_STATS)), _STATS))

_CORR = ["quantity", "unit_price", "discount", "tax", "total_amount", "profit"]
query("correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS left, '{b}' AS right, {R(f'corr({a}, {b})', 4)} AS corr FROM items"
    for a in _CORR for b in _CORR))(lambda t: ops.correlation_matrix(t.order_items, _CORR))

query("category_totals", f"""
  SELECT category, {R('sum(total_amount)')} AS revenue, {R('sum(profit)')} AS profit, count(*) AS order_rows,
         CAST(sum(quantity) AS BIGINT) AS units FROM sales JOIN catalog USING (product_id) GROUP BY 1""")(
    lambda t: ops.category_totals(t.sales, t.catalog))

_DAILY = """
  d AS (SELECT CAST(order_date AS DATE) AS date, count(DISTINCT order_id) AS orders, sum(total_amount) AS revenue,
               CAST(sum(quantity) AS BIGINT) AS units, sum(profit) AS profit FROM sales GROUP BY 1)"""


def _ma(size: int) -> str:
    frame = f"OVER (ORDER BY date ROWS {size - 1} PRECEDING)"
    return f"CASE WHEN count(*) {frame} = {size} THEN {R(f'avg(revenue) {frame}')} END AS revenue_ma{size}"


query("daily_stats_ma", _DAILY + f"""
  SELECT date, orders, {R('revenue')} AS revenue, {R('profit')} AS profit, {_ma(7)}, {_ma(30)} FROM d""")(
    lambda t: ops.daily_stats_ma(t.sales))
query("monthly_stats", f"""
  SELECT strftime(order_date, '%Y-%m') AS month, count(DISTINCT order_id) AS orders,
         count(DISTINCT customer_id) AS customers, {R('sum(total_amount)')} AS revenue,
         {R('sum(profit)')} AS profit FROM sales GROUP BY 1""")(lambda t: ops.monthly_stats(t.sales))

_RESAMPLED = _DAILY + f""",
  w AS (SELECT CAST(unnest(generate_series(date_trunc('week', min(date)), date_trunc('week', max(date)), INTERVAL 7 DAY)) AS DATE) + 6 AS period_end FROM d),
  mm AS (SELECT last_day(unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)), INTERVAL 1 MONTH))) AS period_end FROM d),
  dw AS (SELECT CAST(date_trunc('week', date) AS DATE) + 6 AS period_end, sum(orders) AS orders, sum(revenue) AS revenue, sum(units) AS units, sum(profit) AS profit FROM d GROUP BY 1),
  dm AS (SELECT last_day(date) AS period_end, sum(orders) AS orders, sum(revenue) AS revenue, sum(units) AS units, sum(profit) AS profit FROM d GROUP BY 1),
  resampled AS (
    SELECT 'week' AS grain, w.period_end, CAST(coalesce(orders, 0) AS BIGINT) AS orders, {R('coalesce(revenue, 0)')} AS revenue,
           CAST(coalesce(units, 0) AS BIGINT) AS units, {R('coalesce(profit, 0)')} AS profit FROM w LEFT JOIN dw USING (period_end)
    UNION ALL
    SELECT 'month', mm.period_end, CAST(coalesce(orders, 0) AS BIGINT), {R('coalesce(revenue, 0)')},
           CAST(coalesce(units, 0) AS BIGINT), {R('coalesce(profit, 0)')} FROM mm LEFT JOIN dm USING (period_end))"""
query("weekly_monthly_resample", _RESAMPLED + " SELECT * FROM resampled")(
    lambda t: ops.weekly_monthly_resample(t.sales))

query("seasonality_profile", "s AS (SELECT 'weekday' AS part, dayname(order_date) AS value, total_amount FROM sales "
      "UNION ALL SELECT 'month', monthname(order_date), total_amount FROM sales "
      "UNION ALL SELECT 'quarter', CAST(quarter(order_date) AS VARCHAR), total_amount FROM sales) "
      f"SELECT part, value, {R('sum(total_amount)')} AS revenue, count(*) AS order_rows, "
      f"{R('avg(total_amount)')} AS avg_revenue FROM s GROUP BY 1, 2")(lambda t: ops.seasonality_profile(t.sales))
query("seasonal_pattern_means", f"""
  SELECT 'hour' AS part, CAST(hour(order_date) AS INTEGER) AS value, {R('avg(quantity)', 4)} AS mean_quantity FROM sales GROUP BY 2
  UNION ALL SELECT 'weekday', CAST(isodow(order_date) - 1 AS INTEGER), {R('avg(quantity)', 4)} FROM sales GROUP BY 2""")(
    lambda t: ops.seasonal_pattern_means(t.sales))
query("mom_growth_cumulative", _RESAMPLED + f""",
  m AS (SELECT *, lag(revenue) OVER o AS pr, lag(orders) OVER o AS po,
               sum(revenue) OVER (ORDER BY period_end ROWS UNBOUNDED PRECEDING) AS running
        FROM resampled WHERE grain = 'month' WINDOW o AS (ORDER BY period_end))
  SELECT period_end, orders, revenue, CASE WHEN pr <> 0 THEN {R('(revenue - pr) / pr * 100')} END AS revenue_growth,
         CASE WHEN po <> 0 THEN {R('(orders - po) / po * 100')} END AS orders_growth, {R('running')} AS cumulative_revenue,
         revenue = (SELECT max(revenue) FROM m) AS is_best, revenue = (SELECT min(revenue) FROM m) AS is_worst FROM m""")(
    lambda t: ops.mom_growth_cumulative(t.sales))


def _category_months(t):
    """The pivot over every category of the product dimension, shown in long form."""
    names = sorted(r[0] for r in t.catalog.select("category").distinct().collect())  # one row per category
    return ops.category_month_pivot(t.sales, t.catalog, names).unpivot(["month"], names, "category", "revenue")


query("category_month_pivot", f"""
  m AS (SELECT DISTINCT strftime(order_date, '%Y-%m') AS month FROM sales JOIN catalog USING (product_id)),
  c AS (SELECT DISTINCT category FROM catalog),
  r AS (SELECT strftime(order_date, '%Y-%m') AS month, category, sum(total_amount) AS revenue
        FROM sales JOIN catalog USING (product_id) GROUP BY 1, 2)
  SELECT month, category, {R('coalesce(revenue, 0)')} AS revenue FROM m CROSS JOIN c LEFT JOIN r USING (month, category)""")(
    _category_months)
query("top_categories", f"""
  SELECT category, {R('sum(total_amount)')} AS revenue FROM sales JOIN catalog USING (product_id)
  GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")(lambda t: ops.top_categories(t.sales, t.catalog))
query("category_half_growth", f"""
  cm AS (SELECT category, strftime(order_date, '%Y-%m') AS month, sum(total_amount) AS revenue
         FROM sales JOIN catalog USING (product_id) GROUP BY 1, 2),
  h AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY month) AS k,
               count(*) OVER (PARTITION BY category) AS n FROM cm),
  s AS (SELECT category, max(n) AS months, avg(revenue) FILTER (k <= n // 2) AS a,
               avg(revenue) FILTER (k > n // 2) AS b FROM h GROUP BY 1)
  SELECT category, months, CASE WHEN months >= 2 AND a > 0 THEN {R('(b - a) / a * 100')} ELSE 0 END AS growth_pct FROM s""")(
    lambda t: ops.category_half_growth(t.sales, t.catalog))
query("linear_trend_of_months", _RESAMPLED + f""",
  m AS (SELECT revenue, row_number() OVER (ORDER BY period_end) - 1 AS x FROM resampled WHERE grain = 'month')
  SELECT {R('regr_slope(revenue, x)')} AS slope, {R('regr_intercept(revenue, x)')} AS intercept,
         {R('regr_r2(revenue, x)', 4)} AS r2,
         CASE WHEN regr_slope(revenue, x) > 0 THEN 'Upward' ELSE 'Downward' END AS direction FROM m""")(
    lambda t: ops.linear_trend_of_months(t.sales))

_ROLLUP = """
  rollup_c AS (
    SELECT product_id, any_value(category) AS category, any_value(brand) AS brand, sum(total_amount) AS revenue,
           sum(profit) AS profit, CAST(sum(quantity) AS BIGINT) AS units, count(DISTINCT order_id) AS orders,
           avg(profit_margin) AS avg_margin
    FROM sales JOIN catalog USING (product_id) GROUP BY product_id)"""
query("product_rollup", _ROLLUP + f"""
  SELECT product_id, category, brand, {R('revenue')} AS revenue, {R('profit')} AS profit, units, orders,
         {R('avg_margin')} AS avg_margin FROM rollup_c""")(
    lambda t: ops.product_rollup(t.sales, t.catalog).select(
        "product_id", "category", "brand", ops.money("revenue").alias("revenue"), ops.money("profit").alias("profit"),
        "units", "orders", ops.rnd("avg_margin", 2).alias("avg_margin")))
query("category_profitability", _ROLLUP + f"""
  SELECT category, {R('sum(revenue)')} AS revenue, {R('sum(profit)')} AS profit, CAST(sum(units) AS BIGINT) AS units,
         count(*) AS product_count, {R('avg(avg_margin)')} AS avg_margin,
         {R('sum(profit) / count(*)')} AS profit_per_product FROM rollup_c GROUP BY 1""")(
    lambda t: ops.category_profitability(t.sales, t.catalog))
query("brand_performance", _ROLLUP + f"""
  SELECT brand, {R('sum(revenue)')} AS revenue, {R('sum(profit)')} AS profit, CAST(sum(units) AS BIGINT) AS units,
         count(*) AS product_count, {R('avg(avg_margin)')} AS avg_margin
  FROM rollup_c GROUP BY 1 ORDER BY revenue DESC, brand LIMIT 15""")(
    lambda t: ops.brand_performance(t.sales, t.catalog))
query("price_volume", f"""
  SELECT product_id, any_value(category) AS category, {R('avg(sales.unit_price)')} AS avg_price,
         CAST(sum(quantity) AS BIGINT) AS units FROM sales JOIN catalog USING (product_id) GROUP BY product_id""")(
    lambda t: ops.price_volume(t.sales, t.catalog))
query("sales_fact", f"""
  SELECT order_id, line_no, product_id, customer_id, quantity, {R('total_amount')} AS total_amount, order_status FROM sales""")(
    lambda t: ops.sales_fact(t.orders, t.order_items).select(
        "order_id", "line_no", "product_id", "customer_id", "quantity",
        ops.money("total_amount").alias("total_amount"), "order_status"))
query("sales_product_fact", f"""
  SELECT category, brand, order_status, count(*) AS rows, {R('sum(total_amount)')} AS revenue
  FROM sales LEFT JOIN products USING (product_id) GROUP BY 1, 2, 3""")(
    lambda t: ops.sales_product_fact(t.sales, t.products, "left").groupBy("category", "brand", "order_status").agg(
        ops.F.count(ops.F.lit(1)).alias("rows"), ops.money(ops.F.sum("total_amount")).alias("revenue")))
query("browse_orders_page", """
  SELECT order_id, CAST(order_date AS DATE) AS order_date, customer_id, order_status FROM orders_c
  ORDER BY order_id LIMIT 100 OFFSET 200""")(
    lambda t: ops.browse_page(t.orders.select(
        "order_id", ops.F.to_date("order_date").alias("order_date"), "customer_id", "order_status"),
        ["order_id"], 200, 100))
query("lookup_by_key", "SELECT order_id, customer_id, order_status FROM orders_c WHERE customer_id = 42")(
    lambda t: ops.lookup_by_key(t.orders.select("order_id", "customer_id", "order_status"), "customer_id", 42))
query("browse_recent_orders", """
  SELECT order_id, CAST(order_date AS DATE) AS order_date, customer_id FROM orders_c
  ORDER BY 2 DESC, 1 LIMIT 10""")(
    lambda t: ops.browse_page(t.orders.select(
        "order_id", ops.F.to_date("order_date").alias("order_date"), "customer_id"),
        [ops.F.desc("order_date"), "order_id"], 0, 10))
