"""Named customer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import customers as ops
from ..operators.sales import summary_stats
from .registry import query, rounded as R


def _scores(where: str, frequency: str, shift: str) -> str:
    return f"""
      b AS (SELECT customer_id, CAST(floor(epoch((SELECT now {shift} FROM clock) - max(order_date)) / 86400) AS INTEGER) AS recency,
                   {frequency} AS frequency, sum(total_amount) AS m FROM sales WHERE {where} GROUP BY 1),
      k AS (SELECT *, row_number() OVER (ORDER BY frequency, customer_id) AS fr,
                   row_number() OVER (ORDER BY m, customer_id) AS mr, count(*) OVER () AS n FROM b),
      e AS (SELECT quantile_cont(recency, [0.2, 0.4, 0.6, 0.8]) AS edges FROM b),
      s AS (SELECT customer_id, recency, frequency, {R('m')} AS monetary,
                   CAST(5 - len(list_filter(edges, lambda x: x < recency)) AS INTEGER) AS r_score,
                   CAST(greatest(1, ceil(5 * (fr - 1) / (n - 1))) AS INTEGER) AS f_score,
                   CAST(greatest(1, ceil(5 * (mr - 1) / (n - 1))) AS INTEGER) AS m_score FROM k, e),
      scores AS (SELECT *, r_score + f_score + m_score AS rfm_total,
                        r_score::VARCHAR || f_score::VARCHAR || m_score::VARCHAR AS rfm_score FROM s),
      seg AS (SELECT *,
        CASE WHEN rfm_total >= 12 THEN 'VIP' WHEN rfm_total >= 9 THEN 'Regular' WHEN rfm_total >= 6 THEN 'At-Risk'
             ELSE 'Lost' END AS segment_4,
        CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'Champions'
             WHEN r_score >= 4 AND f_score >= 3 THEN 'Loyal' WHEN r_score <= 2 AND f_score >= 3 THEN 'At Risk'
             WHEN r_score <= 2 AND f_score <= 2 THEN 'Lost' ELSE 'Others' END AS segment_5,
        CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'Champions'
             WHEN r_score >= 4 AND f_score >= 3 THEN 'Loyal Customers'
             WHEN r_score >= 3 AND f_score >= 1 AND m_score >= 4 THEN 'Potential Loyalists'
             WHEN r_score >= 4 AND f_score <= 2 THEN 'Recent Customers'
             WHEN r_score >= 3 AND f_score >= 3 AND m_score >= 3 THEN 'Promising'
             WHEN r_score <= 2 AND f_score >= 4 AND m_score >= 4 THEN 'At Risk'
             WHEN r_score <= 2 AND f_score >= 3 THEN 'Cant Lose Them'
             WHEN r_score <= 2 AND f_score <= 2 THEN 'Hibernating' ELSE 'Need Attention' END AS segment_9 FROM scores)"""


_ONLINE = _scores("order_status = 'Delivered'", "count(*)", "")
_STUDY = _scores("true", "count(DISTINCT order_id)", "+ INTERVAL 1 DAY")


def _online(t):
    return ops.with_segments(ops.rfm_scores(t.sales, t.as_of))


def _study(t):
    return ops.with_segments(ops.rfm_scores(t.sales, t.as_of + F.expr("INTERVAL 1 DAY"), False, True))


def _summary(segment: str) -> str:
    return f"""
      SELECT {segment} AS segment, count(*) AS customers, {R('avg(recency)')} AS avg_recency,
             {R('avg(frequency)')} AS avg_frequency, {R('avg(monetary)')} AS avg_monetary,
             {R('sum(monetary)')} AS total_monetary FROM seg GROUP BY 1"""


query("customer_ltv", f"""
  SELECT customer_id, {R('sum(total_amount)')} AS lifetime_value FROM sales
  WHERE order_status = 'Delivered' GROUP BY 1""")(lambda t: ops.customer_ltv(t.sales))
query("rfm_scores", _ONLINE + " SELECT * FROM scores")(lambda t: ops.rfm_scores(t.sales, t.as_of))
query("rfm_segments", _STUDY + " SELECT customer_id, rfm_score, segment_4, segment_5, segment_9 FROM seg")(
    lambda t: _study(t).select("customer_id", "rfm_score", "segment_4", "segment_5", "segment_9"))
query("rfm_segment_4", _ONLINE + _summary("segment_4"))(lambda t: ops.rfm_segment_summary(_online(t), "segment_4"))
query("rfm_segment_5", _STUDY + _summary("segment_5"))(lambda t: ops.rfm_segment_summary(_study(t), "segment_5"))
query("rfm_segment_9", _STUDY + _summary("segment_9"))(lambda t: ops.rfm_segment_summary(_study(t), "segment_9"))
query("rfm_heatmap", _STUDY + " SELECT r_score, " + ", ".join(
    R(f"avg(monetary) FILTER (f_score = {i})") + f" AS f{i}" for i in range(1, 6)) + " FROM seg GROUP BY 1")(
    lambda t: ops.rfm_heatmap(_study(t)))
query("customer_profile", f"""
  o AS (SELECT customer_id, count(*) AS n, sum(total_amount) AS v, max(order_date) AS last FROM sales
        WHERE order_status = 'Delivered' GROUP BY 1)
  SELECT customer_id, customer_name, customer_type, state, coalesce(n, 0) AS total_orders,
         {R('coalesce(v, 0)')} AS lifetime_value, {R('coalesce(v / n, 0)')} AS avg_order_value,
         CAST(last AS DATE) AS last_purchase_date FROM customers LEFT JOIN o USING (customer_id)""")(
    lambda t: ops.customer_profile(t.sales, t.customers))
_CUST = """
  cs AS (SELECT customer_id, count(DISTINCT order_id) AS orders, sum(total_amount) AS spent, sum(profit) AS profit,
                CAST(sum(quantity) AS BIGINT) AS items, CAST(min(order_date) AS DATE) AS first_order,
                CAST(max(order_date) AS DATE) AS last_order FROM sales GROUP BY 1)"""
query("customer_summary", _CUST + f"""
  SELECT customer_id, orders, {R('spent')} AS total_spent, {R('profit')} AS total_profit, items AS total_items,
         first_order, last_order, {R('spent / orders')} AS avg_order_value FROM cs""")(
    lambda t: ops.customer_summary(t.sales).select(
        "customer_id", "orders", ops.money("total_spent").alias("total_spent"),
        ops.money("total_profit").alias("total_profit"), "total_items", "first_order", "last_order",
        ops.money("avg_order_value").alias("avg_order_value")))
query("customer_summary_stats", _CUST + " , cv AS (SELECT spent AS total_spent, orders, spent / orders AS avg_order_value FROM cs) "
      + " UNION ALL ".join(f"""
  SELECT '{c}' AS measure, count({c}) AS count, {R(f'avg({c})', 4)} AS mean, {R(f'stddev_samp({c})', 4)} AS std,
         {R(f'min({c})', 4)} AS min, {R(f'max({c})', 4)} AS max, {R(f'quantile_cont({c}, 0.25)', 4)} AS q25,
         {R(f'quantile_cont({c}, 0.5)', 4)} AS median, {R(f'quantile_cont({c}, 0.75)', 4)} AS q75 FROM cv"""
                           for c in ("total_spent", "orders", "avg_order_value")))(
    lambda t: summary_stats(ops.customer_summary(t.sales), ["total_spent", "orders", "avg_order_value"]))
query("clv_score", _CUST + f"""
  SELECT customer_id, orders, {R('spent')} AS total_spent, CAST(last_order - first_order AS INTEGER) AS lifetime_days,
         {R('spent * (orders / (CASE WHEN last_order = first_order THEN 1 ELSE last_order - first_order END / 365))')} AS clv_score
  FROM cs ORDER BY total_spent DESC, customer_id LIMIT 20""")(lambda t: ops.clv_score(t.sales))
_CPARETO = f"""
  sp AS (SELECT customer_id, sum(total_amount) AS spent FROM sales GROUP BY 1),
  cp AS (SELECT customer_id, {R('spent')} AS total_spent, row_number() OVER w AS rank,
                {R('sum(spent) OVER w / sum(spent) OVER () * 100', 4)} AS cumulative_pct,
                {R('row_number() OVER w / count(*) OVER () * 100', 4)} AS customer_pct
         FROM sp WINDOW w AS (ORDER BY spent DESC, customer_id ROWS UNBOUNDED PRECEDING))"""
query("customer_pareto", _CPARETO + " SELECT * FROM cp")(lambda t: ops.customer_pareto(t.sales))
query("customer_pareto_80", _CPARETO + " SELECT min(customer_pct) AS customer_pct FROM cp WHERE cumulative_pct >= 80")(
    lambda t: ops.customers_for_share(ops.customer_pareto(t.sales)))
query("cohort_retention", f"""
  cm AS (SELECT DISTINCT customer_id, date_trunc('month', order_date) AS m FROM orders_c),
  fm AS (SELECT customer_id, min(m) AS c FROM cm GROUP BY 1),
  ci AS (SELECT c, CAST(datediff('month', c, m) AS INTEGER) AS i, count(*) AS n FROM cm JOIN fm USING (customer_id) GROUP BY 1, 2),
  cz AS (SELECT c, n AS z FROM ci WHERE i = 0)
  SELECT strftime(c, '%Y-%m') AS cohort_month, i AS month_index, n AS customers, z AS cohort_size,
         {R('n / z * 100')} AS retention_pct FROM ci JOIN cz USING (c)""")(lambda t: ops.cohort_retention(t.orders))
