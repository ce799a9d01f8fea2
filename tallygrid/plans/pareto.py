"""Named ABC and Pareto queries."""

from __future__ import annotations

from ..operators import pareto as ops
from .registry import query, rounded as R

_CLASS = "CASE WHEN {0} <= 80 THEN 'A' WHEN {0} <= 95 THEN 'B' ELSE 'C' END"
_ABC = f"""
  pr AS (SELECT product_id, sum(total_amount) AS r, CAST(sum(quantity) AS BIGINT) AS total_quantity
         FROM sales WHERE order_status = 'Delivered' GROUP BY 1),
  shares AS (SELECT *, CAST(round({R('r / sum(r) OVER () * 100')} * 100) AS BIGINT) AS h FROM pr),
  ranked AS (SELECT *, CAST(sum(h) OVER w AS BIGINT) / 100 AS cumulative_pct, row_number() OVER w AS rank FROM shares
             WINDOW w AS (ORDER BY r DESC, product_id ROWS UNBOUNDED PRECEDING)),
  abc AS (SELECT product_id, product_name, category, {R('r')} AS total_revenue, total_quantity, h / 100 AS revenue_pct,
                 cumulative_pct, {_CLASS.format('cumulative_pct')} AS abc_class, rank
          FROM ranked LEFT JOIN catalog USING (product_id))"""
_SUMMARY = _ABC + f""",
  summary AS (
    SELECT k.abc_class, count(product_id) AS product_count,
           {R('count(product_id) / (SELECT count(*) FROM abc) * 100', 1)} AS product_pct,
           {R('coalesce(sum(total_revenue), 0)')} AS total_revenue, {R('coalesce(sum(revenue_pct), 0)', 1)} AS revenue_pct,
           CAST(coalesce(sum(total_quantity), 0) AS BIGINT) AS total_quantity,
           {R('sum(total_revenue) / count(product_id)')} AS avg_revenue_per_product
    FROM (SELECT unnest(['A', 'B', 'C']) AS abc_class) k LEFT JOIN abc USING (abc_class) GROUP BY 1)"""
_EXACT = f"""
  pe AS (SELECT product_id, any_value(category) AS category, any_value(brand) AS brand, sum(total_amount) AS revenue,
                sum(profit) AS profit, CAST(sum(quantity) AS BIGINT) AS units
         FROM sales JOIN catalog USING (product_id) GROUP BY product_id),
  ce AS (SELECT *, sum(revenue) OVER w / sum(revenue) OVER () * 100 AS cum, row_number() OVER w AS rk,
                count(*) OVER () AS n, sum(units) OVER v / sum(units) OVER () * 100 AS vcum FROM pe
         WINDOW w AS (ORDER BY revenue DESC, product_id ROWS UNBOUNDED PRECEDING),
                v AS (ORDER BY units DESC, product_id ROWS UNBOUNDED PRECEDING)),
  exact AS (SELECT *, {_CLASS.format('cum')} AS abc_class, {_CLASS.format('vcum')} AS volume_class FROM ce)"""


def _analysis(t):
    return ops.abc_analysis(t.sales, t.catalog)


def _exact(t):
    return ops.abc_exact(t.sales, t.catalog)


query("abc_product_revenue", _ABC + """
  SELECT product_id, product_name, category, total_revenue, total_quantity FROM abc""")(
    lambda t: ops.abc_product_revenue(t.sales, t.catalog).withColumn("total_revenue", ops.money("total_revenue")))
query("abc_analysis", _ABC + " SELECT * FROM abc")(_analysis)
query("abc_exact", _EXACT + f"""
  SELECT product_id, category, brand, {R('revenue')} AS revenue, {R('profit')} AS profit, units, rk AS abc_rank,
         {R('cum', 4)} AS abc_cumulative_pct, {R('rk / n * 100', 4)} AS abc_product_pct, abc_class FROM exact""")(
    lambda t: _exact(t).select(
        "product_id", "category", "brand", ops.money("revenue").alias("revenue"), ops.money("profit").alias("profit"),
        "units", "abc_rank", ops.rnd("abc_cumulative_pct", 4).alias("abc_cumulative_pct"),
        ops.rnd("abc_product_pct", 4).alias("abc_product_pct"), "abc_class"))
query("abc_all_status", _EXACT + f"""
  SELECT product_id, product_name, exact.category, {R('revenue')} AS total_revenue, units AS total_quantity, abc_class
  FROM exact JOIN catalog USING (product_id)""")(lambda t: ops.abc_all_status(t.sales, t.catalog))
query("abc_class_summary", _SUMMARY + " SELECT * FROM summary")(lambda t: ops.abc_class_summary(_analysis(t)))
query("abc_recommendations", _SUMMARY + ", advice AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS abc_class, '{title}' AS title, {i + 1} AS item, '{text}' AS recommendation"
    for c, (title, texts) in ops.ADVICE.items() for i, text in enumerate(texts)) + """)
  SELECT abc_class, title, item, recommendation, product_count, revenue_pct FROM advice JOIN summary USING (abc_class)""")(
    lambda t: ops.abc_recommendations(_analysis(t)))
query("abc_with_policy", _ABC + ", policy AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS abc_class, " + ", ".join(f"'{v}' AS {f}" for f, v in zip(ops.POLICY_FIELDS, values))
    for c, values in ops.POLICY.items()) + """)
  SELECT product_id, abc_class, """ + ", ".join(ops.POLICY_FIELDS) + " FROM abc JOIN policy USING (abc_class)")(
    lambda t: ops.abc_with_policy(_analysis(t)).select("product_id", "abc_class", *ops.POLICY_FIELDS))
query("abc_top", _ABC + " SELECT * FROM abc ORDER BY rank LIMIT 10")(lambda t: ops.abc_top(_analysis(t)))
query("abc_top_class_b", _ABC + " SELECT * FROM abc WHERE abc_class = 'B' ORDER BY rank LIMIT 10")(
    lambda t: ops.abc_top(_analysis(t), 10, "B"))
query("abc_by_category", _ABC + f"""
  SELECT category, abc_class, count(*) AS product_count, {R('sum(total_revenue)')} AS total_revenue,
         CAST(sum(total_quantity) AS BIGINT) AS total_quantity FROM abc GROUP BY 1, 2""")(
    lambda t: ops.abc_by_category(_analysis(t)))
query("abc_category_mix", _EXACT + f"""
  SELECT category, count(*) AS products, {R('sum(revenue)')} AS revenue, {R('sum(profit)')} AS profit,
         CAST(sum(units) AS BIGINT) AS units, """ + ", ".join(
    f"count(*) FILTER (abc_class = '{c}') AS {c.lower()}_products" for c in ops.CLASSES) + ", " + ", ".join(
    R(f"count(*) FILTER (abc_class = '{c}') / count(*) * 100") + f" AS {c.lower()}_pct" for c in ops.CLASSES)
    + " FROM exact GROUP BY 1")(lambda t: ops.abc_category_mix(_exact(t)))
query("abc_volume_matrix", _EXACT + " SELECT abc_class, " + ", ".join(
    f"count(*) FILTER (volume_class = '{c}') AS volume_{c.lower()}" for c in ops.CLASSES) + " FROM exact GROUP BY 1")(
    lambda t: ops.abc_volume_matrix(_exact(t)))
_COMBINED = _EXACT + f""",
  combined AS (
    SELECT *, CASE WHEN abc_class = 'A' AND volume_class = 'A' THEN '{ops.COMBINED[0]}'
                WHEN abc_class = 'A' OR volume_class = 'A' THEN '{ops.COMBINED[1]}'
                WHEN abc_class = 'B' AND volume_class = 'B' THEN '{ops.COMBINED[2]}'
                WHEN abc_class = 'B' OR volume_class = 'B' THEN '{ops.COMBINED[3]}'
                ELSE '{ops.COMBINED[4]}' END AS combined_class FROM exact)"""
query("abc_combined", _COMBINED + " SELECT product_id, abc_class, volume_class, combined_class FROM combined")(
    lambda t: ops.abc_combined(_exact(t)).select("product_id", "abc_class", "volume_class", "combined_class"))
query("abc_combined_summary", _COMBINED + f"""
  SELECT combined_class, count(*) AS products, {R('sum(revenue)')} AS revenue, CAST(sum(units) AS BIGINT) AS units
  FROM combined GROUP BY 1""")(lambda t: ops.abc_combined_summary(_exact(t)))
query("pareto_check", _EXACT + f"""
  SELECT count(*) AS products, count(*) FILTER (abc_class = 'A') AS a_products,
         {R('sum(revenue) FILTER (rk <= floor(n * 0.2::DOUBLE)) / sum(revenue) * 100')} AS top_share_pct,
         {R("(sum(revenue) FILTER (abc_class = 'A') / sum(revenue)) / (count(*) FILTER (abc_class = 'A') / count(*))")} AS pareto_ratio
  FROM exact""")(lambda t: ops.pareto_check(_exact(t)))
