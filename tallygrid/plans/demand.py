"""Named demand-series, forecast and backtest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import demand, forecast as ops
from .registry import query, rounded as R

_LIVE = "order_status <> 'Cancelled'"
_GRID = """
  span AS (SELECT series_id, min(ds) AS lo, max(ds) AS hi FROM {points} GROUP BY 1),
  grid AS (SELECT series_id, CAST(unnest(generate_series(CAST({lo} AS TIMESTAMP), CAST({hi} AS TIMESTAMP), INTERVAL {step} DAY)) AS DATE) AS ds
           FROM span, clock),
  hist AS (SELECT series_id, ds, CAST(coalesce(y, 0) AS BIGINT) AS y FROM grid LEFT JOIN {points} USING (series_id, ds))"""
_LO90, _HI90 = "now - INTERVAL 90 DAY", "now"


def _points(by: str, where: str = "true") -> str:
    key = "product_id" if by == "product" else "category"
    return f"""
      pts AS (SELECT {key} AS series_id, CAST(order_date AS DATE) AS ds, CAST(sum(quantity) AS BIGINT) AS y
              FROM sales JOIN catalog USING (product_id), clock WHERE {_LIVE} AND {where} GROUP BY 1, 2)"""


def _recent(by: str = "product") -> str:
    return _points(by, "order_date >= now - INTERVAL 90 DAY") + "," + _GRID.format(
        points="pts", lo=_LO90, hi=_HI90, step=1)


def _span(by: str) -> str:
    return _points(by, "quantity > 0 AND total_amount > 0") + "," + _GRID.format(points="pts", lo="lo", hi="hi", step=1)


_WEEKS = ", wk AS (SELECT series_id, CAST(date_trunc('week', ds) AS DATE) + 6 AS ds, CAST(sum(y) AS BIGINT) AS y FROM pts GROUP BY 1, 2)"
_FIT = f"""
  idx AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM hist),
  fit AS (SELECT series_id, max(n) AS n, max(ds) AS last_ds, avg(y) FILTER (i >= n - 7) AS ma_level,
                 sum(y * CASE WHEN i = 0 THEN pow(0.7::DOUBLE, n - 1 - i) ELSE 0.3::DOUBLE * pow(0.7::DOUBLE, n - 1 - i) END) AS level,
                 regr_slope(y, i) AS slope, regr_intercept(y, i) AS intercept FROM idx GROUP BY 1)"""


def _ahead(horizon: int, fit: str = "fit") -> str:
    return f"""
      ahead AS (SELECT *, CAST(last_ds + step AS DATE) AS ds
                FROM {fit}, (SELECT CAST(unnest(range(1, {horizon + 1})) AS INTEGER) AS step))"""


_LINE = "greatest(intercept + slope * (n - 1 + step), 0)"


def _daily(t):
    return demand.demand_daily(t.sales, 90, t.as_of)


def _category_daily(t):
    return demand.demand_daily(t.sales, 90, t.as_of, t.catalog)


def _category_span(t):
    return demand.demand_daily_span(t.sales, t.catalog)


query("demand_daily", _recent() + " SELECT * FROM hist")(_daily)
query("demand_daily_by_category", _recent("category") + " SELECT * FROM hist")(_category_daily)
query("demand_daily_span", _span("product") + """
  SELECT series_id, count(*) AS days, CAST(sum(y) AS BIGINT) AS y, min(ds) AS first_ds, max(ds) AS last_ds,
         count(*) FILTER (y = 0) AS zero_days FROM hist GROUP BY 1""")(
    lambda t: demand.demand_daily_span(t.sales).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("days"), F.sum("y").alias("y"), F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"),
        F.count(F.when(F.col("y") == 0, 1)).alias("zero_days")))
query("demand_daily_span_by_category", _span("category") + " SELECT * FROM hist")(_category_span)
query("demand_weekly", _points("product", "quantity > 0 AND total_amount > 0") + _WEEKS + "," + _GRID.format(
    points="wk", lo="lo", hi="hi", step=7) + """
  SELECT series_id, count(*) AS weeks, CAST(sum(y) AS BIGINT) AS y, count(*) FILTER (y = 0) AS zero_weeks FROM hist GROUP BY 1""")(
    lambda t: demand.demand_weekly(t.sales).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("weeks"), F.sum("y").alias("y"), F.count(F.when(F.col("y") == 0, 1)).alias("zero_weeks")))
query("demand_weekly_by_category", _points("category", "quantity > 0 AND total_amount > 0") + _WEEKS + " SELECT * FROM wk WHERE y > 0")(
    lambda t: demand.demand_weekly(t.sales, t.catalog, keep_zero=False))

query("forecast_moving_average", _recent() + "," + _FIT + "," + _ahead(30) + f"""
  SELECT series_id, 'moving_average' AS model, step, ds, {R('ma_level')} AS forecast FROM ahead WHERE n >= 7""")(
    lambda t: ops.forecast_moving_average(_daily(t)))
query("forecast_exp_smoothing", _recent() + "," + _FIT + "," + _ahead(30) + f"""
  SELECT series_id, 'exponential_smoothing' AS model, step, ds, {R('level')} AS forecast FROM ahead WHERE n >= 7""")(
    lambda t: ops.forecast_exp_smoothing(_daily(t)))
query("smoothing_sweep", _recent() + "," + _FIT + " SELECT series_id, " + ", ".join(
    R(f"sum(y * CASE WHEN i = 0 THEN pow({1 - a}::DOUBLE, n - 1 - i) ELSE {a}::DOUBLE * pow({1 - a}::DOUBLE, n - 1 - i) END)", 4)
    + f" AS level_{int(a * 10)}" for a in (0.1, 0.3, 0.5, 0.7)) + " FROM idx GROUP BY 1")(
    lambda t: ops.smoothing_sweep(_daily(t)))
query("forecast_linear", _recent() + "," + _FIT + "," + _ahead(30) + f"""
  SELECT series_id, 'linear_regression' AS model, step, ds, {R(_LINE)} AS forecast, {R('slope', 4)} AS slope,
         CASE WHEN slope > 0.1 THEN 'Increasing' WHEN slope < -0.1 THEN 'Declining' ELSE 'Stable' END AS trend
  FROM ahead WHERE n >= 14""")(lambda t: ops.forecast_linear(_daily(t)))
_AUTO = f"""
  auto AS (SELECT series_id, CASE WHEN n >= 14 THEN 'linear_regression' ELSE 'exponential_smoothing' END AS model, step, ds,
                  {R(f'CASE WHEN n >= 14 THEN {_LINE} ELSE level END')} AS forecast FROM ahead WHERE n >= 7)"""
query("forecast_auto", _recent() + "," + _FIT + "," + _ahead(30) + "," + _AUTO + " SELECT * FROM auto")(
    lambda t: ops.forecast_auto(_daily(t)))
# own spans at day grain: short and long histories take different methods
query("forecast_auto_span", _span("product")
      + "," + _FIT + "," + _ahead(7) + "," + _AUTO + " SELECT * FROM auto")(
    lambda t: ops.auto_from(ops.fit_span(demand.product_points(t.sales, positive=True)), 7))
query("forecast_totals", _recent() + "," + _FIT + "," + _ahead(30) + "," + _AUTO + f"""
  SELECT series_id, model, count(*) AS days, {R('sum(forecast)')} AS total_forecast FROM auto GROUP BY 1, 2""")(
    lambda t: ops.forecast_totals(ops.forecast_auto(_daily(t))))
query("forecast_category_rollup", _recent() + "," + _FIT + "," + _ahead(30) + "," + _AUTO + f"""
  SELECT category, ds, count(*) AS products_count, {R('sum(forecast)')} AS forecast
  FROM auto JOIN catalog ON series_id = product_id GROUP BY 1, 2""")(
    lambda t: ops.forecast_category_rollup(ops.forecast_auto(_daily(t)), t.catalog))
query("forecast_simple_mean", f"""
  d AS (SELECT product_id, order_date, sum(quantity) AS q FROM sales, clock
        WHERE order_date >= now - INTERVAL 90 DAY GROUP BY 1, 2),
  m AS (SELECT product_id, sum(q) / count(*) * 30 AS p FROM d GROUP BY 1)
  SELECT product_id, {R('coalesce(p, 0)')} AS predicted_demand FROM catalog LEFT JOIN m USING (product_id)""")(
    lambda t: ops.forecast_simple_mean(t.sales, t.catalog, as_of=t.as_of))

_BAND = f"""
  flat AS (SELECT series_id, 'moving_average' AS model, step, ds, {R('ma_level')} AS forecast FROM ahead WHERE n >= 7),
  band AS (SELECT *, {R('forecast * (1 - 0.2::DOUBLE)')} AS lower, {R('forecast * (1 + 0.2::DOUBLE)')} AS upper FROM flat)"""


def _banded(by: str, horizon: int) -> str:
    return (_recent(by)) + "," + _FIT + "," + _ahead(horizon) + "," + _BAND


query("forecast_fallback_band", _banded("category", 30) + " SELECT * FROM band")(
    lambda t: ops.forecast_fallback_band(_category_daily(t)))

_CAL = """
  cal AS (SELECT series_id, ds, CAST(y AS DOUBLE) AS y, CAST(ds - min(ds) OVER (PARTITION BY series_id) AS DOUBLE) AS a,
                 CAST(isodow(ds) - 1 AS DOUBLE) AS b, CAST(month(ds) AS DOUBLE) AS c FROM hist),
  cv AS (SELECT series_id, count(*) AS n, max(ds) AS last_ds, max(a) AS last_index, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(y) AS my,
                var_pop(a) AS aa, var_pop(b) AS bb, var_pop(c) AS cc, covar_pop(a, b) AS ab, covar_pop(a, c) AS ac,
                covar_pop(b, c) AS bc, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy, covar_pop(c, y) AS cy FROM cal GROUP BY 1),
  dt AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS d FROM cv),
  sl AS (SELECT *, (ay * (bb * cc - bc * bc) - ab * (byy * cc - bc * cy) + ac * (byy * bc - bb * cy)) / d AS b1,
                (aa * (byy * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - byy * ac)) / d AS b2,
                (aa * (bb * cy - byy * bc) - ab * (ab * cy - byy * ac) + ay * (ab * bc - bb * ac)) / d AS b3 FROM dt),
  beta AS (SELECT *, my - b1 * ma - b2 * mb - b3 * mc AS b0 FROM sl)"""
query("forecast_linear_calendar", _span("category") + "," + _CAL + "," + _ahead(7, "beta") + f"""
  SELECT series_id, 'linear_calendar' AS model, step, ds,
         {R('greatest(b0 + b1 * (last_index + step) + b2 * (isodow(ds) - 1) + b3 * month(ds), 0)')} AS forecast FROM ahead""")(
    lambda t: ops.forecast_linear_calendar(_category_span(t)))

query("time_split", _span("category") + """,
  idx AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM hist)
  SELECT series_id, count(*) FILTER (i < n - 30) AS train_last, count(*) FILTER (i >= n - 30) AS test_last,
         count(*) FILTER (i < floor(n * 0.8::DOUBLE)) AS train_ratio, count(*) FILTER (i >= floor(n * 0.8::DOUBLE)) AS test_ratio
  FROM idx GROUP BY 1""")(lambda t: demand.split_last(_category_span(t), 30).withColumn(
    "_r", F.col("i") >= F.floor(F.col("n") * 0.8)).groupBy("series_id").agg(
    F.count(F.when(~F.col("is_test"), 1)).alias("train_last"), F.count(F.when(F.col("is_test"), 1)).alias("test_last"),
    F.count(F.when(~F.col("_r"), 1)).alias("train_ratio"), F.count(F.when(F.col("_r"), 1)).alias("test_ratio")))


def _holdout(in_sample: bool) -> str:
    kept = "true" if in_sample else "i < n - 30"
    return f"""
      idx0 AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM hist),
      idx AS (SELECT series_id, ds, y, i, count(*) OVER (PARTITION BY series_id) AS n FROM idx0 WHERE {kept}),
      fit AS (SELECT series_id, max(n) AS n, avg(y) FILTER (i >= n - 7) AS ma_level,
                     sum(y * CASE WHEN i = 0 THEN pow(0.7::DOUBLE, n - 1 - i) ELSE 0.3::DOUBLE * pow(0.7::DOUBLE, n - 1 - i) END) AS level,
                     regr_slope(y, i) AS slope, regr_intercept(y, i) AS intercept FROM idx GROUP BY 1),
      tst AS (SELECT series_id, ds, CAST(y AS DOUBLE) AS actual, i FROM idx0 WHERE i >= n - 30),
      pairs AS (
        SELECT series_id, ds, actual, 'moving_average' AS model, ma_level AS predicted FROM tst JOIN fit USING (series_id) WHERE n >= 7
        UNION ALL SELECT series_id, ds, actual, 'exponential_smoothing', level FROM tst JOIN fit USING (series_id) WHERE n >= 7
        UNION ALL SELECT series_id, ds, actual, 'linear_regression', intercept + slope * i FROM tst JOIN fit USING (series_id) WHERE n >= 7)"""


_METRICS = f"""
  st AS (SELECT *, abs(actual - lag(actual) OVER (PARTITION BY series_id, model ORDER BY ds)) AS step, actual - predicted AS e FROM pairs),
  metrics AS (
    SELECT series_id, model, count(*) AS points, {R('avg(abs(e))', 4)} AS mae, {R('sqrt(avg(e * e))', 4)} AS rmse,
           {R('avg(abs(e / (actual + 1))) * 100', 4)} AS mape_plus_one, {R('avg(abs(e / greatest(actual, 1))) * 100', 4)} AS mape_floor_one,
           {R('avg(abs(e / actual)) FILTER (actual > 0) * 100', 4)} AS mape_positive,
           {R('avg(abs(e / actual)) FILTER (actual <> 0) * 100', 4)} AS mape_nonzero,
           {R('avg(abs(e / nullif(actual, 0))) * 100', 4)} AS mape_plain,
           {R('coalesce(avg(2 * abs(e) / nullif(abs(actual) + abs(predicted), 0)) * 100, 0)', 4)} AS smape,
           {R('avg(coalesce(2 * abs(e) / nullif(abs(actual) + abs(predicted), 0), 0)) * 100', 4)} AS smape_zero,
           CASE WHEN var_pop(actual) > 0 THEN {R('1 - sum(e * e) / nullif(var_pop(actual) * count(*), 0)', 4)} END AS r2,
           CASE WHEN avg(step) > 0 THEN {R('avg(abs(e)) / nullif(avg(step), 0)', 4)} END AS mase,
           {R('avg(e)', 4)} AS mean_residual, {R('stddev_pop(e)', 4)} AS residual_std
    FROM st GROUP BY 1, 2)"""
query("backtest_metrics", _span("category") + "," + _holdout(False) + "," + _METRICS + " SELECT * FROM metrics")(
    lambda t: ops.backtest_metrics(ops.holdout_predictions(_category_span(t))))
query("backtest_metrics_in_sample", _span("category") + "," + _holdout(True) + "," + _METRICS + " SELECT * FROM metrics")(
    lambda t: ops.backtest_metrics(ops.holdout_predictions(_category_span(t), in_sample=True)))


def _leaderboard(t):
    points = demand.product_points(t.sales, positive=True)
    kept = points.join(ops.top_series(points), "series_id", "left_semi")
    return ops.model_leaderboard(ops.backtest_metrics(ops.holdout_predictions(demand.fill_gaps(kept))))


query("model_leaderboard", _points("product", "quantity > 0 AND total_amount > 0").replace("pts AS", "pts0 AS") + """,
  pts AS (SELECT * FROM pts0 WHERE series_id IN (SELECT series_id FROM pts0 GROUP BY 1 ORDER BY sum(y) DESC, 1 LIMIT 10)),"""
      + _GRID.format(points="pts", lo="lo", hi="hi", step=1) + "," + _holdout(False) + "," + _METRICS + f""",
  board AS (SELECT model, count(*) AS series, {R('avg(mae)', 4)} AS mae_mean, {R('stddev_samp(mae)', 4)} AS mae_std,
                   {R('min(mae)', 4)} AS mae_min, {R('max(mae)', 4)} AS mae_max FROM metrics GROUP BY 1)
  SELECT *, model = (SELECT arg_min(model, mae_mean) FROM board) AS is_best FROM board""")(_leaderboard)

_HORIZONS = "(SELECT unnest([30, 60, 90]) AS horizon_days)"
_ROLL = f"""
  roll AS (SELECT series_id, horizon_days, {R('sum(forecast)', 0)} AS total_forecast, {R('avg(forecast)')} AS daily_average,
                  {R('sum(lower)', 0)} AS lower_total, {R('sum(upper)', 0)} AS upper_total, count(*) AS steps
           FROM band, {_HORIZONS} WHERE step <= horizon_days GROUP BY 1, 2)"""


def _band90(t):
    return ops.forecast_fallback_band(_category_daily(t), horizon=90)


query("horizon_rollup", _banded("category", 90) + "," + _ROLL + " SELECT * FROM roll")(
    lambda t: ops.horizon_rollup(_band90(t)))
query("horizon_rollup_weekly", _banded("category", 13) + f"""
  SELECT series_id, horizon_days, {R('sum(forecast)', 0)} AS total_forecast, {R('sum(forecast) / max(horizon_days)')} AS daily_average,
         {R('sum(lower)', 0)} AS lower_total, {R('sum(upper)', 0)} AS upper_total, count(*) AS steps
  FROM band, {_HORIZONS} WHERE step <= greatest(horizon_days // 7, 1) GROUP BY 1, 2""")(
    lambda t: ops.horizon_rollup(ops.forecast_fallback_band(_category_daily(t), horizon=13), weekly=True))
query("horizon_detail", _banded("category", 13) + f"""
  SELECT series_id, horizon_days, step, ds, {R('forecast')} AS forecast, {R('lower')} AS lower, {R('upper')} AS upper,
         {R('forecast / 7')} AS daily_equivalent FROM band, {_HORIZONS} WHERE step <= greatest(horizon_days // 7, 1)""")(
    lambda t: ops.horizon_detail(ops.forecast_fallback_band(_category_daily(t), horizon=13), weekly=True))
query("forecast_fallback_advice", _banded("category", 90) + "," + _ROLL + f"""
  SELECT series_id, horizon_days, {R('total_forecast / horizon_days * 14', 0)} AS reorder_point,
         {R('total_forecast * 0.1::DOUBLE', 0)} AS safety_stock, 'medium' AS stockout_risk FROM roll""")(
    lambda t: ops.fallback_advice(ops.horizon_rollup(_band90(t))))
query("horizon_grand_total", _banded("category", 90) + "," + _ROLL + f"""
  SELECT horizon_days, count(*) AS series, {R('sum(total_forecast)', 0)} AS total_forecast FROM roll GROUP BY 1""")(
    lambda t: ops.horizon_grand_total(ops.horizon_rollup(_band90(t))))
query("recommended_stock", _banded("category", 90) + "," + _ROLL + f""",
  rs AS (SELECT series_id, horizon_days, {R('upper_total * 1.15::DOUBLE', 0)} AS recommended_stock FROM roll)
  SELECT * FROM rs UNION ALL SELECT NULL, horizon_days, sum(recommended_stock) FROM rs GROUP BY 2""")(
    lambda t: ops.recommended_stock(ops.horizon_rollup(_band90(t))))
query("forecast_reorder_advice", _banded("category", 90) + f""",
  s AS (SELECT series_id, sum(forecast) AS f, sum(upper) AS u, sum(lower) AS l, sum(forecast) FILTER (step <= 30) AS f30,
               sum(forecast) / count(*) AS daily FROM band GROUP BY 1)
  SELECT series_id, {R('f', 0)} AS forecast_90_day, {R('l', 0)} AS lower, {R('u', 0)} AS upper, {R('daily')} AS daily_average,
         {R('(u - f) / 3', 0)} AS safety_stock, {R(f"daily * 14 + {R('(u - f) / 3', 0)}", 0)} AS reorder_point,
         CASE WHEN (u - l) / f < 0.3 THEN 'low' WHEN (u - l) / f < 0.5 THEN 'medium' ELSE 'high' END AS stockout_risk,
         {R('f30 * 1.2::DOUBLE', 0)} AS recommended_order_quantity FROM s""")(
    lambda t: ops.forecast_reorder_advice(_band90(t)))
query("forecast_dashboard_kpis", _banded("category", 30) + f""",
  ap AS (SELECT series_id, ds, y, max(ds) OVER (PARTITION BY series_id) AS last FROM
         (SELECT category AS series_id, CAST(order_date AS DATE) AS ds, CAST(sum(quantity) AS BIGINT) AS y
          FROM sales JOIN catalog USING (product_id) WHERE {_LIVE} GROUP BY 1, 2)),
  pa AS (SELECT series_id, avg(y) FILTER (ds >= last - 360) AS rc, avg(y) AS al FROM ap GROUP BY 1),
  fa AS (SELECT series_id, arg_min(forecast, step) AS f0, arg_max(forecast, step) AS f1, avg(forecast) AS f, avg(lower) AS l,
                avg(upper) AS u, sum(forecast) AS tot, stddev_pop(forecast) AS sd FROM band GROUP BY 1)
  SELECT series_id, {R('rc')} AS avg_daily, {R('(rc - al) / al * 100', 1)} AS vs_all_time_pct, {R('tot')} AS total_forecast,
         {R('(f1 - f0) / f0 * 100', 1)} AS trend_pct, {R('(u - l) / f * 100', 1)} AS interval_width_pct,
         CAST(floor((u - f) * 0.5::DOUBLE) AS INTEGER) AS safety_stock,
         CAST(floor(rc * 14 + floor((u - f) * 0.5::DOUBLE)) AS INTEGER) AS reorder_point,
         CAST(floor({R('tot * 1.2::DOUBLE', 4)}) AS INTEGER) AS recommended_order,
         CASE WHEN sd / (f + 0.01) < 0.3 THEN 'Low' WHEN sd / (f + 0.01) < 0.5 THEN 'Medium' ELSE 'High' END AS risk_level
  FROM fa JOIN pa USING (series_id)""")(
    lambda t: ops.forecast_dashboard_kpis(demand.category_points(t.sales, t.catalog), ops.forecast_fallback_band(_category_daily(t))))
