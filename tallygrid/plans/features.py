"""Named feature and training queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rnd
from ..operators import features as ops, training
from ..operators.ordered import materialise
from .registry import query, rounded as R


def _lines(t):
    return t.sales.select("product_id", "order_date", "order_id", "line_no", "quantity", "unit_price")


def _shown(frame, columns):
    return frame.select("product_id", "order_id", "line_no", "quantity", *[rnd(c, 4).alias(c) for c in columns])


_W = "w AS (PARTITION BY product_id ORDER BY order_date, order_id, line_no, quantity, unit_price)"
_ID = "product_id, order_id, line_no, quantity"


def _rows(size: int) -> str:
    return f"OVER (PARTITION BY product_id ORDER BY order_date, order_id, line_no, quantity, unit_price ROWS {size - 1} PRECEDING)"


query("time_features", f"""
  d AS (SELECT DISTINCT order_date FROM orders_c)
  SELECT CAST(order_date AS DATE) AS order_date, CAST(year(order_date) AS INTEGER) AS year, CAST(month(order_date) AS INTEGER) AS month,
         CAST(day(order_date) AS INTEGER) AS day, CAST(isodow(order_date) - 1 AS INTEGER) AS day_of_week,
         CAST(quarter(order_date) AS INTEGER) AS quarter, CAST(dayofyear(order_date) AS INTEGER) AS day_of_year,
         CAST(weekofyear(order_date) AS INTEGER) AS iso_week, CAST(isodow(order_date) >= 6 AS INTEGER) AS is_weekend,
         CAST(CAST(order_date AS DATE) = last_day(order_date) AS INTEGER) AS is_month_end,
         CAST(CAST(order_date AS DATE) = last_day(order_date) AND month(order_date) % 3 = 0 AS INTEGER) AS is_quarter_end,
         {R('sin(2 * pi() * month(order_date) / 12)', 4)} AS month_sin, {R('cos(2 * pi() * month(order_date) / 12)', 4)} AS month_cos,
         {R('sin(2 * pi() * (isodow(order_date) - 1) / 7)', 4)} AS day_of_week_sin,
         {R('cos(2 * pi() * (isodow(order_date) - 1) / 7)', 4)} AS day_of_week_cos FROM d""")(
    lambda t: ops.time_features(t.orders.select(F.to_date("order_date").alias("order_date")).distinct()).withColumns(
        {c: rnd(c, 4) for c in ("month_sin", "month_cos", "day_of_week_sin", "day_of_week_cos")}))
_LAGS = [1, 3, 7, 14, 30]
query("lag_features", f"SELECT {_ID}, " + ", ".join(
    R(f"coalesce(lag({c}, {k}) OVER w, 0)", 4) + f" AS {c}_lag_{k}" for k in _LAGS for c in ("quantity", "unit_price"))
    + f" FROM sales WINDOW {_W}")(
    lambda t: _shown(ops.lag_features(_lines(t)), list(ops.lag_columns())))


def _rolling(size: int, strict: bool) -> list[str]:
    def kept(expression: str) -> str:
        value = f"coalesce({expression}, 0)"
        return f"CASE WHEN count(*) {_rows(size)} >= {size} THEN {value} ELSE 0 END" if strict else value
    parts = {"quantity_rolling_mean": "avg(quantity)", "quantity_rolling_std": "stddev_samp(quantity)",
             "quantity_rolling_min": "min(quantity)", "quantity_rolling_max": "max(quantity)",
             "price_rolling_mean": "avg(unit_price)"}
    return [R(kept(f"{e} {_rows(size)}"), 4) + f" AS {n}_{size}" for n, e in parts.items()]


query("rolling_features", f"SELECT {_ID}, " + ", ".join(c for s in (3, 7, 14, 30) for c in _rolling(s, False)) + " FROM sales")(
    lambda t: _shown(ops.rolling_features(_lines(t)), list(ops.rolling_columns())))
query("rolling_features_strict", f"SELECT {_ID}, " + ", ".join(c for s in (7, 30) for c in _rolling(s, True)) + " FROM sales")(
    lambda t: _shown(ops.rolling_features(_lines(t), (7, 30), strict=True), list(ops.rolling_columns((7, 30)))))
# small chunks, so that every product is split: the result must not change
query("rolling_features_chunked", f"SELECT {_ID}, " + ", ".join(_rolling(7, False)) + " FROM sales")(
    lambda t: _shown(ops.rolling_features(_lines(t), (7,), chunk=8), list(ops.rolling_columns((7,)))))
query("seasonal_features", f"""
  s AS (SELECT *, lag(quantity, 30) OVER w AS q30, lag(quantity, 365) OVER w AS q365, avg(quantity) {_rows(30)} AS tr FROM sales WINDOW {_W})
  SELECT {_ID}, {R('tr', 4)} AS quantity_trend, {R('least(greatest(coalesce(CASE WHEN q30 = 0 THEN sign(quantity) * 10 ELSE quantity / q30 - 1 END, 0), -10), 10)', 4)} AS quantity_mom_growth,
         {R('least(greatest(coalesce(CASE WHEN q365 = 0 THEN sign(quantity) * 10 ELSE quantity / q365 - 1 END, 0), -10), 10)', 4)} AS quantity_yoy_growth,
         CAST(month(order_date) IN (11, 12) AS INTEGER) AS is_holiday_season,
         CAST(month(order_date) IN (8, 9) AS INTEGER) AS is_back_to_school FROM s""")(
    lambda t: ops.seasonal_features(_lines(t)).select(
        "product_id", "order_id", "line_no", "quantity", *[rnd(c, 4).alias(c) for c in ops.seasonal_columns()],
        "is_holiday_season", "is_back_to_school"))
query("product_stat_features", f"""
  p AS (SELECT product_id, count(quantity) AS quantity_count, {R('avg(quantity)', 4)} AS quantity_mean,
               {R('coalesce(stddev_samp(quantity), 0)', 4)} AS quantity_std, min(quantity) AS quantity_min, max(quantity) AS quantity_max,
               CAST(sum(quantity) AS BIGINT) AS quantity_sum, {R('avg(unit_price)', 4)} AS unit_price_mean,
               {R('coalesce(stddev_samp(unit_price), 0)', 4)} AS unit_price_std, {R('min(unit_price)', 4)} AS unit_price_min,
               {R('max(unit_price)', 4)} AS unit_price_max, count(*) AS order_id_count,
               CAST(datediff('day', min(order_date), max(order_date)) AS INTEGER) AS product_lifespan_days,
               {R("count(quantity) / greatest(datediff('day', min(order_date), max(order_date)), 1)", 4)} AS avg_orders_per_day,
               {R('coalesce(stddev_samp(unit_price), 0) / greatest(avg(unit_price), 0.01)', 4)} AS price_volatility
        FROM sales GROUP BY 1)
  SELECT * FROM p""")(
    lambda t: ops.product_stats(_lines(t)).withColumns({c: rnd(c, 4) for c in (
        "quantity_mean", "quantity_std", "unit_price_mean", "unit_price_std", "unit_price_min", "unit_price_max",
        "avg_orders_per_day", "price_volatility")}))
query("label_encode", """
  SELECT product_id, CAST(dense_rank() OVER (ORDER BY product_id) - 1 AS INTEGER) AS product_id_encoded, count(*) AS rows
  FROM sales GROUP BY 1""")(
    lambda t: ops.label_encode(_lines(t)).groupBy("product_id", "product_id_encoded").agg(F.count(F.lit(1)).alias("rows")))
_TARGET = f"f AS (SELECT *, lead(quantity, 7) OVER w AS quantity_future_7d FROM sales WINDOW {_W})"
query("future_target", _TARGET + f" SELECT {_ID}, quantity_future_7d FROM f WHERE quantity_future_7d IS NOT NULL")(
    lambda t: ops.future_target(_lines(t)).select("product_id", "order_id", "line_no", "quantity", "quantity_future_7d"))
query("future_target_chunked", _TARGET + f" SELECT {_ID}, quantity_future_7d FROM f WHERE quantity_future_7d IS NOT NULL")(
    lambda t: ops.future_target(_lines(t), chunk=8).select("product_id", "order_id", "line_no", "quantity", "quantity_future_7d"))
query("scale_features", f"""
  SELECT order_id, line_no, product_id, {R('(quantity - avg(quantity) OVER ()) / stddev_pop(quantity) OVER ()', 4)} AS quantity,
         {R('(unit_price - avg(unit_price) OVER ()) / stddev_pop(unit_price) OVER ()', 4)} AS unit_price FROM sales""")(
    lambda t: ops.scale_features(_lines(t), ["quantity", "unit_price"]).select(
        "order_id", "line_no", "product_id", rnd("quantity", 4).alias("quantity"), rnd("unit_price", 4).alias("unit_price")))
query("training_frame", f"""
  s AS (SELECT *, coalesce(lag(quantity, 7) OVER w, 0) AS l7, coalesce(lag(quantity, 30) OVER w, 0) AS l30,
               CASE WHEN count(*) {_rows(7)} >= 7 THEN avg(quantity) {_rows(7)} ELSE 0 END AS m7,
               CASE WHEN count(*) {_rows(7)} >= 7 THEN coalesce(stddev_samp(quantity) {_rows(7)}, 0) ELSE 0 END AS s7,
               CASE WHEN count(*) {_rows(30)} >= 30 THEN avg(quantity) {_rows(30)} ELSE 0 END AS m30,
               lead(quantity, 7) OVER w AS target FROM sales WINDOW {_W}),
  p AS (SELECT product_id, avg(quantity) AS qm, stddev_samp(quantity) AS qs, min(quantity) AS lo, max(quantity) AS hi,
               CAST(sum(quantity) AS BIGINT) AS total, avg(unit_price) AS pm, stddev_samp(unit_price) AS ps, count(*) AS n FROM sales GROUP BY 1)
  SELECT product_id, order_id, line_no, quantity, {R('unit_price', 4)} AS unit_price, CAST(month(order_date) AS INTEGER) AS month,
         CAST(day(order_date) AS INTEGER) AS day, CAST(isodow(order_date) - 1 AS INTEGER) AS day_of_week,
         CAST(quarter(order_date) AS INTEGER) AS quarter, CAST(isodow(order_date) >= 6 AS INTEGER) AS is_weekend,
         {R('l7', 4)} AS quantity_lag_7, {R('l30', 4)} AS quantity_lag_30, {R('m7', 4)} AS quantity_rolling_mean_7,
         {R('s7', 4)} AS quantity_rolling_std_7, {R('m30', 4)} AS quantity_rolling_mean_30, {R('qm', 4)} AS quantity_mean,
         {R('coalesce(qs, 0)', 4)} AS quantity_std, lo AS quantity_min, hi AS quantity_max, total AS quantity_sum,
         {R('pm', 4)} AS unit_price_mean, {R('coalesce(ps, 0)', 4)} AS unit_price_std,
         n AS order_id_count, target AS quantity_future_7d FROM s JOIN p USING (product_id) WHERE target IS NOT NULL""")(
    lambda t: training.training_frame(_lines(t)).select(
        "product_id", "order_id", "line_no", "quantity", "month", "day", "day_of_week", "quarter", "is_weekend",
        "quantity_min", "quantity_max", "quantity_sum", *[rnd(c, 4).alias(c) for c in (
            "unit_price", "quantity_lag_7", "quantity_lag_30", "quantity_rolling_mean_7", "quantity_rolling_std_7",
            "quantity_rolling_mean_30", "quantity_mean", "quantity_std", "unit_price_mean", "unit_price_std")],
        "order_id_count", "quantity_future_7d"))
query("evaluate_rolling_mean", f"""
  s AS (SELECT *, CASE WHEN count(*) {_rows(7)} >= 7 THEN avg(quantity) {_rows(7)} ELSE 0 END AS p,
               CAST(lead(quantity, 7) OVER w AS DOUBLE) AS a FROM sales WINDOW {_W}),
  e AS (SELECT a, p, a - p AS e, a - lag(a) OVER w AS step FROM s WHERE a IS NOT NULL WINDOW {_W}),
  m AS (SELECT count(*) AS rows, avg(abs(e)) AS mae, avg(e * e) AS mse, 1 - sum(e * e) / (var_pop(a) * count(*)) AS r2,
               avg(abs(e / nullif(a, 0))) * 100 AS mape, avg(2 * abs(e) / nullif(abs(a) + abs(p), 0)) * 100 AS smape,
               avg(abs(step)) AS step, avg(e) AS bias, stddev_pop(e) AS spread FROM e)
  SELECT rows, {R('mae', 4)} AS mae, {R('mse', 4)} AS mse, {R('sqrt(mse)', 4)} AS rmse, {R('r2', 4)} AS r2, {R('mape')} AS mape,
         {R('smape')} AS smape, {R('mae / step', 4)} AS mase, {R('bias', 4)} AS mean_residual, {R('spread', 4)} AS residual_std,
         CASE WHEN mape < 10 THEN 'Excellent' WHEN mape < 20 THEN 'Good' WHEN mape < 30 THEN 'Acceptable'
              ELSE 'Needs Improvement' END AS performance FROM m""")(
    lambda t: training.evaluate_predictions(training.training_frame(_lines(t)).withColumn("predicted", F.col("quantity_rolling_mean_7"))))
query("ordered_split", """
  o AS (SELECT product_id, row_number() OVER (ORDER BY product_id, order_date, order_id, line_no, quantity, unit_price) AS p,
               count(*) OVER () AS t FROM sales)
  SELECT product_id, count(*) AS rows, count(*) FILTER (p > floor(t * 0.8::DOUBLE)) AS test_rows FROM o GROUP BY 1""")(
    lambda t: training.split_ordered(_lines(t)).groupBy("product_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("is_test"), 1)).alias("test_rows")))
query("date_split", """
  d AS (SELECT order_date, count(*) AS n FROM sales GROUP BY 1),
  c AS (SELECT order_date, sum(n) OVER (ORDER BY order_date) AS c, sum(n) OVER () AS t FROM d),
  k AS (SELECT min(order_date) AS cut FROM c WHERE c >= t * 0.8::DOUBLE)
  SELECT order_date > cut AS is_test, count(*) AS rows FROM sales, k GROUP BY 1""")(
    lambda t: training.split_by_date(_lines(t)).groupBy("is_test").agg(F.count(F.lit(1)).alias("rows")))
query("business_impact", f"""
  m AS (SELECT avg(abs(quantity - 25)) AS mae, count(*) AS n FROM sales),
  s AS (SELECT mae * 50 * n * 0.25::DOUBLE / 12 AS c, n * (0.05::DOUBLE * 0.3::DOUBLE * 20) AS o FROM m)
  SELECT {R('c')} AS monthly_carrying_savings, {R('o')} AS monthly_stockout_savings, {R('c + o')} AS total_monthly_savings,
         {R('(c + o) * 12')} AS annual_benefits, 5000::DOUBLE AS development_cost, {R('((c + o) * 12 - 5000) / 5000 * 100', 1)} AS roi_pct,
         {R('5000 / (c + o)', 4)} AS payback_months FROM s""")(
    lambda t: training.business_impact(_lines(t).agg(
        F.avg(F.abs(F.col("quantity") - 25)).alias("mae"), F.count(F.lit(1)).alias("rows"))))


_FITTED: dict = {}


def _train(t):
    """Forest over every line; the queries of one session over one folder share the fit."""
    key = t.spark.sparkContext.applicationId, t.folder
    if key not in _FITTED:
        frame = materialise(training.split_by_date(training.training_frame(_lines(t))))
        _FITTED[key] = training.train_demand_forest(frame.where(~F.col("is_test"))), frame.where("is_test")
    return _FITTED[key]


def _evaluate(t):
    model, test = _train(t)
    return training.evaluate_forest(model, test)


query("train_demand_forest")(lambda t: (lambda m, test: m.transform(test).select(
    "product_id", "order_id", "line_no", training.TARGET, rnd("predicted", 4).alias("predicted")))(*_train(t)))
query("evaluate_forest")(_evaluate)
query("feature_importance")(lambda t: training.feature_importance(_train(t)[0], t.spark))
query("time_series_cv")(lambda t: training.time_series_cv(materialise(training.training_frame(_lines(t)))))
