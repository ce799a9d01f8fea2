"""Named queries on stored parameters and rolling-origin backtests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.columns import rnd
from ..operators import backtest, demand, fitted as ops, forecast
from ..operators.ordered import materialise
from ..session import ensure_checkpoint_dir
from ..sources.versions import load_version, save_version
from .demand import _AUTO, _CAL, _FIT, _GRID, _METRICS, _ahead, _category_span, _daily, _points, _recent, _span
from .ensemble import _FULL, weekly
from .features import _lines
from .registry import query, rounded as R


def _stored(t, frame, name):
    """Save a fitted table and load it again, as another job would."""
    path = f"{ensure_checkpoint_dir(t.spark)}/fitted/{name}-{uuid.uuid4()}"
    save_version(frame, path)
    return load_version(t.spark, path)


query("forecast_from_parameters", _recent() + "," + _FIT + "," + _ahead(30) + "," + _AUTO + " SELECT * FROM auto")(
    lambda t: ops.forecast_best(_stored(t, ops.fit_parameters(_daily(t)), "forecast"), 30))
query("forecast_calendar_from_parameters", _span("category") + "," + _CAL + "," + _ahead(7, "beta") + f"""
  SELECT series_id, 'linear_calendar' AS model, step, ds,
         {R('greatest(b0 + b1 * (last_index + step) + b2 * (isodow(ds) - 1) + b3 * month(ds), 0)')} AS forecast FROM ahead""")(
    lambda t: ops.forecast_calendar(_stored(t, ops.fit_parameters(_category_span(t)), "calendar"), 7))
query("ensemble_from_parameters", _FULL + f"""
  SELECT series_id, step, ds, count(*) AS members, {R('sum(weight * forecast) / sum(weight)')} AS forecast,
         {R('sum(weight * lower) / sum(weight)')} AS lower, {R('sum(weight * upper) / sum(weight)')} AS upper
  FROM banded JOIN weights USING (series_id, model) GROUP BY 1, 2, 3""")(
    lambda t: ops.forecast_weighted(_stored(t, ops.fit_parameters(weekly(t), holdout=8), "ensemble"), 8).select(
        "series_id", "step", "ds", "members", *[rnd(c, 2).alias(c) for c in ("forecast", "lower", "upper")]))

_FIRST_DAYS = "(SELECT min(o_orderdate) + INTERVAL 30 DAY FROM orders)"


def _extended(t):
    """Codes of the first thirty days' products, kept when the others arrive."""
    lines = materialise(_lines(t))
    first = F.date_add(F.to_date(lines.agg(F.min("order_date")).scalar()), 30)
    early = _stored(t, ops.fit_encoder(lines.where(F.to_date("order_date") < first)), "encoder")
    return ops.encode(lines, _stored(t, ops.extend_encoder(early, lines), "encoder"))


query("encoder_extended", f"""
  e AS (SELECT DISTINCT product_id FROM sales WHERE order_date < {_FIRST_DAYS}),
  c AS (SELECT product_id, row_number() OVER (ORDER BY product_id NOT IN (SELECT product_id FROM e), product_id) - 1 AS code
        FROM (SELECT DISTINCT product_id FROM sales))
  SELECT product_id, CAST(code AS INTEGER) AS product_id_encoded, count(*) AS rows FROM sales JOIN c USING (product_id) GROUP BY 1, 2""")(
    lambda t: _extended(t).groupBy("product_id", "product_id_encoded").agg(F.count(F.lit(1)).alias("rows")))
_SCALED = ["quantity", "unit_price"]


def _merged_scaler(t):
    """Moments of two parts of the lines, stored, merged and applied to all."""
    lines = materialise(_lines(t))
    new = F.year("order_date") >= 1998
    parts = [_stored(t, ops.fit_scaler(lines.where(part), _SCALED), "scaler") for part in (~new, new)]
    return ops.scale(lines, ops.merge_scalers(*parts), _SCALED)


query("scaler_merged", f"""
  SELECT order_id, line_no, product_id, {R('(quantity - avg(quantity) OVER ()) / stddev_pop(quantity) OVER ()', 4)} AS quantity,
         {R('(unit_price - avg(unit_price) OVER ()) / stddev_pop(unit_price) OVER ()', 4)} AS unit_price FROM sales""")(
    lambda t: _merged_scaler(t).select("order_id", "line_no", "product_id", *[rnd(c, 4).alias(c) for c in _SCALED]))

_MODELS = {forecast.MOVING_AVERAGE: "ma_level", forecast.SMOOTHING: "level", forecast.LINEAR: "intercept + slope * i",
           backtest.CALENDAR: "b0 + b1 * a + b2 * b + b3 * c"}
_ROLLING = _points("product", "order_date >= now - INTERVAL 60 DAY") + "," + _GRID.format(
    points="pts", lo="now - INTERVAL 60 DAY", hi="now", step=1) + """,
  idx AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n,
                 CAST(ds - min(ds) OVER (PARTITION BY series_id) AS DOUBLE) AS a, CAST(isodow(ds) - 1 AS DOUBLE) AS b, CAST(month(ds) AS DOUBLE) AS c
          FROM hist),
  org AS (SELECT unnest([30, 20, 10]) AS origin),
  tr AS (SELECT idx.*, origin, n - origin AS cut FROM idx, org WHERE n >= 45 AND i < n - origin),
  cv AS (SELECT series_id, origin, max(cut) AS cut, avg(y) FILTER (i >= cut - 7) AS ma_level,
                sum(y * CASE WHEN i = 0 THEN pow(0.7::DOUBLE, cut - 1 - i) ELSE 0.3::DOUBLE * pow(0.7::DOUBLE, cut - 1 - i) END) AS level,
                regr_slope(y, i) AS slope, regr_intercept(y, i) AS intercept, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(y) AS my,
                var_pop(a) AS aa, var_pop(b) AS bb, var_pop(c) AS cc, covar_pop(a, b) AS ab, covar_pop(a, c) AS ac, covar_pop(b, c) AS bc,
                covar_pop(a, y) AS ay, covar_pop(b, y) AS byy, covar_pop(c, y) AS cy FROM tr GROUP BY 1, 2),
  dt AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS d FROM cv),
  sl AS (SELECT *, (ay * (bb * cc - bc * bc) - ab * (byy * cc - bc * cy) + ac * (byy * bc - bb * cy)) / d AS b1,
                (aa * (byy * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - byy * ac)) / d AS b2,
                (aa * (bb * cy - byy * bc) - ab * (ab * cy - byy * ac) + ay * (ab * bc - bb * ac)) / d AS b3 FROM dt),
  fits AS (SELECT *, my - b1 * ma - b2 * mb - b3 * mc AS b0 FROM sl),
  met AS (SELECT series_id, origin, ds, CAST(y AS DOUBLE) AS actual, i, a, b, c, ma_level, level, slope, intercept, b0, b1, b2, b3
          FROM idx JOIN fits USING (series_id) WHERE i >= cut AND i < cut + 10),
  single AS (""" + " UNION ALL ".join(
    f"SELECT series_id, origin, ds, actual, '{m}' AS model, round(CAST({v} AS DOUBLE), 8) AS predicted FROM met" for m, v in _MODELS.items()) + """),
  er AS (SELECT series_id, model, origin, sum(coalesce(2 * abs(actual - predicted) / nullif(abs(actual) + abs(predicted), 0), 0)) AS e, count(*) AS k
         FROM single GROUP BY 1, 2, 3),
  wt AS (SELECT series_id, model, origin, coalesce(1 / (sum(e) OVER w / sum(k) OVER w * 100 + 0.000001::DOUBLE), 1) AS weight FROM er
         WINDOW w AS (PARTITION BY series_id, model ORDER BY origin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  pairs AS (SELECT * FROM single UNION ALL
            SELECT series_id, origin, ds, actual, 'ensemble', sum(weight * predicted) / sum(weight)
            FROM single JOIN wt USING (series_id, model, origin) GROUP BY 1, 2, 3, 4)"""


def _rolling(t):
    return backtest.with_ensemble(backtest.rolling_pairs(demand.demand_daily(t.sales, 60, t.as_of, dealt=True)))


query("rolling_backtest_metrics", _ROLLING + "," + _METRICS + " SELECT * FROM metrics")(
    lambda t: forecast.backtest_metrics(_rolling(t)))
query("rolling_leaderboard", _ROLLING + "," + _METRICS + f""",
  board AS (SELECT model, count(*) AS series, {R('avg(mae)', 4)} AS mae_mean, {R('stddev_samp(mae)', 4)} AS mae_std,
                   {R('min(mae)', 4)} AS mae_min, {R('max(mae)', 4)} AS mae_max FROM metrics GROUP BY 1)
  SELECT *, model = (SELECT arg_min(model, mae_mean) FROM board) AS is_best FROM board""")(
    lambda t: forecast.model_leaderboard(forecast.backtest_metrics(_rolling(t))))
query("rolling_backtest_by_origin", _ROLLING + f"""
  SELECT model, origin, count(*) AS points, {R('avg(abs(actual - predicted))', 4)} AS mae,
         {R('sqrt(avg((actual - predicted) * (actual - predicted)))', 4)} AS rmse FROM pairs GROUP BY 1, 2""")(
    lambda t: _rolling(t).groupBy("model", "origin").agg(
        F.count(F.lit(1)).alias("points"), rnd(F.avg(F.abs(F.col("actual") - F.col("predicted"))), 4).alias("mae"),
        rnd(F.sqrt(F.avg((F.col("actual") - F.col("predicted")) ** 2)), 4).alias("rmse")))
