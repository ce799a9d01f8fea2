"""Named ensemble, fleet-model and monitoring queries.

Queries with an oracle combine the closed-form methods; the fleet models go
through the same functions and are checked by unit tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rnd
from ..operators import customers, demand, ensemble as ops, fleet, forecast, pareto
from ..operators.ordered import materialise
from .customers import _scores
from .registry import query, rounded as R

_NAMES = [forecast.MOVING_AVERAGE, forecast.SMOOTHING, forecast.LINEAR]
_PERIODS = 8


def weekly(t, keep_zero=True):
    """Weekly demand per category, written once: every member and the weights read it."""
    return materialise(demand.demand_weekly(t.sales, t.catalog, keep_zero))


def _simple(train, horizon=_PERIODS):
    """The three closed-form members with a fixed relative band."""
    return forecast.forecast_all_simple(train, horizon, 0.2)


def _pairs(t):
    return _holdout(weekly(t))


def _holdout(history):
    return materialise(ops.holdout_pairs(history, _simple, _PERIODS))


_WEEKLY = """
  wk AS (SELECT category AS series_id, CAST(date_trunc('week', order_date) AS DATE) + 6 AS ds, CAST(sum(quantity) AS BIGINT) AS y
         FROM sales JOIN catalog USING (product_id)
         WHERE order_status <> 'Cancelled' AND quantity > 0 AND total_amount > 0 GROUP BY 1, 2),
  wspan AS (SELECT series_id, min(ds) AS lo, max(ds) AS hi FROM wk GROUP BY 1),
  wgrid AS (SELECT series_id, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS ds FROM wspan),
  whist AS (SELECT series_id, ds, CAST(coalesce(y, 0) AS BIGINT) AS y FROM wgrid LEFT JOIN wk USING (series_id, ds)),
  widx AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM whist)"""


def _members(train: str, tag: str) -> str:
    """SQL of the closed-form members fitted on rows of widx."""
    return f"""
      {tag}_i AS (SELECT series_id, ds, y, i, count(*) OVER (PARTITION BY series_id) AS n FROM widx WHERE {train}),
      {tag}_f AS (SELECT series_id, max(n) AS n, max(ds) AS last_ds, avg(y) FILTER (i >= n - 7) AS ma_level,
                         sum(y * CASE WHEN i = 0 THEN pow(0.7::DOUBLE, n - 1 - i) ELSE 0.3::DOUBLE * pow(0.7::DOUBLE, n - 1 - i) END) AS level,
                         regr_slope(y, i) AS slope, regr_intercept(y, i) AS intercept FROM {tag}_i GROUP BY 1),
      {tag}_a AS (SELECT *, CAST(last_ds + step AS DATE) AS ds FROM {tag}_f, (SELECT CAST(unnest(range(1, 9)) AS INTEGER) AS step)),
      {tag}_m AS (
        SELECT series_id, '{forecast.MOVING_AVERAGE}' AS model, step, ds, {R('ma_level')} AS forecast FROM {tag}_a
        UNION ALL SELECT series_id, '{forecast.SMOOTHING}', step, ds, {R('level')} FROM {tag}_a
        UNION ALL SELECT series_id, '{forecast.LINEAR}', step, ds, {R('greatest(intercept + slope * (n - 1 + step), 0)')} FROM {tag}_a)"""


_PAIRS = _WEEKLY + "," + _members("i < n - 8", "tr") + """,
  pairs AS (SELECT widx.series_id, model, step, widx.ds, CAST(y AS DOUBLE) AS actual, forecast AS predicted
            FROM widx JOIN tr_m ON widx.series_id = tr_m.series_id AND widx.i - widx.n + 9 = tr_m.step)"""
_SMAPE = "avg(coalesce(2 * abs(actual - predicted) / nullif(abs(actual) + abs(predicted), 0), 0)) * 100"
_WEIGHTS = _PAIRS + f""",
  sm AS (SELECT series_id, model, {_SMAPE} AS smape FROM pairs GROUP BY 1, 2),
  weights AS (SELECT *, (1 / (smape + 0.000001::DOUBLE)) / sum(1 / (smape + 0.000001::DOUBLE)) OVER (PARTITION BY series_id) AS weight FROM sm)"""


def _weights(t):
    return ops.ensemble_weights(_pairs(t), _NAMES)


def _combined(history):
    return ops.ensemble_forecast(_simple(history), ops.ensemble_weights(_holdout(history), _NAMES))


def _report(history):
    return ops.weights_report(ops.ensemble_weights(_holdout(history), _NAMES), _NAMES, history)


query("ensemble_weights", _WEIGHTS + f"""
  SELECT series_id, model, {R('smape', 4)} AS smape, {R('weight', 6)} AS weight FROM weights""")(
    lambda t: _weights(t).select("series_id", "model", rnd("smape", 4).alias("smape"), rnd("weight", 6).alias("weight")))
_FULL = _WEIGHTS + "," + _members("true", "fu") + f""",
  banded AS (SELECT *, {R('forecast * 0.8::DOUBLE')} AS lower, {R('forecast * 1.2::DOUBLE')} AS upper FROM fu_m)"""
query("ensemble_forecast", _FULL + f"""
  SELECT series_id, step, ds, count(*) AS members, {R('sum(weight * forecast) / sum(weight)')} AS forecast,
         {R('sum(weight * lower) / sum(weight)')} AS lower, {R('sum(weight * upper) / sum(weight)')} AS upper
  FROM banded JOIN weights USING (series_id, model) GROUP BY 1, 2, 3""")(
    lambda t: _combined(weekly(t)).select(
        "series_id", "step", "ds", "members", *[rnd(c, 2).alias(c) for c in ("forecast", "lower", "upper")]))
query("ensemble_equal_average", _FULL + f"""
  SELECT series_id, step, ds, count(*) AS members, {R('avg(forecast)')} AS forecast, {R('avg(lower)')} AS lower,
         {R('avg(upper)')} AS upper FROM banded GROUP BY 1, 2, 3""")(
    lambda t: ops.ensemble_equal_average(_simple(weekly(t))).select(
        "series_id", "step", "ds", "members", *[rnd(c, 2).alias(c) for c in ("forecast", "lower", "upper")]))
query("ensemble_average_weights", _WEIGHTS + f"""
  SELECT model, count(*) AS series, {R('avg(weight)', 4)} AS avg_weight, {R('avg(smape)', 4)} AS avg_smape FROM weights GROUP BY 1""")(
    lambda t: ops.average_weights(_weights(t)))
query("ensemble_weights_report", _WEIGHTS + """
  SELECT series_id, (SELECT count(*) FROM whist h WHERE h.series_id = weights.series_id) AS data_points, """ + ", ".join(
    R(f"max(weight) FILTER (model = '{m}')", 4) + f" AS {m}_weight" for m in _NAMES) + ", 'success' AS status FROM weights GROUP BY 1")(
    lambda t: _report(weekly(t)))
_COMPARE = _WEIGHTS + f""",
  ep AS (SELECT series_id, step, actual, sum(weight * predicted) / sum(weight) AS predicted
         FROM pairs JOIN weights USING (series_id, model) GROUP BY 1, 2, 3),
  es AS (SELECT series_id, {_SMAPE} AS es, sum(predicted) AS et FROM ep GROUP BY 1),
  ss AS (SELECT series_id, {_SMAPE} AS ss, sum(predicted) AS st FROM pairs WHERE model = '{forecast.MOVING_AVERAGE}' GROUP BY 1),
  cmp AS (SELECT series_id, {R('ss', 4)} AS single_smape, {R('es', 4)} AS ensemble_smape, {R('st')} AS single_total,
                 {R('et')} AS ensemble_total, {R('ss - es', 4)} AS improvement,
                 CASE WHEN ss > 0 THEN {R('(ss - es) / ss * 100')} ELSE 0 END AS improvement_pct, es < 20 AS meets_target
          FROM ss JOIN es USING (series_id))"""


def _comparison(t):
    pairs = _pairs(t)
    return ops.ensemble_compare(pairs, ops.ensemble_weights(pairs, _NAMES), forecast.MOVING_AVERAGE)


query("ensemble_compare", _COMPARE + " SELECT * FROM cmp")(_comparison)
query("ensemble_compare_summary", _COMPARE + f"""
  SELECT count(*) AS series, {R('avg(single_smape)')} AS avg_single_smape, {R('avg(ensemble_smape)')} AS avg_ensemble_smape,
         {R('avg(improvement)')} AS avg_improvement, count(*) FILTER (meets_target) AS meeting_target FROM cmp""")(
    lambda t: ops.compare_summary(_comparison(t)))
query("model_monitoring_bias", _PAIRS + f"""
  SELECT series_id, model, {R('avg(predicted - actual)', 4)} AS bias, {R('sum(predicted - actual) / sum(actual) * 100')} AS bias_pct,
         {R(_SMAPE, 4)} AS smape, {_SMAPE} > 40 AS needs_retraining FROM pairs GROUP BY 1, 2""")(
    lambda t: ops.forecast_bias(_pairs(t)))


def _abc_moves(t):
    days = [F.lit(day).cast("timestamp_ntz") for day in ("1998-01-01", "2000-01-01")]
    return ops.class_migration(*pareto.abc_snapshots(t.sales, t.catalog, days), "product_id", "abc_class")


def _abc_sql(tag: str, where: str) -> str:
    return f"""
      {tag}p AS (SELECT product_id, sum(total_amount) AS r FROM sales WHERE {where} GROUP BY 1),
      {tag}c AS (SELECT product_id, sum(r) OVER (ORDER BY r DESC, product_id ROWS UNBOUNDED PRECEDING) / sum(r) OVER () * 100 AS c FROM {tag}p),
      {tag} AS (SELECT product_id AS k, CASE WHEN c <= 80 THEN 'A' WHEN c <= 95 THEN 'B' ELSE 'C' END AS cls FROM {tag}c)"""


_MIGRATION = f"""
  SELECT coalesce(b.cls, '(absent)') AS from_class, coalesce(a.cls, '(absent)') AS to_class, count(*) AS members,
         {R('count(*) / sum(count(*)) OVER () * 100')} AS pct, coalesce(b.cls, '(absent)') <> coalesce(a.cls, '(absent)') AS moved
  FROM b FULL OUTER JOIN a ON a.k = b.k GROUP BY 1, 2"""
query("abc_class_migration", _abc_sql("b", "order_date < DATE '1998-01-01'") + "," + _abc_sql("a", "order_date < DATE '2000-01-01'")
      + _MIGRATION)(_abc_moves)


def _rfm_until(t, day):
    kept = t.sales.where(F.col("order_date") < F.lit(day).cast("timestamp_ntz"))
    return customers.with_segments(customers.rfm_scores(kept, day))


def _rfm_sql(tag: str, day: str) -> str:
    text = _scores(f"order_status = 'Delivered' AND order_date < DATE '{day}'", "count(*)", "").replace(
        "(SELECT now  FROM clock)", f"TIMESTAMP '{day}'")
    return f"{tag} AS (SELECT customer_id AS k, segment_4 AS cls FROM (WITH {text.strip()} SELECT customer_id, segment_4 FROM seg))"


query("rfm_segment_migration", _rfm_sql("b", "1999-01-01") + "," + _rfm_sql("a", "2001-01-01") + _MIGRATION)(
    lambda t: ops.class_migration(_rfm_until(t, "1999-01-01"), _rfm_until(t, "2001-01-01"), "customer_id", "segment_4"))


def _shown(frame):
    return frame.select("series_id", "model", "step", "ds", *[rnd(c, 2).alias(c) for c in ("forecast", "lower", "upper")], "error")


query("forecast_seasonal_ar")(lambda t: _shown(fleet.forecast_seasonal_ar(weekly(t), 13)))
query("forecast_seasonal_ar_daily")(lambda t: _shown(fleet.forecast_seasonal_ar(
    demand.demand_daily_span(t.sales, t.catalog), 30, weekly=False)))
query("seasonal_ar_grid_search")(lambda t: fleet.seasonal_ar_grid_search(weekly(t)))
query("forecast_decomposable")(lambda t: fleet.forecast_decomposable(weekly(t), 13).select(
    "series_id", "step", "ds", *[rnd(c, 2).alias(c) for c in ("forecast", "lower", "upper", "trend", "yearly")]))
query("forecast_lag_regressor")(lambda t: _shown(fleet.forecast_lag_regressor(weekly(t), 13)))


def _fleet_ensemble(t):
    history = ops.eligible(weekly(t, keep_zero=False))
    pairs = ops.holdout_pairs(history, lambda train: fleet.all_members(train, _PERIODS), _PERIODS)
    weights = ops.ensemble_weights(pairs, fleet.MEMBERS)
    return ops.ensemble_forecast(fleet.all_members(history, 13), weights).select(
        "series_id", "step", "ds", "members", *[rnd(c, 2).alias(c) for c in ("forecast", "lower", "upper")])


query("ensemble_forecast_fleet")(_fleet_ensemble)
