"""Closed-form forecasts over all series at once, backtests and forecast reports.

A forecast table has (series_id, model, step, ds, forecast[, lower, upper]).
Each simple method is a weighted sum over its series, so all of them come from
one grouped aggregation; series arrive already partitioned by ``series_id``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.columns import anchor, days_before, money, rnd
from .demand import indexed, split_last
from .ordered import join_on, materialise, with_totals

MOVING_AVERAGE, SMOOTHING, LINEAR = "moving_average", "exponential_smoothing", "linear_regression"
METHODS = [MOVING_AVERAGE, LINEAR, SMOOTHING]


def smoothing_weight(i: Column, n: Column, alpha: float) -> Column:
    """Weight of point i (from 0) of n in the final exponential-smoothing level."""
    decay = F.pow(F.lit(1.0 - alpha), (n - 1 - i).cast("double"))
    return F.when(i == 0, decay).otherwise(F.lit(alpha) * decay)


def fit_simple(history: DataFrame, window: int = 7, alpha: float = 0.3, where: Column | None = None) -> DataFrame:
    """Per series: length, last date, trailing mean, smoothed level, and line."""
    points = indexed(history if where is None else history.where(where).select("series_id", "ds", "y"))
    i, n, y = F.col("i"), F.col("n"), F.col("y").cast("double")
    return points.groupBy("series_id").agg(
        F.max("n").alias("n"), F.max("ds").alias("last_ds"),
        F.avg(F.when(i >= n - window, y)).alias("trailing"),
        F.sum(y * smoothing_weight(i, n, alpha)).alias("level"),
        F.regr_slope(y, i.cast("double")).alias("slope"), F.regr_intercept(y, i.cast("double")).alias("intercept"))


def fit_span(points: DataFrame, window: int = 7, alpha: float = 0.3) -> DataFrame:
    """``fit_simple`` of the daily series from each key's first to last point, without its zero rows.

    ``points`` has one row per key and day with sales. A day without sales adds nothing to any sum here, and what the
    days themselves add follows from the length, so a long span costs no more than the points in it.
    """
    by_series = Window.partitionBy("series_id")
    first, last = F.min("ds").over(by_series), F.max("ds").over(by_series)
    placed = points.select("series_id", "ds", F.col("y").cast("double").alias("y"), F.datediff("ds", first).alias("i"),
                           (F.datediff(last, first) + 1).cast("long").alias("n"))
    i, n, y = F.col("i"), F.col("n"), F.col("y")
    sums = placed.groupBy("series_id").agg(
        F.max("n").alias("n"), F.max("ds").alias("last_ds"), F.sum(F.when(i >= n - window, y)).alias("_recent"),
        F.sum(y * smoothing_weight(i, n, alpha)).alias("level"), F.sum(y).alias("_y"), F.sum(i * y).alias("_iy"))
    size = n.cast("double")
    middle, spread = (size - 1) / 2, size * (size * size - 1) / 12
    slope = F.when(n > 1, (F.col("_iy") - middle * F.col("_y")) / spread)
    return sums.select("series_id", "n", "last_ds", (F.coalesce("_recent", F.lit(0.0)) / F.least(n, F.lit(window))).alias("trailing"),
                       "level", slope.alias("slope"), (F.col("_y") / size - slope * middle).alias("intercept"))


def _ahead(fits: DataFrame, horizon: int) -> DataFrame:
    steps = F.sequence(F.lit(1), F.lit(horizon))
    return fits.withColumn("step", F.explode(steps)).withColumn("ds", F.date_add("last_ds", F.col("step")))


def forecast_moving_average(history: DataFrame, window: int = 7, horizon: int = 30) -> DataFrame:
    """Trailing mean repeated; series shorter than the window get no forecast."""
    fits = fit_simple(history, window).where(F.col("n") >= window)
    return _ahead(fits, horizon).select(
        "series_id", F.lit(MOVING_AVERAGE).alias("model"), "step", "ds", rnd("trailing", 2).alias("forecast"))


def forecast_exp_smoothing(history: DataFrame, alpha: float = 0.3, horizon: int = 30) -> DataFrame:
    """Final smoothed level repeated; needs 7 points."""
    fits = fit_simple(history, alpha=alpha).where(F.col("n") >= 7)
    return _ahead(fits, horizon).select(
        "series_id", F.lit(SMOOTHING).alias("model"), "step", "ds", rnd("level", 2).alias("forecast"))


def smoothing_sweep(history: DataFrame, alphas: Sequence[float] = (0.1, 0.3, 0.5, 0.7)) -> DataFrame:
    """Final level for several smoothing factors, in one aggregation."""
    points = indexed(history)
    y = F.col("y").cast("double")
    levels = [rnd(F.sum(y * smoothing_weight(F.col("i"), F.col("n"), a)), 4).alias(f"level_{int(a * 10)}")
              for a in alphas]
    return points.groupBy("series_id").agg(*levels)


def trend_label(slope: Column) -> Column:
    return F.when(slope > 0.1, "Increasing").when(slope < -0.1, "Declining").otherwise("Stable")


def forecast_linear(history: DataFrame, horizon: int = 30) -> DataFrame:
    """Least-squares line on the day index, not below zero; needs 14 points."""
    fits = fit_simple(history).where(F.col("n") >= 14)
    line = F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("step"))
    return _ahead(fits, horizon).select(
        "series_id", F.lit(LINEAR).alias("model"), "step", "ds",
        rnd(F.greatest(line, F.lit(0.0)), 2).alias("forecast"), rnd("slope", 4).alias("slope"),
        trend_label(rnd("slope", 8)).alias("trend"))


def forecast_auto(history: DataFrame, horizon: int = 30) -> DataFrame:
    """Line where 14 points allow it, else the smoothed level, else the trailing mean."""
    return auto_from(fit_simple(history), horizon)


def auto_from(fits: DataFrame, horizon: int = 30) -> DataFrame:
    n = F.col("n")
    line = F.greatest(F.col("intercept") + F.col("slope") * (n - 1 + F.col("step")), F.lit(0.0))
    value = F.when(n >= 14, line).when(n >= 7, F.col("level"))
    name = F.when(n >= 14, LINEAR).when(n >= 7, SMOOTHING)
    return _ahead(fits.where(n >= 7), horizon).select(
        "series_id", name.alias("model"), "step", "ds", rnd(value, 2).alias("forecast"))


def predict_demand(history: DataFrame, horizon: int = 30, method: str = "auto") -> DataFrame:
    """Forecast by a named method."""
    methods = {"auto": forecast_auto, MOVING_AVERAGE: forecast_moving_average,
               SMOOTHING: forecast_exp_smoothing, LINEAR: forecast_linear}
    if method not in methods:
        raise ValueError(f"Unknown method: {method}")
    return methods[method](history, horizon=horizon).select("series_id", "model", "step", "ds", "forecast")


def forecast_all_simple(history: DataFrame, horizon: int = 30, band: float | None = None) -> DataFrame:
    """All three methods from one fit, in one long table, with a relative band if given."""
    return all_simple_from(fit_simple(history), horizon, band)


def all_simple_from(fits: DataFrame, horizon: int = 30, band: float | None = None) -> DataFrame:
    n, line = F.col("n"), F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("step"))
    values = ((MOVING_AVERAGE, 7, F.col("trailing")), (SMOOTHING, 7, F.col("level")),
              (LINEAR, 14, F.greatest(line, F.lit(0.0))))
    models = F.array(*[F.when(n >= least, F.struct(F.lit(name).alias("model"), rnd(value, 2).alias("forecast")))
                       for name, least, value in values])
    long = (_ahead(fits, horizon)
            .select("series_id", "step", "ds", F.explode(F.filter(models, lambda m: m.isNotNull())).alias("m"))
            .select("series_id", "m.model", "step", "ds", "m.forecast"))
    if band is None:
        return long
    return long.select("*", rnd(F.col("forecast") * (1 - band), 2).alias("lower"),
                       rnd(F.col("forecast") * (1 + band), 2).alias("upper"))


def forecast_totals(forecast: DataFrame) -> DataFrame:
    return forecast.groupBy("series_id", "model").agg(
        F.count(F.lit(1)).alias("days"), money(F.sum("forecast")).alias("total_forecast"))


def forecast_category_rollup(forecast: DataFrame, products: DataFrame) -> DataFrame:
    """Product forecasts summed per category and day."""
    named = forecast.join(products.select(F.col("product_id").alias("series_id"), "category"), "series_id")
    return named.groupBy("category", "ds").agg(
        F.count(F.lit(1)).alias("products_count"), money(F.sum("forecast")).alias("forecast"))


def forecast_simple_mean(sales: DataFrame, products: DataFrame, horizon: int = 30, days: int = 90, as_of=None) -> DataFrame:
    """Mean over days with sales times the horizon; zero without sales. All order states."""
    recent = sales.where(F.col("order_date") >= days_before(anchor(sales, as_of), days))
    daily = recent.groupBy("product_id", F.to_date("order_date").alias("ds")).agg(F.sum("quantity").alias("q"))
    means = daily.groupBy("product_id").agg((F.sum("q") / F.count(F.lit(1)) * horizon).alias("p"))
    return products.select("product_id").join(means, "product_id", "left").select(
        "product_id", money(F.coalesce("p", F.lit(0.0))).alias("predicted_demand"))


def forecast_fallback_band(history: DataFrame, window: int = 7, horizon: int = 30, width: float = 0.2) -> DataFrame:
    """Trailing mean with a fixed relative band, for when model fits fail."""
    flat = forecast_moving_average(history, window, horizon)
    return flat.select("*", rnd(F.col("forecast") * (1 - width), 2).alias("lower"),
                       rnd(F.col("forecast") * (1 + width), 2).alias("upper"))


CALENDAR_FEATURES = ["day_index", "weekday", "month"]


def calendar_features(history: DataFrame) -> DataFrame:
    """Day index from the series start, weekday (Monday = 0) and month."""
    first = F.min("ds").over(Window.partitionBy("series_id"))
    return history.select(
        "series_id", "ds", F.col("y").cast("double").alias("y"),
        F.datediff("ds", first).cast("double").alias("day_index"),
        F.weekday("ds").cast("double").alias("weekday"), F.month("ds").cast("double").alias("month"))


def normal_equations(rows: DataFrame, features: Sequence[str], keys: Sequence[str] = ("series_id",),
                     target: str = "y", extra: Sequence[Column] = ()) -> DataFrame:
    """Count, means and centred cross products per key: all a linear fit needs.

    A few sums per key, combined on the map side; no key's rows are gathered.
    """
    names = [*features, target]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    covariances = [F.covar_pop(a, b) for a, b in pairs]
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in names]).alias("means"),
        F.array(*covariances).alias("covariances"), *extra)


def solve_line(p: int):
    """Pandas UDF: (means, covariances) to (intercept, coefficients...), all series of a batch solved at once."""
    upper = np.triu_indices(p + 1)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(means: pd.Series, covariances: pd.Series) -> pd.Series:
        if not len(means):
            return pd.Series([], dtype=object)
        mean = np.stack(means.to_numpy()).astype(float)
        full = np.zeros((len(mean), p + 1, p + 1))
        full[:, upper[0], upper[1]] = np.stack(covariances.to_numpy())
        full[:, upper[1], upper[0]] = full[:, upper[0], upper[1]]
        slopes = np.einsum("nij,nj->ni", np.linalg.pinv(full[:, :p, :p], rcond=1e-12, hermitian=True), full[:, :p, p])
        intercept = mean[:, p] - (mean[:, :p] * slopes).sum(axis=1)
        return pd.Series(list(np.column_stack([intercept, slopes])))
    return solve


def fit_calendar(history: DataFrame) -> DataFrame:
    """Least squares on day index, weekday and month, one row per series."""
    ends = [F.max("ds").alias("last_ds"), F.max("day_index").alias("last_index")]
    sums = normal_equations(calendar_features(history), CALENDAR_FEATURES, extra=ends)
    return sums.withColumn("beta", solve_line(3)("means", "covariances")).select(
        "series_id", "n", "beta", "last_ds", "last_index")


def forecast_linear_calendar(history: DataFrame, horizon: int = 7) -> DataFrame:
    return calendar_from(fit_calendar(history), horizon)


def calendar_from(fits: DataFrame, horizon: int = 7) -> DataFrame:
    ahead = _ahead(fits, horizon)
    b = [F.col("beta")[i] for i in range(4)]
    value = (b[0] + b[1] * (F.col("last_index") + F.col("step")) + b[2] * F.weekday("ds") + b[3] * F.month("ds"))
    return ahead.select("series_id", F.lit("linear_calendar").alias("model"), "step", "ds",
                        rnd(F.greatest(value, F.lit(0.0)), 2).alias("forecast"))


# Zero rules of the percentage errors: what a zero actual does to its row.
MAPE_RULES = {
    "plus_one": lambda a, e: F.abs(F.try_divide(e, a + 1)),
    "floor_one": lambda a, e: F.abs(e / F.greatest(a, F.lit(1.0))),
    "positive": lambda a, e: F.when(a > 0, F.abs(e / a)),
    "nonzero": lambda a, e: F.when(a != 0, F.abs(e / a)),
    "plain": lambda a, e: F.abs(F.try_divide(e, a)),
}


def smape_term(a: Column, p: Column, zero: str = "skip") -> Column:
    """Symmetric percentage error; a zero pair is skipped or counted as zero."""
    total = F.abs(a) + F.abs(p)
    term = 2 * F.abs(a - p) / total
    return F.when(total > 0, term) if zero == "skip" else F.when(total > 0, term).otherwise(F.lit(0.0))


def backtest_metrics(pairs: DataFrame, keys: Sequence[str] = ("series_id", "model"), digits: int = 4) -> DataFrame:
    """Error metrics per key from columns ``actual``, ``predicted`` and ``ds``.

    MASE scales by the mean step of the actuals, taken by ``lag`` in date order.
    """
    a, p = F.col("actual").cast("double"), F.col("predicted").cast("double")
    by_key = Window.partitionBy(*keys).orderBy("ds")
    rows = pairs.withColumn("_step", F.abs(a - F.lag(a).over(by_key)))
    e = a - p
    mape = [(F.avg(rule(a, e)) * 100).alias(f"_mape_{name}") for name, rule in MAPE_RULES.items()]
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"), F.avg(F.abs(e)).alias("_mae"), F.sqrt(F.avg(e * e)).alias("_rmse"),
        *mape, (F.avg(smape_term(a, p)) * 100).alias("_smape"), (F.avg(smape_term(a, p, "zero")) * 100).alias("_smape_zero"),
        F.sum(e * e).alias("_sse"), (F.var_pop(a) * F.count(a)).alias("_sst"),
        F.avg(e).alias("_mean_residual"), F.stddev_pop(e).alias("_residual_std"), F.avg("_step").alias("_naive"))
    r2 = F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst"))
    mase = F.when(F.col("_naive") > 0, F.col("_mae") / F.col("_naive"))
    out = {"mae": F.col("_mae"), "rmse": F.col("_rmse"), **{f"mape_{m}": F.col(f"_mape_{m}") for m in MAPE_RULES},
           "smape": F.coalesce("_smape", F.lit(0.0)), "smape_zero": F.col("_smape_zero"), "r2": r2, "mase": mase,
           "mean_residual": F.col("_mean_residual"), "residual_std": F.col("_residual_std")}
    return sums.select(*keys, "points", *[rnd(c, digits).alias(name) for name, c in out.items()])


def holdout_predictions(history: DataFrame, periods: int = 30, window: int = 7, alpha: float = 0.3,
                        in_sample: bool = False) -> DataFrame:
    """Actual and predicted values of the last periods for the simple methods.

    The fit sees only earlier points unless ``in_sample``.
    """
    marked = materialise(split_last(history, periods))
    base = marked if in_sample else marked.where(~F.col("is_test"))
    fits = fit_simple(base.select("series_id", "ds", "y"), window, alpha).where(F.col("n") >= window)
    test = marked.where("is_test").select("series_id", "ds", F.col("y").cast("double").alias("actual"), "i")
    line = F.col("intercept") + F.col("slope") * F.col("i")
    models = F.array(*[F.struct(F.lit(name).alias("model"), value.alias("predicted")) for name, value in (
        (MOVING_AVERAGE, F.col("trailing")), (SMOOTHING, F.col("level")), (LINEAR, line))])
    return (test.join(fits, "series_id").select("series_id", "ds", "actual", F.explode(models).alias("m"))
            .select("series_id", "ds", "actual", "m.model", "m.predicted"))


def model_leaderboard(metrics: DataFrame) -> DataFrame:
    """Mean, spread and range of the error per model, and the best model flagged."""
    board = metrics.groupBy("model").agg(
        F.count(F.lit(1)).alias("series"), rnd(F.avg("mae"), 4).alias("mae_mean"),
        rnd(F.stddev_samp("mae"), 4).alias("mae_std"), rnd(F.min("mae"), 4).alias("mae_min"),
        rnd(F.max("mae"), 4).alias("mae_max"))
    best = F.min_by("model", F.struct("mae_mean", "model")).alias("_best")
    return with_totals(board, best).select(*board.columns, (F.col("model") == F.col("_best")).alias("is_best"))


def top_series(points: DataFrame, n: int = 10) -> DataFrame:
    """Series with the highest total demand."""
    return points.groupBy("series_id").agg(F.sum("y").alias("_t")).orderBy(F.desc("_t"), "series_id").limit(n).select("series_id")


def horizon_rollup(forecast: DataFrame, horizons: Sequence[int] = (30, 60, 90), weekly: bool = False) -> DataFrame:
    """Totals, daily mean and interval totals per horizon; horizons are in days.

    A weekly forecast uses horizon // 7 steps, at least one.
    """
    days = F.explode(F.array(*[F.lit(int(h)) for h in horizons])).alias("horizon_days")
    wide = forecast.select("*", days)
    steps = F.greatest(F.floor(F.col("horizon_days") / 7), F.lit(1)) if weekly else F.col("horizon_days")
    kept = wide.where(F.col("step") <= steps)
    daily = (F.sum("forecast") / F.max("horizon_days")) if weekly else F.avg("forecast")
    return kept.groupBy("series_id", "horizon_days").agg(
        rnd(F.sum("forecast"), 0).alias("total_forecast"), rnd(daily, 2).alias("daily_average"),
        rnd(F.sum("lower"), 0).alias("lower_total"), rnd(F.sum("upper"), 0).alias("upper_total"),
        F.count(F.lit(1)).alias("steps"))


def horizon_detail(forecast: DataFrame, horizons: Sequence[int] = (30, 60, 90), weekly: bool = False) -> DataFrame:
    """The steps behind each horizon, with the demand per day they stand for."""
    days = F.explode(F.array(*[F.lit(int(h)) for h in horizons])).alias("horizon_days")
    steps = F.greatest(F.floor(F.col("horizon_days") / 7), F.lit(1)) if weekly else F.col("horizon_days")
    return forecast.select("series_id", "step", "ds", "forecast", "lower", "upper", days).where(F.col("step") <= steps).select(
        "series_id", "horizon_days", "step", "ds", *[rnd(c, 2).alias(c) for c in ("forecast", "lower", "upper")],
        rnd(F.col("forecast") / (7 if weekly else 1), 2).alias("daily_equivalent"))


def fallback_advice(rollup: DataFrame) -> DataFrame:
    """Stock advice from the totals alone, for series whose interval is not known."""
    total, days = F.col("total_forecast"), F.col("horizon_days")
    return rollup.select("series_id", "horizon_days", rnd(total / days * 14, 0).alias("reorder_point"),
                         rnd(total * 0.1, 0).alias("safety_stock"), F.lit("medium").alias("stockout_risk"))


def horizon_grand_total(rollup: DataFrame) -> DataFrame:
    return rollup.groupBy("horizon_days").agg(
        F.count(F.lit(1)).alias("series"), rnd(F.sum("total_forecast"), 0).alias("total_forecast"))


def forecast_reorder_advice(forecast: DataFrame, weekly: bool = False, days: int = 90) -> DataFrame:
    """Safety stock, reorder point, order size and risk from a 90-day forecast."""
    per_day = 7 if weekly else 1
    long_steps, short_steps = max(days // per_day, 1), max(30 // per_day, 1)
    kept = forecast.where(F.col("step") <= long_steps)
    f = F.col("forecast")
    sums = kept.groupBy("series_id").agg(
        F.sum(f).alias("_f"), F.sum("upper").alias("_u"), F.sum("lower").alias("_l"),
        F.sum(F.when(F.col("step") <= short_steps, f)).alias("_f30"), (F.sum(f) / (F.count(f) * per_day)).alias("_daily"))
    safety = rnd((F.col("_u") - F.col("_f")) / 3, 0)
    width = F.when(F.col("_f") > 0, (F.col("_u") - F.col("_l")) / F.col("_f")).otherwise(F.lit(0.0))
    return sums.select(
        "series_id", rnd("_f", 0).alias("forecast_90_day"), rnd("_l", 0).alias("lower"), rnd("_u", 0).alias("upper"),
        rnd("_daily", 2).alias("daily_average"), safety.alias("safety_stock"),
        rnd(F.col("_daily") * 14 + safety, 0).alias("reorder_point"),
        F.when(width < 0.3, "low").when(width < 0.5, "medium").otherwise("high").alias("stockout_risk"),
        rnd(F.col("_f30") * 1.2, 0).alias("recommended_order_quantity"))


def recommended_stock(rollup: DataFrame, buffer: float = 1.15) -> DataFrame:
    """Upper forecast total plus a buffer, per series and overall (null series)."""
    per = rollup.select("series_id", "horizon_days", rnd(F.col("upper_total") * buffer, 0).alias("recommended_stock"))
    overall = per.groupBy("horizon_days").agg(rnd(F.sum("recommended_stock"), 0).alias("recommended_stock")).select(
        F.lit(None).cast(per.schema["series_id"].dataType).alias("series_id"), "horizon_days", "recommended_stock")
    return per.unionByName(overall)


def forecast_dashboard_kpis(points: DataFrame, forecast: DataFrame, recent_days: int = 360) -> DataFrame:
    """Recent level against all time, trend, interval width, and stock advice per series."""
    last = points.groupBy("series_id").agg(F.max("ds").alias("_last"))
    recent = F.col("ds") >= F.date_sub("_last", recent_days)
    past = join_on(points, last, ["series_id"]).groupBy("series_id").agg(
        F.avg(F.when(recent, F.col("y"))).alias("_recent"), F.avg("y").alias("_all"))
    ahead = forecast.groupBy("series_id").agg(
        F.min_by("forecast", "step").alias("_first"), F.max_by("forecast", "step").alias("_end"),
        F.avg("forecast").alias("_f"), F.avg("lower").alias("_l"), F.avg("upper").alias("_u"),
        F.sum("forecast").alias("_total"), F.stddev_pop("forecast").alias("_std"))
    f, safety = F.col("_f"), F.floor((F.col("_u") - F.col("_f")) * 0.5)
    cv = F.col("_std") / (f + 0.01)
    return ahead.join(past, "series_id").select(
        "series_id", rnd("_recent", 2).alias("avg_daily"),
        rnd(F.try_divide(F.col("_recent") - F.col("_all"), F.col("_all")) * 100, 1).alias("vs_all_time_pct"),
        rnd("_total", 2).alias("total_forecast"),
        rnd(F.try_divide(F.col("_end") - F.col("_first"), F.col("_first")) * 100, 1).alias("trend_pct"),
        rnd(F.try_divide(F.col("_u") - F.col("_l"), f) * 100, 1).alias("interval_width_pct"),
        safety.cast("int").alias("safety_stock"),
        F.floor(F.col("_recent") * 14 + safety).cast("int").alias("reorder_point"),
        F.floor(rnd(F.col("_total") * 1.2, 4)).cast("int").alias("recommended_order"),
        F.when(cv < 0.3, "Low").when(cv < 0.5, "Medium").otherwise("High").alias("risk_level"))
