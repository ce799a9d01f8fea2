"""Per-series model fits: Spark groups the series, each task fits its own.

A series is already folded to one row per day or week, so a group is bounded by
the calendar. A series that cannot be fitted returns one row with its error and
never fails the job.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import rnd

WEEKLY_ORDER, WEEKLY_SEASONAL = (1, 1, 1), (1, 0, 1, 52)
DAILY_ORDER, DAILY_SEASONAL = (1, 1, 1), (1, 1, 1, 7)
Z95 = 1.96


def _forecast_schema(history: DataFrame, *extra: str) -> T.StructType:
    schema = T.StructType([
        T.StructField("series_id", history.schema["series_id"].dataType), T.StructField("model", T.StringType()),
        T.StructField("step", T.IntegerType()), T.StructField("ds", T.DateType()),
        T.StructField("forecast", T.DoubleType()), T.StructField("lower", T.DoubleType()),
        T.StructField("upper", T.DoubleType()), T.StructField("error", T.StringType())])
    for name in extra:
        schema = schema.add(name, T.DoubleType())
    return schema


def _lagged(values: np.ndarray, lags: Sequence[int], start: int) -> np.ndarray:
    return np.column_stack([values[start - k:len(values) - k] for k in lags]) if lags else np.empty((len(values) - start, 0))


def seasonal_ar_fit(y: np.ndarray, order: Sequence[int], seasonal: Sequence[int], skip: int = 0) -> dict:
    """Two-stage least squares for a seasonal ARMA on the differenced log series.

    A long autoregression gives the shocks; the series is then regressed on its
    own lags and the lagged shocks. The criterion leaves out the first ``skip``
    points, so that orders compared with one ``skip`` are judged on the same points.
    """
    (p, d, q), (sp, sd, sq, period) = order, seasonal
    level = np.log1p(np.maximum(y, 0.0))
    w = level.copy()
    for _ in range(d):
        w = np.diff(w)
    for _ in range(sd):
        w = w[period:] - w[:-period]
    ar = [*range(1, p + 1), *[period * k for k in range(1, sp + 1)]]
    ma = [*range(1, q + 1), *[period * k for k in range(1, sq + 1)]]
    long = max(p + q + 2, 4)
    start = max([long, *ar, *ma], default=long)
    if len(w) - start < len(ar) + len(ma) + 8:
        raise ValueError(f"too few points: {len(y)}")
    first = np.column_stack([np.ones(len(w) - long), _lagged(w, range(1, long + 1), long)])
    beta = np.linalg.lstsq(first, w[long:], rcond=None)[0]
    shocks = np.concatenate([np.zeros(long), w[long:] - first @ beta])
    design = np.column_stack([np.ones(len(w) - start), _lagged(w, ar, start), _lagged(shocks, ma, start)])
    coef = np.linalg.lstsq(design, w[start:], rcond=None)[0]
    residuals = w[start:] - design @ coef
    n, k = len(residuals), design.shape[1]
    sigma2 = float(residuals @ residuals) / max(n - k, 1)
    judged = residuals[max(n - max(len(y) - skip, 0), 0):] if skip else residuals
    if skip and len(judged) < k + 8:
        raise ValueError(f"too few points: {len(y)}")
    return {"w": w, "level": level, "shocks": np.concatenate([shocks[:start], residuals]), "ar": ar, "ma": ma,
            "coef": coef, "sigma2": sigma2, "residuals": residuals, "order": order, "seasonal": seasonal,
            "aic": len(judged) * np.log(max(float(judged @ judged) / len(judged), 1e-300)) + 2 * (k + 1)}


def _path(fit: dict, steps: int, shock: float = 0.0) -> np.ndarray:
    """Level path ahead with one shock at the first step."""
    w, shocks = list(fit["w"]), list(fit["shocks"])
    c, ar, ma = fit["coef"], fit["ar"], fit["ma"]
    for h in range(steps):
        e = shock if h == 0 else 0.0
        value = c[0] + e + sum(c[1 + j] * w[-k] for j, k in enumerate(ar))
        value += sum(c[1 + len(ar) + j] * shocks[-k] for j, k in enumerate(ma))
        w.append(float(value))
        shocks.append(e)
    ahead = np.array(w[len(fit["w"]):])
    (_, d, _), (_, sd, _, period) = fit["order"], fit["seasonal"]
    regular = fit["level"]
    for _ in range(d):
        regular = np.diff(regular)
    for _ in range(sd):
        tail = list(regular[-period:])
        for h in range(steps):
            tail.append(ahead[h] + tail[h])
        ahead = np.array(tail[period:])
    for i in range(d):
        base = fit["level"]
        for _ in range(d - 1 - i):
            base = np.diff(base)
        ahead = base[-1] + np.cumsum(ahead)
    return ahead


def seasonal_ar_path(fit: dict, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forecast and 95% band on the original scale, never below zero."""
    mean = _path(fit, steps)
    psi = _path(fit, steps, 1.0) - mean
    spread = Z95 * np.sqrt(fit["sigma2"] * np.cumsum(psi ** 2))
    with np.errstate(over="ignore", invalid="ignore"):
        lower, middle, upper = (np.maximum(np.expm1(v), 0.0) for v in (mean - spread, mean, mean + spread))
    if not np.isfinite([lower, middle, upper]).all():
        raise ValueError(f"forecast diverges within {steps} steps")
    return middle, lower, upper


def _emit(key, model: str, last, step_days: int, forecast, lower, upper, **extra) -> pd.DataFrame:
    steps = np.arange(1, len(forecast) + 1, dtype="int32")
    dates = [(pd.Timestamp(last) + pd.Timedelta(days=int(s) * step_days)).date() for s in steps]
    return pd.DataFrame({"series_id": key, "model": model, "step": steps, "ds": dates, "forecast": forecast,
                         "lower": lower, "upper": upper, "error": None, **extra})


def _failed(key, model: str, message: str, extra: Sequence[str] = ()) -> pd.DataFrame:
    return pd.DataFrame({"series_id": [key], "model": [model], "step": [None], "ds": [None], "forecast": [None],
                         "lower": [None], "upper": [None], "error": [message], **{e: [None] for e in extra}})


def forecast_seasonal_ar(history: DataFrame, steps: int = 13, weekly: bool = True, order: Sequence[int] | None = None,
                         seasonal: Sequence[int] | None = None) -> DataFrame:
    """Seasonal autoregressive forecast of every series."""
    order = tuple(order or (WEEKLY_ORDER if weekly else DAILY_ORDER))
    seasonal = tuple(seasonal or (WEEKLY_SEASONAL if weekly else DAILY_SEASONAL))
    name, days = "seasonal_ar", 7 if weekly else 1

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        try:
            model = seasonal_ar_fit(pdf["y"].to_numpy(float), order, seasonal)
            return _emit(key[0], name, pdf["ds"].iloc[-1], days, *seasonal_ar_path(model, steps))
        except (ValueError, np.linalg.LinAlgError) as problem:
            return _failed(key[0], name, str(problem))

    return history.select("series_id", "ds", "y").groupBy("series_id").applyInPandas(fit, _forecast_schema(history))


def seasonal_ar_residuals(history: DataFrame, weekly: bool = True) -> DataFrame:
    """In-sample residuals of the seasonal fit, for the diagnostics. A series whose fit fails is one row with the error."""
    order, seasonal = (WEEKLY_ORDER, WEEKLY_SEASONAL) if weekly else (DAILY_ORDER, DAILY_SEASONAL)
    schema = T.StructType([T.StructField("series_id", history.schema["series_id"].dataType),
                           T.StructField("ds", T.DateType()), T.StructField("residual", T.DoubleType()), T.StructField("error", T.StringType())])

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        try:
            residuals = seasonal_ar_fit(pdf["y"].to_numpy(float), order, seasonal)["residuals"]
        except (ValueError, np.linalg.LinAlgError) as problem:
            return pd.DataFrame({"series_id": [key[0]], "ds": [None], "residual": [None], "error": [str(problem)]})
        return pd.DataFrame({"series_id": key[0], "ds": pdf["ds"].to_numpy()[-len(residuals):], "residual": residuals, "error": None})

    return history.select("series_id", "ds", "y").groupBy("series_id").applyInPandas(fit, schema)


def _series_arrays(history: DataFrame) -> DataFrame:
    """Each series as an ordered array, one value per calendar period."""
    packed = F.array_sort(F.collect_list(F.struct("ds", F.col("y").cast("double").alias("y"))))
    return history.groupBy("series_id").agg(packed.alias("_p"), F.max("ds").alias("last_ds")).select(
        "series_id", "last_ds", F.transform("_p", lambda p: p["y"]).alias("ys"))


def seasonal_ar_grid(history: DataFrame, period: int = 52, p: Sequence[int] = (0, 1, 2), d: Sequence[int] = (0, 1, 2),
                     q: Sequence[int] = (0, 1, 2), sp: Sequence[int] = (0, 1), sd: Sequence[int] = (0, 1),
                     sq: Sequence[int] = (0, 1)) -> DataFrame:
    """Information criterion of every order for every series; one row per fit.

    Each (series, order) pair is its own row, spread over the cluster. All orders
    are judged on the points that the largest one leaves.
    """
    skip = max(d) + max(sd) * period + max(max(p) + max(q) + 2, 4, max(sp) * period, max(sq) * period)

    def axis(values: Sequence[int]):
        return F.explode(F.array(*[F.lit(v) for v in values]))

    grid = _series_arrays(history).select("series_id", "ys")
    for name, values in (("p", p), ("d", d), ("q", q), ("sp", sp), ("sd", sd), ("sq", sq)):
        grid = grid.withColumn(name, axis(values))

    @F.pandas_udf(T.DoubleType())
    def criterion(ys: pd.Series, p: pd.Series, d: pd.Series, q: pd.Series, sp: pd.Series, sd: pd.Series,
                  sq: pd.Series) -> pd.Series:
        out = []
        for y, *orders in zip(ys, p, d, q, sp, sd, sq):
            try:
                out.append(seasonal_ar_fit(np.asarray(y, float), orders[:3], [*orders[3:], period], skip)["aic"])
            except (ValueError, np.linalg.LinAlgError):
                out.append(None)
        return pd.Series(out, dtype="float64")

    orders = ["p", "d", "q", "sp", "sd", "sq"]
    return grid.repartition("series_id", *orders).select("series_id", *orders, criterion("ys", *orders).alias("aic"))


def seasonal_ar_grid_search(history: DataFrame, period: int = 52, **axes) -> DataFrame:
    """Order with the lowest criterion per series."""
    orders = ["p", "d", "q", "sp", "sd", "sq"]
    scored = seasonal_ar_grid(history, period, **axes).where(F.col("aic").isNotNull())
    best = F.min_by(F.struct(*orders, "aic"), F.struct("aic", *orders)).alias("b")
    return scored.groupBy("series_id").agg(best, F.count(F.lit(1)).alias("fits")).select(
        "series_id", *[F.col(f"b.{o}").alias(o) for o in orders], rnd(F.col("b.aic"), 2).alias("aic"), "fits")


COMPONENTS = ["trend", "yearly", "weekly"]


def _decomposition_design(days: np.ndarray, first: float, span: float, weekly_terms: bool, hinges: int = 25):
    """Columns and penalties: line, trend hinges over the first 80%, Fourier terms."""
    t = (days - first) / max(span, 1.0)
    knots = np.linspace(0, 0.8, hinges + 1)[1:]
    trend = np.column_stack([np.ones_like(t), t, *[np.maximum(t - k, 0.0) for k in knots]])

    def waves(period: float, terms: int) -> np.ndarray:
        angles = 2 * np.pi * np.outer(days / period, np.arange(1, terms + 1))
        return np.column_stack([np.sin(angles), np.cos(angles)])

    yearly = waves(365.25, 10)
    weekly = waves(7.0, 3) if weekly_terms else np.zeros((len(t), 0))
    return trend, yearly, weekly


def forecast_decomposable(history: DataFrame, steps: int = 13, weekly: bool = True, hinge_scale: float = 0.05,
                          season_scale: float = 10.0) -> DataFrame:
    """Piecewise-linear trend plus yearly (and weekly) seasonality, 95% band, and the components.

    Ridge least squares: the scales are prior widths, so a small hinge scale
    keeps the trend stiff.
    """
    name, gap = "decomposable", 7 if weekly else 1
    schema = _forecast_schema(history, *COMPONENTS)

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        days = pd.to_datetime(pdf["ds"]).to_numpy().astype("datetime64[D]").astype(float)
        y = pdf["y"].to_numpy(float)
        if len(y) < 10:
            return _failed(key[0], name, f"too few points: {len(y)}", COMPONENTS)
        scale = max(np.abs(y).max(), 1e-9)
        first, span = days[0], days[-1] - days[0]
        parts = _decomposition_design(days, first, span, not weekly)
        x = np.column_stack(parts)
        noise = 0.1
        penalty = np.concatenate([[1e-6, 1e-6], np.full(parts[0].shape[1] - 2, (noise / hinge_scale) ** 2),
                                  np.full(x.shape[1] - parts[0].shape[1], (noise / season_scale) ** 2)])
        beta = np.linalg.solve(x.T @ x + np.diag(penalty), x.T @ (y / scale))
        residual = y / scale - x @ beta
        sigma = np.sqrt(residual @ residual / max(len(y) - 4, 1)) * scale
        ahead = days[-1] + gap * np.arange(1, steps + 1)
        future = _decomposition_design(ahead, first, span, not weekly)
        cut = np.cumsum([0] + [f.shape[1] for f in future])
        values = [f @ beta[a:b] * scale for f, a, b in zip(future, cut[:-1], cut[1:])]
        mean = sum(values)
        return _emit(key[0], name, pdf["ds"].iloc[-1], gap, np.maximum(mean, 0), np.maximum(mean - Z95 * sigma, 0),
                     np.maximum(mean + Z95 * sigma, 0), **dict(zip(COMPONENTS, values)))

    return history.select("series_id", "ds", "y").groupBy("series_id").applyInPandas(fit, schema)


def lag_rows(history: DataFrame, lookback: int = 12) -> DataFrame:
    """Training rows: scaled value and the scaled values before it, oldest first."""
    scaled = scaled_arrays(history)
    picks = F.explode(F.sequence(F.lit(lookback), F.size("zs") - 1)).alias("i")
    return scaled.where(F.size("zs") > lookback).select("series_id", "zs", picks).select(
        "series_id", F.slice("zs", F.col("i") - lookback + 1, lookback).alias("lags"),
        F.element_at("zs", F.col("i") + 1).alias("label"))


def scaled_arrays(history: DataFrame) -> DataFrame:
    """Series scaled to 0..1 by their own range."""
    packed = _series_arrays(history).withColumns({"lo": F.array_min("ys"), "hi": F.array_max("ys")})
    width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0))
    return packed.select("series_id", "last_ds", "lo", width.alias("width"),
                         F.transform("ys", lambda v: (v - F.col("lo")) / width).alias("zs"))


def forecast_lag_regressor(history: DataFrame, steps: int = 13, lookback: int = 12, weekly: bool = True,
                           ridge: float = 0.001) -> DataFrame:
    """One pooled regression on scaled lags, rolled forward step by step.

    The fit is a distributed normal-equation solve. Its few coefficients become
    literals, and the roll-forward is a fold over each series' last values.
    """
    rows = lag_rows(history, lookback).select(array_to_vector("lags").alias("features"), "label")
    model = LinearRegression(regParam=ridge, solver="normal").fit(rows)
    weights = F.array(*[F.lit(float(c)) for c in model.coefficients])
    start = F.slice("zs", -lookback, lookback)

    def roll(lags, _):
        recent = F.slice(lags, -lookback, lookback)
        value = F.aggregate(F.zip_with(recent, weights, lambda a, b: a * b), F.lit(float(model.intercept)),
                            lambda acc, v: acc + v)
        return F.concat(lags, F.array(value))

    ready = scaled_arrays(history).where(F.size("zs") >= lookback)
    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, roll)
    levels = ready.withColumn("fs", F.transform(
        F.slice(path, lookback + 1, steps), lambda z: F.greatest(z * F.col("width") + F.col("lo"), F.lit(0.0))))
    mean = F.aggregate("fs", F.lit(0.0), lambda a, v: a + v) / steps
    spread = F.sqrt(F.aggregate("fs", F.lit(0.0), lambda a, v: a + v * v) / steps - mean * mean)
    banded = levels.withColumn("band", F.lit(Z95 * 0.2) * F.coalesce(F.nanvl(spread, F.lit(0.0)), F.lit(0.0)))
    out = banded.select("series_id", "last_ds", "band", F.posexplode("fs").alias("pos", "forecast"))
    step = F.col("pos") + 1
    return out.select(
        "series_id", F.lit("lag_regressor").alias("model"), step.alias("step"),
        F.date_add("last_ds", step * (7 if weekly else 1)).alias("ds"), "forecast",
        F.greatest(F.col("forecast") - F.col("band"), F.lit(0.0)).alias("lower"),
        (F.col("forecast") + F.col("band")).alias("upper"), F.lit(None).cast("string").alias("error"))


def all_members(history: DataFrame, steps: int, weekly: bool = True) -> DataFrame:
    """Forecasts of the three models in one long table."""
    columns = ["series_id", "model", "step", "ds", "forecast", "lower", "upper", "error"]
    return (forecast_seasonal_ar(history, steps, weekly).select(*columns)
            .unionByName(forecast_decomposable(history, steps, weekly).select(*columns))
            .unionByName(forecast_lag_regressor(history, steps, weekly=weekly).select(*columns)))


MEMBERS = ["seasonal_ar", "decomposable", "lag_regressor"]
