"""Regression and residual diagnostics per series.

Inputs are daily or weekly series, so windows per series are bounded by the
calendar. Fits use sums of products per series; only small matrices reach Python.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import tails
from ..functions.columns import rnd
from .forecast import CALENDAR_FEATURES, calendar_features, normal_equations, solve_line
from .ordered import grouped_percentiles, join_on, materialise

def _series():
    return Window.partitionBy("series_id")


def _in_time():
    return _series().orderBy("ds")


def calendar_residuals(history: DataFrame) -> DataFrame:
    """Fitted values and residuals of the calendar regression, with its features."""
    rows = materialise(calendar_features(history))
    beta = normal_equations(rows, CALENDAR_FEATURES).withColumn("beta", solve_line(3)("means", "covariances"))
    joined = rows.join(beta.select("series_id", "n", "beta"), "series_id")
    fitted = F.col("beta")[0]
    for i, name in enumerate(CALENDAR_FEATURES):
        fitted = fitted + F.col("beta")[i + 1] * F.col(name)
    return joined.select("series_id", "ds", "y", "n", *CALENDAR_FEATURES, fitted.alias("fitted"),
                         (F.col("y") - fitted).alias("residual"))


def durbin_watson(residuals: DataFrame) -> DataFrame:
    e = F.col("residual")
    steps = residuals.withColumn("_d", e - F.lag("residual").over(_in_time()))
    value = F.try_divide("_n", "_s")
    return steps.groupBy("series_id").agg(F.sum(F.col("_d") * F.col("_d")).alias("_n"), F.sum(e * e).alias("_s")).select(
        "series_id", rnd(value, 4).alias("durbin_watson"), value.between(1.5, 2.5).alias("independent"))


def _autocorrelations(series: DataFrame, value: str, lags: int) -> DataFrame:
    """Size and autocorrelations 1..lags per series, from one sorted pass."""
    mean = series.withColumn("_c", F.col(value) - F.avg(value).over(_series()))
    shifted = mean.select("series_id", "_c", *[F.lag("_c", k).over(_in_time()).alias(f"_l{k}") for k in range(1, lags + 1)])
    ratios = [F.try_divide(F.sum(F.col("_c") * F.col(f"_l{k}")), F.sum(F.col("_c") * F.col("_c"))).alias(f"r{k}")
              for k in range(1, lags + 1)]
    return shifted.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), *ratios)


def acf(series: DataFrame, value: str = "y", lags: int = 20) -> DataFrame:
    """Autocorrelation by lag in long form."""
    wide = _autocorrelations(series, value, lags)
    cells = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"r{k}").alias("r")) for k in range(1, lags + 1)])
    return wide.select("series_id", F.explode(cells).alias("c")).select(
        "series_id", "c.lag", rnd(F.col("c.r"), 4).alias("acf"))


def ljung_box(residuals: DataFrame, lags: int = 10, value: str = "residual") -> DataFrame:
    """Portmanteau statistic and its tail (even number of lags)."""
    wide = _autocorrelations(residuals, value, lags)
    n = F.col("n")
    q = n * (n + 2) * sum((F.try_divide(F.col(f"r{k}") * F.col(f"r{k}"), n - k) for k in range(1, lags + 1)), F.lit(0.0))
    p = tails.chi2_tail_even(F.col("_q"), lags)
    return wide.withColumn("_q", q).select(
        "series_id", rnd("_q", 4).alias("ljung_box"), rnd(p, 6).alias("p_value"), (p > 0.05).alias("no_autocorrelation"))


def ljung_box_of_fits(residuals: DataFrame, lags: int = 10) -> DataFrame:
    """The portmanteau test of fitted series; one whose fit failed has nulls and the error."""
    kept = materialise(residuals)
    tested = ljung_box(kept.where(F.col("error").isNull()), lags).withColumn("error", F.lit(None).cast("string"))
    return tested.unionByName(kept.where(F.col("error").isNotNull()).select("series_id", "error"), allowMissingColumns=True)


def _moments(residuals: DataFrame, value: str) -> DataFrame:
    x = F.col(value)
    return residuals.groupBy("series_id").agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"))


def jarque_bera(residuals: DataFrame, value: str = "residual") -> DataFrame:
    s, k = F.col("skew"), F.col("kurt")
    jb = F.col("n") / 6 * (s * s + k * k / 4)
    p = F.exp(-jb / 2)
    return _moments(residuals, value).select(
        "series_id", rnd(jb, 4).alias("jarque_bera"), rnd(p, 6).alias("p_value"), (p > 0.05).alias("normal"))


def _skew_z(g: Column, n: Column) -> Column:
    """Normalised skewness (D'Agostino 1970)."""
    y = g * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    b2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (b2 - 1)) - 1
    delta, alpha = 1 / F.sqrt(0.5 * F.log(w2)), F.sqrt(2.0 / (w2 - 1))
    r = y / alpha
    return delta * F.log(r + F.sqrt(r * r + 1))


def _kurtosis_z(k: Column, n: Column) -> Column:
    """Normalised kurtosis (Anscombe and Glynn 1983); ``k`` is the excess kurtosis."""
    expected = 3.0 * (n - 1) / (n + 1)
    variance = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1.0) * (n + 3) * (n + 5))
    x = (k + 3 - expected) / F.sqrt(variance)
    root = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt((6.0 * (n + 3) * (n + 5)) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / root * (2.0 / root + F.sqrt(1 + 4.0 / (root * root)))
    denominator = 1 + x * F.sqrt(2 / (a - 4.0))
    third = F.cbrt((1 - 2.0 / a) / denominator)
    return (1 - 2 / (9.0 * a) - third) / F.sqrt(2 / (9.0 * a))


def dagostino_k2(residuals: DataFrame, value: str = "residual") -> DataFrame:
    """Omnibus normality statistic from skewness and kurtosis; needs 20 points."""
    n = F.col("n").cast("double")
    zs, zk = _skew_z(F.col("skew"), n), _kurtosis_z(F.col("kurt"), n)
    k2 = zs * zs + zk * zk
    p = F.exp(-k2 / 2)
    return _moments(residuals, value).where(F.col("n") >= 20).select(
        "series_id", rnd(k2, 4).alias("k2"), rnd(p, 6).alias("p_value"), (p > 0.05).alias("normal"))


def _standardised(residuals: DataFrame, value: str, population: bool) -> DataFrame:
    spread = F.stddev_pop(value) if population else F.stddev_samp(value)
    x = F.col(value)
    return residuals.select(
        "series_id", x, F.try_divide(x - F.avg(value).over(_series()), spread.over(_series())).alias("z"),
        F.row_number().over(_series().orderBy(value)).alias("i"), F.count(F.lit(1)).over(_series()).alias("n"))


def ks_normal(residuals: DataFrame, value: str = "residual") -> DataFrame:
    """Largest gap between the sample and the normal with its mean and deviation."""
    placed = _standardised(residuals, value, True).withColumn("f", tails.normal_cdf("z"))
    gap = F.greatest(F.col("i") / F.col("n") - F.col("f"), F.col("f") - (F.col("i") - 1) / F.col("n"))
    stats = placed.groupBy("series_id").agg(F.max(gap).alias("d"), F.max("n").alias("n"))
    p = stats.withColumn("p", tails.kolmogorov_upper("d", F.col("n").cast("double")))
    return p.select("series_id", rnd("d", 4).alias("ks"), rnd("p", 6).alias("p_value"), (F.col("p") > 0.05).alias("normal"))


# Critical points of the normality statistic at 15, 10, 5, 2.5 and 1 percent.
ANDERSON_LEVELS = [15.0, 10.0, 5.0, 2.5, 1.0]
ANDERSON_CRITICAL = [0.576, 0.656, 0.787, 0.918, 1.092]


def anderson_darling(residuals: DataFrame, value: str = "residual") -> DataFrame:
    """Anderson-Darling statistic with its size-adjusted critical values."""
    placed = _standardised(residuals, value, False).withColumn("f", tails.normal_cdf("z"))
    f = F.least(F.greatest(F.col("f"), F.lit(1e-300)), F.lit(1 - 1e-16))
    i, n = F.col("i"), F.col("n")
    terms = (2 * i - 1) * F.log(f) + (2 * (n - i) + 1) * F.log1p(-f)
    stats = placed.groupBy("series_id").agg(F.max("n").alias("n"), F.sum(terms).alias("s"))
    a2 = -n - F.col("s") / n
    adjust = 1 + 4 / n - 25 / (n * n)
    critical = [F.round(F.lit(c) / adjust, 3) for c in ANDERSON_CRITICAL]
    return stats.select("series_id", rnd(a2, 4).alias("a2"), *[c.alias(f"critical_{str(l).replace('.', '_')}")
                                                             for l, c in zip(ANDERSON_LEVELS, critical)],
                        (a2 < critical[2]).alias("normal"))


def breusch_pagan(residuals: DataFrame) -> DataFrame:
    """Constant-variance test: explained share of squared residuals on the features."""
    p = len(CALENDAR_FEATURES)
    squared = residuals.withColumn("e2", F.col("residual") * F.col("residual"))
    sums = normal_equations(squared, CALENDAR_FEATURES, target="e2").withColumn(
        "beta", solve_line(p)("means", "covariances"))
    # covariances hold the upper triangle row by row; the target closes each row
    at, row_start = [], 0
    for i in range(p + 1):
        at.append(row_start + p - i)
        row_start += p + 1 - i
    explained = sum((F.col("beta")[i + 1] * F.col("covariances")[at[i]] for i in range(p)), F.lit(0.0))
    total = F.col("covariances")[at[p]]
    r2 = F.when(total > 0, explained / total).otherwise(F.lit(0.0))
    stats = sums.select("series_id", "n", r2.alias("r2"))
    n, k = F.col("n").cast("double"), F.lit(float(p))
    lm, f = n * F.col("r2"), F.try_divide(F.col("r2") * (n - k - 1), (1 - F.col("r2")) * k)
    out = stats.select("series_id", lm.alias("lm"), f.alias("f"), k.alias("k"), (n - k - 1).alias("rest"))
    out = out.withColumns({"p_value": tails.chi2_tail_3("lm"), "f_p_value": tails.f_upper("f", "k", "rest")})
    return out.select("series_id", *[rnd(c, 4).alias(c) for c in ("lm", "f")], *[rnd(c, 6).alias(c) for c in ("p_value", "f_p_value")],
                      (F.col("p_value") > 0.05).alias("constant_variance"))


def _cross_products(rows: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """Full uncentred cross-product matrix per series, flattened row by row."""
    cells = [F.sum(a * b) for a in columns for b in columns]
    return rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.array(*cells).alias("gram"))


def _inverse(p: int):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def invert(grams: pd.Series) -> pd.Series:
        if not len(grams):
            return pd.Series([], dtype=object)
        stacked = np.stack(grams.to_numpy()).astype(float).reshape(-1, p, p)
        return pd.Series(list(np.linalg.pinv(stacked, hermitian=True).reshape(-1, p * p)))
    return invert


def vif(history: DataFrame) -> DataFrame:
    """Variance inflation per feature, without a constant, with its band."""
    p = len(CALENDAR_FEATURES)
    rows = calendar_features(history)
    grams = _cross_products(rows, [F.col(c) for c in CALENDAR_FEATURES]).withColumn("inv", _inverse(p)("gram"))
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), (F.col("gram")[i * p + i] * F.col("inv")[i * p + i]).alias("v"))
                      for i, c in enumerate(CALENDAR_FEATURES)])
    v = F.col("c.v")
    return grams.select("series_id", F.explode(cells).alias("c")).select(
        "series_id", "c.feature", rnd(v, 4).alias("vif"),
        F.when(v < 5, "acceptable").when(v < 10, "moderate").otherwise("high").alias("band"))


def cooks_distance(residuals: DataFrame) -> DataFrame:
    """Leverage and influence of every point; flagged above 4/n."""
    p = len(CALENDAR_FEATURES) + 1
    columns = [F.lit(1.0), *[F.col(c) for c in CALENDAR_FEATURES]]
    inverse = _cross_products(residuals, columns).withColumn("inv", _inverse(p)("gram"))
    noise = residuals.groupBy("series_id").agg(F.try_divide(F.sum(F.col("residual") * F.col("residual")), F.count(F.lit(1)) - p).alias("s2"))
    joined = residuals.join(inverse.select("series_id", "inv").join(noise, "series_id"), "series_id")
    leverage = sum((columns[i] * columns[j] * F.col("inv")[i * p + j] for i in range(p) for j in range(p)), F.lit(0.0))
    h = F.col("leverage")
    placed = joined.withColumn("leverage", leverage)
    distance = F.when((F.col("s2") > 0) & (h < 1), F.col("residual") * F.col("residual") / (p * F.col("s2")) * h / ((1 - h) * (1 - h)))
    return placed.withColumn("d", distance).select(
        "series_id", "ds", rnd("leverage", 6).alias("leverage"), rnd("d", 6).alias("cooks_d"),
        (F.col("d") > 4 / F.col("n")).alias("influential"))


def pearson_significance(history: DataFrame, features: Sequence[str] = CALENDAR_FEATURES) -> DataFrame:
    """Correlation of each feature with demand and its two-sided probability."""
    rows = calendar_features(history)
    wide = rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), *[F.corr(c, "y").alias(f"_{c}") for c in features])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_{c}").alias("r")) for c in features])
    long = wide.select("series_id", "n", F.explode(cells).alias("c")).select("series_id", "n", "c.feature", "c.r")
    df = (F.col("n") - 2).cast("double")
    t = F.col("r") * F.sqrt(F.try_divide(df, F.greatest(1 - F.col("r") * F.col("r"), F.lit(1e-300))))
    scored = long.withColumns({"t": t, "df": df}).withColumn("p", tails.student_two_sided("t", "df"))
    return scored.select("series_id", "feature", rnd("r", 4).alias("r"), rnd("p", 6).alias("p_value"),
                         (F.col("p") < 0.05).alias("significant"))


# Response-surface coefficients (constant, no trend) for 1, 5 and 10 percent,
# and the published approximation of the tail probability.
ADF_CRITICAL = {"1": [-3.43035, -6.5393, -16.786, -79.433], "5": [-2.86154, -2.8903, -4.234, -40.040],
                "10": [-2.56677, -1.5384, -2.809, 0.0]}
ADF_SMALL, ADF_LARGE = [2.1659, 1.4412, 0.038269], [1.7339, 0.93202, -0.12745, -0.010368]
ADF_SWITCH, ADF_LOW, ADF_HIGH = -1.61, -18.83, 2.74


def _adf(y: np.ndarray) -> tuple[float, int, int]:
    """Statistic, chosen lag and rows used; the lag has the lowest information criterion on common rows."""
    n = len(y)
    most = min(int(np.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 2)
    step = np.diff(y)

    def design(lag: int, drop: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(drop, len(step))
        columns = [y[rows], np.ones(len(rows)), *[step[rows - k] for k in range(1, lag + 1)]]
        return np.column_stack(columns), step[rows]

    best, chosen = np.inf, 0
    for lag in range(most + 1):
        x, target = design(lag, most)
        beta = np.linalg.lstsq(x, target, rcond=None)[0]
        rss = float(((target - x @ beta) ** 2).sum())
        aic = len(target) * np.log(max(rss / len(target), 1e-300)) + 2 * x.shape[1]
        if aic < best:
            best, chosen = aic, lag
    x, target = design(chosen, chosen)
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ x.T @ target
    residual = target - x @ beta
    s2 = float(residual @ residual) / (len(target) - x.shape[1])
    return float(beta[0] / np.sqrt(s2 * inverse[0, 0])), chosen, len(target)


def adf_test(history: DataFrame, log: bool = True) -> DataFrame:
    """Unit-root test per series (constant, no trend)."""
    schema = T.StructType([
        T.StructField("series_id", history.schema["series_id"].dataType), T.StructField("statistic", T.DoubleType()),
        T.StructField("p_value", T.DoubleType()), T.StructField("lags", T.IntegerType()), T.StructField("rows", T.IntegerType()),
        *[T.StructField(f"critical_{k}", T.DoubleType()) for k in ADF_CRITICAL],
        T.StructField("stationary", T.BooleanType()), T.StructField("error", T.StringType())])

    def test(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("ds")["y"].to_numpy(float)
        row = {name: None for name in schema.fieldNames()} | {"series_id": key[0]}
        try:
            if len(y) < 12 or np.ptp(y) == 0:
                raise ValueError("series too short or constant")
            statistic, lags, rows = _adf(np.log1p(np.maximum(y, 0)) if log else y)
            surface = {f"critical_{k}": sum(c / rows ** i for i, c in enumerate(v)) for k, v in ADF_CRITICAL.items()}
            curve = ADF_SMALL if statistic <= ADF_SWITCH else ADF_LARGE
            z = sum(c * statistic ** i for i, c in enumerate(curve))
            p = 0.5 + 0.5 * math.erf(z / math.sqrt(2.0))
            p = 1.0 if statistic > ADF_HIGH else 0.0 if statistic < ADF_LOW else p
            row |= {"statistic": round(statistic, 4), "p_value": round(p, 6), "lags": lags, "rows": rows, **surface,
                    "stationary": p < 0.05}
        except (ValueError, np.linalg.LinAlgError) as problem:
            row["error"] = str(problem)
        return pd.DataFrame([row])

    return history.select("series_id", "ds", "y").groupBy("series_id").applyInPandas(test, schema)


def residual_summary(residuals: DataFrame) -> DataFrame:
    """Moments and the verdict of each test, one row per series."""
    base = _moments(residuals, "residual").select(
        "series_id", "n", *[rnd(c, 4).alias(c) for c in ("mean", "std", "skew", "kurt")])
    verdicts = [
        durbin_watson(residuals).select("series_id", "durbin_watson", "independent"),
        ljung_box(residuals).select("series_id", F.col("p_value").alias("ljung_box_p"), "no_autocorrelation"),
        jarque_bera(residuals).select("series_id", F.col("p_value").alias("jarque_bera_p"), "normal")]
    for v in verdicts:
        base = base.join(v, "series_id")
    return base


def qq_points(residuals: DataFrame, value: str = "residual") -> DataFrame:
    """Sorted values with their plotting positions (Filliben)."""
    i, n = F.col("i"), F.col("n")
    inner = (i - 0.3175) / (n + 0.365)
    edge = F.pow(F.lit(0.5), 1.0 / n)
    position = F.when(i == 1, 1 - edge).when(i == n, edge).otherwise(inner)
    placed = _standardised(residuals, value, False)
    return placed.select("series_id", "i", rnd(position, 6).alias("position"), rnd(value, 4).alias("value"))


def qq_theoretical(points: DataFrame) -> DataFrame:
    return points.withColumn("theoretical", rnd(tails.normal_quantile("position"), 4))


def box_stats(frame: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whiskers and outlier count per group."""
    keys = list(keys)
    marks = grouped_percentiles(frame, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    x, spread = F.col(value).cast("double"), F.col("q3") - F.col("q1")
    inside = x.between(F.col("q1") - 1.5 * spread, F.col("q3") + 1.5 * spread)
    return join_on(frame, marks, keys).groupBy(*keys).agg(
        F.count(x).alias("rows"), *[rnd(F.max(c), 4).alias(c) for c in ("q1", "median", "q3")],
        rnd(F.min(F.when(inside, x)), 4).alias("whisker_low"), rnd(F.max(F.when(inside, x)), 4).alias("whisker_high"),
        F.count(F.when(~inside, 1)).alias("outliers"))
