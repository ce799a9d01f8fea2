"""Tail probabilities and normal quantiles.

Spark has no error function or incomplete beta. The normal distribution and what
follows from it are column expressions. The incomplete beta runs on Arrow batches
of already aggregated rows (one per series or test).
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def chi2_tail_even(x: Column, df: int) -> Column:
    """Upper tail of chi-square with an even number of degrees of freedom: a finite sum."""
    if df % 2:
        raise ValueError("closed form needs an even number of degrees of freedom")
    half = x / 2
    term = total = F.lit(1.0)
    for j in range(1, df // 2):
        term = term * half / j
        total = total + term
    return F.exp(-half) * total


# Hart's rational approximation of the normal tail (highest power first).
NORMAL_TOP = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871,
              221.213596169931, 220.206867912376]
NORMAL_BOTTOM = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674,
                 637.333633378831, 793.826512519948, 440.413735824752]
NORMAL_FAR = 7.07106781186547

# Acklam's rational approximation of the normal quantile, middle and tail (highest power first).
QUANTILE_TOP = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02,
                -3.066479806614716e+01, 2.506628277459239e+00]
QUANTILE_BOTTOM = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01,
                   -1.328068155288572e+01, 1.0]
QUANTILE_TAIL_TOP = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00,
                     4.374664141464968e+00, 2.938163982698783e+00]
QUANTILE_TAIL_BOTTOM = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00, 1.0]
QUANTILE_EDGE = 0.02425


def _polynomial(x: Column, coefficients: list[float]) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + c
    return total


def normal_upper(z: Column | str) -> Column:
    """Upper tail of the standard normal, with full relative precision far out."""
    z = F.col(z) if isinstance(z, str) else z
    x = F.abs(z)
    bell = F.exp(-x * x / 2)
    near = bell * _polynomial(x, NORMAL_TOP) / _polynomial(x, NORMAL_BOTTOM)
    fraction = x + 0.65
    for k in (4, 3, 2, 1):
        fraction = x + F.lit(float(k)) / fraction
    tail = F.when(x < NORMAL_FAR, near).otherwise(bell / fraction / math.sqrt(2 * math.pi))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def normal_cdf(z: Column | str) -> Column:
    z = F.col(z) if isinstance(z, str) else z
    return normal_upper(-z)


def normal_quantile(p: Column | str) -> Column:
    """Standard normal quantile; null outside (0, 1)."""
    p = F.col(p) if isinstance(p, str) else p
    q = p - 0.5
    middle = q * _polynomial(q * q, QUANTILE_TOP) / _polynomial(q * q, QUANTILE_BOTTOM)
    r = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = _polynomial(r, QUANTILE_TAIL_TOP) / _polynomial(r, QUANTILE_TAIL_BOTTOM)
    value = F.when(p < QUANTILE_EDGE, tail).when(p > 1 - QUANTILE_EDGE, -tail).otherwise(middle)
    return F.when((p > 0) & (p < 1), value)


def chi2_tail_3(x: Column | str) -> Column:
    """Upper tail of chi-square with three degrees of freedom."""
    v = F.greatest(F.col(x) if isinstance(x, str) else x, F.lit(0.0))
    return 2 * normal_upper(F.sqrt(v)) + F.sqrt(2 * v / math.pi) * F.exp(-v / 2)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (modified Lentz)."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _beta_fraction(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), 1e-300)
    value = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            c = 1.0 + step / c
            d, c = 1.0 / (d if abs(d) > tiny else tiny), (c if abs(c) > tiny else tiny)
            value *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return front * value


@F.pandas_udf(T.DoubleType())
def student_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([_beta_fraction(v / 2, 0.5, v / (v + s * s)) if v > 0 and s == s else None
                      for s, v in zip(t.astype(float), df.astype(float))], dtype="float64")


@F.pandas_udf(T.DoubleType())
def f_upper(x: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series([_beta_fraction(b / 2, a / 2, b / (b + a * s)) if b > 0 and s >= 0 else None
                      for s, a, b in zip(x.astype(float), df1.astype(float), df2.astype(float))], dtype="float64")


def kolmogorov_upper(d: Column | str, n: Column) -> Column:
    """Asymptotic tail of the one-sample Kolmogorov statistic; twenty terms are exact to 1e-14 from 0.2 up."""
    root = F.sqrt(n)
    x = (root + 0.12 + 0.11 / root) * (F.col(d) if isinstance(d, str) else d)
    terms = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * k * k * x * x))
    tail = F.aggregate(terms, F.lit(0.0), lambda total, term: total + term)
    return F.when(x < 0.2, 1.0).otherwise(F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0)))
