"""Named diagnostic queries on the calendar regression of category demand."""

from __future__ import annotations

import re

from ..functions import tails
from ..functions.columns import rnd
from ..operators import demand, diagnostics as ops, fleet
from ..operators.ordered import materialise
from .demand import _CAL, _span
from .registry import query, rounded as R


def _history(t):
    return demand.demand_daily_span(t.sales, t.catalog)


def _residuals(t):
    return ops.calendar_residuals(_history(t))


def _weekly(t):
    return demand.demand_weekly(t.sales, t.catalog)


_RES = _span("category") + "," + _CAL + """,
  res AS (SELECT series_id, ds, cal.y, a, b, c, y - (b0 + b1 * a + b2 * b + b3 * c) AS residual FROM cal JOIN beta USING (series_id))"""
_S = "(PARTITION BY series_id ORDER BY ds)"

query("calendar_residuals", _RES + f" SELECT series_id, ds, CAST(y AS DOUBLE) AS y, {R('residual', 4)} AS residual FROM res")(
    lambda t: _residuals(t).select("series_id", "ds", "y", rnd("residual", 4).alias("residual")))
_DW = f"""
  dd AS (SELECT series_id, residual AS e, residual - lag(residual) OVER {_S} AS d FROM res),
  dw AS (SELECT series_id, sum(d * d) / sum(e * e) AS v FROM dd GROUP BY 1)"""
query("durbin_watson", _RES + "," + _DW + f" SELECT series_id, {R('v', 4)} AS durbin_watson, v BETWEEN 1.5 AND 2.5 AS independent FROM dw")(
    lambda t: ops.durbin_watson(_residuals(t)))


def _lagged(source: str, value: str, lags: int) -> str:
    return f"""
      ce AS (SELECT series_id, ds, {value} - avg({value}) OVER (PARTITION BY series_id) AS c FROM {source}),
      le AS (SELECT series_id, c, """ + ", ".join(f"lag(c, {k}) OVER {_S} AS l{k}" for k in range(1, lags + 1)) + """ FROM ce),
      ac AS (SELECT series_id, count(*) AS n, """ + ", ".join(f"sum(c * l{k}) / sum(c * c) AS r{k}" for k in range(1, lags + 1)) + " FROM le GROUP BY 1)"


_LB = _lagged("res", "residual", 10) + ", lb AS (SELECT series_id, n * (n + 2) * (" + " + ".join(
    f"r{k} * r{k} / (n - {k})" for k in range(1, 11)) + """) AS q FROM ac),
  lp AS (SELECT series_id, q, exp(-q / 2) * (1 + q / 2 + pow(q / 2, 2) / 2 + pow(q / 2, 3) / 6 + pow(q / 2, 4) / 24) AS p FROM lb)"""
query("ljung_box", _RES + "," + _LB + f"""
  SELECT series_id, {R('q', 4)} AS ljung_box, {R('p', 6)} AS p_value, p > 0.05 AS no_autocorrelation FROM lp""")(
    lambda t: ops.ljung_box(_residuals(t)))
query("acf", _span("category") + "," + _lagged("hist", "y", 12) + " SELECT * FROM (" + " UNION ALL ".join(
    f" SELECT series_id, {k} AS lag, {R(f'r{k}', 4)} AS acf FROM ac" for k in range(1, 13)) + ")")(
    lambda t: ops.acf(_history(t), "y", 12))
_MOM = """
  mm AS (SELECT series_id, count(*) AS n, avg(residual) AS mean, stddev_samp(residual) AS std, stddev_pop(residual) AS sp,
                kurtosis_pop(residual) AS kurt FROM res GROUP BY 1),
  mo AS (SELECT mm.series_id, any_value(n) AS n, any_value(mean) AS mean, any_value(std) AS std, any_value(kurt) AS kurt,
                avg(pow((residual - mean) / sp, 3)) AS skew FROM res JOIN mm ON res.series_id = mm.series_id GROUP BY 1)"""
_JB = "n / 6 * (skew * skew + kurt * kurt / 4)"
query("jarque_bera", _RES + "," + _MOM + f"""
  SELECT series_id, {R(_JB, 4)} AS jarque_bera, {R(f'exp(-({_JB}) / 2)', 6)} AS p_value, exp(-({_JB}) / 2) > 0.05 AS normal FROM mo""")(
    lambda t: ops.jarque_bera(_residuals(t)))
query("dagostino_k2", _RES + "," + _MOM + f""",
  k0 AS (SELECT series_id, CAST(n AS DOUBLE) AS n, skew, kurt FROM mo WHERE n >= 20),
  k1 AS (SELECT *, skew * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
                3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS b2,
                (kurt + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
                6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS rt FROM k0),
  k2 AS (SELECT *, -1 + sqrt(2 * (b2 - 1)) AS w2, 6 + 8 / rt * (2 / rt + sqrt(1 + 4 / (rt * rt))) AS a FROM k1),
  k3 AS (SELECT *, 1 / sqrt(0.5::DOUBLE * ln(w2)) * asinh(y / sqrt(2 / (w2 - 1))) AS zs,
                (1 - 2 / (9 * a) - cbrt((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS zk FROM k2)
  SELECT series_id, {R('zs * zs + zk * zk', 4)} AS k2, {R('exp(-(zs * zs + zk * zk) / 2)', 6)} AS p_value,
         exp(-(zs * zs + zk * zk) / 2) > 0.05 AS normal FROM k3""")(lambda t: ops.dagostino_k2(_residuals(t)))
query("residual_summary", _RES + "," + _MOM + "," + _DW + "," + _LB + f"""
  SELECT mo.series_id, mo.n, {R('mean', 4)} AS mean, {R('std', 4)} AS std, {R('skew', 4)} AS skew, {R('kurt', 4)} AS kurt,
         {R('v', 4)} AS durbin_watson, v BETWEEN 1.5 AND 2.5 AS independent, {R('p', 6)} AS ljung_box_p, p > 0.05 AS no_autocorrelation,
         {R(f'exp(-({_JB}) / 2)', 6)} AS jarque_bera_p, exp(-({_JB}) / 2) > 0.05 AS normal
  FROM mo JOIN dw USING (series_id) JOIN lp USING (series_id)""")(lambda t: ops.residual_summary(materialise(_residuals(t))))
query("qq_points", _RES + f""",
  qq AS (SELECT series_id, residual, row_number() OVER (PARTITION BY series_id ORDER BY residual) AS i, count(*) OVER (PARTITION BY series_id) AS n FROM res)
  SELECT series_id, CAST(i AS INTEGER) AS i, {R('CASE WHEN i = 1 THEN 1 - pow(0.5::DOUBLE, 1 / n) WHEN i = n THEN pow(0.5::DOUBLE, 1 / n) ELSE (i - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END', 6)} AS position,
         {R('residual', 4)} AS value FROM qq""")(lambda t: ops.qq_points(_residuals(t)))
query("box_stats", _span("category") + f""",
  bq AS (SELECT series_id, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.5) AS md, quantile_cont(y, 0.75) AS q3 FROM hist GROUP BY 1),
  bx AS (SELECT *, y BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) AS ok FROM hist JOIN bq USING (series_id))
  SELECT series_id, count(*) AS rows, {R('max(q1)', 4)} AS q1, {R('max(md)', 4)} AS median, {R('max(q3)', 4)} AS q3,
         {R('min(y) FILTER (ok)', 4)} AS whisker_low, {R('max(y) FILTER (ok)', 4)} AS whisker_high,
         count(*) FILTER (NOT ok) AS outliers FROM bx GROUP BY 1""")(
    lambda t: ops.box_stats(_history(t), ["series_id"], "y"))
_DET = """
  g AS (SELECT series_id, count(*) AS n, sum(a * a) AS aa, sum(b * b) AS bb, sum(c * c) AS cc, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * c) AS bc
        FROM cal GROUP BY 1),
  gd AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS d FROM g),
  gv AS (SELECT series_id, 'day_index' AS feature, aa * (bb * cc - bc * bc) / d AS v FROM gd
         UNION ALL SELECT series_id, 'weekday', bb * (aa * cc - ac * ac) / d FROM gd
         UNION ALL SELECT series_id, 'month', cc * (aa * bb - ab * ab) / d FROM gd)"""
query("vif", _span("category") + "," + _CAL + "," + _DET + f"""
  SELECT series_id, feature, {R('v', 4)} AS vif, CASE WHEN v < 5 THEN 'acceptable' WHEN v < 10 THEN 'moderate' ELSE 'high' END AS band FROM gv""")(
    lambda t: ops.vif(_history(t)))


def _horner(x: str, coefficients: list[float]) -> str:
    total = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        total = f"({total} * {x} + {c!r}::DOUBLE)"
    return total


def _phi(z: str) -> str:
    """Normal distribution function in SQL."""
    x = f"abs({z})"
    bell = f"exp(-({z}) * ({z}) / 2)"
    fraction = f"({x} + 0.65::DOUBLE)"
    for k in (4, 3, 2, 1):
        fraction = f"({x} + {k} / {fraction})"
    tail = (f"(CASE WHEN {x} < {tails.NORMAL_FAR} THEN {bell} * {_horner(x, tails.NORMAL_TOP)} / {_horner(x, tails.NORMAL_BOTTOM)} "
            f"ELSE {bell} / {fraction} / sqrt(2 * pi()) END)")
    return f"(CASE WHEN {z} <= 0 THEN {tail} ELSE 1 - {tail} END)"


def _standard(spread: str) -> str:
    return f"""
      z0 AS (SELECT series_id, residual, (residual - avg(residual) OVER p) / {spread}(residual) OVER p AS z,
                    row_number() OVER (PARTITION BY series_id ORDER BY residual) AS i, count(*) OVER p AS n
             FROM res WINDOW p AS (PARTITION BY series_id)),
      z1 AS (SELECT *, {_phi('z')} AS f FROM z0)"""


query("ks_normal", _RES + "," + _standard("stddev_pop") + f""",
  k0 AS (SELECT series_id, max(greatest(i / n - f, f - (i - 1) / n)) AS d, max(n) AS n FROM z1 GROUP BY 1),
  k1 AS (SELECT series_id, d, (sqrt(n) + 0.12::DOUBLE + 0.11::DOUBLE / sqrt(n)) * d AS x FROM k0),
  k2 AS (SELECT series_id, d, CASE WHEN x < 0.2 THEN 1 ELSE least(greatest(
           list_sum([CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2 * k * k * x * x) for k in range(1, 21)]), 0), 1) END AS p FROM k1)
  SELECT series_id, {R('d', 4)} AS ks, {R('p', 6)} AS p_value, p > 0.05 AS normal FROM k2""")(
    lambda t: ops.ks_normal(_residuals(t)))
_ADJUST = "(1 + 4 / n - 25 / (n * n))"
query("anderson_darling", _RES + "," + _standard("stddev_samp") + f""",
  a0 AS (SELECT series_id, n, i, least(greatest(f, 1e-300), 1 - 1e-16) AS f FROM z1),
  a1 AS (SELECT series_id, CAST(max(n) AS DOUBLE) AS n, sum((2 * i - 1) * ln(f) + (2 * (n - i) + 1) * ln(1 - f)) AS s FROM a0 GROUP BY 1)
  SELECT series_id, {R('-n - s / n', 4)} AS a2, """ + ", ".join(
    f"round({c}::DOUBLE / {_ADJUST}, 3) AS critical_{str(level).replace('.', '_')}"
    for level, c in zip(ops.ANDERSON_LEVELS, ops.ANDERSON_CRITICAL)) + f""",
         -n - s / n < round({ops.ANDERSON_CRITICAL[2]}::DOUBLE / {_ADJUST}, 3) AS normal FROM a1""")(
    lambda t: ops.anderson_darling(_residuals(t)))
# two-sided probability of Student's t for whole degrees of freedom: a finite sum in the angle atan(t / sqrt(df))
_STUDENT = """(1 - CASE WHEN df % 2 = 0
    THEN sin(th) * list_sum([exp(lgamma(2 * j + 1) - 2 * lgamma(j + 1) - 2 * j * ln(2.0::DOUBLE)) * pow(cos(th), 2 * j) for j in range(0, df // 2)])
    ELSE 2 / pi() * (th + sin(th) * coalesce(list_sum([exp(2 * j * ln(2.0::DOUBLE) + 2 * lgamma(j + 1) - lgamma(2 * j + 2)) * pow(cos(th), 2 * j + 1)
                                                      for j in range(0, (df - 1) // 2)]), 0)) END)"""
_SQUARED = re.sub(r"\b(cal|cv|dt|sl|beta)\b", r"\g<1>2", _CAL[_CAL.index("cv AS"):])
query("breusch_pagan", _RES + ", cal2 AS (SELECT series_id, ds, a, b, c, residual * residual AS y FROM res)," + _SQUARED + f""",
  bp AS (SELECT series_id, n, (b1 * ay + b2 * byy + b3 * cy) / var AS r2
         FROM beta2 JOIN (SELECT series_id, var_pop(y) AS var FROM cal2 GROUP BY 1) USING (series_id)),
  bq AS (SELECT series_id, n * r2 AS lm, r2 * (n - 4) / ((1 - r2) * 3) AS f, n - 4 AS df FROM bp),
  br AS (SELECT *, atan(sqrt(3 * f) / sqrt(df)) AS th, df / (df + 3 * f) AS x,
                2 * (1 - {_phi('sqrt(lm)')}) + sqrt(2 * lm / pi()) * exp(-lm / 2) AS p FROM bq)
  SELECT series_id, {R('lm', 4)} AS lm, {R('f', 4)} AS f, {R('p', 6)} AS p_value, p > 0.05 AS constant_variance,
         {R(f"{_STUDENT} + exp(lgamma((df + 1) / 2) - lgamma(1.5) - lgamma(df / 2) + df / 2 * ln(x)) * sqrt(1 - x)", 6)} AS f_p_value
  FROM br""")(lambda t: ops.breusch_pagan(_residuals(t)))
query("cooks_distance", _RES + f""",
  s2 AS (SELECT series_id, sum(residual * residual) / (count(*) - 4) AS s2 FROM res GROUP BY 1),
  c0 AS (SELECT r.series_id, r.ds, r.residual, s2, n, a - ma AS da, b - mb AS db, c - mc AS dc, aa, bb, cc, ab, ac, bc, d
         FROM res r JOIN beta USING (series_id) JOIN s2 USING (series_id)),
  c1 AS (SELECT *, (1 + (da * da * (bb * cc - bc * bc) + db * db * (aa * cc - ac * ac) + dc * dc * (aa * bb - ab * ab)
                         + 2 * (da * db * (ac * bc - ab * cc) + da * dc * (ab * bc - ac * bb) + db * dc * (ab * ac - aa * bc))) / d) / n AS h FROM c0),
  c2 AS (SELECT *, residual * residual / (4 * s2) * h / ((1 - h) * (1 - h)) AS k FROM c1)
  SELECT series_id, ds, {R('h', 6)} AS leverage, {R('k', 6)} AS cooks_d, k > 4 / n AS influential FROM c2""")(
    lambda t: ops.cooks_distance(materialise(_residuals(t))))
query("pearson_significance", _span("category") + "," + _CAL + f""",
  pr AS (""" + " UNION ALL ".join(f"SELECT series_id, '{name}' AS feature, count(*) - 2 AS df, corr({c}, y) AS r FROM cal GROUP BY 1"
                                  for name, c in (("day_index", "a"), ("weekday", "b"), ("month", "c"))) + f"""),
  pt AS (SELECT *, atan(abs(r) / sqrt(1 - r * r)) AS th FROM pr),
  pp AS (SELECT *, {_STUDENT} AS p FROM pt)
  SELECT series_id, feature, {R('r', 4)} AS r, {R('p', 6)} AS p_value, p < 0.05 AS significant FROM pp""")(
    lambda t: ops.pearson_significance(_history(t)))
query("adf_test")(lambda t: ops.adf_test(_weekly(t)))
_ENDS = "sqrt(-2 * ln(least(position, 1 - position)))"
_TAIL = f"{_horner('rr', tails.QUANTILE_TAIL_TOP)} / {_horner('rr', tails.QUANTILE_TAIL_BOTTOM)}"
_MIDDLE = f"(position - 0.5::DOUBLE) * {_horner('qq', tails.QUANTILE_TOP)} / {_horner('qq', tails.QUANTILE_BOTTOM)}"
query("qq_theoretical", _RES + f""",
  q0 AS (SELECT series_id, residual, row_number() OVER (PARTITION BY series_id ORDER BY residual) AS i, count(*) OVER (PARTITION BY series_id) AS n FROM res),
  q1 AS (SELECT series_id, CAST(i AS INTEGER) AS i, {R('CASE WHEN i = 1 THEN 1 - pow(0.5::DOUBLE, 1 / n) WHEN i = n THEN pow(0.5::DOUBLE, 1 / n) ELSE (i - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END', 6)} AS position,
                {R('residual', 4)} AS value FROM q0),
  q2 AS (SELECT *, {_ENDS} AS rr, (position - 0.5::DOUBLE) * (position - 0.5::DOUBLE) AS qq FROM q1)
  SELECT series_id, i, position, value, {R(f"CASE WHEN position < {tails.QUANTILE_EDGE} THEN {_TAIL} WHEN position > 1 - {tails.QUANTILE_EDGE} THEN -({_TAIL}) ELSE {_MIDDLE} END", 4)} AS theoretical
  FROM q2""")(lambda t: ops.qq_theoretical(ops.qq_points(_residuals(t))))
query("seasonal_ar_ljung_box")(lambda t: ops.ljung_box_of_fits(fleet.seasonal_ar_residuals(_weekly(t))))
