import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.operators import demand, fleet, forecast


def series(spark, values, key="s", start="2024-01-01", step=1):
    first = dt.date.fromisoformat(start)
    return spark.createDataFrame([(key, first + dt.timedelta(days=i * step), float(v)) for i, v in enumerate(values)],
                                 "series_id string, ds date, y double")


def test_grid_covers_gaps_and_midnight_edges(sales_of):
    sales = sales_of([("P", "c", "2024-06-29 23:59", 2, 1), ("P", "c", "2024-07-01 00:00", 3, 1), ("P", "c", "2024-06-30", 9, 1, "Cancelled")])
    rows = demand.demand_daily(sales, 5, "2024-07-01").orderBy("ds").collect()
    assert [r.y for r in rows] == [0, 0, 0, 2, 0, 3] and rows[0].ds == dt.date(2024, 6, 26)


def test_span_of_a_single_day(sales_of):
    rows = demand.demand_daily_span(sales_of([("P", "c", "2024-06-29", 2, 1)])).collect()
    assert [(r.ds, r.y) for r in rows] == [(dt.date(2024, 6, 29), 2)]


def test_weeks_end_on_sunday(sales_of):
    sales = sales_of([("P", "c", "2024-01-01", 1, 1), ("P", "c", "2024-01-07", 2, 1), ("P", "c", "2024-01-22", 4, 1)])
    rows = demand.demand_weekly(sales).orderBy("ds").collect()
    assert [(r.ds.day, r.y) for r in rows] == [(7, 3), (14, 0), (21, 0), (28, 4)]
    assert demand.demand_weekly(sales, keep_zero=False).count() == 2


def test_smoothing_level(spark):
    fit = forecast.fit_simple(series(spark, [10, 20, 30])).first()
    assert fit.level == pytest.approx(18.1)


def test_line_is_extended(spark):
    rows = forecast.forecast_linear(series(spark, [2 * i + 1 for i in range(14)]), 3).orderBy("step").collect()
    assert [r.forecast for r in rows] == [29.0, 31.0, 33.0] and rows[0].trend == "Increasing"


@pytest.mark.parametrize("points, model", [(6, None), (7, "exponential_smoothing"), (13, "exponential_smoothing"), (14, "linear_regression")])
def test_method_choice_by_length(spark, points, model):
    rows = forecast.forecast_auto(series(spark, range(points)), 2).collect()
    assert ({r.model for r in rows} or {None}) == {model}


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        forecast.predict_demand(series(spark, [1]), 3, "oracle")


def test_all_simple_equals_single_methods(spark):
    history = series(spark, [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7, 9])
    both = {(r.model, r.step): r.forecast for r in forecast.forecast_all_simple(history, 2).collect()}
    for method in forecast.METHODS:
        for r in forecast.predict_demand(history, 2, method).collect():
            assert both[(method, r.step)] == r.forecast


def test_zero_rules_of_the_errors(spark):
    pairs = spark.createDataFrame([("s", "m", dt.date(2024, 1, i + 1), a, p) for i, (a, p) in enumerate([(0.0, 0.0), (0.0, 2.0), (4.0, 2.0)])],
                                  "series_id string, model string, ds date, actual double, predicted double")
    r = forecast.backtest_metrics(pairs).first()
    assert r.mae == pytest.approx(4 / 3, abs=1e-4) and r.mape_plus_one == pytest.approx((0 + 2 + 0.4) / 3 * 100, abs=1e-3)
    assert r.mape_floor_one == pytest.approx((0 + 2 + 0.5) / 3 * 100, abs=1e-3)
    assert r.mape_positive == r.mape_nonzero == 50.0
    assert r.smape == pytest.approx((2 + 2 / 3) / 2 * 100, abs=1e-3) and r.smape_zero == pytest.approx((2 + 2 / 3) / 3 * 100, abs=1e-3)
    assert r.mase == pytest.approx((4 / 3) / 2, abs=1e-4)


def test_weekly_horizons_use_whole_weeks(spark):
    rows = [("s", s, 7.0, 6.0, 8.0) for s in range(1, 14)]
    table = spark.createDataFrame(rows, "series_id string, step int, forecast double, lower double, upper double")
    got = {r.horizon_days: r for r in forecast.horizon_rollup(table, (5, 30, 90), weekly=True).collect()}
    assert [got[h].steps for h in (5, 30, 90)] == [1, 4, 12] and got[30].total_forecast == 28.0


def test_calendar_fit_recovers_its_coefficients(spark):
    days = [dt.date(2023, 1, 1) + dt.timedelta(days=i) for i in range(400)]
    rows = [("s", d, 5 + 0.1 * i + 2.0 * d.weekday() + 0.5 * d.month) for i, d in enumerate(days)]
    beta = forecast.fit_calendar(spark.createDataFrame(rows, "series_id string, ds date, y double")).first().beta
    assert beta == pytest.approx([5, 0.1, 2.0, 0.5], abs=1e-6)


def weekly_pattern(weeks=210, noise=0.0, seed=3):
    t = np.arange(weeks)
    rng = np.random.default_rng(seed)
    return 200 + 60 * np.sin(2 * np.pi * t / 52.18) + 0.3 * t + noise * rng.standard_normal(weeks)


def test_decomposition_follows_trend_and_season(spark):
    values = weekly_pattern(223)
    got = fleet.forecast_decomposable(series(spark, values[:210], step=7), 13).orderBy("step").collect()
    errors = [abs(r.forecast - v) / v for r, v in zip(got, values[210:])]
    assert max(errors) < 0.1 and all(r.lower <= r.forecast <= r.upper for r in got)


def test_seasonal_fit_tracks_and_repeats(spark):
    values = weekly_pattern(218, noise=4.0)
    history = series(spark, values[:210], step=7)
    first, second = (fleet.forecast_seasonal_ar(history, 8).orderBy("step").collect() for _ in range(2))
    assert first == second and len(first) == 8
    assert np.mean([abs(r.forecast - v) / v for r, v in zip(first, values[210:])]) < 0.15
    assert all(0 <= r.lower <= r.forecast <= r.upper for r in first)


def test_short_series_reports_its_error_only(spark):
    both = series(spark, weekly_pattern(150), "long", step=7).unionByName(series(spark, [1, 2, 3], "short", step=7))
    got = fleet.forecast_seasonal_ar(both, 4).collect()
    assert {r.series_id for r in got if r.error} == {"short"} and sum(r.series_id == "long" for r in got) == 4


def test_grid_search_prefers_the_true_order(spark):
    rng = np.random.default_rng(1)
    x = [0.0, 0.0]
    for _ in range(300):
        x.append(0.7 * x[-1] + rng.normal(0, 0.1))
    best = fleet.seasonal_ar_grid_search(series(spark, np.expm1(np.array(x) + 4)), 7, p=(0, 1), d=(0,), q=(0,), sp=(0,), sd=(0,), sq=(0,)).first()
    assert (best.p, best.fits) == (1, 2)


def test_lag_regressor_continues_a_cycle(spark):
    values = [math.sin(2 * math.pi * i / 12) * 10 + 20 for i in range(120)]
    got = fleet.forecast_lag_regressor(series(spark, values[:108], step=7), 12, ridge=0.0).orderBy("step").collect()
    assert max(abs(r.forecast - v) for r, v in zip(got, values[108:])) < 0.5


def test_result_does_not_depend_on_partitions(spark):
    values = series(spark, weekly_pattern(150, 5.0), step=7)
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = []
        for n in (1, 4, 17):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(forecast.forecast_all_simple(values, 3).orderBy("model", "step").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", keep)
    assert results[0] == results[1] == results[2]


def test_orders_are_judged_on_common_points():
    """A criterion over the same points does not depend on how many rows the order itself leaves."""
    from tallygrid.operators.fleet import seasonal_ar_fit
    y = 50 + 10 * np.sin(np.arange(160) / 4.0) + np.random.default_rng(1).normal(size=160)
    own = seasonal_ar_fit(y, (1, 0, 0), (0, 0, 0, 52))
    common = seasonal_ar_fit(y, (1, 0, 0), (0, 0, 0, 52), skip=60)
    last = own["residuals"][-100:]
    assert common["aic"] == pytest.approx(100 * np.log(last @ last / 100) + 2 * 3)
    with pytest.raises(ValueError, match="too few"):
        seasonal_ar_fit(y, (1, 0, 0), (0, 0, 0, 52), skip=158)


def test_series_whose_fit_fails_stay_in_the_test_of_residuals(spark):
    from tallygrid.operators import diagnostics
    rows = [("s", dt.date(2024, 1, 1) + dt.timedelta(days=i), i * 7 % 5 - 2.0, None) for i in range(60)] + [("bad", None, None, "too short")]
    frame = spark.createDataFrame(rows, "series_id string, ds date, residual double, error string")
    got = {r.series_id: r for r in diagnostics.ljung_box_of_fits(frame).collect()}
    assert set(got) == {"s", "bad"} and got["s"].error is None and got["s"].ljung_box > 0
    assert got["bad"].error == "too short" and got["bad"].ljung_box is None and got["bad"].no_autocorrelation is None


def test_fits_of_spans_need_no_zero_rows(spark):
    """Same fits as on the filled series, for a century between two sales too."""
    import datetime as dt
    rows = [("a", dt.date(2024, 1, d), y) for d, y in ((1, 5), (2, 0), (9, 7), (20, 3))] + [("one", dt.date(2024, 1, 1), 4)] + [
        ("week", dt.date(2024, 1, 1), 2), ("week", dt.date(2024, 1, 8), 9), ("far", dt.date(1920, 1, 1), 8), ("far", dt.date(2024, 1, 1), 6)]
    points = spark.createDataFrame(rows, "series_id string, ds date, y long")
    want = {r.series_id: r for r in forecast.fit_simple(demand.fill_gaps(points)).collect()}
    fits = forecast.fit_span(points)
    for r in fits.collect():
        w = want.pop(r.series_id)
        assert (r.n, r.last_ds, r.trailing) == (w.n, w.last_ds, w.trailing)
        for c in ("level", "slope", "intercept"):
            assert r[c] == w[c] or abs(r[c] - w[c]) < 1e-9
    assert not want
    assert "explode" not in fits._jdf.queryExecution().toString().lower()
