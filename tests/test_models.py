import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.functions import tails
from tallygrid.operators import diagnostics, features, training


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} double" for k in columns))


def test_tail_probabilities(spark):
    row = one(spark, t=2.2281, df=10.0, x=7.8147, f=3.4903, a=3.0, b=12.0, q=18.307, p=0.975, z=1.959964).select(
        tails.student_two_sided("t", "df").alias("t"), tails.chi2_tail_3("x").alias("c"), tails.f_upper("f", "a", "b").alias("f"),
        tails.chi2_tail_even(F.col("q"), 10).alias("q"), tails.normal_quantile("p").alias("n"), tails.normal_cdf("z").alias("z")).first()
    assert (row.t, row.c, row.f, row.q) == pytest.approx((0.05, 0.05, 0.05, 0.05), abs=1e-4)
    assert row.n == pytest.approx(1.959964, abs=1e-5) and row.z == pytest.approx(0.975, abs=1e-6)


def residuals(spark, values, key="s"):
    return spark.createDataFrame([(key, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)],
                                 "series_id string, ds date, residual double")


def test_normality_tests_tell_normal_from_skewed(spark):
    rng = np.random.default_rng(5)
    both = residuals(spark, rng.normal(size=400), "normal").unionByName(residuals(spark, rng.exponential(size=400), "skewed"))
    for test in (diagnostics.jarque_bera, diagnostics.dagostino_k2, diagnostics.ks_normal, diagnostics.anderson_darling):
        got = {r.series_id: r.normal for r in test(both).collect()}
        assert got == {"normal": True, "skewed": False}, test.__name__


def test_anderson_statistic_by_hand(spark):
    # five equally spaced points: checked against the sum written out
    x = np.array([-2.0, -1.0, 0.0, 1.0, 2.0])
    z = (x - x.mean()) / x.std(ddof=1)
    cdf = np.array([0.5 * (1 + __import__("math").erf(v / 2 ** 0.5)) for v in z])
    want = -5 - sum((2 * i + 1) * (np.log(cdf[i]) + np.log(1 - cdf[4 - i])) for i in range(5)) / 5
    assert diagnostics.anderson_darling(residuals(spark, x)).first().a2 == pytest.approx(want, abs=1e-4)


def test_autocorrelation_tests(spark):
    rng = np.random.default_rng(2)
    walk = np.cumsum(rng.normal(size=300))
    both = residuals(spark, rng.normal(size=300), "noise").unionByName(residuals(spark, walk, "walk"))
    assert {r.series_id: r.independent for r in diagnostics.durbin_watson(both).collect()} == {"noise": True, "walk": False}
    assert {r.series_id: r.no_autocorrelation for r in diagnostics.ljung_box(both).collect()} == {"noise": True, "walk": False}
    series = both.withColumnRenamed("residual", "y")
    got = {r.series_id: r for r in diagnostics.adf_test(series, log=False).collect()}
    assert got["noise"].stationary and not got["walk"].stationary
    assert got["noise"].critical_5 == pytest.approx(-2.871, abs=2e-3)


def test_short_series_adf_reports_error(spark):
    row = diagnostics.adf_test(residuals(spark, [1, 2, 3]).withColumnRenamed("residual", "y")).first()
    assert row.statistic is None and "short" in row.error


def history(spark, values):
    return spark.createDataFrame([("s", dt.date(2023, 1, 2) + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)],
                                 "series_id string, ds date, y double")


def test_influence_matches_direct_algebra(spark):
    rng = np.random.default_rng(0)
    values = rng.normal(10, 1, 120)
    values[60] = 40
    rows = diagnostics.cooks_distance(diagnostics.calendar_residuals(history(spark, values))).orderBy("ds").collect()
    days = [dt.date(2023, 1, 2) + dt.timedelta(days=i) for i in range(120)]
    x = np.array([[1, i, d.weekday(), d.month] for i, d in enumerate(days)], float)
    hat = x @ np.linalg.inv(x.T @ x) @ x.T
    e = values - hat @ values
    h, s2 = np.diag(hat), e @ e / (120 - 4)
    assert [r.cooks_d for r in rows] == pytest.approx(e ** 2 / (4 * s2) * h / (1 - h) ** 2, abs=1e-5)
    assert [r.leverage for r in rows] == pytest.approx(h, abs=1e-5) and rows[60].influential


def test_variance_test_matches_direct_algebra(spark):
    rng = np.random.default_rng(4)
    values = 50 + rng.normal(size=200) * np.linspace(0.2, 6, 200)
    got = diagnostics.breusch_pagan(diagnostics.calendar_residuals(history(spark, values))).first()
    days = [dt.date(2023, 1, 2) + dt.timedelta(days=i) for i in range(200)]
    x = np.array([[1, i, d.weekday(), d.month] for i, d in enumerate(days)], float)
    e2 = (values - x @ np.linalg.lstsq(x, values, rcond=None)[0]) ** 2
    fitted = x @ np.linalg.lstsq(x, e2, rcond=None)[0]
    r2 = 1 - ((e2 - fitted) ** 2).sum() / ((e2 - e2.mean()) ** 2).sum()
    assert got.lm == pytest.approx(200 * r2, abs=1e-3) and not got.constant_variance


def test_correlation_significance(spark):
    got = {r.feature: r for r in diagnostics.pearson_significance(history(spark, [0.5 * i for i in range(90)])).collect()}
    assert got["day_index"].significant and not got["weekday"].significant


@pytest.fixture(scope="module")
def lines(spark):
    rng = np.random.default_rng(9)
    rows = [(f"P{p}", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), p * 1000 + i, 1, int(5 + p + rng.integers(0, 3)), 10.0 + p)
            for p in range(4) for i in range(90)]
    return spark.createDataFrame(rows, "product_id string, order_date timestamp_ntz, order_id long, line_no int, quantity int, unit_price double")


def test_month_end_in_a_leap_year(spark):
    frame = spark.createDataFrame([(dt.datetime(2024, 2, 29),), (dt.datetime(2023, 12, 31),), (dt.datetime(2024, 12, 30),)], "order_date timestamp_ntz")
    rows = features.time_features(frame).orderBy("order_date").collect()
    assert [(r.is_month_end, r.is_quarter_end, r.iso_week, r.day_of_week) for r in rows] == [(1, 1, 52, 6), (1, 0, 9, 3), (0, 0, 1, 0)]


def test_lags_start_at_zero_and_targets_end_early(lines):
    first = features.lag_features(lines).where("product_id = 'P0'").orderBy("order_date").first()
    assert (first.quantity_lag_1, first.unit_price_lag_30) == (0.0, 0.0)
    assert features.future_target(lines).count() == 4 * 83
    rolled = features.rolling_features(lines).where("product_id = 'P0'").orderBy("order_date").first()
    assert rolled.quantity_rolling_std_7 == 0.0 and rolled.quantity_rolling_mean_30 == rolled.quantity


def test_chunk_size_does_not_change_the_feature_table(lines):
    order = ["product_id", "order_date"]
    big, small = (features.feature_table(lines, chunk=c).drop("product_id_encoded").orderBy(*order).collect() for c in (10_000, 366))
    assert big == small and len(big) == 4 * 83


def test_labels_follow_sorted_keys(lines):
    assert {r.product_id: r.product_id_encoded for r in features.label_index(lines).collect()} == {f"P{i}": i for i in range(4)}


def test_forest_trains_saves_and_loads(spark, lines, tmp_path):
    frame = training.split_by_date(training.training_frame(lines))
    model = training.train_demand_forest(frame.where("not is_test"), 10, 5)
    test = frame.where("is_test")
    scores = training.evaluate_forest(model, test).first()
    assert scores.mae < 1.5 and scores.performance in ("Excellent", "Good")
    path = str(tmp_path / "model")
    training.save_pipeline(model, path)
    again = training.load_pipeline(path)
    order = ["product_id", "order_date"]
    assert ([r.predicted for r in model.transform(test).orderBy(*order).collect()]
            == [r.predicted for r in again.transform(test).orderBy(*order).collect()])
    ranked = training.feature_importance(model, spark).collect()
    assert len(ranked) == 20 and sum(r.importance for r in ranked) == pytest.approx(1.0)


def test_ordered_split_goes_by_product(lines):
    marked = training.split_ordered(lines, 0.75)
    assert {r.product_id for r in marked.where("is_test").select("product_id").distinct().collect()} == {"P3"}


def test_registry_keeps_the_latest(spark, tmp_path):
    path = str(tmp_path / "registry")
    training.register_model(spark, path, "Toys", "forest", "2024-01-01", {"mae": 3.0}, "/a")
    training.register_model(spark, path, "Toys", "forest", "2024-02-01", {"mae": 2.0}, "/b")
    rows = training.model_registry(spark, path).collect()
    assert len(rows) == 1 and rows[0].location == "/b" and rows[0].metrics["mae"] == 2.0


@pytest.mark.parametrize("mape, band", [(9.9, "Excellent"), (10.0, "Good"), (20.0, "Acceptable"), (30.0, "Needs Improvement")])
def test_performance_bands(spark, mape, band):
    assert spark.range(1).select(training.performance_band(F.lit(mape)).alias("b")).first().b == band


def test_constant_series_do_not_fail(spark):
    flat = residuals(spark, [0.0] * 30)
    for test in (diagnostics.durbin_watson, diagnostics.ljung_box, diagnostics.jarque_bera, diagnostics.dagostino_k2,
                 diagnostics.ks_normal, diagnostics.anderson_darling):
        assert test(flat).count() <= 1
        test(flat).collect()
    fitted = diagnostics.calendar_residuals(history(spark, [5.0] * 40))
    for test in (diagnostics.breusch_pagan, diagnostics.cooks_distance):
        test(fitted).collect()


def test_steep_series_is_not_clamped():
    """A series that keeps growing is forecast to keep growing."""
    from tallygrid.operators.fleet import seasonal_ar_fit, seasonal_ar_path
    y = np.expm1(np.arange(140) * 0.1 + 0.01 * np.sin(np.arange(140)))
    mean, lower, upper = seasonal_ar_path(seasonal_ar_fit(y, (1, 1, 0), (0, 0, 0, 1)), 60)
    assert np.isfinite(upper).all() and (np.diff(mean) > 0).all() and mean[-1] > 20 * y.max()


def test_growth_from_zero(spark):
    from pyspark.sql import Window

    from tallygrid.operators.features import _growth
    rows = spark.createDataFrame([(1, 0), (2, 0), (3, 5), (4, 10)], "d int, quantity int")
    got = [r[1] for r in rows.select("d", _growth(1)(Window.orderBy("d"))).orderBy("d").collect()]
    assert got == [0.0, 0.0, 10.0, 1.0]
