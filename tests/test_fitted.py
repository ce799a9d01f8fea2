"""Stored parameters, encoders, scalers, keyed tables, summaries and rolling-origin backtests."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.operators import backtest, fitted, forecast, summary
from tallygrid.sources import keyed
from tallygrid.sources.versions import load_version, save_version, versions

D0 = dt.date(2024, 1, 1)


@pytest.fixture
def history(spark):
    dice = np.random.default_rng(3)
    rows = [(s, D0 + dt.timedelta(days=i), int(dice.integers(0, 20) + i * slope))
            for s, n, slope in (("long", 80, 0.3), ("mid", 61, 0.0), ("short", 10, 0.0), ("edge", 45, -0.2)) for i in range(n)]
    return spark.createDataFrame(rows, "series_id string, ds date, y int")


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_saved_and_direct_forecasts_are_equal(spark, history, tmp_path):
    path = str(tmp_path / "p")
    assert save_version(fitted.fit_parameters(history, holdout=8), path) == 1
    stored = load_version(spark, path)
    assert rows_of(fitted.forecast_best(stored, 5)) == rows_of(forecast.forecast_auto(history, 5))
    assert rows_of(fitted.forecast_members(stored, 5)) == rows_of(forecast.forecast_all_simple(history, 5))
    assert rows_of(fitted.forecast_calendar(stored, 5)) == rows_of(forecast.forecast_linear_calendar(history, 5))
    weights = {r.series_id: r.weights for r in stored.collect()}
    assert all(abs(sum(w.values()) - 1) < 1e-12 for w in weights.values()) and weights["long"][forecast.LINEAR] != weights["mid"][forecast.LINEAR]


def test_versions_are_kept_and_chosen(spark, tmp_path):
    path = str(tmp_path / "v")
    assert versions(spark, path) == []
    with pytest.raises(ValueError):
        load_version(spark, path)
    frame = lambda x: spark.createDataFrame([(x,)], "x int")
    assert [save_version(frame(x), path) for x in (1, 2)] == [1, 2]
    save_version(frame(5), path, 1)  # the same version again, as after a failure
    assert versions(spark, path) == [1, 2] and load_version(spark, path).first().x == 2 and load_version(spark, path, 1).collect()[0].x == 5


def test_codes_stay_when_keys_arrive(spark):
    early = spark.createDataFrame([("m",), ("c",), (None,), ("m",)], "product_id string")
    late = spark.createDataFrame([("a",), ("m",), ("z",), ("b",), (None,)], "product_id string")
    first = fitted.fit_encoder(early)
    second = fitted.extend_encoder(first, late)
    third = fitted.extend_encoder(second, early.unionByName(late))
    assert rows_of(first) == [("c", 0), ("m", 1)]
    assert rows_of(second) == rows_of(third) == [("a", 2), ("b", 3), ("c", 0), ("m", 1), ("z", 4)]
    assert rows_of(fitted.encode(late, first)) == [("a", -1), ("b", -1), ("m", 1), ("z", -1), (None, -1)]
    assert rows_of(fitted.extend_encoder(first.limit(0), early)) == rows_of(first)


def test_scalers_merge_without_the_rows(spark):
    rows = [(float(i), i % 7, 3.0, None) for i in range(50)]
    frame = spark.createDataFrame(rows, "x double, q int, flat double, none double")
    columns = ["x", "q", "flat", "none"]
    parts = [fitted.fit_scaler(frame.where(c), columns) for c in ("x < 3", "x between 3 and 30", "x > 30", "x > 900")]
    merged = {r.feature: r for r in fitted.merge_scalers(*parts).collect()}
    whole = {r.feature: r for r in fitted.fit_scaler(frame, columns).collect()}
    for c in columns[:3]:
        assert merged[c].n == whole[c].n and merged[c]["mean"] == pytest.approx(whole[c]["mean"]) and merged[c].m2 == pytest.approx(whole[c].m2)
    assert "none" not in merged and whole["none"].n == 0
    got = fitted.scale(frame, fitted.merge_scalers(*parts), columns).orderBy("x").collect()
    x = np.arange(50.0)
    assert [r.x for r in got] == pytest.approx(list((x - x.mean()) / x.std())) and {r.flat for r in got} == {0.0} and {r.none for r in got} == {None}


def test_rolling_fits_equal_fits_on_each_prefix(spark, history):
    """Every origin's forecasts equal those of a direct fit on the periods before it."""
    pairs = backtest.rolling_pairs(history).collect()
    assert {r.series_id for r in pairs} == {"long", "mid", "edge"} and {r.origin for r in pairs} == {30, 20, 10}
    got = {(r.series_id, r.origin, r.model, r.ds): r.predicted for r in pairs}
    assert len(got) == len(pairs) == 3 * 4 * 30
    data = {}
    for r in history.collect():
        data.setdefault(r.series_id, []).append((r.ds, r.y))
    for name in ("long", "mid", "edge"):
        days, y = zip(*sorted(data[name]))
        for origin in (30, 20, 10):
            n = len(y) - origin
            level = y[0]
            for v in y[1:n]:
                level = 0.3 * v + 0.7 * level
            slope, intercept = np.polyfit(range(n), y[:n], 1)
            design = np.array([[1, i, d.weekday(), d.month] for i, d in enumerate(days)], float)
            beta = np.linalg.pinv(design[:n]) @ np.array(y[:n], float)
            for i in range(n, n + 10):
                want = {forecast.MOVING_AVERAGE: np.mean(y[n - 7:n]), forecast.SMOOTHING: level, forecast.LINEAR: intercept + slope * i}
                if np.ptp(design[:n, 3]) > 0:
                    want[backtest.CALENDAR] = design[i] @ beta
                for model, value in want.items():
                    assert got[name, origin, model, days[i]] == pytest.approx(value, abs=1e-7), (name, origin, model)


def test_levels_over_many_blocks(spark, monkeypatch):
    frame = spark.range(700).select(F.lit("s").alias("series_id"), F.date_add(F.lit(D0), F.col("id").cast("int")).alias("ds"), (F.col("id") * 37 % 101).alias("y"))
    got = [r.level for r in backtest.running_fits(frame).orderBy("i").collect()]
    level, want = None, []
    for i in range(700):
        y = i * 37 % 101
        level = y if level is None else 0.3 * y + 0.7 * level
        want.append(level)
    assert got == pytest.approx(want, rel=1e-12)


def test_weights_see_earlier_origins_only(spark):
    rows = [("s", o, D0 + dt.timedelta(days=30 - o), 10.0, m, p) for o in (30, 20, 10)
            for m, p in (("good", 10.0), ("bad", 30.0 if o == 30 else 10.0))]
    pairs = spark.createDataFrame(rows, "series_id string, origin int, ds date, actual double, model string, predicted double")
    got = {r.origin: r.predicted for r in backtest.with_ensemble(pairs).where("model = 'ensemble'").collect()}
    assert got[30] == 20.0 and got[20] == pytest.approx(10.0) and got[10] == pytest.approx(10.0)


def files(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_upsert_rewrites_touched_folders_only(spark, tmp_path):
    path = str(tmp_path / "dim")
    stored = spark.range(200).select("id", F.lit("old").alias("name"), F.lit(1).alias("load_no"))
    keyed.write_keyed(stored, path, "id", 16)
    before = files(path)
    assert len(before) == 16
    fresh = spark.createDataFrame([(7, "new", 2), (7, "older", 0), (500, "added", 2)], "id long, name string, load_no int")
    touched = keyed.upsert_keyed(fresh, path, "id", "load_no")
    after = files(path)
    same = {f for f in before if after.get(f) == before[f]}
    assert touched in (1, 2) and len(same) == 16 - touched
    want = {(i, "new" if i == 7 else "old", 2 if i == 7 else 1) for i in range(200)} | {(500, "added", 2)}
    assert {tuple(r) for r in keyed.read_keyed(spark, path).collect()} == want
    keyed.upsert_keyed(fresh, path, "id", "load_no")  # the same load again
    assert {tuple(r) for r in keyed.read_keyed(spark, path).collect()} == want
    assert keyed.upsert_keyed(fresh.limit(0), path, "id", "load_no") == 0


def test_summary_grows_by_batches(spark, sales_of, tmp_path):
    path = str(tmp_path / "s")
    batches = [[("A", "c", "2024-01-01", 5, 1), ("B", "c", "2024-01-02", 2, 1)], [("A", "c", "2024-01-20", 3, 1), ("A", "c", "2024-01-21", 9, 1, "Cancelled")],
               [("A", "c", "2024-01-01", 1, 1), ("A", "c", "2024-02-01", 4, 1)]]
    for i, rows in enumerate(batches):
        summary.store_batch(sales_of(rows), path, i)
    summary.store_batch(sales_of(batches[1]), path, 1)  # once more, as after a failure
    moment = F.lit("2024-02-02").cast("timestamp_ntz")
    want = {"A": (dt.datetime(2024, 2, 1), 7), "B": (dt.datetime(2024, 1, 2), None)}

    def got(place):
        return {r.product_id: (r.last_sale, r.sold) for r in summary.product_summary(summary.stored_days(spark, place), moment).collect()}

    assert got(path) == want
    whole = sales_of([r for rows in batches for r in rows])
    assert {r.product_id: (r.last_sale, r.sold) for r in summary.product_summary(summary.product_days(whole), moment).collect()} == want
    summary.compact(spark, path, str(tmp_path / "c"))
    assert got(str(tmp_path / "c")) == want
