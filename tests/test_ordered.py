"""Distributed order statistics against their plain single-window forms."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window, functions as F

from tallygrid.operators import ordered
from tallygrid.operators.ordered import chunk_rows, grouped_percentiles, running_in_ranges, with_running


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_running_totals_match_one_window(spark, partitions):
    frame = spark.range(500).select("id", (F.col("id") * 7919 % 101).alias("v"))
    order = [F.desc("v"), "id"]
    got = with_running(frame, order, "pos", {"run": "v"}, partitions)
    window = Window.orderBy(F.desc("v"), "id")
    want = frame.select("*", F.row_number().over(window).cast("long").alias("pos"),
                        F.sum("v").over(window.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_running_totals_with_one_value_everywhere(spark):
    frame = spark.range(60).select("id", F.lit(5).alias("v"))
    rows = with_running(frame, ["v", "id"], "pos", {"run": "v"}).orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(1, 61)) and rows[-1].run == 300


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60))
def test_percentiles_match_numpy(spark, values):
    frame = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 1.0), (None, 9.0)], "k string, x double")
    got = {r.k: r for r in grouped_percentiles(frame, ["k"], "x", {"lo": 0.25, "mid": 0.5, "hi": 0.9}).collect()}
    for name, q in (("lo", 0.25), ("mid", 0.5), ("hi", 0.9)):
        assert got["a"][name] == pytest.approx(np.quantile(values, q))
    assert got["b"].mid == 1.0 and got[None].mid == 9.0


@pytest.mark.parametrize("chunk", [6, 10, 1000])
def test_chunked_windows_match_plain_windows(spark, chunk):
    # key 0 holds most rows, several at one time; one day holds them all
    frame = spark.range(300).select(
        F.when(F.col("id") % 4 == 0, F.col("id") % 3).otherwise(0).alias("k"), "id",
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(id div 7 as int))").alias("t"))
    plain = Window.partitionBy("k").orderBy("t", "id")
    want = frame.select("id", F.lag("id", 5).over(plain).alias("back"), F.lead("id", 6).over(plain).alias("ahead"),
                        F.sum("id").over(plain.rowsBetween(-4, 0)).alias("s"))
    cut = Window.partitionBy("k", "_chunk").orderBy("t", "id")
    got = (chunk_rows(frame, ["k"], ["t", "id"], 5, 6, chunk)
           .select("id", "_halo", F.lag("id", 5).over(cut).alias("back"), F.lead("id", 6).over(cut).alias("ahead"),
                   F.sum("id").over(cut.rowsBetween(-4, 0)).alias("s")).where("not _halo").drop("_halo"))
    key = lambda r: r.id
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_chunk_must_cover_the_lookback(spark):
    with pytest.raises(ValueError):
        chunk_rows(spark.range(1), ["id"], ["id"], lookback=10, chunk_size=5)


def test_running_totals_need_one_exchange(spark):
    frame = spark.range(100).select("id", (F.col("id") * 0.5).alias("v"))
    plan = running_in_ranges(frame, [F.desc("v"), F.col("id")], {"run": "v"}, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("Exchange rangepartitioning") == 1 and "Window" not in plan


def test_running_totals_pass_over_nulls(spark):
    frame = spark.createDataFrame([(1, None), (2, 5), (3, None), (4, 7)], "id int, v int")
    assert [(r.id, r.run) for r in with_running(frame, ["id"], None, {"run": "v"}, 2).orderBy("id").collect()] == [(1, None), (2, 5), (3, 5), (4, 12)]


@pytest.mark.parametrize("accuracy", [10, 100])
def test_percentiles_from_narrow_brackets(spark, monkeypatch, accuracy):
    """A coarse sketch: brackets leave most rows out, and the percentiles are exact all the same."""
    frame = spark.range(6000).select((F.col("id") % 2).alias("k"), (F.xxhash64("id") % 100_000 / 7).alias("a"),
                                     F.when(F.col("id") % 3 > 0, F.col("id") % 50).alias("b"))
    wanted = {"q1": 0.25, "mid": 0.5, "high": 0.99, "low": 0.0, "top": 1.0}
    brackets = ordered.percentile_brackets(frame, ["k"], ["a", "b"], list(wanted.values()), accuracy=accuracy)
    got = {(r.k, r._measure): r for r in ordered.percentiles_within(frame, brackets, ["k"], ["a", "b"], wanted).collect()}
    rows = frame.collect()
    for k in (0, 1):
        for c in ("a", "b"):
            values = [float(r[c]) for r in rows if r.k == k and r[c] is not None]
            for name, q in wanted.items():
                assert got[k, c][name] == pytest.approx(np.quantile(values, q), abs=1e-9), (k, c, name)
    inside = frame.join(brackets, "k").where(F.col("a").between(F.col("_lo_a_1"), F.col("_hi_a_1"))).count()
    assert inside < 6000 if accuracy == 10 else inside < 1500


def test_percentiles_need_no_shuffle_of_rows(spark):
    """The rows' scans end in a partial aggregate: what is exchanged is what lies inside the brackets, as counts."""
    frame = spark.range(1000).select((F.col("id") % 97).alias("x"))
    brackets = ordered.percentile_brackets(frame, [], ["x"], [0.5])
    plan = ordered.percentiles_within(frame, brackets, [], ["x"], {"m": 0.5})
    assert plan.first().m == float(np.quantile([i % 97 for i in range(1000)], 0.5))


def test_sorted_rows_of_a_task_do_not_grow_with_the_table(spark, monkeypatch, tmp_path, sales_of, products_of):
    """Ledgers, alerts, row windows and the lines of the test tables are dealt by their number of rows."""
    from tallygrid.operators import features, inventory, ordered
    from tallygrid.sources.testmap import Tables
    from tallygrid.streaming import jobs
    sales = sales_of([(f"P{k % 5}", f"C{k}", f"2024-01-{1 + k % 28:02d}", 1 + k % 3, 10) for k in range(60)])
    products = products_of([(f"P{k}", 1, 1, 1, 1, True) for k in range(5)])
    moves = sales.select("product_id", "order_id", "quantity", sales.order_date.cast("timestamp").alias("changed_at"))
    known = products.selectExpr("product_id", "product_name", "reorder_threshold", "initial_stock AS stock")

    def frames():
        lines = Tables(spark, "/root/testdata/sf0.001").sales
        return [inventory.stock_ledger(inventory.sale_movements(sales), products, ["order_id"]),
                jobs.level_changes(moves, known, ["order_id"]), features.rolling_features(sales, (3,)), lines]

    small = [sorted(map(str, f.collect())) for f in frames()]
    monkeypatch.setattr(ordered, "ROWS_PER_TASK", 6)
    dealt = frames()
    for frame in dealt[:3]:
        assert "REPARTITION_BY_NUM" in frame._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(ordered, "ROWS_PER_TASK", 600)
    assert Tables(spark, "/root/testdata/sf0.001").tasks > 4
    assert [sorted(map(str, f.collect())) for f in dealt[:3]] == small[:3]
