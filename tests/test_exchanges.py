"""What large tables cost: rows dealt by their number, each fact moved as seldom and as narrow as can be."""

import datetime as dt

import pytest

from tallygrid.operators import backtest, demand, training
from tallygrid.plans import loading, sales as sales_plans
from tallygrid.plans.catalogue import queries
from tallygrid.sources.testmap import Tables

FOLDER = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def joins_by_exchange(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_lines_of_the_wide_table_move_twice(spark, joins_by_exchange):
    products = plan(queries()["load_denormalised_products"](spark, FOLDER))
    assert "hashpartitioning(ProductID" not in products
    wide = loading._wide(Tables(spark, FOLDER), "order").groupBy("OrderID").count(), loading._wide(Tables(spark, FOLDER)).groupBy("OrderID").count()
    assert sorted(wide[0].collect()) == sorted(wide[1].collect())


def test_summary_reads_its_columns_from_one_join(spark, monkeypatch):
    given = []
    monkeypatch.setattr(sales_plans.ops, "summary_stats", lambda frame, columns: given.append(frame) or frame)
    queries()["summary_stats"](spark, FOLDER)
    assert not any("lineitem" in f or "orders" in f for f in given[0].inputFiles())


def test_series_are_dealt_by_the_days_they_fill(spark, sales_of):
    sales = sales_of([(f"p{k}", "c", f"2024-03-{d:02}", 1, 2) for k in range(8) for d in (1, 9, 30)])
    points = demand.product_points(sales)
    assert demand.dealt_by_days(points, 61, 100).rdd.getNumPartitions() == 15  # 24 points of up to 61 days, 100 a task
    plain, dealt = (demand.demand_daily(sales, 60, dealt=d) for d in (False, True))
    assert sorted(plain.collect()) == sorted(dealt.collect()) and dealt.count() == 8 * 61
    assert dealt.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_ensemble_and_its_errors_need_one_exchange(spark, joins_by_exchange):
    start = dt.date(2024, 1, 1)
    pairs = spark.createDataFrame(
        [(s, o, start + dt.timedelta(days=d), 5.0, m, 4.0 + k + d) for s in "ab" for o in (20, 10) for d in range(3) for k, m in enumerate("xy")],
        "series_id string, origin int, ds date, actual double, model string, predicted double")
    both = backtest.with_ensemble(pairs, 5)
    assert both.count() == 2 * 2 * 3 * 3
    assert plan(both).count("Exchange hashpartitioning(") == 1 and "hashpartitioning(series_id" in plan(both)


def test_errors_write_only_the_columns_they_need(spark, monkeypatch):
    given = []
    real = training.windowed
    monkeypatch.setattr(training, "windowed", lambda frame, *rest: given.append(frame.columns) or real(frame, *rest))
    queries()["evaluate_rolling_mean"](spark, FOLDER)
    assert set(given[-1]) == {"product_id", "order_date", "order_id", "line_no", "quantity", "unit_price", training.TARGET, "predicted"}
