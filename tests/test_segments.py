import pytest
from pyspark.sql import functions as F

from tallygrid.operators import customers as cus
from tallygrid.operators import ensemble, pareto


def test_classes_of_the_textbook_split(sales_of, products_of):
    amounts = {"P1": 80000, "P2": 10000, "P3": 5000, "P4": 3000, "P5": 2000}
    sales = sales_of([(p, "c", "2024-01-01", 1, a) for p, a in amounts.items()])
    products = products_of([(p, 1, 1, 1, 1, True) for p in amounts])
    rows = pareto.abc_analysis(sales, products).orderBy("rank").collect()
    assert [r.abc_class for r in rows] == ["A", "B", "B", "C", "C"]
    assert [r.cumulative_pct for r in rows] == [80.0, 90.0, 95.0, 98.0, 100.0]
    summary = {r.abc_class: r for r in pareto.abc_class_summary(pareto.abc_analysis(sales, products)).collect()}
    assert sum(r.product_count for r in summary.values()) == 5 and summary["A"].total_revenue == 80000.0


def test_single_product_is_class_c_and_empty_classes_show(sales_of, products_of):
    sales = sales_of([("P", "c", "2024-01-01", 1, 10)])
    summary = {r.abc_class: r for r in pareto.abc_class_summary(
        pareto.abc_analysis(sales, products_of([("P", 1, 1, 1, 1, True)]))).collect()}
    assert [summary[c].product_count for c in "ABC"] == [0, 0, 1] and summary["A"].avg_revenue_per_product is None


def test_revenue_ties_rank_by_key(sales_of, products_of):
    sales = sales_of([(p, "c", "2024-01-01", 1, 10) for p in "DBCA"])
    rows = pareto.abc_analysis(sales, products_of([(p, 1, 1, 1, 1, True) for p in "ABCD"])).orderBy("rank").collect()
    assert [r.product_id for r in rows] == list("ABCD")


@pytest.mark.parametrize("n, want", [(5, [1, 2, 3, 4, 5]), (7, [1, 1, 2, 3, 4, 5, 5]), (1, [1])])
def test_frequency_quintiles_use_interpolated_edges(sales_of, n, want):
    rows = [("P", f"c{k}", "2024-01-01", 1, 10 * (k + 1)) for k in range(n) for _ in range(k + 1)]
    got = cus.rfm_scores(sales_of(rows), "2024-02-01").orderBy("customer_id").collect()
    assert [r.f_score for r in got] == want
    assert {r.r_score for r in got} == {5}  # equal recency lies below every edge


@pytest.mark.parametrize("r, f, m, nine, five", [
    (5, 5, 5, "Champions", "Champions"), (4, 3, 1, "Loyal Customers", "Loyal"), (3, 1, 4, "Potential Loyalists", "Others"),
    (4, 2, 1, "Recent Customers", "Others"), (3, 3, 3, "Promising", "Others"), (2, 4, 4, "At Risk", "At Risk"),
    (1, 3, 1, "Cant Lose Them", "At Risk"), (2, 2, 5, "Hibernating", "Lost"), (3, 2, 2, "Need Attention", "Others")])
def test_segment_rules(spark, r, f, m, nine, five):
    columns = [F.lit(v) for v in (r, f, m)]
    row = spark.range(1).select(cus.rfm_segment_9(*columns).alias("n"), cus.rfm_segment_5(*columns).alias("v")).first()
    assert (row.n, row.v) == (nine, five)


def test_cohort_with_a_skipped_month(sales_of):
    orders = sales_of([("P", "a", "2024-01-10", 1, 1), ("P", "a", "2024-03-02", 1, 1), ("P", "b", "2024-01-20", 1, 1),
                       ("P", "a", "2024-03-09", 1, 1)])
    rows = {(r.cohort_month, r.month_index): r for r in cus.cohort_retention(orders).collect()}
    assert set(rows) == {("2024-01", 0), ("2024-01", 2)}
    assert rows[("2024-01", 2)].retention_pct == 50.0 and rows[("2024-01", 0)].cohort_size == 2


def test_profile_without_orders_is_zero(spark, sales_of):
    customers = spark.createDataFrame([("x", "X", "New", "S")], "customer_id string, customer_name string, customer_type string, state string")
    row = cus.customer_profile(sales_of([("P", "a", "2024-01-10", 1, 1)]), customers).first()
    assert (row.total_orders, row.lifetime_value, row.last_purchase_date) == (0, 0.0, None)


def test_failed_member_and_equal_members(spark):
    pairs = spark.createDataFrame([("s", "a", 10.0, 11.0), ("s", "b", 10.0, 11.0)], "series_id string, model string, actual double, predicted double")
    equal = {r.model: r.weight for r in ensemble.ensemble_weights(pairs, ["a", "b"]).collect()}
    assert equal["a"] == pytest.approx(0.5)
    three = {r.model: r for r in ensemble.ensemble_weights(pairs, ["a", "b", "c"]).collect()}
    assert three["c"].smape == 100.0 and three["c"].weight < three["a"].weight
    assert sum(r.weight for r in three.values()) == pytest.approx(1.0)


def test_ensemble_renormalises_over_members_present(spark):
    forecast = spark.createDataFrame([("s", "a", 1, None, 10.0, 8.0, 12.0)], "series_id string, model string, step int, ds date, forecast double, lower double, upper double")
    weights = spark.createDataFrame([("s", "a", 0.2), ("s", "b", 0.8)], "series_id string, model string, weight double")
    row = ensemble.ensemble_forecast(forecast, weights).first()
    assert row.members == 1
    assert (row.forecast, row.lower, row.upper) == pytest.approx((10.0, 8.0, 12.0))


def test_all_revenue_zero_is_class_c(sales_of, products_of):
    sales = sales_of([("P", "c", "2024-01-01", 1, 0)])
    products = products_of([("P", 1, 1, 1, 1, True)])
    assert pareto.abc_analysis(sales, products).first().abc_class == "C"
    assert pareto.pareto_check(pareto.abc_exact(sales, products)).first().top_share_pct is None
    assert cus.customer_pareto(sales).first().cumulative_pct is None


def test_abc_snapshots_share_one_aggregation(spark, sales_of, products_of, monkeypatch):
    from pyspark.sql import functions as F
    from tallygrid.operators import pareto
    sales = sales_of([("A", "x", "2024-01-01", 1, 90), ("B", "x", "2024-01-02", 1, 9), ("C", "x", "2024-01-05", 1, 500), ("Z", "x", "2024-01-01", 1, 5)])
    products = products_of([(k, 1, 1, 1, 1, True) for k in "ABC"])
    days = [F.lit(d).cast("timestamp_ntz") for d in ("2024-01-03", "2024-02-01")]
    reads = []
    build = pareto.materialise
    monkeypatch.setattr(pareto, "materialise", lambda frame: reads.append(frame) or build(frame))
    got = pareto.abc_snapshots(sales, products, days)
    assert len(reads) == 1
    for day, snapshot in zip(days, got):
        want = pareto.abc_exact(sales.where(F.col("order_date") < day), products)
        columns = ["product_id", "revenue", "abc_rank", "abc_cumulative_pct", "abc_class"]
        assert sorted(snapshot.select(columns).collect()) == sorted(want.select(columns).collect())


def test_revenue_equal_but_for_the_last_bit_ranks_by_key(sales_of, products_of):
    # three times 0.1 is above 0.3 in the last bit of a double
    sales = sales_of([("a", "c", "2024-01-01", 1, 0.3)] + [("b", "c", "2024-01-01", 1, 0.1)] * 3)
    products = products_of([(p, 1, 1, 1, 1, True) for p in "ab"])
    assert [r.product_id for r in pareto.abc_analysis(sales, products).orderBy("rank").collect()] == ["a", "b"]
    assert [r.product_id for r in pareto.abc_exact(sales, products).orderBy("abc_rank").collect()] == ["a", "b"]
