"""ABC and Pareto classification.

The running total over all products is range-partitioned (see ``ordered``), so
no task ever holds every product.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import delivered, money, rnd, share_of
from .ordered import materialise, with_running, with_scalars, with_totals

CLASSES = ["A", "B", "C"]

# Management advice per class.
ADVICE = {
    "A": ("High-Value Products (A Items)", [
        "Maintain tight inventory control", "Monitor stock levels daily",
        "Prioritize these items for restocking", "Negotiate better supplier terms",
        "Implement safety stock policies"]),
    "B": ("Medium-Value Products (B Items)", [
        "Review inventory weekly", "Standard safety stock levels",
        "Monitor for movement to A or C class", "Consider promotional opportunities"]),
    "C": ("Low-Value Products (C Items)", [
        "Minimize inventory investment", "Consider reducing SKU count", "Bulk order to reduce costs",
        "Review for potential discontinuation", "May include dead stock candidates"]),
}

# Stocking policy per class.
POLICY_FIELDS = ["reorder_frequency", "safety_stock", "monitoring", "supplier_strategy", "forecasting"]
POLICY = {
    "A": ["Weekly", "High (2-3 weeks)", "Daily", "Multiple reliable suppliers", "Advanced models required"],
    "B": ["Bi-weekly", "Medium (1-2 weeks)", "Weekly", "Primary + backup supplier", "Standard forecasting"],
    "C": ["Monthly", "Low (minimal)", "Monthly", "Single supplier acceptable", "Simple moving average"],
}


def abc_class(cumulative: Column, a: float = 80.0, b: float = 95.0) -> Column:
    return F.when(cumulative <= a, "A").when(cumulative <= b, "B").otherwise("C")


def _falling(measure: str) -> list[Column | str]:
    """Falling order of a sum. Its last bits depend on row order, so equal sums are settled first and then go by key."""
    return [F.desc(F.round(measure, 6)), "product_id"]


def abc_product_revenue(sales: DataFrame, products: DataFrame, only_delivered: bool = True) -> DataFrame:
    """Revenue and quantity per product; names come from the products by lookup."""
    kept = sales.where(delivered()) if only_delivered else sales
    sums = kept.groupBy("product_id").agg(
        F.sum("total_amount").alias("total_revenue"), F.sum("quantity").alias("total_quantity"))
    return sums.join(products.select("product_id", "product_name", "category"), "product_id", "left")


def abc_analysis(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Classes from the running sum of rounded revenue shares.

    Shares are summed as whole hundredths of a percent, so the running sum is exact.
    """
    totalled = with_totals(abc_product_revenue(sales, products), F.sum("total_revenue").alias("_all"))
    hundredths = F.round(rnd(F.try_divide("total_revenue", "_all") * 100, 2) * 100).cast("long")
    shared = totalled.withColumn("_h", hundredths).drop("_all")
    ranked = with_running(shared, _falling("total_revenue"), "rank", {"_c": "_h"})
    cumulative = F.col("_c") / 100
    return ranked.select(
        "product_id", "product_name", "category", money("total_revenue").alias("total_revenue"), "total_quantity",
        (F.col("_h") / 100).alias("revenue_pct"), cumulative.alias("cumulative_pct"),
        abc_class(cumulative).alias("abc_class"), "rank")


def _classified(base: DataFrame, measure: str, label: str, a: float = 80.0, b: float = 95.0) -> DataFrame:
    """Running share of a measure in descending order, and the class it gives."""
    ranked = with_running(base, _falling(measure), f"{label}_rank", {"_c": measure})
    total = ranked.agg(F.sum(measure).alias("_all"), F.count(F.lit(1)).alias("_n"))
    cumulative = F.try_divide("_c", "_all") * 100
    return with_scalars(ranked, total).select(
        *base.columns, f"{label}_rank", cumulative.alias(f"{label}_cumulative_pct"),
        (F.col(f"{label}_rank") / F.col("_n") * 100).alias(f"{label}_product_pct"),
        abc_class(cumulative, a, b).alias(f"{label}_class"))


def abc_exact(sales: DataFrame, products: DataFrame, a: float = 80.0, b: float = 95.0) -> DataFrame:
    """Classes from the unrounded running share, over all order states."""
    base = sales.groupBy("product_id").agg(
        F.sum("total_amount").alias("revenue"), F.sum("profit").alias("profit"), F.sum("quantity").alias("units"))
    named = base.join(products.select("product_id", "category", "brand"), "product_id")
    return _classified(named, "revenue", "abc", a, b)


def abc_snapshots(sales: DataFrame, products: DataFrame, days: Sequence[Column]) -> list[DataFrame]:
    """Revenue classes (as ``abc_exact``) of the sales before each day, all from one aggregation of the lines."""
    sums = []
    for k, day in enumerate(days):
        before = F.col("order_date") < day
        sums += [F.sum(F.when(before, F.col("total_amount"))).alias(f"_r{k}"), F.count(F.when(before, 1)).alias(f"_n{k}")]
    latest = F.greatest(*days) if len(days) > 1 else days[0]
    totals = sales.where(F.col("order_date") < latest).groupBy("product_id").agg(*sums)
    kept = materialise(totals.join(products.select("product_id"), "product_id"))
    return [_classified(kept.where(F.col(f"_n{k}") > 0).select("product_id", F.col(f"_r{k}").alias("revenue")), "revenue", "abc")
            for k in range(len(days))]


def abc_all_status(sales: DataFrame, products: DataFrame) -> DataFrame:
    base = abc_product_revenue(sales, products, only_delivered=False)
    return _classified(base, "total_revenue", "abc").select(
        "product_id", "product_name", "category", money("total_revenue").alias("total_revenue"),
        "total_quantity", "abc_class")


def abc_class_summary(classified: DataFrame) -> DataFrame:
    """Counts, shares and means per class; a class without products shows zeros."""
    spark = classified.sparkSession
    fixed = spark.range(3).select(F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (F.col("id") + 1).cast("int"))
                                  .alias("abc_class"))
    sums = classified.groupBy("abc_class").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_revenue").alias("r"),
        F.sum("revenue_pct").alias("p"), F.sum("total_quantity").alias("q"))
    total = classified.agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce("n", F.lit(0))
    return with_scalars(fixed.join(sums, "abc_class", "left"), total).select(
        "abc_class", n.alias("product_count"), share_of(n, F.col("_n"), 1).alias("product_pct"),
        money(F.coalesce("r", F.lit(0.0))).alias("total_revenue"),
        rnd(F.coalesce("p", F.lit(0.0)), 1).alias("revenue_pct"), F.coalesce("q", F.lit(0)).alias("total_quantity"),
        money(F.col("r") / F.col("n")).alias("avg_revenue_per_product"))


def abc_recommendations(classified: DataFrame) -> DataFrame:
    """One row per class and piece of advice."""
    rows = [(c, title, i + 1, text) for c, (title, texts) in ADVICE.items() for i, text in enumerate(texts)]
    advice = classified.sparkSession.createDataFrame(rows, "abc_class string, title string, item int, recommendation string")
    return F.broadcast(advice).join(
        abc_class_summary(classified).select("abc_class", "product_count", "revenue_pct"), "abc_class")


def abc_policies(spark) -> DataFrame:
    rows = [(c, *values) for c, values in POLICY.items()]
    return spark.createDataFrame(rows, ", ".join(["abc_class string"] + [f"{f} string" for f in POLICY_FIELDS]))


def abc_with_policy(classified: DataFrame) -> DataFrame:
    """Each product with the stocking policy of its class."""
    return classified.join(F.broadcast(abc_policies(classified.sparkSession)), "abc_class")


def abc_top(classified: DataFrame, n: int = 10, only: str | None = None) -> DataFrame:
    kept = classified if only is None else classified.where(F.col("abc_class") == only)
    return kept.orderBy("rank").limit(n)


def abc_by_category(classified: DataFrame) -> DataFrame:
    return classified.groupBy("category", "abc_class").agg(
        F.count(F.lit(1)).alias("product_count"), money(F.sum("total_revenue")).alias("total_revenue"),
        F.sum("total_quantity").alias("total_quantity"))


def abc_category_mix(classified: DataFrame) -> DataFrame:
    """Class counts and percentages per category; ``abc_exact`` rows go in."""
    counts = {c: F.count(F.when(F.col("abc_class") == c, 1)).alias(f"{c.lower()}_products") for c in CLASSES}
    sums = classified.groupBy("category").agg(
        F.count(F.lit(1)).alias("products"), money(F.sum("revenue")).alias("revenue"),
        money(F.sum("profit")).alias("profit"), F.sum("units").alias("units"), *counts.values())
    return sums.select("*", *[share_of(F.col(f"{c.lower()}_products"), F.col("products")).alias(f"{c.lower()}_pct")
                              for c in CLASSES])


def abc_volume(exact: DataFrame, a: float = 80.0, b: float = 95.0) -> DataFrame:
    """Add the class by units sold to ``abc_exact`` rows."""
    return _classified(exact, "units", "volume", a, b)


def abc_volume_matrix(exact: DataFrame) -> DataFrame:
    """Revenue class against volume class."""
    columns = [F.count(F.when(F.col("volume_class") == c, 1)).alias(f"volume_{c.lower()}") for c in CLASSES]
    return abc_volume(exact).groupBy("abc_class").agg(*columns)


# Labels of the combined classes.
COMBINED = ["AA - High Priority", "A - Important", "BB - Medium Priority", "B - Moderate", "CC - Low Priority"]


def combined_class(revenue: Column, volume: Column) -> Column:
    return (F.when((revenue == "A") & (volume == "A"), COMBINED[0])
            .when((revenue == "A") | (volume == "A"), COMBINED[1])
            .when((revenue == "B") & (volume == "B"), COMBINED[2])
            .when((revenue == "B") | (volume == "B"), COMBINED[3]).otherwise(COMBINED[4]))


def abc_combined(exact: DataFrame) -> DataFrame:
    return abc_volume(exact).withColumn("combined_class", combined_class(F.col("abc_class"), F.col("volume_class")))


def abc_combined_summary(exact: DataFrame) -> DataFrame:
    return abc_combined(exact).groupBy("combined_class").agg(
        F.count(F.lit(1)).alias("products"), money(F.sum("revenue")).alias("revenue"), F.sum("units").alias("units"))


def pareto_check(exact: DataFrame, top: float = 0.2) -> DataFrame:
    """Revenue share of the top fifth of products, and how concentrated class A is."""
    n = exact.agg(F.count(F.lit(1)).alias("_n"), F.sum("revenue").alias("_all"))
    first = F.col("abc_rank") <= F.floor(F.col("_n") * top)
    in_a = F.col("abc_class") == "A"
    sums = with_scalars(exact, n).agg(
        F.max("_n").alias("products"), F.max("_all").alias("_r"), F.sum(F.when(first, F.col("revenue"))).alias("top"),
        F.count(F.when(in_a, 1)).alias("a_products"), F.sum(F.when(in_a, F.col("revenue"))).alias("a"))
    return sums.select(
        "products", "a_products", rnd(F.try_divide(F.coalesce("top", F.lit(0.0)), F.col("_r")) * 100, 2).alias("top_share_pct"),
        rnd(F.try_divide(F.try_divide("a", "_r"), F.col("a_products") / F.col("products")), 2).alias("pareto_ratio"))
