"""Customer value, recency-frequency-monetary segments, and cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import calendar as cal
from ..functions.columns import anchor, delivered, money, rnd, share_of, whole_days
from .ordered import with_running, with_scalars


def customer_ltv(sales: DataFrame) -> DataFrame:
    """Delivered revenue per customer."""
    return sales.where(delivered()).groupBy("customer_id").agg(
        money(F.sum("total_amount")).alias("lifetime_value"))


def customer_rfm(sales: DataFrame, as_of=None, only_delivered: bool = True, distinct_orders: bool = False) -> DataFrame:
    """Recency in days, frequency and spend per customer."""
    moment = anchor(sales, as_of)
    kept = sales.where(delivered()) if only_delivered else sales
    count = F.count_distinct("order_id") if distinct_orders else F.count(F.lit(1))
    sums = kept.groupBy("customer_id").agg(
        F.max("order_date").alias("_last"), count.alias("frequency"), F.sum("total_amount").alias("monetary"))
    return sums.select("customer_id", whole_days(moment, F.col("_last")).alias("recency"), "frequency", "monetary")


def _rank_quintile(rank: Column, n: Column) -> Column:
    """Quintile 1 to 5 of a rank among n, with linear-interpolated edges closed on the right."""
    score = F.when(n > 1, F.ceil(5 * (rank - 1) / (n - 1))).otherwise(F.lit(1))
    return F.greatest(F.lit(1), score.cast("int"))


def rfm_scores(sales: DataFrame, as_of=None, only_delivered: bool = True, distinct_orders: bool = False) -> DataFrame:
    """Quintile scores: low recency scores high; frequency and spend by rank.

    The recency edges are exact percentiles over a histogram of whole days, whose
    size is set by the calendar and not by the number of customers.
    """
    base = customer_rfm(sales, as_of, only_delivered, distinct_orders)
    ranked = with_running(base, ["frequency", "customer_id"], "_f")
    ranked = with_running(ranked, ["monetary", "customer_id"], "_m")
    days = ranked.groupBy("recency").agg(F.count(F.lit(1)).alias("_c"))
    edges = days.agg(F.expr("percentile(recency, array(0.2D, 0.4D, 0.6D, 0.8D), _c)").alias("_edges"),
                     F.sum("_c").alias("_n"))
    r = 5 - F.size(F.filter("_edges", lambda e: e < F.col("recency")))
    scored = with_scalars(ranked, edges).select(
        "customer_id", "recency", "frequency", money("monetary").alias("monetary"), r.alias("r_score"),
        _rank_quintile(F.col("_f"), F.col("_n")).alias("f_score"),
        _rank_quintile(F.col("_m"), F.col("_n")).alias("m_score"))
    return scored.withColumn("rfm_total", F.col("r_score") + F.col("f_score") + F.col("m_score")).withColumn(
        "rfm_score", F.concat(*[F.col(c).cast("string") for c in ("r_score", "f_score", "m_score")]))


def rfm_segment_4(total: Column) -> Column:
    return F.when(total >= 12, "VIP").when(total >= 9, "Regular").when(total >= 6, "At-Risk").otherwise("Lost")


def rfm_segment_9(r: Column, f: Column, m: Column) -> Column:
    """Nine segments; the first rule that holds decides."""
    return (F.when((r >= 4) & (f >= 4) & (m >= 4), "Champions")
            .when((r >= 4) & (f >= 3), "Loyal Customers")
            .when((r >= 3) & (m >= 4), "Potential Loyalists")
            .when((r >= 4) & (f <= 2), "Recent Customers")
            .when((r >= 3) & (f >= 3) & (m >= 3), "Promising")
            .when((r <= 2) & (f >= 4) & (m >= 4), "At Risk")
            .when((r <= 2) & (f >= 3), "Cant Lose Them")
            .when(r <= 2, "Hibernating")
            .otherwise("Need Attention"))


def rfm_segment_5(r: Column, f: Column, m: Column) -> Column:
    return (F.when((r >= 4) & (f >= 4) & (m >= 4), "Champions").when((r >= 4) & (f >= 3), "Loyal")
            .when((r <= 2) & (f >= 3), "At Risk").when(r <= 2, "Lost").otherwise("Others"))


def with_segments(scores: DataFrame) -> DataFrame:
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return scores.select(
        "*", rfm_segment_4(F.col("rfm_total")).alias("segment_4"), rfm_segment_5(r, f, m).alias("segment_5"),
        rfm_segment_9(r, f, m).alias("segment_9"))


def rfm_segment_summary(segmented: DataFrame, segment: str) -> DataFrame:
    return segmented.groupBy(F.col(segment).alias("segment")).agg(
        F.count(F.lit(1)).alias("customers"), rnd(F.avg("recency"), 2).alias("avg_recency"),
        rnd(F.avg("frequency"), 2).alias("avg_frequency"), money(F.avg("monetary")).alias("avg_monetary"),
        money(F.sum("monetary")).alias("total_monetary"))


def rfm_heatmap(scores: DataFrame) -> DataFrame:
    """Mean spend by recency score (rows) and frequency score (columns)."""
    return (scores.groupBy("r_score").pivot("f_score", [1, 2, 3, 4, 5]).agg(money(F.avg("monetary")))
            .select("r_score", *[F.col(str(i)).alias(f"f{i}") for i in range(1, 6)]))


def customer_profile(sales: DataFrame, customers: DataFrame) -> DataFrame:
    """Delivered order count, value, mean and last date; zeros without orders."""
    sums = sales.where(delivered()).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_amount").alias("v"), F.max("order_date").alias("last"))
    zero = F.lit(0.0)
    return customers.join(sums, "customer_id", "left").select(
        "customer_id", "customer_name", "customer_type", "state", F.coalesce("n", F.lit(0)).alias("total_orders"),
        money(F.coalesce("v", zero)).alias("lifetime_value"),
        money(F.coalesce(F.col("v") / F.col("n"), zero)).alias("avg_order_value"),
        F.to_date("last").alias("last_purchase_date"))


def customer_summary(sales: DataFrame) -> DataFrame:
    """Distinct orders, spend, profit, items and dates per customer, all order states."""
    per_order = sales.groupBy("customer_id", "order_id").agg(
        F.sum("total_amount").alias("v"), F.sum("profit").alias("p"), F.sum("quantity").alias("q"),
        F.min("order_date").alias("first"), F.max("order_date").alias("last"))
    return per_order.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("v").alias("total_spent"), F.sum("p").alias("total_profit"),
        F.sum("q").alias("total_items"), F.to_date(F.min("first")).alias("first_order"),
        F.to_date(F.max("last")).alias("last_order")).withColumn(
        "avg_order_value", F.col("total_spent") / F.col("orders"))


def clv_score(sales: DataFrame, n: int = 20) -> DataFrame:
    """Spend times yearly order rate; the customers with the highest spend."""
    days = F.datediff("last_order", "first_order")
    years = F.when(days == 0, F.lit(1)).otherwise(days) / 365
    scored = customer_summary(sales).select(
        "customer_id", "orders", money("total_spent").alias("total_spent"), days.alias("lifetime_days"),
        money(F.col("total_spent") * (F.col("orders") / years)).alias("clv_score"))
    return scored.orderBy(F.desc("total_spent"), "customer_id").limit(n)


def customer_pareto(sales: DataFrame) -> DataFrame:
    """Running share of revenue against share of customers."""
    spend = sales.groupBy("customer_id").agg(F.sum("total_amount").alias("spent"))
    ranked = with_running(spend, [F.desc("spent"), "customer_id"], "rank", {"_c": "spent"})
    total = ranked.agg(F.sum("spent").alias("_all"), F.count(F.lit(1)).alias("_n"))
    return with_scalars(ranked, total).select(
        "customer_id", money("spent").alias("total_spent"), "rank",
        rnd(F.try_divide("_c", "_all") * 100, 4).alias("cumulative_pct"),
        rnd(F.col("rank") / F.col("_n") * 100, 4).alias("customer_pct"))


def customers_for_share(pareto: DataFrame, share: float = 80.0) -> DataFrame:
    """Smallest share of customers that brings the given share of revenue."""
    return pareto.where(F.col("cumulative_pct") >= share).agg(F.min("customer_pct").alias("customer_pct"))


def cohort_retention(orders: DataFrame) -> DataFrame:
    """Customers active by months since their first order, and share of the cohort.

    Each customer is folded to the set of months they ordered in, which the
    calendar bounds, in one shuffle; no window over raw orders is needed.
    """
    month = cal.month_index(F.col("order_date"))
    months = orders.groupBy("customer_id").agg(F.collect_set(month).alias("_months"))
    first = F.array_min("_months")
    active = months.select(first.alias("cohort"), F.explode("_months").alias("m")).select(
        "cohort", (F.col("m") - F.col("cohort")).alias("month_index"))
    counts = active.groupBy("cohort", "month_index").agg(F.count(F.lit(1)).alias("customers"))
    # one row per cohort and month, so the window is bounded by the calendar
    size = F.max(F.when(F.col("month_index") == 0, F.col("customers"))).over(Window.partitionBy("cohort"))
    label = F.format_string("%04d-%02d", F.floor((F.col("cohort") - 1) / 12).cast("int"),
                            ((F.col("cohort") - 1) % 12 + 1).cast("int"))
    return counts.withColumn("cohort_size", size).select(
        label.alias("cohort_month"), "month_index", "customers", "cohort_size",
        share_of(F.col("customers"), F.col("cohort_size")).alias("retention_pct"))
