"""Sales, product and category reporting.

Facts are reduced to one row per product (or period) before any dimension join,
so a hot product is folded by the map-side combine and never shuffled row by row.
Windows without a partition appear only over calendar rows, whose number is set
by the date span and not by the data volume.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import calendar as cal
from ..functions.columns import anchor, days_before, delivered, money, not_cancelled, rnd, share_of
from .ordered import materialise, percentile_brackets, percentiles_within, with_scalars, with_totals

METRIC_COLUMNS = {"revenue": "total_amount", "profit": "profit", "quantity": "quantity"}


def sales_fact(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Order headers joined to their lines."""
    return orders.join(items, "order_id")


def sales_product_fact(sales: DataFrame, products: DataFrame, how: str = "inner") -> DataFrame:
    return sales.join(products, "product_id", how)


def product_totals(sales: DataFrame) -> DataFrame:
    """Revenue, profit, units and order rows per product."""
    return sales.groupBy("product_id").agg(
        F.sum("total_amount").alias("revenue"), F.sum("profit").alias("profit"),
        F.sum("quantity").alias("units"), F.count(F.lit(1)).alias("order_rows"))


def top_products(sales: DataFrame, products: DataFrame, metric: str = "revenue", n: int = 10,
                 as_of=None, days: int = 30) -> DataFrame:
    """Best products by revenue, profit, quantity or recent velocity."""
    names = products.select("product_id", "product_name", "category")
    if metric == "velocity":
        moment = anchor(sales, as_of)
        sold = (sales.where(not_cancelled() & (F.col("order_date") >= days_before(moment, days)))
                .groupBy("product_id").agg(F.sum("quantity").alias("sold")))
        value = rnd(F.coalesce("sold", F.lit(0)) / days, 2)
        ranked = names.join(sold, "product_id", "left")
    elif metric in METRIC_COLUMNS:
        summed = (sales.where(delivered()).groupBy("product_id")
                  .agg(F.sum(METRIC_COLUMNS[metric]).cast("double").alias("sold")))
        value = money("sold")
        ranked = names.join(summed, "product_id")
    else:
        raise ValueError(f"unknown metric: {metric}")
    return (ranked.select("product_id", "product_name", "category", value.alias("value"))
            .orderBy(F.desc("value"), "product_id").limit(n))


def sales_trends(sales: DataFrame, period: str = "daily", days: int = 30, as_of=None,
                 only_delivered: bool = True) -> DataFrame:
    """Totals per day, week or month over the last days."""
    recent = sales.where(F.col("order_date") >= days_before(anchor(sales, as_of), days))
    if only_delivered:
        recent = recent.where(delivered())
    return (recent.groupBy(cal.period_label(F.col("order_date"), period).alias("period"))
            .agg(money(F.sum("total_amount")).alias("total_sales"),
                 F.count(F.lit(1)).alias("order_rows"),
                 money(F.coalesce(F.sum("profit"), F.lit(0.0))).alias("total_profit"),
                 money(F.avg("total_amount")).alias("avg_order_value"))
            .orderBy("period"))


def sales_trends_all_status(sales: DataFrame, days: int = 30, as_of=None) -> DataFrame:
    return (sales_trends(sales, "daily", days, as_of, only_delivered=False)
            .drop("total_profit"))


def _monthly(sales: DataFrame) -> DataFrame:
    return (sales.where(delivered()).groupBy(cal.month_label(F.col("order_date")).alias("month"))
            .agg(F.sum("total_amount").alias("revenue"), F.sum("profit").alias("profit"),
                 F.count(F.lit(1)).alias("order_rows"), F.sum("quantity").alias("units_sold")))


def monthly_sales_trend(sales: DataFrame, months: int = 12) -> DataFrame:
    """Revenue, profit, loss and growth for the last months that have sales."""
    kept = _monthly(sales).orderBy(F.desc("month")).limit(months)
    by_month = Window.orderBy("month")
    prev_rev, prev_profit = F.lag("revenue").over(by_month), F.lag("profit").over(by_month)
    revenue, profit = F.col("revenue"), F.col("profit")
    return kept.select(
        "month", money(revenue).alias("revenue"), money(profit).alias("profit"),
        F.when(profit < 0, money(-profit)).otherwise(F.lit(0.0)).alias("loss"),
        F.when(revenue > 0, rnd(profit / revenue * 100, 2)).otherwise(F.lit(0.0)).alias("profit_margin"),
        "order_rows", "units_sold", money(revenue / F.col("order_rows")).alias("avg_order_value"),
        F.when(prev_rev > 0, rnd((revenue - prev_rev) / prev_rev * 100, 2)).alias("revenue_growth_pct"),
        F.when(prev_profit != 0, rnd((profit - prev_profit) / F.abs(prev_profit) * 100, 2))
        .alias("profit_growth_pct"))


def monthly_summary(sales: DataFrame, months: int = 12) -> DataFrame:
    """Totals over the monthly trend, from its rounded values."""
    total = monthly_sales_trend(sales, months).agg(
        F.sum("revenue").alias("r"), F.sum("profit").alias("p"), F.count(F.lit(1)).alias("months_analyzed"))
    r, p, n = F.col("r"), F.col("p"), F.col("months_analyzed")
    return total.select(
        money(r).alias("total_revenue"), money(p).alias("total_profit"),
        money(r / n).alias("avg_monthly_revenue"),
        F.when(r > 0, rnd(p / r * 100, 2)).otherwise(F.lit(0.0)).alias("avg_profit_margin"), "months_analyzed")


def month_span(year: int, month: int) -> tuple[str, str, str]:
    """First day of the previous month, of this month, and of the next."""
    index = year * 12 + month - 1
    return tuple(f"{i // 12:04d}-{i % 12 + 1:02d}-01" for i in (index - 1, index, index + 1))


def _at(day: str) -> Column:
    return F.lit(day).cast("timestamp_ntz")


def in_month(sales: DataFrame, year: int, month: int) -> DataFrame:
    """Delivered sales of one month; the literal bounds prune files and row groups."""
    _, start, end = month_span(year, month)
    return sales.where(delivered() & (F.col("order_date") >= _at(start)) & (F.col("order_date") < _at(end)))


def _month_pair(sales: DataFrame, year: int, month: int) -> DataFrame:
    before, start, end = month_span(year, month)
    both = sales.where(delivered() & (F.col("order_date") >= _at(before)) & (F.col("order_date") < _at(end)))
    this = F.col("order_date") >= _at(start)

    def total(column: str, inside: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(inside, F.col(column))), F.lit(0)).alias(name)

    return both.agg(
        total("total_amount", this, "revenue"), total("profit", this, "profit"),
        total("quantity", this, "units"), F.count(F.when(this, 1)).alias("orders"),
        total("total_amount", ~this, "prev_revenue"), total("profit", ~this, "prev_profit"))


def _growth(now: Column, before: Column, usable: Column) -> Column:
    return F.when(usable, (now - before) / F.abs(before) * 100).otherwise(F.lit(0.0))


def monthly_report_summary(sales: DataFrame, year: int, month: int) -> DataFrame:
    """Month totals and change against the month before, in one pass."""
    rev, profit, n = F.col("revenue"), F.col("profit"), F.col("orders")
    prev_rev, prev_profit = F.col("prev_revenue"), F.col("prev_profit")
    zero = F.lit(0.0)
    return _month_pair(sales, year, month).select(
        F.lit(year).alias("year"), F.lit(month).alias("month"),
        F.lit(cal.MONTH_NAMES[month - 1]).alias("month_name"),
        money(rev).alias("total_revenue"), money(profit).alias("total_profit"),
        F.when(profit < 0, money(-profit)).otherwise(zero).alias("total_loss"),
        F.when(rev > 0, rnd(profit / rev * 100, 2)).otherwise(zero).alias("profit_margin"),
        n.alias("total_orders"), F.col("units").alias("total_units_sold"),
        F.when(n > 0, money(rev / n)).otherwise(zero).alias("avg_order_value"),
        money(rev - prev_rev).alias("revenue_change"),
        rnd(_growth(rev, prev_rev, prev_rev > 0), 2).alias("revenue_growth_pct"),
        money(profit - prev_profit).alias("profit_change"),
        rnd(_growth(profit, prev_profit, prev_profit != 0), 2).alias("profit_growth_pct"),
        money(prev_rev).alias("prev_month_revenue"), money(prev_profit).alias("prev_month_profit"))


def monthly_report_products(sales: DataFrame, products: DataFrame, year: int, month: int,
                            best: bool = True, n: int = 10) -> DataFrame:
    """Best or worst products of a month by revenue."""
    ranked = (product_totals(in_month(sales, year, month))
              .join(products.select("product_id", "product_name", "category"), "product_id")
              .select("product_id", "product_name", "category", money("revenue").alias("revenue"),
                      money("profit").alias("profit"), F.col("units").alias("units_sold")))
    return ranked.orderBy(F.desc("revenue") if best else F.asc("revenue"), "product_id").limit(n)


def monthly_report_categories(sales: DataFrame, products: DataFrame, year: int, month: int) -> DataFrame:
    per_category = (product_totals(in_month(sales, year, month))
                    .join(products.select("product_id", "category"), "product_id")
                    .groupBy("category")
                    .agg(F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit"),
                         F.sum("order_rows").alias("orders")))
    return (with_totals(per_category, F.sum("revenue").alias("_total"))
            .select("category", money("revenue").alias("revenue"), money("profit").alias("profit"), "orders",
                    share_of(F.col("revenue"), F.col("_total")).alias("revenue_share"))
            .orderBy(F.desc("revenue"), "category"))


def monthly_report_daily(sales: DataFrame, year: int, month: int) -> DataFrame:
    return (in_month(sales, year, month).groupBy(F.to_date("order_date").alias("date"))
            .agg(money(F.sum("total_amount")).alias("revenue"), money(F.sum("profit")).alias("profit"),
                 F.count(F.lit(1)).alias("orders"))
            .orderBy("date"))


def monthly_report_advice(sales: DataFrame, products: DataFrame, year: int, month: int) -> DataFrame:
    """Advice rows drawn from the month's profit, growth and best product."""
    pair = _month_pair(sales, year, month)
    growth = _growth(F.col("revenue"), F.col("prev_revenue"), F.col("prev_revenue") > 0)
    profit = F.col("profit")

    def note(when: Column, kind: str, message: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("type"), message.alias("message")))

    # The message texts of the four notes.
    notes = F.array(
        note(profit < 0, "critical", F.concat(
            F.lit("Month operated at a loss of $"), F.format_number(money(-profit), 2),
            F.lit(". Review pricing and costs."))),
        note(growth < -10, "warning", F.concat(
            F.lit("Revenue declined "), F.format_number(rnd(F.abs(growth), 1), 1),
            F.lit("% from previous month. Consider promotional activities."))),
        note(growth > 20, "success", F.concat(
            F.lit("Strong revenue growth of "), F.format_number(rnd(growth, 1), 1),
            F.lit("%. Consider increasing inventory for top performers."))))
    from_totals = (pair.select(F.explode(F.filter(notes, lambda n: n.isNotNull())).alias("note"))
                   .select("note.type", "note.message"))
    leader = monthly_report_products(sales, products, year, month, n=1).select(
        F.lit("info").alias("type"),
        F.concat(F.lit("Top performer: "), F.col("product_name"), F.lit(" generated $"),
                 F.format_number("revenue", 2), F.lit(" revenue.")).alias("message"))
    return from_totals.unionByName(leader)


def _performance(sales: DataFrame, products: DataFrame) -> DataFrame:
    margin = F.when(F.col("revenue") > 0, F.col("profit") / F.col("revenue") * 100).otherwise(F.lit(0.0))
    return (product_totals(sales.where(delivered()))
            .join(products.select("product_id", "product_name", "category"), "product_id")
            .withColumn("margin", margin))


def _shown(frame: DataFrame, order: Sequence[Column], n: int, label: str) -> DataFrame:
    return (frame.orderBy(*order, "product_id").limit(n)
            .select(F.lit(label).alias("ranking"), "product_id", "product_name", "category",
                    money("revenue").alias("revenue"), money("profit").alias("profit"),
                    F.col("units").alias("units_sold"), rnd("margin", 2).alias("profit_margin"), "order_rows"))


def product_performance(sales: DataFrame, products: DataFrame, n: int = 10) -> DataFrame:
    """Best and worst products by revenue. Both rankings read one aggregate."""
    base = _performance(sales, products)
    return (_shown(base, [F.desc(money("revenue"))], n, "best")
            .unionByName(_shown(base, [F.asc(money("revenue"))], n, "worst")))


def margin_performance(sales: DataFrame, products: DataFrame, n: int = 10,
                       best_floor: float = 1000.0, worst_floor: float = 100.0) -> DataFrame:
    """Best and worst margins among products above a revenue floor."""
    base = _performance(sales, products)
    return (_shown(base.where(F.col("revenue") > best_floor), [F.desc(rnd("margin", 6))], n, "best")
            .unionByName(_shown(base.where(F.col("revenue") > worst_floor), [F.asc(rnd("margin", 6))], n, "worst")))


# The advice texts that accompany the product rankings.
PERFORMANCE_ADVICE = {
    "best_performers": [
        "Increase inventory for top revenue generators to avoid stockouts",
        "Consider bundling top products with slower movers",
        "Analyze what makes these products successful - apply learnings elsewhere",
    ],
    "worst_performers": [
        "Review pricing strategy for low performers",
        "Consider promotional campaigns or discounts",
        "Evaluate if products should be discontinued",
    ],
    "margin_optimization": [
        "Products with high margin but low volume may benefit from promotion",
        "Low margin products may need cost reduction or price increase",
        "Consider renegotiating supplier costs for high-volume, low-margin items",
    ],
}


def performance_advice(ranked: DataFrame, margins: DataFrame) -> DataFrame:
    """All advice, with the number of products in each ranking (``product_performance``, ``margin_performance``)."""
    rows = [(kind, i + 1, text) for kind, texts in PERFORMANCE_ADVICE.items() for i, text in enumerate(texts)]
    advice = ranked.sparkSession.createDataFrame(rows, "topic string, item int, advice string")
    topics = ranked.select(F.concat("ranking", F.lit("_performers")).alias("topic")).unionByName(
        margins.select(F.lit("margin_optimization").alias("topic")))
    found = topics.groupBy("topic").agg(F.count(F.lit(1)).alias("products"))
    return advice.join(found, "topic", "left").na.fill(0, ["products"])


def lookup_by_key(frame: DataFrame, key: str, value) -> DataFrame:
    return frame.where(F.col(key) == value)


def category_performance(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Revenue, profit, volume, shares and margin per category."""
    per_category = (product_totals(sales.where(delivered()))
                    .join(products.select("product_id", "category"), "product_id")
                    .groupBy("category")
                    .agg(F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit"),
                         F.sum("units").alias("units_sold"), F.sum("order_rows").alias("order_rows"),
                         F.count(F.lit(1)).alias("product_count")))
    rev, profit = F.col("revenue"), F.col("profit")
    totals = [F.sum("revenue").alias("_revenue"), F.sum("profit").alias("_profit")]
    return (with_totals(per_category, *totals).select(
        "category", money(rev).alias("revenue"), money(profit).alias("profit"), "units_sold", "order_rows",
        "product_count", share_of(rev, F.col("_revenue")).alias("revenue_share"),
        share_of(profit, F.col("_profit")).alias("profit_share"),
        share_of(profit, rev).alias("profit_margin"),
        money(rev / F.col("order_rows")).alias("avg_order_value"))
        .orderBy(F.desc("revenue"), "category"))


def sales_by_dow(sales: DataFrame) -> DataFrame:
    number = cal.day_number(F.col("order_date"))
    return (sales.where(delivered()).groupBy(number.alias("day_number"))
            .agg(money(F.sum("total_amount")).alias("revenue"), money(F.sum("profit")).alias("profit"),
                 F.count(F.lit(1)).alias("order_rows"), money(F.avg("total_amount")).alias("avg_order_value"))
            .withColumn("day", cal.pick_name(F.col("day_number"), cal.DAY_NAMES))
            .orderBy("day_number"))


def revenue_profit_trend(sales: DataFrame, period: str = "monthly", limit: int = 30) -> DataFrame:
    """Latest periods in chronological order."""
    latest = (sales.where(delivered())
              .groupBy(cal.period_label(F.col("order_date"), period).alias("period"))
              .agg(F.sum("total_amount").alias("r"), F.sum("profit").alias("p"), F.count(F.lit(1)).alias("orders"))
              .orderBy(F.desc("period")).limit(limit))
    return (latest.select("period", money("r").alias("revenue"), money("p").alias("profit"),
                          share_of(F.col("p"), F.col("r")).alias("profit_margin"), "orders")
            .orderBy("period"))


def available_months(sales: DataFrame) -> DataFrame:
    month = F.col("month")
    return (sales.where(delivered())
            .groupBy(F.year("order_date").alias("year"), F.month("order_date").alias("month"))
            .agg(F.count(F.lit(1)).alias("order_rows"), money(F.sum("total_amount")).alias("revenue"))
            .withColumn("month_name", cal.pick_name(month - 1, cal.MONTH_NAMES))
            .withColumn("display", F.concat_ws(" ", "month_name", F.col("year").cast("string")))
            .orderBy(F.desc("year"), F.desc("month")))


def dataset_overview(orders: DataFrame, items: DataFrame, products: DataFrame,
                     approximate: bool = False) -> DataFrame:
    """Distinct counts and date coverage; approximate counts are an option for a quick look."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    heads = orders.agg(
        F.count(F.lit(1)).alias("order_rows"), distinct("customer_id").alias("unique_customers"),
        F.to_date(F.min("order_date")).alias("first_date"), F.to_date(F.max("order_date")).alias("last_date"),
        F.datediff(F.max("order_date"), F.min("order_date")).alias("duration_days"))
    # one distinct column per aggregate keeps each to a two-step distinct plan
    sold = items.agg(distinct("product_id").alias("unique_products"))
    sellers = items.agg(distinct("seller_id").alias("unique_sellers"))
    kinds = products.agg(distinct("category").alias("categories"))
    return with_scalars(with_scalars(with_scalars(heads, sold), sellers), kinds)


def value_counts(frame: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Frequency and share of each value, most frequent first."""
    counts = frame.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("rows"))
    shared = with_totals(counts, F.sum("rows").alias("_all")).select(
        "value", "rows", share_of(F.col("rows"), F.col("_all")).alias("pct")).orderBy(F.desc("rows"), "value")
    return shared if n is None else shared.limit(n)


def histogram(frame: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bin counts between the minimum and the maximum."""
    x = F.col(column).cast("double")
    bounds = frame.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    width = (hi - lo) / bins
    slot = F.when(hi > lo, F.least(F.floor((x - lo) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    placed = with_scalars(frame.where(x.isNotNull()).select(column), bounds)
    return (placed.groupBy(slot.alias("bin"))
            .agg(F.count(F.lit(1)).alias("rows"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
            .select("bin", "rows", rnd(lo + F.col("bin") * width, 4).alias("bin_start"),
                    rnd(lo + (F.col("bin") + 1) * width, 4).alias("bin_end"))
            .orderBy("bin"))


def summary_stats(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, spread and exact quartiles of each column, one row per column. Two scans, whatever the number of columns."""
    wanted = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    basic = [make(F.col(c).cast("double")).alias(f"_{name}_{c}") for c in columns
             for name, make in (("avg", F.avg), ("std", F.stddev_samp), ("low", F.min), ("high", F.max))]
    brackets = percentile_brackets(frame, [], columns, list(wanted.values()), basic)
    cells = F.array(*[F.struct(
        F.lit(c).alias("measure"), F.col(f"_n_{c}").alias("count"), rnd(F.col(f"_avg_{c}"), 4).alias("mean"),
        rnd(F.col(f"_std_{c}"), 4).alias("std"), rnd(F.col(f"_low_{c}"), 4).alias("min"), rnd(F.col(f"_high_{c}"), 4).alias("max"))
        for c in columns])
    marks = percentiles_within(frame, brackets, [], columns, wanted)
    return brackets.select(F.explode(cells).alias("c")).select("c.*").join(
        marks.select(F.col("_measure").alias("measure"), *[rnd(c, 4).alias(c) for c in wanted]), "measure")


def correlation_matrix(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson matrix in long form, every pair from one aggregation pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = frame.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}")
                       for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for left, right in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(left).alias("left"), F.lit(right).alias("right"),
                                  rnd(F.col(f"c{i}"), 4).alias("corr")))
    return wide.select(F.explode(F.array(*cells)).alias("cell")).select("cell.left", "cell.right", "cell.corr")


def category_totals(sales: DataFrame, products: DataFrame) -> DataFrame:
    """All-status totals per category."""
    return (product_totals(sales).join(products.select("product_id", "category"), "product_id")
            .groupBy("category")
            .agg(money(F.sum("revenue")).alias("revenue"), money(F.sum("profit")).alias("profit"),
                 F.sum("order_rows").alias("order_rows"), F.sum("units").alias("units")))


def daily_totals(sales: DataFrame) -> DataFrame:
    return sales.groupBy(F.to_date("order_date").alias("date")).agg(
        F.count_distinct("order_id").alias("orders"), F.sum("total_amount").alias("revenue"),
        F.sum("quantity").alias("units"), F.sum("profit").alias("profit"))


def daily_stats_ma(sales: DataFrame, windows: Sequence[int] = (7, 30)) -> DataFrame:
    """Daily totals with trailing means over rows, null until the window is full."""
    out = daily_totals(sales)
    means = []
    for size in windows:
        rows = Window.orderBy("date").rowsBetween(1 - size, 0)
        means.append(F.when(F.count(F.lit(1)).over(rows) == size, money(F.avg("revenue").over(rows)))
                     .alias(f"revenue_ma{size}"))
    return out.select("date", "orders", money("revenue").alias("revenue"),
                      money("profit").alias("profit"), *means)


def monthly_stats(sales: DataFrame) -> DataFrame:
    """Distinct orders and customers per month.

    Orders are reduced to one row each first, so only one distinct remains per step.
    """
    per_order = sales.groupBy(cal.month_label(F.col("order_date")).alias("month"), "order_id", "customer_id").agg(
        F.sum("total_amount").alias("revenue"), F.sum("profit").alias("profit"))
    per_customer = per_order.groupBy("month", "customer_id").agg(
        F.count_distinct("order_id").alias("orders"), F.sum("revenue").alias("revenue"),
        F.sum("profit").alias("profit"))
    return per_customer.groupBy("month").agg(
        F.sum("orders").alias("orders"), F.count(F.lit(1)).alias("customers"),
        money(F.sum("revenue")).alias("revenue"), money(F.sum("profit")).alias("profit"))


def weekly_monthly_resample(sales: DataFrame) -> DataFrame:
    """Calendar weeks (ending Sunday) and months, empty periods as zero."""
    daily = materialise(daily_totals(sales))
    span = daily.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))

    def resample(label: str, end: Column, grid: Column) -> DataFrame:
        periods = span.select(F.explode(grid).alias("period_end"))
        sums = daily.groupBy(end.alias("period_end")).agg(
            F.sum("orders").alias("orders"), F.sum("revenue").alias("revenue"),
            F.sum("units").alias("units"), F.sum("profit").alias("profit"))
        zero = F.lit(0)
        return periods.join(sums, "period_end", "left").select(
            F.lit(label).alias("grain"), "period_end", F.coalesce("orders", zero).alias("orders"),
            money(F.coalesce("revenue", F.lit(0.0))).alias("revenue"), F.coalesce("units", zero).alias("units"),
            money(F.coalesce("profit", F.lit(0.0))).alias("profit"))

    week_end = cal.week_ending_sunday(F.col("date"))
    weeks = resample("week", week_end, F.sequence(
        cal.week_ending_sunday(F.col("lo")), cal.week_ending_sunday(F.col("hi")), F.expr("INTERVAL 7 DAYS")))
    months = resample("month", F.last_day("date"), F.transform(
        F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"), F.expr("INTERVAL 1 MONTH")),
        lambda d: F.last_day(d)))
    return weeks.unionByName(months)


def seasonality_profile(sales: DataFrame) -> DataFrame:
    """Totals by weekday, month name and quarter."""
    daily = sales.groupBy(F.to_date("order_date").alias("date")).agg(
        F.sum("total_amount").alias("revenue"), F.count(F.lit(1)).alias("order_rows"))
    parts = F.array(
        F.struct(F.lit("weekday").alias("part"), F.date_format("date", "EEEE").alias("value")),
        F.struct(F.lit("month").alias("part"), F.date_format("date", "MMMM").alias("value")),
        F.struct(F.lit("quarter").alias("part"), F.quarter("date").cast("string").alias("value")))
    return (daily.select("revenue", "order_rows", F.explode(parts).alias("p"))
            .groupBy("p.part", "p.value")
            .agg(money(F.sum("revenue")).alias("revenue"), F.sum("order_rows").alias("order_rows"),
                 money(F.sum("revenue") / F.sum("order_rows")).alias("avg_revenue")))


def seasonal_pattern_means(sales: DataFrame) -> DataFrame:
    """Mean quantity by hour of day and by weekday (Monday = 0)."""
    parts = F.array(
        F.struct(F.lit("hour").alias("part"), F.hour("order_date").alias("value")),
        F.struct(F.lit("weekday").alias("part"), F.weekday("order_date").alias("value")))
    hourly = sales.groupBy(F.date_trunc("hour", "order_date").alias("order_date")).agg(
        F.sum("quantity").alias("q"), F.count("quantity").alias("n"))
    return (hourly.select("q", "n", F.explode(parts).alias("p")).groupBy("p.part", "p.value")
            .agg(rnd(F.sum("q") / F.sum("n"), 4).alias("mean_quantity")))


def _monthly_resampled(sales: DataFrame) -> DataFrame:
    return weekly_monthly_resample(sales).where(F.col("grain") == "month")


def mom_growth_cumulative(sales: DataFrame) -> DataFrame:
    """Month-over-month growth, running revenue, and best and worst month flags."""
    by_month = Window.orderBy("period_end")
    prev_r, prev_o = F.lag("revenue").over(by_month), F.lag("orders").over(by_month)
    monthly = _monthly_resampled(sales)
    edges = [F.max_by("period_end", "revenue").alias("_best"), F.min_by("period_end", "revenue").alias("_worst")]
    return with_totals(monthly, *edges).select(
        "period_end", "orders", "revenue",
        F.when(prev_r != 0, rnd((F.col("revenue") - prev_r) / prev_r * 100, 2)).alias("revenue_growth"),
        F.when(prev_o != 0, rnd((F.col("orders") - prev_o) / prev_o * 100, 2)).alias("orders_growth"),
        money(F.sum("revenue").over(by_month.rowsBetween(Window.unboundedPreceding, 0))).alias("cumulative_revenue"),
        (F.col("period_end") == F.col("_best")).alias("is_best"),
        (F.col("period_end") == F.col("_worst")).alias("is_worst"))


def _category_months(sales: DataFrame, products: DataFrame) -> DataFrame:
    per_product = sales.groupBy("product_id", cal.month_label(F.col("order_date")).alias("month")).agg(
        F.sum("total_amount").alias("revenue"))
    return (per_product.join(products.select("product_id", "category"), "product_id")
            .groupBy("category", "month").agg(F.sum("revenue").alias("revenue")))


def category_month_pivot(sales: DataFrame, products: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Month by category revenue, zero filled, for the named categories."""
    wide = (_category_months(sales, products).groupBy("month").pivot("category", list(categories))
            .agg(F.sum("revenue")))
    return wide.select("month", *[money(F.coalesce(F.col(f"`{c}`"), F.lit(0.0))).alias(c) for c in categories])


def top_categories(sales: DataFrame, products: DataFrame, n: int = 5) -> DataFrame:
    return (category_totals(sales, products).select("category", "revenue")
            .orderBy(F.desc("revenue"), "category").limit(n))


def category_half_growth(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Mean monthly revenue of the later half of present months against the earlier half."""
    by_category = Window.partitionBy("category")
    halved = _category_months(sales, products).select(
        "category", "revenue", F.row_number().over(by_category.orderBy("month")).alias("k"),
        F.count(F.lit(1)).over(by_category).alias("n"))
    early = F.col("k") <= F.floor(F.col("n") / 2)
    sums = halved.groupBy("category").agg(
        F.max("n").alias("months"), F.avg(F.when(early, F.col("revenue"))).alias("first"),
        F.avg(F.when(~early, F.col("revenue"))).alias("second"))
    growth = F.when((F.col("months") >= 2) & (F.col("first") > 0),
                    (F.col("second") - F.col("first")) / F.col("first") * 100).otherwise(F.lit(0.0))
    return sums.select("category", "months", rnd(growth, 2).alias("growth_pct"))


def linear_trend_of_months(sales: DataFrame) -> DataFrame:
    """Straight-line fit of monthly revenue on the month index."""
    indexed = _monthly_resampled(sales).select(
        "revenue", (F.row_number().over(Window.orderBy("period_end")) - 1).cast("double").alias("x"))
    slope = F.regr_slope("revenue", "x")
    return indexed.agg(
        rnd(slope, 2).alias("slope"), rnd(F.regr_intercept("revenue", "x"), 2).alias("intercept"),
        rnd(F.regr_r2("revenue", "x"), 4).alias("r2"),
        F.when(slope > 0, "Upward").otherwise("Downward").alias("direction"))


def product_rollup(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Revenue, profit, units, distinct orders and mean margin per product."""
    per_order = sales.groupBy("product_id", "order_id").agg(
        F.sum("total_amount").alias("revenue"), F.sum("profit").alias("profit"),
        F.sum("quantity").alias("units"), F.sum("profit_margin").alias("m"), F.count("profit_margin").alias("n"))
    rolled = per_order.groupBy("product_id").agg(
        F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit"), F.sum("units").alias("units"),
        F.count(F.lit(1)).alias("orders"), (F.sum("m") / F.sum("n")).alias("avg_margin"))
    return rolled.join(products.select("product_id", "category", "brand"), "product_id")


def _profitability(sales: DataFrame, products: DataFrame, key: str) -> DataFrame:
    return product_rollup(sales, products).groupBy(key).agg(
        F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit"), F.sum("units").alias("units"),
        F.count(F.lit(1)).alias("product_count"), F.avg("avg_margin").alias("avg_margin"))


def category_profitability(sales: DataFrame, products: DataFrame) -> DataFrame:
    return _profitability(sales, products, "category").select(
        "category", money("revenue").alias("revenue"), money("profit").alias("profit"), "units",
        "product_count", rnd("avg_margin", 2).alias("avg_margin"),
        money(F.col("profit") / F.col("product_count")).alias("profit_per_product"))


def brand_performance(sales: DataFrame, products: DataFrame, n: int = 15) -> DataFrame:
    return (_profitability(sales, products, "brand").select(
        "brand", money("revenue").alias("revenue"), money("profit").alias("profit"), "units",
        "product_count", rnd("avg_margin", 2).alias("avg_margin"))
        .orderBy(F.desc("revenue"), "brand").limit(n))


def price_volume(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Mean price against total units per product."""
    sums = sales.groupBy("product_id").agg(
        F.avg("unit_price").alias("avg_price"), F.sum("quantity").alias("units"))
    return (sums.join(products.select("product_id", "category"), "product_id")
            .select("product_id", "category", money("avg_price").alias("avg_price"), "units"))


def browse_page(frame: DataFrame, order_by: Sequence[str | Column], skip: int = 0, limit: int = 100) -> DataFrame:
    """One page of a listing in key order."""
    return frame.orderBy(*order_by).offset(skip).limit(limit)


def dashboard_sales(sales: DataFrame, as_of=None) -> DataFrame:
    """Month and year to date, order count and mean order value, in one pass."""
    now = anchor(sales, as_of)
    done = sales.where(delivered())
    amount = F.col("total_amount")
    sums = done.agg(
        F.sum(F.when(F.col("order_date") >= F.trunc(now, "month"), amount)).alias("mtd"),
        F.sum(F.when(F.col("order_date") >= F.trunc(now, "year"), amount)).alias("ytd"),
        F.count(F.lit(1)).alias("n"), F.sum(amount).alias("all"))
    zero = F.lit(0.0)
    return sums.select(
        money(F.coalesce("mtd", zero)).alias("total_revenue_mtd"),
        money(F.coalesce("ytd", zero)).alias("total_revenue_ytd"), F.col("n").alias("total_orders"),
        F.when(F.col("n") > 0, money(F.col("all") / F.col("n"))).otherwise(zero).alias("avg_order_value"))
