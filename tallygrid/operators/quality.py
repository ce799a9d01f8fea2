"""Validation, profiling, cleaning and outlier rules.

Each check of a table is a conditional count, so one table is validated in one
aggregation pass whatever the number of rules.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import anchor, rnd, share_of
from .ordered import grouped_percentiles, join_on, materialise, with_scalars


@dataclass(frozen=True)
class Check:
    """A rule over one column: rows it catches, how grave it is, and its message."""
    column: str
    caught: Column | str
    message: str
    error: bool = True
    counts_invalid: bool = True


@dataclass(frozen=True)
class Rules:
    required: tuple[str, ...]
    key: str | None
    label: str
    checks: tuple[Check, ...] = ()


def rules_for(entity: str) -> Rules:
    """Rules of an entity; the future-date rule is added with its own moment."""
    # The message texts that accompany each check.
    rules = {
        "customers": Rules(("customer_id",), "customer_id", "customer IDs", (
            Check("customer_name", "customer_name IS NULL", "customers with missing names", error=False),)),
        "products": Rules(("product_id", "product_name"), "product_id", "product IDs", (
            Check("product_name", "product_name IS NULL", "products with missing names (NOT NULL constraint)"),
            Check("cost_price", "cost_price < 0", "products with negative cost prices"))),
        "inventory": Rules(("product_id",), None, "", (
            Check("current_stock", "current_stock < 0", "items with negative stock levels"),
            Check("reorder_level", "reorder_level < 0", "items with negative reorder points"))),
        "orders": Rules(("order_id", "order_date"), "order_id", "order IDs", (
            Check("order_date", "order_date IS NULL", "orders with invalid dates"),)),
        "order_items": Rules(("order_id", "product_id", "quantity"), None, "", (
            Check("quantity", "quantity <= 0", "items with quantity <= 0"),
            Check("unit_price", "unit_price < 0", "items with negative unit prices"),
            Check("total_amount", "total_amount < 0", "items with negative total amounts (may be refunds)",
                  error=False, counts_invalid=False))),
        "sellers": Rules(("seller_id",), "seller_id", "seller IDs"),
    }
    if entity not in rules:
        raise ValueError(f"Unknown entity type: {entity}")
    return rules[entity]


def validate(frame: DataFrame, entity: str, as_of=None) -> DataFrame:
    """One result row: totals, invalid counts, error and warning messages.

    ``invalid_records`` counts a row once per broken rule; ``distinct_invalid_rows``
    counts it once.
    """
    rules = rules_for(entity)
    missing = [c for c in rules.required if c not in frame.columns]
    if missing:
        note = F.array(F.lit(f"Missing required columns: {missing}"))
        return _result(frame.agg(F.count(F.lit(1)).alias("total_records")).withColumns({
            "invalid_records": F.col("total_records"), "distinct_invalid_rows": F.col("total_records"),
            "errors": note, "warnings": F.array().cast("array<string>")}), entity)

    checks = [c for c in rules.checks if c.column in frame.columns]
    if entity == "orders" and dict(frame.dtypes)["order_date"] != "string":
        moment = anchor(frame, as_of)
        checks.append(Check("order_date", F.col("order_date") > moment, "orders with future dates",
                            error=False, counts_invalid=False))
    caught = [F.expr(c.caught) if isinstance(c.caught, str) else c.caught for c in checks]
    breaking = [hit for hit, c in zip(caught, checks) if c.counts_invalid]
    any_broken = F.lit(False)
    for hit in breaking:
        any_broken = any_broken | F.coalesce(hit, F.lit(False))
    columns = [F.count(F.lit(1)).alias("total_records"), F.count(F.when(any_broken, 1)).alias("distinct_invalid_rows")]
    columns += [F.count(F.when(hit, 1)).alias(f"_c{i}") for i, hit in enumerate(caught)]
    if rules.key:
        columns += [F.count_distinct(rules.key).alias("_keys"),
                    F.max(F.col(rules.key).isNull().cast("int")).alias("_null")]
    counts = frame.agg(*columns)

    def found(n: Column, text: str) -> Column:
        return F.when(n > 0, F.concat(F.lit("Found "), n.cast("string"), F.lit(f" {text}")))

    errors = [found(F.col(f"_c{i}"), c.message) for i, c in enumerate(checks) if c.error]
    warnings = [found(F.col(f"_c{i}"), c.message) for i, c in enumerate(checks) if not c.error]
    if rules.key:
        repeated = F.col("total_records") - F.col("_keys") - F.coalesce("_null", F.lit(0))
        warnings.insert(0, found(repeated, f"duplicate {rules.label}"))
    invalid = F.lit(0).cast("long")
    for i, c in enumerate(checks):
        if c.counts_invalid:
            invalid = invalid + F.col(f"_c{i}")
    return _result(counts.withColumns({
        "invalid_records": invalid, "errors": _present(errors), "warnings": _present(warnings)}), entity)


def _present(notes: list[Column]) -> Column:
    if not notes:
        return F.array().cast("array<string>")
    return F.filter(F.array(*notes), lambda n: n.isNotNull())


def _result(counts: DataFrame, entity: str) -> DataFrame:
    total, invalid = F.col("total_records"), F.col("invalid_records")
    return counts.select(
        F.lit(entity).alias("entity"), (F.size("errors") == 0).alias("is_valid"), "total_records",
        (total - invalid).alias("valid_records"), "invalid_records", "distinct_invalid_rows",
        error_rate(total, invalid).alias("error_rate"), "errors", "warnings")


def error_rate(total: Column, invalid: Column) -> Column:
    return F.when(total > 0, rnd(invalid / total, 4)).otherwise(F.lit(0.0))


def null_profile(frame: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null count and share of each column that has nulls, in one pass."""
    names = list(columns or frame.columns)
    counts = frame.agg(F.count(F.lit(1)).alias("_all"),
                       *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"_{i}") for i, c in enumerate(names)])
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"_{i}").alias("nulls")) for i, c in enumerate(names)]
    return (counts.select("_all", F.explode(F.array(*cells)).alias("c")).where(F.col("c.nulls") > 0)
            .select("c.column_name", "c.nulls", share_of(F.col("c.nulls"), F.col("_all")).alias("null_pct")))


def duplicate_rows(frame: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row in every column."""
    groups = frame.groupBy(*frame.columns).agg(F.count(F.lit(1)).alias("_n"))
    sums = groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
                      F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))
    return sums.select("*", share_of(F.col("duplicates"), F.col("rows")).alias("duplicate_pct"))


def duplicate_keys(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows beyond the first per key, for each named table."""
    out = None
    for name, (frame, key) in tables.items():
        groups = frame.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        row = groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates")).select(
            F.lit(name).alias("table_name"), "duplicates")
        out = row if out is None else out.unionByName(row)
    return out


def fk_orphans(relations: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Distinct child keys without a parent, per relation.

    Child keys are made distinct before the join, so a hot key is one row in it.
    """
    out = None
    for name, (child, child_key, parent, parent_key) in relations.items():
        keys = child.select(F.col(child_key).alias("_k")).where("_k is not null").distinct()
        orphans = keys.join(parent.select(F.col(parent_key).alias("_k")), "_k", "left_anti")
        row = orphans.agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(name).alias("relation"), "orphans")
        out = row if out is None else out.unionByName(row)
    return out


def _bounds(frame: DataFrame, keys: Sequence[str], value: str, factor: float) -> DataFrame:
    quartiles = grouped_percentiles(frame, keys, value, {"q1": 0.25, "q3": 0.75})
    spread = F.col("q3") - F.col("q1")
    return quartiles.select(*keys, "q1", "q3", (F.col("q1") - factor * spread).alias("lower"),
                            (F.col("q3") + factor * spread).alias("upper"))


def iqr_flags(frame: DataFrame, value: str, keys: Sequence[str] = (), factor: float = 1.5) -> DataFrame:
    """Every row with its bounds and an outlier flag."""
    bounds = _bounds(frame, keys, value, factor)
    x = F.col(value)
    return join_on(frame, bounds, keys).withColumn(
        "is_outlier", F.coalesce((x < F.col("lower")) | (x > F.col("upper")), F.lit(False)))


def iqr_outliers(frame: DataFrame, value: str, keys: Sequence[str] = (), factor: float = 1.5) -> DataFrame:
    """Bounds and outlier count per group."""
    flagged = iqr_flags(frame, value, keys, factor)
    return flagged.groupBy(*keys).agg(
        rnd(F.max("lower"), 4).alias("lower"), rnd(F.max("upper"), 4).alias("upper"),
        F.count(value).alias("rows"), F.count(F.when(F.col("is_outlier"), 1)).alias("outliers"))


def zscore_outliers(frame: DataFrame, value: str, keys: Sequence[str] = (), limit: float = 3.0) -> DataFrame:
    """Rows beyond a number of population standard deviations, counted per group."""
    x = F.col(value)
    # written first, so that the measured size of the few thresholds decides the join
    stats = materialise(frame.groupBy(*keys).agg(F.avg(x).alias("_mean"), F.stddev_pop(x).alias("_std")))
    z = F.when(F.col("_std") > 0, F.abs(x - F.col("_mean")) / F.col("_std"))
    return join_on(frame, stats, keys).groupBy(*keys).agg(
        rnd(F.max("_mean"), 4).alias("mean"), rnd(F.max("_std"), 4).alias("std"),
        F.count(value).alias("rows"), F.count(F.when(z > limit, 1)).alias("outliers"))


def mad_outliers(frame: DataFrame, value: str, keys: Sequence[str] = (), limit: float = 3.5) -> DataFrame:
    """Modified z-score from the median absolute deviation (zero deviation counts as 1)."""
    keys = list(keys)
    medians = grouped_percentiles(frame, keys, value, {"median": 0.5})
    spread = join_on(frame, medians, keys).withColumn("_dev", F.abs(F.col(value) - F.col("median")))
    mads = grouped_percentiles(spread, keys, "_dev", {"_mad": 0.5})
    scale = F.when(F.col("_mad") != 0, F.col("_mad")).otherwise(F.lit(1.0))
    score = F.abs(0.6745 * (F.col(value) - F.col("median")) / scale)
    return join_on(spread, mads, keys).groupBy(*keys).agg(
        rnd(F.max("median"), 4).alias("median"), rnd(F.max("_mad"), 4).alias("mad"),
        F.count(value).alias("rows"), F.count(F.when(score > limit, 1)).alias("outliers"))


def sample_skewness(x: Column) -> Column:
    """Skewness with the small-sample correction; needs three values."""
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def treat_outliers(frame: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Capped, log and robust-scaled forms of a column beside the original."""
    keys = list(keys)
    marks = grouped_percentiles(frame, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    x, spread = F.col(value), F.col("q3") - F.col("q1")
    lower, upper = F.col("q1") - 1.5 * spread, F.col("q3") + 1.5 * spread
    scale = F.when(spread != 0, spread).otherwise(F.lit(1.0))
    return join_on(frame, marks, keys).select(
        *frame.columns, x.between(lower, upper).alias("is_kept"), F.least(F.greatest(x, lower), upper).alias("capped"),
        F.log1p(x).alias("logged"), ((x - F.col("median")) / scale).alias("scaled"))


def outlier_treatments(frame: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Skewness before and after each treatment, with the advice it suggests."""
    treated = treat_outliers(frame, value, keys)
    sums = treated.groupBy(*keys).agg(
        F.count(value).alias("rows"), F.count(F.when(~F.col("is_kept"), 1)).alias("removed"),
        sample_skewness(F.col(value)).alias("_s"), rnd(sample_skewness(F.col("capped")), 4).alias("skew_capped"),
        rnd(sample_skewness(F.col("logged")), 4).alias("skew_log"),
        rnd(sample_skewness(F.when(F.col("is_kept"), F.col(value))), 4).alias("skew_removed"),
        rnd(F.avg("scaled"), 4).alias("mean_scaled"))
    size = F.abs("_s")
    return sums.select("*", rnd("_s", 4).alias("skew_original"), F.when(size > 1, "log transformation")
                       .when(size > 0.5, "cap outliers").otherwise("acceptable").alias("advice")).drop("_s")


def clean_products(products: DataFrame) -> DataFrame:
    return products.withColumns({
        "product_name": F.coalesce("product_name", F.lit("Unknown Product")),
        "category": F.coalesce("category", F.lit("Uncategorized")), "brand": F.coalesce("brand", F.lit("Generic")),
        "cost_price": F.when(F.col("cost_price").isNotNull(), F.greatest(F.col("cost_price"), F.lit(0.0)))})


def clean_customers(customers: DataFrame) -> DataFrame:
    return customers.na.fill({"customer_name": "Unknown Customer", "customer_type": "New", "country": "USA"})


def clean_inventory(inventory: DataFrame) -> DataFrame:
    names = [c for c in ("initial_stock", "current_stock", "reorder_level", "restock_quantity") if c in inventory.columns]
    return inventory.withColumns({
        c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("int") for c in names})


def clean_order_items(items: DataFrame) -> DataFrame:
    filled = items.na.fill(0, ["discount", "tax", "shipping_cost", "profit"])
    return filled.withColumn("quantity", F.when(F.col("quantity").isNotNull(), F.greatest(F.col("quantity"), F.lit(1))))


def total_amount_check(items: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Lines whose total differs from its parts by more than the tolerance."""
    parts = (F.col("quantity") * F.col("unit_price") - F.col("discount") + F.col("tax") + F.col("shipping_cost"))
    off = F.abs(parts - F.col("total_amount"))
    return items.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(off > tolerance, 1)).alias("mismatches"),
                     rnd(F.max(off), 4).alias("largest_gap"))


def business_rule_counts(items: DataFrame, inventory: DataFrame) -> DataFrame:
    counts = items.agg(F.count(F.when(F.col("quantity") <= 0, 1)).alias("non_positive_quantity"),
                       F.count(F.when(F.col("unit_price") < 0, 1)).alias("negative_price"))
    return with_scalars(counts, inventory.agg(F.count(F.when(F.col("current_stock") < 0, 1)).alias("negative_stock")))


def training_row_filter(frame: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Complete rows with positive quantity and price."""
    return frame.na.drop(subset=list(columns) if columns else None).where(
        (F.col("quantity") > 0) & (F.col("unit_price") > 0))
