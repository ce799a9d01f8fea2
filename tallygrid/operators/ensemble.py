"""Weighted combination of model forecasts.

Members share one long table shape, so weights and combinations are plain
grouped aggregations over (series_id, model).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import rnd
from .demand import split_last
from .forecast import smape_term
from .ordered import with_totals

FAILED_SMAPE = 100.0


def eligible(history: DataFrame, least: int = 30) -> DataFrame:
    """Series with enough periods to be fitted."""
    enough = history.groupBy("series_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return history.join(enough.select("series_id"), "series_id", "left_semi")


def holdout_pairs(history: DataFrame, forecaster, periods: int = 8) -> DataFrame:
    """Actual and predicted values of the last periods; the fit sees earlier ones only.

    ``forecaster(train)`` returns a forecast table; steps are matched to periods in order.
    """
    marked = split_last(history, periods)
    train = marked.where(~F.col("is_test")).select("series_id", "ds", "y")
    actual = marked.where("is_test").select(
        "series_id", (F.col("i") - F.col("n") + periods + 1).cast("int").alias("step"), F.col("ds"),
        F.col("y").cast("double").alias("actual"))
    predicted = forecaster(train).where(F.col("step").isNotNull()).select(
        "series_id", "model", F.col("step").cast("int").alias("step"), F.col("forecast").alias("predicted"))
    return actual.join(predicted, ["series_id", "step"])


def member_smape(pairs: DataFrame) -> DataFrame:
    term = smape_term(F.col("actual"), F.col("predicted"), "zero")
    return pairs.groupBy("series_id", "model").agg((F.avg(term) * 100).alias("smape"))


def ensemble_weights(pairs: DataFrame, models: Sequence[str], series: DataFrame | None = None) -> DataFrame:
    """Weights in inverse proportion to holdout error; a model without predictions counts as failed."""
    keys = (series if series is not None else pairs).select("series_id").distinct()
    grid = keys.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    scored = grid.join(member_smape(pairs), ["series_id", "model"], "left").withColumn(
        "smape", F.coalesce("smape", F.lit(FAILED_SMAPE)))
    inverse = 1 / (F.col("smape") + 1e-6)
    return scored.select("series_id", "model", "smape",
                         (inverse / F.sum(inverse).over(Window.partitionBy("series_id"))).alias("weight"))


def ensemble_forecast(forecast: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean of the members that produced a forecast, never below zero."""
    joined = forecast.where(F.col("forecast").isNotNull()).join(
        weights.select("series_id", "model", "weight"), ["series_id", "model"])

    def mean(column: str):
        return F.greatest(F.try_divide(F.sum(F.col("weight") * F.col(column)), F.sum("weight")), F.lit(0.0)).alias(column)

    return joined.groupBy("series_id", "step", "ds").agg(
        F.count(F.lit(1)).alias("members"), mean("forecast"), mean("lower"), mean("upper"))


def ensemble_equal_average(forecast: DataFrame) -> DataFrame:
    """Plain mean of the members; one member alone stands as it is."""
    return forecast.where(F.col("forecast").isNotNull()).groupBy("series_id", "step", "ds").agg(
        F.count(F.lit(1)).alias("members"), *[F.avg(c).alias(c) for c in ("forecast", "lower", "upper")])


def average_weights(weights: DataFrame) -> DataFrame:
    return weights.groupBy("model").agg(
        F.count(F.lit(1)).alias("series"), rnd(F.avg("weight"), 4).alias("avg_weight"),
        rnd(F.avg("smape"), 4).alias("avg_smape"))


def weights_report(weights: DataFrame, models: Sequence[str], history: DataFrame) -> DataFrame:
    """One row per series: its weights side by side and its number of periods."""
    wide = weights.groupBy("series_id").pivot("model", list(models)).agg(F.max("weight"))
    points = history.groupBy("series_id").agg(F.count(F.lit(1)).alias("data_points"))
    return points.join(wide, "series_id", "left").select(
        "series_id", "data_points", *[rnd(F.col(f"`{m}`"), 4).alias(f"{m}_weight") for m in models],
        F.when(F.col(f"`{models[0]}`").isNotNull(), "success").otherwise("failed").alias("status"))


def ensemble_pairs(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """Holdout pairs of the weighted combination."""
    joined = pairs.join(weights.select("series_id", "model", "weight"), ["series_id", "model"])
    return joined.groupBy("series_id", "step", "ds", "actual").agg(
        F.greatest(F.try_divide(F.sum(F.col("weight") * F.col("predicted")), F.sum("weight")), F.lit(0.0)).alias("predicted"))


def ensemble_compare(pairs: DataFrame, weights: DataFrame, single: str, target: float = 20.0) -> DataFrame:
    """One model against the combination on the holdout: error, totals, gain, and target flag."""
    def scored(frame: DataFrame, tag: str) -> DataFrame:
        term = smape_term(F.col("actual"), F.col("predicted"), "zero")
        return frame.groupBy("series_id").agg(
            (F.avg(term) * 100).alias(f"{tag}_smape"), F.sum("predicted").alias(f"{tag}_total"))

    both = scored(pairs.where(F.col("model") == single), "single").join(
        scored(ensemble_pairs(pairs, weights), "ensemble"), "series_id")
    gain = F.col("single_smape") - F.col("ensemble_smape")
    return both.select(
        "series_id", *[rnd(c, 4).alias(c) for c in ("single_smape", "ensemble_smape")],
        *[rnd(c, 2).alias(c) for c in ("single_total", "ensemble_total")], rnd(gain, 4).alias("improvement"),
        rnd(F.when(F.col("single_smape") > 0, gain / F.col("single_smape") * 100).otherwise(F.lit(0.0)), 2).alias("improvement_pct"),
        (F.col("ensemble_smape") < target).alias("meets_target"))


def compare_summary(comparison: DataFrame) -> DataFrame:
    return comparison.agg(
        F.count(F.lit(1)).alias("series"), rnd(F.avg("single_smape"), 2).alias("avg_single_smape"),
        rnd(F.avg("ensemble_smape"), 2).alias("avg_ensemble_smape"), rnd(F.avg("improvement"), 2).alias("avg_improvement"),
        F.count(F.when(F.col("meets_target"), 1)).alias("meeting_target"))


def forecast_bias(pairs: DataFrame, limit: float = 40.0) -> DataFrame:
    """Monitoring: mean error, relative bias, and a flag for high error."""
    a, p = F.col("actual"), F.col("predicted")
    sums = pairs.groupBy("series_id", "model").agg(
        F.avg(p - a).alias("_b"), F.sum(p - a).alias("_d"), F.sum(a).alias("_a"),
        (F.avg(smape_term(a, p, "zero")) * 100).alias("_s"))
    return sums.select(
        "series_id", "model", rnd("_b", 4).alias("bias"),
        rnd(F.when(F.col("_a") != 0, F.col("_d") / F.col("_a") * 100).otherwise(F.lit(0.0)), 2).alias("bias_pct"),
        rnd("_s", 4).alias("smape"), (F.col("_s") > limit).alias("needs_retraining"))


def class_migration(before: DataFrame, after: DataFrame, key: str, label: str) -> DataFrame:
    """Members that moved between classes of two snapshots; absent ones count as their own class."""
    missing = F.lit("(absent)")
    joined = before.select(key, F.col(label).alias("_b")).join(after.select(key, F.col(label).alias("_a")), key, "full_outer")
    counts = joined.groupBy(F.coalesce("_b", missing).alias("from_class"), F.coalesce("_a", missing).alias("to_class")).agg(
        F.count(F.lit(1)).alias("members"))
    return with_totals(counts, F.sum("members").alias("_all")).select(
        "from_class", "to_class", "members", rnd(F.col("members") / F.col("_all") * 100, 2).alias("pct"),
        (F.col("from_class") != F.col("to_class")).alias("moved"))
