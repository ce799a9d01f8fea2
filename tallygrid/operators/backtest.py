"""Rolling-origin backtests: every origin's fits come from running sums over one pass of each series.

An origin is the number of periods held out. The row before an origin holds, in its running sums, all that the
closed-form methods and the calendar line need, so no series is fitted again for another origin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .demand import indexed
from .forecast import CALENDAR_FEATURES, LINEAR, MOVING_AVERAGE, SMOOTHING, calendar_features, smape_term, solve_line
from .ordered import materialise, tasks_for

CALENDAR, ENSEMBLE = "linear_calendar", "ensemble"
ORIGINS, HORIZON, LEAST_POINTS = (30, 20, 10), 10, 45
_BLOCK = 256  # periods over which smoothing weights are taken relative to a block's start, far from any overflow


def _level(i: Column, y: Column, alpha: float) -> tuple[Column, Column]:
    """(share of the block so far, whether the row ends its block) of the exponentially smoothed level after each row."""
    place = i % _BLOCK
    grown = F.when(i == 0, y).otherwise(alpha * y) * F.pow(F.lit(1 - alpha), -place.cast("double"))
    inside = Window.partitionBy("series_id", "_block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(grown).over(inside) * F.pow(F.lit(1 - alpha), place.cast("double")), place == _BLOCK - 1


def running_fits(history: DataFrame, window: int = 7, alpha: float = 0.3) -> DataFrame:
    """Each row with the fits on all rows up to it: trailing mean, smoothed level, line, and calendar moments."""
    points = indexed(calendar_features(history)).withColumn("_block", F.floor(F.col("i") / _BLOCK))
    by_series = Window.partitionBy("series_id").orderBy("i")
    so_far = by_series.rowsBetween(Window.unboundedPreceding, 0)
    i, y = F.col("i").cast("double"), F.col("y")
    share, ends = _level(F.col("i"), y, alpha)
    held = points.withColumn("_share", share)
    # what an earlier block leaves has shrunk by (1 - alpha) ** 256, below any double's last bit, one block later
    carried = F.last(F.when(ends, F.col("_share")), ignorenulls=True).over(by_series.rowsBetween(Window.unboundedPreceding, -1))
    place = F.col("i") % _BLOCK
    level = F.col("_share") + F.coalesce(carried, F.lit(0.0)) * F.pow(F.lit(1 - alpha), place.cast("double") + 1)
    names = [*CALENDAR_FEATURES, "y"]
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k:]]
    held = held.withColumns({
        "level": level, "trailing": F.avg(y).over(by_series.rowsBetween(1 - window, 0)),
        "_sy": F.sum(y).over(so_far), "_siy": F.sum(i * y).over(so_far),
        **{f"_s_{a}": F.sum(a).over(so_far) for a in names}, **{f"_p_{a}_{b}": F.sum(F.col(a) * F.col(b)).over(so_far) for a, b in pairs}})
    n = i + 1
    si, sii = n * (n - 1) / 2, (n - 1) * n * (2 * n - 1) / 6
    slope = F.try_divide(n * F.col("_siy") - si * F.col("_sy"), n * sii - si * si)
    means = F.array(*[F.col(f"_s_{a}") / n for a in names])
    covariances = F.array(*[F.col(f"_p_{a}_{b}") / n - F.col(f"_s_{a}") / n * F.col(f"_s_{b}") / n for a, b in pairs])
    return held.withColumn("slope", slope).select(
        "series_id", "ds", "i", "n", "y", *CALENDAR_FEATURES, "level", "trailing", "slope",
        ((F.col("_sy") - F.col("slope") * si) / n).alias("intercept"), means.alias("means"), covariances.alias("covariances"))


def rolling_pairs(history: DataFrame, origins: Sequence[int] = ORIGINS, horizon: int = HORIZON,
                  least: int = LEAST_POINTS) -> DataFrame:
    """(series_id, origin, ds, actual, model, predicted): each origin's forecasts of the periods after it.

    Series with fewer than ``least`` points are left out, as are origins that leave fewer than 7 to fit.
    """
    rows = materialise(running_fits(history).where(F.col("n") >= least))
    fits = (rows.where((F.col("n") - F.col("i") - 1).isin([int(o) for o in origins]) & (F.col("i") >= 6))
            .withColumn("beta", solve_line(3)("means", "covariances"))
            .select("series_id", (F.col("n") - F.col("i") - 1).alias("origin"), F.col("i").alias("_cut"),
                    F.col("level").alias("_level"), F.col("trailing").alias("_trailing"), F.col("slope").alias("_slope"),
                    F.col("intercept").alias("_intercept"), "beta"))
    tail = rows.where(F.col("i") >= F.col("n") - max(origins)).select("series_id", "ds", "i", F.col("y").alias("actual"), *CALENDAR_FEATURES)
    b = [F.col("beta")[k] for k in range(4)]
    values = {MOVING_AVERAGE: F.col("_trailing"), SMOOTHING: F.col("_level"), LINEAR: F.col("_intercept") + F.col("_slope") * F.col("i"),
              CALENDAR: b[0] + b[1] * F.col("day_index") + b[2] * F.col("weekday") + b[3] * F.col("month")}
    # noise in the last bits would make a forecast of zero count as wrong against an actual of zero
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.round(v, 8).alias("predicted")) for m, v in values.items()])
    met = tail.join(fits, "series_id").where((F.col("i") > F.col("_cut")) & (F.col("i") <= F.col("_cut") + horizon))
    return met.select("series_id", "origin", "ds", "actual", F.explode(models).alias("m")).select(
        "series_id", "origin", "ds", "actual", "m.model", "m.predicted")


def with_ensemble(pairs: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Add the weighted combination: a member's weight at an origin is in inverse proportion to its error at the
    origins before it, so no origin sees its own outcome. At the first origin all weigh the same."""
    kept = materialise(pairs)
    # one exchange by series serves the weights, the combination and the error sums that follow
    rows = kept.repartition(tasks_for(kept, rows_per_task), "series_id")
    before = Window.partitionBy("series_id", "model").orderBy(F.desc("origin")).rangeBetween(Window.unboundedPreceding, -1)
    error = F.avg(smape_term(F.col("actual"), F.col("predicted"), "zero")).over(before) * 100
    weight = F.coalesce(1 / (error + 1e-6), F.lit(1.0))
    combined = rows.withColumn("weight", weight).groupBy("series_id", "origin", "ds", "actual").agg(
        (F.sum(F.col("weight") * F.col("predicted")) / F.sum("weight")).alias("_all"),
        F.collect_list(F.struct("model", "predicted")).alias("_members"))
    members = F.concat("_members", F.array(F.struct(F.lit(ENSEMBLE).alias("model"), F.col("_all").alias("predicted"))))
    return combined.select("series_id", "origin", "ds", "actual", F.explode(members).alias("m")).select(
        "series_id", "origin", "ds", "actual", "m.model", "m.predicted")
