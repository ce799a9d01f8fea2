"""Fit once, use many times: stored parameters of forecasts, encoders and scalers.

Every fitted object is a table with one row per series, key or column. It is stored as a version
(``sources.versions``) and joined when it is used; nothing is fitted again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from . import forecast as fc
from .ensemble import ensemble_forecast, ensemble_weights, holdout_pairs
from .features import label_index
from .ordered import join_on, materialise, with_running, with_scalars

CALENDAR = "linear_calendar"
MEMBERS = [fc.MOVING_AVERAGE, fc.SMOOTHING, fc.LINEAR]


# -- forecasts ------------------------------------------------------------------------------------------------------

def fit_parameters(history: DataFrame, holdout: int | None = None, band: float = 0.2) -> DataFrame:
    """One row per series: trailing mean, smoothed level, line, calendar coefficients, and ensemble weights.

    The weights come from the errors on the last ``holdout`` periods; without it the members weigh the same.
    """
    kept = materialise(history)
    simple = fc.fit_simple(kept)
    calendar = fc.fit_calendar(kept).select("series_id", "beta", "last_index")
    if holdout is None:
        weights = simple.select("series_id", F.create_map(*[x for m in MEMBERS for x in (F.lit(m), F.lit(1.0 / len(MEMBERS)))]).alias("weights"))
    else:
        pairs = materialise(holdout_pairs(kept, lambda train: fc.forecast_all_simple(train, holdout, band), holdout))
        weights = ensemble_weights(pairs, MEMBERS, kept).groupBy("series_id").agg(
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("model", "weight")))).alias("weights"))
    return simple.join(calendar, "series_id", "left").join(weights, "series_id", "left")


def forecast_members(parameters: DataFrame, horizon: int = 30, band: float | None = None) -> DataFrame:
    """The three closed-form methods from stored parameters."""
    return fc.all_simple_from(parameters, horizon, band)


def forecast_best(parameters: DataFrame, horizon: int = 30) -> DataFrame:
    """The method that a series' length allows, from stored parameters."""
    return fc.auto_from(parameters, horizon)


def forecast_calendar(parameters: DataFrame, horizon: int = 7) -> DataFrame:
    return fc.calendar_from(parameters.where(F.col("beta").isNotNull()), horizon)


def forecast_weighted(parameters: DataFrame, horizon: int = 30, band: float = 0.2) -> DataFrame:
    """The ensemble from stored parameters and weights."""
    weights = parameters.where(F.col("weights").isNotNull()).select("series_id", F.explode("weights").alias("model", "weight"))
    return ensemble_forecast(forecast_members(parameters, horizon, band), weights)


# -- encoders -------------------------------------------------------------------------------------------------------

def fit_encoder(frame: DataFrame, key: str = "product_id") -> DataFrame:
    """(key, code): codes from zero in key order. Null keys get no code."""
    return label_index(frame.where(F.col(key).isNotNull()), key).select(key, F.col(f"{key}_encoded").alias("code"))


def extend_encoder(stored: DataFrame, frame: DataFrame, key: str = "product_id") -> DataFrame:
    """The stored codes, and codes for the keys not seen before, appended after the largest in key order.

    A key never changes its code, whatever arrives later.
    """
    unseen = frame.where(F.col(key).isNotNull()).select(key).distinct().join(stored.select(key), key, "left_anti")
    top = stored.agg(F.coalesce(F.max("code"), F.lit(-1)).alias("_top"))
    fresh = with_scalars(with_running(unseen, [key], "_p"), top).select(key, (F.col("_top") + F.col("_p")).cast("int").alias("code"))
    return stored.unionByName(fresh)


def encode(frame: DataFrame, encoder: DataFrame, key: str = "product_id") -> DataFrame:
    """Add ``<key>_encoded``; a key that the encoder does not know is -1."""
    codes = encoder.withColumnRenamed("code", "_code")
    return join_on(frame, codes, [key], "left").withColumn(f"{key}_encoded", F.coalesce("_code", F.lit(-1))).drop("_code")


# -- scalers --------------------------------------------------------------------------------------------------------

def fit_scaler(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, n, mean, m2): count, mean and sum of squared deviations of each column, from one pass."""
    sums = frame.agg(*[e for c in columns for e in (
        F.count(c).alias(f"_n_{c}"), F.avg(c).alias(f"_m_{c}"), (F.var_pop(c) * F.count(c)).alias(f"_s_{c}"))])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_n_{c}").alias("n"), F.col(f"_m_{c}").alias("mean"),
                               F.col(f"_s_{c}").alias("m2")) for c in columns])
    return sums.select(F.explode(cells).alias("c")).select("c.*")


def merge_scalers(*scalers: DataFrame) -> DataFrame:
    """The scaler of all rows together, from scalers of disjoint parts: moments add up, the rows are not read again."""
    union = scalers[0]
    for other in scalers[1:]:
        union = union.unionByName(other)
    sums = union.where("n > 0").groupBy("feature").agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"),
        F.collect_list(F.struct("n", "mean", "m2")).alias("parts"))
    m2 = F.aggregate("parts", F.lit(0.0), lambda total, p: total + p["m2"] + p["n"] * (p["mean"] - F.col("mean")) ** 2)
    return sums.select("feature", "n", "mean", m2.alias("m2"))


def scale(frame: DataFrame, scaler: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Standardise by stored moments; a constant column is only centred."""
    def pick(column: str, feature: str):
        return F.max(F.when(F.col("feature") == feature, F.col(column)))

    wide = scaler.agg(*[e for c in columns for e in (
        pick("mean", c).alias(f"_m_{c}"), F.sqrt(pick("m2", c) / pick("n", c)).alias(f"_s_{c}"))])
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(F.lit(1.0)) for c in columns}
    return with_scalars(frame, wide).withColumns(scaled).select(*frame.columns)
