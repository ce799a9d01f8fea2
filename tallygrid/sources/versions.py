"""Versioned parameter tables: what was fitted is stored once and joined later instead of being fitted again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException


def versions(spark: SparkSession, path: str) -> list[int]:
    """Stored versions, oldest first. Only folder names are read."""
    try:
        found = spark.read.parquet(path).select("version").distinct().collect()
    except AnalysisException:
        return []
    return sorted(r.version for r in found)


def save_version(frame: DataFrame, path: str, version: int | None = None) -> int:
    """Store a table under a version, by default the next; a version written again replaces itself. Returns the version."""
    if version is None:
        version = max(versions(frame.sparkSession, path), default=0) + 1
    frame.write.mode("overwrite").parquet(f"{path}/version={version}")
    return version


def load_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table of a version, by default the latest."""
    if version is None:
        version = max(versions(spark, path), default=None)
        if version is None:
            raise ValueError(f"no version is stored at {path}")
    return spark.read.parquet(path).where(F.col("version") == version).drop("version")
