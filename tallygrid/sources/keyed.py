"""Dimension tables that are merged in place: rows lie in folders by hashed key, and a load rewrites only the
folders that receive rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .loading import upsert

_COLUMN = "key_part_of_"


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def write_keyed(frame: DataFrame, path: str, key: str, parts: int = 64) -> None:
    """A new table, one file per hashed part of the key. The folder names hold the number of parts."""
    name = f"{_COLUMN}{parts}"
    (frame.withColumn(name, _part(key, parts)).repartition(parts, name)
     .write.mode("overwrite").partitionBy(name).parquet(path))


def _stored(spark: SparkSession, path: str) -> tuple[DataFrame, str, int]:
    stored = spark.read.parquet(path)
    name = next(c for c in stored.columns if re.fullmatch(_COLUMN + r"\d+", c))
    return stored, name, int(name[len(_COLUMN):])


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    stored, name, _ = _stored(spark, path)
    return stored.drop(name)


def upsert_keyed(incoming: DataFrame, path: str, key: str, sequence: str) -> int:
    """Merge rows by key into a table of ``write_keyed``; the highest load sequence wins. Returns the parts rewritten.

    The parts touched are at most the number of folders, so their numbers may be listed; the scan of the stored rows
    reads these folders alone, and dynamic overwrite replaces them when all tasks are done. A load that is repeated
    after a failure gives the same table.
    """
    spark = incoming.sparkSession
    stored, name, parts = _stored(spark, path)
    placed = incoming.withColumn(name, _part(key, parts))
    touched = [r[0] for r in placed.select(name).distinct().collect()]
    if not touched:
        return 0
    kept = stored.where(F.col(name).isin(touched))
    merged = upsert(kept.drop(name), incoming, key, sequence)
    (merged.withColumn(name, _part(key, parts)).repartition(len(touched), name)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(path))
    spark.catalog.refreshByPath(path)
    return len(touched)
