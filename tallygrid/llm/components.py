"""Connected components of a link table by iterated joins (large-star and small-star steps)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch


def _edges(frame: DataFrame) -> DataFrame:
    return frame.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b); a component is named by its smallest id.

    Each round points every id's larger neighbours at its smallest neighbour, then every id's smaller ones, until
    nothing changes. Only minima are gathered per id, so a hub costs a partial aggregate and a join that can be split.
    """
    edges = scratch.keep(_edges(links), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("n")).agg(F.least("n", F.min("b")).alias("low"))
        large = both.where(F.col("b") > F.col("a")).join(low, F.col("a") == F.col("n")).select(
            F.col("b").alias("a"), F.col("low").alias("b"))
        starred = scratch.keep(_edges(large), "starred")
        down = starred.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("low"))
        small = starred.join(down, F.col("a") == F.col("n")).select("b", "low", F.explode(F.array("a", "b")).alias("x"))
        fresh = scratch.keep(_edges(small.select(F.col("x").alias("a"), F.col("low").alias("b"))), "edges")
        state = fresh.agg(F.count(F.lit(1)), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(edges, starred)
        edges = fresh
        if state == seen:
            return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        seen = state
