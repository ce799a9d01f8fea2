"""Stock levels as keyed engine state: a micro-batch reads and writes only the products it touches.

The levels live in the engine's state store (RocksDB), versioned with the checkpoint: a restart or a replayed batch
starts from the level before that batch and gives the same changes. An opening level enters once, with its product's
first movement.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which keyed state needs; the setting is put back after."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


# Fixed value: states of a stream; one state holds the levels of the products that hash to it.
BUCKETS = 1024


def _ranks(values: pd.Series) -> np.ndarray:
    """Place of each value among the sorted distinct ones, nulls last."""
    codes, found = pd.factorize(values, sort=True)
    return np.where(codes < 0, len(found), codes)


def stock_changes(movements: DataFrame, levels: DataFrame, tiebreak: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """Streaming twin of ``jobs.level_changes``: movements (product_id, changed_at, quantity, ...) with both levels.

    Products are dealt to ``buckets`` by hash and one call handles all products of a bucket at once, since a call for
    each product costs far more than its few rows. The state of a bucket is the level of every product that has moved;
    opening levels are joined to the movements and count with a product's first one only. The rows of a bucket in one
    micro-batch are held together to be sorted; what bounds a micro-batch (``maxFilesPerTrigger``,
    ``maxOffsetsPerTrigger``) bounds them. A running stream must keep its number of buckets.
    """
    order = ["changed_at", *tiebreak]
    given = movements.columns
    schema = T.StructType([*movements.schema.fields, T.StructField("product_name", T.StringType()),
                           T.StructField("reorder_threshold", T.IntegerType()), T.StructField("previous_stock", T.IntegerType()),
                           T.StructField("current_stock", T.IntegerType())])
    held = T.StructType([T.StructField("products", T.ArrayType(movements.schema["product_id"].dataType)),
                         T.StructField("stocks", T.ArrayType(T.LongType()))])
    opening = levels.select("product_id", F.col("product_name").alias("_name"), F.col("reorder_threshold").cast("int").alias("_limit"),
                            F.col("stock").cast("long").alias("_stock")).where("_stock is not null").dropDuplicates(["product_id"])

    def follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts), ignore_index=True)
        which, products = pd.factorize(rows["product_id"])
        level = rows["_stock"].to_numpy().astype(np.int64)[np.unique(which, return_index=True)[1]]
        before, stocks = state.get if state.exists else ([], [])
        before, stocks = list(before), np.array(stocks, dtype=np.int64)
        at = pd.Index(before, dtype=products.dtype).get_indexer(products)
        level[at >= 0] = stocks[at[at >= 0]]

        placed = np.lexsort([_ranks(rows[c]) for c in reversed(order)] + [which])
        rows, which = rows.take(placed), which[placed]
        change = rows["quantity"].fillna(0).to_numpy().astype(np.int64)
        run = np.cumsum(change)
        last = np.flatnonzero(np.append(which[1:] != which[:-1], True))
        after = level[which] + run - np.append(0, run[last[:-1]])[which]
        level = after[last]

        stocks[at[at >= 0]] = level[at >= 0]
        state.update((before + products[at < 0].tolist(), stocks.tolist() + level[at < 0].tolist()))
        yield rows[given].assign(product_name=rows["_name"], reorder_threshold=rows["_limit"].astype("Int32"),
                                 previous_stock=(after - change).astype(np.int32), current_stock=after.astype(np.int32))

    bucket = F.pmod(F.xxhash64("product_id"), F.lit(buckets)).alias("_bucket")
    return movements.join(opening, "product_id").select(*given, "_name", "_limit", "_stock", bucket).groupBy("_bucket").applyInPandasWithState(
        follow, schema, held, "append", GroupStateTimeout.NoTimeout)
