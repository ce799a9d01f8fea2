"""Exact order statistics without a single-task sort.

A window without PARTITION BY sends every row to one task, and ``percentile``
holds every distinct value of a group in one buffer. Both break once a result
has more rows than one executor can take. Running totals here range-partition the
rows, number them inside each range, and add the range offsets afterwards;
percentiles bracket the wanted ranks with sketches and sort what lies between.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.columns import _col
from ..session import ensure_checkpoint_dir


# Fixed value: a generated id holds the partition number above this many bits of row number.
_ID_BITS = 33


# Setting by which Spark deletes what a query has shuffled as soon as the query ends.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(frame: DataFrame, free: bool = False) -> DataFrame:
    """Write a derived table once and read it back, so its readers do not each scan the facts.

    The table is columnar and lies in the shared checkpoint folder: it survives
    the loss of executors, readers take only the columns they need, and its
    measured size guides later join choices. With ``free`` the shuffle files of the write go at once, not when the
    driver happens to collect its garbage.
    """
    spark = frame.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4()}"
    before = spark.conf.get(_FREE, None)
    if free:
        spark.conf.set(_FREE, "true")
    try:
        frame.write.parquet(path)
    finally:
        if free and before is None:
            spark.conf.unset(_FREE)
        elif free:
            spark.conf.set(_FREE, before)
    return spark.read.schema(frame.schema).parquet(path)


# Fixed value: rows of a written or given table that one task sorts or joins.
ROWS_PER_TASK = 500_000


def tasks_for(table: DataFrame, rows_per_task: int | None = None, each: int = 1) -> int:
    """Tasks over which to deal the rows of a stored table, each to become up to ``each`` rows: the session's number, or
    more if the rows ask for it.

    With a fixed number of tasks, the memory of each and what it spills grow with the table. The count reads file
    footers only.
    """
    session = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(session, -(-table.count() * each // (rows_per_task or ROWS_PER_TASK)))


def dealt(frame: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """Rows dealt by key to ``tasks`` tasks, if these are more than the session's; else left to the planner."""
    session = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frame.repartition(tasks, *keys) if tasks > session else frame


def running_in_ranges(frame: DataFrame, order: Sequence[Column], totals: dict[str, str], partitions: int) -> DataFrame:
    """Rows sorted into ranges, with ``_range``, ``_row`` and a running sum ``_run_<name>`` inside the range.

    One exchange deals and sorts the ranges. The sums are carried through each sorted partition, batch by batch, so
    no window has to shuffle and sort the same rows by range again. A null adds nothing; a sum of nulls alone is null.
    """
    # the generated id is the range number and the place in it: no shuffle beyond the range one
    placed = frame.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn(
        "_id", F.monotonically_increasing_id())
    kinds = {name: "long" if isinstance(frame.schema[source].dataType, T.IntegralType) else "double"
             for name, source in totals.items()}
    local = placed.select(*frame.columns, F.shiftright("_id", _ID_BITS).alias("_range"),
                          (F.col("_id").bitwiseAND(F.lit((1 << _ID_BITS) - 1)) + 1).alias("_row"),
                          *[F.col(source).cast(kinds[name]).alias(f"_run_{name}") for name, source in totals.items()])
    if not totals:
        return local
    width = len(totals)

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, seen = [0] * width, [False] * width
        for batch in batches:
            columns = list(batch.columns)
            for k in range(width):
                at = len(columns) - width + k
                sums = columns[at].fill_null(0).to_numpy(zero_copy_only=False).copy()
                given = columns[at].is_valid().to_numpy(zero_copy_only=False)
                if len(sums):
                    sums[0] += before[k]
                    np.cumsum(sums, out=sums)
                    before[k] = sums[-1]
                none = np.zeros(len(sums), bool) if seen[k] else np.cumsum(given) == 0
                seen[k] |= bool(given.any())
                columns[at] = pa.array(sums, mask=none)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return local.mapInArrow(carry, local.schema)


def with_running(frame: DataFrame, order_by: Sequence[Column | str], position: str | None = "position",
                 totals: dict[str, str] | None = None, partitions: int | None = None) -> DataFrame:
    """Add a global 1-based row position and inclusive running sums.

    ``totals`` maps new column names to the columns they accumulate. The order
    must be total (end it with a key), or positions of tied rows are arbitrary.

    The ranged rows are written once: range bounds come from a sample, so
    the offsets and the rows must be read from the same materialised ranges.
    The offsets table has one row per range, which bounds the broadcast.
    """
    totals = totals or {}
    count = partitions or int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = materialise(running_in_ranges(frame, [_col(o) for o in order_by], totals, count))

    # the last row of a range holds its totals
    sizes = local.groupBy("_range").agg(
        F.max("_row").alias("_rows"), *[F.max_by(f"_run_{name}", "_row").alias(f"_sum_{name}") for name in totals])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        *[F.sum(f"_sum_{n}").over(earlier).alias(f"_off_{n}") for n in totals])
    joined = local.join(F.broadcast(offsets), "_range")
    added = [(F.col("_before") + F.col("_row")).alias(position)] if position else []
    added += [F.coalesce(F.col(f"_off_{n}") + F.col(f"_run_{n}"), f"_off_{n}", f"_run_{n}").alias(n) for n in totals]
    return joined.select(*frame.columns, *added)


# Sketch accuracy: a rank is known to within 1 / ACCURACY of a group's rows.
ACCURACY = 10_000


def percentile_brackets(frame: DataFrame, keys: Sequence[str], columns: Sequence[str], wanted: Sequence[float],
                        extra: Sequence[Column] = (), accuracy: int = ACCURACY) -> DataFrame:
    """One row per key: for each column its count and, around each wanted rank, two of its values that enclose it.

    One pass with mergeable quantile sketches, combined on the map side. The sketch's rank error is at most
    1 / accuracy of the rows, and the brackets lie twice as far out; a group too small for that is its own bracket.
    The table is written, so that its measured size decides how it meets the facts.
    """
    around = [p for q in wanted for p in (max(q - 2 / accuracy, 0.0), min(q + 2 / accuracy, 1.0))]
    sketches = []
    for c in columns:
        x = F.col(c).cast("double")
        sketches += [F.count(x).alias(f"_n_{c}"), F.min(x).alias(f"_min_{c}"), F.max(x).alias(f"_max_{c}"),
                     F.percentile_approx(x, [float(p) for p in around], accuracy).alias(f"_at_{c}")]
    found = frame.groupBy(*keys).agg(*sketches, *extra)
    ends = []
    for c in columns:
        small = F.col(f"_n_{c}") <= 4 * accuracy
        for k in range(len(wanted)):
            ends += [F.when(small, F.col(f"_min_{c}")).otherwise(F.col(f"_at_{c}")[2 * k]).alias(f"_lo_{c}_{k}"),
                     F.when(small, F.col(f"_max_{c}")).otherwise(F.col(f"_at_{c}")[2 * k + 1]).alias(f"_hi_{c}_{k}")]
    others = [c for c in found.columns if not c.startswith(("_min_", "_max_", "_at_"))]
    return materialise(found.select(*others, *ends))


def percentiles_within(frame: DataFrame, brackets: DataFrame, keys: Sequence[str], columns: Sequence[str],
                       wanted: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated percentiles (keys, _measure, wanted...) from the brackets of ``percentile_brackets``.

    One scan counts the values below each bracket on the map side and passes on only those inside, as value and
    count. These few are numbered in order, and the wanted ranks are read off.
    """
    keys, qs = list(keys), list(wanted.values())
    bound = join_on(frame.select(*keys, *dict.fromkeys(c for c in columns if c not in keys)), brackets, keys)
    cells = []
    for c in columns:
        x = F.col(c).cast("double")
        for k in range(len(qs)):
            kind = F.when(x < F.col(f"_lo_{c}_{k}"), F.lit(0)).when(x <= F.col(f"_hi_{c}_{k}"), F.lit(1))
            cells.append(F.struct(F.lit(c).alias("_measure"), F.lit(k).alias("_q"), F.col(f"_n_{c}").alias("_size"),
                                  kind.alias("_kind"), F.when(kind == 1, x).alias("_v")))
    counted = (bound.select(*keys, F.explode(F.array(*cells)).alias("_c")).where("_c._kind is not null")
               .groupBy(*keys, "_c._measure", "_c._q", "_c._size", "_c._kind", "_c._v").agg(F.count(F.lit(1)).alias("_in")))
    counted = materialise(counted)

    upto = Window.partitionBy(*keys, "_measure", "_q").orderBy("_kind", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = counted.withColumn("_last", F.sum("_in").over(upto) - 1).where("_kind = 1")
    first, last = F.col("_last") - F.col("_in") + 1, F.col("_last")
    quantile = F.element_at(F.array(*[F.lit(float(q)) for q in qs]), F.col("_q") + 1)
    target = quantile * (F.col("_size") - 1)

    def at(place: Column) -> Column:
        return F.max(F.when((first <= place) & (place <= last), F.col("_v")))

    found = rows.groupBy(*keys, "_measure", "_q", "_size").agg(at(F.floor(target)).alias("_low"), at(F.ceil(target)).alias("_high"))
    low, high = (F.coalesce(c, F.raise_error(F.lit("a wanted rank lies outside its bracket")).cast("double"))
                 for c in (F.col("_low"), F.col("_high")))
    value = low + (high - low) * (target - F.floor(target))
    return found.withColumn("_value", value).groupBy(*keys, "_measure").agg(
        *[F.max(F.when(F.col("_q") == k, F.col("_value"))).alias(name) for k, name in enumerate(wanted)])


def grouped_percentiles(frame: DataFrame, keys: Sequence[str], value: str,
                        wanted: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated percentiles per key, at any group size: (keys, wanted...), as a written table.

    Two map-side passes over the rows and no shuffle of them: sketches bracket the ranks, then only values inside
    the brackets are sorted.
    """
    keys = list(keys)
    narrow = frame.select(*keys, F.col(value).alias("_x")).where(F.col("_x").isNotNull())
    brackets = percentile_brackets(narrow, keys, ["_x"], list(wanted.values()))
    return materialise(percentiles_within(narrow, brackets, keys, ["_x"], wanted).drop("_measure"))


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe equi join on keys (a null key is a group of its own here).

    Without keys the right side is a one-row summary, so the pairing adds
    columns and no rows.
    """
    if not keys:
        return left.crossJoin(F.broadcast(right)) if how == "inner" else left.join(
            F.broadcast(right), F.lit(True), how)
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    condition = None
    for k in keys:
        clause = left[k].eqNullSafe(renamed[f"_r_{k}"])
        condition = clause if condition is None else condition & clause
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def with_scalars(frame: DataFrame, summary: DataFrame) -> DataFrame:
    """Attach the columns of a one-row summary to every row."""
    return frame.crossJoin(F.broadcast(summary))


def with_totals(frame: DataFrame, *totals: Column) -> DataFrame:
    """Attach totals of a small aggregate to its own rows.

    The aggregate is written once. Without that, column pruning gives the totals
    a plan of their own and the facts are scanned and shuffled a second time.
    """
    kept = materialise(frame)
    return with_scalars(kept, kept.agg(*totals))


def chunk_rows(frame: DataFrame, keys: Sequence[str], order: Sequence[str], lookback: int = 0, lookahead: int = 0,
               chunk_size: int = 2_000_000) -> DataFrame:
    """Split oversized keys into blocks of rows for row-offset windows, wherever in a day the cuts fall.

    Adds ``_chunk`` and ``_halo``. Windows partitioned by (keys, _chunk) also see, as halo rows, the ``lookback`` rows
    before the block and the ``lookahead`` rows after it; drop ``_halo`` rows after the window. A key under
    ``chunk_size`` rows is one block. ``order`` must tell the rows of a key apart, or ties may fall either way.

    The rows are written once as a narrow table, so each fact is scanned once. Keys above the limit are few (each has
    more than ``chunk_size`` rows); only their rows are numbered and dealt to blocks.
    """
    if max(lookback, lookahead) > chunk_size:
        raise ValueError("lookback and lookahead must not exceed chunk_size")
    keys = list(keys)
    stored = materialise(frame)
    hot = materialise(stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > chunk_size)
                      .select(*keys, F.lit(True).alias("_hot")))
    whole = {"_chunk": F.lit(0).cast("long"), "_halo": F.lit(False)}
    tasks = tasks_for(stored)
    if hot.isEmpty():
        return dealt(stored, tasks, *keys).withColumns(whole)
    marked = join_on(stored, hot, keys, "left")
    numbered = with_running(marked.where("_hot").drop("_hot"), [*keys, *order], "_p")
    own, place = F.floor((F.col("_p") - 1) / chunk_size), (F.col("_p") - 1) % chunk_size
    uses = [F.array(own)]
    if lookback:
        uses.append(F.when(place >= chunk_size - lookback, F.array(own + 1)).otherwise(F.array().cast("array<long>")))
    if lookahead:
        uses.append(F.when(place < lookahead, F.array(own - 1)).otherwise(F.array().cast("array<long>")))
    blocks = numbered.select("*", own.alias("_own"), F.explode(F.concat(*uses)).alias("_chunk")).withColumn(
        "_halo", F.col("_chunk") != F.col("_own"))
    columns = [*frame.columns, "_chunk", "_halo"]
    return dealt(marked.where("_hot is null"), tasks, *keys).withColumns(whole).select(*columns).unionByName(
        dealt(blocks, tasks, *keys, "_chunk").select(*columns))
