"""Structured Streaming jobs: batch sinks, dispatch, quarantine, stock state.

Every sink writes under its batch id and overwrites it, so a batch that is
replayed after a failure leaves the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..operators.ordered import dealt, materialise, tasks_for
from . import envelope
from .levels import keyed_state, stock_changes
from .windows import late_events

Handler = Callable[[DataFrame, int], None]


def batch_folder(path: str, batch_id: int) -> str:
    return f"{path}/batch={batch_id:012d}"


def write_batches(path: str) -> Handler:
    """Each micro-batch to its own folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(batch_folder(path, batch_id))
    return write


def latest_by_key(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Newest version of each key over all written batches (update-mode results)."""
    written = spark.read.parquet(path)
    rest = [c for c in written.columns if c not in keys and c != "batch"]
    last = F.max_by(F.struct(*rest), "batch").alias("_last")
    return written.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def run_available(stream: DataFrame, sink: Handler, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Process everything available now through a batch sink, then stop."""
    query = (stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def write_channels(events: DataFrame, path: str, checkpoint: str):
    """Streaming sink with one folder per channel."""
    return (events.withColumn("channel", F.coalesce(envelope.channel(F.col("event_type")), F.lit("none")))
            .writeStream.format("parquet").partitionBy("channel").option("path", path)
            .option("checkpointLocation", checkpoint))


def dispatch_events(handlers: dict[str, Sequence[Handler]], default: Sequence[Handler] = (),
                    on_error: Callable[[str, int, Exception], None] | None = None) -> Handler:
    """Batch sink that gives each handler the events of its type.

    Default handlers get every event. A failing handler is reported and the rest still run. Without ``on_error``
    the first failure is raised after the rest have run, so the batch is not lost: the query stops before it.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            work = [(kind, batch.where(F.col("event_type") == kind), h) for kind, hs in handlers.items() for h in hs]
            work += [("*", batch, h) for h in default]
            failures = []
            for kind, rows, handler in work:
                try:
                    handler(rows, batch_id)
                except Exception as problem:  # noqa: BLE001 - one handler must not stop the others
                    failures.append(problem)
                    if on_error:
                        on_error(kind, batch_id, problem)
            if failures and not on_error:
                raise failures[0]
        finally:
            batch.unpersist()
    return run


def publish_or_quarantine(publish: Handler, quarantine: str) -> Handler:
    """Publish a batch; if that fails, keep its rows for a later replay."""
    def run(batch: DataFrame, batch_id: int) -> None:
        try:
            publish(batch, batch_id)
        except Exception as problem:  # noqa: BLE001 - any failure keeps the events
            (batch.withColumn("reason", F.lit(str(problem)))
             .write.mode("overwrite").parquet(batch_folder(quarantine, batch_id)))
    return run


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def drain_quarantine(spark: SparkSession, quarantine: str, replayed: str, max_count: int = 100) -> DataFrame:
    """Oldest kept events not replayed yet, at most ``max_count``; the rest stay for the next call."""
    kept = spark.read.parquet(quarantine)
    done = _read_or_none(spark, replayed)
    if done is not None:
        kept = kept.join(done.select("event_id").distinct(), "event_id", "left_anti")
    return kept.orderBy("timestamp", "event_id").limit(max_count)


def confirm_replay(drained: DataFrame, replayed: str) -> None:
    drained.select("event_id").write.mode("append").parquet(replayed)


def running_stock(orders: DataFrame) -> DataFrame:
    """Units taken per product so far. A plain sum, so the engine keeps the state and folds hot products early."""
    return orders.groupBy("product_id").agg(
        F.sum("quantity").alias("sold"), F.count(F.lit(1)).alias("orders"))


def stock_after(sold: DataFrame, products: DataFrame) -> DataFrame:
    """Stock left per product, against the opening stock."""
    return products.select("product_id", "initial_stock", "reorder_threshold").join(sold, "product_id", "left").select(
        "product_id", F.coalesce("orders", F.lit(0)).alias("orders"),
        (F.col("initial_stock") - F.coalesce("sold", F.lit(0))).alias("stock"), "reorder_threshold")


def level_changes(movements: DataFrame, levels: DataFrame, tiebreak: Sequence[str]) -> DataFrame:
    """Level before and after every movement, in event order, from the given opening levels.

    Minutes run per product first and rows run inside their minute, so a product
    with most of the movements is spread over its minutes. The movements are
    written once and read by both.
    """
    movements = materialise(movements)
    tasks = tasks_for(movements)
    rows = dealt(movements.withColumn("_m", F.date_trunc("minute", "changed_at")), tasks, "product_id", "_m")
    per_minute = dealt(rows.groupBy("product_id", "_m").agg(F.sum("quantity").alias("_net")), tasks, "product_id")
    earlier = Window.partitionBy("product_id").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    opening = per_minute.join(levels.select("product_id", "product_name", "reorder_threshold", "stock"), "product_id").select(
        "product_id", "_m", "product_name", "reorder_threshold",
        (F.col("stock") + F.coalesce(F.sum("_net").over(earlier), F.lit(0))).alias("_carried"))
    inside = Window.partitionBy("product_id", "_m").orderBy("changed_at", *tiebreak).rowsBetween(Window.unboundedPreceding, 0)
    current = (F.col("_carried") + F.sum("quantity").over(inside)).cast("int")
    return rows.join(opening, ["product_id", "_m"]).select(
        *movements.columns, "product_name", "reorder_threshold",
        (current - F.col("quantity")).cast("int").alias("previous_stock"), current.alias("current_stock"))


def transitions(changes: DataFrame) -> DataFrame:
    """Stock events for the changes that cross into low, out or replenished."""
    kind = envelope.stock_transition(F.col("previous_stock"), F.col("current_stock"), F.col("reorder_threshold"))
    crossed = changes.withColumn("_kind", kind).where(F.col("_kind").isNotNull())
    return envelope.stock_events(crossed, F.col("_kind"))


def stock_alerts(movements: DataFrame, levels: DataFrame, tiebreak: Sequence[str], out: str, checkpoint: str) -> StreamingQuery:
    """Write the transition events of a stream of movements, batch by batch, until nothing more is available.

    Levels are keyed engine state, so a batch updates the buckets of the products that move in it and no others. The
    opening levels are written once for all batches of the run.
    """
    opening = materialise(levels)
    with keyed_state(movements.sparkSession):
        return run_available(transitions(stock_changes(movements, opening, tiebreak)), write_batches(out), checkpoint, "append")


def late_audit_sink(path: str, delay: str, column: str = "timestamp") -> Handler:
    """Batch sink that counts rows later than the watermark of the batches before."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = None if batch_id == 0 else _read_or_none(spark, path)
        totals = batch.agg(F.count(F.lit(1)).alias("rows"), F.max(F.col(column).cast("timestamp")).alias("latest"))
        if seen is None:
            late = batch.limit(0)
        else:
            latest = seen.where(F.col("batch") < batch_id).agg(F.max("latest")).scalar()
            late = late_events(batch, latest, delay, column)
        counted = totals.crossJoin(F.broadcast(late.agg(F.count(F.lit(1)).alias("late"))))
        counted.write.mode("overwrite").parquet(batch_folder(path, batch_id))
    return run
