"""Intermediate tables in the shared folder, and small helpers that several operators use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, where driver and executors
    are one process, may go without; anything else without that setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local[") and master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="llm-shared-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """Tables of one operator run. A written table cuts lineage and survives lost executors.

    ``drop`` removes tables that a loop has superseded. Tables that the returned (lazy) result still reads
    stay until the owner of the shared folder clears it.
    """

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark).rstrip('/')}/{operator}-{uuid.uuid4().hex}"
        self._count = 0

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        """Write ``frame`` and return it as read back."""
        self._count += 1
        path = f"{self.folder}/{self._count:03d}-{name}"
        frame.write.parquet(path)
        back = self.spark.read.schema(frame.schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, *frames: DataFrame | None) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for frame in frames:
            path = getattr(frame, "_scratch_path", None)
            if path:
                target = jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(conf).delete(target, True)


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, or the first longer name like it that no column has, whatever the case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def salted_number(frame: DataFrame, groups: list[str], order: list[str], name: str, salts: int = 64) -> DataFrame:
    """Number rows from 0 without gaps inside each group, with a hot group spread over ``salts`` tasks.

    Rows are counted per (group, salt), the counts give each salt its first number, and rows are
    numbered inside their salt. ``order`` must tell rows apart for a repeatable numbering.
    """
    from pyspark.sql import Window

    salted = frame.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = salted.groupBy(*groups, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups or [F.lit(0)]).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_salt").alias("_s"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(*groups, "_salt").orderBy(*order)
    numbered = salted.withColumn("_row", F.row_number().over(inside) - 1)
    same = F.col("_salt") == F.col("_s")
    for i, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return (numbered.join(firsts, same)
            .withColumn(name, F.col("_first") + F.col("_row"))
            .drop("_salt", "_s", "_row", "_first", *[f"_g{i}" for i in range(len(groups))]))
