"""Cutting lineage, and numbering rows in a global order without one task that sees them all."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Spark's setting that has an execution's shuffle files deleted when it ends.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the session shares, or, on a local master without one, in the temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(shared or tempfile.gettempdir()).rstrip('/')}/basketloom-files/{uuid.uuid4().hex}/{name}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete what ``new_path`` gave a path for, with the folder made for it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table in the session's shared folder; cached where the session names none.

    Tables are compressed, which checkpoints are not, and Spark deletes the shuffle files of a write when it ends.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        return df.cache()
    path = new_path(spark, "table")
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the table that ``cut`` returned, which nothing may read any more; what is cached stays, as later tables are not worked out yet."""
    if hasattr(df, "table_path"):
        remove(df.sparkSession, df.table_path)


def sorted_runs(df: DataFrame, *order: Column | str) -> DataFrame:
    """Adds _run and _place: the rows in the given order are those by (_run, _place), places from 0 in each run."""
    placed = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    return placed.withColumn("_run", F.shiftright("_at", 33)).withColumn("_place", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")


def run_offsets(runs: DataFrame) -> DataFrame:
    """(_run, _before): rows in earlier runs.  As many rows as the sort had partitions."""
    before = Window.partitionBy(F.lit(0)).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    return runs.groupBy("_run").count().select("_run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """Adds row numbers from 1 in a total order."""
    runs = sorted_runs(df, *order)
    out = runs.join(F.broadcast(run_offsets(runs)), "_run")
    return out.withColumn(name, (F.col("_before") + F.col("_place") + 1).cast("long")).drop("_run", "_place", "_before")
