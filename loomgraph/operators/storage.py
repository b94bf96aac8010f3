"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on one machine a folder of our own where it is unset."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(named or "/tmp/loomgraph-checkpoints")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


#: Paths in the shared folder that were given out and not deleted yet.
_HELD: list[str] = []


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _HELD.append(path)
    return path


def held_paths() -> list[str]:
    """Paths in the shared folder that stand at the moment."""
    return list(_HELD)


def discard_since(spark: SparkSession, before: list[str], *keep: str) -> int:
    """Deletes what was put into the shared folder since before was taken, but for keep: once a result that reads it is written or shown.

    Nothing goes while a job runs, as that may still read it; how many paths went.
    """
    tracker, gone = spark.sparkContext.statusTracker(), 0
    for path in [p for p in _HELD if p not in before and p not in keep]:
        if tracker.getActiveJobsIds():
            break
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _HELD.remove(path)
        gone += 1
    return gone


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table: lineage ends there, and a lost executor costs no recomputation."""
    path = table_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """rows with their place in the order, from 1 on.

    Rows are sorted by range and written once; the sizes of the ranges before give each
    its start, so that no window over all rows meets in one task.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id())
    held = written(dealt.withColumn("__at", F.monotonically_increasing_id() - F.shiftleft(F.col("__range").cast("long"), 33) + 1))
    sizes = held.groupBy("__range").agg(F.max("__at").alias("__size"))
    # a row for each range
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.join(F.broadcast(sizes.select("__range", before.alias("__before"))), "__range").withColumn(name, F.col("__before") + F.col("__at")).drop("__range", "__at", "__before")


def spread(rows: DataFrame) -> DataFrame:
    """rows for work that is long for each row: dealt to all cores where they come in fewer pieces than there are cores.

    A large table comes in more pieces and stays as it is. For rows as they are read from
    tables: to count the pieces of what is shuffled, its shuffles would have to run.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


#: Tables of at most so many rows are sent to every executor.
SMALL_ROWS = 200_000


def small(table: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """A written table, to be broadcast where it has no more than limit rows; beyond that joins shuffle it."""
    return F.broadcast(table) if table.count() <= limit else table
