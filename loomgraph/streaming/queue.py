"""A work queue that goes on where it stopped: a stream of files of papers, with a commit for each file.

Papers that wait are put down in files of a few papers each, in order.  A run takes one
file after another, does the work and writes the result under the number of the batch,
over whatever a broken attempt has left there.  The stream's checkpoint is the commit:
a run that is killed after k files starts at the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.storage import numbered

_ENOUGH = "the limit of this run is reached"


class Queue:
    """The queue at path; key tells papers apart."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _there(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def add(self, papers: DataFrame, *order: Column, per_commit: int = 1) -> None:
        """Queues the papers that never were, in order, so many to a commit."""
        if self._there("waiting"):
            papers = papers.join(self.spark.read.parquet(f"{self.path}/waiting").select(self.key), self.key, "left_anti")
        placed = numbered(papers, "__n", *order).withColumn("__file", F.expr(f"(__n - 1) div {per_commit}"))
        n_files = (placed.agg(F.max("__file")).first()[0] or 0) + 1
        # a range for each file, so that files hold neighbours
        placed.repartitionByRange(n_files, "__file").sortWithinPartitions("__n").write.mode("append").option("maxRecordsPerFile", per_commit).parquet(f"{self.path}/waiting")

    def run(self, work: Callable[[DataFrame], DataFrame], limit: int | None = None) -> int:
        """Does the work on the files that wait, no more than limit of them; how many were done. What work raises ends the run, and its file stays."""
        done = 0

        def step(batch: DataFrame, number: int) -> None:
            nonlocal done
            if limit is not None and done >= limit:
                raise RuntimeError(_ENOUGH)
            work(batch.drop("__n", "__file")).write.mode("overwrite").parquet(f"{self.path}/done/batch={number}")
            done += 1

        schema = self.spark.read.parquet(f"{self.path}/waiting").schema
        stream = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/waiting")
        query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{self.path}/commits").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except StreamingQueryException as e:
            if _ENOUGH not in str(e):
                raise
        return done

    def results(self) -> DataFrame:
        """What was done so far, with the number of the batch."""
        return self.spark.read.option("basePath", f"{self.path}/done").parquet(f"{self.path}/done/*")
