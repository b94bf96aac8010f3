"""Streaming forms of the incremental operators: monotone states, first-seen registers, windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomgraph.operators.storage import table_path


def read_table(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table of a directory as a stream; its schema is read once."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{folder}/{name}.parquet*")


def state_machine(transitions: DataFrame) -> DataFrame:
    """(user_id, state_rank, n_events) updates of a machine that never goes back unless forced.

    transitions: (user_id, state_rank, forced). A late event of a lower rank changes
    nothing, so no watermark is needed for right results.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rank, n = state.get if state.exists else (-1, 0)
        for b in batches:
            for value, forced in zip(b["state_rank"], b["forced"], strict=True):
                rank = int(value) if forced or value > rank else rank
                n += 1
        state.update((rank, n))
        yield pd.DataFrame({"user_id": [key[0]], "state_rank": [rank], "n_events": [n]})

    return transitions.groupBy("user_id").applyInPandasWithState(step, "user_id long, state_rank int, n_events long", "rank int, n long", "update", GroupStateTimeout.NoTimeout)


class _Places(StatefulProcessor):
    """Where each key stands, by the latest time of every rank and the last forced move; what is idle for long is told and forgotten."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "ranks array<int>, times array<long>, forced_at long, forced_rank int, n long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        ranks, times, forced_at, forced_rank, n = self.held.get() if self.held.exists() else ([], [], -1, -1, 0)
        latest = dict(zip(ranks, times, strict=True))
        for batch in rows:
            n += len(batch)
            at = batch["at"].astype("int64")
            for rank, time in at.groupby(batch["state_rank"]).max().items():
                latest[int(rank)] = max(int(time), latest.get(int(rank), -1))
            moved = batch.assign(at=at)[batch["forced"]].sort_values(["at", "state_rank"])
            if len(moved) and (int(moved["at"].iloc[-1]), int(moved["state_rank"].iloc[-1])) > (forced_at, forced_rank):
                forced_at, forced_rank = int(moved["at"].iloc[-1]), int(moved["state_rank"].iloc[-1])
        self.held.update((list(latest), list(latest.values()), forced_at, forced_rank, n))
        if self.idle_ms is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(latest.values()) // 1000 + self.idle_ms)
        yield self._told(key, latest, forced_at, forced_rank, n, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        ranks, times, forced_at, forced_rank, n = self.held.get()
        self.held.clear()
        yield self._told(key, dict(zip(ranks, times, strict=True)), forced_at, forced_rank, n, True)

    @staticmethod
    def _told(key, latest: dict, forced_at: int, forced_rank: int, n: int, closed: bool) -> pd.DataFrame:
        rank = max([forced_rank, *(r for r, t in latest.items() if t > forced_at)])
        return pd.DataFrame({"key": [key[0]], "state_rank": pd.array([rank], "int32"), "n_events": [n], "closed": [closed]})

    def close(self) -> None:
        pass


def places(moves: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """(key, state_rank, n_events, closed) updates of a stream of (key, ts, state_rank, forced), which has a watermark on ts where idle_ms is given.

    A key stands at the highest rank after its last forced move, or at that move's; moves
    at the time of a forced one lie before it. This holds in whatever order moves come:
    the state has the latest time of every rank, no more. With idle_ms a key of which
    the watermark has left nothing newer than that is told once more as closed, and its
    state goes. Sets the session's state store to RocksDB, which such streams need.
    """
    spark = moves.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    given = moves.withColumn("at", F.unix_micros("ts"))
    return given.groupBy("key").transformWithStateInPandas(_Places(idle_ms), "key long, state_rank int, n_events long, closed boolean", "update", "EventTime" if idle_ms is not None else "None")


def first_seen(rows: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """The first row of each key that comes, and none that comes again within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def collected(stream: DataFrame, name: str, mode: str = "update") -> DataFrame:
    """Runs a stream over all that is there; its rows, in a table in the shared folder, with the number of their batch."""
    path = table_path(stream.sparkSession, f"stream-{name}")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.option("basePath", f"{path}/data").parquet(f"{path}/data/*")


def merged(stream: DataFrame, key: str, latest: str, name: str) -> DataFrame:
    """Runs a stream of updates over all that is there and returns each key's last one.

    Micro-batches are appended with their number to a table in the shared folder, so a
    batch that is repeated after a failure only repeats rows that the last step folds.
    """
    spark = stream.sparkSession
    path = table_path(spark, f"stream-{name}")

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    columns = stream.columns
    out = spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data/*")
    return out.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct("__batch", latest)).alias("last")).select("last.*")


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts of (ts, event_type) in tumbling windows, late events within the watermark included."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width)["start"].alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"))
