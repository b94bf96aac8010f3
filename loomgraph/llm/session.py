"""What the operators need of a session: shared folders, batch sizes, tables."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.shipping import ship

#: Rows of an Arrow batch: some texts are long, and a batch is held whole.
BATCH_ROWS = 256
#: Paths of the tables that written() made and that are not deleted yet.
_HELD: list[str] = []


def prepare(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors, and bounds the rows of an Arrow batch, as texts may be long.

    The bound stays set in the session, as results are evaluated after the call.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on one machine one of our own where it is unset."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(named or "/tmp/loomgraph-checkpoints")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    _HELD.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _HELD:
        _HELD.remove(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made and that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df.written_path)


def held_tables() -> list[str]:
    """Paths of the tables that stand at the moment."""
    return list(_HELD)


def discard_since(spark: SparkSession, before: list[str], *keep: DataFrame) -> None:
    """Deletes the tables that were written since before was taken, but for keep: an operator's, once its result is written."""
    stay = {*before, *(df.written_path for df in keep)}
    for path in [p for p in _HELD if p not in stay]:
        _delete(spark, path)
    release(spark)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of finished jobs: the driver deletes them once it has collected what names them."""
    gc.collect()
    spark._jvm.System.gc()


def with_common(rows: DataFrame, table: DataFrame, key: str, limit: int) -> DataFrame:
    """rows with the columns of table (key, n, ...), null where it lacks the key; n is how many rows hold a key.

    A table of at most limit keys is broadcast, so rows stay where they are. Of a larger
    one the commonest keys are, as many as fit; the rows of all others are shuffled by
    key, of which each then has at most a known number.
    """
    columns = [c for c in table.columns if c not in (key, "n")]
    if table.count() <= limit:
        return rows.join(F.broadcast(table.drop("n")), key, "left")
    most = 1
    while table.where(F.col("n") > most).count() > limit:
        most *= 2
    mark = free_name("__common", rows.columns)
    common = table.where(F.col("n") > most).drop("n").withColumn(mark, F.lit(True))
    met = rows.join(F.broadcast(common), key, "left")
    rest = met.where(F.col(mark).isNull()).drop(mark, *columns).join(table.where(F.col("n") <= most).drop("n"), key, "left")
    return met.where(F.col(mark).isNotNull()).drop(mark).unionByName(rest)


def drawn(rows: DataFrame, n_rows: int, most: int, *columns: str) -> DataFrame:
    """The at most most rows with the smallest hashes of columns, ties by the columns themselves, the same for any layout of n_rows rows.

    Only rows with hashes below a bound that twice as many are expected to meet are sorted.
    """
    if n_rows > 2 * most:
        rows = rows.where(F.xxhash64(*columns) < int(-(2**63) + 2**64 * (2 * most / n_rows)))
    return rows.orderBy(F.xxhash64(*columns), *columns).limit(most)


def free_name(name: str, taken: Iterable[str]) -> str:
    """name, with underscores as long as a column (in any case) bears it already."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
