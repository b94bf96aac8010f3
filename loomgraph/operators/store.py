"""A stored table of rows by key, whose merges rewrite what they touch and check constraints first.

Rows lie in buckets by a hash of their key, each bucket a folder of Parquet files that
is never changed.  A manifest names the folder of every bucket; the one with the highest
number is the table.  A merge reads the buckets of its keys alone, upserts them, checks
the constraints, writes the buckets that differ to new folders, and puts up the next
manifest last: a merge that fails or breaks a constraint leaves the table as it was, and
a merge that is repeated changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomgraph.operators.merge import upsert
from loomgraph.operators.storage import written

_BUCKET = "__bucket"


class ConstraintError(ValueError):
    """A merge would break a constraint."""


class Store:
    """The table at path, by key; unique columns hold a value once (nulls aside), required ones are never null."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, unique: tuple[str, ...] = (), required: tuple[str, ...] = (), buckets: int = 32):
        self.spark, self.path, self.key, self.unique, self.required, self.buckets = spark, path.rstrip("/"), key, unique, (key, *required), buckets
        self.schema = StructType.fromDDL(schema)

    def _files(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def install(self) -> int:
        """Makes an empty table where there is none; the version that stands."""
        if self.version() is None:
            self._put_up(0, {})
        return self.version()

    def version(self) -> int | None:
        at, files = self._files()
        if not files.exists(at):
            return None
        numbers = [int(name[: -len(".json")]) for f in files.listStatus(at) if (name := f.getPath().getName()).endswith(".json")]
        return max(numbers, default=None)

    def _manifest(self, version: int | None = None) -> dict[int, str]:
        """Folders by bucket."""
        number = self.version() if version is None else version
        if number is None:
            raise ValueError(f"no table at {self.path}")
        text = self.spark.read.text(f"{self.path}/manifests/{number}.json", wholetext=True).first()[0]
        return {int(k): v for k, v in json.loads(text)["buckets"].items()}

    def _put_up(self, version: int, folders: dict[int, str]) -> None:
        at, files = self._files()
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        draft, final = hadoop(f"{self.path}/manifests/{uuid.uuid4().hex}.draft"), hadoop(f"{self.path}/manifests/{version}.json")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps({"version": version, "buckets": folders}).encode()))
        out.close()
        if files.exists(final) or not files.rename(draft, final):
            files.delete(draft, False)
            raise RuntimeError(f"another merge has put up version {version} of {self.path}")

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the table, or of an earlier version."""
        return self._rows(list(self._manifest(version).values()))

    def merge(self, rows: DataFrame, **policy: tuple[str, ...]) -> int:
        """Upserts rows, one for each key, by the policy of upsert(); the version that stands then."""
        number = self.install()
        folders = self._manifest(number)
        new = written(rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema)).withColumn(_BUCKET, self._bucket()))
        self._check_rows(new)
        touched = [r[0] for r in new.select(_BUCKET).distinct().collect()]  # as many as there are buckets at most
        old = self._rows([folders[b] for b in touched if b in folders])
        merged = written(upsert(old, new.drop(_BUCKET), self.key, **policy).withColumn(_BUCKET, self._bucket()))
        self._check(merged, self._rows([f for b, f in folders.items() if b not in touched]))
        changed = self._differ(old.withColumn(_BUCKET, self._bucket()), merged)
        if not changed:
            return number
        home = f"{self.path}/data/{uuid.uuid4().hex}"
        merged.where(F.col(_BUCKET).isin(changed)).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(home)
        self._put_up(number + 1, folders | {b: f"{home}/{_BUCKET}={b}" for b in changed})
        return number + 1

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _check_rows(self, new: DataFrame) -> None:
        twice = new.groupBy(self.key).count().where(f"count > 1 OR `{self.key}` IS NULL").limit(1).collect()
        if twice:
            raise ConstraintError(f"{self.key}: null or several rows for {twice[0][0]!r} in one merge")

    def _check(self, merged: DataFrame, rest: DataFrame) -> None:
        """Raises for the first constraint that the touched rows break, among themselves or with the rest."""
        for c in self.required:
            if merged.where(F.col(c).isNull()).limit(1).count():
                raise ConstraintError(f"{c} is required")
        for c in self.unique:
            values = merged.where(F.col(c).isNotNull()).groupBy(c).count()
            clash = values.where("count > 1").select(c).unionByName(rest.select(c).join(values.select(c), c, "left_semi")).limit(1).collect()
            if clash:
                raise ConstraintError(f"{c} is unique: {clash[0][0]!r} on several rows")

    def _differ(self, old: DataFrame, merged: DataFrame) -> list[int]:
        """Buckets whose rows are not the same: by sums of hashes of their rows."""
        def told(rows: DataFrame, name: str) -> DataFrame:
            return rows.groupBy(_BUCKET).agg(F.struct(F.count(F.lit(1)), F.sum(F.xxhash64(*(c.name for c in self.schema)).cast("decimal(38,0)"))).alias(name))

        both = told(merged, "now").join(told(old, "before"), _BUCKET, "left")
        return [r[0] for r in both.where(~F.col("now").eqNullSafe(F.col("before"))).select(_BUCKET).collect()]

    def forget(self, keep: int = 1) -> list[str]:
        """Deletes the manifests but for the last keep, and folders that none of these names; the folders that went."""
        at, files = self._files()
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        numbers = sorted(int(n[: -len(".json")]) for f in files.listStatus(at) if (n := f.getPath().getName()).endswith(".json"))
        stay = {f for n in numbers[-keep:] for f in self._manifest(n).values()}
        gone = sorted({f for n in numbers[:-keep] for f in self._manifest(n).values()} - stay)
        for n in numbers[:-keep]:
            files.delete(hadoop(f"{self.path}/manifests/{n}.json"), False)
        for f in gone:
            files.delete(hadoop(f), True)
        return gone
