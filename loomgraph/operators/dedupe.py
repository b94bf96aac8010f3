"""First come, first kept: rows that share an id or a title with an earlier kept row merge into it.

What a merged row adds is not known later on, so the result depends on the order and is
not transitive.  It is found in rounds: a row that comes first among the undecided rows
of its id and of its title is kept, for nothing that is open can decide about it; rows
that share an id or title with it are decided too.  Each side of a round is an
aggregate by one key, so that no key, however common, and no connected block of rows
meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.storage import written

#: So few undecided rows are walked in order by one task, as a long chain of conflicts takes a round for every two of its rows.
FEW = 50_000


def _walked(rows: DataFrame) -> DataFrame:
    """(i, t) of the rows that are kept of few (n, i, t), one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, titles, kept = set(), set(), []
        for b in batches:
            for i, t in zip(b.column("i").to_pylist(), b.column("t").to_pylist(), strict=True):
                if i not in ids and (t is None or t not in titles):
                    ids.add(i)
                    titles.add(t)
                    kept.append((i, t))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in kept], pa.string()) for k in (0, 1)], names=["i", "t"])

    return rows.repartition(1).sortWithinPartitions("n").select("i", "t").mapInArrow(run, "i string, t string")


def kept_places(rows: DataFrame, few: int = FEW) -> DataFrame:
    """(n, i, t) of the rows that are kept of (n, i, t): places in an order, ids, and titles or null."""
    # of rows with one id and one title only the first can be kept
    left = written(rows.groupBy("i", "t").agg(F.min("n").alias("n")).select("n", "i", "t"))
    kept = []
    while (open_rows := left.count()) > few:
        first = left.groupBy("i").agg(F.min(F.struct("n", "t")).alias("first")).select("first.n", "i", "first.t")
        ahead = left.where("t IS NOT NULL").groupBy("t").agg(F.min("n").alias("ahead"))
        sure = written(first.join(ahead, "t", "left").where("t IS NULL OR n = ahead").select("n", "i", "t"))
        kept.append(sure)
        left = written(left.join(sure.select("i"), "i", "left_anti").join(sure.select("t").where("t IS NOT NULL"), "t", "left_anti").select("n", "i", "t"))
    if open_rows:
        one = _walked(left).withColumnsRenamed({"i": "__i", "t": "__t"})
        kept.append(written(left.join(one, (F.col("i") == F.col("__i")) & F.col("t").eqNullSafe(F.col("__t")), "left_semi")))
    out = kept[0] if kept else left
    for part in kept[1:]:
        out = out.unionByName(part)
    return out


def first_kept(rows: DataFrame, order: list[Column], ids: list[str], title: Column, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """The kept rows, and (__n, __keeper) of all rows: the place of each in the order (a struct) and that of the kept row it merged into, its own for kept ones.

    Order is ascending, nulls first. Rows that stand alike in it go by ids and title;
    of rows that agree in all of this one is kept. Ids may be null, and are alike then;
    null and empty titles are no titles and merge nothing.
    """
    at = rows.withColumn("__i", F.to_json(F.struct(*ids), {"ignoreNullFields": "false"})).withColumn("__t", F.when(title != "", title))
    at = written(at.withColumn("__n", F.struct(*(o.alias(f"o{k}") for k, o in enumerate(order)), F.col("__i").alias("i"), F.col("__t").alias("t"))))
    found = kept_places(at.select(F.col("__n").alias("n"), F.col("__i").alias("i"), F.col("__t").alias("t")), few)
    kept = at.join(found.select(F.col("n").alias("__n")), "__n", "left_semi").dropDuplicates(["__n"]).drop("__i", "__t")
    by_id, by_title = (found.where(f"{c} IS NOT NULL").select(F.col(c).alias(f"__{c}"), F.col("n").alias(f"__by_{c}")) for c in "it")
    told = at.select("__n", "__i", "__t").join(by_id, "__i", "left").join(by_title, "__t", "left")
    keeper = F.when(F.col("__by_i") <= F.col("__n"), F.col("__by_i")).otherwise(F.col("__by_t"))
    return kept, told.select("__n", keeper.alias("__keeper"))


def with_routes(rows: DataFrame, order: list[Column], ids: list[str], title: Column, few: int = FEW) -> DataFrame:
    """The kept rows with routes, how many rows each stands for."""
    kept, told = first_kept(rows, order, ids, title, few)
    return kept.join(told.groupBy(F.col("__keeper").alias("__n")).agg(F.count(F.lit(1)).alias("routes")), "__n").drop("__n")
