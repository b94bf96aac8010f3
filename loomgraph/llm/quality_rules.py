"""Quality rules: fixed rules, then an isolation forest over the rule statistics.

Trees split the documents labelled good at random values; all of them are counted in
every tree. A document that few splits set apart from them is an anomaly; from which
score on it is dropped is calibrated on all labelled good rows, each scored as if the
trees had not seen it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.arrays import by_slices, trimmed
from loomgraph.llm.labelled import features, labelled_statistics
from loomgraph.llm.session import discard, prepare, written
from loomgraph.llm.statistics import BASE, COLUMNS, all_arrays

TREES, DEPTH = 128, 8
#: Of the labelled good documents, at most this share may be dropped by the calibrated threshold.
GOOD_LOSS = 0.002
#: Fixed rules: fewer words, or a larger percentage of words in repeated windows, fail.
FEWEST_WORDS, MOST_REPEATED = 20, 30
#: Columns of features() that the forest splits on: all but the length.
SHAPE = slice(1, None)


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n keys."""
    n = np.asarray(n, np.float64)
    m = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(m - 1) + 0.5772156649015329) - 2 * (m - 1) / m, np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Isolation:
    """Random trees in heap order: feature and threshold of inner nodes, path length of leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    path: np.ndarray
    scale: float
    limit: float

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        """0 to 1: two to the minus mean path length over the expected one."""
        total = self.path[np.arange(len(self.feature)), leaves(self.feature, self.threshold, x)].mean(axis=1)
        return np.exp2(-total / self.scale)


def draw(bounds: tuple[np.ndarray, np.ndarray], trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Feature and threshold of the inner nodes of whole trees.

    A split is drawn over the whole room of its node within bounds, not just over
    the node's rows: a statistic that is constant in the rows can still set others apart.
    """
    rng = np.random.default_rng(seed)
    inner = 2**depth - 1
    feature, threshold = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    for t in range(trees):
        held = {0: bounds}
        for node in range(inner):
            low, high = held.pop(node)
            below, above = high, low
            wide = np.flatnonzero(low < high)
            if len(wide):
                f = int(rng.choice(wide))
                cut = rng.uniform(low[f], high[f])
                feature[t, node], threshold[t, node] = f, cut
                below, above = high.copy(), low.copy()
                below[f] = above[f] = cut
            held[2 * node + 1], held[2 * node + 2] = (low, below), (above, high)
    return feature, threshold


def leaves(feature: np.ndarray, threshold: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The leaf of each row in each tree."""
    trees, inner = feature.shape
    tree, row = np.arange(trees), np.arange(len(x))[:, None]
    node = np.zeros((len(x), trees), np.int64)
    for _ in range((inner + 1).bit_length() - 1):
        node = 2 * node + 1 + (x[row, feature[tree, node]] > threshold[tree, node])
    return node - inner


def leaf_counts(feature: np.ndarray, threshold: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many rows lie in each leaf of each tree."""
    trees, wide = len(feature), feature.shape[1] + 1
    at = leaves(feature, threshold, x) + wide * np.arange(trees)
    return np.bincount(at.ravel(), minlength=trees * wide).reshape(trees, wide)


def weighed(feature: np.ndarray, threshold: np.ndarray, counts: np.ndarray, subsample: int | None = None, left_out: int = 0) -> Isolation:
    """The forest whose leaves hold counts of all rows.

    A tree ends where no more than one row is left; with subsample, where no more than one
    of so many rows is expected. Without rows, a forest that finds nothing odd. With
    left_out 1, each counted row finds the paths of a forest that has not seen it: trees
    are drawn without looking at rows, so that it is only missing from the nodes it is in.
    """
    trees, wide = counts.shape
    depth, n = wide.bit_length() - 1, max(int(counts[0].sum()) - left_out, 0)
    size = n if subsample is None else min(subsample, n)
    # whole numbers of rows, or expected ones between them
    usual = _average_path if size == n else lambda m: np.interp(m, np.arange(size + 1), _average_path(np.arange(size + 1)))
    path, going = np.zeros((trees, wide)), np.ones((trees, wide), bool)
    for level in range(depth + 1):
        at = np.arange(wide) >> (depth - level)
        mass = np.maximum(counts.reshape(trees, 2**level, -1).sum(axis=2) - left_out, 0)[:, at] * (size / max(n, 1))
        path = np.where(going, level + usual(mass), path)
        if level < depth:
            going &= (mass > 1) & np.isfinite(threshold[:, at + 2**level - 1])
    return Isolation(feature, threshold, path, float(max(_average_path(size), 1.0)), np.inf)


def isolate(x: np.ndarray, bounds: tuple[np.ndarray, np.ndarray], trees: int = TREES, subsample: int | None = None, depth: int = DEPTH, seed: int = 7) -> Isolation:
    """The forest over rows at hand."""
    feature, threshold = draw(bounds, trees, depth, seed)
    return weighed(feature, threshold, leaf_counts(feature, threshold, x), subsample)


def calibrate(forest: Isolation, x: np.ndarray, label: np.ndarray, good_loss: float = GOOD_LOSS) -> Isolation:
    """Sets the limit by rows at hand: the lowest score that drops at most good_loss of label 1. Without label 1 there is nothing to hold it against, and nothing is dropped."""
    good = np.sort(forest.anomaly(x[label == 1])) if len(x) else np.zeros(0)
    limit = float(good[-1 - int(good_loss * len(good))]) if len(good) else np.inf
    return Isolation(forest.feature, forest.threshold, forest.path, forest.scale, limit)


def _shapes(b: pa.RecordBatch) -> np.ndarray:
    """What the forest splits on, of a batch that has the columns of the statistics."""
    return features({c: np.asarray(b.column(c)) for c in COLUMNS})[:, SHAPE]


def _bounds(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest of each feature over all rows; empty without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _shapes(b)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(x.shape[1])), pa.array(x.min(0)), pa.array(x.max(0))], names=["f", "low", "high"])

    found = rows.mapInArrow(trimmed(run), "f long, low double, high double").groupBy("f").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("f").toPandas()
    return found["low"].to_numpy(), found["high"].to_numpy()


def _counted(rows: DataFrame, feature: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """leaf_counts over all rows: each task sums its own, and at most a number for each leaf reaches the driver."""
    trees, wide = len(feature), feature.shape[1] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(trees * wide, np.int64)
        for b in batches:
            if b.num_rows:
                total += leaf_counts(feature, threshold, _shapes(b)).ravel()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["leaf", "n"])

    found = rows.mapInArrow(trimmed(run), "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(trees * wide, np.int64)
    out[found["leaf"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out.reshape(trees, wide)


def from_top(rows: DataFrame, column: str, place: int, bins: int = 1024) -> float:
    """The value that place others precede in falling order: bins are counted, and the one with that place is cut again until it holds one value."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while low < high:
        at = F.least(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(bins - 1))
        counts = rows.where(F.col(column).between(low, high)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for r in sorted(counts, key=lambda r: -r["bin"]):
            if place < r["n"]:
                low, high = r["low"], r["high"]
                break
            place -= r["n"]
    return low


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fold: Column | None = None, good_loss: float = GOOD_LOSS) -> Isolation:
    """Fits trees and limit on all labelled documents: the trees on the good ones, the limit on each of these as if the trees had not seen it.

    Null ids and labels are left out; an id that labels repeat counts once, with its
    smallest label.
    """
    prepare(docs.sparkSession)
    held = labelled_statistics(docs, labels, id_col, text_col, label_col, fold)
    # the fixed rules judge the others already
    rows = written(held.where((F.col("n_words") >= FEWEST_WORDS) & (100 * F.col("n_repeat_words") <= MOST_REPEATED * F.col("n_words"))), "rule-statistics")
    feature, threshold = draw(_bounds(rows))
    good = rows.where("label = 1")
    counts = _counted(good, feature, threshold)
    unseen = weighed(feature, threshold, counts, left_out=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(unseen.anomaly(_shapes(b)))], names=["anomaly"])

    n = int(counts[0].sum())
    scores = written(good.mapInArrow(trimmed(run), "anomaly double"), "rule-anomalies")
    limit = from_top(scores, "anomaly", int(good_loss * n)) if n else np.inf
    discard(rows, scores)
    return replace(weighed(feature, threshold, counts), limit=limit)


def judge(docs: DataFrame, model: Isolation, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the five base statistics, base_failed, anomaly and kept of every row's whole text.

    Null and empty texts have no words, so the base rules fail them. Ids pass as they
    are, null ones too; repeated rows are judged each.
    """
    prepare(docs.sparkSession)
    key = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("id", pa.int64()), *((c, pa.int64()) for c in BASE), ("anomaly", pa.float64())])

    def make(raw, offsets):
        stats = dict(zip(COLUMNS, all_arrays(raw, offsets), strict=True))
        return [*(stats[c] for c in BASE), model.anomaly(features(stats)[:, SHAPE])]

    out = key.mapInArrow(by_slices(make, schema), f"id long, {', '.join(f'{c} long' for c in BASE)}, anomaly double")
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= F.lit(float(model.limit)))).withColumnRenamed("id", id_col)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Base statistics and verdict of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = judge(docs, train(docs, labels))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")
