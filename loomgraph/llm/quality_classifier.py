"""Quality classifier: histogram gradient-boosted trees over statistics of the document."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import boosting
from loomgraph.llm.arrays import by_slices, trimmed
from loomgraph.llm.labelled import SAMPLE_ROWS, features, id_remainder, sampled_features
from loomgraph.llm.session import free_name, prepare
from loomgraph.llm.statistics import COLUMNS, all_arrays

#: A document is good from this score on.
GOOD = 0.7


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fold: Column | None = None, rows: int = SAMPLE_ROWS) -> boosting.Forest:
    """Fits the trees on at most rows labelled documents.

    Null ids and labels are left out; an id that labels repeat counts once, with its
    smallest label. Without both classes the trees give the share of label 1.
    """
    prepare(docs.sparkSession)
    return boosting.fit(*sampled_features(docs, labels, id_col, text_col, label_col, fold, rows))


def score(docs: DataFrame, model: boosting.Forest, text_col: str = "text", keep: list[str] | None = None, score_col: str = "score") -> DataFrame:
    """The columns in keep (all of docs if None) and the score of each row's whole text.

    A null or empty text is scored by its zero statistics. Every row gives one row,
    repeated ones too. A column of docs named like the score is replaced.
    """
    prepare(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c != score_col]
    inner = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").cast("string").alias(free_name("__text", keep)))

    def make(raw, offsets):
        return [model.probability(features(dict(zip(COLUMNS, all_arrays(raw, offsets), strict=True))))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([*list(batch.schema)[:-1], pa.field(score_col, pa.float64())])
            yield from by_slices(make, schema)(iter([batch]))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[:-1])
    return inner.mapInArrow(trimmed(run), f"{fields}{', ' * bool(fields)}`{score_col}` double")


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = id_remainder(F.col("doc_id"), 4) == 2
    model = train(docs, labels, fold=~held)
    scored = score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: boosting.Forest, text_col: str = "text", least: float = GOOD) -> DataFrame:
    """The rows whose text scores at least least, columns unchanged. Null and empty texts score by their zero statistics."""
    name = free_name("__score", docs.columns)
    kept = score(docs, model, text_col, keep=docs.columns, score_col=name)
    return kept.where(F.col(name) >= least).select(*(F.col(f"`{c}`") for c in docs.columns))
