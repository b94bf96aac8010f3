"""Bounded, repeatable samples of labelled rows, and the statistics that classifiers take from them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.statistics import COLUMNS, with_statistics

#: At most so many labelled rows train a model (the documented bound of the fit).
SAMPLE_ROWS = 20_000


def id_remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo: splits labelled rows into folds."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(modulus)


def label_rows(labels: DataFrame, id_col: str, label_col: str, fold: Column | None) -> DataFrame:
    """(id, label) of what fold admits; one per id, the smallest label on ties."""
    picked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if fold is not None:
        picked = picked.where(fold)
    return picked.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("label"))


def label_sample(labels: DataFrame, id_col: str, label_col: str, fold: Column | None, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The label_rows with the smallest hashes."""
    return label_rows(labels, id_col, label_col, fold).orderBy(F.xxhash64("id"), "id").limit(rows)


def labelled_statistics(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fold: Column | None) -> DataFrame:
    """(id, label, statistics...) of every labelled document, a row for each id.

    Texts stay where they are read, and only their statistics meet the labels. Ids that
    repeat are taken as in a sample.
    """
    marks = label_rows(labels, id_col, label_col, fold)
    stats = with_statistics(docs, id_col, text_col).groupBy("id").agg(F.min(F.struct(*COLUMNS)).alias("least")).select("id", "least.*")
    return marks.join(stats, "id")


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """A row of ratios for each document; never its id, language, source or label."""
    s = {k: np.asarray(v, np.float64) for k, v in stats.items()}
    words, chars, lines = (np.maximum(s[c], 1) for c in ("n_words", "n_chars", "n_lines"))
    return np.column_stack(
        [
            np.log1p(s["n_words"]),
            s["word_chars"] / words,
            s["n_symbols"] / chars,
            s["n_dup_lines"] / lines,
            s["n_repeat_words"] / words,
            s["n_upper"] / chars,
            s["n_digits"] / chars,
            s["n_marks"] / words,
            s["n_stops"] / words,
            np.log1p(words / lines),
            s["n_distinct"] / words,
            s["top_word"] / words,
            s["long_words"] / words,
            s["n_wide"] / chars,
        ]
    )


def sampled_features(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fold: Column | None, rows: int = SAMPLE_ROWS
) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the sample, in the order of ids; at most rows ids reach the driver, and one document of each.

    Of documents that share a labelled id, the one with the smallest statistics, in
    the order of their columns, is taken whole.
    """
    sample = label_sample(labels, id_col, label_col, fold, rows)
    # the sample has a proven bound, so it is broadcast and the scan of documents stays in place
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample.select("id")), "id")
    stats = with_statistics(texts, "id", "text").groupBy("id").agg(F.min(F.struct(*COLUMNS)).alias("least")).select("id", "least.*")
    got = stats.join(F.broadcast(sample), "id").orderBy("id").toPandas()
    return features({c: got[c].to_numpy() for c in COLUMNS}), got["label"].to_numpy(np.float64)
