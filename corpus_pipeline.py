"""From raw documents to a training mix, in stages of the operators in loomgraph.llm.

Stages before the last leave the columns of documents as they are, extra ones
included, whatever their names.  No rows give no rows; what each stage makes of nulls,
empty texts and repeated rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontamination, mixing, ngram_join, quality_classifier, substring_dedup
from loomgraph.llm.session import discard_since, held_tables, read, written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null and empty texts score alike, so they stay or go together; ids are not looked at but to find labels."""
    return quality_classifier.keep_good(docs, quality_classifier.train(docs, read(spark, sf_dir, "labels")))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id. Texts without a word all stay; of repeated rows one does."""
    return ngram_join.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with passages that an earlier one (by id, null last) holds cut out; null texts stay null. n_chars is that of the text, where there is such a column."""
    out = substring_dedup.dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; items without a text match nothing."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document. Null sources are one source; null and empty texts have no words and nothing is taken of them."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("substring dedup", cut_repeated_passages),
    ("benchmark decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: SQL can't express the classifier; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each on what the one before has written; tables that are read no more are deleted."""
    docs, before = read(spark, sf_dir, "documents"), held_tables()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{k}")
            discard_since(spark, before, docs)
    return docs
