"""Full texts from a folder of cached files, read through: what is not there is asked for once and kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.extraction import jats_sections
from loomgraph.operators.storage import spread, written
from loomgraph.shipping import ship

#: Why a paper has no text (fixed values).
NO_PMCID, EMPTY, HTTP_ERROR, NOT_XML = "no PMCID", "empty response", "http error", "not well-formed XML"


def _at(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, and the folder in it; a path without a scheme is local."""
    if ":/" not in folder:
        folder = f"file://{folder}"
    elif folder.startswith("file:"):
        folder = "file:///" + folder.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(folder)


def cached(spark: SparkSession, folder: str) -> DataFrame:
    """(pmcid, body) of the files of a cache that hold something; none where there is no folder yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "pmcid string, body string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(folder)
    return files.where("length > 0").select(F.regexp_extract("path", r"([^/]+)\.xml$", 1).alias("pmcid"), F.col("content").cast("string").alias("body"))


def _through(folder: str, fetch: Callable[[str], str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Asks for each pmcid, and keeps what comes: put down beside its place and moved there, so that no half file is ever read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, home = _at(folder)
        fs.create_dir(home, recursive=True)
        for batch in batches:
            bodies, reasons = [], []
            for pmcid in batch.column("pmcid").to_pylist():
                try:
                    body, reason = fetch(pmcid), None
                except Exception as e:  # whatever a backend raises is told, not passed on: other papers go on
                    body, reason = None, f"{HTTP_ERROR}: {e}"
                if reason is None and not (body or "").strip():
                    body, reason = None, EMPTY
                if body is not None:
                    with fs.open_output_stream(f"{home}/{pmcid}.part") as f:
                        f.write(body.encode())
                    fs.move(f"{home}/{pmcid}.part", f"{home}/{pmcid}.xml")
                bodies.append(body)
                reasons.append(reason)
            yield pa.RecordBatch.from_arrays([batch.column("pmcid"), pa.array(bodies, pa.string()), pa.array(reasons, pa.string())], names=["pmcid", "body", "reason"])

    return run


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sections of each body, or null where it is no XML."""
    kind = pa.list_(pa.struct([("section_idx", pa.int32()), ("section", pa.string()), ("body", pa.string())]))
    for batch in batches:
        out = []
        for xml in batch.column("body").to_pylist():
            try:
                out.append(None if xml is None else [{"section_idx": i, "section": s, "body": b} for i, s, b in jats_sections(xml)])
            except ElementTree.ParseError:
                out.append(None)
        keep = [c for c in batch.schema.names if c != "body"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, kind)], names=[*keep, "sections"])


def acquire(papers: DataFrame, folder: str, fetch: Callable[[str], str]) -> DataFrame:
    """(paper_id, pmcid, source, reason, sections) of papers (paper_id, pmcid): each paper once, with its sections or the reason why it has none.

    Only papers whose file is missing or empty are asked for, by fetch on the executors,
    each pmcid once; source is cache or fetched. What is not well-formed stays in the
    cache and is told as such. Results are written, so that nothing is asked for twice.
    """
    spark = ship(papers.sparkSession)
    asked = papers.select("paper_id", F.when(F.trim("pmcid") != "", F.col("pmcid")).alias("pmcid"))
    held = written(cached(spark, folder).join(asked.select("pmcid").distinct(), "pmcid", "left_semi"))
    missing = written(asked.where("pmcid IS NOT NULL").select("pmcid").distinct().join(held.select("pmcid"), "pmcid", "left_anti"))
    fetched = written(spread(missing).mapInArrow(_through(folder, fetch), "pmcid string, body string, reason string"))
    texts = held.select("pmcid", "body", F.lit(None).cast("string").alias("reason"), F.lit("cache").alias("source")).unionByName(fetched.withColumn("source", F.lit("fetched")))
    parsed = spread(texts).select("pmcid", "reason", "source", "body").mapInArrow(_parsed, "pmcid string, reason string, source string, sections array<struct<section_idx:int,section:string,body:string>>")
    out = asked.join(parsed, "pmcid", "left")
    reason = F.when(F.col("pmcid").isNull(), NO_PMCID).when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("sections").isNull(), NOT_XML)
    return written(out.select("paper_id", "pmcid", F.when(F.col("reason").isNull(), F.col("source")).alias("source"), reason.alias("reason"), "sections"))


def put(rows: DataFrame, folder: str) -> None:
    """Files <pmcid>.xml of (pmcid, body), as another service would have them."""

    def run(part) -> None:
        fs, home = _at(folder)
        fs.create_dir(home, recursive=True)
        for row in part:
            with fs.open_output_stream(f"{home}/{row['pmcid']}.xml") as f:
                f.write((row["body"] or "").encode())

    ship(rows.sparkSession)
    rows.select("pmcid", "body").foreachPartition(run)


def from_folder(folder: str) -> Callable[[str], str]:
    """fetch() for acquire() that reads another folder; what is not there raises."""

    def fetch(pmcid: str) -> str:
        fs, home = _at(folder)
        with fs.open_input_file(f"{home}/{pmcid}.xml") as f:
            return f.read().decode()

    return fetch
