"""Readers and writers: seed files, tables of text, caches, exports, dossiers, and plug-in data sources."""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomgraph.functions.text import slugify
from loomgraph.operators.storage import written
from loomgraph.shipping import ship

SEED_KEYS = {"papers", "entities", "claims"}
EVIDENCE_SCHEMA = (
    "file string, predicate string, subject_label string, subject_name string, object_label string, object_name string, paper string, experiment_type string, "
    "level string, stance string, finding string, quote string, species string, species_explicit boolean"
)
ENTITY_SCHEMA = "file string, label string, name string, category string, symbol string, chromosome string, best_p_value string, aliases array<string>"
PAPER_SCHEMA = "file string, key string, title string, year int, doi string, pmid string, pmcid string"


def _text(value) -> str | None:
    """Numbers that were written as such stay the text that was reported."""
    return None if value is None else value if isinstance(value, str) else repr(value)


def seed_rows(name: str, text: str, load: Callable[[str], object]) -> tuple[list, list, list, list[str]]:
    """Papers, entities and evidence rows of one seed file, and what is wrong with it; load parses its text."""
    problems: list[str] = []
    try:
        data = load(text)
    except Exception as e:
        return [], [], [], [f"{name}: {e}"]
    if data is None:
        data = {}
    if not isinstance(data, dict):
        return [], [], [], [f"{name}: the top level must be a mapping"]
    problems += [f"{name}: unknown key {k!r}" for k in sorted(set(data) - SEED_KEYS)]
    papers = [(name, p.get("key"), p.get("title"), p.get("year"), p.get("doi"), _text(p.get("pmid")), p.get("pmcid")) for p in data.get("papers") or []]
    entities = [(name, e.get("label"), e.get("name"), e.get("category"), e.get("symbol"), _text(e.get("chromosome")), _text(e.get("best_p_value")), e.get("aliases") or []) for e in data.get("entities") or []]
    evidence = []
    for c in data.get("claims") or []:
        s, o = c.get("subject") or {}, c.get("object") or {}
        for e in c.get("evidence") or []:
            # whether the species was written is kept apart from its default
            evidence.append((name, c.get("predicate"), s.get("label"), s.get("name"), o.get("label"), o.get("name"), e.get("paper"), e.get("experiment_type"), e.get("level", "UNKNOWN"), e.get("stance", "SUPPORTS"), e.get("finding"), e.get("quote"), e.get("species", "Oryzias latipes"), "species" in e))
    return papers, entities, evidence, problems


def read_seeds(spark: SparkSession, path: str, load: Callable[[str], object] | None = None) -> dict[str, DataFrame]:
    """papers, entities, evidence and problems of all seed files under a path, parsed where they are read; problems of every file are kept.

    load parses a file's text: YAML where a parser is installed, else JSON, which is a subset of it.
    """
    if load is None:
        try:
            from yaml import safe_load as load
        except ImportError:
            load = json.loads
    schemas = {"papers": PAPER_SCHEMA, "entities": ENTITY_SCHEMA, "evidence": EVIDENCE_SCHEMA, "problems": "problem string"}
    fields = {kind: [f.split()[0] for f in ddl.split(", ")] for kind, ddl in schemas.items()}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, text in zip(b.column("file").to_pylist(), b.column("value").to_pylist(), strict=True):
                papers, entities, evidence, problems = seed_rows(name, text, load)
                rows = {"papers": papers, "entities": entities, "evidence": evidence, "problems": [(p,) for p in problems]}
                told = [(kind, json.dumps(dict(zip(fields[kind], row, strict=True)))) for kind in rows for row in rows[kind]]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in told], pa.string()), pa.array([v for _, v in told], pa.string())], names=["kind", "value"])

    files = ship(spark).read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    # files are parsed once for all four tables
    told = written(files.mapInArrow(parse, "kind string, value string"))
    return {kind: told.where(F.col("kind") == kind).select(F.from_json("value", ddl).alias("r")).select("r.*") for kind, ddl in schemas.items()}


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated rows with a header; values trimmed, absent ones empty."""
    rows = spark.read.csv(path, sep="\t", header=True, quote="")
    return rows.select(*(F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in rows.columns))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated rows with a header, with or without a byte-order mark."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return rows.toDF(*(c.removeprefix("﻿") for c in rows.columns))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(term, id) of a JSON store of stable ids, one object; none where there is no store yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "term string, id string")
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("term", "id"))


def write_ids(rows: DataFrame, path: str) -> None:
    """(term, id) as one JSON object, terms in order; the store is a vocabulary, small enough for one file."""
    rows = rows.coalesce(1).agg(F.array_sort(F.collect_list(F.struct("term", "id"))).alias("all"))
    rows.select(F.to_json(F.map_from_entries("all")).alias("value")).write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str, order: str) -> None:
    """All values quoted, in order."""
    rows.orderBy(order).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def write_lines(rows: DataFrame, path: str) -> None:
    """A JSON object on each line of (value)."""
    rows.select("value").write.mode("overwrite").text(path)


def write_dossiers(rows: DataFrame, path: str) -> None:
    """Texts of (name, dossier) in a folder for each slug."""
    rows.select(slugify(F.col("name")).alias("slug"), F.col("dossier").alias("value")).write.mode("overwrite").partitionBy("slug").text(path)


def missing_from_cache(wanted: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """What has still to be fetched: no cached file, or an empty one."""
    return wanted.join(cached.where(F.length("body") > 0).select(key), key, "left_anti")


class PagedSource(DataSource):
    """Rows that a paged backend gives for each seed: spark.read.format("paged").

    Options: seeds (separated by commas, a partition each), pageSize, interval (least
    seconds between the requests of a partition), and where pages come from: fixture, a
    JSON Lines file of {"seed", "page", "hitCount", "rows"} that executors can reach,
    or url, a template with {seed}, {page} and {size} that answers with the last two.
    Pages are asked for until hitCount rows are in hand or a page is empty.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "seed string, page int, value string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.seeds = [s for s in options.get("seeds", "").split(",") if s]
        self.size, self.interval = int(options.get("pageSize", "1000")), float(options.get("interval", "0.34"))
        self.fixture, self.url = options.get("fixture"), options.get("url")
        if bool(self.fixture) == bool(self.url):
            raise ValueError("give either fixture or url")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(s) for s in self.seeds]

    def _pages(self, seed: str) -> Callable[[int], dict]:
        if self.url:
            def ask(page: int) -> dict:
                with urllib.request.urlopen(self.url.format(seed=urllib.parse.quote(seed), page=page, size=self.size), timeout=60) as r:
                    return json.load(r)

            return ask
        path = self.fixture if "://" in self.fixture else "file://" + self.fixture.removeprefix("file:")
        fs, inner = pafs.FileSystem.from_uri(path)
        with fs.open_input_file(inner) as f:
            held = {r["page"]: r for r in map(json.loads, f.read().decode().splitlines()) if r["seed"] == seed}
        return lambda page: held.get(page, {})

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        ask, n, page, last = self._pages(partition.value), 0, 1, 0.0
        while True:
            if self.url:
                time.sleep(max(0.0, last + self.interval - time.monotonic()))
                last = time.monotonic()
            body = ask(page)
            rows = body.get("rows") or []
            for row in rows:
                yield partition.value, page, json.dumps(row)
            n += len(rows)
            if not rows or n >= int(body.get("hitCount") or 0):
                return
            page += 1


def write_report(spark: SparkSession, parts: dict[str, DataFrame], path: str) -> None:
    """One JSON object: how many rows each part of a run has, and the rows of parts that are a single row."""
    report = {}
    for name, rows in parts.items():
        head = rows.limit(2).collect()
        report[name] = head[0].asDict(recursive=True) if len(head) == 1 else rows.count()
    spark.createDataFrame([(json.dumps(report, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def markdown_pivot(rows: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """(position, line): counts by row and column as a Markdown table with totals; values are the columns in order."""
    counts = rows.rollup(row).agg(*(F.count_if(F.col(column) == v).alias(f"__{k}") for k, v in enumerate(values)), F.count(F.lit(1)).alias("__all"), F.grouping(row).alias("__total"))
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", F.when(F.col("__total") == 1, "total").otherwise(F.coalesce(F.col(row).cast("string"), F.lit(""))), *(F.col(f"__{k}").cast("string") for k in range(len(values))), F.col("__all").cast("string")), F.lit(" |"))
    body = counts.select((F.row_number().over(Window.orderBy("__total", row)) + 2).alias("position"), cells.alias("line"))
    head = rows.sparkSession.createDataFrame([(1, f"| {row} | {' | '.join(values)} | total |"), (2, "|---" * (len(values) + 2) + "|")], "position int, line string")
    return head.unionByName(body)


#: Fields of a literature search hit.
HIT_SCHEMA = (
    "title string, doi string, pmid string, pmcid string, pubYear string, journalInfo struct<journal:struct<title:string>>, isOpenAccess string, inEPMC string, "
    "fullTextUrlList struct<fullTextUrl:array<struct<availabilityCode:string>>>, authorList struct<author:array<struct<fullName:string>>>, abstractText string"
)


def parse_hits(lines: DataFrame, column: str = "value") -> DataFrame:
    """Papers from search hits in JSON."""
    h = F.from_json(F.col(column), HIT_SCHEMA)
    codes = F.transform(h["fullTextUrlList"]["fullTextUrl"], lambda u: u["availabilityCode"])
    names = F.filter(F.transform(h["authorList"]["author"], lambda a: a["fullName"]), lambda n: F.coalesce(n, F.lit("")) != "")
    return lines.select(
        F.regexp_replace(h["title"], r"\.+$", "").alias("title"), h["doi"].alias("doi"), h["pmid"].alias("pmid"), h["pmcid"].alias("pmcid"), h["pubYear"].try_cast("int").alias("year"),
        h["journalInfo"]["journal"]["title"].alias("journal"), (F.coalesce(h["isOpenAccess"] == "Y", F.lit(False)) | F.coalesce(F.array_contains(codes, "OA"), F.lit(False))).alias("is_open_access"),
        F.coalesce(names, F.array().cast("array<string>")).alias("authors"), h["abstractText"].alias("abstract"),
    ).where(F.coalesce("doi", "pmid", "pmcid").isNotNull())
