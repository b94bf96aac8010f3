"""The tables of a directory as an evidence graph, and the registry of queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import fixed
from loomgraph.shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Experiment types by line number.
EXPERIMENTS = {1: "positional cloning", 2: "Genome Editing", 3: "gwas", 4: "expression analysis", 5: "morpholino knockdown and a new assay", 6: "variant calling and genome editing", 7: "phenotype description"}


PREDICATES = list(fixed.SHAPES)


def predicate_of(trait: Column, gene: Column) -> Column:
    """The predicate of a claim; all of them occur, and most of them with each trait."""
    return F.element_at(F.array(*map(F.lit, PREDICATES)), ((trait + gene) % len(PREDICATES) + 1).cast("int"))


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


class Graph:
    """Parts as traits, suppliers as genes, orders as papers and line items as evidence."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = ship(spark), sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def evidence(self) -> DataFrame:
        q = F.col("l_quantity")
        rank = F.lit(0)
        for least, value in ((2, 5), (4, 10), (8, 20), (14, 30), (22, 40), (32, 50), (40, 60), (45, 70)):
            rank = F.when(q >= least, value).otherwise(rank)
        kind = F.element_at(F.array(*(F.lit(x) for x in EXPERIMENTS.values())), F.col("l_linenumber"))
        return self.read("lineitem").select(
            F.col("l_partkey").alias("trait_id"), F.col("l_suppkey").alias("gene_id"), F.col("l_orderkey").alias("paper_id"),
            F.col("l_linenumber").alias("experiment_no"), kind.alias("experiment_type"), rank.alias("level_rank"),
            F.when(F.col("l_returnflag") == "R", "CONTRADICTS").otherwise("SUPPORTS").alias("stance"),
            (F.col("l_linestatus") == "F").cast("int").alias("species_is_target"),
        )

    @cached_property
    def trait(self) -> DataFrame:
        p = F.col("p_partkey")
        return self.read("part").select(
            p.alias("trait_id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.col("p_brand").alias("phenotype"),
            (p % 10 == 0).cast("int").alias("is_composite"), (F.col("p_size") % 24 + 1).alias("trait_chromosome"),
        )

    @cached_property
    def subsumes(self) -> DataFrame:
        """Small parts hang under the one before them, so components are chains of any length."""
        p = F.col("p_partkey")
        return self.read("part").where("p_size <= 12 AND p_partkey > 0").select((p - 1).alias("subject_id"), p.alias("object_id"))

    @cached_property
    def gene(self) -> DataFrame:
        return self.read("supplier").select(F.col("s_suppkey").alias("gene_id"), F.col("s_name").alias("name"), (F.col("s_nationkey") % 24 + 1).alias("gene_chromosome"), F.col("s_nationkey").alias("mechanism_id"))

    @cached_property
    def mechanism(self) -> DataFrame:
        return self.read("nation").select(F.col("n_nationkey").alias("mechanism_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("anatomy_id"))

    @cached_property
    def anatomy(self) -> DataFrame:
        return self.read("region").select(F.col("r_regionkey").alias("anatomy_id"), F.col("r_name").alias("name"))

    @cached_property
    def paper(self) -> DataFrame:
        state = F.when(F.col("o_orderstatus") == "P", "DISCOVERED").when(F.col("o_orderstatus") == "O", "FULLTEXT_AVAILABLE").otherwise("ACCEPTED")
        return self.read("orders").select(F.col("o_orderkey").alias("paper_id"), F.year("o_orderdate").alias("pub_year"), F.col("o_orderpriority").alias("journal"), state.alias("state"))

    @cached_property
    def claim(self) -> DataFrame:
        """One row per (trait, gene): counts of stances and the strongest support."""
        from loomgraph.operators.claims import summarise

        return summarise(self.evidence, ["trait_id", "gene_id"]).withColumn("predicate", predicate_of(F.col("trait_id"), F.col("gene_id")))


_WHEN = "CASE l_linenumber " + " ".join(f"WHEN {n} THEN '{x}'" for n, x in EXPERIMENTS.items()) + " END"
#: The same tables in SQL; a query's SQL starts with them.
TABLES = {
    "evidence": f"""SELECT l_partkey AS trait_id, l_suppkey AS gene_id, l_orderkey AS paper_id, l_linenumber AS experiment_no, {_WHEN} AS experiment_type,
  CASE WHEN l_quantity >= 45 THEN 70 WHEN l_quantity >= 40 THEN 60 WHEN l_quantity >= 32 THEN 50 WHEN l_quantity >= 22 THEN 40
       WHEN l_quantity >= 14 THEN 30 WHEN l_quantity >= 8 THEN 20 WHEN l_quantity >= 4 THEN 10 WHEN l_quantity >= 2 THEN 5 ELSE 0 END AS level_rank,
  CASE WHEN l_returnflag = 'R' THEN 'CONTRADICTS' ELSE 'SUPPORTS' END AS stance, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS species_is_target
  FROM lineitem""",
    "trait": """SELECT p_partkey AS trait_id, p_name AS name, p_type AS category, p_brand AS phenotype,
  CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE 0 END AS is_composite, p_size % 24 + 1 AS trait_chromosome FROM part""",
    "subsumes": "SELECT p_partkey - 1 AS subject_id, p_partkey AS object_id FROM part WHERE p_size <= 12 AND p_partkey > 0",
    "gene": "SELECT s_suppkey AS gene_id, s_name AS name, s_nationkey % 24 + 1 AS gene_chromosome, s_nationkey AS mechanism_id FROM supplier",
    "mechanism": "SELECT n_nationkey AS mechanism_id, n_name AS name, n_regionkey AS anatomy_id FROM nation",
    "anatomy": "SELECT r_regionkey AS anatomy_id, r_name AS name FROM region",
    "paper": """SELECT o_orderkey AS paper_id, year(o_orderdate) AS pub_year, o_orderpriority AS journal,
  CASE o_orderstatus WHEN 'P' THEN 'DISCOVERED' WHEN 'O' THEN 'FULLTEXT_AVAILABLE' ELSE 'ACCEPTED' END AS state FROM orders""",
    "claim": f"""SELECT trait_id, gene_id, {sql_list(PREDICATES)}[((trait_id + gene_id) % {len(PREDICATES)} + 1)::INT] AS predicate, count(*) AS n_evidence, count(*) FILTER (WHERE level_rank = 0) AS n_unknown, count(*) FILTER (WHERE stance = 'SUPPORTS') AS n_supports,
  count(*) FILTER (WHERE stance = 'CONTRADICTS') AS n_contradicts,
  coalesce(max(CASE WHEN stance = 'SUPPORTS' THEN level_rank END), 0) AS best_rank FROM evidence GROUP BY trait_id, gene_id""",
}
#: First come, first kept over two keys, in rounds: what comes first of its open rows by both keys is kept.
GREEDY = """
  rounds AS (SELECT n, i, t, false AS kept FROM ordered UNION ALL
    SELECT n, i, t, now FROM (SELECT *, bool_or(now) OVER (PARTITION BY i) AS by_i, t IS NOT NULL AND bool_or(now) OVER (PARTITION BY t) AS by_t FROM (
      SELECT n, i, t, n = min(n) OVER (PARTITION BY i) AND (t IS NULL OR n = min(n) OVER (PARTITION BY t)) AS now FROM rounds WHERE NOT kept)) WHERE now OR NOT (by_i OR by_t)),
  chosen AS (SELECT n, i, t FROM rounds WHERE kept),
  merged AS (SELECT o.n, CASE WHEN a.n <= o.n THEN a.n ELSE b.n END AS keeper FROM ordered o LEFT JOIN chosen a ON a.i = o.i LEFT JOIN chosen b ON b.t = o.t),
  standing AS (SELECT keeper AS n, count(*) AS routes FROM merged GROUP BY keeper)"""
PRELUDE = "WITH RECURSIVE " + ", ".join(f"{name} AS ({sql})" for name, sql in TABLES.items())


def query(sql: str | None = None, plain: bool = False):
    """Registers a function of a Graph under its name; sql follows the tables above unless plain."""

    def register(f: Callable[[Graph], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Graph(spark, sf_dir))
        if sql is not None:
            text = sql.strip()
            if not plain:
                text = f"{PRELUDE}, {text[4:].lstrip()}" if text.upper().startswith("WITH") else f"{PRELUDE} {text}"
            ORACLES[f.__name__] = text
        return f

    return register
