"""Commands over a directory of tables: python -m loomgraph COMMAND --data DIR."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import sources
from loomgraph.operators import crosses, phenotypes
from loomgraph.operators.storage import written
from loomgraph.plans import all as plans

#: Commands that show the rows of queries.
SHOWN = {
    "validate": ("Q17_T24_ceilings", "P07_shapes", "P09_label_checks", "P10_entity_checks", "Q17_J13_J14_P11_integrity", "P12_P13_species_rules", "Q21_gene_claim_violations", "A27_duplicate_keys"),
    "status": ("Q10_S03_A07_U01_graph_counts", "Q12_A08_state_counts"),
    "traits": ("Q04_J04_A01_W04_list_traits",),
    "review": ("Q05_A02_A12_W03_review_queue",),
    "disputed": ("Q06_disputed_claims",),
    "shared-genes": ("Q07_J06_J08_J09_A04_A05_shared_genes",),
    "search": ("Q09_W07_search",),
    "queries": ("Q24_G08_J11_J12_query_ladder",),
    "pipeline": ("Q26_A28_citation_screen", "Q29_A29_register_report", "Q27_J17_T14_candidates"),
    "papers": ("Q12_W06_X05_papers_in_states", "Q11_P06_W05_X06_unprocessed_papers"),
    "candidates": ("Q13_pending_candidates",),
    "proposed-genes": ("Q28_T19_new_symbols",),
}


def _cross(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    rules = crosses.seed_rules()
    if a.symbols:
        return spark.createDataFrame([(s, locus, wild) for s, (locus, wild) in sorted(rules.alleles.items())], "symbol string, locus string, wild boolean")
    if a.mother_shows or a.father_shows:
        if a.mother or a.father or not (a.mother_shows and a.father_shows):
            raise SystemExit("give both parents by genotype, or both by what they show")
        pair = phenotypes.one_pair(spark, set(a.mother_shows.split(",")), set(a.father_shows.split(",")), a.true_breeding)
        return phenotypes.range_documents(pair, rules) if a.json else phenotypes.ranges(pair, rules)
    if a.true_breeding or not (a.mother and a.father):
        raise SystemExit("give both parents; --true-breeding goes with what they show")
    table = crosses.cross_table(spark, rules, [("cross", a.mother, a.father)])
    return crosses.cross_json(table, rules, {t: min(r) for t, r in rules.ranks.items()}) if a.json else crosses.shares(crosses.classes(table, rules, "id"))


def _decide(spark: SparkSession, rows: DataFrame, ids: list[int], outcome: str) -> DataFrame:
    """Pending candidates among ids with their outcome; others are refused."""
    asked = spark.createDataFrame([(i,) for i in ids], "id long")
    told = asked.join(rows.select("id", F.lit(outcome).alias("outcome")), "id", "left")
    return told.select("id", F.coalesce("outcome", F.lit("refused: not pending")).alias("outcome"))


def main(argv: list[str]) -> None:
    p = argparse.ArgumentParser(prog="loomgraph", description=__doc__)
    p.add_argument("command", choices=[*SHOWN, "init", "load", "dossier", "dossier-all", "accept", "reject", "export", "cross"])
    p.add_argument("--data", default=".")
    p.add_argument("--out")
    p.add_argument("--id", type=int, action="append", default=[])
    p.add_argument("--limit", type=int, default=20)
    for name in ("mother", "father", "mother-shows", "father-shows", "seeds"):
        p.add_argument(f"--{name}")
    for name in ("json", "symbols", "true-breeding"):
        p.add_argument(f"--{name}", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("loomgraph").getOrCreate()
    if a.command in SHOWN:
        for name in SHOWN[a.command]:
            print(name)
            plans.QUERIES[name](spark, a.data).show(a.limit, truncate=False)
        if a.out:
            sources.write_report(spark, {name: plans.QUERIES[name](spark, a.data) for name in SHOWN[a.command]}, a.out)
    elif a.command == "init":
        # tables are Parquet: constraints are checked, not declared
        plans.QUERIES["K11_uniqueness"](spark, a.data).show()
    elif a.command == "load":
        found = sources.read_seeds(spark, a.seeds)
        if found["problems"].count():
            found["problems"].show(truncate=False)
            raise SystemExit(1)
        for name in ("papers", "entities", "evidence"):
            found[name].write.mode("overwrite").parquet(f"{a.out}/{name}.parquet")
        print(json.dumps({name: found[name].count() for name in ("papers", "entities", "evidence")}))
    elif a.command in ("dossier", "dossier-all"):
        rows = plans.QUERIES["Q14_Q15_S15_dossiers"](spark, a.data)
        if a.command == "dossier":
            for r in rows.where(F.col("trait_id").isin(*a.id)).collect():
                print(r["dossier"])
        else:
            sources.write_dossiers(rows.select(F.concat(F.lit("trait "), "trait_id").alias("name"), "dossier"), a.out)
    elif a.command in ("accept", "reject"):
        pending = spark.read.parquet(f"{a.data}/orders.parquet").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))
        decided = written(_decide(spark, pending, a.id, "ACCEPTED" if a.command == "accept" else "REJECTED"))
        decided.show(truncate=False)
        if a.out:
            decided.write.mode("append").parquet(a.out)
    elif a.command == "export":
        sources.write_lines(plans.QUERIES["Q16_S13_S14_export"](spark, a.data), a.out)
    else:
        _cross(spark, a).show(a.limit, truncate=False)


if __name__ == "__main__":
    main(sys.argv[1:])
