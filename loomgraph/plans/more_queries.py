"""Labels, genotype tokens, registers, reviews and checks over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import crosses as X
from loomgraph.operators.storage import numbered
from loomgraph.plans.base import Graph, query
from loomgraph.plans.cross_queries import _PARENTS, RULES, _crosses


@query("""
SELECT trait_id, 'en: ' || name || CASE WHEN is_composite = 1 THEN ' (' || upper(name) || ')' ELSE '' END || ' [' || CASE category WHEN 'ECONOMY' THEN 'no source' WHEN 'PROMO' THEN phenotype || '; ' || category ELSE phenotype END || ']'
  || CASE WHEN category = 'LARGE' THEN ' UNVERIFIED' ELSE '' END AS label FROM trait
""")
def T05_display_labels(g: Graph) -> DataFrame:
    kind = F.col("category")
    sources = F.when(kind == "ECONOMY", F.array().cast("array<string>")).when(kind == "PROMO", F.array("phenotype", "category")).otherwise(F.array("phenotype"))
    reading = F.when(F.col("is_composite") == 1, F.upper("name"))
    return g.trait.select("trait_id", T.display_label(F.lit("en"), F.col("name"), reading, sources, kind != "LARGE").alias("label"))


@query("""
WITH asked AS (SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'a/A, B/b' WHEN 'MACHINERY' THEN 'b/b;x/X' WHEN 'HOUSEHOLD' THEN 'A/b' WHEN 'FURNITURE' THEN 'a/a A/a' ELSE ' ' END AS text FROM customer)
SELECT id, CASE text WHEN 'a/A, B/b' THEN 'A/a B/b' WHEN 'b/b;x/X' THEN 'b/b X^x Y^X' WHEN ' ' THEN 'wild type throughout' END AS genotype,
  CASE text WHEN 'A/b' THEN 'not a pair of alleles: A/b' WHEN 'a/a A/a' THEN 'locus given twice' END AS error FROM asked
""", plain=True)
def T31_parse_genotypes(g: Graph) -> DataFrame:
    kind = F.col("c_mktsegment")
    text = F.when(kind == "BUILDING", "a/A, B/b").when(kind == "MACHINERY", "b/b;x/X").when(kind == "HOUSEHOLD", "A/b").when(kind == "FURNITURE", "a/a A/a").otherwise(" ")
    pairs, error = X.parse_column(RULES, text, X.MALE)
    rows = g.read("customer").select(F.col("c_custkey").alias("id"), *(p.alias(f"p_{k}") for k, p in enumerate(pairs)), error.alias("error"))
    return rows.select("id", F.when(F.col("error").isNull(), X.show(RULES, X.MALE, "p")).alias("genotype"), "error")


@query(_PARENTS + """
SELECT id, coalesce(nullif(concat_ws(' ', CASE WHEN a1 = 'a' OR a2 = 'a' THEN least(a1, a2) || '/' || greatest(a1, a2) END, CASE WHEN b1 = 'b' OR b2 = 'b' THEN least(b1, b2) || '/' || greatest(b1, b2) END,
  CASE WHEN x1 = 'x' OR x2 = 'x' THEN 'X^' || least(x1, x2) || ' X^' || greatest(x1, x2) END), ''), 'wild type throughout') AS genotype, count(*)::BIGINT AS weight
FROM kids WHERE sex = 'female' GROUP BY ALL
""", plain=True)
def A26_genotype_shares(g: Graph) -> DataFrame:
    return X.genotype_shares(_crosses(g), RULES, X.FEMALE, "id")


@query(_PARENTS + r"SELECT DISTINCT regexp_replace(part, '( \(partial\)|\?)$', '') AS trait FROM (SELECT unnest(string_split(class, ', ')) AS part FROM named) WHERE part <> 'none of the modelled traits'", plain=True)
def T37_traits_in_classes(g: Graph) -> DataFrame:
    labels = X.classes(_crosses(g), RULES, "id").select(F.explode(F.split("class", ", ")).alias("label")).where(F.col("label") != X.NOTHING)
    return labels.select(X.bare_label(F.col("label")).alias("trait")).distinct()


@query("SELECT c.trait_id, c.gene_id FROM claim c WHERE NOT (n_supports > 0 AND n_contradicts > 0) AND gene_id IN (SELECT gene_id FROM claim WHERE n_supports > 0 AND n_contradicts > 0)")
def G07_dispute_one_step_out(g: Graph) -> DataFrame:
    """Claims that are not disputed themselves but share their gene with a disputed one."""
    contested = (F.col("n_supports") > 0) & (F.col("n_contradicts") > 0)
    near = g.claim.where(contested).select("gene_id").distinct()
    return g.claim.where(~contested).join(near, "gene_id", "left_semi").select("trait_id", "gene_id")


@query(_PARENTS + """
SELECT m.id, (m.l1a = 'a' OR m.l1b = 'a' OR f.l1a = 'a' OR f.l1b = 'a') AND (m.sx1 = 'x' OR m.sx2 = 'x' OR f.sx1 = 'x' OR f.sx2 = 'x') AS refused
FROM parents m JOIN parents f ON f.id = m.id + 64 AND m.sex = 'female' AND f.sex = 'male'
""", plain=True)
def G09_linkage_refusals(g: Graph) -> DataFrame:
    """Crosses that would be refused if the first and the sex-linked locus were linked: both in play."""
    rows = _crosses(g)

    def in_play(k: int, wild: str) -> F.Column:
        return F.exists(F.concat(f"m_{k}", f"f_{k}"), lambda s: s != wild)

    return rows.select("id", (in_play(0, "A") & in_play(2, "X")).alias("refused"))


@query("""
SELECT 'Trait' AS label, count(*) - count(DISTINCT trait_id) AS duplicates FROM trait UNION ALL SELECT 'Gene', count(*) - count(DISTINCT gene_id) FROM gene UNION ALL SELECT 'Paper', count(*) - count(DISTINCT paper_id) FROM paper
""")
def K11_uniqueness(g: Graph) -> DataFrame:
    """What a uniqueness constraint would refuse."""
    out = None
    for label, rows, key in (("Trait", g.trait, "trait_id"), ("Gene", g.gene, "gene_id"), ("Paper", g.paper, "paper_id")):
        one = rows.groupBy(key).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates")).select(F.lit(label).alias("label"), "duplicates")
        out = one if out is None else out.unionByName(one)
    return out


@query("""
WITH named AS (SELECT c_custkey AS id, lower(c_name) AS form FROM customer WHERE c_acctbal > 0), aliases AS (SELECT c_custkey AS id, 'customer ' || c_custkey AS form FROM customer WHERE c_mktsegment = 'BUILDING'),
asked AS (SELECT o_orderkey AS id, o_totalprice, lower(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Customer ' || o_custkey ELSE 'CUSTOMER#' || lpad(o_custkey::VARCHAR, 9, '0') END) AS form FROM orders WHERE o_orderstatus = 'P')
SELECT a.id, form, CASE (SELECT count(*) FROM named n WHERE n.form = a.form) WHEN 1 THEN 'RESOLVED_EXACT' WHEN 0 THEN CASE (SELECT count(*) FROM aliases l WHERE l.form = a.form) WHEN 0 THEN 'NEW' WHEN 1 THEN 'RESOLVED_ALIAS' ELSE 'AMBIGUOUS' END ELSE 'AMBIGUOUS' END AS resolved,
  row_number() OVER (ORDER BY o_totalprice DESC, a.id) AS position FROM asked a
""", plain=True)
def Q13_pending_candidates(g: Graph) -> DataFrame:
    """The whole queue in order, each candidate resolved against names and then aliases."""
    customer, urgent = g.read("customer"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    named = customer.where("c_acctbal > 0").groupBy(F.lower("c_name").alias("form")).agg(F.count(F.lit(1)).alias("names"))
    aliases = customer.where("c_mktsegment = 'BUILDING'").groupBy(F.concat(F.lit("customer "), "c_custkey").alias("form")).agg(F.count(F.lit(1)).alias("aliases"))
    form = F.lower(F.when(urgent, F.concat(F.lit("Customer "), "o_custkey")).otherwise(F.concat(F.lit("CUSTOMER#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))))
    asked = g.read("orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), "o_totalprice", form.alias("form")).join(named, "form", "left").join(aliases, "form", "left")
    found = F.when(F.col("names") == 1, "RESOLVED_EXACT").when(F.col("names") > 1, "AMBIGUOUS").when(F.col("aliases") == 1, "RESOLVED_ALIAS").when(F.col("aliases") > 1, "AMBIGUOUS").otherwise("NEW")
    return numbered(asked.select("id", "form", found.alias("resolved"), "o_totalprice"), "position", F.desc("o_totalprice"), F.asc("id")).drop("o_totalprice")


_HITS = """hits AS (SELECT o_orderkey AS pos, o_custkey AS id, o_orderpriority AS via FROM orders WHERE o_totalprice > 1000 UNION ALL SELECT o_orderkey + 1000000000, o_custkey, 'second run' FROM orders WHERE o_orderstatus = 'F')"""


def _hits(g: Graph) -> DataFrame:
    orders = g.read("orders")
    first = orders.where("o_totalprice > 1000").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("via"))
    return first.unionByName(orders.where("o_orderstatus = 'F'").select((F.col("o_orderkey") + 1000000000).alias("pos"), F.col("o_custkey").alias("id"), F.lit("second run").alias("via")))


@query(f"""
WITH {_HITS}, known AS (SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'),
marked AS (SELECT h.id, h.pos, k.id IS NOT NULL AS seeded, row_number() OVER (PARTITION BY h.id ORDER BY h.pos) AS n, CASE WHEN row_number() OVER (PARTITION BY h.id, h.via ORDER BY h.pos) = 1 THEN 1 ELSE 0 END AS fresh FROM hits h LEFT JOIN known k USING (id)),
counted AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY pos) + CASE WHEN seeded THEN 1 ELSE 0 END AS vias FROM marked)
SELECT count(*) FILTER (WHERE NOT seeded AND n = 1) AS added, count(*) FILTER (WHERE seeded OR n > 1) AS already_known, count(*) FILTER (WHERE (seeded OR n > 1) AND vias > 1) AS new_via_recorded FROM counted
""", plain=True)
def Q29_A29_register_report(g: Graph) -> DataFrame:
    """What registering the hits in order would report; a known paper counts as a new route whenever it has several."""
    known = g.read("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), F.lit(1).alias("seeded"))
    by_id = Window.partitionBy("id").orderBy("pos")
    rows = _hits(g).join(known, "id", "left").withColumn("seeded", F.coalesce("seeded", F.lit(0))).withColumn("n", F.row_number().over(by_id))
    rows = rows.withColumn("fresh", (F.row_number().over(Window.partitionBy("id", "via").orderBy("pos")) == 1).cast("int"))
    rows = rows.withColumn("vias", F.sum("fresh").over(by_id.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("seeded"))
    again = (F.col("seeded") == 1) | (F.col("n") > 1)
    return rows.agg(F.count_if(~again).alias("added"), F.count_if(again).alias("already_known"), F.count_if(again & (F.col("vias") > 1)).alias("new_via_recorded"))


@query("SELECT o_orderkey AS id, c_name AS title FROM orders JOIN customer ON 'paper:pmid:' || c_custkey = 'paper:pmid:' || o_custkey", plain=True)
def J23_titles_by_rebuilt_id(g: Graph) -> DataFrame:
    """Ids are rebuilt on both sides, so the join is an equality and no substring search."""
    orders = g.read("orders").select(F.col("o_orderkey").alias("id"), T.paper_id(F.lit(None).cast("string"), F.col("o_custkey").cast("string"), F.lit(None).cast("string")).alias("paper"))
    titles = g.read("customer").select(T.paper_id(F.lit(None).cast("string"), F.col("c_custkey").cast("string"), F.lit(None).cast("string")).alias("paper"), F.col("c_name").alias("title"))
    return orders.join(titles, "paper").select("id", "title")
