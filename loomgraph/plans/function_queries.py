"""Scalar functions, predicates and set operations over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph import fixed
from loomgraph.functions import text as X
from loomgraph.operators import claims as C
from loomgraph.plans.base import Graph, query

@query("SELECT trait_id, trim(regexp_replace(lower(name || ' #' || category), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM trait")
def T01_slugify(g: Graph) -> DataFrame:
    return g.trait.select("trait_id", X.slugify(F.concat("name", F.lit(" #"), "category")).alias("slug"))


@query()
def T01_H13_slugify_unicode(g: Graph) -> DataFrame:
    """Slugs of the whole text of every document."""
    return g.read("documents").select("doc_id", X.slugify(F.col("text")).alias("slug"))


@query("""
SELECT trait_id, gene_id, 'claim:' || substr(sha1('associated_with_gene|' || trait_id || '|' || gene_id), 1, 16) AS claim_id,
  'claim:' || substr(sha1('resembles|' || least(trait_id::VARCHAR, gene_id::VARCHAR) || '|' || greatest(trait_id::VARCHAR, gene_id::VARCHAR)), 1, 16) AS symmetric_id FROM claim
""")
def T02_T03_claim_ids(g: Graph) -> DataFrame:
    trait, gene = F.col("trait_id").cast("string"), F.col("gene_id").cast("string")
    keys = g.evidence.select("trait_id", "gene_id").distinct()
    return keys.select("trait_id", "gene_id", X.claim_id(F.lit("associated_with_gene"), trait, gene).alias("claim_id"), X.claim_id(F.lit("resembles"), gene, trait).alias("symmetric_id"))


@query("""
SELECT o_orderkey AS paper, CASE WHEN o_orderkey % 3 = 0 THEN 'paper:doi:' || lower('10.1/Ab' || o_orderkey) WHEN o_orderkey % 3 = 1 THEN 'paper:pmid:' || o_custkey
  WHEN o_orderkey % 5 = 0 THEN 'paper:pmcid:' || lower('PMC' || o_orderkey) END AS id FROM orders
""", plain=True)
def T04_P08_paper_ids(g: Graph) -> DataFrame:
    k = F.col("o_orderkey")
    doi, pmid = F.when(k % 3 == 0, F.concat(F.lit("10.1/Ab"), k)).otherwise(F.lit("")), F.when(k % 3 == 1, F.col("o_custkey").cast("string"))
    pmcid = F.when(k % 5 == 0, F.concat(F.lit("PMC"), k))
    return g.read("orders").select(k.alias("paper"), X.paper_id(doi, pmid, pmcid).alias("id"))


@query("""
SELECT doc_id, CASE WHEN length(t) > 90 THEN substr(t, 1, 87) || '...' ELSE t END AS cited, trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')) AS key
FROM (SELECT doc_id, regexp_extract(text, '^[^\n]*') AS t FROM documents)
""", plain=True)
def T10_titles(g: Graph) -> DataFrame:
    return _titles(g.read("documents"))


def _titles(docs: DataFrame) -> DataFrame:
    t = docs.select("doc_id", F.regexp_extract("text", "^[^\n]*", 0).alias("t"))
    return t.select("doc_id", X.cited(F.col("t")).alias("cited"), X.normalise_title(F.col("t")).alias("key"))


@query("""
SELECT trait_id, 'chr' || trait_chromosome || CASE WHEN trait_id <> 0 THEN ', ' || format('{:,}', trait_id * 1000) || '-' || format('{:,}', trait_id * 1234) ELSE '' END AS detail FROM trait
""")
def T07_locus_detail(g: Graph) -> DataFrame:
    k = F.col("trait_id")
    return g.trait.select("trait_id", X.locus_detail(F.col("trait_chromosome"), k * 1000, k * 1234).alias("detail"))


@query("""
SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS title
FROM pages
""".replace("\\\\", "\\"), plain=True)
def T08_clean_titles(g: Graph) -> DataFrame:
    return g.read("pages").select("page_id", X.clean_markup(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query("SELECT c_custkey AS id, TRY_CAST(substr(c_name, 10) AS INTEGER) AS number, TRY_CAST(c_name AS INTEGER) AS none FROM customer", plain=True)
def T09_try_cast(g: Graph) -> DataFrame:
    return g.read("customer").select(F.col("c_custkey").alias("id"), F.substring("c_name", 10, 100).try_cast("int").alias("number"), F.col("c_name").try_cast("int").alias("none"))


@query("""
WITH parts AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+([A-Z(])', '\\1' || chr(7) || '\\2', 'g'), chr(7))) AS s FROM documents)
SELECT doc_id, count(*) AS n_sentences, max(length(s)) AS longest FROM parts WHERE s <> '' GROUP BY doc_id
""", plain=True)
def T11_sentences(g: Graph) -> DataFrame:
    return _sentence_counts(g.read("documents"))


def _sentence_counts(docs: DataFrame) -> DataFrame:
    s = docs.select("doc_id", F.explode(X.sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.max(F.length("s")).cast("long").alias("longest"))


@query("""
SELECT category, '"' || array_to_string(list_sort(array_agg(DISTINCT name)), '" OR "') || '"' AS any_of FROM trait GROUP BY category
""")
def T22_query_strings(g: Graph) -> DataFrame:
    return g.trait.groupBy("category").agg(F.collect_set("name").alias("names")).select("category", X.quoted_or(F.col("names")).alias("any_of"))


@query("""
SELECT trait_id, gene_id, paper_id, experiment_no, CASE WHEN species_is_target = 0 AND level_rank > 20 THEN 'comparative evidence above its ceiling' ELSE 'species not written' END AS problem
FROM evidence WHERE (species_is_target = 0 AND level_rank > 20) OR (species_is_target = 0 AND level_rank = 20 AND experiment_no = 1)
""")
def P12_P13_species_rules(g: Graph) -> DataFrame:
    e, comparative = g.evidence, F.col("species_is_target") == 0
    above = comparative & (F.col("level_rank") > fixed.COMPARATIVE_CEILING)
    unsaid = comparative & (F.col("level_rank") == fixed.COMPARATIVE_CEILING) & (F.col("experiment_no") == 1)
    problem = F.when(above, "comparative evidence above its ceiling").otherwise("species not written")
    return e.where(above | unsaid).select("trait_id", "gene_id", "paper_id", "experiment_no", problem.alias("problem"))


@query("""
WITH tiers AS (SELECT * FROM (VALUES ('tionsh.example.net', 1), ('blog.tionble.example.com', 2)) AS t(host, tier)),
hosts AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages)
SELECT page_id, CASE WHEN coalesce(host, '') = '' THEN 4 ELSE coalesce(tier, 3) END AS tier FROM hosts LEFT JOIN tiers USING (host)
""", plain=True)
def T28_host_tiers(g: Graph) -> DataFrame:
    return g.read("pages").select("page_id", X.host_tier(F.col("url"), {"tionsh.example.net": 1, "blog.tionble.example.com": 2}).alias("tier"))


@query("""
SELECT l_orderkey % 64 AS numerator, count(*) AS n, (l_orderkey % 64) // gcd(l_orderkey % 64, 64) AS num, 64 // gcd(l_orderkey % 64, 64) AS den FROM lineitem GROUP BY l_orderkey % 64
""", plain=True)
def T36_exact_fractions(g: Graph) -> DataFrame:
    counts = g.read("lineitem").groupBy((F.col("l_orderkey") % 64).alias("numerator")).agg(F.count(F.lit(1)).alias("n"))
    num, den = X.fraction(F.col("numerator"), 64)
    return counts.select("numerator", "n", num.alias("num"), den.alias("den"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp FROM events", plain=True)
def T38_dates(g: Graph) -> DataFrame:
    return g.read("events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("stamp"))


@query("SELECT conv_id, string_agg(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ' ORDER BY turn, role, text) AS said, count(*) AS turns FROM conversations GROUP BY conv_id".replace("\\\\", "\\"), plain=True)
def T40_A18_ordered_concat(g: Graph) -> DataFrame:
    one = g.read("conversations").select("conv_id", F.struct("turn", "role", "text", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("flat")).alias("said"))
    rows = one.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"), F.count(F.lit(1)).alias("turns"))
    return rows.select("conv_id", F.array_join(F.transform("said", lambda s: s["flat"]), " ").alias("said"), "turns")


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '\\b(there|theser)')".replace("\\\\", "\\"), plain=True)
def P19_word_start(g: Graph) -> DataFrame:
    return g.read("documents").where(F.lower("text").rlike(r"\b(there|theser)")).select("doc_id")


@query("SELECT trait_id, gene_id, best_rank < 20 AS weak FROM claim")
def P20_weak_basis(g: Graph) -> DataFrame:
    return g.claim.select("trait_id", "gene_id", (F.col("best_rank") < 20).alias("weak"))


@query("""
SELECT 'claim without evidence' AS problem, count(*) AS n FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p.p_partkey)
UNION ALL SELECT 'evidence without paper', count(*) FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l.l_orderkey)
UNION ALL SELECT 'reference without entity', count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o.o_custkey AND c_acctbal > 0)
""", plain=True)
def Q17_J13_J14_P11_integrity(g: Graph) -> DataFrame:
    line, orders = g.read("lineitem"), g.read("orders")
    checks = {
        "claim without evidence": g.read("part").join(line, F.col("p_partkey") == F.col("l_partkey"), "left_anti"),
        "evidence without paper": line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"),
        "reference without entity": orders.join(g.read("customer").where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left_anti"),
    }
    out = None
    for problem, rows in checks.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(problem).alias("problem"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""
SELECT 'duplicate definition' AS problem, p_name AS key, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1 AND count(DISTINCT p_type) = 1
UNION ALL SELECT 'id collision', p_name, count(*) FROM part GROUP BY p_name HAVING count(*) > 1 AND count(DISTINCT p_type) > 1
""", plain=True)
def A27_duplicate_keys(g: Graph) -> DataFrame:
    found = g.read("part").groupBy(F.col("p_name").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_type").alias("kinds")).where("n > 1")
    return found.select(F.when(F.col("kinds") == 1, "duplicate definition").otherwise("id collision").alias("problem"), "key", "n")


@query("""
SELECT category, array_to_string(list_sort(list_intersect(a, b)), ',') AS in_both, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS only_first, list_has_any(a, b) AS overlap
FROM (SELECT category, array_agg(DISTINCT phenotype) FILTER (WHERE trait_chromosome = 1) AS a, array_agg(DISTINCT phenotype) FILTER (WHERE trait_chromosome = 2) AS b FROM trait GROUP BY category)
WHERE a IS NOT NULL AND b IS NOT NULL
""")
def U03_U06_U07_array_sets(g: Graph) -> DataFrame:
    sets = g.trait.groupBy("category").agg(*(F.collect_set(F.when(F.col("trait_chromosome") == r, F.col("phenotype"))).alias(c) for r, c in ((1, "a"), (2, "b"))))
    sets = sets.where((F.size("a") > 0) & (F.size("b") > 0))
    return sets.select("category", F.array_join(F.array_sort(F.array_intersect("a", "b")), ",").alias("in_both"), F.array_join(F.array_sort(F.array_except("a", "b")), ",").alias("only_first"), F.arrays_overlap("a", "b").alias("overlap"))


@query("SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem", plain=True)
def U08_unordered_pairs(g: Graph) -> DataFrame:
    return g.read("lineitem").select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).distinct()


@query("SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'", plain=True)
def U04_U02_union_distinct(g: Graph) -> DataFrame:
    return g.read("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")).union(g.read("customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")).distinct()


@query("""
(SELECT 'new' AS kind, trait_id AS id FROM claim WHERE best_rank = 70 EXCEPT SELECT 'new', trait_id FROM trait WHERE category = 'PROMO')
UNION ALL (SELECT 'stale', trait_id FROM trait WHERE category = 'PROMO' EXCEPT SELECT 'stale', trait_id FROM claim WHERE best_rank = 70)
""")
def U05_U09_differences(g: Graph) -> DataFrame:
    """Violations against a known list, both ways."""
    found = g.claim.where(F.col("best_rank") == 70).select(F.col("trait_id").alias("id")).distinct()
    known = g.trait.where(F.col("category") == "PROMO").select(F.col("trait_id").alias("id"))
    new, stale = found.join(known, "id", "left_anti"), known.join(found, "id", "left_anti")
    return new.select(F.lit("new").alias("kind"), "id").unionByName(stale.select(F.lit("stale").alias("kind"), "id"))


@query("""
SELECT t.trait_id, coalesce(CASE WHEN t.trait_id % 4 = 0 THEN t.name END, CASE WHEN t.trait_id % 4 = 1 THEN t.phenotype END, t.category) AS shown FROM trait t
""")
def P03_null_dropping(g: Graph) -> DataFrame:
    k = F.col("trait_id")
    return g.trait.select("trait_id", F.coalesce(F.when(k % 4 == 0, F.col("name")), F.when(k % 4 == 1, F.col("phenotype")), "category").alias("shown"))
