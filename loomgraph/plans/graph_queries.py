"""Read queries over claims: listings, reviews, disputes, shared genes, mechanisms, nominations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import fixed
from loomgraph.operators import claims as C
from loomgraph.operators.components import connected_components
from loomgraph.operators.storage import numbered, written
from loomgraph.plans.base import Graph, query

LEVEL = fixed.level_sql("best_rank")
ALLOWED = ", ".join(f"'{x}'" for x in fixed.DIRECT_EXPERIMENTS)


@query("SELECT trait_id, name, category, phenotype FROM trait WHERE trait_id = 42")
def Q01_S04_P04_get_trait(g: Graph) -> DataFrame:
    return g.trait.where(F.col("trait_id") == 42).select("trait_id", "name", "category", "phenotype")


@query("""
SELECT c.trait_id, t.name AS subject_name, c.gene_id, x.name AS object_name, 'Gene' AS object_label, e.paper_id, e.experiment_no, e.stance, e.level_rank, p.pub_year, p.journal
FROM claim c JOIN trait t USING (trait_id) JOIN gene x ON x.gene_id = c.gene_id
LEFT JOIN evidence e ON e.trait_id = c.trait_id AND e.gene_id = c.gene_id LEFT JOIN paper p ON p.paper_id = e.paper_id
""")
def Q02_J01_J02_P01_P02_claims_about(g: Graph) -> DataFrame:
    evidence = g.evidence.select("trait_id", "gene_id", "paper_id", "experiment_no", "stance", "level_rank")
    out = g.claim.select("trait_id", "gene_id").join(g.trait.select("trait_id", F.col("name").alias("subject_name")), "trait_id")
    out = out.join(g.gene.select("gene_id", F.col("name").alias("object_name")), "gene_id").withColumn("object_label", F.lit("Gene"))
    out = out.join(evidence, ["trait_id", "gene_id"], "left").join(g.paper.select("paper_id", "pub_year", "journal"), "paper_id", "left")
    return out.select("trait_id", "subject_name", "gene_id", "object_name", "object_label", "paper_id", "experiment_no", "stance", "level_rank", "pub_year", "journal")


@query("""
SELECT c.gene_id, c.trait_id, t.name AS subject_name, c.best_rank FROM claim c JOIN trait t USING (trait_id) WHERE c.gene_id IN (1, 7, 42)
""")
def Q03_J03_P05_claims_targeting(g: Graph) -> DataFrame:
    claims = C.summarise(g.evidence.where(F.col("gene_id").isin(1, 7, 42)), ["trait_id", "gene_id"])
    return claims.join(g.trait.select("trait_id", F.col("name").alias("subject_name")), "trait_id").select("gene_id", "trait_id", "subject_name", "best_rank")


@query("""
SELECT t.trait_id, t.category, t.name, count(DISTINCT c.gene_id) AS n_claims,
  row_number() OVER (ORDER BY t.category NULLS LAST, t.name NULLS LAST, t.trait_id) AS position
FROM trait t LEFT JOIN claim c USING (trait_id) GROUP BY t.trait_id, t.category, t.name
""")
def Q04_J04_A01_W04_list_traits(g: Graph) -> DataFrame:
    counts = g.evidence.groupBy("trait_id").agg(F.countDistinct("gene_id").alias("n_claims"))
    rows = g.trait.join(counts, "trait_id", "left").select("trait_id", "category", "name", F.coalesce("n_claims", F.lit(0)).alias("n_claims"))
    return numbered(rows, "position", F.col("category").asc_nulls_last(), F.col("name").asc_nulls_last(), F.asc("trait_id"))


@query("""
WITH reasons AS (
  SELECT trait_id, gene_id, predicate, n_supports, n_contradicts, list_sort(list_distinct(list_filter([
    CASE WHEN n_supports > 0 AND n_contradicts > 0 THEN 'CONTRADICTORY_EVIDENCE' END, CASE WHEN predicate = 'caused_by_variant' THEN 'NEW_CAUSAL_VARIANT' END,
    CASE WHEN predicate = 'putatively_same_as' THEN 'BREEDER_ACADEMIC_LINK' END, CASE WHEN n_unknown > 0 THEN 'EVIDENCE_LEVEL_UNCLEAR' END,
    CASE WHEN p_size = 7 THEN 'NEW_CAUSAL_VARIANT' WHEN p_size = 8 THEN 'LOW_RESOLUTION_CONFIDENCE' END], lambda x: x IS NOT NULL))) AS reasons FROM claim JOIN part ON p_partkey = trait_id)
SELECT trait_id, gene_id, predicate, n_supports, n_contradicts, array_to_string(reasons, ',') AS reasons,
  row_number() OVER (ORDER BY n_contradicts DESC, len(reasons) DESC, trait_id, gene_id) AS position
FROM reasons WHERE len(reasons) > 0
""")
def Q05_A02_A12_W03_review_queue(g: Graph) -> DataFrame:
    """The whole queue in order, with the reasons that a record states (here by a part's size) and those that follow."""
    size = F.col("p_size")
    stated = F.when(size == 7, F.array(F.lit("NEW_CAUSAL_VARIANT"))).when(size == 8, F.array(F.lit("LOW_RESOLUTION_CONFIDENCE")))
    rows = g.claim.join(g.read("part").select(F.col("p_partkey").alias("trait_id"), stated.alias("stated")), "trait_id")
    rows = rows.withColumn("why", C.review_reasons(F.col("stated"))).where(F.size("why") > 0)
    rows = rows.select("trait_id", "gene_id", "predicate", "n_supports", "n_contradicts", F.concat_ws(",", "why").alias("reasons"), F.size("why").alias("n_reasons"))
    return numbered(rows, "position", F.desc("n_contradicts"), F.desc("n_reasons"), F.asc("trait_id"), F.asc("gene_id")).drop("n_reasons")


@query("SELECT trait_id, gene_id, n_supports, n_contradicts FROM claim WHERE n_supports > 0 AND n_contradicts > 0")
def Q06_disputed_claims(g: Graph) -> DataFrame:
    return C.disputed(g.claim).select("trait_id", "gene_id", "n_supports", "n_contradicts")


@query("""
SELECT c.trait_id, c.gene_id FROM (SELECT DISTINCT trait_id, gene_id FROM evidence) c
WHERE EXISTS (SELECT 1 FROM evidence e WHERE e.trait_id = c.trait_id AND e.gene_id = c.gene_id AND e.stance = 'SUPPORTS')
  AND EXISTS (SELECT 1 FROM evidence e WHERE e.trait_id = c.trait_id AND e.gene_id = c.gene_id AND e.stance = 'CONTRADICTS')
""")
def J05_J07_semi_joins(g: Graph) -> DataFrame:
    keys = ["trait_id", "gene_id"]
    for_, against = (g.evidence.where(F.col("stance") == s).select(*keys) for s in ("SUPPORTS", "CONTRADICTS"))
    return g.evidence.select(*keys).distinct().join(for_, keys, "left_semi").join(against, keys, "left_semi")


@query("""
WITH held AS (SELECT trait_id, gene_id, n_contradicts > 0 AS contested FROM claim WHERE n_supports > 0 AND predicate IN ('associated_with_gene', 'associated_with_locus', 'caused_by_variant'))
SELECT a.trait_id AS a, b.trait_id AS b, array_to_string(list_sort(array_agg(DISTINCT a.gene_id)), ',') AS genes, bool_or(a.contested OR b.contested) AS contested
FROM held a JOIN held b ON a.gene_id = b.gene_id AND a.trait_id < b.trait_id
WHERE NOT EXISTS (SELECT 1 FROM subsumes s WHERE (s.subject_id = a.trait_id AND s.object_id = b.trait_id) OR (s.subject_id = b.trait_id AND s.object_id = a.trait_id))
GROUP BY a.trait_id, b.trait_id
""")
def Q07_J06_J08_J09_A04_A05_shared_genes(g: Graph) -> DataFrame:
    """Over supported claims of the predicates that name genes."""
    out = C.shared_targets(g.claim.where(F.col("predicate").isin(*fixed.GENE_PREDICATES)), g.subsumes, "trait_id", "gene_id")
    return out.select("a", "b", F.concat_ws(",", F.col("targets").cast("array<string>")).alias("genes"), "contested")


@query(f"""
WITH per_gene AS (SELECT c.trait_id, x.mechanism_id, c.gene_id, c.best_rank FROM claim c JOIN gene x USING (gene_id))
SELECT trait_id, m.name AS mechanism, best_rank, {LEVEL} AS level, array_to_string(list_sort(array_agg(gene_id)), ',') AS genes,
  row_number() OVER (PARTITION BY trait_id ORDER BY best_rank DESC, m.name) AS position
FROM per_gene JOIN mechanism m USING (mechanism_id) GROUP BY trait_id, m.name, best_rank
""")
def Q08_J10_A06_W02_mechanisms_via_genes(g: Graph) -> DataFrame:
    rows = g.claim.join(g.gene.select("gene_id", "mechanism_id"), "gene_id").join(g.mechanism.select("mechanism_id", F.col("name").alias("mechanism")), "mechanism_id")
    out = rows.groupBy("trait_id", "mechanism", "best_rank").agg(F.sort_array(F.collect_list("gene_id")).alias("genes"))
    order = Window.partitionBy("trait_id").orderBy(F.desc("best_rank"), "mechanism")
    return out.select("trait_id", "mechanism", "best_rank", fixed.level_of(F.col("best_rank")).alias("level"), F.concat_ws(",", F.col("genes").cast("array<string>")).alias("genes"), F.row_number().over(order).alias("position"))


@query("""
SELECT 'Trait' AS label, count(*) AS n FROM trait UNION ALL SELECT 'Gene', count(*) FROM gene UNION ALL SELECT 'Mechanism', count(*) FROM mechanism
UNION ALL SELECT 'Anatomy', count(*) FROM anatomy UNION ALL SELECT 'Paper', count(*) FROM paper UNION ALL SELECT 'Claim', count(*) FROM claim
""")
def Q10_S03_A07_U01_graph_counts(g: Graph) -> DataFrame:
    parts = {"Trait": g.trait, "Gene": g.gene, "Mechanism": g.mechanism, "Anatomy": g.anatomy, "Paper": g.paper, "Claim": g.evidence.select("trait_id", "gene_id").distinct()}
    out = None
    for label, rows in parts.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("label"), "n")
        out = one if out is None else out.unionByName(one)
    return out.where(F.col("n") > 0)


@query("""
SELECT paper_id, pub_year, row_number() OVER (ORDER BY pub_year DESC NULLS FIRST, paper_id) AS position
FROM paper WHERE state <> 'ACCEPTED' AND (journal = '1-URGENT' OR coalesce(CASE WHEN journal = '2-HIGH' THEN 1 END, -1) < 1)
""")
def Q11_P06_W05_X06_unprocessed_papers(g: Graph) -> DataFrame:
    """Never processed, or processed by an older version; newest first, unknown years first of all."""
    version = F.when(F.col("journal") == "2-HIGH", 1)
    rows = g.paper.where((F.col("state") != "ACCEPTED") & ((F.col("journal") == "1-URGENT") | (F.coalesce(version, F.lit(-1)) < 1)))
    return numbered(rows.select("paper_id", "pub_year"), "position", F.col("pub_year").desc_nulls_first(), F.asc("paper_id"))


@query("""
SELECT state, paper_id, coalesce(pub_year, 0) AS pub_year, row_number() OVER (ORDER BY coalesce(pub_year, 0) DESC, paper_id) AS position
FROM paper WHERE state IN ('DISCOVERED', 'METADATA_RESOLVED', 'FULLTEXT_AVAILABLE', 'EXTRACTION_PENDING')
""")
def Q12_W06_X05_papers_in_states(g: Graph) -> DataFrame:
    """All papers that wait for a step, newest first; a caller's limit is a limit on position."""
    rows = g.paper.where(F.col("state").isin(*fixed.ACTIONABLE)).select("state", "paper_id", F.coalesce("pub_year", F.lit(0)).alias("pub_year"))
    return numbered(rows, "position", F.desc("pub_year"), F.asc("paper_id"))


@query("SELECT CASE WHEN state = 'ACCEPTED' THEN 'UNTRACKED' ELSE state END AS state, count(*) AS n FROM paper GROUP BY 1")
def Q12_A08_state_counts(g: Graph) -> DataFrame:
    tracked = F.when(F.col("state") != "ACCEPTED", F.col("state"))
    return g.paper.groupBy(F.coalesce(tracked, F.lit("UNTRACKED")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH items AS (SELECT DISTINCT trait_id, gene_id, level_rank, paper_id, experiment_no, stance FROM evidence)
SELECT trait_id, gene_id, array_to_string(array_agg(level_rank || ':' || paper_id || ':' || experiment_no || ':' || stance ORDER BY level_rank DESC, paper_id, experiment_no, stance), ' ') AS evidence
FROM items GROUP BY trait_id, gene_id
""")
def A03_W01_evidence_of_claims(g: Graph) -> DataFrame:
    out = C.gathered(g.evidence, ["trait_id", "gene_id"])
    show = F.transform("evidence", lambda e: F.concat_ws(":", (-e["order"]).cast("string"), e["paper_id"].cast("string"), e["experiment_no"].cast("string"), e["stance"]))
    return out.select("trait_id", "gene_id", F.array_join(show, " ").alias("evidence"))


@query(f"SELECT trait_id, gene_id, best_rank, {LEVEL} AS level, n_supports > 0 AND n_contradicts > 0 AS disputed FROM claim")
def A09_A11_strongest_support(g: Graph) -> DataFrame:
    level = fixed.level_of(F.col("best_rank"))
    return g.claim.select("trait_id", "gene_id", "best_rank", level.alias("level"), ((F.col("n_supports") > 0) & (F.col("n_contradicts") > 0)).alias("disputed"))


@query("""
SELECT trait_id, best_rank AS least_rank, gene_id FROM (SELECT *, row_number() OVER (PARTITION BY trait_id ORDER BY best_rank, gene_id) AS n FROM claim) WHERE n = 1
""")
def A10_weakest_claim(g: Graph) -> DataFrame:
    return C.weakest(g.claim, ["trait_id"], "best_rank", "gene_id").withColumnRenamed("best_rank", "least_rank").select("trait_id", "least_rank", "gene_id")


_FLAGS = f"""flags AS (SELECT trait_id, gene_id, coalesce(max(CASE WHEN stance = 'SUPPORTS' THEN level_rank END), 0) AS best_rank,
  bool_or(stance = 'SUPPORTS' AND level_rank IN (60, 70) AND species_is_target = 1 AND len(list_filter(string_split(lower(trim(experiment_type)), ' and '), lambda p: p IN ({ALLOWED}))) > 0) AS direct,
  bool_or(stance = 'SUPPORTS' AND level_rank IN (40, 50) AND species_is_target = 1) AS mapped FROM evidence GROUP BY trait_id, gene_id),
basis AS (SELECT trait_id, gene_id, best_rank, CASE WHEN best_rank = 0 THEN 'UNASSERTED' WHEN direct THEN 'DIRECT' WHEN mapped THEN 'MAPPED' ELSE 'INFERRED' END AS basis FROM flags)"""


@query(f"WITH {_FLAGS} SELECT trait_id, gene_id, best_rank, basis FROM basis")
def Q18_T23_classify(g: Graph) -> DataFrame:
    return C.classify(g.evidence, ["trait_id", "gene_id"])


_NOMINATED = f"""both_ways AS (SELECT subject_id AS a, object_id AS b FROM subsumes UNION SELECT object_id, subject_id FROM subsumes),
reach AS (SELECT trait_id, trait_id AS seen FROM trait UNION SELECT r.trait_id, e.b FROM reach r JOIN both_ways e ON e.a = r.seen),
roots AS (SELECT trait_id, min(seen) AS root FROM reach GROUP BY trait_id),
told AS (SELECT DISTINCT e.trait_id, e.gene_id, e.paper_id FROM evidence e JOIN basis b USING (trait_id, gene_id)
  WHERE e.stance = 'SUPPORTS' AND e.species_is_target = 1 AND ((b.basis = 'DIRECT' AND e.level_rank IN (60, 70) AND len(list_filter(string_split(lower(trim(e.experiment_type)), ' and '), lambda p: p IN ({ALLOWED}))) > 0)
    OR (b.basis = 'MAPPED' AND e.level_rank IN (40, 50)))),
place AS (SELECT p_partkey AS trait_id, p_brand || '/' || p_type || '/' || p_size AS phenotype FROM part UNION SELECT p_partkey, p_name || '/' || p_size || '/' || p_brand FROM part),
nominated AS (SELECT p.trait_id, n.gene_id, count(DISTINCT p.phenotype) AS phenotypes, count(DISTINCT n.trait_id) AS neighbours, count(DISTINCT rn.root) AS via, count(DISTINCT n.paper_id) AS papers
  FROM place p JOIN roots rp USING (trait_id) JOIN place q ON q.phenotype = p.phenotype JOIN roots rn ON rn.trait_id = q.trait_id JOIN told n ON n.trait_id = q.trait_id
  WHERE rp.root <> rn.root AND p.trait_id <> q.trait_id GROUP BY p.trait_id, n.gene_id)"""


def _places(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Two phenotypes of each trait, and the components of subsumption as roots."""
    part = g.read("part")
    size = F.col("p_size").cast("string")
    places = part.select(F.col("p_partkey").alias("trait_id"), F.explode(F.array(F.concat_ws("/", "p_brand", "p_type", size), F.concat_ws("/", "p_name", size, "p_brand"))).alias("phenotype"))
    found = connected_components(g.subsumes.select(F.col("subject_id").alias("a"), F.col("object_id").alias("b")))
    roots = g.trait.select("trait_id").join(found.withColumnRenamed("node", "trait_id"), "trait_id", "left").select("trait_id", F.coalesce("component", "trait_id").alias("root"))
    return places, roots


@query(f"WITH {_FLAGS}, {_NOMINATED} SELECT trait_id, gene_id, phenotypes, neighbours, via, papers, via >= 2 AND papers >= 2 AS convergent FROM nominated")
def Q19_J18_A20_nominate(g: Graph) -> DataFrame:
    return C.nominate(g.evidence, *_places(g))


_POSITION = "CASE WHEN t.trait_chromosome IS NULL OR x.gene_chromosome IS NULL THEN 'unknown' WHEN t.trait_chromosome = x.gene_chromosome THEN 'consistent' ELSE 'vetoed' END"


def _with_position(g: Graph, rows: DataFrame) -> DataFrame:
    out = rows.join(g.trait.select("trait_id", "trait_chromosome"), "trait_id", "left").join(g.gene.select("gene_id", "gene_chromosome"), "gene_id", "left")
    chromosomes = F.when(F.col("trait_chromosome").isNotNull(), F.array("trait_chromosome"))
    return out.withColumn("position", C.position(chromosomes, F.col("gene_chromosome"))).drop("trait_chromosome", "gene_chromosome")


@query(f"SELECT c.trait_id, c.gene_id, {_POSITION} AS position FROM claim c LEFT JOIN trait t USING (trait_id) LEFT JOIN gene x USING (gene_id)")
def Q20_J19_position(g: Graph) -> DataFrame:
    return _with_position(g, g.claim.select("trait_id", "gene_id")).select("trait_id", "gene_id", "position")


@query(f"""WITH {_FLAGS}, {_NOMINATED}
SELECT b.trait_id, b.gene_id, b.basis, CASE
  WHEN b.basis = 'MAPPED' THEN 'mapped gene lies off the chromosome'
  WHEN coalesce(n.via, 0) < 2 OR coalesce(n.papers, 0) < 2 THEN 'inferred gene without convergence (' || coalesce(n.via, 0) || ' neighbours, ' || coalesce(n.papers, 0) || ' papers)'
  ELSE 'inferred gene without positional support' END AS why
FROM basis b LEFT JOIN nominated n USING (trait_id, gene_id) LEFT JOIN trait t USING (trait_id) LEFT JOIN gene x USING (gene_id)
WHERE (b.basis = 'MAPPED' AND {_POSITION} = 'vetoed') OR (b.basis = 'INFERRED' AND (coalesce(n.via, 0) < 2 OR coalesce(n.papers, 0) < 2 OR {_POSITION} <> 'consistent'))""")
def Q21_gene_claim_violations(g: Graph) -> DataFrame:
    basis = C.classify(g.evidence, ["trait_id", "gene_id"]).where(F.col("basis").isin("MAPPED", "INFERRED"))
    basis = written(basis)
    nominated = C.nominate(g.evidence, *_places(g), asked=basis.where("basis = 'INFERRED'")).select("trait_id", "gene_id", "via", "papers")
    rows = _with_position(g, basis).join(nominated, ["trait_id", "gene_id"], "left").na.fill(0, ["via", "papers"])
    alone = (F.col("via") < fixed.MIN_NEIGHBOURS) | (F.col("papers") < fixed.MIN_PAPERS)
    said = F.concat(F.lit("inferred gene without convergence ("), F.col("via"), F.lit(" neighbours, "), F.col("papers"), F.lit(" papers)"))
    why = F.when((F.col("basis") == "MAPPED") & (F.col("position") == "vetoed"), "mapped gene lies off the chromosome")
    why = why.when((F.col("basis") == "INFERRED") & alone, said).when((F.col("basis") == "INFERRED") & (F.col("position") != "consistent"), "inferred gene without positional support")
    return rows.withColumn("why", why).where(F.col("why").isNotNull()).select("trait_id", "gene_id", "basis", "why")


@query(f"""WITH {_FLAGS}, {_NOMINATED},
truth AS (SELECT DISTINCT trait_id FROM claim WHERE best_rank >= 50),
rows AS (SELECT n.*, coalesce(c.best_rank >= 50, false) AS correct, n.via >= 2 AND n.papers >= 2 AS convergent, {_POSITION} AS position FROM nominated n JOIN truth USING (trait_id)
  LEFT JOIN claim c ON c.trait_id = n.trait_id AND c.gene_id = n.gene_id LEFT JOIN trait t ON t.trait_id = n.trait_id LEFT JOIN gene x ON x.gene_id = n.gene_id)
SELECT count(DISTINCT trait_id) AS traits_tested, count(*) AS nominations, count(*) FILTER (WHERE correct) AS correct, count(*) FILTER (WHERE convergent) AS convergent,
  count(*) FILTER (WHERE convergent AND correct) AS convergent_correct, count(*) FILTER (WHERE position = 'consistent') AS veto_kept,
  count(*) FILTER (WHERE position = 'consistent' AND NOT correct) AS veto_kept_wrong, count(*) FILTER (WHERE position = 'vetoed') AS vetoed,
  count(*) FILTER (WHERE position = 'vetoed' AND correct) AS vetoed_correct FROM rows""")
def Q22_A21_leave_one_out(g: Graph) -> DataFrame:
    """Nominations of the traits with a known gene are counted as they are made; which of them are right, over the known pairs alone."""
    told = C.told(g.evidence, *_places(g))
    known = written(g.claim.where(F.col("best_rank") >= fixed.TRUTH_FLOOR).select("trait_id", "gene_id"))
    truth = known.select("trait_id").distinct().join(g.trait.select("trait_id", "trait_chromosome"), "trait_id", "left")
    rows = C.nominated(told, truth, g.gene.select("gene_id", "gene_chromosome"))
    chromosomes = F.when(F.col("trait_chromosome").isNotNull(), F.array("trait_chromosome"))
    rows = rows.withColumn("position", C.position(chromosomes, F.col("gene_chromosome")))
    kept, vetoed = F.col("position") == "consistent", F.col("position") == "vetoed"
    every = rows.groupBy("trait_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("convergent").alias("convergent"), F.count_if(kept).alias("kept"), F.count_if(vetoed).alias("vetoed"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "convergent", "kept", "vetoed")]
    every = every.agg(F.count(F.lit(1)).alias("traits"), *sums)
    right = _with_position(g, C.nominated_of(told, known)).agg(F.count(F.lit(1)).alias("correct"), F.count_if("convergent").alias("convergent_correct"), F.count_if(kept).alias("kept_correct"), F.count_if(vetoed).alias("vetoed_correct"))
    # a row each
    return every.crossJoin(right).select(
        F.col("traits").alias("traits_tested"), F.col("n").alias("nominations"), "correct", "convergent", "convergent_correct",
        F.col("kept").alias("veto_kept"), (F.col("kept") - F.col("kept_correct")).alias("veto_kept_wrong"), "vetoed", "vetoed_correct",
    )


@query("""
WITH links AS (SELECT subject_id AS a, object_id AS b FROM subsumes),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT trait_id AS node, trait_id AS seen FROM trait UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen)
SELECT node, min(seen) AS component FROM reach GROUP BY node HAVING count(*) > 1
""")
def G01_G02_components(g: Graph) -> DataFrame:
    """Components of subsumption, by smallest labels and pointer jumping."""
    return connected_components(g.subsumes.select(F.col("subject_id").alias("a"), F.col("object_id").alias("b")))


@query("""
WITH edges AS (SELECT p_partkey AS a, p_partkey // 7 AS b FROM part WHERE p_partkey > 0),
reach AS (SELECT 64::BIGINT AS node UNION SELECT e.a FROM reach r JOIN edges e ON e.b = r.node)
SELECT node FROM reach
""")
def G03_closure(g: Graph) -> DataFrame:
    """Everything below one node of a composition tree, until no row is new."""
    from loomgraph.operators.components import closure

    edges = g.read("part").where("p_partkey > 0").select(F.col("p_partkey").alias("below"), F.expr("p_partkey div 7").alias("above"))
    return closure(g.spark.createDataFrame([(64,)], "node long"), edges, "above", "below")
