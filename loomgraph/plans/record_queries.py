"""Checks of records against the model's rules: ceilings, shapes, labels, entities, terms and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import fixed
from loomgraph.functions import text as X
from loomgraph.operators import claims as C
from loomgraph.operators import extraction as E
from loomgraph.operators import merge as M
from loomgraph.plans.base import PREDICATES, Graph, predicate_of, query, sql_list

#: Experiments by evidence, among them compound, unknown and missing ones.
KINDS = [
    "positional cloning", "Genome Editing", "gwas", " expression analysis ", "morpholino knockdown and rna-seq", "variant calling and genome editing", "phenotype description",
    "", "skeletal analysis", "complementation test", "breeder description", "segregation analysis", "inference", "lesion sequencing", "a new assay and gwas and another", "literature attribution", None,
]
SUBJECTS = ["OrnamentalTrait", "Phenotype", "Gene", "GeneticVariant", "HumanGene", "Strain", "Locus"]
OBJECTS = ["Gene", "Phenotype", "Locus", "GeneticVariant", "Anatomy", "BiologicalMechanism", "HumanGene", "HumanPhenotype", "OrnamentalTrait", "InheritanceMode"]
ENDPOINTS = [x for x in fixed.PREFIXES if x not in ("Paper", "Evidence", "Claim", "Label")]


def pick(values: list, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def sql_pick(values: list, at: str) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"][(({at}) % {len(values)} + 1)::INT]"


_LEVEL = "CASE {} " + " ".join(f"WHEN {n} THEN '{name}'" for name, n in fixed.LEVELS.items()) + " END"
_TYPED = f"typed AS (SELECT trait_id, gene_id, paper_id, experiment_no, level_rank, {sql_pick(PREDICATES, 'trait_id + gene_id')} AS predicate, {sql_pick(KINDS, 'paper_id + experiment_no')} AS kind FROM evidence)"
_FACTS = "facts AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{k}', {r})" for p, table in fixed.CEILINGS_OF.items() for k, r in table.items()) + ") AS t(predicate, part, rank))"


def _typed(g: Graph) -> DataFrame:
    e = g.evidence
    kind = pick(KINDS, F.col("paper_id") + F.col("experiment_no"))
    return e.select("trait_id", "gene_id", "paper_id", "experiment_no", "level_rank", predicate_of(F.col("trait_id"), F.col("gene_id")).alias("predicate"), kind.alias("experiment_type"))


@query(f"""
WITH {_TYPED}, {_FACTS},
kinds AS (SELECT predicate, kind, list_filter(list_transform(string_split(lower(trim(coalesce(kind, ''))), ' and '), lambda p: trim(p)), lambda p: p <> '') AS parts FROM (SELECT DISTINCT predicate, kind FROM typed WHERE predicate IN (SELECT predicate FROM facts))),
each AS (SELECT predicate, kind, unnest(parts) AS part, generate_subscripts(parts, 1) AS place FROM kinds),
bound AS (SELECT e.predicate, e.kind, string_agg(CASE WHEN rank IS NULL THEN part END, ', ' ORDER BY place) AS unknown, max(rank) AS ceiling FROM each e LEFT JOIN facts f USING (predicate, part) GROUP BY ALL),
judged AS (SELECT t.*, CASE WHEN len(k.parts) = 0 THEN 'no experiment, so no ceiling' WHEN unknown IS NOT NULL THEN 'no ceiling for ' || unknown
  WHEN level_rank > ceiling THEN {_LEVEL.format("level_rank")} || ' is above ' || {_LEVEL.format("ceiling")} END AS problem
  FROM typed t JOIN kinds k ON k.predicate = t.predicate AND k.kind IS NOT DISTINCT FROM t.kind LEFT JOIN bound b ON b.predicate = t.predicate AND b.kind IS NOT DISTINCT FROM t.kind)
SELECT predicate, trait_id, gene_id, paper_id, experiment_no, problem FROM judged WHERE problem IS NOT NULL
""")
def Q17_T24_ceilings(g: Graph) -> DataFrame:
    """Evidence that breaks the ceiling of its predicate, for every predicate that has one."""
    return C.ceiling_problems(_typed(g)).select("predicate", "trait_id", "gene_id", "paper_id", "experiment_no", "problem")


_SHAPES = "shapes AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', {sql_list(sorted(s))}, {sql_list(sorted(o))})" for p, (s, o) in fixed.SHAPES.items()) + ") AS t(predicate, subjects, objects))"


@query(f"""
WITH {_SHAPES}, ends AS (SELECT trait_id, gene_id, predicate, {sql_pick(SUBJECTS, "trait_id * 3 + gene_id")} AS s, {sql_pick(OBJECTS, "trait_id + gene_id * 7")} AS o FROM claim),
judged AS (SELECT trait_id, gene_id, CASE WHEN NOT list_contains(subjects, s) THEN predicate || ': subject must be ' || array_to_string(subjects, ' or ') || ', not ' || s
  WHEN NOT list_contains(objects, o) THEN predicate || ': object must be ' || array_to_string(objects, ' or ') || ', not ' || o END AS problem FROM ends JOIN shapes USING (predicate))
SELECT * FROM judged WHERE problem IS NOT NULL
""")
def P07_shapes(g: Graph) -> DataFrame:
    """Claims whose ends their predicate does not allow, over all predicates."""
    trait, gene = F.col("trait_id"), F.col("gene_id")
    rows = g.claim.select("trait_id", "gene_id", C.shape_problem(F.col("predicate"), pick(SUBJECTS, trait * 3 + gene), pick(OBJECTS, trait + gene * 7)).alias("problem"))
    return rows.where(F.col("problem").isNotNull())


_LANGUAGES = ["ja", "ja-Latn", "ko", "EN", "zh-Hant", "e", "en_US", "en"]


@query(f"""
WITH labels AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN '  ' ELSE c_name END AS text, {sql_pick(_LANGUAGES, "c_custkey")} AS lang,
  CASE c_custkey % 5 WHEN 0 THEN ['bv:0001'] WHEN 1 THEN ['bv:0003', 'bv:12'] ELSE [] END AS vocab, c_nationkey % 3 = 0 AS unverified, CASE WHEN c_nationkey % 4 = 0 THEN [] ELSE [c_mktsegment] END AS sources FROM customer),
judged AS (SELECT id, CASE WHEN trim(text) = '' THEN 'blank text' WHEN NOT regexp_matches(lang, '{fixed.LANGUAGE_TAG}') THEN 'no language tag: ' || lang
  WHEN len(list_filter(vocab, lambda v: NOT regexp_matches(v, '{fixed.VOCABULARY_ID}'))) > 0 THEN 'no vocabulary id: ' || array_to_string(list_filter(vocab, lambda v: NOT regexp_matches(v, '{fixed.VOCABULARY_ID}')), ', ')
  WHEN NOT unverified AND len(sources) = 0 AND len(vocab) = 0 THEN 'attested without a source' END AS problem FROM labels)
SELECT * FROM judged WHERE problem IS NOT NULL
""", plain=True)
def P09_label_checks(g: Graph) -> DataFrame:
    k, nation, none = F.col("c_custkey"), F.col("c_nationkey"), F.array().cast("array<string>")
    vocab = F.when(k % 5 == 0, F.array(F.lit("bv:0001"))).when(k % 5 == 1, F.array(F.lit("bv:0003"), F.lit("bv:12"))).otherwise(none)
    labels = g.read("customer").select(
        k.alias("id"), F.when(k % 11 == 0, "  ").otherwise(F.col("c_name")).alias("text"), pick(_LANGUAGES, k).alias("lang"), vocab.alias("vocab"),
        F.when(nation % 3 == 0, "UNVERIFIED").otherwise("ATTESTED").alias("status"), F.when(nation % 4 == 0, none).otherwise(F.array("c_mktsegment")).alias("sources"))
    return labels.select("id", M.label_problem().alias("problem")).where(F.col("problem").isNotNull())


_LABELS = list(fixed.PREFIXES)


@query(f"""
WITH entities AS (SELECT p_partkey AS id, {sql_pick(_LABELS, "p_partkey")} AS label, CASE WHEN p_size % 2 = 0 THEN p_type END AS category, CASE WHEN p_size % 3 = 0 THEN [p_name] ELSE [] END AS query_terms,
  string_split(p_name, ' ') AS aliases, CASE WHEN p_size % 7 = 0 THEN [p_brand, split_part(p_name, ' ', 1)] ELSE [p_brand] END AS unverified, CASE WHEN p_size % 5 <> 0 THEN 'Oryzias latipes' END AS species FROM part),
judged AS (SELECT id, CASE WHEN label NOT IN (SELECT unnest({sql_list(ENDPOINTS)})) THEN 'no endpoint of claims: ' || label WHEN category IS NOT NULL AND label <> 'OrnamentalTrait' THEN 'category on ' || label
  WHEN len(query_terms) > 0 AND label <> 'Anatomy' THEN 'query terms on ' || label WHEN list_has_any(aliases, unverified) THEN 'sourced and unverified: ' || array_to_string(list_sort(list_distinct(list_intersect(aliases, unverified))), ', ')
  WHEN label = 'Gene' AND species IS NULL THEN 'gene without a species' END AS problem FROM entities)
SELECT * FROM judged WHERE problem IS NOT NULL
""", plain=True)
def P10_entity_checks(g: Graph) -> DataFrame:
    size, first = F.col("p_size"), F.split("p_name", " ")
    entities = g.read("part").select(
        F.col("p_partkey").alias("id"), pick(_LABELS, F.col("p_partkey")).alias("label"), F.when(size % 2 == 0, F.col("p_type")).alias("category"),
        F.when(size % 3 == 0, F.array("p_name")).otherwise(F.array().cast("array<string>")).alias("query_terms"), first.alias("aliases"),
        F.when(size % 7 == 0, F.array(F.col("p_brand"), first[0])).otherwise(F.array("p_brand")).alias("unverified"), F.when(size % 5 != 0, fixed.TARGET_SPECIES).alias("species"))
    return entities.select("id", M.entity_problem(ENDPOINTS).alias("problem")).where(F.col("problem").isNotNull())


_SECTIONS = ["Results", "Author contributions", "References", "Data Availability Statement", "Methods", "Acknowledgements", "Discussion of ethics", "Conflicts of interest", "Competing interests", "List of abbreviations", "Introduction"]


@query(f"""
SELECT c_custkey AS id, section FROM (SELECT c_custkey, {sql_pick(_SECTIONS, "c_custkey")} || ' ' || c_mktsegment AS section FROM customer)
WHERE NOT list_bool_or(list_transform({sql_list(fixed.NO_EVIDENCE)}, lambda p: contains(lower(section), p)))
""".replace("list_bool_or(", "list_contains(").replace("lower(section), p)))", "lower(section), p)), true)"), plain=True)
def P14_evidence_sections(g: Graph) -> DataFrame:
    section = F.concat_ws(" ", pick(_SECTIONS, F.col("c_custkey")), "c_mktsegment")
    return g.read("customer").select(F.col("c_custkey").alias("id"), section.alias("section")).where(E.is_evidence(F.col("section")))


_FORM = f"CASE p_size % 6 WHEN 0 THEN {sql_pick(list(fixed.AMBIGUOUS), 'p_partkey')} WHEN 1 THEN left(p_name, 3) WHEN 2 THEN '  ' || p_name WHEN 3 THEN (p_partkey * 1000 + p_size)::VARCHAR WHEN 4 THEN 'Oryzias ' || p_name ELSE 'protomedaka ' || p_name END"


@query(f"""
WITH forms AS (SELECT p_partkey AS id, {_FORM} AS form, p_type AS abstract FROM part), bare AS (SELECT *, trim(form) AS f FROM forms)
SELECT id, length(f) >= 4 AND (contains(f, ' ') OR NOT list_contains({sql_list(x.lower() for x in fixed.AMBIGUOUS)}, lower(f))) AS searchable, length(f) >= 3 AND regexp_matches(f, '\\p{{L}}') AS anatomical,
  length(f) < 4 OR list_contains({sql_list(x.lower() for x in fixed.AMBIGUOUS)}, lower(f)) OR NOT regexp_matches(f, '\\p{{L}}') AS ambiguous,
  contains(lower(form), 'medaka') OR contains(lower(form), 'oryzias') OR contains(lower(form), 'latipes') AS anchored, regexp_matches(form || ' ' || abstract, '(?i)\\b(medaka|oryzias)') AS on_topic FROM bare
""".replace("\\\\", "\\"), plain=True)
def P15_P17_P18_P19_terms(g: Graph) -> DataFrame:
    size, name = F.col("p_size") % 6, F.col("p_name")
    form = F.when(size == 0, pick(list(fixed.AMBIGUOUS), F.col("p_partkey"))).when(size == 1, F.left(name, F.lit(3))).when(size == 2, F.concat(F.lit("  "), name))
    form = form.when(size == 3, (F.col("p_partkey") * 1000 + F.col("p_size")).cast("string")).when(size == 4, F.concat(F.lit("Oryzias "), name)).otherwise(F.concat(F.lit("protomedaka "), name))
    f = F.col("form")
    return g.read("part").select(F.col("p_partkey").alias("id"), form.alias("form"), F.col("p_type").alias("abstract")).select(
        "id", E.is_searchable(f).alias("searchable"), E.is_anatomical(f).alias("anatomical"), E.is_ambiguous(f).alias("ambiguous"), E.is_anchored(f).alias("anchored"), E.on_topic(f, F.col("abstract")).alias("on_topic"))


@query("""
SELECT DISTINCT paper_id, experiment_type, stance, 'ev:' || substr(sha1('paper:pmid:' || paper_id || '|' || experiment_type || '|' || stance), 1, 16) AS evidence_id,
  'mech:' || trim(regexp_replace(lower(experiment_type || ' of ' || stance), '[^a-z0-9]+', '-', 'g'), '-') AS entity_id FROM evidence
""")
def T03_ids(g: Graph) -> DataFrame:
    """Ids of evidence and of entities; evidence is keyed on its paper, experiment and finding, whatever it supports."""
    rows = g.evidence.select("paper_id", "experiment_type", "stance").distinct()
    paper = X.paper_id(F.lit(None).cast("string"), F.col("paper_id").cast("string"), F.lit(None).cast("string"))
    name = F.concat_ws(" of ", "experiment_type", "stance")
    return rows.select("paper_id", "experiment_type", "stance", X.evidence_id(paper, F.col("experiment_type"), F.col("stance")).alias("evidence_id"), X.entity_id(F.lit("BiologicalMechanism"), name).alias("entity_id"))


@query("""
WITH papers AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN repeat(o_clerk || ' ', (o_orderkey % 7)::INT + 1) || 'end' END AS title, CASE WHEN o_orderkey % 3 <> 0 THEN year(o_orderdate) END AS year,
  CASE WHEN o_orderkey % 4 = 0 THEN '10.1/' || o_orderkey END AS doi, CASE WHEN o_orderkey % 4 < 2 THEN o_custkey::VARCHAR END AS pmid, CASE WHEN o_orderkey % 4 < 3 THEN 'http://x/' || o_custkey END AS url FROM orders)
SELECT id, coalesce(nullif(concat_ws(' ', CASE WHEN length(title) <= 90 THEN title ELSE left(title, 87) || '...' END, '(' || year || ')'), ''), 'source unrecorded')
  || coalesce(' — doi:' || doi, ' — PMID:' || pmid, ' — ' || url, '') AS cited FROM papers
""".replace("o_clerk", "o_orderpriority"), plain=True)
def T06_citations(g: Graph) -> DataFrame:
    """Title and year, then the best locator there is: DOI, else PMID, else URL."""
    k = F.col("o_orderkey")
    title = F.when(k % 5 != 0, F.concat(F.repeat(F.concat("o_orderpriority", F.lit(" ")), (k % 7 + 1).cast("int")), F.lit("end")))
    return g.read("orders").select(k.alias("id"), X.cite(
        title, F.when(k % 3 != 0, F.year("o_orderdate")), F.when(k % 4 == 0, F.concat(F.lit("10.1/"), k)), F.when(k % 4 < 2, F.col("o_custkey").cast("string")), F.when(k % 4 < 3, F.concat(F.lit("http://x/"), "o_custkey"))).alias("cited"))


_STATES = list(fixed.STATES)


@query(f"""
WITH moves AS (SELECT user_id, {sql_pick(_STATES, "event_id * 5")} AS state FROM events), ranks AS (SELECT * FROM (VALUES {", ".join(f"('{s}', {r})" for s, r in fixed.STATES.items())}) AS t(state, rank))
SELECT user_id, arg_max(state, rank) AS state, count(*) AS n_moves FROM moves JOIN ranks USING (state) GROUP BY user_id
""", plain=True)
def X01_paper_states(g: Graph) -> DataFrame:
    """States by the ranks of the model: a move back is no move."""
    moves = g.read("events").select("user_id", pick(_STATES, F.col("event_id") * 5).alias("state"))
    ranks = F.create_map(*(F.lit(x) for pair in fixed.STATES.items() for x in pair))
    best = moves.withColumn("rank", ranks[F.col("state")]).groupBy("user_id").agg(F.max(F.struct("rank", "state")).alias("best"), F.count(F.lit(1)).alias("n_moves"))
    return best.select("user_id", "best.state", "n_moves")


@query("""
WITH counts AS (SELECT c_nationkey AS id, count(*) FILTER (WHERE c_custkey % 2 = 0) AS a, count(*) FILTER (WHERE c_custkey % 2 = 1) AS b FROM customer GROUP BY c_nationkey),
chi AS (SELECT *, power(a - b, 2) / (a + b) AS x FROM counts), steps AS (SELECT id, a, b, x, sqrt(x / 2) AS z FROM chi)
SELECT id, a, b, round(x, 6) AS chi_square, round(1 - 2 / sqrt(pi()) * (SELECT sum(power(-1, n) * power(z, 2 * n + 1) / (gamma(n + 1) * (2 * n + 1))) FROM range(60) AS r(n)), 4) AS p FROM steps
""", plain=True)
def A30_chi_square_with_p(g: Graph) -> DataFrame:
    """Counts against 1:1 and the P value of one degree of freedom; the SQL sums the series of the error function."""
    even = F.col("c_custkey") % 2 == 0
    rows = g.read("customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.count_if(even).alias("a"), F.count_if(~even).alias("b"))
    chi = F.pow(F.col("a") - F.col("b"), 2) / (F.col("a") + F.col("b"))
    return rows.select("id", "a", "b", F.round(chi, 6).alias("chi_square"), F.round(X.erfc(F.sqrt(chi / 2)), 4).alias("p"))


@query("""
WITH first AS (SELECT conv_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS said, min(turn) AS turn FROM conversations GROUP BY ALL)
SELECT conv_id, string_agg(said, ' / ' ORDER BY turn, said) AS said, count(*) AS n FROM first WHERE said <> '' GROUP BY conv_id
""".replace("\\\\", "\\"), plain=True)
def A18_distinct_concat(g: Graph) -> DataFrame:
    """What was said, each saying once and where it came first."""
    first = g.read("conversations").groupBy("conv_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("said")).agg(F.min("turn").alias("turn")).where("said <> ''")
    rows = first.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "said"))).alias("all"), F.count(F.lit(1)).alias("n"))
    return rows.select("conv_id", F.array_join(F.transform("all", lambda x: x["said"]), " / ").alias("said"), "n")


@query("""
WITH rows AS (SELECT l_suppkey AS term, CASE WHEN l_linenumber <= 2 THEN 'colour' WHEN l_linenumber <= 4 THEN 'shape' ELSE 'scale' END AS axis, l_orderkey * 10 + l_linenumber AS pos, l_shipmode AS lane FROM lineitem WHERE l_quantity > 40),
counts AS (SELECT term, axis, count(*) AS n, min(pos) AS first, min(CASE WHEN lane = 'R' AND axis = 'colour' OR lane = 'N' AND axis = 'shape' THEN pos END) AS owned FROM rows GROUP BY ALL),
best AS (SELECT *, max(n) OVER (PARTITION BY term) AS top FROM counts)
SELECT term, axis FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY owned NULLS LAST, first) AS k FROM best WHERE n = top) WHERE k = 1
""".replace("l_shipmode", "l_returnflag"), plain=True)
def A16_lane_vote(g: Graph) -> DataFrame:
    """The commonest axis of a term; on ties the first row from a lane that owns its axis decides, and without one the axis seen first."""
    line, flag = F.col("l_linenumber"), F.col("l_returnflag")
    axis = F.when(line <= 2, "colour").when(line <= 4, "shape").otherwise("scale")
    rows = g.read("lineitem").where("l_quantity > 40").select(F.col("l_suppkey").alias("term"), axis.alias("axis"), (F.col("l_orderkey") * 10 + line).alias("pos"), flag.alias("lane"))
    owns = ((F.col("lane") == "R") & (F.col("axis") == "colour")) | ((F.col("lane") == "N") & (F.col("axis") == "shape"))
    return M.voted_by_lane(rows, "term", "axis", "pos", owns)
