"""Aggregations, rankings, resolution, upserts, registries and citation screening over the tables."""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import merge as M
from loomgraph.operators.claims import first_per_key
from loomgraph.operators.dedupe import with_routes
from loomgraph.operators.storage import small, table_path
from loomgraph.operators.store import ConstraintError, Store
from loomgraph.plans.base import GREEDY, Graph, query


@query("""
SELECT coalesce(category, 'TOTAL') AS category, count(*) FILTER (WHERE is_composite = 1) AS composite, count(*) FILTER (WHERE is_composite = 0) AS single, count(*) AS total
FROM trait GROUP BY ROLLUP (category)
""")
def A13_S18_cross_tab(g: Graph) -> DataFrame:
    rows = g.trait.rollup("category").agg(F.count_if(F.col("is_composite") == 1).alias("composite"), F.count_if(F.col("is_composite") == 0).alias("single"), F.count(F.lit(1)).alias("total"))
    return rows.withColumn("category", F.coalesce("category", F.lit("TOTAL")))


@query("SELECT stance, count(*) AS n, count(*) FILTER (WHERE species_is_target = 1) AS stated FROM evidence GROUP BY stance")
def A14_basis_counts(g: Graph) -> DataFrame:
    return g.evidence.groupBy("stance").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("species_is_target") == 1).alias("stated"))


@query("""
WITH counts AS (SELECT trait_id, experiment_type, count(*) AS n, min(CASE experiment_type WHEN 'gwas' THEN 0 WHEN 'positional cloning' THEN 1 ELSE 2 END) AS pref FROM evidence GROUP BY ALL),
first AS (SELECT *, row_number() OVER (PARTITION BY trait_id ORDER BY n DESC, pref, experiment_type) AS k FROM counts)
SELECT trait_id, experiment_type AS kind FROM first WHERE k = 1
""")
def A15_majority_with_preference(g: Graph) -> DataFrame:
    kind = F.col("experiment_type")
    return M.voted(g.evidence, "trait_id", "experiment_type", F.when(kind == "gwas", 0).when(kind == "positional cloning", 1).otherwise(2), "kind")


@query("""
WITH counts AS (SELECT gene_id, experiment_type, count(*) AS n, min(paper_id) AS first_seen FROM evidence GROUP BY ALL),
first AS (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY n DESC, first_seen, experiment_type) AS k FROM counts)
SELECT gene_id, experiment_type AS spelling FROM first WHERE k = 1
""")
def A16_A17_majority_first_seen(g: Graph) -> DataFrame:
    return M.voted(g.evidence, "gene_id", "experiment_type", F.col("paper_id"), "spelling")


@query("SELECT gene_id, coalesce(min(CASE WHEN level_rank >= 20 THEN level_rank END), 9) AS best_tier FROM evidence GROUP BY gene_id")
def A19_best_tier(g: Graph) -> DataFrame:
    return g.evidence.groupBy("gene_id").agg(F.coalesce(F.min(F.when(F.col("level_rank") >= 20, F.col("level_rank"))), F.lit(9)).alias("best_tier"))


@query("""
WITH distinct_ids AS (SELECT conv_id, text, min(turn) AS turn FROM conversations GROUP BY conv_id, text),
ordered AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM distinct_ids)
SELECT conv_id, turn, n, md5(text) AS digest FROM ordered WHERE n <= 3
""", plain=True)
def W09_W10_cap_after_dedupe(g: Graph) -> DataFrame:
    """First occurrences only, then at most three of each conversation in order."""
    first = g.read("conversations").groupBy("conv_id", "text").agg(F.min("turn").alias("turn"))
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    return first.withColumn("n", n).where(F.col("n") <= 3).select("conv_id", "turn", "n", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT trait_id, array_to_string(array_agg(best_rank || ':' || gene_id ORDER BY best_rank, gene_id), ' ') AS support FROM claim GROUP BY trait_id")
def W15_T41_support_in_order(g: Graph) -> DataFrame:
    rows = g.claim.groupBy("trait_id").agg(F.array_sort(F.collect_list(F.struct("best_rank", "gene_id"))).alias("all"))
    return rows.select("trait_id", F.array_join(F.transform("all", lambda x: F.concat_ws(":", x["best_rank"].cast("string"), x["gene_id"].cast("string"))), " ").alias("support"))


@query("""
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY trait_id ORDER BY level_rank DESC, experiment_no, paper_id, gene_id, stance, species_is_target) AS n FROM evidence)
SELECT trait_id, level_rank, experiment_no, experiment_type FROM ranked WHERE n = 1
""")
def W12_W13_W17_strongest_first(g: Graph) -> DataFrame:
    """The strongest evidence of each trait, the first in the order of experiments on ties."""
    best = g.evidence.groupBy("trait_id").agg(F.min(F.struct((-F.col("level_rank")).alias("r"), "experiment_no", "paper_id", "gene_id", "stance", "species_is_target", "experiment_type")).alias("b"))
    return best.select("trait_id", (-F.col("b.r")).alias("level_rank"), F.col("b.experiment_no").alias("experiment_no"), F.col("b.experiment_type").alias("experiment_type"))


@query("SELECT experiment_type, count(*) AS n FROM evidence GROUP BY 1 ORDER BY n DESC, experiment_type LIMIT 5")
def W16_W18_W19_most_common(g: Graph) -> DataFrame:
    return g.evidence.groupBy("experiment_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "experiment_type").limit(5)


_RESOLVE = """
WITH forms AS (SELECT DISTINCT 'Trait' AS label, lower(p_name) AS form, p_partkey AS id, 'name' AS kind FROM part UNION ALL SELECT 'Gene', lower(s_name), s_suppkey, 'name' FROM supplier
  UNION ALL SELECT 'Gene', 'gene ' || s_suppkey, s_suppkey, 'alias' FROM supplier),
asked AS (SELECT c_custkey AS ask, 'Gene' AS label, lower(CASE c_mktsegment WHEN 'BUILDING' THEN 'SUPPLIER#' || lpad(CAST(c_nationkey AS VARCHAR), 9, '0') WHEN 'MACHINERY' THEN 'Gene ' || c_nationkey
  WHEN 'HOUSEHOLD' THEN 'Small Ring' ELSE 'nobody ' || c_custkey END) AS form FROM customer),
hits AS (SELECT a.ask, count(DISTINCT CASE WHEN f.label = a.label AND f.kind = 'name' THEN f.id END) AS exact, count(DISTINCT CASE WHEN f.label = a.label AND f.kind = 'alias' THEN f.id END) AS alias,
  count(DISTINCT CASE WHEN f.label <> a.label THEN f.id END) AS other FROM asked a LEFT JOIN forms f ON f.form = a.form GROUP BY a.ask)
SELECT ask, CASE WHEN exact = 1 THEN 'RESOLVED_EXACT' WHEN exact > 1 THEN 'AMBIGUOUS' WHEN alias = 1 THEN 'RESOLVED_ALIAS' WHEN alias > 1 THEN 'AMBIGUOUS' WHEN other > 0 THEN 'AMBIGUOUS' ELSE 'NEW' END AS status FROM hits
"""


@query(_RESOLVE, plain=True)
def Q23_J15_resolve_names(g: Graph) -> DataFrame:
    """Exact name, then alias, then a name under another label, else new; an equi join on the folded form."""
    part, supplier = g.read("part"), g.read("supplier")
    forms = part.select(F.lit("Trait").alias("label"), F.lower("p_name").alias("form"), F.col("p_partkey").alias("id"), F.lit("name").alias("kind"))
    forms = forms.unionByName(supplier.select(F.lit("Gene").alias("label"), F.lower("s_name").alias("form"), F.col("s_suppkey").alias("id"), F.lit("name").alias("kind")))
    forms = forms.unionByName(supplier.select(F.lit("Gene").alias("label"), F.concat(F.lit("gene "), "s_suppkey").alias("form"), F.col("s_suppkey").alias("id"), F.lit("alias").alias("kind")))
    # one row per form, so that asking a common form does not multiply its holders
    gene = F.col("label") == "Gene"
    held = forms.groupBy("form").agg(
        F.countDistinct(F.when(gene & (F.col("kind") == "name"), F.col("id"))).alias("exact"), F.countDistinct(F.when(gene & (F.col("kind") == "alias"), F.col("id"))).alias("alias"),
        F.count_if(~gene).alias("other"))
    segment, nation = F.col("c_mktsegment"), F.col("c_nationkey").cast("string")
    asked = F.when(segment == "BUILDING", F.concat(F.lit("SUPPLIER#"), F.lpad(nation, 9, "0"))).when(segment == "MACHINERY", F.concat(F.lit("Gene "), nation)).when(segment == "HOUSEHOLD", "Small Ring").otherwise(F.concat(F.lit("nobody "), "c_custkey"))
    rows = g.read("customer").select(F.col("c_custkey").alias("ask"), F.lower(asked).alias("form")).join(held, "form", "left")
    status = F.when(F.col("exact") == 1, "RESOLVED_EXACT").when(F.col("exact") > 1, "AMBIGUOUS").when(F.col("alias") == 1, "RESOLVED_ALIAS").when((F.col("alias") > 1) | (F.col("other") > 0), "AMBIGUOUS").otherwise("NEW")
    return rows.select("ask", status.alias("status"))


_OLD = "old AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS segment, c_nationkey AS status, [c_mktsegment] AS routes FROM customer WHERE c_acctbal > -500)"
_NEW = "new AS (SELECT o_custkey AS id, max(CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'Order ' || o_orderkey END) AS name, max(o_orderpriority) AS segment, 99 AS status, [max(o_orderstatus), min(o_orderstatus)] AS routes FROM orders GROUP BY o_custkey)"


@query(f"""
WITH {_OLD}, {_NEW}
SELECT coalesce(o.id, n.id) AS id, CASE WHEN trim(n.name) <> '' THEN n.name ELSE o.name END AS name, coalesce(o.segment, n.segment) AS segment, CASE WHEN o.id IS NOT NULL THEN o.status ELSE n.status END AS status,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(o.routes, []), coalesce(n.routes, [])))), ',') AS routes FROM old o FULL JOIN new n ON o.id = n.id
""", plain=True)
def K01_X02_X03_upsert(g: Graph) -> DataFrame:
    """Names change only to something, segments are back-filled, status belongs to the creator, routes accumulate."""
    customer, orders = g.read("customer"), g.read("orders")
    old = customer.where("c_acctbal > -500").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("segment"), F.col("c_nationkey").alias("status"), F.array("c_mktsegment").alias("routes"))
    name = F.when(F.col("o_orderstatus") == "F", "").otherwise(F.concat(F.lit("Order "), "o_orderkey"))
    new = orders.groupBy(F.col("o_custkey").alias("id")).agg(F.max(name).alias("name"), F.max("o_orderpriority").alias("segment"), F.lit(99).alias("status"), F.array(F.max("o_orderstatus"), F.min("o_orderstatus")).alias("routes"))
    out = M.upsert(old, new, "id", create_only=("status",), back_fill=("segment",), non_empty=("name",), append=("routes",))
    return out.withColumn("routes", F.array_join(F.array_sort("routes"), ","))


@query(f"""
WITH {_OLD}, {_NEW}
SELECT coalesce(o.id, n.id) AS id, CASE WHEN trim(n.name) <> '' THEN n.name ELSE o.name END AS name, coalesce(o.segment, n.segment) AS segment, CASE WHEN o.id IS NOT NULL THEN o.status ELSE n.status END AS status, 2 AS version FROM old o FULL JOIN new n ON o.id = n.id
""", plain=True)
def K01_K11_stored_upsert(g: Graph) -> DataFrame:
    """The same upsert into a stored table, merged again, which changes nothing; one more that breaks a constraint leaves it as it is."""
    customer, orders = g.read("customer"), g.read("orders")
    old = customer.where("c_acctbal > -500").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("segment"), F.col("c_nationkey").alias("status"))
    name = F.when(F.col("o_orderstatus") == "F", "").otherwise(F.concat(F.lit("Order "), "o_orderkey"))
    new = orders.groupBy(F.col("o_custkey").alias("id")).agg(F.max(name).alias("name"), F.max("o_orderpriority").alias("segment"), F.lit(99).alias("status"))
    store = Store(g.spark, table_path(g.spark, "store"), "id", "id long, name string, segment string, status int", required=("status",), buckets=8)
    policy = {"create_only": ("status",), "back_fill": ("segment",), "non_empty": ("name",)}
    store.merge(old, **policy)
    store.merge(new, **policy)
    again = store.merge(new, **policy)
    with contextlib.suppress(ConstraintError):
        store.merge(orders.select((-F.col("o_orderkey") - 1).alias("id"), F.lit("x").alias("name"), F.lit("x").alias("segment"), F.lit(None).cast("int").alias("status")), **policy)
    return store.read().withColumn("version", F.lit(again))


@query("""
WITH used AS (SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_quantity > 49)
SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT id, 'on demand' FROM used WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = used.id AND s.s_acctbal > 0)
""", plain=True)
def K05_created_on_demand(g: Graph) -> DataFrame:
    known = g.read("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    used = g.read("lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("id")).distinct()
    return known.unionByName(used.join(known, "id", "left_anti").select("id", F.lit("on demand").alias("name")))


@query("""
WITH known AS (SELECT p_name AS term, 'bv:' || lpad(CAST(min(p_partkey) + 1 AS VARCHAR), 4, '0') AS id, min(p_partkey) + 1 AS n FROM part WHERE p_type = 'ECONOMY' GROUP BY p_name),
fresh AS (SELECT p_name || '/' || p_brand AS term, min(p_partkey) AS pos FROM part GROUP BY 1)
SELECT term, id FROM known UNION ALL
SELECT term, 'bv:' || CASE WHEN length(CAST(k AS VARCHAR)) >= 4 THEN CAST(k AS VARCHAR) ELSE lpad(CAST(k AS VARCHAR), 4, '0') END FROM (SELECT term, (SELECT max(n) FROM known) + row_number() OVER (ORDER BY pos, term) AS k FROM fresh WHERE term NOT IN (SELECT term FROM known))
""", plain=True)
def K06_S12_stable_ids(g: Graph) -> DataFrame:
    part = g.read("part")
    known = part.where("p_type = 'ECONOMY'").groupBy(F.col("p_name").alias("term")).agg(F.concat(F.lit("bv:"), F.lpad((F.min("p_partkey") + 1).cast("string"), 4, "0")).alias("id"))
    return M.stable_ids(known, part.select(F.concat_ws("/", "p_name", "p_brand").alias("term"), F.col("p_partkey").alias("pos")), "term", "pos")


@query("""
WITH decided AS (SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_orderstatus <> 'P' THEN 'already decided' WHEN o_totalprice > 150000 THEN 'ACCEPTED' ELSE 'REJECTED' END AS outcome FROM orders)
SELECT outcome, count(*) AS n, min(id) AS first FROM decided GROUP BY outcome
""", plain=True)
def K08_decisions(g: Graph) -> DataFrame:
    """A pending candidate is decided once; others are refused."""
    outcome = F.when(F.col("o_orderstatus") != "P", "already decided").when(F.col("o_totalprice") > 150000, "ACCEPTED").otherwise("REJECTED")
    return g.read("orders").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))


@query("""
WITH first AS (SELECT least(trait_id, gene_id) AS s, greatest(trait_id, gene_id) AS o, CASE stance WHEN 'SUPPORTS' THEN 'source:' ELSE 'inferred:' END || experiment_no AS basis, min(paper_id) AS pos FROM evidence GROUP BY ALL)
SELECT s, o, string_agg(basis, ' | ' ORDER BY CASE WHEN basis LIKE 'source:%' THEN 0 ELSE 1 END, pos, basis) AS basis FROM first GROUP BY s, o
""")
def K09_relation_upsert(g: Graph) -> DataFrame:
    """Symmetric relations have their ends in order, and bases that are stated come first."""
    rows = g.evidence.select(F.least("trait_id", "gene_id").alias("s"), F.greatest("trait_id", "gene_id").alias("o"), F.concat(F.when(F.col("stance") == "SUPPORTS", "source:").otherwise("inferred:"), "experiment_no").alias("basis"), "paper_id")
    return M.merged_basis(rows, ["s", "o"], "basis", "paper_id")


_RANK = "CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'signup' THEN 3 ELSE 8 END"


@query(f"SELECT user_id, max({_RANK}) AS state_rank, count(*) AS n_events FROM events GROUP BY user_id", plain=True)
def X01_monotone_state(g: Graph) -> DataFrame:
    return M.advanced(transitions(g.read("events")), "user_id", "state_rank")


def state_rank() -> Column:
    kind = F.col("event_type")
    return F.when(kind == "view", 0).when(kind == "click", 1).when(kind == "error", 2).when(kind == "signup", 3).otherwise(8)


def transitions(events: DataFrame) -> DataFrame:
    return events.select("event_id", "ts", "user_id", state_rank().alias("state_rank"))


@query("SELECT user_id, event_type, min(ts) AS created_at, max(ts) AS last_seen, count(*) - 1 AS seen_again FROM events GROUP BY user_id, event_type", plain=True)
def X04_idempotent_stage(g: Graph) -> DataFrame:
    return g.read("events").groupBy("user_id", "event_type").agg(F.min("ts").alias("created_at"), F.max("ts").alias("last_seen"), (F.count(F.lit(1)) - 1).alias("seen_again"))


@query("SELECT paper_id, CASE WHEN state = 'ACCEPTED' THEN 'ACCEPTED' ELSE coalesce(CASE WHEN journal <> '5-LOW' THEN state END, 'ACCEPTED') END AS state FROM paper")
def X07_adopt_seeds(g: Graph) -> DataFrame:
    """Papers without a state count as accepted."""
    state = F.when(F.col("journal") != "5-LOW", F.col("state"))
    return g.paper.select("paper_id", F.coalesce(state, F.lit("ACCEPTED")).alias("state"))


_FOLLOWING = """links AS (SELECT o_orderkey AS pos, CASE o_orderstatus WHEN 'F' THEN 'MED' WHEN 'O' THEN 'PMC' ELSE 'AGR' END AS source, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 9 END AS rank,
  o_custkey AS id, 'title ' || o_custkey AS title FROM orders),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY rank, pos) AS n, count(*) OVER (PARTITION BY title) AS routes FROM links) WHERE n = 1)"""


@query(f"WITH {_FOLLOWING} SELECT pos, source, id, title, routes FROM kept", plain=True)
def W11_dedupe_links(g: Graph) -> DataFrame:
    """The first by source rank and position of each title, where titles follow ids."""
    links = _links(g).withColumn("title", F.concat(F.lit("title "), "id"))
    best = F.min(F.struct("rank", "pos", "source", "id")).alias("first")
    return links.groupBy("title").agg(best, F.count(F.lit(1)).alias("routes")).select("first.pos", "first.source", "first.id", "title", "routes")


#: Published before preprint; ids and titles clash in different ways, and some titles are empty.
_LINKS = """links AS (SELECT o_orderkey AS pos, CASE o_orderstatus WHEN 'F' THEN 'MED' WHEN 'O' THEN 'PMC' ELSE 'AGR' END AS source, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 9 END AS rank,
  o_custkey AS id, CASE WHEN o_orderkey % 13 <> 0 THEN 'title ' || o_orderkey % 4000 END AS title FROM orders),
ordered AS (SELECT *, row_number() OVER (ORDER BY rank, pos) AS n, source || '|' || id AS i, title AS t FROM links)"""


def _links(g: Graph) -> DataFrame:
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    return g.read("orders").select(
        key.alias("pos"), F.when(status == "F", "MED").when(status == "O", "PMC").otherwise("AGR").alias("source"), F.when(status == "F", 0).when(status == "O", 1).otherwise(9).alias("rank"),
        F.col("o_custkey").alias("id"), F.when(key % 13 != 0, F.concat(F.lit("title "), key % 4000)).alias("title"))


@query(f"WITH RECURSIVE {_LINKS}, {GREEDY.strip()} SELECT pos, source, id, title, routes FROM ordered JOIN standing USING (n)", plain=True)
def W11_H6_greedy_dedupe(g: Graph) -> DataFrame:
    """Links that share no id and no title with an earlier kept one, and how many each stands for."""
    return with_routes(_links(g), [F.col("rank"), F.col("pos")], ["source", "id"], F.col("title")).drop("rank")


@query("SELECT count(*) AS papers, (count(*) + 19) // 20 AS batches FROM (SELECT DISTINCT o_custkey FROM orders)", plain=True)
def J22_batches(g: Graph) -> DataFrame:
    rows = g.read("orders").select("o_custkey").distinct().agg(F.count(F.lit(1)).alias("papers"))
    return rows.withColumn("batches", F.expr("(papers + 19) div 20"))


@query("""
SELECT o.o_orderkey AS id, n.n_nationkey AS bin FROM orders o JOIN nation n ON o.o_totalprice >= n.n_nationkey * 20000 AND o.o_totalprice < n.n_nationkey * 20000 + 30000
""", plain=True)
def J27_range_join(g: Graph) -> DataFrame:
    """Beyond the model's own joins: points in overlapping intervals, by an equi join on buckets of the interval step."""
    step = 20000
    intervals = g.read("nation").select(F.col("n_nationkey").alias("bin"), (F.col("n_nationkey") * step).alias("low")).withColumn("high", F.col("low") + 30000)
    intervals = intervals.withColumn("bucket", F.explode(F.sequence((F.col("low") / step).cast("long"), ((F.col("high") - 1) / step).cast("long"))))
    points = g.read("orders").select(F.col("o_orderkey").alias("id"), "o_totalprice", F.floor(F.col("o_totalprice") / step).alias("bucket"))
    met = points.join(small(intervals), "bucket").where((F.col("o_totalprice") >= F.col("low")) & (F.col("o_totalprice") < F.col("high")))
    return met.select("id", "bin")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2", plain=True)
def X_tumbling_windows(g: Graph) -> DataFrame:
    """Beyond the model's own operators: hourly windows of events."""
    return g.read("events").groupBy(F.window("ts", "1 hour")["start"].alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"))
