"""Crosses over the customers as parents, and the published crosses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph import fixed
from loomgraph.operators import crosses as X
from loomgraph.operators import layer as L
from loomgraph.operators import phenotypes as P
from loomgraph.operators.storage import small, written
from loomgraph.plans.base import Graph, query
from loomgraph.plans.record_queries import pick

#: Two autosomal loci and a sex-linked one; A hides B, and C is A with X.
RULES = X.Rules(
    {"A": ("l1", True), "a": ("l1", False), "B": ("l2", True), "b": ("l2", False), "X": ("sx", True), "x": ("sx", False)}, frozenset({"sx"}),
    {("A", "a"): "full", ("B", "b"): "partial", ("X", "x"): "full"}, {"Ta": ("a",), "Tb": ("b",), "Tx": ("x",)}, (("Ta", "Tb"),), {"Tc": ("Ta", "Tx")},
)

_PARENTS = """
WITH parents AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 128 < 64 THEN 'female' ELSE 'male' END AS sex,
  CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'a' END AS l1a, CASE WHEN c_custkey % 4 < 2 THEN 'A' ELSE 'a' END AS l1b, CASE WHEN c_custkey % 8 < 4 THEN 'B' ELSE 'b' END AS l2a,
  CASE WHEN c_custkey % 16 < 8 THEN 'B' ELSE 'b' END AS l2b, CASE WHEN c_custkey % 32 < 16 THEN 'X' ELSE 'x' END AS sx1, CASE WHEN c_custkey % 64 < 32 THEN 'X' ELSE 'x' END AS sx2 FROM customer),
pick AS (SELECT * FROM (VALUES (0), (1)) AS t(v)),
kids AS (SELECT m.id, s.sex, CASE p1.v WHEN 0 THEN m.l1a ELSE m.l1b END AS a1, CASE q1.v WHEN 0 THEN f.l1a ELSE f.l1b END AS a2, CASE p2.v WHEN 0 THEN m.l2a ELSE m.l2b END AS b1, CASE q2.v WHEN 0 THEN f.l2a ELSE f.l2b END AS b2,
  CASE p3.v WHEN 0 THEN m.sx1 ELSE m.sx2 END AS x1, CASE s.sex WHEN 'female' THEN f.sx1 ELSE f.sx2 END AS x2
  FROM parents m JOIN parents f ON f.id = m.id + 64 AND m.sex = 'female' AND f.sex = 'male', pick p1, pick q1, pick p2, pick q2, pick p3, (VALUES ('female'), ('male')) AS s(sex)),
states AS (SELECT id, sex, CASE WHEN a1 = 'a' AND a2 = 'a' THEN 3 ELSE 0 END AS ta, CASE WHEN b1 = 'b' AND b2 = 'b' THEN 3 WHEN b1 = 'b' OR b2 = 'b' THEN 2 ELSE 0 END AS tb, CASE WHEN x1 = 'x' AND x2 = 'x' THEN 3 ELSE 0 END AS tx FROM kids),
seen AS (SELECT id, sex, ta, tb, tx, ta = 3 AND tx = 3 AS tc, ta = 3 AND tb > 0 AS hides FROM states),
named AS (SELECT id, sex, hides, coalesce(nullif(concat_ws(', ', CASE WHEN ta = 3 AND NOT tc THEN 'Ta' END, CASE WHEN NOT hides AND tb = 3 THEN 'Tb' WHEN NOT hides AND tb = 2 THEN 'Tb (partial)' END,
  CASE WHEN tc THEN 'Tc' END, CASE WHEN tx = 3 AND NOT tc THEN 'Tx' END), ''), 'none of the modelled traits') AS class FROM seen),
counted AS (SELECT id, sex, class, count(*) AS weight, 32 AS whole FROM named GROUP BY ALL UNION ALL SELECT id, 'overall', class, count(*), 64 FROM named GROUP BY id, class)
"""


def _crosses(g: Graph) -> DataFrame:
    k = F.col("c_custkey")
    alleles = [((2, 1), (4, 2), "A"), ((8, 4), (16, 8), "B"), ((32, 16), (64, 32), "X")]
    pairs = [F.array(*(F.when(k % m < half, s).otherwise(s.lower()) for m, half in (one, two))) for one, two, s in alleles]
    parents = g.read("customer").select(k.alias("id"), *(p.alias(f"p_{i}") for i, p in enumerate(pairs)))
    mothers = parents.where(F.col("id") % 128 < 64).withColumnsRenamed({f"p_{i}": f"m_{i}" for i in range(3)})
    fathers = parents.where(F.col("id") % 128 >= 64).withColumnsRenamed({f"p_{i}": f"f_{i}" for i in range(3)}).withColumn("id", F.col("id") - 64)
    return mothers.join(fathers, "id")


@query(_PARENTS + "SELECT id, sex, class, (weight // gcd(weight, whole)) || '/' || (whole // gcd(weight, whole)) AS share FROM counted", plain=True)
def Q30_Q33_J25_A22_A24_T34_T35_crosses(g: Graph) -> DataFrame:
    return X.shares(X.classes(_crosses(g), RULES, "id"))


@query(_PARENTS + "SELECT id, sex, class, 'Tb' AS victim, count(*) FILTER (WHERE hides)::BIGINT AS part, count(*)::BIGINT AS total FROM named GROUP BY ALL HAVING count(*) FILTER (WHERE hides) > 0", plain=True)
def A23_hidden_mass(g: Graph) -> DataFrame:
    return X.hidden(_crosses(g), RULES, "id").withColumnRenamed("of", "total").drop("maskers")


@query("""
SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 16 < 4 AND c_custkey % 64 < 16 THEN 'wild type throughout' ELSE shown END AS genotype FROM (
  SELECT c_custkey, concat_ws(' ', CASE WHEN a <> 'A/A' THEN a END, CASE WHEN b <> 'B/B' THEN b END, CASE WHEN x <> 'X^X X^X' THEN x END) AS shown FROM (
    SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'a' END || '/' || CASE WHEN c_custkey % 4 < 2 THEN 'A' ELSE 'a' END AS a, CASE WHEN c_custkey % 8 < 4 THEN 'B' ELSE 'b' END || '/' || CASE WHEN c_custkey % 16 < 8 THEN 'B' ELSE 'b' END AS b,
      'X^' || CASE WHEN c_custkey % 32 < 16 THEN 'X' ELSE 'x' END || ' X^' || CASE WHEN c_custkey % 64 < 32 THEN 'X' ELSE 'x' END AS x FROM customer)) WHERE true
""", plain=True)
def T32_T33_show_genotypes(g: Graph) -> DataFrame:
    k = F.col("c_custkey")
    alleles = [((2, 1), (4, 2), "A"), ((8, 4), (16, 8), "B"), ((32, 16), (64, 32), "X")]
    pairs = [F.array(*(F.when(k % m < half, s).otherwise(s.lower()) for m, half in (one, two))).alias(f"p_{i}") for i, (one, two, s) in enumerate(alleles)]
    return g.read("customer").select(k.alias("id"), *pairs).select("id", X.show(RULES, X.FEMALE, "p").alias("genotype"))


_GOLDEN = [
    ("maintenance", "b/b r/r", "b/b r/R"), ("backcross", "B/b R/r", "b/b r/r"), ("sex linked", "B/b R/r", "B/b R/r"), ("two loci", "I/i pd/pd+", "I/i pd/pd+"),
    ("dominant", "RLF/RLF", "rlf+/rlf+"),
]
_NONE = X.NOTHING
_EXPECTED = [
    ("maintenance", "female", "white", "1/1"), ("maintenance", "male", "yellow", "1/1"), ("maintenance", "overall", "white", "1/2"), ("maintenance", "overall", "yellow", "1/2"),
    *(("backcross", sex, c, "1/4") for sex in ("female", "male", "overall") for c in ("white", "blue", "yellow", _NONE)),
    ("sex linked", "female", _NONE, "3/4"), ("sex linked", "female", "yellow", "1/4"), ("sex linked", "male", _NONE, "3/8"), ("sex linked", "male", "blue", "3/8"),
    ("sex linked", "male", "yellow", "1/8"), ("sex linked", "male", "white", "1/8"), ("sex linked", "overall", _NONE, "9/16"), ("sex linked", "overall", "yellow", "3/16"),
    ("sex linked", "overall", "blue", "3/16"), ("sex linked", "overall", "white", "1/16"),
    *(("two loci", sex, c, p) for sex in ("female", "male", "overall") for c, p in ((_NONE, "9/16"), ("albino", "3/16"), ("panda", "3/16"), ("seethrough", "1/16"))),
    *(("dominant", sex, "reallongfin", "1/1") for sex in ("female", "male", "overall")),
]


@query("SELECT c_custkey AS id, sex, class, share FROM customer JOIN (VALUES " + ", ".join(f"({next(k for k, x in enumerate(_GOLDEN) if x[0] == a)}, '{b}', '{c}', '{d}')" for a, b, c, d in _EXPECTED) + f") AS t(k, sex, class, share) ON k = c_custkey % {len(_GOLDEN)}", plain=True)
def Q30_golden_crosses(g: Graph) -> DataFrame:
    """Each customer asks for one of the published crosses, as text; the SQL has the published shares."""
    rules, k = X.seed_rules(), F.col("c_custkey")
    asked = g.read("customer").select(k.alias("id"), pick([m for _, m, _ in _GOLDEN], k).alias("mother"), pick([f for _, _, f in _GOLDEN], k).alias("father"))
    # equal crosses are worked out once
    each = asked.select("mother", "father").distinct()
    for p, text, sex in (("m", "mother", X.FEMALE), ("f", "father", X.MALE)):
        pairs, error = X.parse_column(rules, F.col(text), sex)
        each = each.where(error.isNull()).select("*", *(pair.alias(f"{p}_{i}") for i, pair in enumerate(pairs)))
    each = written(each.withColumn("cross", F.struct("mother", "father")))
    found = X.shares(X.classes(each, rules, "cross")).select("cross.*", "sex", "class", "share")
    return asked.join(small(written(found)), ["mother", "father"]).select("id", "sex", "class", "share")


#: What customers are seen to show: any of four traits and one that nobody knows, whatever their genotypes; some lines are said to breed true.
_SEEN = ("Ta", "Tb", "Tc", "Tx")
_PAIRS = """
seen AS (SELECT c_custkey AS id, list_concat(""" + ", ".join(f"CASE WHEN c_custkey // 3 % {2 << i} >= {1 << i} THEN ['{t}'] ELSE [] END" for i, t in enumerate(_SEEN)) + """, CASE WHEN c_nationkey = 7 THEN ['Tz'] ELSE [] END) AS shows FROM customer),
pairs AS (SELECT m.id, m.shows AS ms, f.shows AS fs, m.id % 5 = 0 AS fixed FROM seen m JOIN seen f ON f.id = m.id + 64 WHERE m.id % 128 < 64)"""
_RANGES = f"""
WITH {_PAIRS.strip()},
genos AS (SELECT s.sex, p.a1, p.a2, q.b1, q.b2, r.x1, r.x2 FROM (VALUES ('female'), ('male')) AS s(sex), (VALUES ('A', 'A'), ('A', 'a'), ('a', 'a')) AS p(a1, a2), (VALUES ('B', 'B'), ('B', 'b'), ('b', 'b')) AS q(b1, b2),
  (VALUES ('X', 'X'), ('X', 'x'), ('x', 'X'), ('x', 'x')) AS r(x1, x2) WHERE s.sex = 'male' OR r.x1 <= r.x2),
called AS (SELECT *, a1 = 'a' AND a2 = 'a' AS ta, x1 = 'x' AND x2 = 'x' AS tx, b1 = 'b' OR b2 = 'b' AS tb FROM genos),
told AS (SELECT *, list_concat(CASE WHEN ta AND NOT tx THEN ['Ta'] ELSE [] END, CASE WHEN tb AND NOT ta THEN ['Tb'] ELSE [] END, CASE WHEN ta AND tx THEN ['Tc'] ELSE [] END, CASE WHEN tx AND NOT ta THEN ['Tx'] ELSE [] END) AS shown FROM called),
asked AS (SELECT DISTINCT sex, shows, fixed, list_has_any(shows, ['Ta', 'Tb', 'Tc']) AS l1, list_contains(shows, 'Tb') AS l2, list_has_any(shows, ['Tc', 'Tx']) AS lx,
    list_concat(CASE WHEN list_has_any(shows, ['Ta', 'Tb', 'Tc']) THEN ['Ta'] ELSE [] END, CASE WHEN list_contains(shows, 'Tb') THEN ['Tb'] ELSE [] END, CASE WHEN list_contains(shows, 'Tc') THEN ['Tc'] ELSE [] END, CASE WHEN list_has_any(shows, ['Tc', 'Tx']) THEN ['Tx'] ELSE [] END) AS near
  FROM (SELECT 'female' AS sex, ms AS shows, fixed FROM pairs UNION SELECT 'male', fs, fixed FROM pairs)),
found AS (SELECT k.sex, k.shows, k.fixed, t.a1, t.a2, t.b1, t.b2, t.x1, t.x2 FROM asked k JOIN told t ON t.sex = k.sex AND (k.l1 OR (t.a1 = 'A' AND t.a2 = 'A')) AND (k.l2 OR (t.b1 = 'B' AND t.b2 = 'B')) AND (k.lx OR (t.x1 = 'X' AND t.x2 = 'X'))
  AND (NOT k.fixed OR (t.a1 = t.a2 AND t.b1 = t.b2 AND t.x1 = t.x2)) AND list_filter(t.shown, lambda x: list_contains(k.near, x)) = k.shows WHERE len(k.shows) > 0),
counts AS (SELECT sex, shows, fixed, count(*) AS n FROM found GROUP BY ALL),
combos AS (SELECT DISTINCT ms, fs, fixed FROM pairs),
verdicts AS (SELECT c.ms, c.fs, c.fixed, m.n AS n_mothers, f.n AS n_fathers, coalesce(
    CASE WHEN len(c.ms) = 0 THEN 'input: name at least one trait' WHEN list_contains(c.ms, 'Tz') THEN 'input: unknown trait Tz' WHEN m.n IS NULL THEN 'input: no genotype shows exactly ' || array_to_string(c.ms, ', ') END,
    CASE WHEN len(c.fs) = 0 THEN 'input: name at least one trait' WHEN list_contains(c.fs, 'Tz') THEN 'input: unknown trait Tz' WHEN f.n IS NULL THEN 'input: no genotype shows exactly ' || array_to_string(c.fs, ', ') END) AS error
  FROM combos c LEFT JOIN counts m ON m.sex = 'female' AND m.shows = c.ms AND m.fixed = c.fixed LEFT JOIN counts f ON f.sex = 'male' AND f.shows = c.fs AND f.fixed = c.fixed),
crossed AS (SELECT row_number() OVER () AS cross_id, v.ms, v.fs, v.fixed, m.a1 AS ma1, m.a2 AS ma2, m.b1 AS mb1, m.b2 AS mb2, m.x1 AS mx1, m.x2 AS mx2, f.a1 AS fa1, f.a2 AS fa2, f.b1 AS fb1, f.b2 AS fb2, f.x1 AS fx1, f.x2 AS fx2
  FROM verdicts v JOIN found m ON m.sex = 'female' AND m.shows = v.ms AND m.fixed = v.fixed JOIN found f ON f.sex = 'male' AND f.shows = v.fs AND f.fixed = v.fixed WHERE v.error IS NULL),
pick AS (SELECT * FROM (VALUES (0), (1)) AS t(v)),
kids AS (SELECT c.cross_id, s.sex, CASE p1.v WHEN 0 THEN ma1 ELSE ma2 END AS a1, CASE q1.v WHEN 0 THEN fa1 ELSE fa2 END AS a2, CASE p2.v WHEN 0 THEN mb1 ELSE mb2 END AS b1, CASE q2.v WHEN 0 THEN fb1 ELSE fb2 END AS b2,
  CASE p3.v WHEN 0 THEN mx1 ELSE mx2 END AS x1, CASE s.sex WHEN 'female' THEN fx1 ELSE fx2 END AS x2 FROM crossed c, pick p1, pick q1, pick p2, pick q2, pick p3, (VALUES ('female'), ('male')) AS s(sex)),
states AS (SELECT cross_id, sex, a1 = 'a' AND a2 = 'a' AS ta, (b1 = 'b')::INT + (b2 = 'b')::INT AS tb, x1 = 'x' AND x2 = 'x' AS tx FROM kids),
named AS (SELECT cross_id, sex, coalesce(nullif(concat_ws(', ', CASE WHEN ta AND NOT tx THEN 'Ta' END, CASE WHEN NOT ta AND tb = 2 THEN 'Tb' WHEN NOT ta AND tb = 1 THEN 'Tb (partial)' END, CASE WHEN ta AND tx THEN 'Tc' END, CASE WHEN tx AND NOT ta THEN 'Tx' END), ''), 'none of the modelled traits') AS class FROM states),
counted AS (SELECT cross_id, sex, class, count(*) AS weight, 32 AS whole FROM named GROUP BY ALL UNION ALL SELECT cross_id, 'overall', class, count(*), 64 FROM named GROUP BY cross_id, class),
spans AS (SELECT ms, fs, fixed, sex, class, max(weight) AS high, CASE WHEN count(*) < any_value(v.n_mothers * v.n_fathers) THEN 0 ELSE min(weight) END AS low, any_value(whole) AS whole FROM counted JOIN crossed USING (cross_id) JOIN verdicts v USING (ms, fs, fixed) GROUP BY ALL)
"""


def _observed(g: Graph) -> DataFrame:
    k = F.col("c_custkey")
    bits = [F.when(F.expr(f"c_custkey div 3 % {2 << i} >= {1 << i}"), t) for i, t in enumerate(_SEEN)]
    seen = g.read("customer").select(k.alias("id"), F.array_compact(F.array(*bits, F.when(F.col("c_nationkey") == 7, "Tz"))).alias("shows"))
    mothers = seen.where("id % 128 < 64").select("id", F.col("shows").alias("mother_shows"), (F.col("id") % 5 == 0).alias("true_breeding"))
    return mothers.join(seen.select((F.col("id") - 64).alias("id"), F.col("shows").alias("father_shows")), "id")


@query(_RANGES + """SELECT p.id, s.sex, s.class, (s.low // gcd(s.low, s.whole)) || '/' || (s.whole // gcd(s.low, s.whole)) AS low, (s.high // gcd(s.high, s.whole)) || '/' || (s.whole // gcd(s.high, s.whole)) AS high,
  CASE WHEN error IS NULL THEN n_mothers END AS n_mothers, CASE WHEN error IS NULL THEN n_fathers END AS n_fathers, error FROM pairs p JOIN verdicts v USING (ms, fs, fixed) LEFT JOIN spans s USING (ms, fs, fixed)""", plain=True)
def Q31_Q32_J26_A25_U06_ranges(g: Graph) -> DataFrame:
    """Customers crossed by what they show: ranges of every class over all genotypes that show it, or why there are none."""
    return P.ranges(_observed(g), RULES)


@query()
def Q32_T39_range_documents(g: Graph) -> DataFrame:
    """The same as documents."""
    return P.range_documents(_observed(g), RULES)


#: The layer over the tables: claims that need alleles, composites (some part of themselves), modes, and what masks what.
_LAYER = """
layer AS (SELECT 'r' || trait_id || '-' || gene_id AS claim_id, 'requires_allele' AS predicate, trait_id AS subject, gene_id::VARCHAR AS object, best_rank AS rank, n_supports > 0 AND n_contradicts > 0 AS disputed FROM claim WHERE predicate = 'requires_allele' AND best_rank >= 40 AND trait_id % 4 <> 0
  UNION ALL SELECT 'c' || p_partkey || '-' || d, 'composed_of', p_partkey, (p_partkey + d)::VARCHAR, p_size, p_size = 13 FROM part, (VALUES (1), (3)) AS t(d) WHERE p_size BETWEEN 10 AND 16
  UNION ALL SELECT 'b' || p_partkey, 'composed_of', p_partkey, (p_partkey - 1)::VARCHAR, 20, false FROM part WHERE p_size = 17
  UNION ALL SELECT 'i' || p_partkey, 'inherited_as', p_partkey, CASE WHEN p_size % 3 = 0 THEN 'multilocus' ELSE 'recessive' END, 20, false FROM part WHERE p_size % 4 = 1
  UNION ALL SELECT 'm' || subject_id || '-' || object_id, 'masks', subject_id, object_id::VARCHAR, 5, false FROM subsumes
  UNION ALL SELECT 'a' || s_suppkey, 'allele_of', s_suppkey, s_nationkey::VARCHAR, 50, false FROM supplier
  UNION ALL SELECT 'd' || s_suppkey || '-' || d, CASE WHEN d = 2 THEN 'incompletely_dominant_over' ELSE 'dominant_over' END, s_suppkey, (s_suppkey + d)::VARCHAR, (s_suppkey + d) % 7 * 10, s_suppkey * d % 29 = 0 FROM supplier, (VALUES (1), (2), (3), (4), (5)) AS t(d)),
needs AS (SELECT DISTINCT subject AS trait FROM layer WHERE predicate = 'requires_allele'), whole AS (SELECT DISTINCT subject AS trait FROM layer WHERE predicate = 'composed_of'),
edges AS (SELECT DISTINCT subject AS trait, object::BIGINT AS below FROM layer WHERE predicate = 'composed_of' AND subject NOT IN (SELECT trait FROM needs)),
down AS (SELECT trait, below FROM edges UNION SELECT r.trait, e.below FROM down r JOIN edges e ON e.trait = r.below),
circular AS (SELECT trait FROM down WHERE trait = below),
spoiled AS (SELECT DISTINCT trait FROM down WHERE below IN (SELECT trait FROM circular) OR (below NOT IN (SELECT trait FROM needs) AND below NOT IN (SELECT trait FROM whole))),
has_model AS (SELECT trait FROM needs UNION SELECT trait FROM whole WHERE trait NOT IN (SELECT trait FROM spoiled)),
own AS (SELECT trait, trait AS below FROM needs UNION SELECT trait, trait FROM whole UNION SELECT trait, below FROM down),
facts AS (SELECT subject AS below, claim_id, rank, disputed FROM layer WHERE predicate = 'requires_allele' UNION ALL SELECT subject, claim_id, rank, disputed FROM layer WHERE predicate = 'composed_of' AND subject NOT IN (SELECT trait FROM needs)
  UNION ALL SELECT object::BIGINT, claim_id, rank, disputed FROM layer WHERE predicate = 'masks'),
loci AS (SELECT DISTINCT own.trait, a.object AS locus FROM own JOIN layer r ON r.subject = own.below AND r.predicate = 'requires_allele' JOIN layer a ON a.subject = r.object::BIGINT AND a.predicate = 'allele_of'),
locus_facts AS (SELECT a.object AS locus, d.claim_id, d.rank, d.disputed FROM layer d JOIN layer a ON a.subject = d.subject AND a.predicate = 'allele_of' JOIN layer b ON b.subject = d.object::BIGINT AND b.predicate = 'allele_of' AND b.object = a.object
  WHERE d.predicate IN ('dominant_over', 'incompletely_dominant_over')),
rests AS (SELECT DISTINCT trait, claim_id, rank, disputed FROM own JOIN facts USING (below) UNION SELECT trait, claim_id, rank, disputed FROM loci JOIN locus_facts USING (locus))
"""


def _layer(g: Graph) -> DataFrame:
    part, size, p = g.read("part"), F.col("p_size"), F.col("p_partkey")
    disputed = (F.col("n_supports") > 0) & (F.col("n_contradicts") > 0)
    needs = g.claim.where("predicate = 'requires_allele' AND best_rank >= 40 AND trait_id % 4 <> 0").select(F.concat(F.lit("r"), "trait_id", F.lit("-"), "gene_id").alias("claim_id"), F.lit("requires_allele").alias("predicate"), F.col("trait_id").alias("subject"), F.col("gene_id").cast("string").alias("object"), F.col("best_rank").alias("rank"), disputed.alias("disputed"))
    made = part.where("p_size BETWEEN 10 AND 16").withColumn("d", F.explode(F.array(F.lit(1), F.lit(3)))).select(F.concat(F.lit("c"), p, F.lit("-"), "d"), F.lit("composed_of"), p, (p + F.col("d")).cast("string"), size, size == 13)
    back = part.where("p_size = 17").select(F.concat(F.lit("b"), p), F.lit("composed_of"), p, (p - 1).cast("string"), F.lit(20), F.lit(False))
    modes = part.where("p_size % 4 = 1").select(F.concat(F.lit("i"), p), F.lit("inherited_as"), p, F.when(size % 3 == 0, "multilocus").otherwise("recessive"), F.lit(20), F.lit(False))
    masks = g.subsumes.select(F.concat(F.lit("m"), "subject_id", F.lit("-"), "object_id"), F.lit("masks"), "subject_id", F.col("object_id").cast("string"), F.lit(5), F.lit(False))
    supplier, s = g.read("supplier"), F.col("s_suppkey")
    alleles = supplier.select(F.concat(F.lit("a"), s), F.lit("allele_of"), s, F.col("s_nationkey").cast("string"), F.lit(50), F.lit(False))
    over = supplier.withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(5)))).select(
        F.concat(F.lit("d"), s, F.lit("-"), "d"), F.when(F.col("d") == 2, "incompletely_dominant_over").otherwise("dominant_over"), s, (s + F.col("d")).cast("string"), ((s + F.col("d")) % 7 * 10).cast("int"), s * F.col("d") % 29 == 0)
    return L.written(needs.union(made).union(back).union(modes).union(masks).union(alleles).union(over))


@query(f"WITH {_LAYER} SELECT trait, (SELECT count(*) FROM down d WHERE d.trait = h.trait) AS below FROM has_model h")
def G04_G05_modelled(g: Graph) -> DataFrame:
    """Traits with a model, and how many traits each is made of."""
    layer = _layer(g)
    below = L.reach(layer)
    return L.modelled(layer, below).join(below.groupBy("trait").count(), "trait", "left").select("trait", F.coalesce("count", F.lit(0)).alias("below"))


@query(f"""
WITH {_LAYER}, disputed AS (SELECT DISTINCT trait FROM rests WHERE disputed),
plain AS (SELECT trait, claim_id, rank FROM rests WHERE claim_id NOT LIKE 'm%')
SELECT trait, min(rank) AS rank, arg_min(claim_id, rank * 1e9 + place) AS weakest, count(*) AS n_claims
FROM (SELECT *, row_number() OVER (PARTITION BY trait ORDER BY rank, claim_id) AS place FROM plain) WHERE trait IN (SELECT trait FROM has_model) AND trait NOT IN (SELECT trait FROM disputed) GROUP BY trait
""")
def Q35_G06_support(g: Graph) -> DataFrame:
    """The weakest claim under each prediction where nothing is hidden, dominance at its loci included."""
    layer = _layer(g)
    return L.support(layer, L.reach(layer))


#: The claims behind the rules of the crosses; how well each is supported comes from the evidence on the part with its number.
_CLAIMS = [
    ("requires_allele", "Ta", "a"), ("requires_allele", "Tb", "b"), ("requires_allele", "Tx", "x"), ("composed_of", "Tc", "Ta"), ("composed_of", "Tc", "Tx"), ("masks", "Ta", "Tb"),
    ("dominant_over", "A", "a"), ("incompletely_dominant_over", "B", "b"), ("dominant_over", "X", "x"), ("inherited_as", "sx", "sex-linked"),
    ("allele_of", "A", "l1"), ("allele_of", "a", "l1"), ("allele_of", "B", "l2"), ("allele_of", "b", "l2"), ("allele_of", "X", "sx"), ("allele_of", "x", "sx"),
]


@query(_PARENTS + f""",
strength AS (SELECT trait_id AS k, max(CASE WHEN stance = 'SUPPORTS' THEN level_rank ELSE 0 END) AS rank FROM evidence WHERE experiment_no >= 6 GROUP BY trait_id),
claims AS (SELECT k, predicate || ' ' || s || ' -> ' || o AS claim_id, predicate, s, o, coalesce(rank, 0) AS rank FROM (VALUES {", ".join(f"({k}, '{p}', '{s}', '{o}')" for k, (p, s, o) in enumerate(_CLAIMS, 1))}) AS t(k, predicate, s, o) LEFT JOIN strength USING (k)),
under AS (SELECT t.trait, c.claim_id, c.rank, c.predicate FROM (VALUES ('Ta', [1, 7]), ('Tb', [2, 8, 6]), ('Tx', [3, 9, 10]), ('Tc', [4, 5, 1, 7, 3, 9, 10])) AS t(trait, ks) JOIN claims c ON list_contains(t.ks, c.k)),
appears AS (SELECT DISTINCT id, regexp_replace(part, ' \\(partial\\)$', '') AS trait FROM (SELECT id, unnest(string_split(class, ', ')) AS part FROM named)),
covers AS (SELECT id, bool_or(hides AND tb > 0) AS hides FROM seen GROUP BY id)
SELECT id, trait, min(rank) AS rank, min_by(claim_id, (rank, claim_id)) AS weakest, count(*) AS n_claims FROM appears JOIN under USING (trait) JOIN covers USING (id) WHERE predicate <> 'masks' OR hides GROUP BY id, trait
""")
def Q35_G06_support_by_cross(g: Graph) -> DataFrame:
    """The weakest claim under each trait that a cross shows; what masks it counts where the cross hides it."""
    strength = g.evidence.where("experiment_no >= 6").groupBy(F.col("trait_id").alias("k")).agg(F.max(F.when(F.col("stance") == "SUPPORTS", F.col("level_rank")).otherwise(0)).alias("rank"))
    told = g.spark.createDataFrame([(k, p, s, o) for k, (p, s, o) in enumerate(_CLAIMS, 1)], "k long, predicate string, subject string, object string")
    layer = told.join(strength, "k", "left").select(F.concat("predicate", F.lit(" "), "subject", F.lit(" -> "), "object").alias("claim_id"), "predicate", "subject", "object", F.coalesce("rank", F.lit(0)).alias("rank"), F.lit(False).alias("disputed"))
    layer, crosses = L.written(layer), L.written(_crosses(g))
    shown = X.classes(crosses, RULES, "id").select("id", F.explode(F.split("class", ", ")).alias("label")).select("id", X.bare_label(F.col("label")).alias("trait")).where(F.col("trait") != X.NOTHING)
    hidden = X.hidden(crosses, RULES, "id").select("id", F.col("victim").alias("trait"))
    return L.support_in(shown, hidden, layer, L.reach(layer))


@query(f"""
WITH {_LAYER},
modes AS (SELECT subject AS trait, array_to_string(list_sort(list_distinct(array_agg(object))), ', ') AS modes, bool_or(object = 'multilocus') AS many FROM layer WHERE predicate = 'inherited_as' GROUP BY subject),
bare AS (SELECT subject AS trait, string_agg(DISTINCT object, ', ' ORDER BY object) AS bare FROM layer WHERE predicate = 'composed_of' AND object::BIGINT NOT IN (SELECT trait FROM has_model) GROUP BY subject),
against AS (SELECT trait, string_agg(claim_id, '; ' ORDER BY claim_id) AS against FROM rests WHERE disputed GROUP BY trait)
SELECT t.trait_id AS trait, CASE WHEN h.trait IS NOT NULL THEN 'disputed' WHEN many THEN 'multilocus' WHEN bare IS NOT NULL OR modes IS NOT NULL THEN 'no_allele_model' ELSE 'no_inheritance_data' END AS code,
  CASE WHEN h.trait IS NOT NULL THEN against WHEN many THEN modes WHEN bare IS NOT NULL AND modes IS NULL THEN bare ELSE coalesce(modes, '') END AS detail
FROM trait t LEFT JOIN has_model h ON h.trait = t.trait_id LEFT JOIN modes m ON m.trait = t.trait_id LEFT JOIN bare b ON b.trait = t.trait_id LEFT JOIN against a ON a.trait = t.trait_id WHERE h.trait IS NULL OR against IS NOT NULL
""")
def Q34_refusals(g: Graph) -> DataFrame:
    """Traits that are not predicted, by the first reason that holds."""
    layer = _layer(g)
    return L.refusals(g.trait.select(F.col("trait_id").alias("trait")), layer, L.reach(layer))


#: Ranks under the traits of the crosses; what is below OBSERVATIONAL is a weak basis.
RANKS = {"Ta": 40, "Tb": 10, "Tx": 20, "Tc": 5}
_MARKED = "class"
for _t, _r in RANKS.items():
    if _r < fixed.COMPARATIVE_CEILING:
        _MARKED = f"regexp_replace({_MARKED}, '\\b({_t}( \\(partial\\))?)(,|$)', '\\1 [{next(n for n, r in fixed.LEVELS.items() if r == _r)}]\\3')"


@query(_PARENTS + f"""
SELECT id, sex, replace({_MARKED}, ', ', ' + ') AS label, (weight // gcd(weight, whole)) || '/' || (whole // gcd(weight, whole)) AS share, format('{{:.1f}}', 100.0 * weight / whole) || '%' AS percent,
  row_number() OVER (PARTITION BY id, sex ORDER BY weight DESC, replace(class, ', ', ' + ')) AS position FROM counted
""", plain=True)
def Q36_W16_class_lines(g: Graph) -> DataFrame:
    """Classes largest first, as they are shown: traits on a weak basis are marked with the level."""
    return X.class_lines(X.classes(_crosses(g), RULES, "id"), RANKS, "id")


@query(_PARENTS + """,
pairs AS (SELECT m.id, (m.l1a = 'a' OR m.l1b = 'a' OR f.l1a = 'a' OR f.l1b = 'a')::INT AS p1, (m.l2a = 'b' OR m.l2b = 'b' OR f.l2a = 'b' OR f.l2b = 'b')::INT AS p2, (m.sx1 = 'x' OR m.sx2 = 'x' OR f.sx1 = 'x' OR f.sx2 = 'x')::INT AS p3
  FROM parents m JOIN parents f ON f.id = m.id + 64 AND m.sex = 'female' AND f.sex = 'male'),
shown AS (SELECT DISTINCT id, regexp_replace(part, '( \\(partial\\)|\\?)$', '') AS trait FROM (SELECT id, unnest(string_split(class, ', ')) AS part FROM named) WHERE part <> 'none of the modelled traits'),
notes AS (SELECT id, string_agg(CASE trait WHEN 'Tc' THEN 'inferred:Tc' WHEN 'Tb' THEN 'mode:Tb' END, ' ' ORDER BY trait DESC) AS notes FROM shown GROUP BY id)
SELECT id, concat_ws(' ', 'sex_ratio', CASE WHEN p1 + p2 > 1 OR (p1 + p2 = 1 AND p3 = 1) THEN 'independent_assortment' END, 'wild_type_default', notes, 'strain_scope source_authority r_sex_recombination albino_allele') AS assumptions FROM pairs LEFT JOIN notes USING (id)
""".replace("\\\\", "\\"), plain=True)
def Q37_assumptions(g: Graph) -> DataFrame:
    """What each prediction assumes: always, by the loci in play, by inferred claims and modes of the traits shown, and the open decisions."""
    return X.assumptions_of(_crosses(g), RULES, "id", inferred={"Tc": "Tc"}, modes={"Tb": "Tb"})


@query(_PARENTS + f""",
placed AS (SELECT id, sex, class, replace({_MARKED}, ', ', ' + ') AS label, weight, whole, row_number() OVER (PARTITION BY id, sex ORDER BY weight DESC, replace(class, ', ', ' + ')) AS position FROM counted),
under AS (SELECT id, sex, class, count(*) FILTER (WHERE hides) AS part, count(*) AS total FROM named GROUP BY ALL HAVING count(*) FILTER (WHERE hides) > 0)
SELECT id, sex, position, 0 AS place, '  ' || lpad((weight // gcd(weight, whole)) || CASE WHEN weight = whole THEN '' ELSE '/' || (whole // gcd(weight, whole)) END || ' (' || format('{{:.1f}}', 100.0 * weight / whole) || '%)', 14, ' ') || '  ' || label AS line FROM placed
UNION ALL SELECT id, sex, position, 1, '      hides Tb (masked by Ta) in ' || CASE WHEN part = total THEN 'all' ELSE (part // gcd(part, total)) || '/' || (total // gcd(part, total)) END || ' of it' FROM under JOIN placed USING (id, sex, class)
""", plain=True)
def Q36_text_lines(g: Graph) -> DataFrame:
    """Crosses as text: classes with percentage and share, and what each hides."""
    return X.text_lines(_crosses(g), RULES, RANKS)


@query(_PARENTS + """,
pairs AS (SELECT m.id, (m.l1a = 'a' OR m.l1b = 'a' OR f.l1a = 'a' OR f.l1b = 'a')::INT AS p1, (m.l2a = 'b' OR m.l2b = 'b' OR f.l2a = 'b' OR f.l2b = 'b')::INT AS p2, (m.sx1 = 'x' OR m.sx2 = 'x' OR f.sx1 = 'x' OR f.sx2 = 'x')::INT AS p3
  FROM parents m JOIN parents f ON f.id = m.id + 64 AND m.sex = 'female' AND f.sex = 'male'),
shown AS (SELECT id, bool_or(class LIKE '%Tc%') AS tc, bool_or(class LIKE '%Tb%') AS tb FROM named GROUP BY id),
codes AS (SELECT id, list_filter(['sex_ratio', CASE WHEN p1 + p2 > 1 OR (p1 + p2 = 1 AND p3 = 1) THEN 'independent_assortment' END, 'wild_type_default', CASE WHEN tc THEN 'inferred:Tc' END, CASE WHEN tb THEN 'mode:Tb' END, 'strain_scope', 'source_authority', 'r_sex_recombination', 'albino_allele'], lambda x: x IS NOT NULL) AS codes FROM pairs JOIN shown USING (id)),
each AS (SELECT id, unnest(codes) AS word, generate_subscripts(codes, 1) - 1 AS place FROM codes), texts AS (SELECT * FROM (VALUES """ + ", ".join(f"('{c}', '{t}')" for c, t in X.ASSUMED.items()) + """) AS t(code, text))
SELECT id, place, code, CASE WHEN word LIKE '%:%' THEN split_part(word, ':', 2) END AS claim, text, code IN ('strain_scope', 'source_authority', 'r_sex_recombination', 'albino_allele') AS open FROM each JOIN texts ON code = split_part(word, ':', 1)
""", plain=True)
def Q37_assumption_texts(g: Graph) -> DataFrame:
    """The assumptions of each prediction in words, with the claims behind them."""
    return X.assumption_texts(X.assumptions_of(_crosses(g), RULES, "id", inferred={"Tc": "Tc"}, modes={"Tb": "Tb"}), "id")


@query()
def Q36_T39_cross_documents(g: Graph) -> DataFrame:
    return X.cross_json(_crosses(g), RULES, RANKS, inferred={"Tc": "Tc"}, modes={"Tb": "Tb"})
