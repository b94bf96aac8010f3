"""The genetic layer as tables: which traits have a model, what each rests on, and which are refused.

A layer is a table of claims (claim_id, predicate, subject, object, rank, disputed):
what alleles a trait needs (requires_allele), what it is made of (composed_of), what
masks it (masks), how it is inherited (inherited_as, also of loci), which locus an
allele belongs to (allele_of) and which allele prevails (DOMINANCE).  Composites are
flattened once by a closure of joins, so that nothing is walked on the driver.  The
claims of a locus are summed up once per locus, not once for each trait that rests on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.components import reachable
from loomgraph.operators.storage import written  # noqa: F401


#: Predicates between alleles of a locus, and the way of inheritance that marks a locus (fixed values).
DOMINANCE = ("dominant_over", "incompletely_dominant_over")
SEX_LINKED = "sex-linked"


def of(layer: DataFrame, predicate: str) -> DataFrame:
    return layer.where(F.col("predicate") == predicate)


def target(layer: DataFrame) -> Column:
    """The object of a claim between traits, of the type of its subject; objects of all claims stand as text."""
    return F.col("object").cast(layer.schema["subject"].dataType)


def reach(layer: DataFrame) -> DataFrame:
    """(trait, below): every trait that a composite is made of, directly or through others.

    What needs alleles of its own is not taken apart. Cycles end.
    """
    needs = of(layer, "requires_allele").select(F.col("subject").alias("trait")).distinct()
    edges = of(layer, "composed_of").select(F.col("subject").alias("trait"), target(layer).alias("b")).distinct().join(needs, "trait", "left_anti")
    return reachable(edges.withColumnRenamed("trait", "a")).select(F.col("a").alias("trait"), F.col("b").alias("below"))


def modelled(layer: DataFrame, below: DataFrame) -> DataFrame:
    """(trait) of the traits that need known alleles, or all of whose parts do in the end; what is part of itself never does."""
    needs = of(layer, "requires_allele").select(F.col("subject").alias("trait")).distinct()
    whole = of(layer, "composed_of").select(F.col("subject").alias("trait")).distinct()
    leaves = below.select(F.col("below").alias("trait")).distinct().join(needs, "trait", "left_anti")
    circular = below.where("trait = below").select("trait").distinct()
    bad = leaves.join(whole, "trait", "left_anti").unionByName(circular).distinct()
    spoiled = below.join(bad.select(F.col("trait").alias("below")), "below").select("trait").distinct()
    return needs.unionByName(whole.join(needs, "trait", "left_anti").join(spoiled, "trait", "left_anti"))


def _own(layer: DataFrame, below: DataFrame) -> DataFrame:
    """(trait, below): every trait of which something is known, with itself and all that it is made of."""
    known = layer.where(F.col("predicate").isin("requires_allele", "composed_of")).select(F.col("subject").alias("trait")).distinct()
    return known.select("trait", F.col("trait").alias("below")).unionByName(below).distinct()


def rests_on(layer: DataFrame, below: DataFrame, masks: bool = True) -> DataFrame:
    """(trait, claim_id, rank, disputed): each claim on traits under a prediction once: what a trait or its parts need, the composition, and with masks what masks any of them."""
    needs = of(layer, "requires_allele").select(F.col("subject").alias("below")).distinct()
    facts = of(layer, "requires_allele").select(F.col("subject").alias("below"), "claim_id", "rank", "disputed")
    facts = facts.unionByName(of(layer, "composed_of").select(F.col("subject").alias("below"), "claim_id", "rank", "disputed").join(needs, "below", "left_anti"))
    if masks:
        facts = facts.unionByName(of(layer, "masks").select(target(layer).alias("below"), "claim_id", "rank", "disputed"))
    return _own(layer, below).join(facts, "below").groupBy("trait", "claim_id").agg(F.first("rank").alias("rank"), F.first("disputed").alias("disputed"))


def locus_facts(layer: DataFrame) -> DataFrame:
    """(locus, claim_id, rank, disputed): which of a locus's alleles prevails over which, and its own way of inheritance if it goes with sex."""
    at = of(layer, "allele_of").select(F.col("subject").cast("string").alias("allele"), F.col("object").alias("locus")).distinct()
    pairs = layer.where(F.col("predicate").isin(*DOMINANCE)).select(F.col("subject").cast("string").alias("allele"), F.col("object").alias("other"), "claim_id", "rank", "disputed")
    within = pairs.join(at, "allele").join(at.select(F.col("allele").alias("other"), "locus"), ["other", "locus"]).select("locus", "claim_id", "rank", "disputed")
    sexed = of(layer, "inherited_as").where(F.col("object") == SEX_LINKED).select(F.col("subject").cast("string").alias("locus"), "claim_id", "rank", "disputed").join(at.select("locus").distinct(), "locus", "left_semi")
    return within.unionByName(sexed).groupBy("locus", "claim_id").agg(F.first("rank").alias("rank"), F.first("disputed").alias("disputed"))


def on_loci(layer: DataFrame, below: DataFrame) -> DataFrame:
    """(trait, locus): the loci of all alleles that a trait or its parts need."""
    at = of(layer, "allele_of").select(F.col("subject").cast("string").alias("allele"), F.col("object").alias("locus"))
    needs = of(layer, "requires_allele").select(F.col("subject").alias("below"), F.col("object").alias("allele"))
    return _own(layer, below).join(needs, "below").join(at, "allele").select("trait", "locus").distinct()


def _least() -> list[Column]:
    return [F.min(F.struct("rank", "claim_id")).alias("least"), F.count(F.lit(1)).alias("n_claims"), F.bool_or("disputed").alias("disputed")]


def support(layer: DataFrame, below: DataFrame) -> DataFrame:
    """(trait, rank, weakest, n_claims) of the traits that can be predicted, where nothing hides them: no weaker claim stands under the prediction."""
    each = rests_on(layer, below, masks=False).groupBy("trait").agg(*_least())
    loci = on_loci(layer, below).join(locus_facts(layer).groupBy("locus").agg(*_least()), "locus").drop("locus")
    found = each.unionByName(loci).groupBy("trait").agg(F.min("least").alias("least"), F.sum("n_claims").alias("n_claims"))
    against = disputes(layer, below).select("trait").distinct()
    return found.join(modelled(layer, below), "trait", "left_semi").join(against, "trait", "left_anti").select("trait", "least.rank", F.col("least.claim_id").alias("weakest"), "n_claims")


def disputes(layer: DataFrame, below: DataFrame) -> DataFrame:
    """(trait, claim_id) of the disputed claims that a prediction can rest on, whatever is hidden."""
    loci = on_loci(layer, below).join(locus_facts(layer).where("disputed"), "locus").select("trait", "claim_id")
    return rests_on(layer, below).where("disputed").select("trait", "claim_id").unionByName(loci).distinct()


def support_in(shown: DataFrame, hidden: DataFrame, layer: DataFrame, below: DataFrame, key: str = "id") -> DataFrame:
    """(key, trait, rank, weakest, n_claims) of the traits (key, trait) that each result shows.

    What masks a trait counts only in results that hide it: hidden has (key, trait) of
    the traits that some class of a result hides.
    """
    masks = of(layer, "masks").select(target(layer).alias("victim"), "claim_id", "rank", "disputed")
    over = _own(layer, below).select("trait", F.col("below").alias("victim")).join(masks, "victim").groupBy("trait", "victim").agg(*_least()).drop("disputed")
    met = shown.select(key, "trait").distinct().join(over, "trait").join(hidden.select(key, F.col("trait").alias("victim")).distinct(), [key, "victim"]).select(key, "trait", "least", "n_claims")
    plain = shown.select(key, "trait").distinct().join(support(layer, below).select("trait", F.struct("rank", F.col("weakest").alias("claim_id")).alias("least"), "n_claims"), "trait")
    return plain.unionByName(met).groupBy(key, "trait").agg(F.min("least").alias("least"), F.sum("n_claims").alias("n_claims")).select(key, "trait", "least.rank", F.col("least.claim_id").alias("weakest"), "n_claims")


def refusals(traits: DataFrame, layer: DataFrame, below: DataFrame) -> DataFrame:
    """(trait, code, detail) of the traits in (trait) that are not predicted.

    In this order: a claim under the prediction is disputed; many loci are said to
    act; parts have no model; a mode is known but no alleles; nothing is known.
    """
    has_model = modelled(layer, below).withColumn("model", F.lit(True))
    disputed = disputes(layer, below).groupBy("trait").agg(F.array_join(F.array_sort(F.collect_list("claim_id")), "; ").alias("against"))
    modes = of(layer, "inherited_as").groupBy(F.col("subject").alias("trait")).agg(F.array_sort(F.collect_set("object")).alias("modes"))
    parts = of(layer, "composed_of").select(F.col("subject").alias("trait"), target(layer).alias("part")).distinct().join(has_model.select(F.col("trait").alias("part")), "part", "left_anti")
    bare = parts.groupBy("trait").agg(F.array_join(F.array_sort(F.collect_set(F.col("part").cast("string"))), ", ").alias("bare"))
    rows = traits.select("trait").distinct().join(has_model, "trait", "left").join(disputed, "trait", "left").join(modes, "trait", "left").join(bare, "trait", "left")
    rows = rows.where(F.col("model").isNull() | F.col("against").isNotNull())
    said = F.array_join("modes", ", ")
    code = F.when(F.col("model").isNotNull(), "disputed").when(F.array_contains("modes", "multilocus"), "multilocus").when(F.col("bare").isNotNull() | F.col("modes").isNotNull(), "no_allele_model").otherwise("no_inheritance_data")
    detail = F.when(F.col("model").isNotNull(), F.col("against")).when(F.array_contains("modes", "multilocus"), said).when(F.col("bare").isNotNull() & F.col("modes").isNull(), F.col("bare")).otherwise(F.coalesce(said, F.lit("")))
    return rows.select("trait", code.alias("code"), detail.alias("detail"))
