"""Audits of a vocabulary against itself and against the seed: one row for each finding.

terms: id, term_ja, term_en, term_ko, reading, notes, best_tier, unverified.
relations: subject, relation, object, basis; seed matches name an entity as object.
entities: name, label, japanese_name, aliases, unverified_labels, has_labels.

Forms meet by their folded keys, in equi joins and groups: names that share a key are
counted by cluster, never paired.  Null texts have no keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators.components import connected_components
from loomgraph.operators.storage import written

#: Relations that name one thing after another, and those that say two names are one (fixed values).
NAMING = ("same_as", "variant_spelling", "narrower", "broader", "collides_with")
SAME = ("same_as", "variant_spelling")
TRAIT = "OrnamentalTrait"
_DISAGREE = "kind 이견"


def _found(rows: DataFrame, check: str, severity: str, subject: Column, n: Column | None = None) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"), (F.lit(1) if n is None else n).cast("long").alias("n"))


def _clusters(relations: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    edges = relations.where(F.col("relation").isin(*kinds) & (F.coalesce("object", F.lit("")) != ""))
    if kinds == SAME:
        edges = edges.where(~F.contains(F.coalesce("basis", F.lit("")), F.lit("disputed:")))
    return connected_components(edges.select(F.col("subject").alias("a"), F.col("object").alias("b")))


def english(text: Column) -> Column:
    """The renderings of an English field: parts between slashes, without brackets."""
    return F.array_distinct(F.filter(F.transform(X.split_multi(text), lambda p: F.trim(F.regexp_replace(p, r"\(.*?\)", ""))), lambda p: p != ""))


def _keys(terms: DataFrame, which: str) -> DataFrame:
    """(id, key): the folded keys of each term, by language."""
    if which == "ja-normalised":
        rows = terms.select("id", X.norm_ja(F.col("term_ja")).alias("key"))
    elif which == "en":
        parts = terms.where(~F.contains("term_en", F.lit("inferred"))).select("id", F.explode(english(F.col("term_en"))).alias("part"))
        rows = parts.select("id", X.norm_romaji(F.col("part")).alias("key")).where(F.length("key") > 3)
    else:
        rows = terms.select("id", F.explode(X.split_multi(F.col("term_ko"), "/,")).alias("part")).select("id", X.norm_ko(F.col("part")).alias("key"))
    return rows.where(F.coalesce("key", F.lit("")) != "").distinct()


def scattered(terms: DataFrame, relations: DataFrame) -> DataFrame:
    """Terms that share a folded key although no chain of relations joins them; n is how many pairs of a key are unrelated."""
    linked = written(_clusters(relations, NAMING)).select(F.col("node").alias("id"), "component")
    out = None
    for which in ("ja-normalised", "en", "ko"):
        keys = _keys(terms, which).join(linked, "id", "left").withColumn("component", F.coalesce("component", "id"))
        sizes = keys.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
        pairs = lambda c: c * (c - 1) / 2
        groups = sizes.groupBy("key").agg((pairs(F.sum("size")) - F.sum(pairs(F.col("size")))).alias("unlinked")).where("unlinked > 0")
        found = _found(groups, f"1-scattered:{which}", "medium", F.col("key"), F.col("unlinked"))
        out = found if out is None else out.unionByName(found)
    return out


def wrong_merges(terms: DataFrame, relations: DataFrame) -> DataFrame:
    """Collisions inside a cluster of same names, clusters that match several seeds, and rows whose sources disagree on the kind."""
    held = written(_clusters(relations, SAME))
    size = held.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    ends = relations.where((F.col("relation") == "collides_with") & (F.coalesce("object", F.lit("")) != "")).select("subject", "object")
    inside = ends.join(held.select(F.col("node").alias("subject"), "component"), "subject").join(held.select(F.col("node").alias("object"), "component"), ["object", "component"]).join(size, "component")
    out = _found(inside, "2-wrong-merge:collision-inside-same_as-cluster", "high", F.concat_ws(" ~ ", "subject", "object"), F.col("size"))
    seeds = relations.where("relation = 'seed_match'").select(F.col("subject").alias("node"), F.col("object").alias("seed")).distinct()
    spans = held.join(seeds, "node").select("component", "seed").distinct().groupBy("component").agg(F.count(F.lit(1)).alias("seeds")).where("seeds > 1")
    out = out.unionByName(_found(spans, "2-wrong-merge:same_as-cluster-spans-seed-traits", "high", F.col("component"), F.col("seeds")))
    return out.unionByName(_found(terms.where(F.contains("notes", F.lit(_DISAGREE))), "2-wrong-merge:row-merged-across-kinds", "low", F.col("id")))


def _labels(entities: DataFrame) -> DataFrame:
    """(name, text, field) of all labels of each entity."""
    alias, other = (entities.select("name", F.explode(c).alias("text"), F.lit(c).alias("field")) for c in ("aliases", "unverified_labels"))
    return entities.where(F.col("japanese_name").isNotNull()).select("name", F.col("japanese_name").alias("text"), F.lit("japanese_name").alias("field")).unionByName(alias).unionByName(other)


def seed_labels(terms: DataFrame, relations: DataFrame, entities: DataFrame) -> DataFrame:
    """What the seed records of names that the vocabulary attests, and how it spells them."""
    labels = _labels(entities)
    bare = F.when(F.col("field") == "japanese_name", X.strip_reading(F.col("text"))).otherwise(F.col("text"))
    owners = labels.withColumn("key", F.lower(X.norm_ja(bare))).where("text <> ''").select("key", "name").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("owners")).where("owners > 1")
    out = _found(owners, "3-seed:same-label-on-two-entities", "medium", F.col("key"), F.col("owners"))

    traits = entities.where(F.col("label") == TRAIT)
    carried = labels.withColumn("key", X.norm_ja(F.when(F.col("field") == "unverified_labels", F.col("text")).otherwise(X.strip_reading(F.col("text"))))).groupBy("name", "key").agg(F.bool_or(F.col("field") == "unverified_labels").alias("unverified_label"), F.lit(True).alias("carried"))
    match = relations.where("relation = 'seed_match'").select(F.col("subject").alias("id"), F.col("object").alias("name"), F.startswith("basis", F.lit("source:")).alias("sourced"))
    met = match.join(traits.select("name"), "name").join(terms.select("id", X.norm_ja(F.col("term_ja")).alias("key"), "term_en", F.left("best_tier", F.lit(1)).isin("1", "2").alias("good"), "unverified"), "id")
    met = written(met.join(carried, ["name", "key"], "left").withColumns({"carried": F.coalesce("carried", F.lit(False)), "unverified_label": F.coalesce("unverified_label", F.lit(False))}))
    filed = F.col("unverified_label") & F.col("sourced") & F.col("good") & ~F.col("unverified")
    missing = ~filed & ~F.col("carried") & F.col("sourced") & F.col("good")
    for when, check, severity in ((filed, "attested-label-filed-unverified", "high"), (missing, "attested-synonym-missing", "medium"), (~filed & ~F.col("carried") & ~F.col("sourced"), "inferred-match-not-recorded", "low")):
        out = out.unionByName(_found(met.where(when), f"3-seed:{check}", severity, F.concat_ws(" / ", "name", "id")))

    plain = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit(""))
    parts = met.select("name", F.explode(english(F.col("term_en"))).alias("part")).where(F.col("part").rlike(r"^[\x00-\x7f]+$") & (plain("part") != plain("name")))
    parts = parts.where(X.norm_romaji(F.col("part")) == X.norm_romaji(F.col("name")))
    recorded = labels.where("field = 'aliases'").select("name", F.lower("text").alias("lowered")).distinct()
    variants = parts.withColumn("lowered", F.lower("part")).join(recorded, ["name", "lowered"], "left_anti")
    out = out.unionByName(_found(variants, "3-orthography:romanisation-variant", "low", F.concat_ws(" ~ ", "name", "part")))

    name, old = F.col("name"), ~F.col("has_labels")
    strange = F.exists("aliases", lambda a: ~a.rlike(r"^[\x00-\x7f]*$"))
    for when, check, severity in (
        (F.contains("japanese_name", F.lit("（")), "3-orthography:reading-inside-label", "medium"),
        (F.col("japanese_name").isNotNull() & (F.size("unverified_labels") > 0) & old, "3-structure:single-slot-japanese-name", "medium"),
        (old & strange, "3-structure:non-ascii-alias", "low"), (name != F.lower(name), "3-orthography:case", "low"),
    ):
        out = out.unionByName(_found(traits.where(when), check, severity, name))
    return out


def spellings(terms: DataFrame) -> DataFrame:
    """Readings that are not kana, terms in another width, and Korean forms that differ by spaces and brackets only."""
    out = _found(terms.where(F.col("reading").rlike("[A-Za-z]")), "3-orthography:reading-not-kana", "low", F.col("id"))
    wide = (F.col("term_ja") != X.nfkc(F.col("term_ja"))) & ~F.col("term_ja").rlike("[（）]")
    out = out.unionByName(_found(terms.where(wide), "3-orthography:width-variant-in-term", "low", F.col("id")))
    forms = terms.select("id", F.explode(X.split_multi(F.col("term_ko"), "/,")).alias("part")).withColumn("key", X.norm_ko(F.col("part")))
    several = forms.groupBy("id", "key").agg(F.count(F.lit(1)).alias("n")).groupBy("id").agg(F.sum("n").alias("forms"), F.count(F.lit(1)).alias("keys")).where("forms > 1 AND keys < forms")
    return out.unionByName(_found(several, "3-orthography:korean-spacing-variant", "low", F.col("id"), F.col("forms")))


def findings(terms: DataFrame, relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(check, severity, subject, n) of all 18 audits."""
    return scattered(terms, relations).unionByName(wrong_merges(terms, relations)).unionByName(seed_labels(terms, relations, entities)).unionByName(spellings(terms))


def coverage(seeds: DataFrame, terms: DataFrame, relations: DataFrame) -> DataFrame:
    """(side, name, status, basis, n): each seed (name, lab) and each term (id) with what joins it to the other side.

    A seed is matched (M), else known from laboratories only (L), else met by a
    colliding name only (C), else nowhere (N). A term that neither matches nor collides
    with a seed is U. basis is the best of the rows that give the status: a source,
    before an inference; n counts these rows.
    """
    ties = relations.where(F.col("relation").isin("seed_match", "collides_with")).select(F.col("subject").alias("id"), F.col("object").alias("seed"), (F.col("relation") == "seed_match").alias("match"), F.when(F.startswith("basis", F.lit("source:")), 0).otherwise(1).alias("weak")).join(seeds.select(F.col("name").alias("seed")), "seed", "left_semi")
    ties = written(ties.join(terms.select("id"), "id", "left_semi"))
    basis = lambda c: F.when(c == 0, "source").when(c == 1, "inferred")

    def summed(by: str) -> DataFrame:
        return ties.groupBy(F.col(by).alias("name")).agg(F.count_if("match").alias("matches"), F.count_if(~F.col("match")).alias("collisions"), F.min(F.when(F.col("match"), F.col("weak"))).alias("by_match"), F.min(F.when(~F.col("match"), F.col("weak"))).alias("by_collision"))

    one = seeds.join(summed("seed"), "name", "left")
    status = F.when(F.col("matches") > 0, "M").when(F.col("lab"), "L").when(F.col("collisions") > 0, "C").otherwise("N")
    other = terms.select(F.col("id").alias("name"), F.lit(False).alias("lab")).join(summed("id"), "name", "left")
    met = F.when(F.col("matches") > 0, "M").when(F.col("collisions") > 0, "C").otherwise("U")
    both = one.withColumns({"side": F.lit("seed"), "status": status}).unionByName(other.withColumns({"side": F.lit("term"), "status": met}))
    return both.select("side", "name", "status", F.when(F.col("status") == "M", basis(F.col("by_match"))).when(F.col("status").isin("C", "L"), basis(F.col("by_collision"))).alias("basis"), F.coalesce(F.when(F.col("status") == "M", F.col("matches")).when(F.col("status").isin("C", "L"), F.col("collisions")), F.lit(0)).alias("n"))
