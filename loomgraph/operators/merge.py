"""Upserts by column policy, stable ids, monotone states and ordered merging of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import fixed
from loomgraph.functions.text import claim_id, clean, evidence_id, normalise_title
from loomgraph.operators.claims import shape_problem
from loomgraph.operators.dedupe import with_routes
from loomgraph.operators.storage import numbered, small, written


def upsert(old: DataFrame, new: DataFrame, key: str, create_only: tuple[str, ...] = (), back_fill: tuple[str, ...] = (), non_empty: tuple[str, ...] = (), append: tuple[str, ...] = ()) -> DataFrame:
    """One row per key of either side.

    create_only columns keep what a known key has; back_fill ones are set only where
    they were null; non_empty ones change only to a text that is not blank; append
    ones unite arrays. Other columns take the new value, and a null never erases one.
    """
    o, n = (side.select(*(F.col(c).alias(f"{mark}_{c}") for c in side.columns)) for side, mark in ((old, "o"), (new, "n")))
    met = o.join(n, F.col(f"o_{key}") == F.col(f"n_{key}"), "full_outer")
    known = F.col(f"o_{key}").isNotNull()
    out = [F.coalesce(f"o_{key}", f"n_{key}").alias(key)]
    for c in old.columns:
        if c == key:
            continue
        a, b = F.col(f"o_{c}"), F.col(f"n_{c}")
        if c in create_only:
            value = F.when(known, a).otherwise(b)
        elif c in back_fill:
            value = F.coalesce(a, b)
        elif c in non_empty:
            value = F.when(F.trim(b) != "", b).otherwise(a)
        elif c in append:
            value = F.array_union(F.coalesce(a, F.array().cast(old.schema[c].dataType)), F.coalesce(b, F.array().cast(old.schema[c].dataType)))
        else:
            value = F.coalesce(b, a)
        out.append(value.alias(c))
    return met.select(*out)


def stable_ids(known: DataFrame, keys: DataFrame, key: str, position: str, prefix: str = "bv:") -> DataFrame:
    """(key, id): known ids stay, new keys get the next numbers in the order of their first position."""
    first = keys.groupBy(key).agg(F.min(position).alias("__first"))
    top = known.agg(F.coalesce(F.max(F.regexp_extract("id", "([0-9]+)$", 1).cast("long")), F.lit(0)).alias("__top"))
    new = numbered(first.join(known.select(key), key, "left_anti"), "__n", F.asc("__first"), F.asc(key)).crossJoin(F.broadcast(top))
    number = (F.col("__top") + F.col("__n")).cast("string")
    fresh = new.select(key, F.concat(F.lit(prefix), F.lpad(number, F.greatest(F.length(number), F.lit(4)), F.lit("0"))).alias("id"))
    return known.select(key, "id").unionByName(fresh)


def advanced(transitions: DataFrame, key: str, rank: str) -> DataFrame:
    """Where a state machine stands that never goes back: the highest rank of each key."""
    return transitions.groupBy(key).agg(F.max(rank).alias(rank), F.count(F.lit(1)).alias("n_events"))


def merged_basis(rows: DataFrame, keys: list[str], basis: str, position: str) -> DataFrame:
    """Distinct bases of each key, stated ones before inferred ones, each group in order of appearance."""
    first = rows.groupBy(*keys, basis).agg(F.min(position).alias("__at"))
    item = F.struct(F.when(F.col(basis).startswith("source:"), 0).otherwise(1).alias("kind"), F.col("__at"), F.col(basis).alias("basis"))
    out = first.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("__all"))
    return out.select(*keys, F.array_join(F.transform("__all", lambda x: x["basis"]), " | ").alias(basis))


def voted(rows: DataFrame, key: str, value: str, preference: Column, name: str) -> DataFrame:
    """The commonest value of each key; ties go by the smallest preference."""
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("__n"), F.min(preference).alias("__p"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("__n")).alias("n"), "__p", F.col(value).alias("value"))).alias("best")).select(key, F.col("best.value").alias(name))


def voted_by_lane(rows: DataFrame, key: str, value: str, position: str, owns: Column) -> DataFrame:
    """The commonest value of each key. Ties go to the first row of a lane that owns its value, and without one to the value seen first."""
    last = F.lit(2**63 - 1)
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("__n"), F.min(position).alias("__first"), F.coalesce(F.min(F.when(owns, F.col(position))), last).alias("__owned"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("__n")).alias("n"), "__owned", "__first", F.col(value).alias("value"))).alias("best")).select(key, F.col("best.value").alias(value))


def label_problem() -> Column:
    """What is wrong first with a label (text, lang, vocab, status, sources); null for a good one."""
    bad = F.filter("vocab", lambda v: ~v.rlike(fixed.VOCABULARY_ID))
    problem = F.when(F.trim("text") == "", "blank text").when(~F.col("lang").rlike(fixed.LANGUAGE_TAG), F.concat(F.lit("no language tag: "), "lang"))
    problem = problem.when(F.size(bad) > 0, F.concat(F.lit("no vocabulary id: "), F.array_join(bad, ", ")))
    return problem.when((F.col("status") == "ATTESTED") & (F.size("sources") == 0) & (F.size("vocab") == 0), "attested without a source")


def entity_problem(endpoints: list[str]) -> Column:
    """What is wrong first with an entity (label, category, query_terms, aliases, unverified, species); null for a good one."""
    label = F.col("label")
    problem = F.when(~label.isin(*endpoints), F.concat(F.lit("no endpoint of claims: "), label)).when(F.col("category").isNotNull() & (label != "OrnamentalTrait"), F.concat(F.lit("category on "), label))
    problem = problem.when((F.size("query_terms") > 0) & (label != "Anatomy"), F.concat(F.lit("query terms on "), label))
    problem = problem.when(F.arrays_overlap("aliases", "unverified"), F.concat(F.lit("sourced and unverified: "), F.array_join(F.array_sort(F.array_intersect("aliases", "unverified")), ", ")))
    return problem.when((label == "Gene") & F.col("species").isNull(), "gene without a species")


def last_written(rows: DataFrame, keys: list[str], position: str, values: list[str]) -> DataFrame:
    """The values of the last row of each key; a replay of the same rows changes nothing."""
    return rows.groupBy(*keys).agg(F.max(F.struct(position, *values)).alias("last")).select(*keys, *(F.col(f"last.{v}").alias(v) for v in values))


def accepted(candidates: DataFrame) -> DataFrame:
    """candidates with claim_id, evidence_id and level_rank of what accepting each would write, or why it is refused.

    A candidate is decided once; its claim must have its predicate's shape, and a
    result in another species can't stand above the comparative ceiling.
    """
    target = fixed.TARGET_SPECIES
    rank = fixed.rank_of(F.col("level"))
    refused = F.when(F.col("status") != "PENDING", "already decided").when(shape_problem(F.col("predicate"), F.col("subject_label"), F.col("object_label")).isNotNull(), "shape")
    refused = refused.when((F.col("species") != target) & (rank > fixed.COMPARATIVE_CEILING), "comparative evidence above its ceiling")
    ok = refused.isNull()
    return candidates.withColumns({
        "refused": refused, "claim_id": F.when(ok, claim_id(F.col("predicate"), F.col("subject_id"), F.col("object_id"))),
        "evidence_id": F.when(ok, evidence_id(F.col("paper_id"), F.lit("co-mention extraction, reviewed"), F.col("quote"))), "level_rank": F.when(ok, rank)})


def screened(links: DataFrame, core: DataFrame, known_ids: DataFrame, known_dois: DataFrame, ranks: dict[str, int], other: int = 9) -> DataFrame:
    """Papers behind (pos, source, id, title) links, with routes, and a row without pos that counts all links.

    Links without an id count as raw and lead nowhere. By rank of the source and
    position, a link to a (source, id) or to a normalised title that is there already
    merges into that paper; empty titles merge nothing. A paper meets its core record
    (source, id, title, abstract, doi) by source and id; known is one whose PMID or
    lower-cased DOI is known.
    """
    order = F.coalesce(F.create_map(*(F.lit(x) for pair in ranks.items() for x in pair))[F.col("source")], F.lit(other))
    found = links.where(F.col("id").isNotNull() & (F.col("id").cast("string") != "")).select("pos", "source", "id", "title")
    best = with_routes(found, [order, F.col("pos")], ["source", "id"], normalise_title(clean(F.coalesce("title", F.lit("")))))
    told = best.join(core.select("source", "id", F.col("title").alias("own"), "abstract", F.lower("doi").alias("doi"), F.lit(True).alias("fetched")), ["source", "id"], "left")
    told = told.join(known_ids.select("id", F.lit("MED").alias("source"), F.lit(True).alias("by_id")).distinct(), ["source", "id"], "left")
    told = told.join(known_dois.select("doi", F.lit(True).alias("by_doi")).distinct(), "doi", "left")
    known = F.coalesce("by_id", F.lit(False)) | F.coalesce("by_doi", F.lit(False))
    rows = told.select("pos", "source", "id", "title", F.coalesce("fetched", F.lit(False)).alias("fetched"), known.alias("known"), F.coalesce("own", "title").alias("shown"), "abstract", "routes", F.lit(None).cast("long").alias("raw"))
    return rows.unionByName(links.agg(F.count(F.lit(1)).alias("raw")), allowMissingColumns=True)


def funnel(rows: DataFrame) -> DataFrame:
    """How far the rows of screened() come, in one pass."""
    from loomgraph.operators.extraction import on_topic

    new = F.col("pos").isNotNull() & ~F.col("known")
    return rows.agg(
        F.max("raw").alias("raw"), F.count("pos").alias("deduped"), F.count_if(new).alias("not_yet_known"), F.count_if(new & (F.coalesce("abstract", F.lit("")) == "")).alias("no_abstract"), F.count_if(new & on_topic(F.col("shown"), F.col("abstract"))).alias("on_topic"))


def revised(relations: DataFrame, fixes: DataFrame) -> DataFrame:
    """(s, rel, o, basis) after fixes (s, rel, o, new): retyped with a note on the basis, or dropped without a new type; a fix holds in both directions."""
    both = fixes.unionByName(fixes.select(F.col("o").alias("s"), "rel", F.col("s").alias("o"), "new")).distinct().withColumn("__fix", F.lit(True))
    rows = relations.join(small(written(both)), ["s", "rel", "o"], "left").where(F.col("__fix").isNull() | F.col("new").isNotNull())
    basis = F.when(F.col("new").isNotNull(), F.concat("basis", F.lit(" | revised"))).otherwise(F.col("basis"))
    rows = rows.select("s", F.coalesce("new", "rel").alias("rel"), "o", basis.alias("basis"))
    return rows.groupBy("s", "rel", "o").agg(F.array_join(F.array_sort(F.collect_set("basis")), " | ").alias("basis"))


def steps_around(crossed: DataFrame, same: DataFrame) -> DataFrame:
    """(s, other, o): the synonyms o of that end s of each crossed (a, b) that has fewer in the symmetric same (s, o); what both ends share is among them."""
    degree = same.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    ends = crossed.join(degree.select(F.col("s").alias("a"), F.col("n").alias("n_a")), "a").join(degree.select(F.col("s").alias("b"), F.col("n").alias("n_b")), "b")
    fewer = F.col("n_a") <= F.col("n_b")
    ends = ends.select(F.when(fewer, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(fewer, F.col("b")).otherwise(F.col("a")).alias("other"))
    return ends.join(same, "s")


def marked_disputes(relations: DataFrame) -> DataFrame:
    """relations with a mark on the basis of synonyms between which a collision stands, or that tie both ends of one to a third term."""
    relations = written(relations)
    crossed = relations.where("rel = 'collides_with'").select(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")).distinct()
    same = relations.where("rel = 'same_as'").select("s", "o")
    same = written(same.union(same.select("o", "s")).distinct())
    met = steps_around(crossed, same).join(same.select(F.col("s").alias("other"), "o"), ["other", "o"])
    out = met.select(F.explode(F.array(*(F.struct(F.least(x, "o").alias("a"), F.greatest(x, "o").alias("b")) for x in ("s", "other")))).alias("e")).select("e.*").distinct()
    rows = relations.withColumns({"a": F.least("s", "o"), "b": F.greatest("s", "o")})
    rows = rows.join(crossed.withColumn("direct", F.lit(True)), ["a", "b"], "left").join(out.withColumn("near", F.lit(True)), ["a", "b"], "left")
    mark = F.when((F.col("rel") == "same_as") & F.col("direct").isNotNull(), " | disputed:collides").when((F.col("rel") == "same_as") & F.col("near").isNotNull(), " | disputed:one step out").otherwise("")
    return rows.select("s", "rel", "o", F.concat("basis", mark).alias("basis"))
