"""Dossiers of traits and the queries that look for more about them, built as text in one aggregate per section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import fixed
from loomgraph.functions.text import quoted_or
from loomgraph.operators.extraction import is_anatomical, is_searchable

GENETIC = ("associated_with_gene", "associated_with_locus", "caused_by_variant")
INHERITANCE = ("inherited_as", "requires_allele", "masks", "composed_of")
RELATED = ("resembles", "co_occurs_with", "subsumes", "putatively_same_as", "pleiotropic_with")
CAUSAL = fixed.DIRECT_RANKS
#: Scopes of the literature search, and its fields.
TARGET_SCOPE = '(medaka OR "Oryzias latipes")'
FISH_SCOPE = '(medaka OR zebrafish OR "Oryzias latipes" OR "Danio rerio" OR teleost OR fish)'
TITLE, TITLE_ABS, TITLE_TARGET = "TITLE", "TITLE_ABS", "TITLE:(medaka)"


def lines(items: Column, show) -> Column:
    """One line for each item."""
    return F.array_join(F.transform(items, show), "\n")


def section(title: str, body: Column, none: str | None) -> Column:
    """A heading and its body, or what stands for an empty one; an empty section without that goes."""
    text = F.concat(F.lit(f"\n\n## {title}\n\n"), F.when(body != "", body).otherwise(F.lit(none)))
    return text if none is not None else F.when(body != "", text).otherwise("")


def render(traits: DataFrame, claims: DataFrame, inbound: DataFrame, evidence: DataFrame, mechanisms: DataFrame) -> DataFrame:
    """(trait_id, dossier) of every trait.

    traits: (trait_id, name, category, is_composite, labels, aliases, unverified). claims:
    (trait_id, predicate, object_name, detail, n_supports, n_contradicts, best_rank,
    pending, reasons). inbound: (trait_id, predicate, subject_name) of claims on the trait.
    evidence: (trait_id, predicate, object_name, level_rank, stance, source, cited,
    finding, place), of which each source's finding is shown once, at its first place.
    mechanisms: (trait_id, mechanism, best_rank, genes). Each is gathered by itself, so
    that none multiplies another.
    """
    about = claims.groupBy("trait_id").agg(F.array_sort(F.collect_list(F.struct("predicate", "object_name", "detail", "n_supports", "n_contradicts", "best_rank", "pending", "reasons"))).alias("about"))
    on = inbound.groupBy("trait_id").agg(F.array_sort(F.collect_set(F.struct("predicate", "subject_name"))).alias("on"))
    first = evidence.groupBy("trait_id", "source", "finding").agg(F.min(F.struct("predicate", "object_name", (-F.col("level_rank")).alias("order"), "place", "stance", "cited")).alias("e"))
    shown = first.groupBy("trait_id").agg(F.array_sort(F.collect_list(F.struct("e", "finding"))).alias("evidence"))
    via = mechanisms.groupBy("trait_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("best_rank")).alias("order"), "mechanism", "genes"))).alias("via"))
    rows = traits.join(about, "trait_id", "left").join(on, "trait_id", "left").join(shown, "trait_id", "left").join(via, "trait_id", "left")

    def those(predicates: tuple) -> Column:
        return F.coalesce(F.filter("about", lambda c: c["predicate"].isin(*predicates)), F.array().cast(about.schema["about"].dataType))

    def those_on(predicates: tuple) -> Column:
        return F.coalesce(F.filter("on", lambda c: c["predicate"].isin(*predicates)), F.array().cast(on.schema["on"].dataType))

    def level(c: Column) -> Column:
        return F.when(c["n_supports"] > 0, fixed.level_of(c["best_rank"])).otherwise("—")

    def joined(*parts: Column) -> Column:
        return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "\n")

    meta = F.concat_ws(" · ", "category", F.when(F.col("is_composite") == 1, "composite class"))
    unverified = F.when(F.size("unverified") > 0, F.concat(F.lit("\nUnverified labels, which no source prints:\n"), lines(F.col("unverified"), lambda a: F.concat(F.lit("- "), a)))).otherwise("")
    aliases = F.when(F.size("aliases") > 0, lines(F.col("aliases"), lambda a: F.concat(F.lit("- "), a))).otherwise("- _none recorded_")
    genetic, inheritance = those(GENETIC), those(INHERITANCE)
    contra = lambda c: F.when(c["n_contradicts"] > 0, F.concat(F.lit(" ("), c["n_contradicts"].cast("string"), F.lit(" contradicting)"))).otherwise("")
    table = F.when(F.size(genetic) > 0, F.concat(F.lit("| Target | Relation | Strongest evidence | Detail |\n|---|---|---|---|\n"), lines(genetic, lambda c: F.concat(F.lit("| "), c["object_name"], F.lit(" | "), c["predicate"], F.lit(" | "), level(c), contra(c), F.lit(" | "), c["detail"], F.lit(" |"))))).otherwise("")
    passed = joined(lines(inheritance, lambda c: F.concat(F.lit("| "), c["predicate"], F.lit(" | "), c["object_name"], F.lit(" | "), level(c), F.lit(" |"))), lines(those_on(("masks",)), lambda c: F.concat(F.lit("| masked by | "), c["subject_name"], F.lit(" | see there |"))))
    inherited = F.when(passed != "", F.concat(F.lit("| Relation | Target | Strongest evidence |\n|---|---|---|\n"), passed)).otherwise("")
    through = F.coalesce(lines(F.col("via"), lambda m: F.concat(F.lit("- "), m["mechanism"], F.lit(" — via "), m["genes"], F.lit(" ("), fixed.level_of(-m["order"]), F.lit(")"))), F.lit(""))
    found = F.coalesce(lines(F.col("evidence"), lambda x: F.concat(
        F.when(x["e"]["stance"] == "CONTRADICTS", "✗").otherwise("•"), F.lit(" **"), fixed.level_of(-x["e"]["order"]), F.lit("** — "), x["e"]["cited"],
        F.lit("\n  - "), x["e"]["predicate"], F.lit(" → "), x["e"]["object_name"], F.lit("\n  - "), x["finding"])), F.lit(""))
    related = joined(lines(those(RELATED), lambda c: F.concat(F.lit("- "), c["predicate"], F.lit(" → "), c["object_name"])), lines(those_on(RELATED), lambda c: F.concat(F.lit("- "), c["subject_name"], F.lit(" → "), c["predicate"], F.lit(" → this trait"))))
    text = F.concat(
        F.lit("# "), "name", F.lit("\n\n"), meta, section("Names", lines(F.col("labels"), lambda a: F.concat(F.lit("- "), a)), None), section("Aliases", F.concat(aliases, unverified), ""), section("Phenotypes", lines(those(("has_phenotype",)), lambda c: F.concat(F.lit("- "), c["object_name"])), "- _none recorded_"),
        section("Genetics", table, "_No genetic association recorded._"), section("Inheritance", inherited, None), section("Mechanism", through, "- _not yet linked to a mechanism_"), section("Evidence", found, "_No evidence recorded._"),
        section("Related traits", related, "- _none recorded_"), section("Open questions", _questions(genetic), "- _none flagged_"))
    return rows.select("trait_id", text.alias("dossier"))


def _questions(genetic: Column) -> Column:
    """What a reader must know before trusting a dossier, from the claims themselves."""
    about = F.coalesce("about", genetic)
    contradicted = lines(F.filter(about, lambda c: c["n_contradicts"] > 0), lambda c: F.concat(F.lit("- contradicted: "), c["predicate"], F.lit(" → "), c["object_name"], F.lit(", "), c["n_contradicts"].cast("string"), F.lit(" finding(s)")))
    causal = F.exists(genetic, lambda c: (c["n_supports"] > 0) & c["best_rank"].isin(*CAUSAL))
    waiting = F.filter(about, lambda c: c["pending"])
    why = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(waiting, lambda c: c["reasons"])))), ", ")
    return F.array_join(F.filter(F.array(
        contradicted,
        F.when(F.size(genetic) == 0, "- no candidate gene or locus recorded yet").when(~causal, "- no causal or functionally validated variant: every genetic link is an association").otherwise(""),
        F.when(F.size("unverified") > 0, "- labels without a source need a check before use").otherwise(""),
        F.when(F.size(waiting) > 0, F.concat(F.lit("- "), F.size(waiting).cast("string"), F.lit(" claim(s) await review"), F.when(why != "", F.concat(F.lit(" ("), why, F.lit(")"))).otherwise(""))).otherwise("")),
        lambda q: q != ""), "\n")


def any_of(terms: Column, field: str = "", always_quoted: bool = False) -> Column:
    """Sorted distinct terms joined by OR, each with its field; quoted where they hold a space."""
    mark = f"{field}:" if field else ""
    if always_quoted:
        return quoted_or(terms, mark)
    return F.array_join(F.transform(F.array_sort(F.array_distinct(terms)), lambda t: F.concat(F.lit(mark), F.when(F.contains(t, F.lit(" ")), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t))), " OR ")


def ladder(traits: DataFrame) -> DataFrame:
    """(trait_id, tier, query) of (trait_id, names, mutants, genes, mechanisms, anatomy): up to five queries for each trait.

    A rung without searchable terms has no query. Names are looked for in titles and
    abstracts, genes anywhere, mechanisms beside genes in any species, anatomy in
    titles only, once of the target species and once of all fish.
    """
    kept = traits.select("trait_id", F.filter(F.concat("names", "mutants"), is_searchable).alias("names"), F.filter("genes", is_searchable).alias("genes"), F.filter("mechanisms", is_searchable).alias("mechanisms"), F.filter("anatomy", is_anatomical).alias("anatomy"))
    names, genes, mechanisms, anatomy = (F.size(c) > 0 for c in ("names", "genes", "mechanisms", "anatomy"))
    titles = any_of(F.col("anatomy"), TITLE, always_quoted=True)
    both = F.concat(F.lit("("), any_of(F.col("genes")), F.lit(") AND ("), any_of(F.col("mechanisms")), F.lit(")"))
    rungs = {
        "trait": F.when(names, F.concat(F.lit(f"{TARGET_SCOPE} AND ("), any_of(F.col("names"), TITLE_ABS), F.lit(")"))), "gene": F.when(genes, F.concat(F.lit(f"{TARGET_SCOPE} AND ("), any_of(F.col("genes")), F.lit(")"))),
        "mechanism": F.when(genes & mechanisms, both), "anatomy": F.when(anatomy, F.concat(F.lit(f"{TITLE_TARGET} AND ("), titles, F.lit(")"))), "anatomy-wide": F.when(anatomy, F.concat(F.lit("("), titles, F.lit(f") AND {FISH_SCOPE}"))),
    }
    each = F.filter(F.array(*(F.struct(F.lit(t).alias("tier"), q.alias("query")) for t, q in rungs.items())), lambda r: r["query"].isNotNull())
    return kept.select("trait_id", F.explode(each).alias("r")).select("trait_id", "r.tier", "r.query")
