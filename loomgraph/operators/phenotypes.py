"""Crosses of parents of whom only the shown traits are known, for a table of pairs.

A pair says what mother and father show.  Every genotype that shows exactly that, over
the loci that can change it, is a hypothesis.  Genotypes are numbered by mixed radix, so
that each distinct set of loci is enumerated once, and kept under the set of traits that
they show: an equi join gives any number of parents their hypotheses.  Each distinct
combination of two parents is crossed once, and its ranges are joined to the pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import crosses as X
from loomgraph.operators.components import reachable
from loomgraph.operators.storage import small, written

#: Numbers of genotypes that one row is exploded to at a time.
_STEP = 4096


def closures(spark: SparkSession, rules: X.Rules) -> DataFrame:
    """(trait, traits, loci): what can change how a trait looks: traits on its loci, what masks them, and so on."""
    names = sorted({*rules.requires, *rules.parts})
    at = spark.createDataFrame([(t, rules.alleles[s][0]) for t in names if rules.modelled(t) for s in rules.leaves(t)] or [(None, None)], "trait string, locus string").where("trait IS NOT NULL").distinct()
    masks = spark.createDataFrame([(v, m) for m, v in rules.masks if rules.predictable(m)] or [(None, None)], "trait string, other string").where("trait IS NOT NULL")
    needs = spark.createDataFrame([(t,) for t in rules.requires] or [(None,)], "other string")
    beside = at.join(at.select(F.col("trait").alias("other"), "locus").join(needs, "other", "left_semi"), "locus").select("trait", "other")
    reach = reachable(beside.unionByName(masks).select(F.col("trait").alias("a"), F.col("other").alias("b")))
    whole = reach.unionByName(at.select(F.col("trait").alias("a"), F.col("trait").alias("b"))).distinct()
    found = whole.join(at.select(F.col("trait").alias("b"), "locus"), "b", "left").groupBy(F.col("a").alias("trait"))
    return written(found.agg(F.array_sort(F.collect_set("b")).alias("traits"), F.array_sort(F.collect_set("locus")).alias("loci")))


def _problem(rules: X.Rules, shows: Column) -> Column:
    """Why no hypothesis can be made of what a parent shows, or null."""
    known = F.array(*map(F.lit, sorted({*rules.requires, *rules.parts, *rules.modes, *rules.others}))).cast("array<string>")
    good = F.array(*map(F.lit, rules.traits())).cast("array<string>")
    strange, closed = F.array_except(shows, known), F.array_except(shows, good)
    return F.when(F.size(shows) == 0, "input: name at least one trait").when(F.size(strange) > 0, F.concat(F.lit("input: unknown trait "), F.array_min(strange))).when(F.size(closed) > 0, F.concat(F.lit("not_predictable: "), F.array_min(closed)))


def hypotheses(asked: DataFrame, rules: X.Rules, sex: str) -> DataFrame:
    """(shows, true_breeding, g_k...) of every genotype of one sex that shows exactly what is asked.

    asked: distinct (shows, true_breeding, traits, loci), with the closure of what is shown.
    """
    cells = asked.select("true_breeding", "traits", "loci").distinct()
    sizes, options = [], []
    for locus in rules.loci:
        names = rules.symbols(locus)
        pairs = [[a, b] for i, a in enumerate(names) for b in (names if locus in rules.sex_linked and sex == X.MALE else names[i:])]
        both, same = (F.array(*(F.array(*map(F.lit, p)) for p in held)) for held in (pairs, [p for p in pairs if p[0] == p[1]]))
        wild = F.array(F.array(*[F.lit(rules.wild(locus))] * 2))
        options.append(F.when(~F.array_contains("loci", locus), wild).when(F.col("true_breeding"), same).otherwise(both))
        sizes.append(F.size(options[-1]).cast("long"))
    n = reduce(lambda a, b: a * b, sizes)
    first = cells.withColumn("n", n).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(_STEP).cast("long"))))
    out = first.withColumn("code", F.explode(F.sequence("first", F.least(F.col("first") + _STEP, F.col("n")) - 1)))
    # the digit of each locus, by the product of the sizes before
    sized = out.select("*", *(s.alias(f"__n{k}") for k, s in enumerate(sizes)))
    digit = ["pmod(code div ({}), __n{})".format(" * ".join(["1", *(f"__n{j}" for j in range(k))]), k) for k in range(len(sizes))]
    out = sized.select("true_breeding", "traits", "loci", *(F.get(o, F.expr(d).cast("int")).alias(f"g_{k}") for k, (o, d) in enumerate(zip(options, digit, strict=True))))
    shown = X.called(out, rules, X._pairs(rules, "g")).withColumn("shows", F.array_sort(F.array_intersect("seen", "traits")))
    return shown.join(asked, ["shows", "true_breeding", "traits", "loci"], "left_semi").select("shows", "true_breeding", *(f"g_{k}" for k in range(len(rules.loci))))


def ranges(pairs: DataFrame, rules: X.Rules, key: str = "id") -> DataFrame:
    """(key, sex, class, low, high, n_mothers, n_fathers, error) of (key, mother_shows, father_shows, true_breeding).

    Shares range over the crosses of all hypotheses, as reduced fractions; a class that
    a cross lacks counts 0 there. A pair that can't be crossed has one row with an error
    and nothing else: code, colon, text. Null sets are empty ones; a null true_breeding
    is false. Traits repeated in a set count once.
    """
    spark = pairs.sparkSession
    plain = lambda c: F.array_sort(F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull())))
    pairs = pairs.select(key, plain("mother_shows").alias("m_shows"), plain("father_shows").alias("f_shows"), F.coalesce("true_breeding", F.lit(False)).alias("true_breeding"))
    combos = written(pairs.select("m_shows", "f_shows", "true_breeding").distinct())
    each = combos.select(F.col("m_shows").alias("shows"), "true_breeding").unionByName(combos.select(F.col("f_shows").alias("shows"), "true_breeding")).distinct()
    each = each.withColumn("problem", _problem(rules, F.col("shows")))
    near = closures(spark, rules)  # a row for each trait of the rules
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    asked = each.where("problem IS NULL").withColumn("trait", F.explode("shows")).join(F.broadcast(near), "trait").groupBy("shows", "true_breeding").agg(flat("traits").alias("traits"), flat("loci").alias("loci"))
    asked = written(asked)
    n_loci = range(len(rules.loci))
    found = {sex: written(hypotheses(asked, rules, sex)) for sex in (X.FEMALE, X.MALE)}
    told = combos
    for p, sex, name in (("m", X.FEMALE, "n_mothers"), ("f", X.MALE, "n_fathers")):
        own = each.join(asked, ["shows", "true_breeding"], "left").join(found[sex].groupBy("shows", "true_breeding").agg(F.count(F.lit(1)).alias(name)), ["shows", "true_breeding"], "left")
        own = own.withColumn("problem", F.coalesce("problem", F.when(F.col(name).isNull(), F.concat(F.lit("input: no genotype shows exactly "), F.array_join("shows", ", ")))))
        told = told.join(own.select(F.col("shows").alias(f"{p}_shows"), "true_breeding", name, F.col("loci").alias(f"{p}_loci"), F.col("problem").alias(f"{p}_problem")), [f"{p}_shows", "true_breeding"], "left")
    both = F.array_union("m_loci", "f_loci")
    linked = F.coalesce(*(F.when(F.array_contains(both, a) & F.array_contains(both, b), f"linked_loci_no_recombination_fraction: {a} and {b}") for a, b in rules.linked if a != b), F.lit(None).cast("string"))
    told = written(told.select("m_shows", "f_shows", "true_breeding", "n_mothers", "n_fathers", F.coalesce("m_problem", "f_problem", linked).alias("error")))
    crossed = told.where("error IS NULL")
    for p, sex in (("m", X.FEMALE), ("f", X.MALE)):
        side = found[sex].select(F.col("shows").alias(f"{p}_shows"), "true_breeding", *(F.col(f"g_{k}").alias(f"{p}_{k}") for k in n_loci))
        crossed = crossed.join(side, [f"{p}_shows", "true_breeding"])
    combo = F.struct("m_shows", "f_shows", "true_breeding")
    crossed = crossed.withColumn("cross", F.struct(combo.alias("combo"), *(f"{p}_{k}" for p in "mf" for k in n_loci)))
    rows = X.classes(written(crossed.select("cross", *(f"{p}_{k}" for p in "mf" for k in n_loci))), rules, "cross")
    spans = rows.groupBy("cross.combo", "sex", "class").agg(F.max("weight").alias("high"), F.min("weight").alias("least"), F.count(F.lit(1)).alias("n"), F.max("bits").alias("bits"))
    spans = spans.select("combo.*", "sex", "class", "high", "least", "n", "bits")
    by = ["m_shows", "f_shows", "true_breeding"]
    out = told.join(spans, by, "left")
    whole = F.pow(F.lit(2.0), "bits").cast("long")
    low = F.when(F.col("n") < F.col("n_mothers") * F.col("n_fathers"), F.lit(0)).otherwise(F.col("least"))
    out = written(out.select(*by, "sex", "class", X.reduced(low, whole).alias("low"), X.reduced(F.col("high"), whole).alias("high"), "n_mothers", "n_fathers", "error"))
    fails = F.col("error").isNotNull()
    out = out.withColumns({c: F.when(~fails, F.col(c)) for c in ("low", "high", "n_mothers", "n_fathers")})
    return pairs.join(small(out), by).select(key, "sex", "class", "low", "high", "n_mothers", "n_fathers", "error")


def range_documents(pairs: DataFrame, rules: X.Rules, key: str = "id") -> DataFrame:
    """(key, document): each pair as JSON: its parents, each class with its least and greatest share, the largest first, and what is assumed; or an error document."""
    rows = ranges(pairs, rules, key)
    value = lambda c: F.split_part(c, F.lit("/"), F.lit(1)).cast("double") / F.split_part(c, F.lit("/"), F.lit(2)).cast("double")
    item = F.struct((-value(F.col("high"))).alias("order"), F.replace("class", F.lit(", "), F.lit(" + ")).alias("label"), F.struct(F.col("low").alias("min"), F.col("high").alias("max")).alias("probability"))
    by_sex = rows.where("error IS NULL").groupBy(key, "sex").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("order")).alias("classes"), F.first("n_mothers").alias("n_m"), F.first("n_fathers").alias("n_f"))
    whole = by_sex.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("sex", F.struct("classes"))))).alias("offspring"), F.first("n_m").alias("n_m"), F.first("n_f").alias("n_f"))
    shows = lambda c: F.array_sort(F.array_distinct(c))
    given = pairs.select(key, shows("mother_shows").alias("m"), shows("father_shows").alias("f"), F.coalesce("true_breeding", F.lit(False)).alias("fixed"))
    said = F.array(*map(F.lit, ("sex_ratio", "wild_type_default", "phenotype_hypotheses", *X.OPEN_DECISIONS)))
    parents = F.struct(*(F.struct(F.col(p).alias("shows"), F.col(f"n_{p}").alias("hypotheses")).alias(name) for p, name in (("m", "mother"), ("f", "father"))))
    good = F.struct(F.lit(X.SCHEMA_VERSION).alias("schema_version"), F.lit("phenotype_cross").alias("kind"), parents.alias("parents"), F.col("fixed").alias("true_breeding"), "offspring", said.alias("assumptions"))
    bad = F.struct(F.lit(X.SCHEMA_VERSION).alias("schema_version"), F.struct(F.substring_index("error", ": ", 1).alias("code"), F.expr("substr(error, instr(error, ': ') + 2)").alias("message")).alias("error"))
    failed = rows.where("error IS NOT NULL").select(key, F.to_json(bad).alias("document"))
    return given.join(whole, key).select(key, F.to_json(good).alias("document")).unionByName(failed)


def one_pair(spark: SparkSession, mother: set[str], father: set[str], true_breeding: bool = False) -> DataFrame:
    """A table of one pair, for a command."""
    return spark.createDataFrame([("cross", sorted(mother), sorted(father), true_breeding)], "id string, mother_shows array<string>, father_shows array<string>, true_breeding boolean")
