"""Co-mention extraction: sentences, mentions of a lexicon, candidate claims, new symbols, JATS sections."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import fixed
from loomgraph.functions.text import content_digest, sentences, whole_word
from loomgraph.operators.storage import small, written

#: Up to so many forms pick the n-grams of a sentence in place; up to so many are broadcast, more are joined by a shuffle.
FORMS_IN_PLACE, BROADCAST_FORMS = 20_000, 200_000


def predicate_table() -> dict[str, str]:
    """'subject|object' label pairs and the weakest predicate that their shapes allow."""
    out: dict[str, str] = {}
    for predicate in fixed.PREFERENCE:
        subjects, objects = fixed.SHAPES[predicate]
        for s in subjects:
            for o in objects:
                if (predicate, s, o) not in fixed.UNSUPPORTED:
                    out.setdefault(f"{s}|{o}", predicate)
    return out


def is_evidence(section: Column) -> Column:
    """Whether a section's name is none of those that hold no evidence."""
    name = F.lower(section)
    return ~F.exists(F.array(*map(F.lit, fixed.NO_EVIDENCE)), lambda p: F.contains(name, p))


def is_ambiguous(form: Column) -> Column:
    """Surface forms that are short, ordinary words, or without a letter."""
    f = F.trim(form)
    return (F.length(f) < fixed.MIN_SAFE_LENGTH) | F.lower(f).isin(*(x.lower() for x in fixed.AMBIGUOUS)) | ~f.rlike(r"\p{L}")


def is_searchable(term: Column) -> Column:
    """Terms that are worth a query: long enough, and no ordinary word by itself."""
    t = F.trim(term)
    return (F.length(t) >= fixed.MIN_SAFE_LENGTH) & (F.contains(t, F.lit(" ")) | ~F.lower(t).isin(*(x.lower() for x in fixed.AMBIGUOUS)))


def is_anatomical(term: Column) -> Column:
    """The same for queries on titles, which allow shorter and ordinary words."""
    t = F.trim(term)
    return (F.length(t) >= 3) & t.rlike(r"\p{L}")


def is_anchored(text: Column) -> Column:
    """Whether a text names the target species anywhere, also inside a word."""
    return F.lower(text).rlike("|".join(fixed.ANCHORS))


def on_topic(title: Column, abstract: Column) -> Column:
    """Whether title or abstract has a word that begins like the target species."""
    return F.concat_ws(" ", title, abstract).rlike(r"(?iU)\b(medaka|oryzias)")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(text), r"(?U)\W+"), lambda t: t != "")


def split_sentences(sections: DataFrame, *more: str) -> DataFrame:
    """(paper_id, section_idx, section, sentence_idx, sentence) of (paper_id, section_idx, section, body), with more columns as they are."""
    return sections.select("paper_id", "section_idx", "section", *more, F.posexplode(sentences(F.col("body"))).alias("sentence_idx", "sentence"))


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is worked out once for each row: a generated column, as conditions on others are copied into every place that reads them."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def held(rows: DataFrame, lexicon: DataFrame, anchors: tuple[str, ...] = fixed.ANCHORS, at_least: int = 1) -> DataFrame:
    """The sentences with at least so many mentions, and these as an array found; lexicon is (position, form, entity_id, entity_name, label, ambiguous).

    Forms meet sentences by an equi join on their token n-grams and are confirmed by
    the pattern, so no sentence is held against every form; a form that is one word
    needs no pattern. Only n-grams that are forms leave their sentence where there are
    not too many of these; with a larger lexicon n-grams travel with the sentence's key
    alone and meet the sentence again after the join. An ambiguous form counts only
    beside an unambiguous one or an anchor. A sentence is put together before it is
    shuffled, and shuffled once.
    """
    forms = lexicon.withColumn("gram", F.array_join(tokens(F.col("form")), " ")).withColumn("size", F.size(tokens(F.col("form")))).withColumn("plain", F.col("form").rlike(r"(?U)^\w+$"))
    sizes = sorted(r["size"] for r in forms.select("size").distinct().collect() if r["size"])
    keys = ["paper_id", "section_idx", "sentence_idx"]
    rest = [c for c in rows.columns if c not in keys]
    words = _once(rows, "words", tokens(F.col("sentence")))
    grams = F.array_distinct(F.concat(*(F.col("words") if n == 1 else _ngrams(F.col("words"), n) for n in sizes)))
    n_forms, n_grams = forms.agg(F.count(F.lit(1)), F.countDistinct("gram")).first()
    if n_forms <= FORMS_IN_PLACE:
        known = [r["gram"] for r in forms.select("gram").distinct().collect()]
        # with one entity for each n-gram, fewer n-grams than mentions can't do
        least = at_least if n_grams == n_forms else 1
        hits = _once(words, "grams", F.filter(grams, lambda g: g.isin(*known))).where(F.size("grams") >= least).withColumn("gram", F.explode("grams")).drop("grams", "words").join(F.broadcast(forms), "gram")
    else:
        pieces = words.select(*keys, F.explode(grams).alias("gram"))
        hits = pieces.join(F.broadcast(forms) if n_forms <= BROADCAST_FORMS else forms, "gram").join(rows, keys)
    hits = hits.where(F.col("plain") | F.rlike(F.col("sentence"), whole_word(F.col("form"))))
    found = F.collect_list(F.struct("ambiguous", "position", "entity_id", "label", "entity_name", "form")).alias("found")
    told = hits.groupBy(*keys).agg(found, *(F.first(c).alias(c) for c in rest))
    anchored = reduce(lambda a, b: a | b, [F.contains(F.lower("sentence"), F.lit(x)) for x in anchors])
    sure = F.exists("found", lambda m: ~m["ambiguous"]) | anchored
    told = told.withColumn("found", F.when(sure, F.col("found")).otherwise(F.filter("found", lambda m: ~m["ambiguous"])))
    return told.where(F.size("found") >= at_least).select(*keys, *rest, "found")


def mentions(rows: DataFrame, lexicon: DataFrame, anchors: tuple[str, ...] = fixed.ANCHORS) -> DataFrame:
    """The mentions of held(), a row for each."""
    out = held(rows, lexicon, anchors).withColumn("m", F.explode("found")).drop("found")
    return out.select("*", "m.*").drop("m")


def _ngrams(words: Column, n: int) -> Column:
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def _core(patterns: list[str]) -> str:
    """A pattern of lower-cased text that holds wherever one of the patterns does: without boundaries and open ends."""
    cores = [re.sub(r"\\b|\\w[*+]", "", p).lower() for p in patterns]
    return "|".join(f"(?:{c})" for c in cores)


def _may_hold(text: Column, patterns: list[str]) -> Column:
    """Whether any of the patterns can occur: one look at a text instead of one for each pattern."""
    return F.translate(F.lower(text), "ſ\u212a", "sk").rlike(_core(patterns))


def detect_level(text: Column) -> tuple[Column, Column]:
    """Rank of the strongest cue, the first in the table on ties, and the phrase; 0 and null without one."""
    found = F.array_compact(
        F.array(*(F.when(text.rlike(f"(?iU){p}"), F.struct(F.lit(-rank).alias("order"), F.lit(i).alias("at"), F.regexp_extract(text, f"(?iU)({p})", 1).alias("cue"))) for i, (p, rank) in enumerate(fixed.LEVEL_CUES)))
    )
    best = F.when(_may_hold(text, [p for p, _ in fixed.LEVEL_CUES]), F.array_min(found))
    return F.coalesce(-best["order"], F.lit(0)), best["cue"]


def detect_species(text: Column, default: Column) -> Column:
    """The first species whose cue occurs."""
    out = F.lit(None).cast("string")
    for pattern, species in reversed(fixed.SPECIES_CUES):
        out = F.when(text.rlike(f"(?iU){pattern}"), species).otherwise(out)
    return F.coalesce(F.when(_may_hold(text, [p for p, _ in fixed.SPECIES_CUES]), out), default)


def paper_species(title: Column, abstract: Column) -> Column:
    """What a paper is about; one that names the target species anywhere is about it."""
    head = F.concat_ws(" ", title, abstract)
    return F.when((F.trim(head) == "") | head.rlike("(?i)medaka|Oryzias"), fixed.TARGET_SPECIES).otherwise(detect_species(head, F.lit(fixed.TARGET_SPECIES)))


def candidates(told: DataFrame, default_species: Column | None = None, cap: int = fixed.MAX_CANDIDATES) -> DataFrame:
    """Candidate claims of the sentences of held() with two to six entities, in document order, from sections that hold evidence.

    Each pair takes its predicate in the order of mention, else in reverse. Repeats by
    id go before the cap on a paper's candidates. default_species may read the columns
    of told that stand with the whole paper. What a sentence says is read once, whatever
    pairs it holds; repeats and the cap are found by keys alone, and the sentences meet
    the candidates that are left.
    """
    keys = ["paper_id", "section_idx", "sentence_idx"]
    species = default_species if default_species is not None else F.lit(fixed.TARGET_SPECIES)
    ids = F.array_distinct(F.transform("found", lambda m: m["entity_id"]))
    rows = told.where(is_evidence(F.col("section"))).withColumn("__ids", ids).where(F.size("__ids").between(2, fixed.MAX_MENTIONS))
    rows = _once(rows, "__species", species)

    def order(m: Column) -> Column:
        return F.struct(m["ambiguous"].cast("int").alias("late"), m["position"].alias("position"))

    def entity(e: Column) -> Column:
        # it stands where it was first and with what was last said of it
        own = F.filter("found", lambda m: m["entity_id"] == e)
        last = F.array_max(F.transform(own, lambda m: F.struct(order(m).alias("o"), m["label"].alias("label"), m["entity_name"].alias("entity_name"), m["ambiguous"].alias("ambiguous"), m["form"].alias("form"))))
        return F.struct(F.array_min(F.transform(own, order)).alias("order"), e.alias("entity_id"), last["label"].alias("label"), last["entity_name"].alias("entity_name"), last["ambiguous"].alias("ambiguous"))

    rows = rows.withColumn("all", F.sort_array(F.transform("__ids", entity)))
    level, cue = detect_level(F.col("sentence"))
    negated = F.when(_may_hold(F.col("sentence"), [fixed.NEGATION]), F.col("sentence").rlike(f"(?iU){fixed.NEGATION}")).otherwise(False)
    rows = written(rows.select(*keys, "section", "sentence", "all", level.alias("level_rank"), cue.alias("cue"), detect_species(F.col("sentence"), F.col("__species")).alias("species"), negated.alias("negated")))
    first = rows.select(*keys, "sentence", "all", F.posexplode("all").alias("i", "a"))
    pairs = first.select(*keys, "sentence", "i", "a", F.posexplode("all").alias("j", "b")).where("i < j")
    table = F.create_map(*(F.lit(x) for pair in predicate_table().items() for x in pair))
    pairs = pairs.select("*", table[F.concat_ws("|", "a.label", "b.label")].alias("__forward"), table[F.concat_ws("|", "b.label", "a.label")].alias("__back"))
    ahead = F.col("__forward").isNotNull()
    out = pairs.select(*keys, "sentence", "i", "j", F.coalesce("__forward", "__back").alias("predicate"), F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("subject"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("object")).where(F.col("predicate").isNotNull())
    out = out.withColumn("id", F.concat(F.lit("cand:"), content_digest(F.col("paper_id").cast("string"), F.col("predicate"), F.col("subject.entity_id").cast("string"), F.col("object.entity_id").cast("string"), F.col("sentence")))).drop("sentence")
    place = ["section_idx", "sentence_idx", "i", "j"]
    out = out.repartition("paper_id")  # both windows are about one paper: one shuffle, of keys
    out = out.withColumn("__n", F.row_number().over(Window.partitionBy("paper_id", "id").orderBy(*place))).where("__n = 1")
    out = out.withColumn("__n", F.row_number().over(Window.partitionBy("paper_id").orderBy(*place))).where(F.col("__n") <= cap)
    out = out.drop("__n", "i", "j").join(rows.drop("all"), keys)
    reasons = F.array_compact(F.array(
        F.when(F.col("level_rank").isin(60, 70) | (F.col("predicate") == "caused_by_variant"), "NEW_CAUSAL_VARIANT"), F.when(F.col("level_rank") == 0, "EVIDENCE_LEVEL_UNCLEAR"),
        F.when(F.col("subject.ambiguous") | F.col("object.ambiguous"), "LOW_RESOLUTION_CONFIDENCE")))
    return out.withColumn("reasons", F.array_sort(reasons))


def new_symbols(rows: DataFrame, found: DataFrame, lexicon: DataFrame, anchors: tuple[str, ...] = fixed.ANCHORS) -> DataFrame:
    """(paper_id, symbol, quote, near): gene-shaped tokens that nobody knows, from sentences with an entity or an anchor; the first sentence of each paper wins."""
    keys = ["paper_id", "section_idx", "sentence_idx"]
    near = found.groupBy(*keys).agg(F.array_sort(F.collect_set("entity_name")).alias("near"))
    anchored = reduce(lambda a, b: a | b, [F.contains(F.lower("sentence"), F.lit(x)) for x in anchors])
    told = rows.join(near, keys, "left").where(F.col("near").isNotNull() | anchored)
    each = told.select(*keys, "sentence", "near", F.explode(F.array_distinct(F.regexp_extract_all("sentence", F.lit(r"(?U)\b([a-z]{2,8}[0-9]{1,3}[a-z]?)\b"), 1))).alias("symbol"))
    number, stem = F.regexp_extract("symbol", "^[a-z]+([0-9]+)$", 1), F.regexp_extract("symbol", "^([a-z]+)[0-9]+$", 1)
    counted = reduce(lambda a, b: a | b, [stem.isin(*names) & number.try_cast("int").between(1, top) & ~number.startswith("0") for top, names in fixed.NOT_SYMBOLS.items()])
    each = each.where(~F.coalesce(counted, F.lit(False)) & ~F.col("symbol").isin(*fixed.NOT_SYMBOLS_OTHER))
    each = each.join(small(lexicon.select(F.lower("form").alias("symbol")).distinct()), "symbol", "left_anti")
    first = F.row_number().over(Window.partitionBy("paper_id", "symbol").orderBy("section_idx", "sentence_idx"))
    return each.withColumn("n", first).where("n = 1").select("paper_id", "symbol", F.col("sentence").alias("quote"), F.coalesce("near", F.array().cast("array<string>")).alias("near"))


def jats_sections(xml: str) -> list[tuple[int, str, str]]:
    """(index, name, body): the first abstract, then every section with paragraphs of its own.

    A later section of the same name replaces the body and keeps the first place.
    """
    root = ElementTree.fromstring(xml)
    found: dict[str, str] = {}

    def text(node) -> str:
        # inline markup parts words
        return " ".join(" ".join(node.itertext()).split())

    abstract = root.find(".//abstract")
    if abstract is not None and text(abstract):
        found["Abstract"] = text(abstract)
    for n, section in enumerate(root.iter("sec"), 1):
        body = " ".join(t for p in section.findall("p") if (t := text(p)))
        if body:
            title = section.find("title")
            found[(text(title) if title is not None else "") or f"Section {n}"] = body
    return [(i, name, body) for i, (name, body) in enumerate(found.items())]


def parse_jats(papers: DataFrame) -> DataFrame:
    """(paper_id, section_idx, section, body) of (paper_id, xml); what is not well-formed has no sections."""
    schema = pa.schema([("paper_id", pa.int64()), ("section_idx", pa.int32()), ("section", pa.string()), ("body", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for paper, xml in zip(b.column("paper_id").to_pylist(), b.column("xml").to_pylist(), strict=True):
                try:
                    rows += [(paper, *s) for s in jats_sections(xml)] if xml else []
                except ElementTree.ParseError:
                    continue
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return papers.select(F.col("paper_id").cast("long"), "xml").mapInArrow(run, "paper_id long, section_idx int, section string, body string")
