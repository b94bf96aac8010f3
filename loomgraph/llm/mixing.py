"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

A source takes whole epochs of all its documents first.  What its target leaves is
filled in the order of exponential keys -ln(u) / w, where w is the document's quality
weight, up to the budget in words; the document at the budget's end is cut there.

The running sums are taken in steps, so that no source has to fit one task.  Sums over
bins of keys, narrow enough to hold at most 0.4 % of a source under any weights, tell
the one bin in which the budget ends; that bin is cut into FINE bins in the same way,
and only the one of those that holds the end is sorted.  No other rows are moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.session import written

#: Weights of the sources in order, again and again, and the most a source may be repeated.
WEIGHTS = (1, 2, 3)
MOST = 3
#: Bins to an octave of keys, and bins that the one with the budget's end is cut into.
OCTAVE, FINE = 64, 4096
#: So many sources are broadcast at most; more are joined by a shuffle, salted against a hot source.
BROADCAST_SOURCES = 100_000
SALTS = 32
#: What parts words, and characters that lower a document's weight.
WORD = r"[^\x20\x09-\x0D]+"
JUNK = "#*$%&|<>"
KEY_SCALE = 1e9


def quality_weight(text: Column, size: Column) -> Column:
    """Share of a document's words that junk characters do not spoil, 0.05 at least; 1 for plain text."""
    junk = F.length(text) - F.length(F.translate(text, JUNK, ""))
    return F.greatest(F.lit(0.05), size.cast("double") / (size + F.lit(4) * junk).cast("double"))


def exponential_key(name: Column, weight: Column, seed: str) -> Column:
    """-ln(u) / weight in units of 1e-9, with u from a digest of seed and name: reruns agree."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(seed), name).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long") + 1).cast("double") / F.lit(float(2**52 + 1))
    return F.floor(-F.ln(u) / weight * F.lit(KEY_SCALE)).cast("long")


def targets(sizes: DataFrame, source_col: str, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, n_rows, source_size, number, target) from (source, n_rows, source_size).

    Sources weigh in code-point order, null last. Filling like water: sources whose
    ceiling is lowest for their weight stop first, and the rest share what is left.
    One row of five numbers per source goes through the windows without partitions,
    which spill; the order of all sources decides the weight of each.
    """
    ordered = Window.orderBy(F.col(source_col).asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # ceilings over weights compare exactly as integers over a common multiple of the weights
    common = 1
    for w in set(weights):
        common *= w
    number = F.row_number().over(ordered) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int"))
    t = sizes.withColumn("number", number).withColumn("weight", weight.cast("long"))
    t = t.withColumn("ceiling", F.col("source_size") * most)
    t = t.withColumn("total", F.sum("source_size").over(everything))
    rising = Window.orderBy(F.col("ceiling") * F.expr(f"{common} div weight"), "number")
    t = t.withColumn("before", F.coalesce(F.sum("ceiling").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("open", F.sum("weight").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    left = F.col("total") - F.col("before")
    t = t.withColumn("full", F.col("ceiling") * F.col("open") <= left * F.col("weight"))
    t = t.withColumn("level", F.max(F.when(~F.col("full"), left.cast("double") / F.col("open").cast("double"))).over(everything))
    target = F.when(F.col("full"), F.col("ceiling").cast("double")).otherwise(F.col("weight").cast("double") * F.col("level"))
    return t.select(F.col(source_col), "n_rows", "source_size", "number", target.alias("target"))


def _with_sources(base: DataFrame, table: DataFrame, n_sources: int) -> DataFrame:
    """base with the columns of its source; null sources meet."""
    t = table.withColumnRenamed("source", "source_")
    if n_sources <= BROADCAST_SOURCES:
        return base.join(F.broadcast(t), F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    salted = t.withColumn("salt_", F.explode(F.array(*map(F.lit, range(SALTS)))))
    dealt = base.withColumn("salt", F.pmod(F.xxhash64("id", "key"), F.lit(SALTS)).cast("int"))
    same = F.col("source").eqNullSafe(F.col("source_")) & (F.col("salt") == F.col("salt_"))
    return dealt.join(salted, same).drop("source_", "salt", "salt_")


def _ends(sums: DataFrame, bin_col: str) -> DataFrame:
    """(number, end, start) of each source: the last bin that begins before the budget's end, and the sum before it."""
    in_order = Window.partitionBy("number").orderBy(bin_col).rowsBetween(Window.unboundedPreceding, -1)
    told = sums.withColumn("start", F.coalesce(F.sum("bin_size").over(in_order), F.lit(0)))
    return told.where(F.col("start") < F.col("rest")).groupBy("number").agg(F.max(bin_col).alias("end"), F.max("start").alias("start"))


def _at_ends(rows: DataFrame, ends: DataFrame, bin_col: str, n_sources: int) -> DataFrame:
    """rows with side: -1 before the bin that holds the budget's end, 0 in it, 1 after it or without a budget; and that bin's start."""
    if n_sources <= BROADCAST_SOURCES:
        met = rows.join(F.broadcast(ends), "number", "left")
    else:
        salted = ends.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        met = rows.withColumn("salt", F.pmod(F.xxhash64("id", "key"), F.lit(SALTS)).cast("int")).join(salted, ["number", "salt"], "left").drop("salt")
    side = F.when(F.col("end").isNull(), 1).otherwise(F.signum((F.col(bin_col) - F.col("end")).cast("double")).cast("int"))
    return met.withColumn("side", side).drop("end")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """id, source, size, source_size, target, weight, epochs, taken of every row.

    Null and empty texts have size 0 and take 0. Null sources are one source, the
    last. Null ids are keyed by a digest of their text. Ties of keys go by id, then size;
    rows that agree in all of them are interchangeable, so repeated rows are dealt
    with in any order with the same result. Other columns are not read. No rows
    give no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), text.alias("text"))
    base = base.withColumn("size", F.regexp_count("text", F.lit(WORD)).cast("long"))
    base = base.withColumn("weight", F.when(F.col("size") > 0, quality_weight(F.col("text"), F.col("size"))).otherwise(F.lit(1.0)))
    name = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("text "), F.md5(F.col("text").cast("binary"))))
    base = base.withColumn("key", exponential_key(name, F.col("weight"), seed))
    # texts are read once; ids, sizes and keys are what later steps share
    base = written(base.select("id", "source", "size", "weight", "key"), "mix-keys")
    sizes = base.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("source_size"))
    table = written(targets(sizes, "source", weights, most), "mix-sources")
    n_sources = table.count()
    rows = _with_sources(base, table, n_sources)
    rows = rows.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    rows = rows.withColumn("rest", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size"))
    # keys on a logarithmic scale: an octave holds at most half of any exponential, a bin at most 1 / (e * OCTAVE) * ln 2 of it
    scale = F.log2(F.col("key").cast("double") + 1) * OCTAVE
    rows = rows.withColumn("bin", F.floor(scale)).withColumn("fine", F.floor((scale - F.floor(scale)) * FINE))
    ends = _ends(rows.groupBy("number", "bin").agg(F.sum("size").alias("bin_size"), F.first("rest").alias("rest")), "bin")
    # one row per source, like the table of sources
    rows = _at_ends(rows, ends, "bin", n_sources)
    ends = _ends(rows.where(F.col("side") == 0).groupBy("number", "fine").agg(F.sum("size").alias("bin_size"), F.first(F.col("rest") - F.col("start")).alias("rest")), "fine")
    out = ["id", "source", "size", "source_size", "target", "weight", "epochs"]
    plain = rows.where(F.col("side") != 0).select(*out, F.when(F.col("side") < 0, F.col("size")).otherwise(F.lit(0)).cast("long").alias("part"))
    rows = _at_ends(rows.where(F.col("side") == 0).withColumnRenamed("start", "outer").drop("side"), ends, "fine", n_sources)
    plain = plain.unionByName(rows.where(F.col("side") != 0).select(*out, F.when(F.col("side") < 0, F.col("size")).otherwise(F.lit(0)).cast("long").alias("part")))
    by_key = Window.partitionBy("number").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("outer") + F.col("start") + F.coalesce(F.sum("size").over(by_key), F.lit(0))
    cut = rows.where(F.col("side") == 0).withColumn("before", before)
    cut = cut.select(*out, F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before"))).cast("long").alias("part"))
    return plain.unionByName(cut).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "weight", "epochs", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken")
    )


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "epochs", "weight")


def mix_sql(table: str, seed: str = "mix") -> str:
    """DuckDB SQL for the rows of op2_mixing over a table or a parenthesised query."""
    return f"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM {table}
), weighed AS (
  SELECT doc_id, source, text, size,
    CASE WHEN size > 0 THEN greatest(0.05::DOUBLE, size::DOUBLE / (size + 4 * (length(text) - length(translate(text, '{JUNK}', ''))))::DOUBLE) ELSE 1.0::DOUBLE END AS weight
  FROM words
), keyed AS (
  SELECT *, floor(-ln((('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR, 'text ' || md5(text))), 1, 13))::BIGINT + 1)::DOUBLE / {2**52 + 1}.0::DOUBLE) / weight * 1e9::DOUBLE)::BIGINT AS key
  FROM weighed
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM sizes
), shares AS (
  SELECT *, number % 3 + 1 AS w, 3 * source_size AS ceiling, sum(source_size) OVER () AS total FROM numbered
), filled AS (
  SELECT *, total - coalesce(sum(ceiling) OVER (ORDER BY ceiling * (6 // w), number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_total,
    sum(w) OVER (ORDER BY ceiling * (6 // w), number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM shares
), levels AS (
  SELECT *, ceiling * open <= rest_total * w AS is_full FROM filled
), targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN ceiling::DOUBLE
    ELSE w::DOUBLE * max(CASE WHEN NOT is_full THEN rest_total::DOUBLE / open::DOUBLE END) OVER () END AS target
  FROM levels
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM targets
), ordered AS (
  SELECT k.*, b.source_size, b.target, b.epochs, floor(b.target)::BIGINT - b.epochs * b.source_size AS rest,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM keyed k JOIN budgets b ON k.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken, epochs, weight FROM ordered
"""


SQL = mix_sql("documents")
