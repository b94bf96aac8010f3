"""Vector code compression: product codes over integer codebooks, learned in a fixed number of rounds.

Components become integers floor(256 * x), so that every distance, sum and mean is exact
and the same on any partitioning.  Codebooks are broadcast; a task takes blocks of
vectors, finds all distances of a part to its entries by norm expansion with int64
matrix products, and adds up what each entry was given.  A round's sums meet in a
shuffle grouped by part and entry: a task sends at most one row for each entry.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.arrays import trimmed
from loomgraph.llm.session import free_name, prepare, with_common, written
from loomgraph.llm.vectors import blocks, column, commonest_length, finite, matrix

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Sums of labels up to so many are broadcast; of more, the commonest are.
LABELS = 100_000


def integers(values: np.ndarray) -> np.ndarray:
    """floor(256 * x) as int64, (rows, PARTS, length), padded with zeros to whole parts.

    Squared distances over all parts stay below 2**63: components beyond the bound that
    this needs (over 700,000 at 64 components) are held at it.
    """
    n, dim = values.shape
    bound = math.isqrt((2**63 - 1) // (4 * max(dim, 1)))
    out = np.clip(np.floor(values * SCALE), -bound, bound).astype(np.int64)
    wide = -(-dim // PARTS) * PARTS
    if wide > dim:
        out = np.concatenate([out, np.zeros((n, wide - dim), np.int64)], axis=1)
    return out.reshape(n, PARTS, -1)


def nearest(parts: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (n, PARTS, length) the first nearest entry of each part and its squared distance, (n, PARTS) both."""
    index, distance = (np.empty(parts.shape[:2], np.int64) for _ in range(2))
    for p in range(parts.shape[1]):
        v, c = parts[:, p], books[p]
        d = (c * c).sum(1) - 2 * (v @ c.T)
        index[:, p] = d.argmin(1)
        distance[:, p] = d[np.arange(len(v)), index[:, p]] + (v * v).sum(1)
    return index, distance


def entry_sums(parts: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many parts each entry was given, and their componentwise sums."""
    index, _ = nearest(parts, books)
    n_parts, n_entries, length = books.shape
    at = (index + np.arange(n_parts) * n_entries).ravel()
    order = np.argsort(at, kind="stable")
    count = np.bincount(at, minlength=n_parts * n_entries)
    sums = np.zeros((n_parts * n_entries, length), np.int64)
    met = count > 0
    sums[met] = np.add.reduceat(parts.reshape(-1, length)[order], (np.cumsum(count) - count)[met])
    return count.reshape(n_parts, n_entries), sums.reshape(books.shape)


def first_books(kept: DataFrame, id_col: str, vector: str) -> np.ndarray:
    """(PARTS, entries, length) of the ENTRIES smallest ids; rows of one id by their vectors. Null ids come last."""
    rows = kept.orderBy(F.col(f"`{id_col}`").asc_nulls_last(), F.col(f"`{vector}`")).limit(ENTRIES).select(f"`{vector}`").collect()
    return integers(np.array([r[0] for r in rows], np.float64)).transpose(1, 0, 2)


def revised(kept: DataFrame, vector: str, dim: int, books: np.ndarray) -> np.ndarray:
    """Codebooks after a round: each entry becomes the floor of the mean of what it was given; unused ones stay."""
    length, sent = books.shape[2], kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(sent.value.shape[:2], np.int64), np.zeros(sent.value.shape, np.int64)
        for table in blocks(batches, dim):
            n, s = entry_sums(integers(matrix(column(table, vector), dim)), sent.value)
            count += n
            sums += s
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (part, entry, count[part, entry], *sums[part, entry].T)], names=["part", "entry", "n", *(f"s{k}" for k in range(length))])

    schema = ", ".join(f"{c} long" for c in ("part", "entry", "n", *(f"s{k}" for k in range(length))))
    given = kept.select(F.col(f"`{vector}`").alias(vector)).mapInArrow(trimmed(run), schema)
    rows = given.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(f"s{k}").alias(f"s{k}") for k in range(length))).collect()
    out = books.copy()
    for r in rows:  # a row for each entry in use
        out[r["part"], r["entry"]] = [r[f"s{k}"] // r["n"] for k in range(length)]
    return out


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, as decimals with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """id, code, error, label_error, codebooks_sha256 of each row with a vector of finite components.

    Null and empty vectors, and those with null or non-finite components, are dropped, as
    are those of another length than the commonest; a length that PARTS doesn't divide
    is padded with zeros. Fewer rows than ENTRIES make as many entries. Rows pass as
    they are, repeated ones and null ids too. Errors of rows without a label are added
    up together. A table without rows gives none.
    """
    spark = prepare(rows.sparkSession)
    key = free_name("__label", [id_col])
    kept = rows.where(finite(F.col(f"`{vector}`"))).select(F.col(f"`{id_col}`").cast("long").alias(id_col), F.col(f"`{vector}`").alias(vector), F.concat(F.lit("="), F.col(f"`{label}`").cast("string")).alias(key))
    dim, _ = commonest_length(kept, vector)
    out_schema = f"`{id_col}` long, `{key}` string, code string, error long"
    if not dim:
        return spark.createDataFrame([], f"`{id_col}` long, code string, error long, label_error long, codebooks_sha256 string")
    kept = kept.where(F.size(vector) == dim)
    books = first_books(kept, id_col, vector)
    for _ in range(ROUNDS):
        books = revised(kept, vector, dim, books)
    sent, hexes = spark.sparkContext.broadcast(books), np.array([f"{k:02x}" for k in range(ENTRIES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, dim):
            index, distance = nearest(integers(matrix(column(table, vector), dim)), sent.value)
            code = pa.array(["".join(r) for r in hexes[index].tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([column(table, id_col), column(table, key), code, pa.array(distance.sum(1), pa.int64())], names=[id_col, key, "code", "error"])

    coded = written(kept.mapInArrow(trimmed(run), out_schema).withColumn(key, F.coalesce(key, F.lit("null"))), "vector-codes")
    sums = written(coded.groupBy(key).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "vector-labels")
    return with_common(coded, sums, key, LABELS).select(id_col, "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Codes of all embeddings, their errors, and the digest of the codebooks."""
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _round(before: str, after: str) -> str:
    """SQL of one round: assign, then floor of means; entries without parts stay."""
    return f"""a_{after} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry FROM (
    SELECT p.vec_id, p.part, c.entry, sum((p.v - c.v) * (p.v - c.v)) AS d FROM parts p JOIN {before} c USING (part, pos) GROUP BY p.vec_id, p.part, c.entry) GROUP BY vec_id, part),
  {after} AS MATERIALIZED (SELECT part, entry, pos, coalesce(m.v, c.v) AS v FROM {before} c LEFT JOIN (
    SELECT part, entry, pos, floor(sum(p.v) / count(*))::BIGINT AS v FROM a_{after} JOIN parts p USING (vec_id, part) GROUP BY part, entry, pos) m USING (part, entry, pos))"""


#: For tables with one row for each vec_id and vectors of one length that 16 divides.
SQL = f"""WITH kept AS (SELECT vec_id, label, embedding, len(embedding) // {PARTS} AS width FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  parts AS MATERIALIZED (SELECT vec_id, (k - 1) // width AS part, (k - 1) % width AS pos, floor({SCALE} * embedding[k]::DOUBLE)::BIGINT AS v FROM (SELECT *, unnest(range(1, {PARTS} * width + 1)) AS k FROM kept)),
  b0 AS MATERIALIZED (SELECT part, entry, pos, v FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {ENTRIES}) USING (vec_id)),
  {_round("b0", "b1")}, {_round("b1", "b2")},
  last AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT p.vec_id, p.part, c.entry, sum((p.v - c.v) * (p.v - c.v)) AS d FROM parts p JOIN b2 c USING (part, pos) GROUP BY p.vec_id, p.part, c.entry) GROUP BY vec_id, part),
  coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM last GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b2) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""
