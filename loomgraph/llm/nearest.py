"""Approximate nearest neighbours: anisotropic product codes, four-bit table scans, exact reranking.

Of the smallest Euclidean distance to q is the row x with the largest q.x - |x|^2 / 2, an
inner product with one exact component more; distances don't change if the sample's mean
is taken from all vectors, and then x is short.  Only q.x is estimated: each two
components of x (of short vectors each one) become one of 16 codewords, chosen so that
the residual parallel to x costs ETA times what the residual across it does, as it is
the parallel part that shifts the inner products of near queries.  Codebooks are fitted on a bounded sample; all rows
are coded and written with their vectors.  A search is a scan: a task takes blocks of
rows, adds up table values for two four-bit codes at a time, reranks the best of each
block by exact distances in double precision, and keeps each query's k nearest; these
meet in a shuffle by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.arrays import mix, trimmed
from loomgraph.llm.session import drawn, prepare, written
from loomgraph.llm.vectors import blocks, column, commonest_length, finite, matrix

WORDS = 16
#: Vectors of fewer components get a codeword for each component, others for each two; those of fewer than LEAST are turned into that many first.
SHORT, LEAST = 32, 16
#: Codebooks are fitted on the rows with the smallest hashes of their ids: at most so many rows and bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 10_000, 32 << 20
#: Inner products above this part of the norms are to be told well; it sets the weight of the parallel residual.
THRESHOLD = 0.2
FIT_ROUNDS, CODE_SWEEPS = 6, 2
#: So many rows with the best estimates of each block (16,384 rows at most) are reranked, and k more.
RERANK = 128
#: Queries are sent to the executors in blocks of at most so many bytes; more take another scan for each block.
QUERY_BYTES = 32 << 20


def eta(dim: int) -> float:
    """Weight of the parallel residual for inner products above THRESHOLD."""
    return max(1.0, (dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))


class Codebooks:
    """Codewords (parts, WORDS, width) of placed vectors, which have dim components."""

    def __init__(self, words: np.ndarray, dim: int, centre: np.ndarray, frame: np.ndarray | None = None):
        self.words, self.dim, self.eta, self.centre, self.frame = words, dim, eta(dim), centre, frame

    def placed(self, x: np.ndarray) -> np.ndarray:
        """Vectors less the centre; short ones in a frame that keeps inner products."""
        return x - self.centre if self.frame is None else (x - self.centre) @ self.frame

    def split(self, x: np.ndarray) -> np.ndarray:
        """(n, parts, width), padded with zeros; parts are even in number, so that codes fill bytes."""
        n_parts, _, width = self.words.shape
        return np.concatenate([x, np.zeros((len(x), n_parts * width - self.dim))], axis=1).reshape(len(x), n_parts, width)

    def assign(self, x: np.ndarray, sweeps: int = CODE_SWEEPS) -> np.ndarray:
        """Codes (n, parts) of vectors: the nearest codewords, then part by part those with the least anisotropic loss given the others."""
        parts = self.split(x)
        unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
        across = [((parts[:, m, None] - self.words[m]) ** 2).sum(2) for m in range(len(self.words))]
        along = [(unit[:, m] * parts[:, m]).sum(1)[:, None] - unit[:, m] @ self.words[m].T for m in range(len(self.words))]
        codes = np.stack([a.argmin(1) for a in across], axis=1)
        row = np.arange(len(x))
        total = sum(along[m][row, codes[:, m]] for m in range(len(self.words))) if len(x) else np.zeros(0)
        for _ in range(sweeps):
            for m in range(len(self.words)):
                others = total - along[m][row, codes[:, m]]
                codes[:, m] = (across[m] + (self.eta - 1) * (others[:, None] + along[m]) ** 2).argmin(1)
                total = others + along[m][row, codes[:, m]]
        return codes

    def refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Codewords of least anisotropic loss for the codes, part by part: a small system of equations for each."""
        parts = self.split(x)
        unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
        rest = parts - self.words[np.arange(len(self.words)), codes]
        total = (unit * rest).sum((1, 2))
        for m in range(len(self.words)):
            others = total - (unit[:, m] * rest[:, m]).sum(1)
            for k in range(WORDS):
                own = codes[:, m] == k
                if own.any():
                    u, v = unit[own, m], parts[own, m]
                    left = own.sum() * np.eye(u.shape[1]) + (self.eta - 1) * u.T @ u
                    right = v.sum(0) + (self.eta - 1) * (u * (others[own] + (u * v).sum(1))[:, None]).sum(0)
                    self.words[m, k] = np.linalg.solve(left, right)
            rest[:, m] = parts[:, m] - self.words[m, codes[:, m]]
            total = others + (unit[:, m] * rest[:, m]).sum(1)

    def loss(self, x: np.ndarray, codes: np.ndarray) -> float:
        """Sum of squared residuals, the parallel ones weighed with eta."""
        rest = (self.split(x) - self.words[np.arange(len(self.words)), codes]).reshape(len(x), -1)[:, : self.dim]
        along = (rest * x).sum(1) / np.maximum(np.linalg.norm(x, axis=1), 1e-300)
        return float((rest**2).sum() + (self.eta - 1) * (along**2).sum())

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(n, bytes, 256): what a byte of two codes adds to a query's inner product."""
        by_code = np.einsum("npw,pcw->npc", self.split(q), self.words).astype(np.float32)
        low, high = by_code[:, 0::2], by_code[:, 1::2]
        return (high[:, :, :, None] + low[:, :, None, :]).reshape(len(q), -1, WORDS * WORDS)


def fit(sample: np.ndarray) -> Codebooks:
    """Codebooks of a sample (rows in any fixed order): parts of some rows first, then rounds of codes and codewords."""
    (n, given), rng = sample.shape, np.random.default_rng(11)
    dim, width = max(given, LEAST), 1 if given < SHORT else 2
    frame = np.linalg.qr(rng.normal(size=(dim, given)))[0].T if dim > given else None
    parts = -(-dim // (2 * width)) * 2
    books = Codebooks(np.zeros((parts, WORDS, width)), dim, sample.mean(0), frame)
    sample = books.placed(sample)
    split = books.split(sample)
    for m in range(parts):
        books.words[m] = split[rng.choice(n, WORDS, replace=n < WORDS), m]
    for k in range(FIT_ROUNDS):
        books.refit(sample, books.assign(sample, sweeps=int(k > 1)))
    return books


def packed(codes: np.ndarray) -> np.ndarray:
    """Two codes a byte, (n, parts / 2)."""
    return (codes[:, 0::2] | codes[:, 1::2] << 4).astype(np.uint8)


def build_index(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A written table (id, vector, code, half) of all rows that take part, with codebooks as .codebooks.

    Null and empty vectors, zero ones, those with null or non-finite components, those
    of another length than the commonest, and rows with a null id take no part.
    """
    spark = prepare(rows.sparkSession)
    v = F.col(f"`{vector}`")
    kept = rows.where(F.col(f"`{id_col}`").isNotNull() & finite(v) & F.exists(v, lambda x: x != 0)).select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("vector"))
    dim, n_rows = commonest_length(kept, "vector")
    kept = kept.where(F.size("vector") == dim)
    most = max(WORDS, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(dim, 1))))
    sample = drawn(kept, n_rows, most, "id", "vector").select("vector").toArrow()
    books = fit(matrix(column(sample, "vector"), dim)) if len(sample) else None
    sent = spark.sparkContext.broadcast(books)
    kind = kept.schema["vector"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, dim):
            x = sent.value.placed(matrix(column(table, "vector"), dim))
            code = packed(sent.value.assign(x))
            half = pa.array((x * x).sum(1) / 2)
            flat = pa.Array.from_buffers(pa.binary(code.shape[1]), len(x), [None, pa.py_buffer(np.ascontiguousarray(code))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([column(table, "id"), column(table, "vector"), flat, half], names=["id", "vector", "code", "half"])

    out = written(kept.mapInArrow(trimmed(run), f"id long, vector {kind}, code binary, half double"), "nearest-index")
    out.codebooks = books
    return out


def _first_copies(ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Rows of a block without repeated rows, and of equal vectors those with the most smallest ids: others can't be among the nearest."""
    bits = np.ascontiguousarray(x).view(np.uint64)
    key = mix((bits * mix(np.arange(1, x.shape[1] + 1, dtype=np.uint64))).sum(1))
    order = np.lexsort((ids, key))
    same = np.zeros(len(ids), bool)
    same[1:] = (key[order[1:]] == key[order[:-1]]) & (x[order[1:]] == x[order[:-1]]).all(1)
    again = same.copy()
    again[1:] &= ids[order[1:]] == ids[order[:-1]]
    order, same = order[~again], same[~again]
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    return np.sort(order[np.arange(len(order)) - start < most])


def _closest(ids: np.ndarray, distances: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest by (distance, id), each id once."""
    order = np.lexsort((ids, distances))
    ids, distances = ids[order], distances[order]
    _, first = np.unique(ids, return_index=True)
    first = np.sort(first)[:k]
    return ids[first], distances[first]


class Searcher:
    """The queries of one block against blocks of rows; holds each query's k nearest so far."""

    def __init__(self, books: Codebooks, ids: np.ndarray, queries: np.ndarray, k: int, rerank: int):
        self.books, self.ids, self.queries, self.k, self.rerank = books, ids, queries, k, rerank
        self.held = [(np.zeros(0, np.int64), np.zeros(0)) for _ in ids]

    def take(self, ids: np.ndarray, x: np.ndarray, code: np.ndarray, half: np.ndarray) -> None:
        keep = _first_copies(ids, x, self.k + 1)
        ids, x, code, half = ids[keep], x[keep], np.ascontiguousarray(code[keep].T), half[keep].astype(np.float32)
        most = self.rerank + self.k
        for i in range(0, len(self.ids), 256):
            for j, table in enumerate(self.books.tables(self.books.placed(self.queries[i : i + 256])), i):
                near = np.arange(len(ids))
                if len(ids) > most:
                    score = -half
                    for b in range(len(code)):
                        score += table[b][code[b]]
                    near = np.argpartition(score, len(score) - most)[-most:]
                near = near[ids[near] != self.ids[j]]
                distance = np.sqrt(((x[near] - self.queries[j]) ** 2).sum(1))
                self.held[j] = _closest(np.concatenate([self.held[j][0], ids[near]]), np.concatenate([self.held[j][1], distance]), self.k)


def _query_blocks(queries: DataFrame, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of queries in blocks of about QUERY_BYTES; of rows with one id the smallest vector counts."""
    n = max(1, -(-queries.count() * 8 * dim // QUERY_BYTES))
    for k in range(n):
        part = queries.where(F.pmod(F.xxhash64("id", F.lit("block")), F.lit(n)) == k)
        held = part.groupBy("id").agg(F.min("vector").alias("vector")).orderBy("id").toArrow()
        if len(held):
            yield column(held, "id").to_numpy(), matrix(column(held, "vector"), dim)


def search(index: DataFrame, queries: DataFrame, k: int = 10, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest found: smallest Euclidean distance first, ties to the smaller id.

    queries: (id, vector) rows of an index of build_index. A row with a query's own id is
    no candidate of it; all others are, and rows that share an id count as one, by
    the nearest of them. With fewer than k candidates all are returned.
    """
    spark: SparkSession = index.sparkSession
    schema, out = "query_id long, vec_id long, score double", None
    books: Codebooks | None = index.codebooks

    def scanner(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books, ids, vectors = sent.value
            searcher = Searcher(books, ids, vectors, k, rerank)
            for table in blocks(batches, len(books.centre)):
                code = np.frombuffer(b"".join(column(table, "code").to_pylist()), np.uint8).reshape(len(table), -1)
                searcher.take(column(table, "id").to_numpy(), matrix(column(table, "vector"), len(books.centre)), code, column(table, "half").to_numpy())
            sizes = [len(x) for x, _ in searcher.held]
            if sum(sizes):
                near, score = (np.concatenate([h[i] for h in searcher.held]) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), pa.array(near), pa.array(score)], names=["query_id", "vec_id", "score"])

        return trimmed(run)

    if books is not None:
        for ids, vectors in _query_blocks(queries, len(books.centre)):
            found = index.mapInArrow(scanner(spark.sparkContext.broadcast((books, ids, vectors))), schema)
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    each = out.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op11_nearest(spark, sf_dir: str) -> DataFrame:
    """The ten nearest rows of each embedding whose id is divisible by 100."""
    index = build_index(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(index, index.where(F.col("id") % 100 == 0).select("id", "vector"))
