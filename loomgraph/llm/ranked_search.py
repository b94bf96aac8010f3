"""Ranked lexical search over documents reordered by recursive graph bisection.

Documents are read once for the terms that the items ask for.  The upper levels of the
bisection are fitted on a bounded sample and deal all documents to leaves; a leaf is cut
into segments of a bounded number of postings, each of which is bisected further in a
task of its own.  Runs of neighbouring documents are shards.  A segment is one row of the
clustered index: its documents in their new order, their postings by term and shard, and
the largest impact of each term in each shard.

A search is a scan of the index with the items broadcast.  An item's bound for a shard is
the sum of its terms' largest impacts there; shards are visited from the highest bound
on, until no bound left reaches the score of the last place that is held.  Tasks' best
meet in a shuffle by item, with ties by the documents' own ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.arrays import Words, flat, slices, trimmed
from loomgraph.llm.bisection import Tree, bisected, spread
from loomgraph.llm.session import discard, drawn, prepare, written

#: Bytes between terms: ASCII but for digits and letters.
BREAK = np.ones(256, bool)
BREAK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Items are sent to the executors in blocks of about so many bytes of text; more take another pass for each block.
BLOCK_BYTES = 16 << 20
#: Postings of a segment, on average, and documents of a shard.
SEGMENT_POSTINGS, SHARD_DOCS = 500_000, 64
#: The upper levels are fitted on the documents with the smallest hashes of their ids; they make at most so many leaves and take so many bytes.
SAMPLE_DOCS, MOST_LEAVES, TREE_BYTES = 8192, 256, 32 << 20
_LAST = 2**63 - 1


class Items:
    """Items of a block: the terms they ask for (by 64-bit hash) and how often each asks for which."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids = ids
        raw, offsets = flat(pa.array(texts, pa.string()))
        words = Words(raw, offsets, BREAK)
        self.terms, at = np.unique(words.hashes(lower=True), return_inverse=True)
        pair, self.times = np.unique(words.doc * max(len(self.terms), 1) + at, return_counts=True)
        self.term = pair % max(len(self.terms), 1)
        self.offsets = np.searchsorted(pair // max(len(self.terms), 1), np.arange(len(ids) + 1))

    def counts(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text its number of terms, offsets into what follows, the items' terms that it holds and how often."""
        words = Words(raw, offsets, BREAK)
        n = len(offsets) - 1
        if not len(self.terms) or not len(words.starts):
            return np.bincount(words.doc, minlength=n), np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = words.hashes(lower=True)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[at] == hashes)
        pair, times = np.unique(words.doc[known] * len(self.terms) + at[known], return_counts=True)
        return np.bincount(words.doc, minlength=n), np.searchsorted(pair // len(self.terms), np.arange(n + 1)), pair % len(self.terms), times


def term_weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((2N + 2) / (2df + 1)))."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What an occurrence of a term in an item adds, but for the term's weight."""
    m = 25 + (75 * n * n_docs) // max(n_terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _lists(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column."""
    held = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    offsets = held.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], held.flatten().to_numpy().astype(np.int64)


def forward(docs: DataFrame, sent, id_col: str, text_col: str) -> DataFrame:
    """id, n, terms, times of all documents with at least one term; terms are those of the items."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = flat(batch.column("text"))
            for i, j in slices(offsets):
                n, at, terms, times = sent.value.counts(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids = batch.column("id").slice(i, j - i)
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for x in (terms, times)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), *lists], names=["id", "n", "terms", "times"]).filter(pa.array(n > 0))

    return rows.mapInArrow(trimmed(run), "id long, n long, terms array<int>, times array<int>")


def fitted_tree(rows: DataFrame, n_holders: int, n_postings: int, n_vocabulary: int) -> Tree:
    """The upper levels: as many leaves as segments are needed, up to what is worth its bytes."""
    leaves = min(MOST_LEAVES, max(1, n_postings // SEGMENT_POSTINGS), max(1, TREE_BYTES // (4 * max(n_vocabulary, 1))))
    depth = max(0, math.ceil(math.log2(leaves)))
    sample = drawn(rows.where(F.size("terms") > 0), n_holders, SAMPLE_DOCS, "id", "n", "terms").select("terms").toArrow() if depth else []
    if not len(sample):
        return Tree([], np.zeros(1, np.int64), np.zeros(0, np.int64), n_vocabulary)
    offsets, terms = _lists(sample.column("terms"))
    return Tree(bisected(offsets, terms, depth), offsets, terms, n_vocabulary)


def dealt(rows: DataFrame, tree: Tree) -> DataFrame:
    """rows that hold terms with leaf and piece: a leaf has as many pieces as its postings need, and its rows are dealt to them in turn."""
    sent = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            offsets, terms = _lists(batch.column("terms"))
            leaf = sent.value.leaves(offsets, terms)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int64()), pa.array(np.arange(seen, seen + len(batch)), pa.int64())], names=[*batch.schema.names, "leaf", "turn"])
            seen += len(batch)

    routed = written(rows.where(F.size("terms") > 0).mapInArrow(trimmed(run), "id long, n long, terms array<int>, times array<int>, leaf long, turn long"), "search-leaves")
    # a row for each leaf, of which there are MOST_LEAVES at most
    pieces = routed.groupBy("leaf").agg(F.ceil(F.sum(F.size("terms")) / SEGMENT_POSTINGS).alias("pieces"))
    out = routed.join(F.broadcast(pieces), "leaf").withColumn("piece", F.pmod("turn", "pieces")).drop("turn", "pieces")
    out.written_path = routed.written_path
    return out


_INDEX = "ids array<long>, known array<boolean>, term array<int>, shard array<int>, start array<int>, most array<int>, doc array<int>, impact array<int>"


def segments(rows: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The clustered index: a row for each (leaf, piece) of dealt rows.

    ids (0 where not known) stand in the order of the bisection; shard k holds the
    documents from k * SHARD_DOCS on. (term, shard, start, most) are its groups of
    postings (doc, impact), by term and shard; most is a group's largest impact.
    """

    def build(table: pa.Table) -> pa.Table:
        offsets, terms = _lists(table.column("terms"))
        n_rows = len(offsets) - 1
        levels = bisected(offsets, terms, max(0, math.ceil(math.log2(max(n_rows / SHARD_DOCS, 1)))))
        part = np.zeros(n_rows, np.int64)
        for level in levels:
            part = part * 2 + level.side
        order = np.argsort(part, kind="stable")
        place = np.empty(n_rows, np.int64)
        place[order] = np.arange(n_rows)
        of = np.repeat(np.arange(n_rows), np.diff(offsets))
        n = table.column("n").to_numpy()
        impact = impacts(_lists(table.column("times"))[1], n[of], n_docs, n_terms)
        by = np.lexsort((place[of], terms))
        term, doc, impact = terms[by], place[of][by], impact[by]
        shard = doc // SHARD_DOCS
        head = np.ones(len(term), bool)
        head[1:] = (term[1:] != term[:-1]) | (shard[1:] != shard[:-1])
        start = np.flatnonzero(head)
        ids = table.column("id").combine_chunks().take(pa.array(order))
        made = [ids.fill_null(0), ids.is_valid(), term[start], shard[start], start, np.maximum.reduceat(impact, start), doc, impact]
        kinds = [pa.int64(), pa.bool_(), *[pa.int32()] * 6]
        return pa.table([pa.array([x], pa.list_(k)) for x, k in zip(made, kinds, strict=True)], names=[c.split()[0] for c in _INDEX.split(", ")])

    return rows.groupBy("leaf", "piece").applyInArrow(build, _INDEX)


class Best:
    """The k best (score, id) of an item so far; ties go to smaller ids, unknown ids last."""

    def __init__(self, k: int):
        self.k, self.score, self.id, self.known = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        score, ids, known = (np.concatenate(x) for x in ((self.score, score), (self.id, ids), (self.known, known)))
        order = np.lexsort((ids, ~known, -score))[: self.k]
        self.score, self.id, self.known = score[order], ids[order], known[order]

    @property
    def least(self) -> int:
        """What a document must score to come in, perhaps by its id."""
        return max(1, int(self.score[-1])) if len(self.score) == self.k else 1


class Visitor:
    """Searches segments for the items of a block."""

    def __init__(self, items: Items, weights: np.ndarray, k: int, shard_docs: int):
        self.items, self.weights, self.best, self.shard_docs = items, weights, [Best(k) for _ in items.ids], shard_docs
        self.visited = self.shards = 0

    def take(self, ids: np.ndarray, known: np.ndarray, term: np.ndarray, shard: np.ndarray, start: np.ndarray, most: np.ndarray, doc: np.ndarray, impact: np.ndarray) -> None:
        n_shards = -(-len(ids) // self.shard_docs)
        sizes, first = np.diff(np.append(start, len(doc))), np.searchsorted(term, np.arange(len(self.weights) + 1))
        for k, best in enumerate(self.best):
            own = slice(self.items.offsets[k], self.items.offsets[k + 1])
            terms = self.items.term[own]
            weight = self.weights[terms] * self.items.times[own]
            held = first[terms + 1] - first[terms]
            groups, weight = spread(first[terms], held), np.repeat(weight, held)
            bound = np.zeros(n_shards, np.int64)
            np.add.at(bound, shard[groups], weight * most[groups])
            order = np.argsort(-bound, kind="stable")
            at, step, score = 0, 1, np.zeros(len(ids), np.int64)
            self.shards += n_shards
            while at < n_shards and bound[order[at]] >= best.least:
                now = order[at : at + step]
                now = now[bound[now] >= best.least]
                at, step = at + step, 2 * step
                self.visited += len(now)
                chosen = np.zeros(n_shards, bool)
                chosen[now] = True
                mine = np.flatnonzero(chosen[shard[groups]])
                g = groups[mine]
                posting = spread(start[g], sizes[g])
                np.add.at(score, doc[posting], np.repeat(weight[mine], sizes[g]) * impact[posting])
                docs = spread(now * self.shard_docs, np.minimum(self.shard_docs, len(ids) - now * self.shard_docs))
                docs = docs[score[docs] >= best.least]
                best.add(score[docs], ids[docs], known[docs])


def _blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[Items]:
    """The distinct items with a text in blocks of about BLOCK_BYTES."""
    each = items.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")).where(F.col("text").isNotNull()).distinct()
    total = each.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long")).first()[0]
    n = max(1, -(-total // BLOCK_BYTES))
    for k in range(n):
        part = each.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).orderBy("item", "text").collect()
        if part:
            yield Items([r["item"] for r in part], [r["text"] for r in part])


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's k documents with the highest scores above 0, equal ones by ascending id.

    Null and empty texts hold no terms: such documents don't count, and such items find
    nothing. Rows of documents count each, repeated ones too; null ids come last among
    equal scores. Equal rows of items count once, and rows that share an id but not the
    text are ranked each by itself.
    """
    spark = prepare(docs.sparkSession)
    schema, out, shard_docs = "block int, at int, item long, id long, score long", None, SHARD_DOCS

    def scanner(sent, block: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, weights = sent.value
            visitor = Visitor(items, weights, k, shard_docs)
            for batch in batches:
                for row in range(len(batch)):
                    visitor.take(*(c.slice(row, 1).flatten().to_numpy(zero_copy_only=False) for c in batch.columns))
            found = [(block, at, items.ids[at], i if known else None, s) for at, b in enumerate(visitor.best) for s, i, known in zip(b.score.tolist(), b.id.tolist(), b.known.tolist(), strict=True)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["block", "at", "item", "id", "score"])

        return trimmed(run)

    for block, held in enumerate(_blocks(items, item_col, item_text)):
        rows = written(forward(docs, spark.sparkContext.broadcast(held), id_col, text_col), "search-forward")
        n_docs, n_terms, n_postings, n_holders = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0)), F.count_if(F.size("terms") > 0)).first()
        df = np.zeros(len(held.terms), np.int64)
        for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each term of the block's items
            df[r["term"]] = r["count"]
        spread_out = dealt(rows, fitted_tree(rows, n_holders, n_postings, len(held.terms)))
        index = written(segments(spread_out, n_docs, n_terms), "search-index")
        discard(rows, spread_out)
        found = index.mapInArrow(scanner(spark.sparkContext.broadcast((held, term_weights(n_docs, df))), block), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("block", "at").orderBy(F.desc("score"), F.col("id").asc_nulls_last()))
    return out.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(docs, benchmark)


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: For tables with one row for each item_id.
SQL = f"""WITH words AS MATERIALIZED (SELECT rowid AS pos, doc_id, unnest({_TERMS}) AS term FROM (SELECT *, row_number() OVER () AS rowid FROM documents)),
  sizes AS MATERIALIZED (SELECT pos, any_value(doc_id) AS doc_id, count(*) AS n FROM words GROUP BY pos),
  whole AS MATERIALIZED (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
  asked AS MATERIALIZED (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
  held AS MATERIALIZED (SELECT pos, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY pos, term),
  weights AS MATERIALIZED (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM held GROUP BY term), whole),
  impacts AS MATERIALIZED (SELECT pos, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))) AS gives FROM held JOIN sizes USING (pos) JOIN weights USING (term), whole),
  scores AS (SELECT item_id, pos, any_value(doc_id) AS doc_id, sum(times * gives)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY item_id, pos)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 10"""
