"""Substring dedup by content-defined chunks.

A gear rolling hash over the last bytes decides at each word whether a chunk ends
there, so that chunks depend on content alone and an insertion moves only the cuts
next to it.  Chunks that occur once are left out by digest; of the runs that remain,
windows of neighbouring chunks are compared, so that a passage is a run of chunks that
stand together in one other document, and the first document (the smallest id) keeps
it.  Only anchors are counted over
all documents: chunks of half a run, and the smallest digest of any three chunks that
stand together; a window can only repeat if all anchors do that lie within it by
themselves.  What a passage has
before its first whole chunk and after its last one is not
seen: RUN_WORDS in whole chunks are what is left of 51 words in 997 cases of 1,000.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.arrays import BYTE, Words, flat, mix, powers, repeated, slices, trimmed
from loomgraph.llm.session import discard, free_name, prepare, release, with_common, written

#: A word starts a chunk with a chance of 1 in CUT_ONE_IN, by a hash of the WINDOW bytes before it.
CUT_ONE_IN, WINDOW = 3, 16
#: Chunks of fewer words say too little to be compared and are joined to the next; one at
#: a document's end goes along with a repeated one before it.
LEAST_WORDS = 3
#: A chunk that no hash has ended ends after so many words, as in texts of one word.
MOST_WORDS = 16
#: Runs of fewer words in whole chunks stay: common phrases and lines are no passages.
RUN_WORDS = 24
#: Digests that are shared by most documents are broadcast, so many at most.
COMMON = 500_000
_GEAR = (BYTE >> np.uint64(32)).astype(np.uint32)
LAST_ID = 2**63 - 1
#: So many ids of documents with repeats are broadcast at most, to leave the other texts where they are.
PICKED = 500_000


class Chunks:
    """Chunks of a slice of documents: first words, sizes in words, digests (0 for small ones)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.words = words = Words(raw, offsets)
        h = words.hashes()
        n_docs = len(offsets) - 1
        # documents are set apart by zeros, so that no hash reaches into a neighbour
        shift = WINDOW * (np.repeat(np.arange(n_docs), np.diff(offsets)) + 1)
        gear = np.zeros(len(raw) + WINDOW * (n_docs + 1), np.uint32)
        gear[np.arange(len(raw)) + shift] = _GEAR[raw]
        step = 1
        while step < WINDOW:
            gear[step:] = gear[step:] + (gear[:-step] << np.uint32(step))
            step *= 2
        before = words.starts - 1 + WINDOW * (words.doc + 1)
        cut = gear[before] * np.uint32(0x9E3779B1) < np.uint32(int(2**32 / CUT_ONE_IN))
        cut[words.offsets[:-1][np.diff(words.offsets) > 0]] = True
        self.first = _joined(np.flatnonzero(cut), words.offsets, len(h))
        self.size = np.diff(np.append(self.first, len(h)))
        self.doc = words.doc[self.first]
        self.offsets = np.searchsorted(self.first, words.offsets)
        if len(h):
            at = np.arange(len(h)) - np.repeat(self.first, self.size)
            self.digest = mix(np.add.reduceat(h * powers(int(self.size.max()))[at], self.first) + self.size.astype(np.uint64)).astype(np.int64)
            self.digest[self.size < LEAST_WORDS] = 0
        else:
            self.digest = np.zeros(0, np.int64)


def _joined(first: np.ndarray, offsets: np.ndarray, total: int) -> np.ndarray:
    """Starts of chunks when a chunk of too few words goes with those after it, inside its document.

    A chunk that is long enough by itself ends what was gathered, so the cuts agree
    again from there on.
    """
    heads, out, start = set(offsets.tolist()), [], 0
    ends = first[1:].tolist()
    for at, end in zip(first.tolist(), [*ends, total], strict=False):
        if at in heads:
            start = at
            out.append(at)
        while end - start > MOST_WORDS:
            start += MOST_WORDS
            out.append(start)
        if end - start >= LEAST_WORDS and end not in heads:
            start = end
            out.append(end)
    return np.array(out, np.int64)


def anchors(digest: np.ndarray, size: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """Which chunks have half of least words, or the smallest digest of three neighbours in their document.

    Two documents that share a run share its anchors inside. A run of least words has
    three chunks or one of half its words, so it has an anchor that both hold.
    """
    out = size >= least // 2
    least_of = _least_of_three(digest)
    out[least_of[doc[: len(least_of)] == doc[len(doc) - len(least_of) :]]] = True
    return out


def _least_of_three(digest: np.ndarray) -> np.ndarray:
    """For each three neighbours the place of the smallest digest."""
    n = max(len(digest) - 2, 0)
    return np.arange(n) + np.stack([digest[:n], digest[1 : n + 1], digest[2 : n + 2]]).argmin(axis=0)


def _signed(c: Chunks, n_docs: int, least: int) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """Each document's digests and sizes in order, without small chunks, its distinct anchors, and whether a digest occurs twice in it."""
    real = c.digest != 0
    digest, size, doc = c.digest[real], c.size[real], c.doc[real]
    at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n_docs))]).astype(np.int32))
    order = np.lexsort((digest, doc))
    again = np.zeros(len(digest), bool)
    again[1:] = (digest[order][1:] == digest[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(n_docs, bool)
    twice[doc[order][again]] = True
    kept = order[anchors(digest, size, doc, least)[order]]
    first = np.ones(len(kept), bool)
    first[1:] = (digest[kept][1:] != digest[kept][:-1]) | (doc[kept][1:] != doc[kept][:-1])
    kept = kept[first]
    held = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[kept], minlength=n_docs))]).astype(np.int32))
    return pa.ListArray.from_arrays(at, pa.array(digest)), pa.ListArray.from_arrays(at, pa.array(size.astype(np.int8))), pa.ListArray.from_arrays(held, pa.array(digest[kept])), pa.array(twice)


def _windows(digest: np.ndarray, size: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows [a, b) of neighbouring chunks, in order, and their digests.

    From each chunk on and back from each chunk, the fewest chunks of at least least
    words: any run of so many words is covered by the windows that lie inside it.
    """
    n = len(size)
    total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    on, back = np.searchsorted(total, total[:-1] + least), np.searchsorted(total, total[1:] - least, "right") - 1
    each = np.arange(n)
    spans = np.unique(np.concatenate([each[on <= n] * (n + 1) + on[on <= n], back[back >= 0] * (n + 1) + each[back >= 0] + 1]))
    a, b = spans // (n + 1), spans % (n + 1)
    h, chunks = np.zeros(len(a), np.uint64), digest.view(np.uint64)
    for k in range(int((b - a).max(initial=0))):
        inside = a + k < b
        h[inside] = mix(h[inside] * np.uint64(0x9FB21C651E98DF25) + chunks[a[inside] + k])
    return a, b, h.view(np.int64)


def _key(id_col: str) -> Column:
    """Null ids are one document, the last."""
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID))


def _shared(each: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(key, digest, first) of the digests that several keys hold, first being the smallest of them; and a table to delete afterwards."""
    counts = each.groupBy("digest").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count(F.lit(1)).alias("n"))
    shared = written(counts.where(F.col("first") < F.col("last")).select("digest", "first", "n"), name)
    release(each.sparkSession)
    return with_common(each, shared, "digest", COMMON).where(F.col("first").isNotNull()), shared


def repeats(docs: DataFrame, id_col: str, text_col: str, least: int = RUN_WORDS, within: bool = False) -> DataFrame:
    """(key, digests, firsts) of each document that holds a window of chunks that another (or, with within, the same) holds too.

    firsts are the smallest ids that hold the windows. Windows are taken only where
    their own anchors are shared, as in every repeated window. Digests are counted with partial
    sums before the shuffle, and a document's lists are as long as the document at most.
    """
    prepare(docs.sparkSession)
    schema = pa.schema([("key", pa.int64()), ("digests", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int8())), ("anchors", pa.list_(pa.int64())), ("twice", pa.bool_())])

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = flat(b.column("text"))
            for i, j in slices(offsets):
                c = Chunks(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([b.column("key").slice(i, j - i), *_signed(c, j - i, least)], schema=schema)

    rows = docs.select(_key(id_col).alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    signed = written(rows.mapInArrow(trimmed(chunk), "key long, digests array<long>, sizes array<tinyint>, anchors array<long>, twice boolean"), "chunk-digests")
    found, counts = _shared(signed.select("key", F.explode("anchors").alias("digest")), "chunk-shared")
    held = written(found.groupBy("key").agg(F.collect_set("digest").alias("known")), "chunk-repeats")
    discard(counts)
    release(docs.sparkSession)
    met, rest = _met(signed, held, "key")
    if rest is not None:
        met = met.unionByName(rest.withColumn("known", F.lit(None).cast("array<long>")))
    met = met.where(F.col("known").isNotNull() | (F.lit(within) & F.col("twice"))).select("key", "digests", "sizes", "known")
    out = pa.schema([("key", pa.int64()), ("digests", pa.list_(pa.int64())), ("twice", pa.bool_())])

    def window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for key, digests, sizes, known in zip(b.column("key").to_pylist(), *(b.column(c) for c in ("digests", "sizes", "known")), strict=True):
                digest, size = digests.values.to_numpy(), sizes.values.to_numpy()
                across = own = np.zeros(0, np.int64)
                if known.is_valid:
                    across = _windows_across(digest, size, np.isin(digest, known.values.to_numpy()), least)
                if within:
                    own = _windows_of(digest, size, repeated(digest), least)
                if len(across) or len(own):
                    made.append((key, np.unique(np.concatenate([across, own])), len(np.unique(own)) < len(own)))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*made, strict=True), out, strict=True)], schema=out)

    windows = written(met.mapInArrow(trimmed(window), "key long, digests array<long>, twice boolean"), "window-digests")
    discard(signed, held)
    each, counts = _shared(windows.select("key", F.explode("digests").alias("digest")), "window-shared")
    found = each.groupBy("key").agg(F.collect_set(F.struct("digest", "first")).alias("found"))
    found = written(found.select("key", F.col("found.digest").alias("digests"), F.col("found.first").alias("firsts")), "window-repeats")
    discard(counts)
    release(docs.sparkSession)
    if not within:
        discard(windows)
        return found
    nothing = F.array().cast("array<long>")
    alone = windows.where("twice").select("key").distinct().join(found.select("key"), "key", "left_anti").select("key", nothing.alias("digests"), nothing.alias("firsts"))
    alone = written(alone, "window-alone")
    discard(windows)
    return found.unionByName(alone)


def _windows_across(digest: np.ndarray, size: np.ndarray, known: np.ndarray, least: int) -> np.ndarray:
    """Digests of the windows whose own anchors are known: long chunks, and the smallest of three that all lie inside."""
    a, b, h = _windows(digest, size, least)
    long = np.concatenate([[0], np.cumsum((size >= least // 2) & ~known)])
    three = np.concatenate([[0], np.cumsum(~known[_least_of_three(digest)])])
    inside = np.maximum(b - 2, a)
    return h[(long[a] == long[b]) & (three[np.minimum(a, len(three) - 1)] == three[np.minimum(inside, len(three) - 1)])]


def _windows_of(digest: np.ndarray, size: np.ndarray, seen: np.ndarray, least: int) -> np.ndarray:
    """Digests of the windows whose chunks were all seen."""
    a, b, h = _windows(digest, size, least)
    unseen = np.concatenate([[0], np.cumsum(~seen)])
    return h[unseen[a] == unseen[b]]


def _met(rows: DataFrame, found: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """rows with what was found of them, and the rows without anything found, if they could be told apart without a shuffle."""
    keys = found.select(key)
    if keys.count() > PICKED:
        return rows.join(found, key, "left"), None
    return rows.join(F.broadcast(keys), key, "left_semi").join(found, key), rows.join(F.broadcast(keys), key, "left_anti")


def _runs(able: np.ndarray, small: np.ndarray, size: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Runs [a, b) of able chunks with small ones between them, of at least least words."""
    out, a, end = [], -1, -1
    total = np.concatenate([[0], np.cumsum(size)])
    for k in np.flatnonzero(able | ~small).tolist():
        if able[k]:
            a = k if a < 0 else a
            end = k + 1
        elif a >= 0:
            out.append((a, end))
            a = -1
    if a >= 0:
        out.append((a, end))
    return [(a, b) for a, b in out if total[b] - total[a] >= least]


def _covered(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of n chunks the spans [a, b) hold."""
    steps = np.bincount(a, minlength=n + 1) - np.bincount(b, minlength=n + 1)
    return np.cumsum(steps)[:n] > 0


def _found(text: str, key: int, digests: list[int], firsts: list[int], least: int, within: bool) -> tuple[Chunks, np.ndarray, list, list, list[int]]:
    """Chunks of a text, its bytes, the runs found elsewhere (or with within twice in it), those to remove, and the ids that keep them."""
    raw = np.frombuffer(text.encode(), np.uint8)
    c = Chunks(raw, np.array([0, len(raw)]))
    n, small = len(c.size), c.digest == 0
    a, b, h = _windows(c.digest[~small], c.size[~small], least)
    known = dict(zip(digests, firsts, strict=True))
    first = np.array([known.get(d, -1) for d in h.tolist()], np.int64)
    _, at, group, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    # a window that overlaps its own first place loses only what lies beyond that
    earlier = (first >= 0) & (first < key)
    start = np.where(earlier, a, np.minimum(np.maximum(a, b[at[group]]), b))
    gone = earlier | (within & (at[group] < np.arange(len(h))))
    seen = (first >= 0) | (within & (times[group] > 1))
    runs, cuts = _runs(_covered(n, a[seen], b[seen]), small, c.size, least), _runs(_covered(n, start[gone], b[gone]), small, c.size, least)
    holders = {int(f) if f >= 0 else key for f in first[seen].tolist()}
    return c, raw, runs, cuts, sorted(holders)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = RUN_WORDS, within: bool = False) -> DataFrame:
    """docs with every passage that stands in several documents cut from all but the first; rows and columns stay.

    The first is the document with the smallest id. With within, what a document
    repeats itself is cut too, from all but its first place. Rows that share an id are
    one document, so copies under one id do not empty each other; null ids are one
    document, the last. Null and empty texts stay. A text may end up empty.
    """
    found = repeats(docs, id_col, text_col, least, within)
    names, at = docs.columns, docs.columns.index(text_col)
    own, digest, first = (free_name(x, names) for x in ("__key", "__digests", "__firsts"))
    found = found.withColumnsRenamed({"key": own, "digests": digest, "firsts": first})
    rows, untouched = _met(docs.withColumn(own, _key(id_col)), found, own)
    rows = rows.select(*(F.col(f"`{c}`").cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns), own, digest, first)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            for i, (key, digests) in enumerate(zip(b.column(own).to_pylist(), b.column(digest).to_pylist(), strict=True)):
                if digests is None or not texts[i]:
                    continue
                c, raw, _, cuts, _ = _found(texts[i], key, digests, b.column(first)[i].as_py(), least, within)
                ends = np.append(c.words.starts[c.first], len(raw))
                keep, last = [], 0
                for x, y in cuts:
                    keep.append(raw[last : ends[x]].tobytes())
                    last = ends[y]
                texts[i] = b"".join([*keep, raw[last:].tobytes()]).decode()
            columns = [pa.array(texts, pa.string()) if k == at else b.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    columns = [F.col(f"`{c}`") for c in names]
    done = rows.mapInArrow(trimmed(cut), rows.select(*columns).schema)
    return done if untouched is None else done.unionByName(untouched.select(*columns))


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = RUN_WORDS, within: bool = False) -> DataFrame:
    """A row for each row of docs that holds a repeated passage; others give none.

    id, n_words, repeated_words (in passages that other documents, or with within the
    same, hold too),
    removed_words (of those, the ones that dedup cuts) and holders, the ids that keep
    the passages. Nulls, ties and repeated rows as in dedup.
    """
    found = repeats(docs, id_col, text_col, least, within)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), _key(id_col).alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = _met(rows, found, "key")[0].where(F.col("digests").isNotNull())
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("repeated_words", pa.int64()), ("removed_words", pa.int64()), ("holders", pa.list_(pa.int64()))])

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for id_, key, text, digests, firsts in zip(*(b.column(c).to_pylist() for c in ("id", "key", "text", "digests", "firsts")), strict=True):
                if text:
                    c, _, runs, cuts, holders = _found(text, key, digests, firsts, least, within)
                    if runs:
                        out.append((id_, int(c.size.sum()), *(int(sum(c.size[x:y].sum() for x, y in r)) for r in (runs, cuts)), holders))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return rows.select("id", "key", "text", "digests", "firsts").mapInArrow(trimmed(report), "id long, n_words long, repeated_words long, removed_words long, holders array<long>").withColumnRenamed("id", id_col)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """The documents that hold repeated passages."""
    return passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
