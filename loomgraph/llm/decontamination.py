"""Benchmark decontamination by the q-gram lemma.

An edit spoils at most one of the disjoint q-grams that an item is cut into.  So an
item that stands in a document with at most k edits shares at least (number of its
disjoint q-grams) - k of them with it, all within k + 1 neighbouring diagonals.  Shared
q-grams are counted in overlapping bands of diagonals; what reaches the bound must also
reach the bound of the lemma for all overlapping grams of a smaller length, and is then
aligned in full within its band, many regions at a time.  Only the disjoint q-grams are
indexed, so an index takes about three times the items' text.

Texts are compared lower-cased (A-Z) and with white space as single spaces; lengths
and edits are in UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.arrays import LOWER, SPACE, flat, mix, slices, trimmed
from loomgraph.llm.session import prepare

Q, SMALL = 10, 5
#: Edits allowed for each byte of an item; fewer where the lemma's bound would vanish.
EDIT_RATE = 0.08
#: Items are sent to the executors in blocks of at most so many bytes; more items take a scan more for each block.
BLOCK_BYTES = 64 << 20
#: Postings that are expanded at a time, grams compared at a time, and cells of bands aligned at a time.
HITS, GRAMS, CELLS = 1 << 20, 1 << 20, 1 << 19
#: Bytes that words are made of, for items too short for a q-gram.
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_UNIT, _NEVER = np.int64(1) << 32, np.int64(1) << 60


def normalise(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with runs of white space as one space, and the new offsets."""
    space = SPACE[raw]
    keep = ~space
    keep[1:] |= ~space[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    keep[inner] = True
    out = LOWER[raw]
    out[space] = 0x20
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def codes(text: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A code of the n bytes from each place on, itself up to eight of them and a hash of nine."""
    out = np.zeros(len(at), np.uint64)
    for k in range(min(n, 8)):
        out |= text[at + k].astype(np.uint64) << np.uint64(8 * k)
    return out if n <= 8 else out * np.uint64(0x9E3779B97F4A7C15) ^ mix(text[at + 8].astype(np.uint64))


def gram_codes(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The upper halves of qgrams() at some places."""
    two = text[at + 8].astype(np.uint64) | (text[at + 9].astype(np.uint64) << np.uint64(8))
    return ((codes(text, at, 8) * np.uint64(0x9E3779B97F4A7C15) ^ mix(two)) >> np.uint64(32)).astype(np.uint32)


def qgrams(text: np.ndarray) -> np.ndarray:
    """Hash of the Q bytes from each position on (Q is 10: eight exact bytes, mixed with two)."""
    n = len(text) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    b = text.astype(np.uint64)
    two = b[:-1] | (b[1:] << np.uint64(8))
    four = two[:-2] | (two[2:] << np.uint64(16))
    eight = four[:-4] | (four[4:] << np.uint64(32))
    return eight[:n] * np.uint64(0x9E3779B97F4A7C15) ^ mix(two[8 : 8 + n])


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... n[0] numbers of them, then those of the next range."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def align(items: list[np.ndarray], regions: list[np.ndarray], budget: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, int, int] | None]:
    """(edits, start, end) of the best place of each item in its region on diagonals low to high; None beyond budget.

    All bands are of one width. A row of every band at a time: cell d of row i is the
    end at region[i + low + d]. Costs carry their start, so that no way back is needed.
    """
    out: list[tuple[int, int, int] | None] = [None] * len(items)
    if not items:
        return out
    size, total = np.array([len(x) for x in items]), np.array([len(x) for x in regions])
    order = np.argsort(-size, kind="stable")
    text, item = np.concatenate([*regions, np.zeros(1, np.uint8)]), np.concatenate([*items, np.zeros(1, np.uint8)])
    text_at, item_at = np.cumsum(total) - total, np.cumsum(size) - size
    column = low[:, None] + np.arange(int(high[0] - low[0]) + 1)
    slope = np.arange(column.shape[1]) * _UNIT
    row = np.where((column >= 0) & (column <= total[:, None]), column.astype(np.int64), _NEVER)
    live, column, row = order, column[order], row[order]
    i = 0
    while len(live):
        here, room = column + i, total[live][:, None]
        inside = (here >= 0) & (here < room)
        same = inside & (text[np.where(inside, text_at[live][:, None] + here, 0)] == item[item_at[live] + i][:, None])
        new = np.where(inside, row + np.where(same, 0, _UNIT), _NEVER)
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + _UNIT)  # a byte of the item is missing
        outside = (here + 1 < 0) | (here + 1 > room)
        new[outside] = _NEVER
        row = np.minimum.accumulate(new - slope, axis=1) + slope  # a byte too many
        row[outside] = _NEVER
        i += 1
        best = row.argmin(axis=1)
        cost = row[np.arange(len(live)), best]
        fits = (cost >> 32) <= budget[live]
        for x in np.flatnonzero(fits & (size[live] == i)).tolist():
            n = int(live[x])
            out[n] = (int(cost[x] >> 32), int(cost[x] & 0xFFFFFFFF), int(best[x] + low[n] + size[n]))
        stay = fits & (size[live] > i)
        live, column, row = live[stay], column[stay], row[stay]
    return out


class ItemIndex:
    """Disjoint q-grams of a block of items, and their edit budgets."""

    def __init__(self, ids: list[int], texts: list[str]):
        raw, offsets = flat(pa.array(texts, pa.string()))
        raw, offsets = normalise(raw, offsets)
        start, end = offsets[:-1].copy(), offsets[1:].copy()
        # normalised items have one space at most at either end
        start += (start < end) & (raw[np.minimum(start, max(len(raw) - 1, 0))] == 0x20 if len(raw) else False)
        end -= (start < end) & (raw[np.maximum(end - 1, 0)] == 0x20 if len(raw) else False)
        self.text, self.ids, self.start, self.size = raw, np.array(ids, np.int64), start, end - start
        grams = self.size // Q
        self.budget = np.maximum(np.minimum(np.floor(EDIT_RATE * self.size), grams - 1), 0).astype(np.int64)
        self.bound = grams - self.budget
        place = np.repeat(start, grams) + Q * spread(np.zeros(len(grams), np.int64), grams)
        h = np.zeros(0, np.uint32)
        if len(place):
            h = gram_codes(raw, place)
        order = np.argsort(h, kind="stable")
        self.keys, self.post = h[order], place[order].astype(np.int32)
        bits = int(np.clip(np.ceil(np.log2(max(len(h), 1) * 8)), 12, 30))
        self.shift = np.uint32(32 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[self.keys >> self.shift] = True
        # items without a q-gram, by their size
        self.short = {}
        for n in range(1, Q):
            at = np.flatnonzero(self.size == n)
            if len(at):
                code = codes(raw, start[at], n)
                order = np.argsort(code, kind="stable")
                self.short[n] = (code[order], at[order])

    @property
    def items(self) -> list[bytes]:
        return [self.bytes_of(i).tobytes() for i in range(len(self.size))]

    def bytes_of(self, item: int) -> np.ndarray:
        return self.text[self.start[item] : self.start[item] + self.size[item]]

    def matches(self, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, item, edits, bytes) of each item in each document of a slice, its best place."""
        text, offsets = normalise(raw, offsets)
        out = self._words(text, offsets)
        if not len(self.keys):
            return out
        h = (qgrams(text) >> np.uint64(32)).astype(np.uint32)
        at = np.flatnonzero(self.seen[h >> self.shift])
        low, high = np.searchsorted(self.keys, h[at], "left"), np.searchsorted(self.keys, h[at], "right")
        doc = np.searchsorted(offsets, at, "right") - 1
        real = (high > low) & (at + Q <= offsets[doc + 1])
        at, low, n, doc = at[real], low[real], (high - low)[real], doc[real]
        # as many documents at a time as give HITS postings, or one of them in parts of the items
        i, ends = 0, np.append(np.flatnonzero(doc[1:] != doc[:-1]) + 1, len(doc)) if len(doc) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(n)])
        while i < len(doc):
            fits = ends[(ends > i) & (total[ends] - total[i] <= HITS)]
            j = int(fits[-1]) if len(fits) else int(ends[ends > i][0])
            out += self._verified(text, offsets, *self._candidates(at[i:j], low[i:j], n[i:j], doc[i:j], offsets))
            i = j
        return out

    def _words(self, text: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Items too short for a q-gram, found unchanged and as whole words."""
        out, edge = [], np.append(~_WORD[text], True)
        for n, (code, item) in self.short.items():
            if len(text) < n:
                continue
            at = np.arange(len(text) - n + 1)
            doc = np.searchsorted(offsets, at, "right") - 1
            inside = at + n <= offsets[doc + 1]
            whole = inside & (edge[at - 1] | (at == offsets[doc])) & (edge[at + n] | (at + n == offsets[doc + 1]))
            at, doc = at[whole], doc[whole]
            here = codes(text, at, n)
            low, high = np.searchsorted(code, here, "left"), np.searchsorted(code, here, "right")
            pairs = np.unique(np.column_stack([np.repeat(doc, high - low), item[spread(low, high - low)]]), axis=0)
            out += [(int(d), int(self.ids[i]), 0, n) for d, i in pairs.tolist()]
        return out

    def _candidates(self, at: np.ndarray, low: np.ndarray, n: np.ndarray, doc: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, band) of the bands that reach their bound."""
        parts = -(-int(n.sum()) // HITS)
        # a part takes the items of a range, so that each band is counted whole
        edges = np.linspace(0, len(self.size), parts + 1).astype(np.int64)
        steps = [0, *(np.searchsorted(np.cumsum(n), np.arange(1, parts) * HITS) + 1).tolist(), len(n)]
        found = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            hits = []
            for x, y in zip(steps[:-1], steps[1:], strict=True):
                place = self.post[spread(low[x:y], n[x:y])].astype(np.int64)
                item = np.searchsorted(self.start, place, "right") - 1
                where, d = np.repeat(at[x:y], n[x:y]), np.repeat(doc[x:y], n[x:y])
                if parts > 1:
                    mine = (item >= a) & (item < b)
                    place, item, where, d = place[mine], item[mine], where[mine], d[mine]
                hits.append((place, item, where, d))
            found.append(self._counted(*(np.concatenate(x) for x in zip(*hits, strict=True)), offsets))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _counted(self, place: np.ndarray, item: np.ndarray, at: np.ndarray, doc: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place = place - self.start[item]
        # each hit lies in two bands of twice the width, so a match lies within one
        band = (at - offsets[doc] - place) // (self.budget[item] + 1)
        band, doc, item, place = np.concatenate([band, band - 1]), np.tile(doc, 2), np.tile(item, 2), np.tile(place, 2)
        order = np.lexsort((place, band, item, doc))
        doc, item, band, place = doc[order], item[order], band[order], place[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])
        fresh = new.copy()
        fresh[1:] |= place[1:] != place[:-1]
        start = np.flatnonzero(new)
        if len(start):
            start = start[np.add.reduceat(fresh.astype(np.int64), start) >= self.bound[item[start]]]
        return doc[start], item[start], band[start]

    def _verified(self, text: np.ndarray, offsets: np.ndarray, doc: np.ndarray, item: np.ndarray, band: np.ndarray) -> list[tuple[int, int, int, int]]:
        """What an alignment of each candidate's band confirms."""
        k = self.budget[item]
        base, end = offsets[doc], offsets[doc + 1]
        low, high = band * (k + 1) - k, (band + 2) * (k + 1) + k
        a = np.maximum(base + low, base)
        b = np.maximum(np.minimum(base + high + self.size[item] + k, end), a)
        keep = self._promising(text, offsets, doc, item, a, b)
        doc, item, k, base, low, high, a, b = (x[keep] for x in (doc, item, k, base, low, high, a, b))
        low, high = base + low - a, base + high - a
        best: dict[tuple[int, int], tuple[int, int]] = {}
        # one width of band at a time
        for edits in np.unique(k).tolist():
            group = np.flatnonzero(k == edits)
            step = max(1, CELLS // (4 * edits + 3))
            for x in range(0, len(group), step):
                part = group[x : x + step]
                part = part[[best.get((int(doc[c]), int(item[c])), (1,))[0] > 0 for c in part]]
                found = align([self.bytes_of(i) for i in item[part]], [text[p:q] for p, q in zip(a[part], b[part], strict=True)], k[part], low[part], high[part])
                for c, f in zip(part.tolist(), found, strict=True):
                    pair = (int(doc[c]), int(item[c]))
                    if f and f[0] < best.get(pair, (edits + 1,))[0]:
                        best[pair] = (f[0], f[2] - f[1])
        return [(d, int(self.ids[i]), n, size) for (d, i), (n, size) in best.items()]

    def _promising(self, text: np.ndarray, offsets: np.ndarray, doc: np.ndarray, item: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Candidates that also share as many small grams as the lemma asks for, with the document and then with the region."""
        need = self.size - SMALL + 1 - SMALL * self.budget
        small = np.maximum(self.size - SMALL + 1, 0)
        pair, of_pair = np.unique(doc * len(self.size) + item, return_inverse=True)
        pair_doc, pair_item = pair // len(self.size), pair % len(self.size)
        held = np.unique(pair_doc)
        n = np.maximum(offsets[held + 1] - offsets[held] - SMALL + 1, 0)
        shift = np.uint64(64 - int(np.clip(np.ceil(np.log2(max(int(n.sum()), 1) * 16)), 12, 24)))
        table = np.zeros(1 << (64 - int(shift)), bool)
        table[mix(codes(text, spread(offsets[held], n), SMALL) ^ np.repeat(mix(held.astype(np.uint64) + np.uint64(1)), n)) >> shift] = True
        likely = np.zeros(len(pair), bool)
        for i in range(0, len(pair), step := max(1, GRAMS // max(int(small[pair_item].max(initial=1)), 1))):
            d, x = pair_doc[i : i + step], pair_item[i : i + step]
            grams = codes(self.text, spread(self.start[x], small[x]), SMALL) ^ np.repeat(mix(d.astype(np.uint64) + np.uint64(1)), small[x])
            likely[i : i + step] = np.bincount(np.repeat(np.arange(len(x)), small[x]), table[mix(grams) >> shift], len(x)) >= need[x]
        at = np.flatnonzero(likely[of_pair])
        large = np.maximum(b - a - SMALL + 1, 0)
        out, total, i = np.zeros(len(at), bool), np.concatenate([[0], np.cumsum(small[item[at]] + large[at])]), 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(total, total[i] + GRAMS, "right")) - 1)
            x, n = item[at[i:j]], large[at[i:j]]
            mark = mix(np.arange(j - i, dtype=np.uint64) + np.uint64(1))
            mine = codes(self.text, spread(self.start[x], small[x]), SMALL) ^ np.repeat(mark, small[x])
            other = codes(text, spread(a[at[i:j]], n), SMALL) ^ np.repeat(mark, n)
            out[i:j] = np.bincount(np.repeat(np.arange(j - i), small[x]), np.isin(mine, other), j - i) >= need[x]
            i = j
        return at[out]


def _blocks(benchmark: DataFrame, item_col: str, item_text: str) -> Iterator[ItemIndex]:
    """Indexes of the items, each of about BLOCK_BYTES of text at most, which take about three times as much."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).where(F.col("text").isNotNull())
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long")).first()[0]
    n = max(1, -(-total // BLOCK_BYTES))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).orderBy("item", "text").collect()
        yield ItemIndex([r["item"] for r in part], [r["text"] for r in part])


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """id, item, edits, n_bytes for each row and benchmark item found in it.

    Items that are null or hold nothing but white space match nothing; those under Q
    bytes only match unchanged and as whole words, those under 2 * Q bytes only
    unchanged. Null and empty texts hold nothing. Ids pass as they are, null ones too;
    repeated rows and repeated items are reported each. Clean documents give no row.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = pa.schema([("id", pa.int64()), ("item", pa.int64()), ("edits", pa.int64()), ("n_bytes", pa.int64())])

    def searcher(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for b in batches:
                raw, offsets = flat(b.column("text"))
                ids = b.column("id").to_pylist()
                for i, j in slices(offsets):
                    found = index.matches(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    if found:
                        d, item, edits, size = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array([ids[i + x] for x in d], pa.int64()), *(pa.array(x, pa.int64()) for x in (item, edits, size))], schema=schema)

        return trimmed(run)

    out = None
    for index in _blocks(benchmark, item_col, item_text):
        found = rows.mapInArrow(searcher(spark.sparkContext.broadcast(index)), "id long, item long, edits long, n_bytes long")
        out = found if out is None else out.unionByName(found)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that hold no benchmark item; columns unchanged. Nulls as in leaks, so null texts stay."""
    spark = prepare(docs.sparkSession)
    names = docs.columns
    at = names.index(text_col)

    def keeper(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for b in batches:
                raw, offsets = flat(b.column(at))
                stays = np.ones(len(b), bool)
                for i, j in slices(offsets):
                    stays[[i + d for d, *_ in index.matches(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])]] = False
                yield b.filter(pa.array(stays))

        return trimmed(run)

    out = docs.select(*(F.col(f"`{c}`").cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in names))
    for index in _blocks(benchmark, item_col, item_text):
        out = out.mapInArrow(keeper(spark.sparkContext.broadcast(index)), out.schema)
    return out


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return leaks(docs, benchmark)
