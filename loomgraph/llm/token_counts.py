"""Token counts by rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens as byte spans, in numpy, and equal ones are counted once.
Pre-tokens that were not seen before are held as rows of symbol matrices, one matrix
for each row length.  In a round every row applies its lowest-ranked pair, the
leftmost of them, which shortens it by one; rows without a pair are done, the others
join the matrix of the next length.  Rows longer than any matrix is worth lie end to
end in one flat array, and a round applies all places of a row's lowest-ranked pair
at once where no merge of that pair can give rise to a lower rank.  What survives is
the number of tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.arrays import flat, slices, span_hashes, trimmed
from loomgraph.llm.session import prepare

#: The character that stands for a space in pieces, and its bytes (fixed values of the format).
META = "▁"
META_BYTES = META.encode()
#: Rows of up to so many symbols lie in matrices, longer ones in a flat array; the rounds are the same.
MATRIX = 64
#: Pre-tokens remembered by a task, by a 64-bit hash of their bytes.
REMEMBERED = 500_000
NEVER = np.int32(2**31 - 1)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a serialised message; fixed-width values as bytes."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[i : i + size]
        i += size


@dataclass
class PieceModel:
    """Tables of a byte-fallback BPE model: symbols of characters, and ranks of pairs."""

    symbol: np.ndarray  # code point -> symbol, the last entry for characters in no piece
    fallback: np.ndarray  # symbol -> whether it is no piece, so that its bytes count
    keys: np.ndarray  # left * size + right, sorted
    ranks: np.ndarray
    merged: np.ndarray
    size: int
    prefix: bool
    cut: bool  # whether no piece goes on after a space, so that spaces end pre-tokens
    lone: np.ndarray  # symbol -> whether a pair with it may rank before the pair that made it
    seen: dict = field(default_factory=dict)

    @classmethod
    def read(cls, path: str) -> PieceModel:
        """Reads a serialised model file. ValueError for what the method can't give exactly."""
        with open(path, "rb") as f:
            data = f.read()
        pieces, spec, trainer = [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                x = dict(_fields(value))
                pieces.append((x[1].decode(), float(np.frombuffer(x.get(2, bytes(4)), "<f4")[0]), x.get(3, 1)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                spec = dict(_fields(value))
        if trainer.get(3, 1) != 2 or spec.get(2) or spec.get(4, 1) or not spec.get(5, 1) or not trainer.get(35):
            raise ValueError("only BPE models with byte fallback and identity normalisation")
        if {kind for _, _, kind in pieces} - {1, 2, 3, 6}:
            raise ValueError("user-defined or unused pieces")
        return cls.of({p: s for p, s, kind in pieces if kind == 1}, bool(spec.get(3, 1)))

    @classmethod
    def of(cls, scores: dict[str, float], prefix: bool) -> PieceModel:
        """From pieces and their scores; the highest score merges first."""
        ids = {p: i for i, p in enumerate(scores)}
        known = len(ids)
        for c in sorted({c for p in scores for c in p} - ids.keys()):
            ids[c] = len(ids)
        size = len(ids) + 1
        symbol = np.full(0x110000, size - 1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                symbol[ord(p)] = i
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        rows = [(ids[p[:k]] * size + ids[p[k:]], order[s], ids[p]) for p, s in scores.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        table = np.array(sorted(rows), np.int64).reshape(-1, 3)
        fallback = np.zeros(size, bool)
        fallback[known:] = True
        cut = not any(re.search(f"[^{META}]{META}", p) for p in scores)
        made = np.full(size, -1, np.int64)
        made[list(range(known))] = [order[s] for s in scores.values()]
        lone = np.zeros(size, bool)
        for part in (table[:, 0] // size, table[:, 0] % size):
            lone[part[table[:, 1] <= made[part]]] = True
        return cls(symbol, fallback, table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32), size, prefix, cut, lone)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}}

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; NEVER where it is none."""
        if not len(self.keys):
            return np.full(left.shape, NEVER), np.zeros(left.shape, np.int32)
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], NEVER), self.merged[at]

    def _flat(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Symbols that survive in each of the rows that symbols holds end to end."""
        out, rows = np.zeros(len(lengths), np.int64), np.arange(len(lengths))
        while len(rows):
            starts = np.cumsum(lengths) - lengths
            rank, merged = self.pairs(symbols[:-1], symbols[1:])
            rank = np.append(rank, NEVER)
            rank[starts + lengths - 1] = NEVER
            least = np.minimum.reduceat(rank, starts)
            done = least == NEVER
            out[rows[done]] = lengths[done]
            hit = (rank == np.repeat(least, lengths)) & (rank != NEVER)
            at = np.flatnonzero(hit)
            if not len(at):
                break
            row = np.searchsorted(starts, at, "right") - 1
            # of pairs that overlap, as in runs of one symbol, every second one from the left
            head = np.ones(len(at), bool)
            head[1:] = at[1:] != at[:-1] + 1
            begin = np.flatnonzero(head)
            keep = (at - at[begin[np.cumsum(head) - 1]]) % 2 == 0
            first = np.ones(len(at), bool)
            first[1:] = row[1:] != row[:-1]
            # only the leftmost where the new symbol may come before the other places
            alone = np.zeros(len(lengths), bool)
            alone[row[self.lone[merged[at]]]] = True
            at = at[keep & (first | ~alone[row])]
            symbols = symbols.copy()
            symbols[at] = merged[at]
            stay = np.repeat(~done, lengths)
            stay[at + 1] = False
            lengths = (lengths - np.bincount(np.searchsorted(starts, at, "right") - 1, minlength=len(lengths)))[~done]
            symbols, rows = symbols[stay], rows[~done]
        return out

    def count(self, tokens: list[str]) -> np.ndarray:
        """Tokens of each non-empty pre-token."""
        points = np.frombuffer("".join(tokens).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        starts = np.cumsum(lengths) - lengths
        symbols = self.symbol[points]
        # characters without a piece count by their UTF-8 bytes
        wide = np.where(self.fallback[symbols], (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF), 0)
        out = np.add.reduceat(wide, starts)
        long = np.flatnonzero(lengths > MATRIX)
        if len(long):
            out[long] += self._flat(symbols[np.repeat(lengths > MATRIX, lengths)], lengths[long])
        rows = np.zeros(0, np.int64)
        held, ranks, merged = (np.zeros((0, 0), np.int32) for _ in range(3))
        for n in range(int(min(lengths.max(), MATRIX)), 0, -1):
            new = np.flatnonzero(lengths == n)
            if len(new):
                fresh = symbols[starts[new][:, None] + np.arange(n)]
                r, m = self.pairs(fresh[:, :-1], fresh[:, 1:])
                old = len(rows)
                rows = np.concatenate([rows, new])
                held = np.concatenate([held.reshape(old, n), fresh])
                ranks, merged = np.concatenate([ranks.reshape(old, n - 1), r]), np.concatenate([merged.reshape(old, n - 1), m])
            if not len(rows):
                continue
            if n == 1:
                out[rows] += 1
                break
            at = ranks.argmin(axis=1)
            row = np.arange(len(rows))
            going = ranks[row, at] != NEVER
            out[rows[~going]] += n
            rows, held, ranks, merged, at = rows[going], held[going], ranks[going], merged[going], at[going]
            row = np.arange(len(rows))
            held[row, at] = merged[row, at]
            stay = np.arange(n) != (at + 1)[:, None]
            held = held[stay].reshape(len(rows), n - 1)
            stay = np.arange(n - 1) != at[:, None]
            ranks, merged = ranks[stay].reshape(len(rows), n - 2), merged[stay].reshape(len(rows), n - 2)
            for side in (at - 1, at):
                ok = np.flatnonzero((side >= 0) & (side < n - 2))
                ranks[ok, side[ok]], merged[ok, side[ok]] = self.pairs(held[ok, side[ok]], held[ok, side[ok] + 1])
        return out

    def _spans(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, starts, lengths, documents) of the pre-tokens of a slice of texts that hold no META themselves."""
        n = len(offsets) - 1
        sizes = np.diff(offsets)
        if self.prefix:
            # a space before each text that is not empty
            some = sizes > 0
            raw, sizes = np.insert(raw, offsets[:-1][some], 0x20), sizes + some
            offsets = np.concatenate([[0], np.cumsum(sizes)])
        head = np.zeros(len(raw), bool)
        if self.cut and len(raw):
            head[1:] = (raw[1:] == 0x20) & (raw[:-1] != 0x20)
        head[offsets[:-1][sizes > 0]] = True
        starts = np.flatnonzero(head)
        doc = np.repeat(np.arange(n), np.diff(np.searchsorted(starts, offsets)))
        return raw, starts, np.diff(np.append(starts, len(raw))), doc

    def count_slice(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text of a slice; empty ones have none."""
        n = len(offsets) - 1
        raw, starts, lengths, doc = self._spans(raw, offsets)
        if not len(starts):
            return np.zeros(n, np.int64)
        h, at, which = np.unique(span_hashes(raw, starts, lengths), return_index=True, return_inverse=True)
        known = self.seen
        counts = np.array([known.get(k, -1) for k in h.tolist()], np.int64)
        new = np.flatnonzero(counts < 0)
        if len(new):
            words = [raw[a : a + m].tobytes().decode().replace(" ", META) for a, m in zip(starts[at[new]].tolist(), lengths[at[new]].tolist(), strict=True)]
            counts[new] = self.count(words)
            if len(known) > REMEMBERED:
                known.clear()
            known.update(zip(h[new].tolist(), counts[new].tolist(), strict=True))
        return np.bincount(doc, counts[which], n).astype(np.int64)

    def count_texts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; null and empty ones have none."""
        # a META in a text counts as a space
        raw, offsets = flat(pa.array([t and t.replace(META, " ") for t in texts], pa.string()))
        return [n for i, j in slices(offsets) for n in self.count_slice(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).tolist()]


def holds(raw: np.ndarray, part: bytes) -> bool:
    """Whether bytes stand anywhere in an array, without a copy of it."""
    return re.search(re.escape(part), memoryview(raw)) is not None if len(raw) else False


def count_tokens(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every row's whole text.

    Null counts as empty: no bytes, no tokens. Very long texts are taken whole. Equal
    pre-tokens are told by 64-bit hashes, which agree by chance less than once in 10^9
    tasks. Ids pass as they are; repeated rows
    give a row each, and other columns are not read.
    """
    prepare(docs.sparkSession)
    key = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            raw, offsets = flat(text)
            sizes = np.diff(offsets)
            if holds(raw, META_BYTES):
                counts = model.count_texts(text.to_pylist())
            else:
                counts = [n for i, j in slices(offsets) for n in model.count_slice(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], schema=schema)

    out = key.mapInArrow(trimmed(run), "id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit).withColumnRenamed("id", id_col)


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    import public_tokenizers

    model = PieceModel.read(public_tokenizers.path("piece_bpe_32k.model"))
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), model)
