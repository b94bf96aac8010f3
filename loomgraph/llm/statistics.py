"""Statistics of whole documents, as the quality rules and the quality classifier use them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.arrays import Words, by_slices, later, mix, powers, repeated, span_hashes, windows

#: The symbols that the rules count.
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:")] = True
_SEED = np.uint64(0x2545F4914F6CDD1D)

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_chars", "n_upper", "n_digits", "n_marks", "n_stops", "n_lines", "n_distinct", "top_word", "long_words", "n_wide"]
COLUMNS = BASE + EXTRA


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _keyed(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(h + (doc.astype(np.uint64) + np.uint64(1)) * _SEED)


def base_arrays(raw: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], Words, np.ndarray]:
    """The five base statistics of each document, its words and their hashes."""
    n = len(offsets) - 1
    words = Words(raw, offsets)
    n_words = np.diff(words.offsets)
    lead = (raw & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(lead)])
    word_chars = np.bincount(words.doc, at[words.ends] - at[words.starts], n).astype(np.int64)
    # lines with a word, cut at \n and at documents
    breaks = np.flatnonzero(raw == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(raw)]
    ends = np.append(starts[1:], len(raw)) if len(starts) else starts
    ends = ends - ((ends > starts) & (raw[np.maximum(ends - 1, 0)] == 10)) if len(starts) else ends
    has = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[has], ends[has]
    line_doc = np.searchsorted(offsets, starts, "right") - 1
    lines = _keyed(line_doc, span_hashes(raw, starts, ends - starts))
    n_dup = np.bincount(line_doc[later(lines)], minlength=n)
    # words inside 8-word windows that the document has at least twice
    h = words.hashes()
    grams, first = windows(h, words.offsets, 8)
    twice = first[repeated(_keyed(words.doc[first], grams))]
    edge = np.zeros(len(h) + 9, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + 8, -1)
    inside = np.cumsum(edge)[: len(h)] > 0
    n_repeat = np.bincount(words.doc[inside], minlength=n)
    base = [n_words, word_chars, _per_doc(_SYMBOL[raw], offsets), n_dup, n_repeat]
    return [x.astype(np.int64) for x in base], words, h


def all_arrays(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Every statistic of COLUMNS for each document."""
    base, words, h = base_arrays(raw, offsets)
    n = len(offsets) - 1
    keys = _keyed(words.doc, h)
    order = np.argsort(keys)
    k = keys[order]
    new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    run = np.diff(np.append(new, len(k)))
    run_doc = words.doc[order[new]]
    top = np.zeros(n, np.int64)
    np.maximum.at(top, run_doc, run)
    extra = [
        _per_doc((raw & 0xC0) != 0x80, offsets),
        _per_doc(_UPPER[raw], offsets),
        _per_doc(_DIGIT[raw], offsets),
        _per_doc(_MARK[raw], offsets),
        _per_doc(_STOP[raw], offsets),
        _per_doc(raw == 10, offsets) + (np.diff(offsets) > 0),
        np.bincount(run_doc, minlength=n),
        top,
        np.bincount(words.doc[words.lengths >= 16], minlength=n),
        _per_doc(raw >= 0xC0, offsets),
    ]
    return base + [x.astype(np.int64) for x in extra]


def with_statistics(docs: DataFrame, id_col: str, text_col: str, full: bool = True) -> DataFrame:
    """(id, statistics...) of each row's whole text; other columns of docs are not read.

    A null text counts as empty, and an empty text has zeros. A null id stays null;
    repeated rows give a row each.
    """
    names = COLUMNS if full else BASE
    key = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = pa.int64() if isinstance(key.schema["id"].dataType, T.LongType) else None
    if kind is None:
        key = key.withColumn("id", F.col("id").cast("long"))
        kind = pa.int64()
    schema = pa.schema([("id", kind), *((c, pa.int64()) for c in names)])
    make = all_arrays if full else lambda raw, offsets: base_arrays(raw, offsets)[0]
    powers(1 << 12)
    return key.mapInArrow(by_slices(make, schema), f"id long, {', '.join(f'{c} long' for c in names)}")
