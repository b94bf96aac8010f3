"""Recursive graph bisection: documents that share terms come to stand near each other.

Documents and terms are a bipartite graph.  Each part is halved, and pairs of documents
change sides as long as that lowers the estimated bits of the terms' gaps on both sides;
then the halves are parts.  All parts of a level are worked on at the same time.
"""

from __future__ import annotations

import numpy as np

from loomgraph.llm.arrays import mix

ITERATIONS = 8


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... of sizes[i] numbers each, one after another."""
    first = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - first, sizes)


def _bits(degree: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Estimated bits of the gaps of terms that so many of n documents hold."""
    return degree * np.log2(n / (degree + 1) + 1e-9)


def _places(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by keys (the first one last to decide), and each row's place among rows with equal last keys."""
    order = np.lexsort(keys)
    head = np.ones(len(order), bool)
    last = keys[-1][order]
    head[1:] = last[1:] != last[:-1]
    return order, np.arange(len(order)) - np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))


class Level:
    """One halving: the part and side of each document, and of each (part, term) its degrees on both sides."""

    def __init__(self, part: np.ndarray, side: np.ndarray, keys: np.ndarray, degrees: np.ndarray, sizes: np.ndarray):
        self.part, self.side, self.keys, self.degrees, self.sizes = part, side, keys, degrees, sizes


def halved(part: np.ndarray, rank: np.ndarray, doc: np.ndarray, terms: np.ndarray, n_terms: int, iterations: int) -> Level:
    """Halves of all parts; rank tells how documents are dealt at first. doc and terms are the edges."""
    n_parts = int(part.max()) + 1
    order, place = _places(rank, part)
    total = np.bincount(part, minlength=n_parts)
    side = np.empty(len(part), np.int64)
    side[order] = place >= (total[part[order]] + 1) // 2
    sizes = np.stack([(total + 1) // 2, total // 2], axis=1)
    keys, edge = np.unique(part[doc] * n_terms + terms, return_inverse=True)
    n = sizes[keys // n_terms].astype(float)

    def degrees() -> np.ndarray:
        return np.bincount(edge * 2 + side[doc], minlength=2 * len(keys)).reshape(-1, 2)

    for _ in range(iterations):
        d = degrees().astype(float)
        now = _bits(d[:, 0], n[:, 0]) + _bits(d[:, 1], n[:, 1])
        gains = np.stack([now - _bits(np.maximum(d[:, a] - 1, 0), n[:, a]) - _bits(d[:, 1 - a] + 1, n[:, 1 - a]) for a in (0, 1)], axis=1)
        gain = np.bincount(doc, gains[edge, side[doc]], len(part))
        order, place = _places(rank, -gain, part * 2 + side)
        starts = np.concatenate([[0], np.cumsum(np.bincount(part * 2 + side, minlength=2 * n_parts))])
        pairs = sizes.min(1)
        at = spread(np.zeros(n_parts, np.int64), pairs)
        mine, other = (order[np.repeat(starts[s : 2 * n_parts : 2], pairs) + at] for s in (0, 1))
        change = gain[mine] + gain[other] > 1e-9
        if not change.any():
            break
        side[mine[change]], side[other[change]] = 1, 0
    return Level(part, side, keys, degrees(), sizes)


def bisected(offsets: np.ndarray, terms: np.ndarray, depth: int, iterations: int = ITERATIONS) -> list[Level]:
    """Levels of the recursion over documents whose distinct terms lie between offsets; documents first stand by their smallest mixed term."""
    if len(offsets) < 2:
        return []
    doc, n_terms = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), int(terms.max(initial=0)) + 1
    least = np.full(len(offsets) - 1, 2**64 - 1, np.uint64)
    np.minimum.at(least, doc, mix(terms.astype(np.uint64) + np.uint64(1)))
    part, out = np.zeros(len(least), np.int64), []
    for _ in range(depth):
        out.append(halved(part, least, doc, terms, n_terms, iterations))
        part = part * 2 + out[-1].side
    return out


class Tree:
    """The upper levels, fitted on a sample: any document goes down by the terms it shares with either half."""

    def __init__(self, levels: list[Level], offsets: np.ndarray, terms: np.ndarray, n_terms: int):
        self.weights, self.limits = [], []
        doc, top = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), int(terms.max(initial=0)) + 1
        for k, level in enumerate(levels):
            weight = np.zeros((1 << k, n_terms), np.float32)
            share = np.log((level.degrees + 1) / (level.sizes[level.keys // top] + 2))
            weight[level.keys // top, level.keys % top] = share[:, 0] - share[:, 1]
            score = np.bincount(doc, weight[level.part[doc], terms], len(offsets) - 1)
            # the limit between the halves: the middle of the part's scores
            limit = [np.median(score[level.part == p]) if (level.part == p).any() else 0.0 for p in range(1 << k)]
            self.weights.append(weight)
            self.limits.append(np.array(limit))

    def leaves(self, offsets: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """The leaf of each document."""
        part, doc = np.zeros(len(offsets) - 1, np.int64), np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        for weight, limit in zip(self.weights, self.limits, strict=True):
            part = part * 2 + (np.bincount(doc, weight[part[doc], terms], len(part)) < limit[part])
        return part
