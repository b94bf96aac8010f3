"""Ranked search against scores of every document, and what the order of documents is good for."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import bisection, ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]+", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def ranked(docs, items, k=10):
    """(item, rank, doc, score) from the formula, over every pair."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, total = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in sorted(set(items), key=repr):
        asked = Counter(terms(text))
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in asked}
        scores = [(sum(w[t] * times * ((10**9 * c[t]) // (1000 * c[t] + 8 * (25 + 75 * n * n_docs // total))) for t, times in asked.items() if t in c), i) for i, c, n in held]
        best = sorted(((s, i) for s, i in scores if s > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out += [(item, r, i, s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out, key=repr)


def corpus(n, seed):
    rng = random.Random(seed)
    topics = [["".join(rng.choice("abcdeäé日") for _ in range(rng.randint(2, 5))) for _ in range(40)] for _ in range(12)]
    common = ["the", "of", "and", "was"]
    docs = []
    for i in range(n):
        own = topics[i % 12]
        words = [rng.choice(common) if rng.random() < 0.3 else rng.choice(own).title() for _ in range(rng.choice([0, 3, 30, 120]))]
        docs.append((i, rng.choice([" ", "\n", "-", "_"]).join(words)))
    items = [(k, " ".join(rng.choice(topics[k % 12] + common) for _ in range(rng.randint(1, 12)))) for k in range(25)]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def rows_of(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize(("postings", "shard"), [(500_000, 64), (3000, 4), (400, 1)])
def test_search_against_every_document(spark, postings, shard, monkeypatch):
    monkeypatch.setattr(ranked_search, "SEGMENT_POSTINGS", postings)
    monkeypatch.setattr(ranked_search, "SHARD_DOCS", shard)
    docs, items = corpus(700, 4)
    docs += [(i + 2000, docs[5][1]) for i in range(60)] + [(5, docs[5][1]), (None, docs[5][1]), (9000, " ".join(["the", "Of"] * 4000))]
    items += [(90, docs[5][1]), (91, docs[5][1]), items[0], (92, "nowhere"), (93, ""), (94, None), (None, docs[2][1]), (95, "the THE the")]
    want = ranked(docs, [(i, t or "") for i, t in items])
    frame, asked = frames(spark, docs, items)
    assert rows_of(ranked_search.search(frame.repartition(5), asked)) == want
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", 700)
    assert rows_of(ranked_search.search(frame.withColumn("rank", F.lit("x")).withColumn("n", F.lit("x")), asked.withColumn("score", F.lit(1)))) == want


def test_search_without_rows(spark):
    docs, items = frames(spark, [(1, None), (2, ""), (3, "-- !")], [(1, "a b")])
    assert ranked_search.search(docs, items).count() == 0
    assert ranked_search.search(docs.limit(0), items).count() == 0
    out = ranked_search.search(docs, items.limit(0))
    assert out.count() == 0 and out.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def graph(n, topics, seed):
    """Documents of topics in random order: offsets and terms."""
    rng = random.Random(seed)
    held = [sorted({rng.randrange(30) + 30 * rng.randrange(topics) if rng.random() < 0.1 else rng.randrange(30) + 30 * (k % topics) for _ in range(12)}) for k in rng.sample(range(n), n)]
    return np.concatenate([[0], np.cumsum([len(x) for x in held])]), np.concatenate(held).astype(np.int64)


def bits(offsets, values, order):
    """log2 of the gaps of all terms' lists in an order."""
    place = np.argsort(order)
    total = 0.0
    for t in np.unique(values):
        at = np.sort(place[np.searchsorted(offsets, np.flatnonzero(values == t), "right") - 1])
        total += np.log2(np.diff(np.concatenate([[-1], at]))).sum()
    return total


def test_bisection_brings_alike_documents_together():
    offsets, values = graph(512, 8, 1)
    levels = bisection.bisected(offsets, values, 4)
    part = np.zeros(512, np.int64)
    for level in levels:
        # halves differ by no more than one document
        both = np.bincount(level.part * 2 + level.side, minlength=2 * (level.part.max() + 1)).reshape(-1, 2)
        assert (abs(both[:, 0] - both[:, 1]) <= 1).all()
        assert (level.part == part).all()
        part = part * 2 + level.side
    assert bits(offsets, values, np.argsort(part, kind="stable")) < 0.8 * bits(offsets, values, np.arange(512))
    # the tree that is fitted on them deals other documents of the topics much as evenly
    tree = bisection.Tree(levels, offsets, values, 240)
    other = graph(4000, 8, 2)
    counts = np.bincount(tree.leaves(*other), minlength=16)
    assert counts.max() < 5 * 4000 / 16


def test_shards_are_left_unvisited():
    """Bounds of shards in the order of the bisection end the search early, with the same best documents."""
    docs, items = corpus(3000, 9)
    held = ranked_search.Items([i for i, _ in items], [t for _, t in items])
    counted = [Counter(terms(t)) for _, t in docs]
    n_terms = sum(sum(c.values()) for c in counted)
    n_docs = sum(bool(c) for c in counted)
    raw = "".join(t for _, t in docs).encode()
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for _, t in docs])])
    n, offsets, values, times = held.counts(np.frombuffer(raw, np.uint8), at)
    assert n.tolist() == [sum(c.values()) for c in counted]
    df = np.bincount(values, minlength=len(held.terms))
    visits = {}
    for name, order in (("bisected", None), ("given", np.arange(len(docs)))):
        if order is None:
            part = np.zeros(len(docs), np.int64)
            for level in bisection.bisected(offsets, values, 6):
                part = part * 2 + level.side
            order = np.argsort(part, kind="stable")
        place = np.argsort(order)
        doc = np.repeat(np.arange(len(docs)), np.diff(offsets))
        impact = ranked_search.impacts(times, n[doc], n_docs, n_terms)
        by = np.lexsort((place[doc], values))
        term, where, impact = values[by], place[doc][by], impact[by]
        shard = where // ranked_search.SHARD_DOCS
        start = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (shard[1:] != shard[:-1])]))
        visitor = ranked_search.Visitor(held, ranked_search.term_weights(n_docs, df), 10, ranked_search.SHARD_DOCS)
        visitor.take(order, np.ones(len(docs), bool), term[start], shard[start], start, np.maximum.reduceat(impact, start), where, impact)
        got = [(held.ids[k], r, int(i), int(s)) for k, b in enumerate(visitor.best) for r, (i, s) in enumerate(zip(b.id, b.score, strict=True), 1)]
        assert sorted(got, key=repr) == ranked(docs, items)
        visits[name] = visitor.visited
        assert visitor.shards == len(items) * -(-len(docs) // ranked_search.SHARD_DOCS)
    assert visits["bisected"] < 0.5 * visits["given"]
