"""Stored tables, queues, caches, indexes and streams: what they leave behind when something goes wrong."""

import math
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomgraph import streaming as S
from loomgraph.operators import search as X
from loomgraph.operators.store import ConstraintError, Store
from loomgraph.sources import cache
from loomgraph.streaming.queue import Queue

PAPER = "id long, title string, doi string, state string"


def papers(spark, rows):
    return spark.createDataFrame(rows, PAPER)


def held(store, version=None):
    return sorted(map(tuple, store.read(version).collect()))


def test_store_merges_and_keeps_its_constraints(spark, tmp_path):
    store = Store(spark, str(tmp_path / "papers"), "id", PAPER, unique=("doi",), required=("state",), buckets=4)
    assert store.install() == store.install() == 0 and held(store) == []
    policy = {"create_only": ("state",), "non_empty": ("title",)}
    first = [(i, f"t{i}", f"10/{i}" if i % 2 else None, "new") for i in range(20)]
    assert store.merge(papers(spark, first), **policy) == 1 and held(store) == sorted(first)
    # a replay changes nothing, and an older record takes nothing back
    assert store.merge(papers(spark, first), **policy) == 1
    folders = store._manifest()
    assert store.merge(papers(spark, [(3, " ", None, "lost"), (99, "late", None, "new")]), **policy) == 2
    after = {r[0]: r for r in held(store)}
    assert after[3] == (3, "t3", "10/3", "new") and len(after) == 21
    # only the bucket that changed was written
    assert sum(folders.get(b) != f for b, f in store._manifest().items()) == 1
    for bad, said in (([(50, "x", "10/7", "new")], "doi is unique"), ([(50, "x", "d", "new"), (51, "x", "d", "new")], "doi is unique"), ([(50, "x", None, None)], "state is required"), ([(50, "x", None, "a"), (50, "y", None, "b")], "id: null or several"), ([(None, "x", None, "a")], "id: null or several")):
        with pytest.raises(ConstraintError, match=said):
            store.merge(papers(spark, bad), **policy)
        assert store.version() == 2 and {r[0]: r for r in held(store)} == after
    # the doi moves within one merge; earlier versions can still be read until they are forgotten
    assert store.merge(papers(spark, [(50, "x", "10/50", "new")]), **policy) == 3
    assert held(store, 1) == sorted(first)
    assert store.forget() and held(store) == sorted([*after.values(), (50, "x", "10/50", "new")])
    again = Store(spark, str(tmp_path / "papers"), "id", PAPER, unique=("doi",), required=("state",), buckets=4)
    assert again.version() == 3 and held(again) == held(store)


def test_store_survives_a_merge_that_breaks_off(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "t"), "id", PAPER, buckets=2)
    store.merge(papers(spark, [(1, "a", None, "s")]))

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Store, "_put_up", broken)
        with pytest.raises(RuntimeError, match="lost"):
            store.merge(papers(spark, [(1, "b", None, "s"), (2, "c", None, "s")]))
    assert held(store) == [(1, "a", None, "s")]
    assert store.merge(papers(spark, [(1, "b", None, "s"), (2, "c", None, "s")])) == 2 and len(held(store)) == 2
    # two merges that start from one version: the second to end is refused
    with pytest.raises(RuntimeError, match="another merge"):
        store._put_up(2, {})


def test_queue_goes_on_where_it_stopped(spark, tmp_path):
    rows = spark.createDataFrame([(i, 2000 + i % 7) for i in range(11)], "paper long, year int")
    queue = Queue(spark, str(tmp_path / "q"), "paper")
    queue.add(rows, F.desc("year"), F.asc("paper"), per_commit=2)
    taken = []

    def work(batch):
        found = sorted(r["paper"] for r in batch.collect())
        if found == fail:
            raise ValueError("killed")
        taken.append(found)
        return batch.select("paper", (F.col("year") * 2).alias("twice"))

    fail = None
    assert queue.run(work, limit=2) == 2 and len(taken) == 2
    order = [r["paper"] for r in rows.orderBy(F.desc("year"), "paper").collect()]
    files = [sorted(order[i : i + 2]) for i in range(0, 11, 2)]
    fail = next(f for f in files if f not in taken)
    with pytest.raises(Exception, match="killed"):
        while queue.run(work):
            pass
    done = len(taken)
    assert 2 <= done < 6 and all(f in files for f in taken)
    fail = None
    assert queue.run(work) == 6 - done and sorted(taken) == sorted(files)
    assert queue.run(work) == 0
    # papers that were queued once don't come again
    queue.add(rows.unionByName(spark.createDataFrame([(50, 1999)], "paper long, year int")), F.desc("year"), per_commit=2)
    assert queue.run(work) == 1 and taken[-1] == [50]
    assert sorted((r["paper"], r["twice"]) for r in queue.results().collect()) == sorted([*((i, 2 * (2000 + i % 7)) for i in range(11)), (50, 3998)])


def test_texts_are_asked_for_once(spark, tmp_path):
    folder, asked = str(tmp_path / "cache"), str(tmp_path / "asked")
    good = "<article><sec><title>A</title><p>one</p></sec></article>"
    cache.put(spark.createDataFrame([("P1", good), ("P2", ""), ("P3", "<a>")], "pmcid string, body string"), folder)

    def fetch(pmcid):
        import pathlib
        import uuid

        pathlib.Path(asked).mkdir(exist_ok=True)
        (pathlib.Path(asked) / f"{pmcid}-{uuid.uuid4().hex}").touch()
        if pmcid == "P5":
            raise OSError("404")
        return {"P2": good.replace("one", "two"), "P4": " ", "P6": "no xml"}[pmcid]

    rows = spark.createDataFrame([(1, "P1"), (2, "P2"), (3, "P3"), (4, "P4"), (5, "P5"), (6, "P6"), (7, None), (8, " "), (9, "P2")], "paper_id long, pmcid string")
    got = {r["paper_id"]: (r["source"], r["reason"], r["sections"] and [tuple(s) for s in r["sections"]]) for r in cache.acquire(rows, folder, fetch).collect()}
    two = ("fetched", None, [(0, "A", "two")])
    assert got == {1: ("cache", None, [(0, "A", "one")]), 2: two, 3: ("cache", cache.NOT_XML, None), 4: (None, cache.EMPTY, None), 5: (None, f"{cache.HTTP_ERROR}: 404", None), 6: ("fetched", cache.NOT_XML, None), 7: (None, cache.NO_PMCID, None), 8: (None, cache.NO_PMCID, None), 9: two}
    times = Counter(p.name.split("-")[0] for p in (tmp_path / "asked").iterdir())
    assert times == {"P2": 1, "P4": 1, "P5": 1, "P6": 1}
    # what has come is in the cache now; what has not is asked for again
    again = {r["paper_id"]: r["source"] for r in cache.acquire(rows, folder, fetch).collect()}
    assert again[2] == again[9] == "cache" and sorted(p.name.split("-")[0] for p in (tmp_path / "asked").iterdir()) == ["P2", "P4", "P4", "P5", "P5", "P6"]
    assert cache.cached(spark, str(tmp_path / "nowhere")).count() == 0 and cache.acquire(rows.limit(0), folder, fetch).count() == 0


def by_formula(named, text, k):
    """The first k by BM25, over every document."""
    words = [(label, i, name, [w for w in (t or "").lower().split(" ") if w]) for label, i, t, name in named]
    usual = sum(len(w) for *_, w in words) / len(words)
    out = []
    for label, i, name, w in words:
        score = 0.0
        for term in sorted({t for t in text.lower().split(" ") if t}):
            df, tf = sum(term in x for *_, x in words), w.count(term)
            if tf:
                score += math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / usual))
        if score:
            out.append((-round(score, 6), label, i, name))
    return [(label, i, name, -s) for s, label, i, name in sorted(out)[:k]]


def test_search_reads_few_blocks_and_finds_the_same(spark, tmp_path):
    rng = random.Random(5)
    rare, usual = [f"r{i}" for i in range(60)], ["the", "fish", "Gene"]
    named = [("Trait" if i % 3 else "Gene", i, " ".join(rng.choice(rare) if rng.random() < 0.4 else rng.choice(usual) for _ in range(rng.randint(1, 9))), f"n{i}") for i in range(700)] + [("Gene", 9001, None, "none"), ("Gene", 9002, "", "empty"), ("Trait", 9003, "r1 r1 r1", "thrice")]
    index = X.build(spark.createDataFrame(named, "label string, id long, text string, name string"), block=8)
    texts = {k: " ".join(rng.sample(rare, rng.randint(1, 3)) + rng.sample(usual, rng.randint(0, 2))) for k in range(12)} | {50: "nothing known", 51: "", 52: "GENE gene  the", 53: texts_of(rare)}
    searches = spark.createDataFrame([*texts.items(), (60, None), (61, texts[0])], "search int, text string")
    got = {}
    for r in sorted(X.search(index, searches, 5).collect(), key=lambda r: (r["search"], r["rank"])):
        got.setdefault(r["search"], []).append((r["label"], r["id"], r["name"], r["score"]))
    texts |= {61: texts[0]}
    want = {k: w for k, t in texts.items() if (w := by_formula(named, t, 5))}
    assert got == want
    # most blocks of common words are left unread
    asked = index.terms.where("term IN ('the', 'r1')").selectExpr("1L AS search", "term")
    kept, every = X.kept_blocks(index, asked, 3).count(), index.blocks.where("term IN ('the', 'r1')").count()
    assert 0 < kept < 0.3 * every
    index.save(str(tmp_path / "index"))
    again = X.search(X.load(spark, str(tmp_path / "index")), searches.where("search = 0"), 5).collect()
    assert [(r["label"], r["id"], r["name"], r["score"]) for r in sorted(again, key=lambda r: r["rank"])] == want[0]
    empty = X.build(spark.createDataFrame([], "label string, id long, text string, name string"))
    assert X.search(empty, searches, 5).count() == 0 and X.search(index, searches.limit(0), 5).count() == 0


def texts_of(words):
    return " ".join(words[:12])


def test_states_come_in_any_order_and_expire(spark, tmp_path):
    start = datetime(2024, 1, 1)
    at = lambda m: start + timedelta(minutes=m)
    files = [[(1, at(10), 5, False), (2, at(1), 1, False)], [(1, at(20), 2, True), (1, at(5), 8, False), (1, at(25), 3, False)], [(1, at(15), 1, True), (2, at(400), 2, False)], [(2, at(401), 0, False), (3, at(800), 4, False)], [(3, at(801), 4, False)]]
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, "key long, ts timestamp, state_rank int, forced boolean").coalesce(1).write.parquet(str(tmp_path / "in" / f"f{k}"))
    schema = spark.read.parquet(str(tmp_path / "in" / "f0")).schema
    moves = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    rows = [tuple(r) for r in S.collected(S.places(moves), "places").select("key", "state_rank", "n_events").collect()]
    last = {k: max((r for r in rows if r[0] == k), key=lambda r: r[2]) for k in (1, 2, 3)}
    # the last forced move is at 20, whenever it came; what lies after it counts, what came late before it does not
    assert last == {1: (1, 3, 5), 2: (2, 2, 3), 3: (3, 4, 2)}
    idle = S.collected(S.places(moves.withWatermark("ts", "1 minute"), idle_ms=60 * 60_000), "idle")
    closed = {(r["key"], r["state_rank"]) for r in idle.where("closed").collect()}
    assert closed == {(1, 3), (2, 2)}


def test_first_seen(spark, tmp_path):
    rows = [(i % 4, datetime(2024, 1, 1, 0, i)) for i in range(30)]
    spark.createDataFrame(rows, "key long, ts timestamp").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert sorted(r["key"] for r in S.collected(S.first_seen(stream, ["key"], "ts", "1 day"), "first", "append").collect()) == [0, 1, 2, 3]


def test_documents_with_the_same_words_are_indexed_once(spark):
    texts = ["red ring", "ring red", "red ring ring", "blue ring", "blue gear"]
    named = [("Trait" if i % 2 else "Gene", i, texts[i % 5] if i % 7 else texts[0].upper(), f"n{i}") for i in range(120)]
    index = X.build(spark.createDataFrame(named, "label string, id long, text string, name string"), block=2)
    assert index.postings.count() == 8
    asked = {1: "red ring", 2: "ring", 3: "gear blue"}
    got = {}
    for r in sorted(X.search(index, spark.createDataFrame([*asked.items()], "search int, text string"), 30).collect(), key=lambda r: (r["search"], r["rank"])):
        got.setdefault(r["search"], []).append((r["label"], r["id"], r["name"], r["score"]))
    assert got == {k: by_formula(named, t, 30) for k, t in asked.items()}


def test_searches_with_the_same_usual_words_are_searched_once(spark, monkeypatch):
    named = [("Trait" if i % 2 else "Gene", i, f"{'red' if i % 3 else 'blue'} {'ring' if i % 5 else 'gear'} n{i} n{i // 2}", f"n{i}") for i in range(120)] + [("Gene", 500 + i, "red ring", "plain") for i in range(4)]
    index = X.build(spark.createDataFrame(named, "label string, id long, text string, name string"), block=8)
    asked = {i: f"red ring n{i}" for i in range(60)} | {100: "n7", 101: "blue n3 n4 n9 unknown", 102: "ring  RED", 103: "gear", 104: "n1 n2 n3 n4 n5 n6 n7 n8 red"}
    searches, sought, blocks = spark.createDataFrame([*asked.items()], "search int, text string"), [], X.kept_blocks

    def seen(index, terms, k):
        sought.append(terms.select("search").distinct().count())
        return blocks(index, terms, k)

    monkeypatch.setattr(X, "kept_blocks", seen)
    for k in (1, 6, 40):
        got = {}
        for r in sorted(X.search(index, searches, k).collect(), key=lambda r: (r["search"], r["rank"])):
            got.setdefault(r["search"], []).append((r["label"], r["id"], r["name"], r["score"]))
        assert got == {s: by_formula(named, t, k) for s, t in asked.items()}
    # red ring; blue; gear; red
    assert sought == [4, 4, 4]


def test_the_bound_of_blocks_counts_all_words_of_what_the_first_blocks_hold(spark):
    # the best document stands in the first block of c alone, and last among those of a and b
    named = [("Gene", 0, "a b c", "best")] + [("Gene", 1 + i, f"c p{i} q{i}", "c") for i in range(20)]
    named += [("Gene", 100 + 100 * (w == "b") + i, f"{w} x{i}", w) for w in "ab" for i in range(40)] + [("Gene", 1000 + i, f"gene g{i} h{i}", "gene") for i in range(50)]
    index = X.build(spark.createDataFrame(named, "label string, id long, text string, name string"), block=4)
    asked = index.terms.where("term IN ('a', 'b', 'c', 'gene')").selectExpr("1L AS search", "term")
    assert {r["term"] for r in X.kept_blocks(index, asked, 1).collect()} == {"c"}
    got = X.search(index, spark.createDataFrame([(1, "a b c gene")], "search int, text string"), 1).collect()
    assert [(r["label"], r["id"], r["name"], r["score"]) for r in got] == by_formula(named, "a b c gene", 1)


def test_what_stands_behind_k_copies_is_left_out(spark):
    rows = [(1, "Gene", 7, 3, 2.0), (1, "Gene", 2, 1, 1.0), (1, "Trait", 0, 5, 1.0), (1, "Gene", 4, 9, 0.5), (2, "Gene", 4, 2, 0.5), (2, "Gene", 5, 1, 0.25)]
    scored = spark.createDataFrame(rows, "search long, label string, id long, copies long, score double")
    best = {k: {(r["search"], r["id"]) for r in X._best(scored, k).collect()} for k in (1, 3, 4, 9)}
    assert best == {1: {(1, 7), (2, 4)}, 3: {(1, 7), (2, 4), (2, 5)}, 4: {(1, 7), (1, 2), (1, 0), (2, 4), (2, 5)}, 9: {(1, 7), (1, 2), (1, 0), (2, 4), (2, 5)}}
