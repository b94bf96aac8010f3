"""Near duplicates, repeated passages, leaks, mixing, archives and the pipeline against brute force."""

import base64
import hashlib
import io
import pickle
import random
import re
import time
import zipfile
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import components, decontamination, mixing, ngram_join, substring_dedup, warc, zip_archive
from loomgraph.llm.session import table_path, written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], DOCS)


def vocabulary(rng, n=500):
    return ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def family_texts(seed=3):
    """Plain texts, exact and near copies at many distances, one large family, and a passage that many share."""
    rng = random.Random(seed)
    words = vocabulary(rng)
    text = lambda n: [rng.choice(words) for _ in range(n)]
    passage, hot, out = text(40), text(150), []
    for i in range(60):
        base = text(rng.choice([3, 4, 5, 6, 20, 60, 150, 400]))
        if i % 3 == 0:
            base += passage
        out.append(base)
        for _ in range(rng.randint(0, 3)):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(copy) // 40)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(copy)
    for _ in range(160):
        copy = list(hot)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        out.append(copy)
    texts = [" ".join(w.upper() if rng.random() < 0.05 else w for w in t) for t in out]
    return [*texts, None, "", " \n", "one", "one", "ONE", "two words", "two  words"]


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def plain_components(rows):
    """Of (id, text) rows, by all pairs: the smallest id that links reach, in the order of rows."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)].append(k)
    return [min(least[find(i)], default=None) for i in range(len(rows))], [len(s) for s in sets]


def test_components_against_all_pairs(spark):
    texts = family_texts()
    rows = [((i * 37) % 1009, t) for i, t in enumerate(texts)]
    want, sizes = plain_components(rows)
    got = {r["doc_id"]: r for r in ngram_join.components(documents(spark, rows)).collect()}
    assert [got[i]["component_id"] for i, _ in rows] == want and [got[i]["n_shingles"] for i, _ in rows] == sizes
    assert len(set(want)) < len(rows) - 150


@pytest.mark.parametrize("one_task", [0, 300_000])
def test_edges_in_one_task_and_in_rounds(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    least = {x: x for p in pairs for x in p}
    for _ in range(60):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    got = components.connected_components(spark.createDataFrame(pairs, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == least
    assert components.connected_components(spark.createDataFrame([], "a binary, b binary")).count() == 0


def test_components_of_small_parts(spark, monkeypatch):
    monkeypatch.setattr(components, "ONE_TASK", 50)
    monkeypatch.setattr(ngram_join, "PART", 16)
    monkeypatch.setattr(ngram_join, "PICKED", 0)
    rows = list(enumerate(family_texts(8)))
    want, _ = plain_components(rows)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.components(documents(spark, rows)).collect()}
    assert [got[i] for i, _ in rows] == want


def counted_components(texts):
    """As plain_components, with overlaps counted over posting lists: fast enough for thousands of alike texts."""
    sets = [[hash(x) for x in shingles(t)] for t in texts]
    flat, owner = np.array([h for s in sets for h in s]), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    token = np.unique(flat, return_inverse=True)[1]
    order = np.argsort(token, kind="stable")
    ends = np.searchsorted(token[order], np.arange(token.max() + 2))
    size, at, parent = np.array([len(s) for s in sets]), np.cumsum([0, *map(len, sets)]), np.arange(len(sets))
    for i in range(len(sets)):
        both = np.bincount(np.concatenate([owner[order[ends[t] : ends[t + 1]]] for t in token[at[i] : at[i + 1]]]), minlength=len(sets))
        linked = (both > 0) & (100 * both >= 80 * (size + size[i] - both))
        tied = np.unique(parent[linked])
        parent[np.isin(parent, tied)] = tied.min()
    return parent.tolist()


def test_components_of_a_family_of_thousands(spark):
    rng = random.Random(21)
    words = vocabulary(rng, 3000)
    base = [rng.choice(words) for _ in range(90)]
    other = base[:50] + [rng.choice(words) for _ in range(40)]
    texts = []
    for i in range(5000):
        copy = list(base if i % 5 else other)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    want = counted_components(texts)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.components(documents(spark, enumerate(texts))).collect()}
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) > 2


def test_parts_grow_with_their_nodes_only(spark):
    names = spark.range(20_000).select(F.lit("k").alias("key"), F.sha1(F.col("id").cast("string").cast("binary")).cast("binary").alias("node"), F.lit(60).alias("n"), F.col("id").alias("group"))
    alone = names.withColumn("group", F.when(F.col("group") % 200 == 0, F.col("group")).otherwise(1))
    parts = ngram_join._parted(ngram_join._measured(alone, "key"), "key").groupBy("part").count().toPandas()
    assert parts["count"].max() < 3 * ngram_join.PART and parts["count"].sum() < 2 * 20_000
    parts = ngram_join._with_hubs(ngram_join._measured(names, "key"), "key").groupBy("part").count().toPandas()
    assert parts["count"].max() < 2 * ngram_join.PART and parts["count"].sum() < 1.3 * 20_000


def test_equal_blocks_are_searched_once_and_only_near_sizes_meet(spark):
    rng = random.Random(8)
    size = {i: rng.choice([20, 24, 25, 26, 31, 32, 40, 50, 63, 64, 80, 100, 125, 126, 200]) for i in range(1200)}
    rows = [(k, bytes([i % 256, i // 256]), size[i], i if i % 10 == 0 else 1) for k in ("k", "l") for i in size]
    members = spark.createDataFrame(rows, "key string, node binary, n int, `group` long")
    dealt = ngram_join._parted(ngram_join._measured(members, "key"), "key").collect()
    # in both blocks and with all sizes there would be 3,360
    assert len(dealt) < 1600
    parts, met = {}, set()
    for r in dealt:
        parts.setdefault(r["part"], []).append((r["node"][0] + 256 * r["node"][1], r["asks"]))
    for part in parts.values():
        met |= {frozenset((i, j)) for i, asks in part if asks for j, _ in part if i != j}
    linkable = {frozenset((i, j)) for i in range(0, 1200, 10) for j in size if i != j and 4 * max(size[i], size[j]) <= 5 * min(size[i], size[j])}
    assert linkable <= met


def test_components_of_repeated_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(5, long), (5, long), (5, "quite another text of six words"), (2, long), (None, long), (None, "nobody else has this text at all"), (9, None), (9, "")]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in ngram_join.components(documents(spark, rows)).collect())
    assert got == sorted([(False, 5, 56, 2), (False, 5, 56, 2), (False, 5, 2, 5), (False, 2, 56, 2), (True, 0, 56, 2), (True, 0, 3, None), (False, 9, 0, 9), (False, 9, 0, 9)], key=lambda r: (r[0], r[1], r[2]))
    named = documents(spark, rows).withColumn("__id", F.lit("own")).withColumn("__node", F.lit("own")).withColumn("__component", F.lit("own"))
    assert {tuple(r)[5:] for r in ngram_join.keep_one(named).collect()} == {("own", "own", "own")}
    kept = ngram_join.keep_one(documents(spark, rows).withColumn("node", F.lit("clash")))
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(left, key=repr) == sorted([(2, long), (5, rows[2][1]), (None, rows[5][1]), (9, None), (9, "")], key=repr) and kept.columns[-1] == "node"
    assert ngram_join.components(documents(spark, []).limit(0)).count() == 0 and ngram_join.keep_one(documents(spark, [])).count() == 0


def test_keep_one_leaves_the_smallest(spark):
    rows = [((i * 37) % 1009, t) for i, t in enumerate(family_texts(5))]
    want, _ = plain_components(rows)
    assert {r["doc_id"] for r in ngram_join.keep_one(documents(spark, rows)).collect()} == set(want)


def test_divide_skip_against_counting():
    rng = random.Random(1)
    for _ in range(300):
        lists = [np.array(sorted(rng.sample(range(60), rng.randint(1, 60)))) for _ in range(rng.randint(1, 12))]
        least = rng.randint(1, 12)
        counts = defaultdict(int)
        for x in lists:
            for m in x.tolist():
                counts[m] += 1
        members, found = ngram_join.divide_skip(lists, least)
        assert dict(zip(members.tolist(), found.tolist(), strict=True)) == {m: n for m, n in counts.items() if n >= least}


def passages(seed=4):
    rng = random.Random(seed)
    words = vocabulary(rng, 3000)
    text = lambda n: [rng.choice(words) for _ in range(n)]
    shared, line = [text(60) for _ in range(5)], text(7)
    rows = {}
    for i in range(80):
        body = text(rng.randint(20, 200)) + line
        if i % 4 == 0:
            at = rng.randrange(len(body))
            body[at:at] = shared[i // 4 % 5]
        rows[i] = " ".join(body)
    return rows, [" ".join(p) for p in shared]


def test_repeated_passages(spark):
    rows, shared = passages()
    held = {i for i, t in rows.items() if any(p in t for p in shared)}
    found = {r["doc_id"]: r for r in substring_dedup.passages(documents(spark, rows.items())).collect()}
    assert set(found) == held
    kept = {r["doc_id"]: r["text"] for r in substring_dedup.dedup(documents(spark, rows.items())).collect()}
    for p in shared:
        first = min(i for i, t in rows.items() if p in t)
        assert [i for i, t in kept.items() if p in t] == [first] and found[first]["removed_words"] == 0
        core = " ".join(p.split()[22:38])
        assert [i for i, t in kept.items() if core in t] == [first]
    assert all(kept[i] == rows[i] for i in set(rows) - held)
    for i in held:
        assert first_words(kept[i]) <= first_words(rows[i])


def first_words(text):
    return set(text.split())


@pytest.mark.parametrize("picked", [0, 500_000])
def test_passages_of_awkward_rows(spark, monkeypatch, picked):
    monkeypatch.setattr(substring_dedup, "PICKED", picked)
    rows, _ = passages()
    long = rows[0]
    odd = [(1, long), (1, long), (None, long), (None, None), (3, ""), (4, "Shti " * 500), (5, "Shti " * 700), (6, "w" * 100_000)]
    docs = documents(spark, odd).withColumn("key", F.lit(1)).withColumn("digests", F.lit("x"))
    docs = docs.withColumn("__key", F.lit("own")).withColumn("__Digests", F.lit("own")).withColumn("__firsts", F.lit("own"))
    plain = substring_dedup.dedup(docs).where("doc_id in (4, 5)").orderBy("doc_id").collect()
    # documents of one word, over and over: the later one is cut, the first stays
    assert plain[0]["text"] == odd[5][1] and len(plain[1]["text"]) < 200
    out = substring_dedup.dedup(docs, within=True)
    assert {r["__key"] + r["__firsts"] for r in out.collect()} == {"ownown"}
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    texts = defaultdict(list)
    for i, t in got:
        texts[i].append(t)
    assert out.columns == docs.columns and len(got) == len(odd)
    assert texts[1] == [long, long] and set(texts[None]) == {"", None} and texts[3] == [""] and texts[6] == ["w" * 100_000]
    assert len(texts[4][0]) < 200 and len(texts[5][0]) < 200
    assert substring_dedup.dedup(docs.limit(0)).count() == 0 and substring_dedup.passages(docs.limit(0)).count() == 0


def test_every_run_has_an_anchor_that_both_texts_hold():
    rng = random.Random(17)
    for _ in range(400):
        run = [(rng.randint(1, 10**6), rng.randint(3, 16)) for _ in range(rng.randint(1, 9))]
        while sum(n for _, n in run) < 24:
            run.append((rng.randint(1, 10**6), rng.randint(3, 16)))
        held = []
        for _ in range(2):
            before, after = ([(rng.randint(1, 10**6), rng.randint(3, 16)) for _ in range(rng.randint(0, 5))] for _ in range(2))
            text = [*before, *run, *after]
            marks = substring_dedup.anchors(np.array([d for d, _ in text]), np.array([n for _, n in text]), np.zeros(len(text), np.int64), 24)
            held.append({k - len(before) for k in np.flatnonzero(marks).tolist() if 0 <= k - len(before) < len(run)})
        assert held[0] & held[1]


def plain_covered(rows, least=substring_dedup.RUN_WORDS):
    """Words of each text in spans of whole chunks, least words at least, that another text holds too."""
    chunks = {}
    for i, t in rows.items():
        c = digests(t)
        chunks[i] = [(d, n) for d, n in zip(c.digest.tolist(), c.size.tolist(), strict=True) if d]
    held = defaultdict(set)
    for i, c in chunks.items():
        for a in range(len(c)):
            for b in range(a + 1, min(len(c), a + 12) + 1):
                held[tuple(d for d, _ in c[a:b])].add(i)
    out = {}
    for i, c in chunks.items():
        known = {k for a in range(len(c)) for b in range(a + 1, min(len(c), a + 12) + 1) if len(held[tuple(d for d, _ in c[a:b])]) > 1 and sum(n for _, n in c[a:b]) >= least for k in range(a, b)}
        if known:
            out[i] = sum(c[k][1] for k in known)
    return out


def test_passages_against_all_spans(spark):
    rows, _ = passages(9)
    rng = random.Random(3)
    for i in range(80, 110):
        # pieces of other texts, some of them just long enough
        other = rows[rng.randrange(80)].split()
        at, n = rng.randrange(len(other)), rng.randint(15, 60)
        rows[i] = " ".join(rows[i - 80].split()[:15] + other[at : at + n] + rows[i - 60].split()[-9:])
    got = {r["doc_id"]: r["repeated_words"] for r in substring_dedup.passages(documents(spark, rows.items())).collect()}
    want = plain_covered(rows)
    # small chunks between found ones go along, so a run may have a few words more
    assert set(got) == set(want) and all(0 <= got[i] - want[i] <= 6 for i in want) and 20 < len(want) < 100


def test_chunks_do_not_depend_on_neighbours():
    rows, shared = passages()
    text = shared[0].encode()
    other = rows[1].encode()
    both = np.frombuffer(other + text, np.uint8)
    together = substring_dedup.Chunks(both, np.array([0, len(other), len(both)]))
    alone = substring_dedup.Chunks(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert together.digest[together.doc == 1].tolist() == alone.digest.tolist()


def digests(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return substring_dedup.Chunks(raw, np.array([0, len(raw)]))


def test_chunks_of_many_holders_are_no_passage(spark):
    rng = random.Random(6)
    words = vocabulary(rng, 3000)
    rows = {i: " ".join(rng.choice(words) for _ in range(120)) for i in range(60)}
    held, built = {d for t in rows.values() for d in digests(t).digest.tolist()}, []
    for t in rows.values():
        c = digests(t)
        for at, n in list(zip(c.first.tolist(), c.size.tolist(), strict=True))[1:-1]:
            more = [*built, *t.split()[at : at + n]]
            if n < 9 and set(digests(" ".join(more)).digest.tolist()) <= held:
                built = more
                break
    assert len(built) >= 24
    rows[99] = " ".join(built)
    assert substring_dedup.passages(documents(spark, rows.items())).count() == 0
    assert {r["doc_id"]: r["text"] for r in substring_dedup.dedup(documents(spark, rows.items())).collect()} == rows


def test_chunks_are_cut_at_one_word_in_three():
    rng = random.Random(51)
    words = vocabulary(rng, 3000)
    assert digests(" ".join(rng.choice(words) for _ in range(50_000))).size.mean() < 5.25


def test_windows_cover_common_runs():
    rng = random.Random(9)
    for _ in range(300):
        size = {d: rng.randint(3, 16) for d in range(1, 7)}
        one, two = ([rng.randint(1, 6) for _ in range(rng.randint(1, 14))] for _ in range(2))
        want = {k for i in range(len(one)) for j in range(i + 1, len(one) + 1) if sum(size[d] for d in one[i:j]) >= 12 and any(two[k : k + j - i] == one[i:j] for k in range(len(two))) for k in range(i, j)}
        (a, b, h), (_, _, other) = (substring_dedup._windows(np.array(x), np.array([size[d] for d in x]), 12) for x in (one, two))
        same = np.isin(h, other)
        assert set(np.flatnonzero(substring_dedup._covered(len(one), a[same], b[same])).tolist()) == want


def least_edits(item, text):
    row = np.zeros(len(text) + 1, int)
    steps, t = np.arange(len(text) + 1), np.frombuffer(text, np.uint8)
    for i, c in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (t != c), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def test_leaks_against_edit_distance(spark):
    rng = random.Random(7)
    words = vocabulary(rng)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randint(3, 40))) for i in range(30)] + [(98, None), (99, "short")]
    rows = []
    for i in range(150):
        item = list(rng.choice(items[:30])[1]) if i % 3 else list(text(10))
        for _ in range(rng.randint(0, len(item) // 8)):
            p = rng.randrange(len(item))
            item[p : p + 1] = rng.choice(["", "x", item[p] + "y", item[p].upper(), "  "])
        rows.append((i, f"{text(rng.randint(0, 60))} {''.join(item)}\n{text(rng.randint(0, 60))}"))
    docs, benchmark = documents(spark, [*rows, (None, items[0][1]), (500, None), (501, "")]), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontamination.leaks(docs, benchmark).collect()}
    plain = lambda t: " ".join(re.sub("[A-Z]", lambda m: m[0].lower(), t).split()).encode()
    index = decontamination.ItemIndex([i for i, t in items if t], [t for _, t in items if t])
    want = {(d, i): n for d, t in rows for i, k, item in zip(index.ids, index.budget.tolist(), index.items, strict=True) if (n := least_edits(item, plain(t))) <= k}
    assert {k: v for k, v in got.items() if k[0] is not None} == want and len(want) > 30 and (None, items[0][0]) in got
    left = decontamination.clean(docs.withColumn("item", F.lit(1)), benchmark)
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in rows} - {d for d, _ in want} | {500, 501} and left.columns[-1] == "item"
    assert decontamination.leaks(docs, benchmark.limit(0)).count() == 0 and decontamination.leaks(docs.limit(0), benchmark).count() == 0
    assert decontamination.clean(docs, benchmark.limit(0)).count() == docs.count()


def test_short_items_match_as_whole_words(spark):
    items = spark.createDataFrame([(1, "Yes"), (2, "a b"), (3, "ninebytes"), (4, "fifteen bytes!!"), (5, " "), (6, "é"), (7, "yes")], "item_id long, text string")
    texts = {1: "he said YES", 2: "yesterday", 3: "a  b", 4: "xa b", 5: "ninebytes", 6: "ninebytesx ninebyte", 7: "so fifteen\nBYTES!! it is", 8: "fifteen bytes?!", 9: "é", 10: "éa", 11: "yes yes", 12: ""}
    got = {(r["doc_id"], r["item_id"], r["edits"]) for r in decontamination.leaks(documents(spark, texts.items()), items).collect()}
    assert got == {(1, 1, 0), (1, 7, 0), (3, 2, 0), (5, 3, 0), (7, 4, 0), (9, 6, 0), (11, 1, 0), (11, 7, 0)}
    assert {r["doc_id"] for r in decontamination.clean(documents(spark, texts.items()), items).collect()} == {2, 4, 6, 8, 10, 12}


def test_items_that_share_a_template(monkeypatch):
    rng = random.Random(12)
    words = vocabulary(rng, 3000)
    start = "which of the following is correct? "
    items = [start + " ".join(rng.choice(words) for _ in range(12)) for _ in range(20_000)]
    index = decontamination.ItemIndex(list(range(len(items))), items)
    body = " ".join(rng.choice(words) for _ in range(150))
    text = f"{body} {start}{body} {items[77]} {start} {items[5][:-1]} {body}".encode()
    began = time.time()
    found = {(i, n) for _, i, n, _ in index.matches(np.frombuffer(text, np.uint8), np.array([0, len(text)]))}
    assert found == {(77, 0), (5, 1)} and time.time() - began < 5
    monkeypatch.setattr(decontamination, "HITS", 1000)
    assert {(i, n) for _, i, n, _ in index.matches(np.frombuffer(text, np.uint8), np.array([0, len(text)]))} == found


def test_index_takes_few_times_the_text():
    rng = random.Random(13)
    words = vocabulary(rng, 3000)
    items = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(20_000)]
    size = len(pickle.dumps(decontamination.ItemIndex(list(range(len(items))), items)))
    # a block of 64 MB takes a quarter of a GB at this rate
    assert size < 4 * sum(map(len, items))


def test_leaks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 100)
    items = spark.createDataFrame([(i, " ".join(f"item{i}word{k}" for k in range(6))) for i in range(9)], "item_id long, text string")
    docs = documents(spark, [(r["item_id"], f"before {r['text']} after") for r in items.collect()])
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, items).collect()} == {(i, i) for i in range(9)}
    assert decontamination.clean(docs, items).count() == 0


def mixed(spark, docs):
    return mixing.mix(docs).toPandas()


def test_mix_against_sql(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i if i % 50 else None, None if i % 41 == 0 else " ".join(["ab", "#c", "d"][rng.randrange(3)] for _ in range(rng.randint(0, 60))), "en", rng.choice(["a"] * 9 + ["b", "ß", None, ""]), 0) for i in range(900)] + [(7, "same same", "en", "a", 0)] * 3
    docs = spark.createDataFrame(rows, DOCS)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    order = ["doc_id", "size", "source_size", "target", "taken"]
    want = sorted(map(repr, con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.SQL})").fetchall()))
    for fine, broadcast in ((4096, 100_000), (2, 0)):
        monkeypatch.setattr(mixing, "FINE", fine)
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
        got = mixing.mix(docs)
        assert sorted(repr(tuple(r[c] for c in order)) for r in got.collect()) == want
    frame = got.toPandas()
    assert (frame.taken <= 3 * frame["size"]).all()
    for _, part in frame.groupby("source", dropna=False):
        assert abs(part.taken.sum() - part.target.iloc[0]) < 1 and part.target.iloc[0] <= 3 * part.source_size.iloc[0]
    assert mixing.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("weight", [1.0, 0.5, 0.08])
def test_no_bin_of_keys_holds_much_of_a_source(spark, weight):
    key = mixing.exponential_key(F.col("id").cast("string"), F.lit(weight), "mix")
    bins = spark.range(200_000).select(F.floor(F.log2(key + 1) * mixing.OCTAVE).alias("bin"), F.floor(F.log2(key + 1) * mixing.OCTAVE * mixing.FINE).alias("fine"))
    assert bins.groupBy("bin").count().agg(F.max("count")).first()[0] < 0.006 * 200_000
    # what is sorted in one task is a fine bin
    assert bins.groupBy("fine").count().agg(F.max("count")).first()[0] < 10


def test_mix_prefers_clean_documents(spark):
    rows = [(i, "word " * 10 if i % 2 else "#### " * 10, "en", s, 0) for i in range(600) for s in ("a", "b", "c")]
    frame = mixed(spark, spark.createDataFrame(rows, DOCS))
    a = frame[frame.source == "a"]
    assert a[a.weight == 1].taken.sum() > 3 * a[a.weight < 1].taken.sum()


def plain_targets(sizes):
    """Water filling by repeated sharing."""
    total, weights = sum(sizes), [i % 3 + 1 for i in range(len(sizes))]
    fixed = {}
    while True:
        rest = total - sum(fixed.values())
        weight = sum(w for i, w in enumerate(weights) if i not in fixed)
        over = [i for i, w in enumerate(weights) if i not in fixed and rest * w / weight > 3 * sizes[i]] if weight else []
        if not over:
            return [fixed.get(i, rest * w / weight if weight else 0) for i, w in enumerate(weights)]
        fixed |= {i: 3 * sizes[i] for i in over}


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1, 1000, 5], [100], [0, 5, 0], [3, 900, 1, 1, 2, 50, 7]])
def test_targets(spark, sizes):
    table = spark.createDataFrame([(chr(97 + i), 1, s) for i, s in enumerate(sizes)], "source string, n_rows long, source_size long")
    got = [r["target"] for r in mixing.targets(table, "source").orderBy("source").collect()]
    assert np.allclose(got, plain_targets(sizes))


def test_archives_round_trip(spark):
    pages = [(1, "http://a/ü\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b", None), (4, "http://c", ""), (5, "http://d", "x" * 200_000), (2, "http://e", "<p>é</p>"), (None, "http://f", "<p>é</p>"), (None, "http://g", "alone"), (9, "h", "\r\n\r\nWARC/1.1")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).withColumn("refers_to", F.lit("clash"))
    packages = written(warc.write_packages(frame, table_path(spark, "warc")), "packages")
    got = warc.read_packages(packages, payloads=True).collect()
    want = []
    for page, _, html in pages:
        payload = (html or "").encode()
        same = [i for i, _, h in pages if (h or "").encode() == payload and i is not None]
        first = min(same, default=None)
        again = first is not None and page != first
        want.append((page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if again else "response", first if again else None, None if again else payload))
    assert sorted(map(repr, [(*tuple(r)[:5], None if r["payload"] is None else bytes(r["payload"])) for r in got])) == sorted(map(repr, want))
    assert packages.agg(F.sum("n_records")).first()[0] == len(pages)
    assert warc.read_packages(warc.write_packages(frame.limit(0), table_path(spark, "warc")).limit(0)).count() == 0


@pytest.mark.parametrize("digests", [500_000, 1, 0])
def test_archives_against_sql(spark, monkeypatch, digests):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", digests)
    rows = [(i, f"http://x/{i}", "abc"[i % 3] * (i % 5)) for i in range(60)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    con = duckdb.connect()
    con.register("pages", frame.toArrow())
    packages = written(warc.write_packages(frame, table_path(spark, "warc")), "packages")
    assert sorted(map(tuple, warc.read_packages(packages).collect()), key=repr) == sorted(con.execute(warc.SQL).fetchall(), key=repr)


def zipped(compression=zipfile.ZIP_STORED, force=False, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", compression) as z:
        for name, data in (("a.txt", b"hello"), ("b/ü.bin", bytes(range(256)) * 40), ("empty", b"")):
            with z.open(zipfile.ZipInfo(name) if compression == zipfile.ZIP_STORED else name, "w", force_zip64=force) as m:
                m.write(data)
        z.comment = comment
    return out.getvalue()


@pytest.mark.parametrize("force", [False, True])
@pytest.mark.parametrize("comment", [b"", b"PK\x05\x06 not the end" * 3])
def test_zip_directories(force, comment):
    data = zipped(force=force, comment=comment)
    read_at = lambda offset, length: data[offset : offset + length]
    members = {m.name: m for m in zip_archive.members(read_at, len(data))}
    assert set(members) == {"a.txt", "b/ü.bin", "empty"}
    start = zip_archive.data_offset(read_at, members["b/ü.bin"])
    assert data[start : start + members["b/ü.bin"].size] == bytes(range(256)) * 40


def test_zip64_directory_and_refusals():
    data = zipped()
    end = data.rfind(zip_archive.END)
    entries, size, offset = int.from_bytes(data[end + 10 : end + 12], "little"), int.from_bytes(data[end + 12 : end + 16], "little"), int.from_bytes(data[end + 16 : end + 20], "little")
    record = zip_archive.END64 + (44).to_bytes(8, "little") + b"\x2d\0\x2d\0" + bytes(8) + b"".join(x.to_bytes(8, "little") for x in (entries, entries, size, offset))
    locator = zip_archive.LOCATOR64 + bytes(4) + end.to_bytes(8, "little") + (1).to_bytes(4, "little")
    wide = data[:end] + record + locator + data[end : end + 8] + b"\xff" * 12 + data[end + 20 :]
    read_at = lambda at, length: wide[at : at + length]
    assert [m.name for m in zip_archive.members(read_at, len(wide))] == ["a.txt", "b/ü.bin", "empty"]
    with pytest.raises(ValueError, match="no end"):
        zip_archive.members(lambda a, n: b"x" * n, 100)
    packed = zipped(zipfile.ZIP_DEFLATED)
    members = zip_archive.members(lambda a, n: packed[a : a + n], len(packed))
    with pytest.raises(ValueError, match="compressed"):
        zip_archive.data_offset(lambda a, n: packed[a : a + n], members[1])


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(11)
    words = vocabulary(rng, 2000)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item, shared = text(30), text(60)
    rows, labels = [], []
    for i in range(300):
        body = text(rng.randint(60, 160))
        if i % 9 == 0:
            body = " ".join(w + "%%%" for w in body.split())
        rows.append([i, body])
        labels.append((i, 0 if i % 9 == 0 else 1, 0))
    rows[10][1] = rows[4][1] + " end"
    rows[20][1] += f" {shared} {text(20)}"
    rows[30][1] = f"{text(20)} {shared} {rows[30][1]}"
    rows[40][1] += f" {item} {text(20)}"
    docs = documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, at = [], docs
    for name, stage in P.STAGES:
        at = written(stage(spark, at, str(tmp_path)), "stage")
        if name != P.STAGES[-1][0]:
            assert at.columns == docs.columns and at.schema == at.select(*docs.columns).schema
        seen.append({r["doc_id"]: r for r in at.collect()})
    good, unique, cut, clean, mix = seen
    assert set(good) == {i for i, q, _ in labels if q}
    assert set(unique) == set(good) - {10}
    assert set(cut) == set(unique) and shared in cut[20]["text"] and shared not in cut[30]["text"] and cut[30]["n_chars"] == len(cut[30]["text"])
    assert all(cut[i]["text"] == unique[i]["text"] for i in cut if i != 30)
    assert set(clean) == set(cut) - {40} and set(mix) == set(clean)
    assert sum(r["taken"] for r in mix.values()) > 0.99 * sum(r["size"] for r in mix.values())
    assert {r["doc_id"] for r in P.run(spark, str(tmp_path)).collect()} == set(mix)


@pytest.mark.parametrize("rows", [[], [(1, None), (None, None), (2, ""), (2, "")], [(5, "some words that are here " * 8)] * 3 + [(None, "some words that are here " * 8), (6, "x " * 60_000)]])
def test_pipeline_of_awkward_rows(spark, tmp_path, rows):
    import corpus_pipeline as P

    own = ["__score", "__text", "__id", "__node", "__key", "__digests", "size", "id"]
    docs = documents(spark, rows)
    for c in own:
        docs = docs.withColumn(c, F.lit("own"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, None, None), (1, None, 1), (99, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, None), (1, ""), (1, "nowhere to be found in any text")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = docs
    for _, stage in P.STAGES[:-1]:
        at = written(stage(spark, at, str(tmp_path)), "stage")
        assert at.columns == docs.columns and at.count() <= len(rows)
        assert {r[c] for r in at.select(*own).collect() for c in own} <= {"own"}
    assert P.run(spark, str(tmp_path)).count() <= len(rows)


def test_pipeline_deletes_what_it_reads_no_more(spark, tmp_path):
    import corpus_pipeline as P
    from loomgraph.llm.session import held_tables

    documents(spark, [(i, f"text number {i} of some more words " * 9) for i in range(30)]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nowhere")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = set(held_tables())
    P.run(spark, str(tmp_path)).count()
    # the last stage's input and its tables of keys and sources
    assert len(set(held_tables()) - before) <= 3
