"""Nearest neighbours and vector codes against brute force over all pairs and against plain integers."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import nearest, vector_codes, vectors

ROWS = "vec_id long, embedding array<float>, label int"


def table(spark, rows, extra=()):
    out = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], c) for i, v, c in rows], ROWS)
    for c in extra:
        out = out.withColumn(c, F.lit("own"))
    return out


def clustered(n, dim, seed, scale=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return (centres[rng.integers(0, 12, n)] + scale * rng.normal(size=(n, dim))).astype(np.float32).astype(np.float64)


def brute(ids, x, queries, k):
    """query -> [(distance, id)] of the k nearest others, each id by its nearest row."""
    out = {}
    for q in queries:
        at = min((i for i in range(len(ids)) if ids[i] == q), key=lambda i: tuple(x[i]))
        best = {}
        for i, d in zip(ids, np.sqrt(((x - x[at]) ** 2).sum(1)).tolist(), strict=True):
            if i != q:
                best[i] = min(d, best.get(i, d))
        out[q] = sorted((d, i) for i, d in best.items())[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def search(frame, k=10, **more):
    index = nearest.build_index(frame)
    return nearest.search(index, index.where(F.col("id") % 100 == 0).select("id", "vector"), k, **more)


@pytest.mark.parametrize("dim", [3, 24])
def test_recall_and_exact_scores(spark, dim, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 1000)
    x = clustered(6000, dim, dim)
    got = found(search(table(spark, [(i, v, 0) for i, v in enumerate(x)]), rerank=60))
    want = brute(list(range(6000)), x, range(0, 6000, 100), 10)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    for q, rows in got.items():
        assert rows == sorted(rows)
        for d, i in rows:
            assert d == pytest.approx(float(np.sqrt(((x[i] - x[q]) ** 2).sum())), abs=1e-12)


def test_copies_never_push_out_nearer_rows(spark):
    """A third of the rows are one vector: its smallest ids come in their place, and rows nearer than it stay."""
    x = clustered(3000, 16, 5)
    x[100:1100] = x[200]
    x[1200] = x[200] + np.float32(0.01)
    x[1300] = x[200] + np.float32(0.02)
    x = x.astype(np.float32).astype(np.float64)
    got = found(search(table(spark, [(i, v, 0) for i, v in enumerate(x)]), rerank=40))
    want = brute(list(range(3000)), x, range(0, 3000, 100), 10)
    for q in (200, 900, 1200, 1300):
        assert got[q] == want[q]
    assert [i for _, i in got[200]] == list(range(100, 110))


def test_anisotropic_codes_lose_less_along_the_vector():
    x = clustered(2000, 32, 8) + 50
    books = nearest.fit(x)
    x = books.placed(x)
    assert books.words.shape == (16, 16, 2) and nearest.fit(x[:, :20]).words.shape == (20, 16, 1)
    short = nearest.fit(x[:, :3])
    assert np.allclose(short.placed(x[:9, :3]) @ short.placed(x[:9, :3]).T, (x[:9, :3] - short.centre) @ (x[:9, :3] - short.centre).T)
    along = lambda codes: (((books.split(x) - books.words[np.arange(len(books.words)), codes]).reshape(len(x), -1) * x).sum(1) ** 2 / (x**2).sum(1)).sum()
    plain, better = books.assign(x, sweeps=0), books.assign(x)
    assert books.loss(x, better) < books.loss(x, plain) and along(better) < along(plain)
    again = nearest.Codebooks(books.words.copy(), 32, books.centre)
    again.refit(x, better)
    assert again.loss(x, better) <= books.loss(x, better) + 1e-9
    # table scans add up the inner products of the coded vectors
    table, coded = books.tables(x[:5]), books.words[np.arange(len(books.words)), better].reshape(len(x), -1)
    code = nearest.packed(better)
    scanned = sum(table[:, b][:, code[:, b]] for b in range(code.shape[1]))
    assert np.allclose(scanned, x[:5] @ coded.T, atol=1e-4)


def test_nearest_edge_cases(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 2], 1), (1, [1, 2], 1), (100, [0, 0], 2), (200, None, 2), (300, [nan, 1], None), (400, [1, inf], 3), (500, [1, None], 3), (600, [], 3), (700, [1, 2, 3], 3), (-100, [4, 6], 3), (5, [9, 9], 1), (5, [1, 3], 1), (5, [1, 3], 1), (None, [1, 2], 1), (800, [5, 5], 1), (800, [2, 2], 1)]
    got = found(search(table(spark, rows, ("id", "vector", "code", "score")).withColumnRenamed("id", "Rank")))
    assert set(got) == {0, -100, 800}
    assert [(i, round(d, 6)) for d, i in got[0]] == [(1, 0), (5, 1), (800, 1), (-100, 5)]
    assert got[800][0] == (1.0, 0)  # of the rows of a query's id the smallest vector counts
    assert search(table(spark, rows[2:9])).count() == 0 and search(table(spark, [])).count() == 0
    one = search(table(spark, rows[:1]))
    assert one.count() == 0 and one.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    # several blocks of queries and of rows give the same rows
    x = clustered(900, 8, 3)
    frame = table(spark, [(i, v, 0) for i, v in enumerate(x)])
    want = found(search(frame, rerank=900))
    monkeypatch.setattr(nearest, "QUERY_BYTES", 200)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 37)
    assert found(search(frame, rerank=900)) == want == {q: [(pytest.approx(d), i) for d, i in v] for q, v in brute(list(range(900)), x, range(0, 900, 100), 10).items()}


def plain_codes(rows):
    """The contract with Python integers and floor division."""
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], c) for i, v, c in rows]
    kept = [(i, v + [0] * (-len(v) % 16), c) for i, v, c in kept]
    size = len(kept[0][1]) // 16
    cut = [[tuple(v[p * size : p * size + size]) for p in range(16)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0], kept[k][1]))[:64]
    books = [[cut[k][p] for k in first] for p in range(16)]
    near = lambda p, v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(books[p]))
    for _ in range(2):
        for p in range(16):
            given = {}
            for parts in cut:
                given.setdefault(near(p, parts[p])[1], []).append(parts[p])
            for e, held in given.items():
                books[p][e] = tuple(sum(x) // len(held) for x in zip(*held, strict=True))
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    coded = [[near(p, parts[p]) for p in range(16)] for parts in cut]
    errors, sums = [sum(d for d, _ in c) for c in coded], {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        sums[label] = sums.get(label, 0) + e
    return sorted(((i, "".join(f"{e:02x}" for _, e in c), err, sums[label], digest) for (i, _, label), c, err in zip(kept, coded, errors, strict=True)), key=repr)


@pytest.mark.parametrize(("dim", "n"), [(16, 300), (64, 150), (20, 90), (3, 40)])
def test_codes_against_plain_integers(spark, dim, n, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 64)
    rng = random.Random(dim)
    rows = [(rng.randrange(10**6), [rng.choice([-0.5, 0, 0.25, rng.gauss(0, 1)]) for _ in range(dim)], rng.choice([None, 1, 2, 2, 2])) for _ in range(n)]
    rows += rows[:5]
    odd = [(1, None, 1), (2, [], 1), (3, [None] * dim, None), (4, [float("nan")] * dim, 1), (5, [float("inf")] + [0] * (dim - 1), 1), (6, [1.0] * (dim + 1), 1)]
    got = vector_codes.compress(table(spark, rows + odd, ("code", "error", "__label", "n")).drop("code").withColumn("code", F.lit(1)).repartition(5))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_codes(rows)


def test_codes_with_few_or_common_labels(spark, monkeypatch):
    rows = [(i, [i / 7 + k for k in range(16)], i % 50 if i % 3 else None) for i in range(150)]
    want = plain_codes(rows)
    monkeypatch.setattr(vector_codes, "LABELS", 3)
    assert sorted(map(tuple, vector_codes.compress(table(spark, rows)).collect()), key=repr) == want
    none = vector_codes.compress(table(spark, [(1, None, 1)]))
    assert none.count() == 0 and none.dtypes == [("vec_id", "bigint"), ("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string")]


def test_integers_hold_what_sums_can():
    """Floors go down, and what squared distances could not hold is held at the bound."""
    x = np.array([[-0.001, 0.001, 1e30, -1e30] + [0.0] * 12])
    got = vector_codes.integers(x).ravel().tolist()
    assert got[:2] == [-1, 0] and got[2] == -got[3] and 16 * (2 * got[2]) ** 2 < 2**63
