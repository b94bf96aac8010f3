"""The registered queries on small directories: folds, thresholds, columns, and tables that are empty or full of nulls."""

import os
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import registry

COLUMNS = {
    "op1_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op3_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op4_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op5_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op6_substring_dedup": {"doc_id": "bigint", "repeated_words": "bigint", "removed_words": "bigint"},
    "op7_ngram_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op8_decontamination": {"doc_id": "bigint", "item_id": "bigint", "edits": "bigint"},
    "op9_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op10_quality_classifier": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op11_nearest": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op12_vector_codes": {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"},
    "op13_ranked_search": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
}
#: These give a row for each row of their table.
WHOLE = set(COLUMNS) - {"op6_substring_dedup", "op8_decontamination", "op11_nearest", "op12_vector_codes", "op13_ranked_search"}
PAGES = {"op3_url_filter", "op9_warc"}
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string", "pages": "page_id long, url string, html string", "embeddings": "vec_id long, embedding array<float>, label int",
}


def wrote(spark, folder, tables, extra=()):
    for name, schema in SCHEMAS.items():
        frame = spark.createDataFrame(tables.get(name, []), schema)
        for c in extra:
            if c not in frame.columns:
                frame = frame.withColumn(c, F.lit("own"))
        frame.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def plain(spark, tmp_path_factory):
    rng = random.Random(31)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs, labels, passage = [], [], text(70)
    for i in range(400):
        bad, toxic = i % 7 == 0, i % 5 == 1
        body = text(rng.randint(40, 120))
        body = " ".join(w + "%%%" for w in body.split()) if bad else body
        body += f" you grumblefop and {rng.choice(['snarkwit', 'grumblefop'])}" * toxic
        body += f" {passage}" if i in (50, 53) else ""
        docs.append((i, body, "en", f"s{i % 4}" if i % 9 else None, len(body)))
        labels.append((i, int(not bad), int(toxic)))
    docs.append((400, docs[3][1], "en", "s1", 0))
    pages = [(i, f"http://{'x.net' if i % 3 else 'a.org'}/fr/{i}", f"<p>{text(60)}</p>" if i % 4 else "<p>same</p>") for i in range(60)]
    vectors = [(i, [rng.gauss(0, 1) for _ in range(32)], i % 5) for i in range(250)]
    return wrote(spark, tmp_path_factory.mktemp("plain"), {"embeddings": vectors, "documents": docs, "labels": labels, "pages": pages, "benchmark": [(1, " ".join(docs[9][1].split()[5:30]))]}, ("id", "score", "text_", "key", "host", "verdict", "path", "digest"))


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, plain, name):
    rows = registry.queries()[name](spark, plain)
    kinds = dict(rows.dtypes)
    assert {c: kinds[c] for c in COLUMNS[name]} == COLUMNS[name]
    if name in WHOLE:
        key = "page_id" if name in PAGES else "doc_id"
        assert sorted(r[key] for r in rows.select(key).collect()) == list(range(60 if name in PAGES else 401))


@pytest.mark.parametrize(("name", "modulus", "held", "least", "label"), [("op1_toxicity", 5, 0, 0.5, "toxic"), ("op10_quality_classifier", 4, 2, 0.7, "quality")])
def test_folds_and_thresholds(spark, plain, tmp_path, name, modulus, held, least, label):
    run = registry.queries()[name]
    rows = {r["doc_id"]: r for r in run(spark, plain).collect()}
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % modulus == held) and r["predicted"] == int(r["score"] >= least) and 0 <= r["score"] <= 1
    # labels of the held-out fold change no score
    for t in SCHEMAS:
        frame = spark.read.parquet(f"{plain}/{t}.parquet")
        if t == "labels":
            mark = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == held
            assert frame.where(mark).count() > 50
            frame = frame.withColumn(label, F.when(mark, 1 - F.col(label)).otherwise(F.col(label)))
        frame.write.parquet(f"{tmp_path}/{t}.parquet")
    assert {r["doc_id"]: r["score"] for r in run(spark, str(tmp_path)).collect()} == {i: r["score"] for i, r in rows.items()}


def test_verdicts_and_records(spark, plain):
    found = {r["page_id"]: r for r in registry.queries()["op3_url_filter"](spark, plain).collect()}
    assert all((r["rule"], r["verdict"]) == (("net/", "block") if i % 3 else ("org/fr/", "allow")) for i, r in found.items())
    records = {r["page_id"]: r for r in registry.queries()["op9_warc"](spark, plain).collect()}
    assert all((r["record_type"], r["refers_to"]) == (("revisit", 0) if i % 4 == 0 and i else ("response", None)) for i, r in records.items())


def test_what_is_found(spark, plain):
    q = registry.queries()
    assert {r["doc_id"] for r in q["op6_substring_dedup"](spark, plain).collect()} == {3, 50, 53, 400}
    assert {(r["doc_id"], r["item_id"]) for r in q["op8_decontamination"](spark, plain).collect()} == {(9, 1)}
    assert {r["doc_id"]: r["component_id"] for r in q["op7_ngram_join"](spark, plain).collect()} == {i: 3 if i == 400 else i for i in range(401)}
    rows = q["op2_mixing"](spark, plain).collect()
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_empty_and_null_tables(spark, tmp_path, name):
    run = registry.queries()[name]
    assert run(spark, wrote(spark, tmp_path / "empty", {})).count() == 0
    nulls = {"documents": [(None, None, None, None, None), (1, None, None, None, None), (1, "", None, None, 0), (2, "\n \n", "x", "", 3), (3, "w " * 30_000, None, None, 1), (3, "w " * 30_000, None, None, 1)], "labels": [(None, None, None), (1, None, 1), (3, 1, 0), (3, 0, 1)]}
    nulls |= {"benchmark": [(None, None), (1, ""), (2, "not there at all")], "pages": [(None, None, None), (1, None, ""), (2, "", None), (2, "", None), (4, "http://" + "a." * 5_000 + "net/" + "x/" * 20_000, "h" * 2_000_000)]}
    nulls["embeddings"] = [(None, None, None), (0, None, 1), (0, [1.0, 2.0], None), (0, [1.0, 2.0], None), (None, [3.0, 4.0], 1), (100, [], 1)]
    rows = run(spark, wrote(spark, tmp_path / "nulls", nulls)).collect()
    assert name != "op12_vector_codes" or len(rows) == 3
    assert name not in WHOLE or len(rows) == len(nulls["pages" if name in PAGES else "documents"])


def test_searches_and_codes(spark, plain):
    q = registry.queries()
    near = q["op11_nearest"](spark, plain).collect()
    assert {r["query_id"] for r in near} == {0, 100, 200} and len(near) == 30
    coded = q["op12_vector_codes"](spark, plain).collect()
    assert sorted(r["vec_id"] for r in coded) == list(range(250)) and {len(r["code"]) for r in coded} == {32} and len({r["codebooks_sha256"] for r in coded}) == 1
    best = q["op13_ranked_search"](spark, plain).collect()
    assert [r["doc_id"] for r in best if r["rank"] == 1] == [9]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_rows_match_sql(spark, name):
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in SCHEMAS:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    rows = registry.queries()[name](spark, data)
    told = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in told.description]
    assert sorted(names) == sorted(rows.columns)
    rounded = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    assert sorted(map(rounded, rows.select(*names).collect()), key=repr) == sorted(map(rounded, told.fetchall()), key=repr)
