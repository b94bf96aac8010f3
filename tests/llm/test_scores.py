"""Classifiers, rules, toxicity and token counts on small inputs."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.llm import arrays, boosting, quality_classifier, quality_rules, statistics, toxicity, url_filter
from loomgraph.llm.labelled import id_remainder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [None, "", " ", "\n\n", "a", "a b c d", "x " * 9000, "é ü\x0bß 日本 😀", "a b\n\na b\n a b", "# $ %%% <a> | &", "w" * 50_000]


def plain_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(c in statistics.SYMBOLS for c in text), dup, len(inside)]


def measured(texts):
    raw, offsets = arrays.flat(pa.array(texts, pa.string()))
    out = [[] for _ in statistics.BASE]
    for i, j in arrays.slices(offsets, 64):
        for o, x in zip(out, statistics.base_arrays(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[0], strict=True):
            o += x.tolist()
    return list(map(list, zip(*out, strict=True)))


def test_statistics_of_awkward_texts():
    assert measured(AWKWARD) == [plain_statistics(t) for t in AWKWARD]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab \n\t#é", max_size=80), min_size=1, max_size=5))
def test_statistics_of_any_texts(texts):
    assert measured(texts) == [plain_statistics(t) for t in texts]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def labelled(spark, n=400, seed=1):
    """Plain documents are good; shouted or littered ones are not; insults are toxic."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(30, 120)))
        bad, toxic = i % 7 == 0, i % 5 == 0
        if bad:
            text = " ".join(w.upper() + "!!" if i % 2 else w + "%%%" for w in text.split())
        if toxic:
            text += " you " + rng.choice(["grumblefop", "snarkwit", "blotherer"]) + " and " + rng.choice(["grumblefop", "snarkwit"])
        rows.append((i, text))
        labels.append((i, 0 if bad else 1, int(toxic)))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_forest_matches_a_walk_and_constant_labels():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    f = boosting.fit(x, y, trees=20)
    depth = (f.feature.shape[1] + 1).bit_length() - 1

    def walk(row):
        total = f.start
        for t in range(len(f.feature)):
            node = 0
            for _ in range(depth):
                node = 2 * node + 1 + (row[f.feature[t, node]] > f.threshold[t, node])
            total += f.leaf[t, node - f.feature.shape[1]]
        return total

    assert np.allclose(f.margin(x), [walk(r) for r in x]) and ((f.probability(x) > 0.5) == y).mean() > 0.95
    assert np.allclose(boosting.fit(x, np.ones(300)).probability(x), 0.999) and np.allclose(boosting.fit(x[:0], y[:0]).probability(x), 0.5)


def test_quality_classifier(spark):
    docs, labels = labelled(spark)
    held = id_remainder(F.col("doc_id"), 4) == 2
    model = quality_classifier.train(docs, labels, fold=~held)
    scored = quality_classifier.score(docs, model, keep=["doc_id"]).join(labels, "doc_id").where(held).toPandas()
    assert ((scored.score >= 0.7) == (scored.quality == 1)).mean() > 0.95
    odd = documents(spark, [(None, AWKWARD[0]), *((i, t) for i, t in enumerate(AWKWARD)), (3, "twice"), (3, "twice")]).withColumn("score", F.lit("clash")).withColumn("text_", F.lit(1))
    out = quality_classifier.score(odd, model)
    assert out.count() == len(AWKWARD) + 3 and out.columns == [*DOCS_COLUMNS, "text_", "score"] and out.where("score between 0 and 1").count() == out.count()
    assert quality_classifier.score(odd.limit(0), model).count() == 0
    kept = quality_classifier.keep_good(docs, model)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


DOCS_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_rules(spark):
    docs, labels = labelled(spark)
    model = quality_rules.train(docs, labels)
    out = quality_rules.judge(docs, model).join(labels, "doc_id").toPandas()
    assert out[out.quality == 1].kept.mean() > 0.98 and out[out.quality == 0].kept.mean() < 0.2
    odd = quality_rules.judge(documents(spark, list(enumerate(AWKWARD)) + [(None, None)]), model).toPandas()
    assert not odd[odd.n_words < 20].kept.any() and odd[odd.n_words == 9000].base_failed.all() and len(odd) == len(AWKWARD) + 1
    empty = quality_rules.train(docs.limit(0), labels.limit(0))
    assert quality_rules.judge(docs, empty).where("kept = base_failed").count() == 0


def test_quality_rules_are_fitted_on_all_labelled_rows(spark):
    n = 21_000
    rng = np.random.default_rng(8)
    rows = [(i, " ".join("abcdefg"[k] * (k + 1 + i % 3) for k in rng.integers(0, 7, 24)) + ("!" if i % 5 else "#")) for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 9 > 0), 0) for i in range(n)], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows)
    model = quality_rules.train(docs, labels)
    got = statistics.with_statistics(docs, "doc_id", "text").toPandas()
    fit = got[(got.n_words >= 20) & (100 * got.n_repeat_words <= 30 * got.n_words)]
    x = quality_rules.features({c: fit[c] for c in statistics.COLUMNS})[:, quality_rules.SHAPE]
    good, bounds = x[(fit.id % 9 > 0).to_numpy()], (x.min(0), x.max(0))
    forest = quality_rules.isolate(good, bounds)
    assert len(good) > 18_000 and np.array_equal(forest.path, model.path) and np.array_equal(forest.threshold, model.threshold)
    counts = quality_rules.leaf_counts(forest.feature, forest.threshold, good)
    unseen = quality_rules.weighed(forest.feature, forest.threshold, counts, left_out=1)
    assert model.limit == np.sort(unseen.anomaly(good))[-1 - int(0.002 * len(good))]


def test_rows_left_out_are_scored_as_unseen():
    x = np.random.default_rng(4).normal(size=(60, 3))
    bounds = (x.min(0), x.max(0))
    f = quality_rules.isolate(x, bounds, trees=8)
    unseen = quality_rules.weighed(f.feature, f.threshold, quality_rules.leaf_counts(f.feature, f.threshold, x), left_out=1)
    want = [quality_rules.isolate(np.delete(x, i, 0), bounds, trees=8).anomaly(x[i : i + 1])[0] for i in range(60)]
    assert np.allclose(unseen.anomaly(x), want)


def test_the_limit_drops_a_share_of_unseen_good_rows():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 4))
    grown = quality_rules.isolate(x[::2], (x.min(0), x.max(0)))
    s = np.sort(grown.anomaly(x[1::2]))
    model = quality_rules.calibrate(grown, x[1::2], np.ones(1000), 0.01)
    assert (s > model.limit).sum() == 10 and quality_rules.calibrate(grown, x[1::2], np.zeros(1000)).limit == np.inf


def test_isolation_paths_against_a_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    f = quality_rules.isolate(x, (x.min(0), x.max(0)), trees=8, subsample=64)
    inner = f.feature.shape[1]

    def path(row, t):
        node = 0
        while node < inner:
            node = 2 * node + 1 + (row[f.feature[t, node]] > f.threshold[t, node])
        return f.path[t, node - inner]

    want = [2 ** (-np.mean([path(r, t) for t in range(8)]) / f.scale) for r in x]
    assert np.allclose(f.anomaly(x), want)
    assert f.anomaly(np.array([[50.0, 50.0, 50.0]]))[0] > np.median(want)


def edits(a, b):
    last, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                new[-1] = min(new[-1], last[j - 2] + 1)
        last, row = row, new
    return row[-1]


def test_automaton_against_edit_distance():
    rng = random.Random(5)
    terms = ["idiotic", "scum", "moronic", "trashy", "réeux*"]
    machine = toxicity.Automaton(terms, [1.0] * 5)
    for _ in range(3000):
        word = "".join(rng.choice("idotcsumrnahyé") for _ in range(rng.randint(1, 9))) if rng.random() < 0.3 else rng.choice(terms).removesuffix("*")
        for _ in range(rng.randint(0, 2)):
            p = rng.randrange(len(word) + 1)
            word = rng.choice([word[:p] + word[p + 1 : p + 2] + word[p : p + 1] + word[p + 2 :], word[:p] + word[p + 1 :], word[:p] + "x" + word[p:], word[:p] + rng.choice("oi") + word[p + 1 :]]) or "a"
        points = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        state = machine.walk(machine.letters[points], np.array([0]), np.array([len(word)]))[0]
        exact = word in terms or word.startswith("réeux")
        near = any(len(t) >= toxicity.FUZZY_LENGTH and not t.endswith("*") and edits(word, t) == 1 for t in terms)
        assert (machine.found[state] > 0) == (exact or near) and (not exact or not machine.near[state]), word


def test_no_bound_on_terms():
    rng = random.Random(2)
    rows = [("".join(rng.choice("abcdefghijklmnop") for _ in range(9)), 40, 0) for _ in range(600)]
    machine = toxicity.choose_terms(rows, 1000, 9000)
    assert len(machine.terms) == len({t for t, _, _ in rows})
    points = np.frombuffer("".join(t for t, _, _ in rows).encode("utf-32-le"), np.uint32)
    state = machine.walk(machine.letters[points], np.arange(600) * 9, np.full(600, 9))
    assert (machine.found[state] > 0).all() and not machine.near[state].any()


def plain_context(machine, text):
    """The four sums by a walk over the words, one after the other."""
    tokens = text.lower().split()
    words = [(k, t.strip(toxicity.PUNCTUATION)) for k, t in enumerate(tokens) if t.strip(toxicity.PUNCTUATION)]
    at = [k for k, (_, w) in enumerate(words) if w in machine.terms]
    total, most, often, each = 0.0, 0.0, 0.0, {}
    for k in at:
        a, b = max(k - toxicity.WINDOW, 0), min(k + toxicity.WINDOW, len(words) - 1)
        place, word = words[k]
        raw = tokens[place]
        cut = raw.index(word)
        before = " ".join([*tokens[words[a][0] : place], raw[:cut]])
        after = " ".join([raw[cut + len(word) :], *tokens[place + 1 : words[b][0] + 1]])
        worth = 1.0
        if any(c in toxicity.QUOTES for c in after) and sum(c in toxicity.QUOTES for c in before) % 2:
            worth *= toxicity.QUOTED * (0.5 if toxicity.REPORTING & set(before.split()) else 1)
        elif toxicity.YOU & {x.strip(toxicity.PUNCTUATION) for x in before.split() + after.split()}:
            worth *= toxicity.ADDRESS
        worth *= 1 + toxicity.COMPANY * sum(a <= x <= b for x in at if x != k)
        weight = machine.weights[machine.terms.index(word)]
        total, most, often = total + worth * weight, max(most, worth * weight), often + worth
        each[word] = max(each.get(word, 0), min(worth, 1.0))
    return [np.log1p(total), most, np.log1p(100 * often / max(len(words), 1)), np.log1p(sum(each.values()))]


def test_context_sums_against_a_walk():
    rng = random.Random(4)
    machine = toxicity.Automaton(["grumble", "snarkwit"], [2.0, 1.5])
    texts = [" ".join(rng.choice(["grumble", "snarkwit!", '"grumble"', "you", "said", '"', "plain", "words", "here", "and", "-"]) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    assert np.allclose(machine.features(texts), [plain_context(machine, t) for t in texts])


def test_toxicity(spark):
    docs, labels = labelled(spark)
    held = id_remainder(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, labels, fold=~held)
    out = toxicity.score(docs, model).join(labels, "doc_id").where(held).toPandas()
    assert ((out.score >= 0.5) == (out.toxic == 1)).mean() > 0.97
    plain, insult, wrong, quoted, *rest = model.score(["a plain text about nothing", "you grumblefop", "you grumblefxp", 'he called it a "grumblefop" in his text', "", None])
    assert model.score(["you grumblfeop"])[0] > plain
    assert insult > 0.5 > plain and wrong > plain and quoted < insult and rest == [plain, plain]
    odd = toxicity.score(documents(spark, [(None, None), *enumerate(AWKWARD)]), model)
    assert odd.count() == len(AWKWARD) + 1 and odd.where("score between 0 and 1").count() == odd.count()
    nothing = toxicity.train(docs.limit(0), labels.limit(0))
    assert nothing.score(["grumblefop"]).tolist() == [0.5]


def plain_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in url_filter.LIST if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


URLS = [None, "", "no scheme", "http://", "HTTP://A.Net/x?y#z", "x://sub.Example.NET/en/1", "x://example.net/de/", "x://example.com/de/?q", "x://org/fr/", "x://a.org/fr/x", "x://net", "x://notnet/", "x://a.net?x/en/", "x://a.net#b", "a://b://c.net/d", "x://É.net/"]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(URLS)] + [(None, "x://a.net/", ""), (1, "", "")], "page_id long, url string, html string")
    pages = pages.withColumn("host", F.lit("clash")).withColumn("tokens", F.lit(1)).withColumn("id", F.lit("x"))
    long = spark.createDataFrame([(9, "http://a.com/" + "x/" * 100_000 + "de/?" + "k=v&" * 100_000, "", "", 1, "")], pages.schema)
    assert url_filter.judge(long, [(("path:de",), "block", 0.9)]).first()["verdict"] == "block"
    out = url_filter.judge(pages, [(("path:de",), "block", 0.9)]).collect()
    assert len(out) == len(URLS) + 2
    for r in out[: len(URLS)]:
        host, path, rule, verdict = plain_url(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), URLS[r["page_id"]]
        assert r["verdict"] == (verdict or ("block" if "/de/" in path else "allow"))
    assert url_filter.judge(pages.limit(0), []).count() == 0


def told_pages(spark, n=400):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        tokens = [f"domain:{rng.choice('ab')}.com", "host:spam" if bad else "host:good", *(["host:twin"] if bad else []), f"path:{rng.choice('pqr')}", f"key:{i}"]
        if i % 10 == 1:
            tokens += ["path:mixed", "path:pair"]
        rows.append((i, tokens, "block" if bad or {"path:mixed", "path:p"} <= set(tokens) else "allow"))
    return spark.createDataFrame([*rows, (None, [], "block"), (7, ["host:good"], None)], "id long, tokens array<string>, verdict string"), rows


def test_mined_rules(spark):
    told, rows = told_pages(spark)
    mined = url_filter.mine(told, min_support=0.01)
    rules = {(t, v): c for t, v, c in mined}
    # host:twin stands where host:spam does, so one of them speaks for both
    assert rules[("host:spam",), "block"] == 1.0 and not any("host:twin" in t for t, _ in rules)
    total = Counter(v for _, _, v in rows)
    for (tokens, verdict), sure in rules.items():
        here = [v for _, held, v in rows if set(tokens) <= set(held)]
        share = {v: here.count(v) / total[v] for v in total}
        assert abs(sure - share[verdict] / sum(share.values())) < 1e-9 and sure >= url_filter.MIN_CONFIDENCE and here.count(verdict) >= 4
        for t in tokens:
            part = [v for _, held, v in rows if set(tokens) - {t} <= set(held)]
            if len(tokens) > 1:
                less = {v: part.count(v) / total[v] for v in total}
                assert less[verdict] / sum(less.values()) < sure
    index = url_filter.RuleIndex(mined)
    for tokens in (["host:spam", "domain:a.com"], ["host:good"], ["path:mixed", "path:p", "host:good"], []):
        fits = [v for need, v, _ in mined if set(need) <= set(tokens)]
        assert index.verdict(tokens) == (fits[0] if fits else "allow")
    assert url_filter.mine(told.limit(0)) == [] and url_filter.mine(told.where("verdict = 'block'")) == []


def test_url_tokens(spark):
    urls = ["https://blog.casino-win.example.com/en/18plus-shop/33.html?x=1&y#z", "http://com/7/", "x://a.b/2024.pdf", "nothing", None]
    host, path = url_filter.host_and_path(F.col("url"))
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select(url_filter.url_tokens(F.col("url"), host, path).alias("t")).collect()
    assert [sorted(r["t"] or []) for r in rows] == [["domain:example.com", "end:html", "host:blog", "host:casino", "host:win", "key:x", "key:y", "path:18plus-shop", "path:en"], ["domain:com"], ["domain:a.b", "end:pdf"], [], []]


def test_pages_are_labelled_by_their_text(spark):
    docs, labels = labelled(spark)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    marks = {r["doc_id"]: r["quality"] == 0 or r["toxic"] == 1 for r in labels.collect()}
    html = lambda t: f"<html><style>p {{x: y}}</style><script>grumblefop()</script><p>{t.replace('<', '&lt;')}</p></html>"
    pages = spark.createDataFrame([(i, f"x://{'bad' if marks[i] else 'good'}.a.com/", html(texts[i]), 1, "x") for i in range(300)] + [(None, None, None, 1, "y")], "page_id long, url string, html string, id int, verdict string")
    told = url_filter.labelled_pages(pages, docs, labels).toPandas()
    known = told[told.id.notna()]
    assert len(told) == 301 and ((known.verdict == "block") == known.id.astype(int).map(marks)).mean() > 0.95
    assert url_filter.labelled_pages(pages.limit(0), docs, labels).count() == 0


def test_token_counts(spark):
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece

    from loomgraph.llm import token_counts

    path = public.path("piece_bpe_32k.model")
    model, library = token_counts.PieceModel.read(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(6)
    texts = AWKWARD + ["<s> </s> <0x0A>", "▁a▁", "the" * 300, "ab cd " * 50] + ["".join(rng.choice("ab e\n\t▁ éß日本😀\x00​theing") for _ in range(rng.randint(1, 300))) for _ in range(300)]
    rows = spark.createDataFrame([*enumerate(texts), (None, "a"), (0, "a")], "doc_id long, text string")
    got = token_counts.count_tokens(rows, model).toPandas()
    assert len(got) == len(texts) + 2
    want = [len(x) for x in library.encode([t or "" for t in texts], num_threads=1)]
    assert got.n_tokens.tolist()[: len(texts)] == want
    assert got.n_bytes.tolist()[: len(texts)] == [len((t or "").encode()) for t in texts]
    assert (got.over_limit == (got.n_tokens > 4096)).all()
    assert token_counts.count_tokens(rows.limit(0), model).count() == 0


def test_long_tokens_in_chunks():
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece

    from loomgraph.llm import token_counts

    path = public.path("piece_bpe_32k.model")
    model = token_counts.PieceModel.read(path)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(9)
    texts = [("several words  and\nlines " * 80_000)[:1_148_575], "日本語" * 9_000, "".join(rng.choice("aeinrst") for _ in range(20_000)), "a" * 5_000, " " * 3_000, "".join(rng.choice("ab") for _ in range(3_000))]
    texts += ["".join(rng.choice("theinandr") for _ in range(rng.randint(30, 300))) for _ in range(300)]
    assert model.count_texts(texts) == [len(x) for x in library.encode(texts, num_threads=1)]


def plain_merges(model, word):
    """Symbols left when the leftmost of the lowest-ranked pairs merges again and again."""
    symbols = model.symbol[[ord(c) for c in word]].tolist()
    while len(symbols) > 1:
        rank, merged = model.pairs(np.array(symbols[:-1]), np.array(symbols[1:]))
        if rank.min() == 2**31 - 1:
            break
        at = int(rank.argmin())
        symbols[at : at + 2] = [int(merged[at])]
    return len(symbols)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=2, max_size=5), min_size=1, max_size=12, unique=True), st.lists(st.text("abcd", min_size=1, max_size=40), min_size=1, max_size=6))
def test_merges_on_both_sides_of_the_matrix(pieces, words):
    from loomgraph.llm import token_counts

    model = token_counts.PieceModel.of({**{c: -99.0 - i for i, c in enumerate("abc")}, **{p: -float(i) for i, p in enumerate(pieces)}}, False)
    want = [plain_merges(model, w) for w in words]
    lengths = np.array([len(w) for w in words])
    symbols = model.symbol[[ord(c) for w in words for c in w]]
    assert model.count(words).tolist() == want == model._flat(symbols, lengths).tolist()
