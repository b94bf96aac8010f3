"""Toxicity: a Levenshtein automaton intersected with a trie of learned terms, scored in context.

Terms are words and word stems that labelled toxic documents hold and clean ones do
not; how many there are is bounded by the evidence that the sample of labelled rows can
give.  Their trie, walked with up to one edit (two letters that have changed places
count as one; stems and words of fewer than FUZZY_LENGTH letters must be exact), is made deterministic once and kept as a
table, so that all words of a batch step through it together; a word that leaves the
neighbourhood of every term drops out within a few steps.  Each hit is weighed by the
words around it: quoted terms count less, terms among other terms or addressed to the
reader count more.  A logistic model over these sums gives the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.arrays import trimmed
from loomgraph.llm.labelled import SAMPLE_ROWS, id_remainder, label_sample
from loomgraph.llm.session import discard, prepare, written

#: Lengths of stems, and the least length of a word that may be misspelled.
STEMS = range(4, 8)
FUZZY_LENGTH = 5
#: A term needs this log-likelihood ratio against chance, and this share of toxic documents.
EVIDENCE, PRECISION = 20.0, 0.8
#: A misspelled hit's worth, a quoted hit's, and what address and company add.
MISSPELT, QUOTED, ADDRESS, COMPANY = 0.6, 0.3, 1.25, 0.1
WINDOW = 6
#: Quotation marks, words of reporting, words of address.
QUOTES = frozenset("\"“”„«»‘’`")
REPORTING = frozenset("said says saying called calling wrote quote quoted quoting word words term terms dit disait sagte sagt nannte dijo dice llamó mot wort palabra".split())
YOU = frozenset("you your you're u ur du dich dir sie tu te toi vous ton tú usted tus".split())
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”„«»‘’…¡¿"

CHUNK = 1 << 20  # characters taken through the automaton at a time, or one longer text
_KIND = np.ones(0x110000, np.uint8)  # 0 space, 1 word, 2 punctuation
_KIND[[*range(0x21), 0x85, 0xA0, 0x2028, 0x2029, 0x3000]] = 0
_KIND[[ord(c) for c in PUNCTUATION]] = 2
_TOKEN = re.compile(r"\S+")


def plain_words(text: str) -> set[str]:
    """Distinct lower-case words of a text without punctuation around them."""
    return {w for w in (x.strip(PUNCTUATION) for x in _TOKEN.findall(text.lower())) if w}


@dataclass
class Automaton:
    """Terms (a stem ends in *) and their weights, as a table of transitions."""

    terms: list[str]
    weights: list[float]
    ordinary: frozenset = frozenset()  # near misses that clean documents use as words
    table: np.ndarray = field(init=False, repr=False)
    found: np.ndarray = field(init=False, repr=False)  # state -> 1 + term, 0 for none
    near: np.ndarray = field(init=False, repr=False)  # state -> whether one edit was needed
    letters: np.ndarray = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self.letters = np.zeros(0x110000, np.int16)
        alphabet = sorted({c for t in self.terms for c in t.removesuffix("*")})
        for i, c in enumerate(alphabet):
            self.letters[ord(c)] = i + 1
        kids: list[dict[str, int]] = [{}]
        above: list[tuple[int, str]] = [(0, "")]
        word, stem, long = {}, {}, set()
        for i, t in enumerate(self.terms):
            node, path = 0, [0]
            for c in t.removesuffix("*"):
                node = kids[node].setdefault(c, len(kids))
                if node == len(kids):
                    kids.append({})
                    above.append((path[-1], c))
                path.append(node)
            if t.endswith("*"):
                stem[node] = i
            else:
                word[node] = i
                if len(t) >= FUZZY_LENGTH:
                    long.update(path)

        def closed(states: set) -> frozenset:
            # a letter of the term may be missing
            more = {(k, 1) for v, e in states if e == 0 and v >= 0 for k in kids[v].values() if k in long}
            return frozenset(states | more)

        def step(states: frozenset, c: str) -> frozenset:
            out = set()
            for v, e in states:
                if v < 0:  # inside a stem's word
                    out.add((v, e))
                    continue
                if e == 2:  # of two letters that have changed places, the second is to come
                    if above[above[v][0]][1] == c:
                        out.add((v, 1))
                    continue
                k = kids[v].get(c)
                if k is not None and (e == 0 or k in long):
                    out.add((k, e))
                    if e == 0 and k in stem:
                        out.add((-1 - stem[k], 0))
                if e == 0 and v in long:
                    out.add((v, 1))  # a letter too many
                    out.update((k, 1) for x, k in kids[v].items() if x != c and k in long)  # another letter
                    out.update((kids[k][c], 2) for x, k in kids[v].items() if x != c and c in kids[k] and kids[k][c] in long)
            return closed(out)

        first = closed({(0, 0)})
        ids, rows, queue = {frozenset(): 0, first: 1}, [[0] * (len(alphabet) + 1)], [first]
        for states in queue:
            row = []
            for c in ["", *alphabet]:
                to = step(states, c)
                if to not in ids:
                    ids[to] = len(ids)
                    queue.append(to)
                row.append(ids[to])
            rows.append(row)
        self.table = np.array(rows, np.int32)
        self.found, self.near = np.zeros(len(ids), np.int32), np.zeros(len(ids), bool)
        for states, i in ids.items():
            exact = [word[v] for v, e in states if e == 0 and v in word]
            stems = [-1 - v for v, _ in states if v < 0]
            close = [word[v] for v, e in states if e == 1 and v in word and len(self.terms[word[v]]) >= FUZZY_LENGTH]
            best = exact or stems or close
            if best:
                self.found[i] = 1 + max(best, key=lambda t: (self.weights[t], -t))
                self.near[i] = not exact and not stems

    def walk(self, letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Final state of each word, 0 where no term is near."""
        out = np.zeros(len(starts), np.int32)
        alive, state, at = np.arange(len(starts)), np.ones(len(starts), np.int32), 0
        while len(alive):
            state = self.table[state, letters[starts[alive] + at]]
            at += 1
            done = lengths[alive] == at
            out[alive[done]] = state[done]
            go = ~done & (state != 0)
            alive, state = alive[go], state[go]
        return out

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Four sums of each text over hits weighed by context: their weights, the strongest, their number per 100 words, distinct terms."""
        out, i = np.zeros((len(texts), 4)), 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size < CHUNK):
                size += len(texts[j] or "")
                j += 1
            out[i:j] = self._chunk([(t or "").lower() for t in texts[i:j]])
            i = j
        return out

    def _chunk(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), 4))
        if not self.terms:
            return out
        joined = "\n".join([*texts, ""])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _KIND[points]
        inside = np.concatenate([[False], kind != 0, [False]])
        heads, tails = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:])
        core = np.flatnonzero(kind == 1)
        first, last = np.searchsorted(core, heads), np.searchsorted(core, tails, "right") - 1
        real = np.flatnonzero(first <= last)
        if not len(real):
            return out
        starts, stops = core[first[real]], core[last[real]] + 1
        heads, tails = heads[real], tails[real] + 1
        state = self.walk(self.letters[points], starts, stops - starts)
        ends = np.cumsum([len(t) + 1 for t in texts])
        doc = np.searchsorted(ends, starts, "right")
        n_words = np.bincount(doc, minlength=len(texts))
        bounds = np.concatenate([[0], np.cumsum(n_words)])
        hits = np.flatnonzero(self.found[state] > 0)
        hits = [int(h) for h in hits if not (self.near[state[h]] and joined[starts[h] : stops[h]] in self.ordinary)]
        places, terms = np.array(hits, np.int64), [{} for _ in texts]
        for h in hits:
            d, term = int(doc[h]), int(self.found[state[h]]) - 1
            a, b = max(h - WINDOW, bounds[d]), min(h + WINDOW, bounds[d + 1] - 1)
            before, after = joined[heads[a] : starts[h]], joined[stops[h] : tails[b]]
            worth = MISSPELT if self.near[state[h]] else 1.0
            if any(c in QUOTES for c in after) and sum(c in QUOTES for c in before) % 2:
                worth *= QUOTED * (0.5 if REPORTING & set(before.split()) else 1.0)
            elif YOU & {x.strip(PUNCTUATION) for x in before.split() + after.split()}:
                worth *= ADDRESS
            company = np.searchsorted(places, b, "right") - np.searchsorted(places, a) - 1
            worth *= 1 + COMPANY * int(company)
            out[d, 0] += worth * self.weights[term]
            out[d, 1] = max(out[d, 1], worth * self.weights[term])
            out[d, 2] += worth
            terms[d][term] = max(terms[d].get(term, 0.0), min(worth, 1.0))
        out[:, 0] = np.log1p(out[:, 0])
        out[:, 2] = np.log1p(100 * out[:, 2] / np.maximum(n_words, 1))
        out[:, 3] = np.log1p([sum(t.values()) for t in terms])
        return out


def choose_terms(rows: list, toxic: int, clean: int) -> Automaton:
    """The terms with the most evidence among (term, toxic documents, clean documents)."""
    share = (toxic + 1) / (toxic + clean + 2)
    scored = []
    for term, a, b in rows:
        n = a + b
        ratio = 2 * (a * np.log(a / (n * share)) + (b * np.log(b / (n * (1 - share))) if b else 0.0)) if a else 0.0
        if ratio >= EVIDENCE and a / n >= PRECISION:
            scored.append((-ratio, term.endswith("*"), term, a, b))
    kept: dict[str, tuple[int, int]] = {}
    for _, is_stem, term, a, b in sorted(scored):
        bare = term.removesuffix("*")
        if any(bare.startswith(k[:-1]) for k in kept if k.endswith("*")):
            continue
        # a stem that says little more than a word it begins is that word
        if is_stem and any(k.startswith(bare) and a <= 1.2 * n for k, (n, _) in kept.items()):
            continue
        kept[term] = (a, b)
    prior = np.log(share / (1 - share))
    return Automaton(list(kept), [float(np.log((a + 0.5) / (b + 0.5)) - prior) for a, b in kept.values()])


@dataclass
class Model:
    automaton: Automaton
    slope: np.ndarray
    start: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        margin = self.automaton.features(texts) @ self.slope + self.start
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.5) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps; without both classes, a constant."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return np.zeros(x.shape[1]), float(np.log(share / (1 - share)))
    a = np.column_stack([x, np.ones(len(x))])
    ridge = np.diag([penalty] * x.shape[1] + [1e-6])
    w = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w += step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fold: Column | None = None, rows: int = SAMPLE_ROWS) -> Model:
    """Learns terms and score on at most rows labelled documents.

    The score's slope is fitted on hits of terms that the other half of the sample
    chose, as a half's own terms fit it too well. Null ids and labels are left out; an
    id that labels repeat counts once, with its smallest label, and documents that
    share a labelled id all count.
    """
    prepare(docs.sparkSession)
    sample = label_sample(labels, id_col, label_col, fold, rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # the sample has a proven bound, so it is broadcast
    texts = written(texts.join(F.broadcast(sample), "id").withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "id"), F.lit(2)).cast("int")), "toxic-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {}
        for b in batches:
            for text, label, half in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), b.column("half").to_pylist(), strict=True):
                words = plain_words(text or "")
                terms = words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}
                seen.setdefault((half, label == 1), Counter()).update(terms)
        for (half, toxic), counts in seen.items():
            n = len(counts)
            yield pa.RecordBatch.from_pydict({"term": pa.array(counts.keys(), pa.string()), "half": pa.array([half] * n, pa.int32()), "toxic": pa.array([toxic] * n), "n": pa.array(counts.values(), pa.int64())})

    at = F.when
    counted = texts.mapInArrow(trimmed(count), "term string, half int, toxic boolean, n long")
    counted = counted.groupBy("term").agg(*(F.sum(at((F.col("half") == h) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"{k}{h}") for h in (0, 1) for k, t in (("toxic", True), ("clean", False))))
    counted = written(counted, "toxic-terms")
    strong = counted.where((F.col("toxic0") + F.col("toxic1") >= 3) & (F.col("toxic0") + F.col("toxic1") >= PRECISION * 0.5 * (F.col("clean0") + F.col("clean1") + F.col("toxic0") + F.col("toxic1")))).collect()
    held = {(r["half"], r["label"] == 1): r["count"] for r in texts.groupBy("half", "label").count().collect()}

    def chosen(halves: tuple[int, ...]) -> Automaton:
        found = [(r["term"], sum(r[f"toxic{h}"] for h in halves), sum(r[f"clean{h}"] for h in halves)) for r in strong]
        return choose_terms(sorted(found), *(sum(held.get((h, t), 0) for h in halves) for t in (True, False)))

    machines = [chosen((1,)), chosen((0,)), chosen((0, 1))]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [w for w in b.column("term").to_pylist() if not w.endswith("*")]
            points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            close = np.zeros(len(words), bool)
            for m in machines:
                close |= m.near[m.walk(m.letters[points], np.cumsum(lengths) - lengths, lengths)]
            yield pa.RecordBatch.from_pydict({"term": pa.array([words[i] for i in np.flatnonzero(close)], pa.string())})

    # a near miss that more clean documents than toxic ones hold is an ordinary word
    used = counted.where(F.col("clean0") + F.col("clean1") > F.col("toxic0") + F.col("toxic1")).select("term").mapInArrow(trimmed(near), "term string")
    ordinary = frozenset(r["term"] for r in used.collect())
    for m in machines:
        m.ordinary = ordinary

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, half = b.column("text").to_pylist(), np.array(b.column("half").to_pylist(), np.int64)
            x = np.where((half == 0)[:, None], machines[0].features(text), machines[1].features(text)) if len(half) else np.zeros((0, 4))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), *map(pa.array, x.T)], names=["id", "label", "a", "b", "c", "d"])

    got = texts.mapInArrow(trimmed(measure), "id long, label int, a double, b double, c double, d double").toPandas().sort_values(["id", "a"])
    discard(texts, counted)
    return Model(machines[2], *logistic(got[["a", "b", "c", "d"]].to_numpy(), got["label"].to_numpy(np.float64)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every row's whole text.

    Null and empty texts score as texts without hits. Ids pass as they are, repeated
    rows are scored each, other columns are not read.
    """
    prepare(docs.sparkSession)
    key = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(model.score(b.column("text").to_pylist()))], schema=schema)

    return key.mapInArrow(trimmed(run), "id long, score double").withColumnRenamed("id", id_col)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = id_remainder(F.col("doc_id"), 5) == 0
    scored = score(docs, train(docs, labels, fold=~held))
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
