"""URL filters: list rules first, then association rules that FP-growth mines from labelled URLs.

A URL is a set of tokens (domain, names before it, path segments, query keys, ending),
none of which repeats another.  Pages are labelled by their own text: the quality and
the toxicity model, both fitted on labelled documents and so on no page, tell which
pages are to be blocked.  The token sets of labelled pages with the label as one more
token are mined for frequent combinations; rules "tokens -> label" that pass support,
confidence and evidence and say more than their parts are held in an inverted index
under their rarest token.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import quality_classifier, toxicity
from loomgraph.llm.arrays import flat, slices, trimmed
from loomgraph.llm.labelled import features, id_remainder
from loomgraph.llm.session import discard, prepare, written
from loomgraph.llm.statistics import COLUMNS, all_arrays

#: Fixed values: (verdict, host, path) of the list.
LIST = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Least share of pages that hold a combination with its label.
MIN_SUPPORT = 0.005
#: Least confidence, as if both labels were equally common, and least log-likelihood ratio against chance.
MIN_CONFIDENCE, EVIDENCE = 0.6, 15.0
#: A page is to be blocked if its text scores below GOOD for quality or from TOXIC on for toxicity.
GOOD, TOXIC = 0.7, 0.5
#: Pages whose id leaves 0 are held out of mining.
FOLDS = 5
LABEL = "label="
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a URL; both empty for null and where "://" is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def list_rule(host: Column, path: Column, rules: tuple = LIST) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does.

    A rule fits its host and the hosts below it if the path starts with its path.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL, none for what another one says already; none without a host and path.

    The last two labels of the host are its domain. Labels before it count by
    themselves, hyphenated ones by their words; path segments that are numbers, with
    or without an ending, say nothing.
    """

    def marked(mark: str, values: Column) -> Column:
        return F.transform(values, lambda x: F.concat(F.lit(mark), x))

    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    domain = F.when(F.size(labels) > 0, F.array(F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."))).otherwise(F.array().cast("array<string>"))
    before = F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0)))
    words = F.filter(F.flatten(F.transform(before, lambda x: F.split(x, "-"))), lambda x: x != "")
    segments = F.filter(F.split(path, "/"), lambda x: (x != "") & ~x.rlike(r"^[0-9]+(\.[A-Za-z0-9]+)?$"))
    keys = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: x != "")
    ending = F.filter(F.array(F.regexp_extract(path, r"/[0-9]+\.([A-Za-z0-9]+)$", 1)), lambda x: x != "")
    parts = [
        marked("domain:", domain), marked("host:", words), marked("path:", segments),
        marked("key:", F.transform(keys, lambda x: F.split(x, "=")[0])), marked("end:", ending),
    ]
    return F.coalesce(F.array_distinct(F.concat(*parts)), F.array().cast("array<string>"))


def page_text(html: Column) -> Column:
    """What a page shows: no scripts, styles or tags."""
    bare = F.regexp_replace(F.coalesce(html.cast("string"), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return F.regexp_replace(bare, r"<[^>]*>", "\n")


def _judged(pages: DataFrame, url_col: str, rules: tuple) -> list[Column]:
    url = F.col(f"`{url_col}`").cast("string")
    host, path = host_and_path(url)
    host, path = F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))
    rule, verdict = list_rule(host, path, rules)
    return [url.alias("url"), host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("listed"), url_tokens(url, host, path).alias("tokens")]


def labelled_pages(pages: DataFrame, docs: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, tokens and verdict of every page, the verdict (block or allow) being that of models on its own text.

    The models are fitted on bounded samples of labelled documents, and every page is
    scored whole. A null html counts as empty; the list's rules have no part in this.
    """
    spark = prepare(pages.sparkSession)
    sent = spark.sparkContext.broadcast((quality_classifier.train(docs, labels), toxicity.train(docs, labels)))
    url = F.col(f"`{url_col}`").cast("string")
    host, path = host_and_path(url)
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), url_tokens(url, host, path).alias("tokens"), page_text(F.col(f"`{html_col}`")).alias("text"))
    schema = pa.schema([("id", pa.int64()), ("tokens", pa.list_(pa.string())), ("verdict", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, toxic = sent.value
        for b in batches:
            raw, offsets = flat(b.column("text"))
            block = toxic.score(b.column("text").to_pylist()) >= TOXIC
            for i, j in slices(offsets):
                stats = dict(zip(COLUMNS, all_arrays(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), strict=True))
                block[i:j] |= good.probability(features(stats)) < GOOD
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("tokens"), pa.array(np.where(block, "block", "allow"), pa.string())], schema=schema)

    return rows.mapInArrow(trimmed(run), "id long, tokens array<string>, verdict string")


def _alike(told: DataFrame, least: int) -> dict[str, str]:
    """Frequent tokens, each with the first of those that stand on exactly the same pages.

    There are at most (tokens of a page) / (least support) frequent tokens, which bounds
    what reaches the driver. Tokens of the same pages are one in mining, as every
    combination of them would be as frequent as each.
    """
    each = told.select("mark", F.explode("tokens").alias("token"))
    held = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("mark").cast("decimal(20,0)")).alias("of")).where(F.col("n") >= least)
    groups = held.groupBy("n", "of").agg(F.array_sort(F.collect_list("token")).alias("tokens")).select("tokens").collect()
    return {t: g["tokens"][0] for g in groups for t in g["tokens"]}


def mine(told: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, evidence: float = EVIDENCE) -> list[tuple[tuple[str, ...], str, float]]:
    """(tokens, verdict, confidence) of the pruned rules of (id, tokens, verdict), surest first.

    A rule's confidence is the share of its verdict among the pages that hold its
    tokens, with both verdicts weighed as if they were equally common. Rows without
    tokens or verdict say nothing; repeated rows count each. A rule goes if one with a
    token less is as sure of the same verdict. What is left is collected: how many
    rules there are depends on the least support, not on the number of pages.
    """
    told = written(told.where(F.col("verdict").isNotNull() & (F.size("tokens") > 0)).select("tokens", "verdict", F.xxhash64(F.monotonically_increasing_id()).alias("mark")), "url-told")
    total = {r["verdict"]: r["count"] for r in told.groupBy("verdict").count().collect()}
    n = sum(total.values())
    if len(total) < 2:
        discard(told)
        return []
    same = _alike(told, max(1, int(min_support * n)))

    def baskets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = [sorted({same[t] for t in tokens if t in same}) + [LABEL + v] for tokens, v in zip(b.column("tokens").to_pylist(), b.column("verdict").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.list_(pa.string()))], names=["items"])

    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=0.0).fit(told.mapInArrow(trimmed(baskets), "items array<string>"))
    rules = model.associationRules.where(F.element_at("consequent", 1).startswith(LABEL))
    counts = F.create_map(*(F.lit(x) for v, c in total.items() for x in (LABEL + v, c)))
    rules = rules.select(F.array_sort("antecedent").alias("tokens"), F.element_at("consequent", 1).alias("to"), F.round(F.col("support") * n).alias("a"), F.round(F.col("support") * n / F.col("confidence")).alias("m"))
    own, other = F.col("a") / counts[F.col("to")], (F.col("m") - F.col("a")) / (F.lit(n) - counts[F.col("to")])
    rules = written(rules.withColumn("sure", own / (own + other)).withColumn("of", counts[F.col("to")]), "url-rules")

    def term(x: Column, expected: Column) -> Column:
        return F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)

    a, m, of = F.col("a"), F.col("m"), F.col("of")
    ratio = 2 * (term(a, m * of / n) + term(m - a, m * (n - of) / n) + term(of - a, (n - m) * of / n) + term(n - m - of + a, (n - m) * (n - of) / n))
    strong = rules.where((F.col("sure") >= min_confidence) & (ratio >= evidence))
    parts = strong.select("tokens", "to", "sure", F.explode(F.transform("tokens", lambda x: F.array_remove("tokens", x))).alias("part"))
    surer = rules.select(F.col("tokens").alias("part"), "to", F.col("sure").alias("part_sure"))
    dull = parts.join(surer, ["part", "to"]).where(F.col("part_sure") >= F.col("sure")).select("tokens", "to").distinct()
    kept = strong.join(dull, ["tokens", "to"], "left_anti").select("tokens", "to", "sure").collect()
    discard(told, rules)
    # a token stands for those of the same pages, any of which a page may be asked for
    return sorted(((tuple(r["tokens"]), r["to"].removeprefix(LABEL), r["sure"]) for r in kept), key=lambda r: (-r[2], -len(r[0]), r[0], r[1]))


class RuleIndex:
    """Rules by their rarest token."""

    def __init__(self, rules: list[tuple[tuple[str, ...], str, float]]):
        often = Counter(t for tokens, _, _ in rules for t in tokens)
        self.by_token: dict[str, list] = defaultdict(list)
        for rank, (tokens, verdict, _) in enumerate(rules):
            self.by_token[min(tokens, key=lambda t: (often[t], t))].append((rank, frozenset(tokens), verdict))

    def verdict(self, tokens: list[str]) -> str:
        """That of the surest rule whose tokens are all there; allow without one."""
        held, best = set(tokens), None
        for t in tokens:
            for rank, need, verdict in self.by_token.get(t, ()):
                if need <= held and (best is None or rank < best[0]):
                    best = (rank, verdict)
        return best[1] if best else "allow"


def judge(pages: DataFrame, mined: list, id_col: str = "page_id", url_col: str = "url", rules: tuple = LIST) -> DataFrame:
    """id, host, path, rule, verdict of every row.

    A null URL, and one without "://", has neither host nor path and is allowed by
    default. Ids pass as they are, repeated rows are judged each, other columns are
    not read.
    """
    prepare(pages.sparkSession)
    index = RuleIndex(mined)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), *_judged(pages, url_col, rules)).drop("url")
    schema = pa.schema([("id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            listed, tokens = b.column("listed").to_pylist(), b.column("tokens").to_pylist()
            verdicts = [x or index.verdict(t) for x, t in zip(listed, tokens, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "host", "path", "rule")), pa.array(verdicts, pa.string())], schema=schema)

    return rows.mapInArrow(trimmed(run), "id long, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    pages, docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "documents", "labels"))
    told = labelled_pages(pages, docs, labels)
    return judge(pages, mine(told.where(F.coalesce(id_remainder(F.col("id"), FOLDS) != 0, F.lit(True)))))
