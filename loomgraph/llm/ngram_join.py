"""N-gram Jaccard self-join by T-occurrence search (DivideSkip), and its components.

A document is the set of its 5-word shingles, as 64-bit hashes.  Documents with one
set are one node, so that copies cost nothing further.  A node's sketch is its SKETCH
smallest hashes; nodes of similarity 0.8 share most of it.  Under an order that puts
shingles of many nodes (boilerplate) last, a node's first hashes are its keys, and
nodes that share a key form a block:

1. in each block every node's sketch is held against one pivot's, a number of pairs
   linear in the blocks; nodes whose sketches overlap enough become a cluster;
2. blocks that still hold several clusters are searched: inverted lists of the
   sketches, the short ones merged on a heap, the long ones probed by binary search,
   give the nodes that occur often enough; a block yields a spanning forest at most;
3. each cluster's full sets, sent once, are searched in the same way for links, and
   the forest of links gives the components.

A group of more than PART nodes is searched in pieces.  Some nodes of it, the hubs, go
to every piece, so that pieces are tied through them; after that only the nodes that
are apart from the group's largest part are held against its pieces, those of sizes that
a link allows.  Blocks with the same nodes are searched once.  A search stops as soon as
all that is left belongs together.

So every link lies within a cluster, while no step emits the pairs of a group.  Sets
of up to SKETCH shingles are their own sketch and are treated exactly.  For larger
ones a pair of similarity 0.8 or more shares no key, or too little of its sketch, with
a chance below 5e-9, as a hash collision has its chance; no cap drops a candidate.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from math import log, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.arrays import Words, flat, mix, slices, trimmed, windows
from loomgraph.llm.components import connected_components
from loomgraph.llm.session import discard, free_name, prepare, release, with_common, written

N = 5
#: Similarity from which documents link, in hundredths.
LINKED = 80
SKETCH, KEYS, HOT_KEYS = 64, 24, 16
#: Least overlap of two sketches: 64 draws that each agree with a chance of 0.8 or more give fewer with one of 4.4e-9 at most.
OVERLAP = 31
#: Shingles in more sketches than this come last in the order; doubled until the list of them fits its bound.
HOT = 64
HOT_LIST = 500_000
#: Nodes whose sketch is cold to a smaller share get keys among hot shingles too.
COLD_SHARE = 0.6
#: Groups are searched in pieces of about so many nodes, each with about so many hubs of a larger group.
PART, HUBS = 256, 32
#: Sizes of sets in a band differ by less than this factor, which is above 100 / LINKED, so that links lead one band away at most.
BAND = 1.26
#: Ids that are sent to executors to pick texts; more are joined by a shuffle.
PICKED = 500_000
LAST_ID = 2**63 - 1


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int = N) -> Iterator[np.ndarray]:
    """Each document's distinct shingle hashes in rising order; with fewer words the sequence is one."""
    words = Words(raw, offsets)
    h = words.hashes(lower=True)
    grams, first = windows(h, words.offsets, n)
    grams = grams.view(np.int64)
    at = np.searchsorted(first, words.offsets)
    for d, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if a < b:
            yield np.unique(grams[a:b])
            continue
        x, y = words.offsets[d], words.offsets[d + 1]
        if x == y:
            yield grams[:0]
            continue
        whole = np.full(1, y - x, np.uint64)
        for w in h[x:y]:
            whole = mix(whole * np.uint64(0x9FB21C651E98DF25) + w)
        yield whole.view(np.int64)


def node_of(shingles: np.ndarray) -> bytes | None:
    """128-bit digest of a set; none for the empty set."""
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def _signed(docs: DataFrame, id_col: str, text_col: str, full: bool) -> DataFrame:
    """(id, node, n, tokens): the whole set with full, else the sketch."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = pa.schema([("id", pa.int64()), ("node", pa.binary()), ("n", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = flat(b.column("text"))
            for i, j in slices(offsets):
                sets = list(shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                held = sets if full else [s[:SKETCH] for s in sets]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, held)]).astype(np.int32)), pa.array(np.concatenate(held)))
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), pa.array(map(node_of, sets), pa.binary()), pa.array([len(s) for s in sets], pa.int64()), lists], schema=schema)

    return rows.mapInArrow(trimmed(run), "id long, node binary, n long, tokens array<long>")


def needed(n: Column) -> Column:
    """Sketch overlap that a link of a set of n shingles needs."""
    return F.least(F.lit(OVERLAP), F.ceil(n * LINKED / 100.0)).cast("int")


def occurrences(members: list[int], spans: list[tuple[int, int]], least: int, wanted: Callable[[int], bool] | None = None, mu: float = 0.0085) -> Iterator[tuple[int, int]]:
    """(member, lists) of what stands in at least least of the sorted lists members[a:b], in order.

    The longest lists are set aside, as many as the bound allows. The heads of the
    others meet on a heap; where too few agree, lists skip to the first head that can
    still reach the bound. What they hold often enough, and is wanted, is looked up in
    the long lists for as long as it can still reach the bound.
    """
    if least <= 0 or len(spans) < least:
        return
    spans = sorted(spans, key=lambda s: s[1] - s[0])
    aside = min(least - 1, int(least / (mu * log2(spans[-1][1] - spans[-1][0] + 1) + 1)))
    short, long = (spans[:-aside], spans[-aside:]) if aside else (spans, [])
    need = least - aside
    heap = [(members[a], k, a) for k, (a, b) in enumerate(short) if a < b]
    heapify(heap)
    while len(heap) >= need:
        member, taken = heap[0][0], []
        while heap and heap[0][0] == member:
            taken.append(heappop(heap))
        if len(taken) >= need:
            count = len(taken)
            if wanted is None or wanted(member):
                for left, (a, b) in zip(range(len(long), 0, -1), long, strict=True):
                    if count + left < least:
                        break
                    at = bisect_left(members, member, a, b)
                    count += at < b and members[at] == member
                if count >= least:
                    yield member, count
            floor = member + 1
        else:
            while heap and len(taken) < need - 1:
                taken.append(heappop(heap))
            if not heap:
                return
            floor = max(heap[0][0], member + 1)
        for _, k, a in taken:
            at = a + 1 if a + 1 < short[k][1] and members[a + 1] >= floor else bisect_left(members, floor, a + 1, short[k][1])
            if at < short[k][1]:
                heappush(heap, (members[at], k, at))


def divide_skip(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of at least least of the sorted lists, and of how many."""
    ends = np.cumsum([len(x) for x in lists])
    members = np.concatenate([np.zeros(0, np.int64), *lists]).tolist()
    found = list(occurrences(members, [(int(b) - len(x), int(b)) for x, b in zip(lists, ends, strict=True)], least))
    return np.array([m for m, _ in found], np.int64), np.array([n for _, n in found], np.int64)


def search(sizes: np.ndarray, groups: np.ndarray, tokens: list[np.ndarray], exact: bool, first: int = 1) -> Iterator[tuple[int, int]]:
    """A spanning forest (earlier, later) of what ties groups of a block together, between nodes from first on and all before each.

    Tied are nodes whose token lists overlap enough; with exact these are whole sets,
    and the overlap must make a link. Members of a group, and of groups tied already,
    are not held against each other.
    """
    root = np.unique(groups, return_inverse=True)[1]
    if len(tokens) < 2 or (root == root[0]).all():
        return
    lengths = np.array([len(t) for t in tokens])
    flat_tokens, owner = np.concatenate(tokens), np.repeat(np.arange(len(tokens)), lengths)
    order = np.lexsort((owner, flat_tokens))
    by_token, members = flat_tokens[order], owner[order].tolist()
    new = np.ones(len(by_token), bool)
    new[1:] = by_token[1:] != by_token[:-1]
    start = np.flatnonzero(new)[np.cumsum(new) - 1]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    ends = np.cumsum(lengths)
    for i in range(max(first, 1), len(tokens)):
        if (root[:i] == root[i]).all():
            continue
        # an overlap for the smaller of both sets; what the larger one needs is looked at below
        need = -(-int(sizes[i]) * LINKED // 100)
        least = need if exact else min(OVERLAP, need)
        mine = place[ends[i] - lengths[i] : ends[i]]
        # within a token's list the earlier members stand before this one
        some = mine > start[mine]
        spans = list(zip(start[mine][some].tolist(), mine[some].tolist(), strict=True))

        def apart(m: int, i: int = i) -> bool:
            return root[m] != root[i] and sizes[m] * 100 >= sizes[i] * LINKED and sizes[i] * 100 >= sizes[m] * LINKED

        for j, common in occurrences(members, spans, least, apart):
            if not exact or common * 100 >= (sizes[j] + sizes[i] - common) * LINKED:
                root[root == root[j]] = root[i]
                yield j, i
                if (root[:i] == root[i]).all():
                    break


def _keys(nodes: DataFrame, hot: np.ndarray) -> DataFrame:
    """(key, node, n): the keys of each node; hot is the sorted list of shingles that come last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, at = [], []
            sketches = b.column("tokens")
            values, offsets = np.asarray(sketches.flatten()), np.asarray(sketches.offsets) - sketches.offsets[0].as_py()
            place = np.minimum(np.searchsorted(hot, values), max(len(hot) - 1, 0))
            warm = hot[place] == values if len(hot) else np.zeros(len(values), bool)
            for r, (x, y, n) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), b.column("n").to_pylist(), strict=True)):
                cold, late = values[x:y][~warm[x:y]], values[x:y][warm[x:y]]
                if n <= SKETCH:
                    mine = np.concatenate([cold, late])[: n - -(-n * LINKED // 100) + 1]
                else:
                    mine = cold[:KEYS]
                    if len(cold) < COLD_SHARE * (y - x):
                        mine = np.concatenate([mine, late[:HOT_KEYS]])
                keys.append(mine)
                at.append(np.full(len(mine), r))
            take = pa.array(np.concatenate([np.zeros(0, np.int64), *at]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *keys]).astype(np.int64)), b.column("node").take(take), b.column("n").take(take)], names=["key", "node", "n"])

    return nodes.select("node", "n", "tokens").mapInArrow(trimmed(run), "key long, node binary, n long")


def _hot(nodes: DataFrame) -> np.ndarray:
    """Shingles in more than HOT sketches, or in more than a multiple that keeps the list within its bound."""
    counts = written(nodes.select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") > HOT), "hot-shingles")
    limit = HOT
    while (found := counts.where(F.col("count") > limit)).count() > HOT_LIST:
        limit *= 2
    hot = np.sort(found.select("token").toPandas()["token"].to_numpy(np.int64))
    discard(counts)
    return hot


def _searched(blocks: DataFrame, exact: bool) -> DataFrame:
    """(a, b): what search finds in each part of (part, node, n, group, asks, tokens), between the nodes that ask and all others."""

    def found(rows: list) -> Iterator[tuple[bytes, bytes]]:
        rows.sort(key=lambda r: (r[3], r[1], r[0]))
        groups = np.unique([r[2] for r in rows], return_inverse=True)[1]
        for i, j in search(np.array([r[1] for r in rows], np.int64), groups, [r[4] for r in rows], exact, sum(not r[3] for r in rows)):
            yield rows[i][0], rows[j][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part, out = [], None, []

        def flushed() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*out, strict=True)], names=["a", "b"])
                out.clear()

        for b in batches:
            lists = b.column("tokens")
            values, offsets = np.asarray(lists.flatten()), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            for k, (p, node, n, group, asks) in enumerate(zip(*(b.column(c).to_pylist() for c in ("part", "node", "n", "group", "asks")), strict=True)):
                if p != part:
                    out += found(held) if len(held) > 1 else ()
                    held, part = [], p
                held.append((node, n, group, asks, values[offsets[k] : offsets[k + 1]].copy()))
            yield from flushed()
        out += found(held) if len(held) > 1 else ()
        yield from flushed()

    # a part is of bounded size, whole in one task and sorted together
    dealt = blocks.repartition(F.col("part")).sortWithinPartitions("part")
    return dealt.select("part", "node", "n", "group", "asks", "tokens").mapInArrow(trimmed(run), "a binary, b binary")


def _measured(members: DataFrame, key: str) -> DataFrame:
    """members of keys with several groups, with m, the key's nodes, alone, those outside its largest group, and asks, whether a node is one of them.

    Of keys with the same nodes, told by digests, one stays.
    """
    digests = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"x{k}") for k in range(2)]
    counts = members.groupBy(key, "group").agg(F.count(F.lit(1)).alias("count"), *digests)
    counts = counts.groupBy(key).agg(F.sum("count").alias("m"), F.max(F.struct("count", "group")).alias("top"), *(F.bit_xor(f"x{k}").alias(f"x{k}") for k in range(2)))
    counts = counts.where(F.col("m") > F.col("top.count")).groupBy("m", "x0", "x1").agg(F.min(F.struct(key, "top")).alias("one"))
    counts = counts.select(F.col(f"one.{key}").alias(key), F.col("m").alias("n"), "m", (F.col("m") - F.col("one.top.count")).alias("alone"), F.col("one.top.group").alias("top"))
    counts = written(counts, "ngram-sizes")
    met = with_common(members.withColumnRenamed("n", "size"), counts, key, PICKED).where(F.col("m").isNotNull())
    return met.withColumn("asks", F.col("group") != F.col("top")).withColumnRenamed("size", "n").drop("top")


def _thinned(star: DataFrame) -> DataFrame:
    """(a, b) links that tie what (pivot a, node b) ties: a node keeps one pivot, and its pivots are tied among themselves, each pair once."""
    pivots = star.groupBy("b").agg(F.array_sort(F.collect_set("a")).alias("all"))
    ends = F.transform("all", lambda a, k: F.struct(F.when(k == 0, F.col("b")).otherwise(a).alias("b"), F.col("all")[0].alias("a")))
    return pivots.select(F.explode(ends).alias("e")).select("e.a", "e.b").distinct()


def _with_hubs(members: DataFrame, key: str) -> DataFrame:
    """members with a part: pieces of a key, each with all its hubs; every node asks."""
    pieces, near = F.ceil(F.col("m") / PART).cast("int"), F.ceil(F.col("m") / HUBS).cast("int")
    hub = F.pmod(F.xxhash64(F.lit("hub"), "node"), near) == 0
    dealt = members.withColumn("piece", F.explode(F.when(hub, F.sequence(F.lit(0), pieces - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), pieces).cast("int")))))
    return dealt.withColumn("part", F.xxhash64(key, "piece")).withColumn("asks", F.lit(True)).drop("piece")


def _banded(members: DataFrame, key: str) -> DataFrame:
    """members with their band of sizes and ways, (at, pieces, slots) of the bands at most one away that hold nodes which some that ask may link with; others go.

    Sets that link lie at most one band apart. A band's slots take those that ask of it and of both bands beside it.
    """
    members = members.withColumn("band", F.floor(F.log("n") / log(BAND)).cast("int"))
    beside = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1))
    sizes = members.groupBy(key, "band").agg(F.count(F.lit(1)).alias("held"), F.count_if("asks").alias("asking")).withColumn("at", beside("band"))
    sizes = sizes.groupBy(key, "at").agg(F.sum(F.when(F.col("at") == F.col("band"), F.col("held")).otherwise(0)).alias("held"), F.sum("asking").alias("asking")).where("held > 0 AND asking > 0")
    way = F.struct("at", F.ceil(F.col("held") / PART).cast("int").alias("pieces"), F.ceil(F.col("asking") / PART).cast("int").alias("slots"))
    ways = sizes.withColumn("band", beside("at")).groupBy(key, "band").agg(F.collect_list(way).alias("ways"))
    return members.join(ways, [key, "band"])


def _parted(members: DataFrame, key: str) -> DataFrame:
    """members with a part: each piece of a key meets each piece of the nodes in it that ask and are near in size, so others go nowhere twice where few ask."""
    whole = members.where(F.col("m") <= PART).withColumn("part", F.xxhash64(key))
    slot = lambda w: F.pmod(F.xxhash64(F.lit("asks"), "node"), w["slots"]).cast("int")
    mine = lambda w: F.pmod(F.xxhash64("node"), w["pieces"]).cast("int")
    role = lambda w, piece, slot, asks: F.struct(w["at"].alias("at"), piece.alias("piece"), slot.alias("slot"), F.lit(asks).alias("asks"))
    own = F.filter("ways", lambda w: w["at"] == F.col("band"))
    told = F.flatten(F.transform(own, lambda w: F.transform(F.filter(F.sequence(F.lit(0), w["slots"] - 1), lambda k: ~F.col("asks") | (k != slot(w))), lambda k: role(w, mine(w), k, False))))
    asking = F.flatten(F.transform("ways", lambda w: F.transform(F.sequence(F.lit(0), w["pieces"] - 1), lambda k: role(w, k, slot(w), True))))
    dealt = _banded(members.where(F.col("m") > PART), key).withColumn("role", F.explode(F.when(F.col("asks"), F.concat(told, asking)).otherwise(told)))
    dealt = dealt.withColumn("part", F.xxhash64(key, "role.at", "role.piece", "role.slot")).withColumn("asks", F.col("role.asks"))
    return whole.unionByName(dealt.select(*whole.columns))


def _tied(members: DataFrame, key: str, tokens: DataFrame, exact: bool, known: DataFrame | None) -> tuple[DataFrame, list[DataFrame]]:
    """Labels and links (with the known ones) after the nodes of each key of (key, node, n) have been searched; members of a group are the nodes that known links tie."""

    def grouped(labels: DataFrame | None) -> DataFrame:
        if labels is None:
            return members.withColumn("group", F.col("node"))
        return members.join(labels.withColumnRenamed("component", "label"), "node", "left").select(key, "node", "n", F.coalesce("label", "node").alias("group"))

    def links(dealt: DataFrame) -> DataFrame:
        dealt = dealt.select("part", "node", "n", "group", "asks")
        dealt = F.broadcast(dealt) if dealt.count() <= PICKED else dealt
        return written(_searched(tokens.join(dealt, "node"), exact), "ngram-ties")

    held = [known] if known is not None else []
    labels = connected_components(known) if known is not None else None
    told = written(_measured(grouped(labels), key), "ngram-groups")
    crowded = told.where((F.col("m") > PART) & (F.col("alone") > PART))
    if crowded.limit(1).count():
        held.append(links(_with_hubs(crowded, key)))
        if labels is not None:
            discard(labels)
        labels = connected_components(_united(held))
        discard(told)
        told = written(_measured(grouped(labels), key), "ngram-groups")
    held.append(links(_parted(told, key)))
    discard(told, *([labels] if labels is not None else []))
    release(told.sparkSession)
    return connected_components(_united(held)), held


def _united(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _full_sets(picked: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, tokens) of the nodes in (node, rep), from the texts of their smallest ids."""
    ids = picked.select(F.coalesce("rep", F.lit(LAST_ID)).alias("rep")).distinct()
    few = picked.count() <= PICKED
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID)).alias("rep"))
    texts = texts.join(F.broadcast(ids) if few else ids, "rep", "left_semi")
    sets = _signed(texts, "id", "text", full=True).select("node", "tokens")
    # rows that repeat an id may give a set twice, which a search takes for one node
    return sets.join(F.broadcast(picked.select("node")) if few else picked.select("node"), "node", "left_semi")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, node, n_shingles, component of every row, component being the smallest id that links reach.

    Null and empty texts, and texts without a word, have an empty set and link with
    nothing. Rows that share an id are rows of their own, which links tie if their
    texts are alike. Null ids take part, but a component is named by another id if it
    has one. Other columns are not read; no rows give no rows.
    """
    prepare(docs.sparkSession)
    sketches = written(_signed(docs, id_col, text_col, full=False), "ngram-sketches")
    held = sketches.where(F.col("node").isNotNull())
    nodes = written(held.groupBy("node").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("tokens").alias("tokens")), "ngram-nodes")
    base = written(sketches.select("id", "node", "n"), "ngram-ids")
    discard(sketches)
    keys = written(_keys(nodes, _hot(nodes)), "ngram-keys")
    blocks = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("pivot")).where(F.col("m") > 1)
    members = written(keys.join(blocks, "key"), "ngram-members")
    discard(keys)
    release(docs.sparkSession)
    # overlaps are counted on half of each hash: a chance match can only add to what is searched
    light = nodes.select("node", "n", F.transform("tokens", lambda t: (t.bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)).cast("int")).alias("tokens"))
    # 1. each node of a block against its pivot
    star = members.where(F.col("node") != F.col("pivot")).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    one, two = (light.withColumnsRenamed({"node": k, "n": f"n_{k}", "tokens": f"t_{k}"}) for k in "ab")
    star = star.join(one, "a").join(two, "b").where(F.size(F.array_intersect("t_a", "t_b")) >= needed(F.greatest("n_a", "n_b")))
    star = written(_thinned(star.select("a", "b")), "ngram-star")
    release(docs.sparkSession)
    # 2. blocks that hold several clusters
    labels, held = _tied(members.select("key", "node", "n"), "key", light.select("node", "tokens"), exact=False, known=star)
    clusters = written(labels.withColumnRenamed("component", "cluster").join(nodes.select("node", "n", "rep"), "node"), "ngram-clusters")
    discard(members, labels, *held)
    # 3. links within clusters, on full sets
    sets = written(_full_sets(clusters.select("node", "rep"), docs, id_col, text_col), "ngram-full")
    labels, held = _tied(clusters.select("cluster", "node", "n"), "cluster", sets, exact=True, known=None)
    named = nodes.select("node", "rep").join(labels.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = written(named.join(named.groupBy("label").agg(F.min("rep").alias("component")), "label").select("node", "component"), "ngram-named")
    discard(clusters, sets, labels, nodes, *held)
    out = base.select("id", "node", F.col("n").alias("n_shingles")).join(named, "node", "left")
    return out.select(F.col("id").alias(id_col), "node", "n_shingles", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay when one of each component does, the one with the smallest id.

    Of rows that share that id too (repeated rows), and in components without any id,
    one stays. Rows with an empty set all stay. Columns are those of docs.
    """
    names, at = docs.columns, docs.columns.index(text_col)
    own, digest, least = (free_name(x, names) for x in ("__id", "__node", "__component"))
    found = written(components(docs, id_col, text_col).withColumnRenamed(id_col, own), "ngram-components")
    odd = written(found.groupBy(own).count().where((F.col("count") > 1) | F.col(own).isNull()).select(own), "ngram-odd-ids")
    gone = found.where(F.col(own) != F.col("component_id")).select(own).distinct()
    rows = docs.withColumn(own, F.col(f"`{id_col}`").cast("long"))
    plain = rows.where(F.col(own).isNotNull()).join(gone, own, "left_anti")
    columns = [F.col(f"`{c}`") for c in names]
    if not odd.limit(1).count():
        return plain.select(*columns)
    plain = plain.join(odd, own, "left_anti")
    # ids that are null or repeated: rows are told apart by their sets
    some = rows.where(F.col(own).isNull()).unionByName(rows.where(F.col(own).isNotNull()).join(odd, own, "left_semi"))
    inner = some.select(*(F.col(f"`{c}`").cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in names), own)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = flat(b.column(at))
            sets = [s for i, j in slices(offsets) for s in shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(map(node_of, sets), pa.binary())], names=[*names, own, digest])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields)
    marked = written(inner.mapInArrow(trimmed(mark), f"{fields}, {digest} binary"), "ngram-odd")
    named = found.where(F.col("node").isNotNull()).groupBy(F.col("node").alias(digest)).agg(F.min("component_id").alias(least))
    empty = marked.where(F.col(digest).isNull())
    kept = marked.join(named, digest).where(F.col(least).isNull() | F.col(own).eqNullSafe(F.col(least)))
    kept = kept.dropDuplicates([digest]).dropDuplicates([own, least])
    return plain.select(*columns).unionByName(empty.select(*columns)).unionByName(kept.select(*columns))


def op7_ngram_join(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
