"""Operator 11: ranked lexical search by branch and bound over a document FP-tree.

Only terms that some item asks for matter.  One pass over the texts counts each document's terms and keeps its
*restricted vector*: the asked terms it holds, with their counts, the most frequent term (by document frequency)
first.  Each task sorts the vectors of a block of its documents, so that vectors with equal beginnings share the path
of a trie; a path without a fork is one edge.  Every node knows the largest count of each term below it and the
smallest length norm m below it.  As a score rises with a count and falls with m, these bound the score of every
document below a node from above.  The search goes depth first and carries, for all items at once, which of them
still can win something below; an item leaves a subtree when its bound is under the item's 50th best score so far.
Documents with equal vectors and norms are one leaf entry, so large groups of copies cost one comparison.

A task keeps the best ``top`` documents of each item, and those lists are merged by windows over (item, share of the
tasks) and then over the item.  Nothing but integers decides, so the ranks do not depend on the partitioning.
"""

from __future__ import annotations

import heapq
import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MOST_PAIRS = 500_000        # (item, term) pairs searched in one pass; more items take more passes
DOCS, CELLS = 4096, 600_000  # documents and vector entries in one tree
NO_ID = 1 << 63             # stands for a null id: after all others

# every byte that ends a term becomes a blank, A-Z become a-z; bytes of non-ASCII characters stay
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    """The terms of a text: maximal runs of ASCII letters and digits and of all non-ASCII characters."""
    return text.encode().translate(_FOLD).split()


def gains(weight: np.ndarray, tf: np.ndarray, m) -> np.ndarray:
    """What terms add to a score."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


class Queries:
    """The items of one pass: weights by term, and for each term the items that ask for it.  Terms are numbered by
    falling document frequency."""

    def __init__(self, items: list[tuple], df: dict[bytes, int], n_docs: int):
        self.ids = [i for i, _ in items]
        asked = sorted({t for _, ts in items for t in ts if df.get(t)}, key=lambda t: (-df[t], t))
        self.number = {t: i for i, t in enumerate(asked)}
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in asked], dtype=np.int64)
        pairs = sorted((self.number[t], q) for q, (_, ts) in enumerate(items) for t in set(ts) if t in self.number)
        self.item = np.array([q for _, q in pairs], dtype=np.int64)
        self.first = np.searchsorted(np.array([t for t, _ in pairs], dtype=np.int64), np.arange(len(asked) + 1))

    def spread(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For terms ``at``: which entry and which item each of their pairs belongs to."""
        size = self.first[at + 1] - self.first[at]
        entry = np.repeat(np.arange(len(at)), size)
        inside = np.arange(len(entry)) - np.repeat(np.cumsum(size) - size, size)
        return entry, self.item[np.repeat(self.first[at], size) + inside]

    def add_up(self, pairs: tuple[np.ndarray, np.ndarray], gain: np.ndarray) -> np.ndarray:
        """Score by item.  Sums stay below 2**53, so doubles hold them exactly."""
        entry, item = pairs
        return np.bincount(item, gain[entry], minlength=len(self.ids)).astype(np.int64)


class Best:
    """The best ``top`` (score, id) of each item: higher scores, then smaller ids."""

    def __init__(self, n_items: int, top: int):
        self.top, self.heaps = top, [[] for _ in range(n_items)]
        self.least = np.ones(n_items, dtype=np.int64)       # a score below this cannot enter

    def offer(self, scores: np.ndarray, ids: list[int], items: np.ndarray) -> None:
        """``ids``, ascending, share their scores."""
        for q in items[scores[items] >= self.least[items]].tolist():
            heap, score = self.heaps[q], int(scores[q])
            for i in ids:
                if len(heap) < self.top:
                    heapq.heappush(heap, (score, -i))
                elif (score, -i) > heap[0]:
                    heapq.heapreplace(heap, (score, -i))
                else:
                    break
            if len(heap) == self.top:
                self.least[q] = heap[0][0]


class Node:
    """A trie node: the terms below it (ascending numbers) with their largest counts, the smallest norm below, and
    either children or, for documents with just these terms, {(counts, norm): smallest ids}."""

    __slots__ = ("depth", "at", "tf", "m", "children", "docs")

    def __init__(self, depth: int):
        self.depth, self.children, self.docs = depth, [], None

    def close(self) -> Node:
        """Sum up the children, all of them closed."""
        if self.docs is None:
            at, tf = np.concatenate([c.at for c in self.children]), np.concatenate([c.tf for c in self.children])
            order = np.argsort(at, kind="stable")
            at, tf = at[order], tf[order]
            start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            self.at, self.tf = at[start], np.maximum.reduceat(tf, start)
            self.m = min(c.m for c in self.children)
        return self


def leaf(at: np.ndarray, docs: dict[tuple[bytes, int], list[int]]) -> Node:
    node = Node(len(at))
    node.at, node.docs = at, docs
    node.tf = np.max([np.frombuffer(tf, np.int64) for tf, _ in docs], axis=0)
    node.m = min(m for _, m in docs)
    return node


def tree(docs: Iterator[tuple[int, int, np.ndarray, np.ndarray]], top: int) -> Node | None:
    """The FP-tree of documents (id, norm, term numbers ascending, counts).  Of equal documents the ``top`` smallest
    ids are kept, as no list can name more of them."""
    groups: dict[bytes, dict[tuple[bytes, int], list[int]]] = {}
    for i, m, at, tf in docs:
        ids = groups.setdefault(at.astype(">i4").tobytes(), {}).setdefault((tf.astype(np.int64).tobytes(), m), [])
        insort(ids, i)
        del ids[top:]
    open_ = [Node(0)]               # the forks of the rightmost path, the root first
    last, before = None, np.empty(0, np.int64)

    def hang(child: Node, depth: int) -> Node:
        """Hang the last subtree under the forks deeper than ``depth`` and close those."""
        while open_ and open_[-1].depth > depth:
            open_[-1].children.append(child)
            child = open_.pop().close()
        return child

    for path in sorted(groups):
        at = np.frombuffer(path, ">i4").astype(np.int64)
        if last is not None:
            n = min(len(at), len(before))
            differ = np.flatnonzero(at[:n] != before[:n])
            shared = int(differ[0]) if len(differ) else n
            child = hang(last, shared)
            if open_[-1].depth < shared:
                open_.append(Node(shared))
            open_[-1].children.append(child)
        last, before = leaf(at, groups[path]), at
    return hang(last, -1) if last is not None else None


def search(root: Node, queries: Queries, best: Best) -> int:
    """Offer every document that can enter a list; returns how many leaf entries were scored."""
    scored = 0
    stack = [(root, np.arange(len(queries.ids)))]
    while stack:
        node, items = stack.pop()
        pairs = queries.spread(node.at)
        weight = queries.weight[node.at]
        bound = queries.add_up(pairs, gains(weight, node.tf, node.m))[items]
        items = items[(bound >= best.least[items]) & (bound > 0)]
        if not len(items):
            continue
        if node.docs is None:
            stack += [(c, items) for c in node.children]
            continue
        for (tf, m), ids in node.docs.items():
            scores = queries.add_up(pairs, gains(weight, np.frombuffer(tf, np.int64), m))
            best.offer(scores, ids, items)
            scored += 1
    return scored


def rank(docs: DataFrame, items: DataFrame, top: int = 50, key: str = "doc_id", text: str = "text", item: str = "item_id",
         item_text: str = "text", most_pairs: int = MOST_PAIRS) -> DataFrame:
    """The ``top`` documents of each item with a score above 0: ``item``, rank (int, from 1), ``key``, score.

    Scores are as the module's users define them: a term counts floor(1000 ln((2N+2)/(2df+1))) times
    (10^9 tf) div (1000 tf + 20 m), m = 50 + (50 n N) div L, over an item's terms once each.  Equal scores go by
    ascending ``key`` (of integer type), null keys last.  Null and empty texts have no terms and never appear;
    repeated rows of either table are rows like others, each item row with its ranks; further columns are left out;
    if either table is empty the result is.
    """
    spark = docs.sparkSession
    scratch = common.Scratch(spark)
    key_type, item_field = docs.schema[key].dataType, items.schema[item]
    wanted = T.StructType([T.StructField("_item", item_field.dataType), T.StructField("terms", T.ArrayType(T.BinaryType())), T.StructField("row", T.LongType())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 40
        for b in batches:
            found = [sorted(set(terms(t))) for t in common.texts(b, "_text")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.binary())), pa.array(np.arange(n, n + len(found)))], names=wanted.names)
            n += len(found)

    asked = scratch.keep(items.select(F.col(item).alias("_item"), F.col(item_text).alias("_text")).mapInArrow(ask, wanted))
    pairs = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    passes = max(1, -(-pairs // most_pairs))
    base = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    out = None
    for p in range(passes):
        block = [(r["row"], r["_item"], [bytes(t) for t in r["terms"]]) for r in
                 asked.where(F.pmod(F.xxhash64("row"), F.lit(passes)) == p).orderBy("row").collect()]      # about most_pairs pairs
        found = _one_pass(base, block, top, scratch, item_field.dataType)
        out = found if out is None else out.unionByName(found)
    order = [F.desc("score"), F.asc_nulls_last("_key")]
    # each task's lists meet by shares of the tasks first, so that no group grows with the number of tasks alone
    for by in (["row", "share"], ["row"]):
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    return out.select(F.col("_item").alias(item), "rank", F.col("_key").cast(key_type).alias(key), "score")


def _one_pass(base: DataFrame, block: list[tuple], top: int, scratch: common.Scratch, item_type: T.DataType) -> DataFrame:
    """Each task's best documents for the items (row, id, terms) of ``block``."""
    vocabulary = sorted({t for _, _, ts in block for t in ts})
    number = {t: i for i, t in enumerate(vocabulary)}

    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.slices(whole, "_text"):
                size, at, tf = [], [], []
                for t in common.texts(b, "_text"):
                    found = terms(t)
                    held = Counter(map(number.get, found))
                    held.pop(None, None)
                    size.append(len(found))
                    at.append(list(held))
                    tf.append(list(held.values()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))],
                                                 names=["_key", "n", "at", "tf"])

    vectors = scratch.keep(base.mapInArrow(restrict, "_key long, n long, at array<int>, tf array<long>"))
    facts = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_docs, n_terms = int(facts[0]), int(facts[1])
    counts = vectors.select(F.explode("at").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()    # the block's vocabulary at most
    queries = Queries([(i, ts) for _, i, ts in block], {vocabulary[r["t"]]: r["df"] for r in counts}, n_docs)
    renumber = np.array([queries.number.get(t, -1) for t in vocabulary], dtype=np.int64)
    rows = [r for r, _, _ in block]
    shared = base.sparkSession.sparkContext.broadcast((queries, renumber))

    def best_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, renumber = shared.value
        best = Best(len(queries.ids), top)
        waiting: list[tuple] = []
        cells = 0
        for b in batches:
            keys, norm = b.column("_key").to_pylist(), b.column("n").to_numpy()
            norm = 50 + (50 * norm * n_docs) // max(1, n_terms)
            lists, tfs = b.column("at"), b.column("tf")
            ends = lists.offsets.to_numpy()
            at_all, tf_all = renumber[lists.values.to_numpy()], tfs.values.to_numpy()
            for i, k in enumerate(keys):
                lo, hi = ends[i], ends[i + 1]
                if lo == hi:
                    continue
                order = np.argsort(at_all[lo:hi])
                waiting.append((NO_ID if k is None else k, int(norm[i]), at_all[lo:hi][order], tf_all[lo:hi][order]))
                cells += hi - lo
                if len(waiting) >= DOCS or cells >= CELLS:
                    search(tree(waiting, top), queries, best)
                    waiting, cells = [], 0
        if waiting:
            search(tree(waiting, top), queries, best)
        part = TaskContext.get().partitionId() % 64
        out = [(rows[q], queries.ids[q], None if -i == NO_ID else -i, score, part) for q, heap in enumerate(best.heaps) for score, i in heap]
        if out:
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["row", "_item", "_key", "score", "share"])

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [pa.int64(), to_arrow_type(item_type), pa.int64(), pa.int64(), pa.int32()]
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("_item", item_type), T.StructField("_key", T.LongType()),
                           T.StructField("score", T.LongType()), T.StructField("share", T.IntegerType())])
    return vectors.mapInArrow(best_of_task, schema)
