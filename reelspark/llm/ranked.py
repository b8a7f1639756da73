"""Ranked lexical search: document FP-trees searched by depth-first branch and bound.

Terms are the words of ASCII lower-cased texts (``words.ALNUM``). With N documents that have a
term, L terms in all, df documents with a term, n terms in a document and tf of them the term:

    w = floor(1000 * ln((2N + 2) / (2 df + 1)))        m = 50 + (50 * n * N) div L
    score = sum over the item's terms of w * ((10^9 * tf) div (1000 * tf + 20 * m))

Three passes over Spark's partitions:

1. Each text becomes its term vector, restricted to the terms of the items, with n; the vectors
   are written to the shared folder, the texts aren't read again.
2. N, L and df are counted from the vectors (counts per task, then a sum per term).
3. A task takes its vectors by batches. In a batch each vector's terms are put in order of
   descending df and the vectors are sorted, which makes them the paths of an FP-tree: vectors that
   begin with the same frequent terms share a path. A node stands for a branch (paths without
   one are one node) and holds its subtree's greatest tf of each term and smallest m; small
   subtrees are leaves. As an item's score grows with tf and falls with m, these give a bound of
   all scores below a node. For each item, the search goes depth first, best bound first, skips
   subtrees whose bound is below the item's k-th best score so far (kept from batch to batch),
   and scores the documents of the leaves it reaches exactly, in 64-bit integers. The scores to
   start from are those of a search among about FIRST_DOCUMENTS documents: lower limits of the
   k-th best of all, so they skip work and no result.

A task emits at most its k best documents of each item; the final order
is taken in two steps, first among a few tasks each. Items are taken in blocks of bounded
text (ITEM_BYTES); only a block's terms and weights are broadcast.

Defined results: texts that are null or without a term have no score and count nowhere. Equal
scores go by ascending doc_id, documents without doc_id after the others; rows that repeat are ranked
each. Rows of ``items`` with one item_id (null included) are one item, with the terms of all; an
item without terms, or whose terms no document has, gives no rows. Empty tables give an empty one.
64-bit hashes stand for terms.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import apply_runtime_conf
from .components import pick, written
from .words import batches

ITEM_BYTES = 1 << 20
LEAF = 16
CELLS = 1 << 23            # of the tables of greatest tf of one tree
TASKS_TOGETHER = 64
FIRST_DOCUMENTS = 10_000
LAST = np.iinfo(np.int64).max


@dataclass
class Items:
    """The items of a block: ids, all their terms' hashes (sorted), and each item's terms as
    places in that list."""
    ids: list
    terms: np.ndarray
    of_item: list[np.ndarray]


def read_items(items: DataFrame) -> Items:
    """A block of items, on the driver."""
    found: dict[object, list[np.ndarray]] = {}
    for row in items.collect():
        for _, _, words in batches(pa.array([row["text"]], pa.string()), "alnum", lower=True):
            found.setdefault(row["item_id"], []).append(words.hashes)
    own = {i: np.unique(np.concatenate(h)) for i, h in found.items()}
    ids = [i for i, h in own.items() if len(h)]
    terms = np.unique(np.concatenate([own[i] for i in ids])) if ids else np.empty(0, np.uint64)
    return Items(ids, terms, [np.searchsorted(terms, own[i]) for i in ids])


VECTORS = "doc_id long, n long, terms binary, tfs binary"


def restricted(spark: SparkSession, docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n, terms, tfs): the number of terms of each text that has any,
    and of the given terms (sorted hashes) those that it holds, as places in the list, with tf."""
    shared = spark.sparkContext.broadcast(terms)

    def restrict(rows):
        known = shared.value
        for batch in rows:
            keep, n, places, counts = [], [], [], []
            for a, b, words in batches(batch.column("text"), "alnum", lower=True):
                size = np.diff(words.bounds)
                at = np.minimum(np.searchsorted(known, words.hashes), max(len(known) - 1, 0))
                hit = known[at] == words.hashes if len(known) else np.zeros(len(words), bool)
                both, tf = np.unique(words.docs_of_words()[hit] * max(len(known), 1) + at[hit], return_counts=True)
                cut = np.searchsorted(both, np.arange(b - a + 1) * max(len(known), 1))
                place, tf = (both % max(len(known), 1)).astype("<u4").tobytes(), tf.astype("<u4").tobytes()
                for d in np.flatnonzero(size).tolist():
                    keep.append(a + d)
                    n.append(int(size[d]))
                    places.append(place[4 * cut[d]:4 * cut[d + 1]])
                    counts.append(tf[4 * cut[d]:4 * cut[d + 1]])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").take(pa.array(keep, pa.int64())), "n": pa.array(n, pa.int64()),
                "terms": pa.array(places, pa.binary()), "tfs": pa.array(counts, pa.binary())})

    return docs.mapInArrow(restrict, VECTORS)


def document_counts(vectors: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each term: counts per task, then a sum per term."""

    def count(rows):
        total = np.zeros(n_terms, dtype=np.int64)
        for batch in rows:
            for held in batch.column("terms"):
                total[np.frombuffer(held.as_buffer(), "<u4")] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(at, pa.int64()), "df": pa.array(total[at], pa.int64())})

    out = np.zeros(n_terms, dtype=np.int64)
    for row in vectors.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[row["term"]] = row["df"]
    return out


class Tree:
    """The FP-tree of a batch of vectors.

    ``ranks`` and ``tfs`` hold the documents' paths one after another (``offsets``), sorted.
    Node x covers the documents ``low[x]:high[x]``; ``children[x]`` is empty for a leaf."""

    def __init__(self, ranks: list[np.ndarray], tfs: list[np.ndarray], m: np.ndarray, ids: np.ndarray,
                 n_terms: int, leaf: int = LEAF, cells: int = CELLS):
        paths = []
        for rank, tf in zip(ranks, tfs):
            order = np.argsort(rank)
            paths.append((rank[order].astype(">u4").tobytes(), tf[order]))
        order = sorted(range(len(paths)), key=lambda d: paths[d][0])
        self.ranks = np.frombuffer(b"".join([paths[d][0] for d in order]), ">u4").astype(np.int64)
        self.tfs = np.concatenate([paths[d][1] for d in order]).astype(np.int64)
        size = np.array([len(paths[d][1]) for d in order], dtype=np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(size)))
        self.m, self.ids = m[order], ids[order]
        #: what each entry adds to a score, but for the weight
        self.adds = (1_000_000_000 * self.tfs) // (1000 * self.tfs + 20 * np.repeat(self.m, size))
        self._branch(self._shared(size), leaf, max(1, cells // max(n_terms, 1)))
        self._bounds(n_terms)

    def _shared(self, size: np.ndarray) -> np.ndarray:
        """Number of first terms that each path shares with the path before it."""
        depth = np.arange(len(self.ranks)) - np.repeat(self.offsets[:-1], size)
        before = np.repeat(np.concatenate(([0], self.offsets[:-2])), size) + depth
        there = depth < np.repeat(np.concatenate(([0], size[:-1])), size)
        same = there & (self.ranks[np.minimum(before, len(self.ranks) - 1)] == self.ranks)
        return np.minimum.reduceat(np.where(same, size.max(), depth), self.offsets[:-1])

    def _branch(self, shared: np.ndarray, leaf: int, most: int) -> None:
        """Splits the greatest subtrees first, until all are small or ``most`` nodes are there."""
        self.low, self.high, self.children = [0], [len(shared)], [[]]
        waiting = [0]
        while waiting and len(self.low) < most:
            later = []
            for x in waiting:
                a, b = self.low[x], self.high[x]
                if b - a <= leaf or len(self.low) >= most:
                    continue
                inside = shared[a + 1:b]
                cuts = (np.flatnonzero(inside == inside.min()) + a + 1).tolist()
                start = a
                for i, cut in enumerate([*cuts, b]):
                    # neighbouring small branches are one leaf
                    after = cuts[i + 1] if i + 1 < len(cuts) else b
                    if cut < b and after - start <= leaf:
                        continue
                    self.children[x].append(len(self.low))
                    later.append(len(self.low))
                    self.low.append(start)
                    self.high.append(cut)
                    self.children.append([])
                    start = cut
            waiting = sorted(later, key=lambda y: self.low[y] - self.high[y])

    def _bounds(self, n_terms: int) -> None:
        """Greatest tf of each term and smallest m below each node, from the leaves up."""
        self.greatest = np.zeros((len(self.low), n_terms), dtype=np.int32)
        self.least = np.zeros(len(self.low), dtype=np.int64)
        for x in range(len(self.low) - 1, -1, -1):
            row, a, b = self.greatest[x], self.low[x], self.high[x]
            if self.children[x]:
                for y in self.children[x]:
                    np.maximum(row, self.greatest[y], out=row)
            else:
                part = slice(self.offsets[a], self.offsets[b])
                np.maximum.at(row, self.ranks[part], np.minimum(self.tfs[part], np.iinfo(np.int32).max).astype(np.int32))
            self.least[x] = self.m[a:b].min()

    def bounds(self, ranks: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """No document below a node scores higher for these terms."""
        tf = self.greatest[:, ranks].astype(np.int64)
        return ((1_000_000_000 * tf) // (1000 * tf + 20 * self.least[:, None]) * weights).sum(axis=1)

    def scores(self, a: int, b: int, weight_of: np.ndarray) -> np.ndarray:
        """Exact scores of the documents a:b, with a weight for each rank."""
        part = slice(self.offsets[a], self.offsets[b])
        return np.add.reduceat(weight_of.take(self.ranks[part]) * self.adds[part], self.offsets[a:b] - self.offsets[a])


@dataclass
class Best:
    """The k best documents of an item so far: scores and doc_ids."""
    k: int
    limit: int = 1              # a lower score can't enter
    scores: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if scores.max() < self.limit:
            return
        fit = scores >= self.limit
        scores, ids = np.concatenate((self.scores, scores[fit])), np.concatenate((self.ids, ids[fit]))
        order = np.lexsort((ids, -scores))[:self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.limit = int(self.scores[-1])


def search(tree: Tree, ranks: np.ndarray, weights: np.ndarray, weight_of: np.ndarray, best: Best) -> int:
    """Depth-first branch and bound for one item; returns the number of documents scored."""
    bound = tree.bounds(ranks, weights)
    stack, scored = [0], 0
    while stack:
        x = stack.pop()
        if bound[x] < best.limit:
            continue
        if tree.children[x]:
            stack += sorted(tree.children[x], key=bound.__getitem__)
        else:
            a, b = tree.low[x], tree.high[x]
            best.add(tree.scores(a, b, weight_of), tree.ids[a:b])
            scored += b - a
    return scored


def _weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(f) + 1))) for f in df], dtype=np.int64)


def _block(spark: SparkSession, docs: DataFrame, items: Items, k: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of each task for each item of a block."""
    vectors = written(spark, restricted(spark, docs, items.terms), "ranked-vectors")
    totals = vectors.agg(F.count("*").alias("N"), F.sum("n").alias("L")).first()
    n_docs, n_all = totals["N"], totals["L"] or 1
    df = document_counts(vectors, len(items.terms))
    rank_of = np.empty(len(df), dtype=np.int64)                 # ranks by descending df
    rank_of[np.argsort(-df, kind="stable")] = np.arange(len(df))
    weights = _weights(n_docs, df)
    asked = [(rank_of[t[df[t] > 0]], weights[t[df[t] > 0]]) for t in items.of_item]
    held = vectors.where("octet_length(terms) > 0")
    # the k-th best scores of some documents are limits that every task can start from
    share = min(1.0, FIRST_DOCUMENTS / max(n_docs, 1))
    place = F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    limits = [1] * len(asked)
    for row in _last(_searched(spark, held.where(place < share), rank_of, asked, limits, n_docs, n_all, k), k).collect():
        limits[row["item"]] = row["score"]
    return _searched(spark, held, rank_of, asked, limits, n_docs, n_all, k)


def _best_first() -> list:
    return [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]


def _last(near: DataFrame, k: int) -> DataFrame:
    """(item, score) of the k-th best documents, of items that have so many."""
    r = F.row_number().over(Window.partitionBy("item").orderBy(*_best_first()))
    return near.withColumn("r", r).where(F.col("r") <= k).where(F.col("r") == k).select("item", "score")


def _searched(spark: SparkSession, vectors: DataFrame, rank_of: np.ndarray, asked: list, limits: list[int],
              n_docs: int, n_all: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of each task for each item."""
    shared = spark.sparkContext.broadcast((rank_of, asked, limits))

    def run(rows):
        rank, questions, least = shared.value
        best = [Best(k, limit) for limit in least]
        weight_of = np.zeros(len(rank), dtype=np.int64)
        for batch in rows:
            terms = [rank[np.frombuffer(x.as_buffer(), "<u4")] for x in batch.column("terms")]
            tfs = [np.frombuffer(x.as_buffer(), "<u4") for x in batch.column("tfs")]
            if not terms:
                continue
            m = 50 + (50 * batch.column("n").to_numpy() * n_docs) // n_all
            ids = batch.column("doc_id").fill_null(LAST).to_numpy()
            tree = Tree(terms, tfs, m, ids, len(rank))
            for (own, w), top in zip(questions, best):
                if len(own):
                    weight_of[own] = w
                    search(tree, own, w, weight_of, top)
                    weight_of[own] = 0
        ids = np.concatenate([b.ids for b in best]) if best else np.empty(0, np.int64)
        yield pa.RecordBatch.from_pydict({
            "item": pa.array(np.repeat(np.arange(len(best)), [len(b.ids) for b in best]), pa.int64()),
            "doc_id": pa.array(ids, mask=ids == LAST),
            "score": pa.array(np.concatenate([b.scores for b in best]) if best else [], pa.int64())})

    return vectors.mapInArrow(run, "item long, doc_id long, score long")


def rank_documents(spark: SparkSession, documents: DataFrame, items: DataFrame, k: int = 50,
                   item_bytes: int = ITEM_BYTES) -> DataFrame:
    """documents(doc_id, text), items(item_id, text) -> (item_id, rank, doc_id, score): each item's k
    documents with the highest scores above 0."""
    apply_runtime_conf(spark)
    docs = pick(documents, doc_id="long", text="string")
    id_type = items.schema["item_id"].dataType
    asked = pick(items, item_id=id_type.simpleString(), text="string").where("text IS NOT NULL")
    size = asked.agg(F.sum(F.octet_length("text") + 8).alias("bytes")).first()["bytes"] or 0
    blocks = max(1, math.ceil(size / item_bytes))
    out = None
    for b in range(blocks):
        held = read_items(asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else asked)
        names = spark.createDataFrame([(i, x) for i, x in enumerate(held.ids)], f"item long, item_id {id_type.simpleString()}")
        near = _block(spark, docs, held, k).withColumn("part", F.floor(F.spark_partition_id() / TASKS_TOGETHER))
        some = near.withColumn("r", F.row_number().over(Window.partitionBy("item", "part").orderBy(*_best_first()))).where(F.col("r") <= k)
        top = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*_best_first()))).where(F.col("rank") <= k)
        ranked = top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.unionByName(ranked)
    return out
