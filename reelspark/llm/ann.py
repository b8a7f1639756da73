"""Approximate nearest neighbours: low-dimensional stable projections in kd-trees.

Nearness is the largest inner product. A vector x of norm up to M gets one more component,
sqrt(M * M - |x| * |x|), and a query 0 there; then the nearest in Euclidean distance has the largest
inner product. A Gaussian (2-stable) projection to m dimensions turns a distance d into a
random one with (projected / d) ** 2 chi-square distributed with m degrees of freedom. So
candidates are taken in the order of their projected distance from a kd-tree over the
projections, verified on the original vectors, and the search stops when the next projected
distance r has r * r > c * d_k * d_k, for the k-th best distance d_k and the chi-square
quantile c of ``confidence``: a neighbour nearer than d_k lies beyond r with a chance of at
most 1 - confidence.

Spark job: an upper kd-tree, fitted to the projections of a bounded sample (``SAMPLE`` rows,
by hash of the id), deals all vectors into regions; a region of more than ``block_rows``
rows (also one of equal vectors) is split into blocks by hash. Each block is one kd-tree
in one task. A query first searches its own region, which gives a d_k, and then those other
regions that the stopping test, with the distance to the region's box, does not rule out.
Tables are dealt by block and streamed, so a task holds one block at a time.

Defined results: vectors that are null or zero, hold null or non-finite components, or
differ from the most common length take no part. Equal scores go to the smaller vec_id. With
fewer than k candidates all are returned. A query's own vec_id is no candidate. Rows that
repeat a vec_id with an equal vector count once. Null vec_ids take no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import apply_runtime_conf
from .components import pick, written

SAMPLE = 20_000
BLOCK_ROWS = 16_384
LEAF_ROWS = 64
SEED = 20240501


def chi_square_quantile(p: float, m: int) -> float:
    """x with P(chi-square of m degrees <= x) = p, for even m, by bisection."""
    if m % 2:
        raise ValueError("m must be even")

    def cdf(x):
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))

    lo, hi = 0.0, 1.0
    while cdf(hi) < p:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def projection(dim: int, m: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim + 1, m))


def project(x: np.ndarray, norm: float, a: np.ndarray) -> np.ndarray:
    """Projections of vectors with their extra component."""
    extra = np.sqrt(np.maximum(norm * norm - np.einsum("ij,ij->i", x, x), 0.0))
    return x @ a[:-1] + extra[:, None] * a[-1]


class Tree:
    """A kd-tree over points: leaves of about ``leaf`` rows, with their tight boxes."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.order = np.arange(len(points))
        bounds = [(0, len(points))]
        done = []
        while bounds:
            a, b = bounds.pop()
            if b - a <= leaf:
                done.append((a, b))
                continue
            part = points[self.order[a:b]]
            dim = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            half = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(part[:, dim], half)]
            bounds += [(a, a + half), (a + half, b)]
        done.sort()
        self.starts = np.array([a for a, _ in done])
        self.ends = np.array([b for _, b in done])
        ordered = points[self.order]
        self.low = np.minimum.reduceat(ordered, self.starts, axis=0)
        self.high = np.maximum.reduceat(ordered, self.starts, axis=0)

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distance from q to each leaf's box."""
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0.0)
        return np.einsum("ij,ij->i", gap, gap)


class Block:
    """The vectors of one block: verified leaf by leaf in projected order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm: float, a: np.ndarray, c: float):
        self.tree = Tree(project(vectors, norm, a), LEAF_ROWS)
        self.ids, self.vectors = ids[self.tree.order], vectors[self.tree.order]
        self.norm, self.c = norm, c

    def search(self, query_id: int, q: np.ndarray, projected: np.ndarray, k: int, bound: float):
        """(ids, scores) of the k best; ``bound``: a score that k others elsewhere reach."""
        far = self.tree.distances(projected)
        order = np.argsort(far, kind="stable")
        far = far[order]
        ids, scores = np.empty(0, dtype=np.int64), np.empty(0)
        at, step, square = 0, 8, float(q @ q)
        while at < len(order):
            least = max(bound, float(np.partition(scores, -k)[-k])) if len(scores) >= k else bound
            reach = np.inf if least == -np.inf else self.c * max(self.norm ** 2 + square - 2 * least, 0.0) + 1e-9
            end = min(at + step, int(np.searchsorted(far, reach, side="right")))
            if end <= at:
                break
            rows = np.concatenate([np.arange(self.tree.starts[l], self.tree.ends[l]) for l in order[at:end]])
            ids = np.concatenate((ids, self.ids[rows]))
            scores = np.concatenate((scores, np.einsum("ij,j->i", self.vectors[rows], q)))
            own = ids != query_id
            ids, scores = ids[own], scores[own]
            at, step = end, step * 2
        if len(scores) > k:
            near = scores >= np.partition(scores, -k)[-k]
            ids, scores = ids[near], scores[near]
        best = np.lexsort((ids, -scores))[:k]
        return ids[best], scores[best]


class Regions:
    """The upper kd-tree: splits of the projected space, fitted to a sample."""

    def __init__(self, sample: np.ndarray, depth: int):
        m = sample.shape[1]
        self.nodes: list[tuple[int, float, int, int]] = []      # dim, split, left, right
        self.low, self.high = [], []

        def grow(points, low, high, left):
            if left == 0 or len(points) < 2:
                self.low.append(low)
                self.high.append(high)
                return -len(self.low)
            dim = int(np.argmax(points.max(axis=0) - points.min(axis=0)))
            split = float(np.median(points[:, dim]))
            here = len(self.nodes)
            self.nodes.append((0, 0.0, 0, 0))
            up, down = high.copy(), low.copy()
            up[dim], down[dim] = split, split
            below = points[:, dim] < split
            a = grow(points[below], low, up, left - 1)
            b = grow(points[~below], down, high, left - 1)
            self.nodes[here] = (dim, split, a, b)
            return here

        grow(sample, np.full(m, -np.inf), np.full(m, np.inf), depth)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), dtype=np.int32)

        def walk(node, rows):
            if node < 0:
                out[rows] = -node - 1
            elif len(rows):
                dim, split, a, b = self.nodes[node]
                below = points[rows, dim] < split
                walk(a, rows[below])
                walk(b, rows[~below])

        if self.nodes:
            walk(0, np.arange(len(points)))
        return out

    def distances(self, q: np.ndarray) -> np.ndarray:
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0.0)
        return np.einsum("ij,ij->i", gap, gap)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, dim) if len(column) else np.empty((0, dim))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>) of the rows that take part, each vec_id's equal
    vectors once."""
    v = pick(vectors, vec_id="long", embedding="array<double>")
    good = v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
                   & F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
                   & F.exists("embedding", lambda x: x != 0))
    sizes = good.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    return good.where(F.size("embedding") == (sizes["n"] if sizes else 0)).dropDuplicates()


def nearest(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 20, m: int = 8,
            confidence: float = 0.98, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vectors(vec_id, embedding), queries(vec_id): ids of the rows that are queries ->
    (query_id, rank, vec_id, score)."""
    apply_runtime_conf(spark)
    out = "query_id long, rank int, vec_id long, score double"
    x = written(spark, usable(vectors), "ann-vectors")
    facts = x.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim"), F.max(F.sqrt(F.aggregate(
        "embedding", F.lit(0.0), lambda s, e: s + e * e))).alias("norm")).first()
    if not facts["n"]:
        return spark.createDataFrame([], out)
    dim, norm = facts["dim"], facts["norm"]
    a, c = projection(dim, m), chi_square_quantile(confidence, m)
    sample = np.array([r["embedding"] for r in x.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect()])
    depth = max(0, math.ceil(math.log2(facts["n"] / block_rows)))
    shared = spark.sparkContext.broadcast(Regions(project(sample, norm, a), depth))

    def place(rows):
        for batch in rows:
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id"), "region": pa.array(shared.value.of(project(flat, norm, a))),
                "vector": pa.array([v.tobytes() for v in flat.astype("<f8")], pa.binary())})

    placed = written(spark, x.mapInArrow(place, "vec_id long, region int, vector binary"), "ann-placed")
    sizes = (placed.groupBy("region").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("vec_id", "vector"), F.col("parts")).cast("int")
    data = placed.join(sizes, "region").select("region", part.alias("part"), F.lit(0).alias("kind"), "vec_id", "vector",
                                               F.lit(float("-inf")).alias("bound"))
    asked = placed.join(pick(queries, vec_id="long").distinct(), "vec_id", "left_semi")

    def search(rows):
        key, block, ids, held = None, None, [], []
        for batch in rows:
            matrix = _matrix(batch.column("vector"), dim)
            region, part_, kind, vec, bound = (batch.column(n).to_numpy() for n in ("region", "part", "kind", "vec_id", "bound"))
            new = np.flatnonzero((np.diff(region) != 0) | (np.diff(part_) != 0) | (np.diff(kind) != 0)) + 1
            for s, e in zip([0, *new.tolist()], [*new.tolist(), len(region)]):
                if s == e:
                    continue
                if key != (region[s], part_[s]):
                    key, block, ids, held = (region[s], part_[s]), None, [], []
                if kind[s] == 0:
                    ids.append(vec[s:e])
                    held.append(matrix[s:e])
                    continue
                if not held:
                    continue
                if block is None:
                    block = Block(np.concatenate(ids), np.concatenate(held), norm, a, c)
                asked_, found, scores = [], [], []
                near = matrix[s:e] @ a[:-1]
                for i in range(s, e):
                    n, w = block.search(int(vec[i]), matrix[i], near[i - s], k, float(bound[i]))
                    asked_.append(np.full(len(n), vec[i]))
                    found.append(n)
                    scores.append(w)
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.concatenate(asked_)),
                                                  "vec_id": pa.array(np.concatenate(found)), "score": pa.array(np.concatenate(scores))})

    def searched(sent: DataFrame) -> DataFrame:
        """sent(region, vec_id, vector, bound) against all blocks of their regions."""
        q = (sent.join(sizes, "region").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("region", "part", F.lit(1).alias("kind"), "vec_id", "vector", "bound"))
        # "kind" is not part of the key: a block's vectors come before its queries
        return (data.unionByName(q).repartition("region", "part").sortWithinPartitions("region", "part", "kind", "vec_id")
                .mapInArrow(search, "query_id long, vec_id long, score double"))

    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)

    first = written(spark, best(searched(asked.withColumn("bound", F.lit(float("-inf"))))), "ann-first")
    found = first.select("query_id", "vec_id", "score")
    if depth:
        kth = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))

        def route(rows):
            for batch in rows:
                matrix = _matrix(batch.column("vector"), dim)
                near, square = matrix @ a[:-1], np.einsum("ij,ij->i", matrix, matrix)
                home = batch.column("region").to_numpy()
                bound = batch.column("bound").to_numpy(zero_copy_only=False)
                take, region = [], []
                for i in range(len(matrix)):
                    reach = np.inf if np.isnan(bound[i]) or np.isinf(bound[i]) else c * max(norm ** 2 + square[i] - 2 * bound[i], 0.0) + 1e-9
                    for r in np.flatnonzero(shared.value.distances(near[i]) <= reach).tolist():
                        if r != home[i]:
                            take.append(i)
                            region.append(r)
                rows_ = batch.select(["vec_id", "vector", "bound"]).take(pa.array(take, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(region, pa.int32()), *rows_.columns], ["region", "vec_id", "vector", "bound"])

        sent = (asked.join(kth, "vec_id", "left").select("region", "vec_id", "vector", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))
                .mapInArrow(route, "region int, vec_id long, vector binary, bound double"))
        found = found.union(best(searched(sent)).select("query_id", "vec_id", "score"))
    return best(found).select("query_id", "rank", "vec_id", "score")
