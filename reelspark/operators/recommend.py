"""Hybrid recommendation for many profiles at once.

Input: ``profiles(profile_id, movieId, pos, role)`` with role seed / like / dislike, and the
item table ``(movieId, content, factor)`` of the movies the model covers.

Scoring every item for every profile is a dense product, cut into a grid of profile blocks ×
item blocks of bounded size. Items are dealt to the cells of their column and profiles to those
of their row by one shuffle (no item passes the driver); a task holds the item block of a cell,
multiplies batches of its profiles with it in numpy and emits only the top ``pool_limit`` items
per profile, never the full profile × item product. Exclusions, the global pool cut over the
blocks and the per-profile ranking are then ordinary Spark operators.

The score is linear in an item's unit vectors but for likes and dislikes themselves, so that one
product in single precision gives every score to within a known error. The items that can be
among the best by that error are then scored in double precision: the results are those
of a product in double precision.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules as R
from ..functions.arrow import whole_groups
from ..functions.columns import jaccard

ITEM_BLOCK_BYTES = 128 * 1024 * 1024
PROFILE_BLOCK = 2048
PROFILE_BATCH = 256
PAIRS_AT_ONCE = 1 << 15


@dataclass(frozen=True)
class RecParams:
    top_k: int = 10
    diversity: float = R.DIVERSITY_DEFAULT
    content_weight: float = R.CONTENT_WEIGHT
    collab_weight: float = R.COLLAB_WEIGHT
    dislike_penalty: float = R.DISLIKE_PENALTY
    like_boost: float = R.LIKE_BOOST
    similarity_weight: float = R.FEEDBACK_SIMILARITY_WEIGHT

    @property
    def pool_limit(self) -> int:
        return max(self.top_k * 30, 100)

    @property
    def clipped_diversity(self) -> float:
        return float(max(0.0, min(1.0, self.diversity)))


# ---------------------------------------------------------------------------- validation

def validate_seeds(profiles: DataFrame, item_ids: DataFrame, max_seeds: int = 10) -> DataFrame:
    """(profile_id, problem, movieId) violations: no seed, more than ``max_seeds`` seeds,
    or a seed the model has not seen (an unseen like is ignored, not an error)."""
    seeds = profiles.where(F.col("role") == "seed")
    counts = profiles.groupBy("profile_id").agg(F.count_if(F.col("role") == "seed").alias("n"))
    few = counts.where(F.col("n") < 1).select("profile_id", F.lit("no_seeds").alias("problem"),
                                              F.lit(None).cast("long").alias("movieId"))
    many = counts.where(F.col("n") > max_seeds).select("profile_id", F.lit("too_many_seeds").alias("problem"),
                                                       F.lit(None).cast("long").alias("movieId"))
    unknown = (seeds.join(item_ids.select("movieId").distinct(), "movieId", "left_anti")
               .select("profile_id", F.lit("unknown_seed").alias("problem"), F.col("movieId").cast("long")))
    return few.unionByName(many).unionByName(unknown)


def valid_profiles(profiles: DataFrame, item_ids: DataFrame, max_seeds: int = 10) -> DataFrame:
    bad = validate_seeds(profiles, item_ids, max_seeds).select("profile_id").distinct()
    return profiles.join(bad, "profile_id", "left_anti")


# ---------------------------------------------------------------------------- profile vectors

#: Stands for a null profile where profiles are numpy numbers.
NO_PROFILE = -(1 << 63)


def _lists(values: np.ndarray, lengths: np.ndarray, valid: np.ndarray | None = None) -> pa.ListArray:
    """Lists of the given lengths over ``values``; null where not ``valid``."""
    offsets = pa.array(np.append(0, np.cumsum(lengths)), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values), mask=None if valid is None else pa.array(~valid))


def _by_profile(rows: DataFrame, vecs: list[str], means: dict[str, tuple[str, tuple[str, ...]]],
                lists: dict[str, str] | None = None) -> DataFrame:
    """(profile_id, means, lists) from rows (profile_id, movieId, role, vectors ``vecs``). ``means``: name ->
    (vector, roles it is the mean of; null without a row of them), ``lists``: name -> role whose ids it holds.

    The rows meet by profile in one shuffle, as plain arrays, and are averaged there: partial aggregates
    would combine nothing, as the rows come dealt by movie, and their buffers are larger than the rows."""
    lists = lists or {}
    schema = ", ".join(["profile_id long", *(f"{n} array<double>" for n in means), *(f"{n} array<long>" for n in lists)])

    def run(batches):
        for table in whole_groups(batches, "profile_id"):
            t = table.combine_chunks()
            ids, movies = t.column("profile_id").to_numpy(), t.column("movieId").to_numpy()
            role = t.column("role").to_numpy().astype(str)
            of = {v: _matrix(t.column(v).combine_chunks()) for v in vecs}
            first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            out = {"profile_id": pa.array(ids[first], pa.int64())}
            for name, (v, roles) in means.items():
                mine = np.isin(role, roles)
                n = np.add.reduceat(mine.astype(np.int64), first)
                total = np.add.reduceat(np.where(mine[:, None], of[v], 0.0), first, axis=0)
                dim = total.shape[1]
                out[name] = _lists((total[n > 0] / n[n > 0, None]).ravel(), np.where(n > 0, dim, 0), n > 0)
            for name, r in lists.items():
                mine = role == r
                out[name] = _lists(movies[mine], np.add.reduceat(mine.astype(np.int64), first))
            yield pa.RecordBatch.from_pydict(out)

    rows = rows.select(F.col("profile_id").cast("long"), F.col("movieId").cast("long"), "role", *[F.col(v).cast("array<double>") for v in vecs])
    return rows.repartition("profile_id").sortWithinPartitions("profile_id").mapInArrow(run, schema)


def profile_vectors(profiles: DataFrame, items: DataFrame, vecs: dict[str, str], roles=("seed", "like")) -> DataFrame:
    """(profile_id, mean vectors named by ``vecs``: item column -> name) over the rows of
    ``roles`` the model knows (a movie that is both seed and like counts twice)."""
    rows = profiles.where(F.col("role").isin(*roles)).select(F.coalesce("profile_id", F.lit(NO_PROFILE)).alias("profile_id"), "movieId", "role")
    x = rows.join(items.select("movieId", *vecs), "movieId")
    got = _by_profile(x, list(vecs), {name: (c, tuple(roles)) for c, name in vecs.items()})
    return got.select(F.nullif("profile_id", F.lit(NO_PROFILE)).alias("profile_id"), *vecs.values())


# ---------------------------------------------------------------------------- scoring kernel

def _normalize_rows(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    out = np.zeros_like(m)
    np.divide(m, n, out=out, where=n > 0)
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    n = float(np.linalg.norm(v))
    return v / n if n > 0 else np.zeros_like(v)


class ItemBlock:
    """Item ids and unit content/factor rows of one block (numpy); ``masks``: genre sets as bitmask words, if needed."""

    def __init__(self, ids, content, factor, masks=None):
        self.ids = np.asarray(ids, dtype=np.int64)
        self.content_u = _normalize_rows(np.asarray(content, dtype=np.float64))
        self.factor_u = _normalize_rows(np.asarray(factor, dtype=np.float64))
        self.masks = None if masks is None else np.asarray(masks).view(np.uint64)
        self.order = np.argsort(self.ids, kind="stable")
        self.sorted_ids = self.ids[self.order]
        width = self.content_u.shape[1]
        self.single = np.empty((len(self.ids), width + self.factor_u.shape[1]), dtype=np.float32)
        self.single[:, :width], self.single[:, width:] = self.content_u, self.factor_u
        self.longest = math.sqrt(float(np.einsum("ij,ij->i", self.single, self.single, dtype=np.float64).max(initial=0.0)))
        self.repeats = bool((self.sorted_ids[1:] == self.sorted_ids[:-1]).any())

    def places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the ids are in the block, and the row of each (the first if it holds an id twice)."""
        at = np.minimum(np.searchsorted(self.sorted_ids, ids), max(len(self.ids) - 1, 0))
        hit = np.flatnonzero(self.sorted_ids[at] == ids) if len(self.ids) else np.empty(0, dtype=np.int64)
        return hit, self.order[at[hit]]

    def all_places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the ids are in the block, once for each row that has it, and these rows."""
        if not self.repeats:
            return self.places(ids)
        a, b = (np.searchsorted(self.sorted_ids, ids, side=x) for x in ("left", "right"))
        hit = np.repeat(np.arange(len(ids)), b - a)
        return hit, self.order[np.arange(len(hit)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[hit]]


CELL_ROWS = ("cell int, is_profile boolean, id long, content array<double>, factor array<double>, seed_ids array<long>, "
             "like_ids array<long>, dislike_ids array<long>, lmean array<double>, dmean array<double>, masks array<long>")


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a column of equally long arrays."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _grid(profiles: DataFrame, items: DataFrame) -> tuple[int, int]:
    """(item blocks, profile blocks). Item blocks are bounded by bytes, as a task holds one. Profiles
    are streamed, so their blocks need no bound: only as many are made as keep the cores busy, since
    each one takes a copy of all items through the shuffle."""
    size = items.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("content") + F.size("factor")).alias("w")).first()
    across = max(1, math.ceil((size["n"] or 0) * ((size["w"] or 0) * 8 + 16) / ITEM_BLOCK_BYTES))
    busy = math.ceil(max(2 * items.sparkSession.sparkContext.defaultParallelism, 8) / across)
    return across, max(1, min(busy, math.ceil(profiles.select("profile_id").distinct().count() / PROFILE_BLOCK)))


def _in_cells(inputs: DataFrame, items: DataFrame, across: int, down: int) -> DataFrame:
    """Profiles and items dealt to the cells of a grid: profile blocks x item blocks. A profile goes to
    the cells of its row, an item to those of its column; in a cell the items come first."""
    # an empty list stands for none: Arrow's writer passes over all null lists at the end of a batch again
    # whenever its size is asked for, which Spark does at each row
    no_ids, no_vec = F.array().cast("array<long>"), F.array().cast("array<double>")

    def block(key: str, n: int):
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def masks(df: DataFrame):
        return (F.coalesce("masks", no_ids) if "masks" in df.columns else no_ids).alias("masks")

    p = inputs.select(
        F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("x"), block("profile_id", down).alias("y"), F.lit(True).alias("is_profile"),
        F.col("profile_id").cast("long").alias("id"), F.coalesce("cmean", no_vec).alias("content"), F.coalesce("fmean", no_vec).alias("factor"),
        *[F.coalesce(F.col(c).cast("array<long>"), no_ids).alias(c) for c in ("seed_ids", "like_ids", "dislike_ids")],
        *[F.coalesce(c, no_vec).alias(c) for c in ("lmean", "dmean")], masks(inputs))
    i = items.select(
        block("movieId", across).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("y"), F.lit(False).alias("is_profile"),
        F.col("movieId").cast("long").alias("id"), F.col("content").cast("array<double>").alias("content"),
        F.col("factor").cast("array<double>").alias("factor"),
        *[no_ids.alias(c) for c in ("seed_ids", "like_ids", "dislike_ids")], no_vec.alias("lmean"), no_vec.alias("dmean"), masks(items))
    cells = p.unionByName(i).withColumn("cell", (F.col("y") * across + F.col("x")).cast("int")).drop("x", "y")
    return (cells.repartition(max(2 * across * down, 8), "cell").sortWithinPartitions("cell", "is_profile")
            .select(*[c.split()[0] for c in CELL_ROWS.split(", ")]))


class Profiles:
    """A batch of profiles: ids, unit mean vectors (zeros for none) and the lists of their ids (offsets, values)."""

    def __init__(self, rows: pa.RecordBatch, blk: ItemBlock):
        content, factor = rows.column("content"), rows.column("factor")
        ok = (_lengths(content) > 0) & (_lengths(factor) > 0)
        if not ok.all():
            rows = rows.filter(pa.array(ok))
        self.ids = rows.column("id").to_numpy()
        self.content = _units(rows.column("content"), blk.content_u.shape[1])
        self.factor, self.likes, self.dislikes = (_units(rows.column(c), blk.factor_u.shape[1]) for c in ("factor", "lmean", "dmean"))
        self.lists = {c: (np.repeat(np.arange(len(rows)), _lengths(rows.column(c))), rows.column(c).flatten().to_numpy(zero_copy_only=False))
                      for c in ("seed_ids", "like_ids", "dislike_ids", "masks")}
        self.pairs: dict[tuple, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.ids)

    def codes(self, blk: ItemBlock, *names: str, every: bool = False) -> np.ndarray:
        """profile x items + item of the ids of these lists that are in the block, sorted; ``every``: all rows of an id."""
        if (names, every) not in self.pairs:
            rows, ids = (np.concatenate(x) for x in zip(*(self.lists[c] for c in names)))
            hit, at = (blk.all_places if every else blk.places)(ids)
            self.pairs[names, every] = np.unique(rows[hit] * len(blk.ids) + at)
        return self.pairs[names, every]


KNOWN = ("seed_ids", "like_ids", "dislike_ids")


def _among(codes: np.ndarray, sought: np.ndarray) -> np.ndarray:
    """Which of the codes are among the (sorted) ones sought."""
    if not len(sought):
        return np.zeros(len(codes), dtype=bool)
    return sought[np.minimum(np.searchsorted(sought, codes), len(sought) - 1)] == codes


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """The parts as one, which are given up."""
    out = np.concatenate(parts)
    parts.clear()
    return out


def _lengths(lists: pa.Array) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy()


def _units(lists: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of a column of lists; an empty list gives zeros."""
    out = np.zeros((len(lists), dim))
    out[_lengths(lists) > 0] = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return _normalize_rows(out)


def _blockwise(inputs: DataFrame, items: DataFrame, grid: tuple[int, int], score, schema: T.StructType) -> DataFrame:
    """``score(rows of profiles, item block)`` -> a record batch or None, for every cell of the grid. A task
    holds one item block and streams the profiles of its cell; nothing passes the driver."""
    names = schema.fieldNames()

    def run(batches):
        cell, held, blk = None, ([], [], [], []), None
        for batch in batches:
            cells, is_profile = batch.column("cell").to_numpy(), batch.column("is_profile").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(cells) != 0) | np.diff(is_profile)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cells)]):
                if a == b:
                    continue
                if cells[a] != cell:
                    cell, held, blk = cells[a], ([], [], [], []), None
                rows = batch.slice(a, b - a)
                if not is_profile[a]:
                    for parts, x in zip(held, (rows.column("id").to_numpy(), *(_matrix(rows.column(c)) for c in ("content", "factor", "masks")))):
                        parts.append(x)
                    continue
                if blk is None and held[0]:
                    blk = ItemBlock(*map(_joined, held))
                if blk is not None:
                    step = _profile_step(blk)
                    for start in range(0, len(rows), step):
                        out = score(Profiles(rows.slice(start, step), blk), blk)
                        if out is not None and len(out["profile_id"]):
                            yield pa.RecordBatch.from_pydict({n: out[n] for n in names})

    return _in_cells(inputs, items, *grid).mapInArrow(run, schema)


POOL_SCHEMA = T.StructType([
    T.StructField("profile_id", T.LongType()),
    T.StructField("movieId", T.LongType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("content_score", T.DoubleType()),
    T.StructField("collaborative_score", T.DoubleType()),
])
#: What leaves a cell: seeds, likes and dislikes are marked, the others ranked within the block.
SCORED_SCHEMA = T.StructType(POOL_SCHEMA.fields + [T.StructField("excluded", T.BooleanType()), T.StructField("pool_rank", T.IntegerType())])
#: For the rerank also the item's genre masks and its overlap with the seeds (more than one if items hold the id twice).
MASKED_SCHEMA = T.StructType(SCORED_SCHEMA.fields + [T.StructField("mask", T.ArrayType(T.LongType())),
                                                     T.StructField("pen0", T.ArrayType(T.DoubleType()))])
#: The same, a profile's pool in one line; ``n``: masks of each item.
POOLS_SCHEMA = ("profile_id long, movieId array<long>, score array<double>, content_score array<double>, collaborative_score array<double>, "
                "pool_rank array<int>, n array<int>, mask array<long>, pen0 array<double>")


def _profile_step(blk: ItemBlock, budget: int = 64 << 20) -> int:
    """Profiles per matrix product: one (profiles × items) single precision matrix and what is made of it within ``budget``."""
    return max(1, min(PROFILE_BATCH, budget // (max(len(blk.ids), 1) * 8)))


SCORES = ("content", "collab", "hybrid", "adjusted")


def _parts(part: Profiles, kind: str, p: RecParams) -> tuple[np.ndarray, np.ndarray]:
    """The vectors whose products with an item's content and factor vectors add up to a score (the adjusted
    one without what a like or dislike itself adds)."""
    none = np.zeros_like
    if kind == "content":
        return part.content, none(part.factor)
    if kind == "collab":
        return none(part.content), part.factor
    content, factor = p.content_weight * part.content, p.collab_weight * part.factor
    if kind == "adjusted":
        factor = factor + p.similarity_weight * part.likes - p.similarity_weight * part.dislikes
    return content, factor


def _shifts(part: Profiles, kind: str, blk: ItemBlock, p: RecParams) -> list[tuple[np.ndarray, float]]:
    """(codes of pairs, what they gain), to be added one after another."""
    return [(part.codes(blk, "dislike_ids"), -p.dislike_penalty), (part.codes(blk, "like_ids"), p.like_boost)] if kind == "adjusted" else []


def _single(part: Profiles, blk: ItemBlock, kind: str, p: RecParams) -> tuple[np.ndarray, np.ndarray]:
    """Scores of all (profile, item) pairs in single precision, and how far each row's may be from the exact ones."""
    q = np.hstack(_parts(part, kind, p))
    at, to = {"content": (0, part.content.shape[1]), "collab": (part.content.shape[1], q.shape[1])}.get(kind, (0, q.shape[1]))
    s = q[:, at:to].astype(np.float32) @ blk.single[:, at:to].T
    for codes, gain in _shifts(part, kind, blk, p):
        s.reshape(-1)[codes] += np.float32(gain)
    # rounding of both factors, the products and their sum: (terms + 3) units of |q||item|; shifts round once more each
    shift = p.dislike_penalty + p.like_boost if kind == "adjusted" else 0.0
    return s, (q.shape[1] + 8) * 2.0 ** -24 * (np.linalg.norm(q, axis=1) * blk.longest + shift) + 1e-12


def _reaching(s: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The columns of the entries that reach their row's least (rounded down), row by row, and where each row's begin."""
    rows, cols = np.divmod(np.flatnonzero(s >= np.nextafter(least.astype(s.dtype), s.dtype.type(-np.inf))[:, None]), s.shape[1])
    return cols, np.searchsorted(rows, np.arange(len(s) + 1))


def _exact(part: Profiles, rows: np.ndarray, cols: np.ndarray, blk: ItemBlock, p: RecParams) -> dict[str, np.ndarray]:
    """All scores of some pairs, in double precision. A pair's sums don't depend on its place among the others."""
    out = {k: np.empty(len(rows)) for k in SCORES}
    for a in range(0, len(rows), PAIRS_AT_ONCE):
        some = slice(a, a + PAIRS_AT_ONCE)
        at, item = rows[some], cols[some]

        def products(vectors: np.ndarray, of: np.ndarray) -> np.ndarray:
            return np.einsum("ij,ij->i", of, vectors[at])

        factor = blk.factor_u[item]
        c, cf = products(part.content, blk.content_u[item]), products(part.factor, factor)
        h = p.content_weight * c + p.collab_weight * cf
        s = h.copy()
        for codes, gain in _shifts(part, "adjusted", blk, p):
            s[_among(at * len(blk.ids) + item, codes)] += gain
        for vectors, weight in ((part.likes, p.similarity_weight), (part.dislikes, -p.similarity_weight)):
            if vectors.any():
                s += weight * products(vectors, factor)
        for k, v in zip(SCORES, (c, cf, h, s)):
            out[k][some] = v
    return out


def _low_kth(s: np.ndarray, k: int) -> np.ndarray:
    """For each row a number that at least ``k`` of its entries reach, close to the k-th greatest: the k-th
    greatest of the maxima of groups of entries (the k-th greatest itself where rows are short)."""
    n = s.shape[1]
    if n <= k:
        return np.full(len(s), -np.inf, dtype=s.dtype)
    size = min(64, n // (8 * k))
    if size > 1:
        groups = n // size
        s = np.maximum(s[:, :groups * size].reshape(len(s), size, groups).max(axis=1),
                       np.pad(s[:, groups * size:], ((0, 0), (0, groups - (n - groups * size))), constant_values=-np.inf))
    return np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]


def _score_batch(part: Profiles, blk: ItemBlock, p: RecParams, keep, margin: float | None = None,
                 drop_excluded: bool = False) -> dict | None:
    """The top ``keep`` items of each profile (all if None; of tied ones those with the least ids). With
    ``margin``, of these only the items that score at most so much less than the ``top_k``-th item
    that may be shown: the others can't be picked."""
    if len(part) == 0 or len(blk.ids) == 0:
        return None
    n_items = len(blk.ids)
    least = np.full(len(part), -np.inf)
    s, error = _single(part, blk, "adjusted", p)
    known = part.codes(blk, *KNOWN)
    behind = p.top_k + int(np.bincount(known // n_items, minlength=1).max())      # the top_k-th item shown is at least the one at that place
    near = margin is not None and (keep is None or behind < keep)
    if keep is not None and not (near and margin == 0):
        least = _low_kth(s, keep) - 2 * error
    if near:
        least = np.maximum(least, _low_kth(s, behind) - 2 * error - margin)
    cols, cuts = _reaching(s, least)
    rows = np.repeat(np.arange(len(part)), np.diff(cuts))
    got = _exact(part, rows, cols, blk, p)
    got |= {"rows": rows, "cols": cols}

    def only(these) -> dict:
        return {k: v[these] for k, v in got.items()}

    got = only(np.lexsort((blk.ids[cols], -got["adjusted"], rows)))
    if keep is not None:
        got = only(_nth_of_row(got["rows"]) < keep)
    if margin is not None and n_items > p.top_k:
        shown = np.flatnonzero(~_among(got["rows"] * n_items + got["cols"], known))
        kth = shown[_nth_of_row(got["rows"][shown]) == p.top_k - 1]
        last = np.full(len(part), -np.inf)
        last[got["rows"][kth]] = got["adjusted"][kth]
        got = only(got["adjusted"] >= last[got["rows"]] - margin)
    got["excluded"] = _among(got["rows"] * n_items + got["cols"], part.codes(blk, *KNOWN, every=True))
    if drop_excluded:
        got = only(~got["excluded"])
    got["pool_rank"] = (_nth_of_row(got["rows"]) + 1).astype(np.int32)
    if blk.masks.shape[1]:
        got["at"] = np.arange(len(got["rows"]))
        of, masks, pen0 = _masked(part, got["rows"], got["cols"], blk)
        if drop_excluded and p.clipped_diversity < 1.0:         # ranked: what can't be picked may go
            got = only(_may_be_picked(got, of, pen0, p))
            stay = np.isin(of, got["at"])
            of, masks, pen0 = of[stay], masks[stay], pen0[stay]
        n = np.bincount(of, minlength=1)[got["at"]] if len(of) else np.zeros(0, np.int64)
    out = {"profile_id": part.ids[got["rows"]], "movieId": blk.ids[got["cols"]], "score": got["adjusted"], "content_score": got["content"],
           "collaborative_score": got["collab"], "excluded": got["excluded"], "pool_rank": got["pool_rank"]}
    if not blk.masks.shape[1]:
        return out
    if not drop_excluded:
        return out | {"mask": _lists(masks.view(np.int64).ravel(), n * masks.shape[1]), "pen0": _lists(pen0, n)}
    # a pool of a profile in one line
    first = np.flatnonzero(np.append(True, got["rows"][1:] != got["rows"][:-1]))[:len(n)]
    size = np.diff(np.append(first, len(n)))
    line = {k: _lists(v, size) for k, v in (out | {"n": n.astype(np.int32)}).items() if k not in ("profile_id", "excluded")}
    of_line = np.add.reduceat(n, first) if len(first) else n
    return line | {"profile_id": out["profile_id"][first], "mask": _lists(masks.view(np.int64).ravel(), of_line * masks.shape[1]),
                   "pen0": _lists(pen0, of_line)}


def _nth_of_row(rows: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of equal numbers."""
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))[:len(rows)]
    return np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))


def _masked(part: Profiles, rows: np.ndarray, cols: np.ndarray, blk: ItemBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the pair, genre masks of the item, overlap with the profile's seeds), pair by pair. Where the
    block holds an id twice, each of its rows has the masks of both."""
    if blk.repeats:
        of, at = blk.all_places(blk.ids[cols])
    else:
        of, at = np.arange(len(cols)), cols
    masks, rows = blk.masks[at], rows[of]
    sizes, pen = np.bitwise_count(masks).sum(axis=1, dtype=np.int64), np.zeros(len(at))
    words = masks.shape[1]
    owner, seeds = part.lists["masks"]
    owner, seeds = owner[::words], seeds.view(np.uint64).reshape(-1, words)
    nth = _nth_of_row(owner)
    for k in range(int(nth.max(initial=-1)) + 1):           # the k-th seed of each profile
        one = np.zeros((len(part), words), dtype=np.uint64)
        one[owner[nth == k]] = seeds[nth == k]
        np.maximum(pen, _jaccard_to(masks, sizes, one[rows]), out=pen)
    return of, masks, pen


def _may_be_picked(got: dict, of: np.ndarray, pen0: np.ndarray, p: RecParams) -> np.ndarray:
    """Whether fewer than ``top_k`` items of its ranked pool win, at full penalty, against an item at its
    first penalty, which only grows (exact, no cap)."""
    rows, score = got["rows"], got["adjusted"]
    if not len(rows):
        return np.zeros(0, dtype=bool)
    d = p.clipped_diversity
    weight = d * R.DIVERSITY_PENALTY_SCALE
    first = np.full(len(rows), np.inf)
    np.minimum.at(first, of, pen0)
    kth = np.flatnonzero(got["pool_rank"] == p.top_k)
    last = np.full(int(rows.max()) + 1, -np.inf)
    last[rows[kth]] = score[kth]
    return (1.0 - d) * score - weight * first >= (1.0 - d) * last[rows] - weight - 1e-9


STATS_KINDS = SCORES


def _stats_schema(kinds) -> T.StructType:
    return T.StructType([T.StructField("profile_id", T.LongType())] + [
        f for k in kinds for f in (
            T.StructField(f"{k}_n", T.LongType()), T.StructField(f"{k}_sum", T.DoubleType()),
            T.StructField(f"{k}_max", T.DoubleType()), T.StructField(f"{k}_argmax", T.LongType()))])


def _stats_batch(part: Profiles, blk: ItemBlock, params: RecParams, kinds) -> dict | None:
    """Number, sum, maximum and best item over the block. The sum of products with all items is the product
    with the items' sum; the maximum is looked for among all pairs."""
    if len(part) == 0 or len(blk.ids) == 0:
        return None
    out = {"profile_id": part.ids}
    total_c, total_f = blk.content_u.sum(axis=0), blk.factor_u.sum(axis=0)
    for k in kinds:
        s, error = _single(part, blk, k, params)
        cols, cuts = _reaching(s, s.max(axis=1) - 2 * error)
        rows = np.repeat(np.arange(len(part)), np.diff(cuts))
        content, factor = _parts(part, k, params)
        sums = content @ total_c + factor @ total_f
        for codes, gain in _shifts(part, k, blk, params):
            sums += gain * np.bincount(codes // len(blk.ids), minlength=len(part))
        v = _exact(part, rows, cols, blk, params)[k]
        best = np.maximum.reduceat(v, cuts[:-1])
        ids = np.where(v >= best[rows] - 1e-12, blk.ids[cols], np.iinfo(np.int64).max)      # ties within 1e-12 go to the lowest id
        out |= {f"{k}_n": np.full(len(part), len(blk.ids), dtype=np.int64), f"{k}_sum": sums, f"{k}_max": best,
                f"{k}_argmax": np.minimum.reduceat(ids, cuts[:-1])}
    return out


def similarity_stats(profiles: DataFrame, items: DataFrame, params: RecParams, kinds=STATS_KINDS) -> DataFrame:
    """Per profile and score kind: item count, sum, max and the best item (lowest id on ties),
    over all items, computed inside the scoring tasks (no profile × item rows leave them)."""
    out = _blockwise(scoring_inputs(profiles, items), items, _grid(profiles, items),
                     lambda part, blk: _stats_batch(part, blk, params, kinds), _stats_schema(kinds))
    aggs = []
    for k in kinds:
        aggs += [F.sum(f"{k}_n").alias(f"{k}_n"), F.sum(f"{k}_sum").alias(f"{k}_sum"),
                 F.max(f"{k}_max").alias(f"{k}_max"),
                 F.max_by(f"{k}_argmax", F.struct(F.col(f"{k}_max"), -F.col(f"{k}_argmax"))).alias(f"{k}_argmax")]
    # one row per profile and block: merging is a no-op with one block
    return out.groupBy("profile_id").agg(*aggs)


def scoring_inputs(profiles: DataFrame, items: DataFrame) -> DataFrame:
    """One row per profile that has an item: the ids of its seeds, likes and dislikes that are items, and
    the four mean vectors the score needs."""
    rows = profiles.where(F.col("role").isin("seed", "like", "dislike") & F.col("profile_id").isNotNull()).select("profile_id", "movieId", "role")
    own = ("seed", "like")
    return _by_profile(rows.join(items.select("movieId", "content", "factor"), "movieId"), ["content", "factor"],
                       {"cmean": ("content", own), "fmean": ("factor", own), "lmean": ("factor", ("like",)), "dmean": ("factor", ("dislike",))},
                       {"seed_ids": "seed", "like_ids": "like", "dislike_ids": "dislike"})


def score_items(profiles: DataFrame, items: DataFrame, params: RecParams, keep: int | None,
                margin: float | None = None, grid: tuple[int, int] | None = None, seed_sets: DataFrame | None = None) -> DataFrame:
    """(profile_id, movieId, score, content_score, collaborative_score, excluded, pool_rank) for the top
    ``keep`` items per profile and item block; ``keep=None`` keeps all. With one item block the
    excluded ones are left out and ``pool_rank`` is that of the whole pool. With ``seed_sets`` each item
    has its genre masks and its overlap with the seeds, and items that the rerank can't pick go."""
    grid = grid or _grid(profiles, items)
    alone = grid[0] == 1
    inputs, schema = scoring_inputs(profiles, items), SCORED_SCHEMA
    if seed_sets is not None:
        vocab = _vocabulary(items)
        inputs = inputs.join(_seed_masks(seed_sets, vocab).select("profile_id", F.flatten("seed_masks").alias("masks")), "profile_id", "left")
        items, schema = items.withColumn("masks", _item_mask(vocab)), T.StructType.fromDDL(POOLS_SCHEMA) if alone else MASKED_SCHEMA
    return _blockwise(inputs, items, grid, lambda part, blk: _score_batch(part, blk, params, keep, margin, alone), schema)


# ---------------------------------------------------------------------------- pool and rerank

def pick_margin(params: RecParams) -> float | None:
    """How much less than the ``top_k``-th item of a pool an item may score and still be picked: it
    must win against ``top_k`` others at full penalty with none of its own."""
    d = params.clipped_diversity
    if d <= 0.05 or params.top_k <= 1:
        return 0.0
    return R.DIVERSITY_PENALTY_SCALE * d / (1.0 - d) + 1e-9 if d < 1.0 else None


def candidate_pool(profiles: DataFrame, items: DataFrame, params: RecParams, margin: float | None = None,
                   seed_sets: DataFrame | None = None) -> DataFrame:
    """Top ``pool_limit`` by score (ties: movieId), *then* seeds, likes and dislikes dropped,
    so a pool can hold fewer than ``pool_limit`` items. Adds ``pool_rank``. With ``margin`` (see
    ``pick_margin``) the end of the pool that can't be picked is left out where it is scored. With ``seed_sets``
    the pool is made ready for ``diversity_rerank``: a profile's rows together, by rank (in one line, with one item block)."""
    grid = _grid(profiles, items)
    scored = score_items(profiles, items, params, params.pool_limit, margin, grid, seed_sets)
    if grid[0] == 1:                                        # a profile's pool comes out of one task, ranked
        return scored.drop("excluded") if seed_sets is None else scored
    w = Window.partitionBy("profile_id").orderBy(F.col("score").desc(), F.col("movieId"))
    top = scored.drop("pool_rank").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= params.pool_limit).drop("_r")
    shown = F.count_if(~F.col("excluded")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    return top.withColumn("pool_rank", shown).where(~F.col("excluded")).drop("excluded")


def plain_top_k(pool: DataFrame, k: int) -> DataFrame:
    return pool.where(F.col("pool_rank") <= k).withColumn("rank", F.col("pool_rank"))


RERANK_SCHEMA = T.StructType(POOL_SCHEMA.fields + [
    T.StructField("pool_rank", T.IntegerType()), T.StructField("rank", T.IntegerType())])


WORD_BITS = 62


def _mask_word(gset, vocab: list[str]):
    """Genre set -> bitmask long over (at most ``WORD_BITS``) genres; other genres add nothing."""
    voc = F.array(*[F.lit(g) for g in vocab])
    return F.aggregate(gset, F.lit(0).cast("long"),
                       lambda acc, g: acc.bitwiseOR(F.pow(F.lit(2.0), F.array_position(voc, g) - 1).cast("long")))


def _mask_expr(gset, vocab: list[str]):
    """Genre set -> bitmask words (array<long>) over the sorted vocabulary, of any length."""
    words = [_mask_word(gset, vocab[i:i + WORD_BITS]) for i in range(0, len(vocab), WORD_BITS)]
    return F.array(*words) if words else F.array(F.lit(0).cast("long"))


def _jac_expr(a, b):
    """Jaccard of two bitmask columns (0 if either is empty)."""
    def bits(x):
        return F.aggregate(x, F.lit(0), lambda n, w: n + F.bit_count(w))

    inter = bits(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)))
    union = bits(F.zip_with(a, b, lambda x, y: x.bitwiseOR(y)))
    return F.when((bits(a) == 0) | (bits(b) == 0), F.lit(0.0)).otherwise(
        inter.cast("double") / F.greatest(union, F.lit(1)).cast("double"))


RERANK_IN = "profile_id long, movieId long, score double, content_score double, collaborative_score double, " \
            "pool_rank int, mask array<long>, pen0 array<double>"


def _vocabulary(item_genres: DataFrame) -> list[str]:
    return sorted({g for r in item_genres.select(F.explode("genre_set").alias("g")).distinct().collect()
                   for g in [r["g"]] if g is not None})                       # bounded: the genre count


def _item_mask(vocab: list[str]):
    return _mask_expr(F.coalesce("genre_set", F.array().cast("array<string>")), vocab)


def _seed_masks(seed_sets: DataFrame, vocab: list[str]) -> DataFrame:
    return seed_sets.select("profile_id", F.transform(F.coalesce("seed_sets", F.array().cast("array<array<string>>")),
                                                      lambda x: _mask_expr(x, vocab)).alias("seed_masks"))


def _jaccard_to(masks: np.ndarray, sizes: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Jaccard of every candidate's bitmask (rows of words) with one (0 if either is empty)."""
    inter = np.bitwise_count(masks & one).sum(axis=1, dtype=np.int64)
    union = np.bitwise_count(masks | one).sum(axis=1, dtype=np.int64)
    return np.where((sizes == 0) | (not one.any()), 0.0, inter / np.maximum(union, 1))


def _greedy(value: np.ndarray, pen: np.ndarray, masks: np.ndarray, top_k: int, weight: float) -> list[int]:
    """Places of the picks of one pool, in pick order; of equal values the lower pool rank."""
    sizes = np.bitwise_count(masks).sum(axis=1)
    picked: list[int] = []
    pen = pen.copy()
    for _ in range(min(top_k, len(value))):
        adjusted = value - weight * pen
        adjusted[picked] = -np.inf
        best = int(np.argmax(adjusted))
        picked.append(best)
        np.maximum(pen, _jaccard_to(masks, sizes, masks[best]), out=pen)
    return picked


def _rerank(top_k: int, d: float):
    """mapInArrow body over pools sorted by profile and pool rank."""

    def run(batches):
        for table in whole_groups(batches, "profile_id"):
            batch = table.combine_chunks()
            pens, masks = (batch.column(c).combine_chunks().flatten().to_numpy() for c in ("pen0", "mask"))
            if "n" in batch.schema.names:               # a pool a line
                n = batch.column("n").combine_chunks()
                at = np.repeat(np.arange(len(batch)), _lengths(n))
                batch = pa.table({"profile_id": batch.column("profile_id").take(pa.array(at)),
                                  **{c: batch.column(c).combine_chunks().flatten() for c in (*POOL_SCHEMA.names[1:], "pool_rank")}})
                n = n.flatten().to_numpy()
            else:
                n = _lengths(batch.column("pen0").combine_chunks())
            if (n != 1).any():                          # items hold an id twice: a line for each
                batch = batch.take(pa.array(np.repeat(np.arange(len(n)), n)))
            ids, pen = batch.column("profile_id").to_numpy(), pens
            masks = masks.view(np.uint64).reshape(len(ids), -1)
            value = (1.0 - d) * batch.column("score").to_numpy()
            first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            picks, ranks = [], []
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(ids)]):
                picked = _greedy(value[a:b], pen[a:b], masks[a:b], top_k, d * R.DIVERSITY_PENALTY_SCALE)
                picks += [a + i for i in picked]
                ranks += range(1, len(picked) + 1)
            out = batch.select([*POOL_SCHEMA.names, "pool_rank"]).take(pa.array(picks, pa.int64()))
            yield from out.append_column("rank", pa.array(ranks, pa.int32())).to_batches()

    return run


def diversity_rerank(pool: DataFrame, item_genres: DataFrame, seed_sets: DataFrame, params: RecParams) -> DataFrame:
    """Greedy pick of ``top_k``: argmax (1-d)·score − 0.35·d·max-Jaccard to the genre sets
    picked so far (which start with the seeds'); plain top-k when d ≤ 0.05 or k ≤ 1.

    Sequential per profile but bounded (≤ pool_limit rows, ≤ top_k rounds), and parallel
    over profiles. Genre sets travel as bitmask words, the
    starting penalty (overlap with the seeds) is computed where the items are scored (in Spark for
    a pool without it), and rows that can never be picked are dropped first: if ``top_k`` candidates beat a row even at full penalty
    against its zero penalty, it cannot enter the top ``top_k`` (exact, no cap)."""
    d = params.clipped_diversity
    k = params.top_k
    if d <= 0.05 or k <= 1:
        return plain_top_k(pool, k)
    if "pen0" in pool.columns:      # made by ``candidate_pool`` with the seeds' sets: no join, no shuffle
        columns = POOLS_SCHEMA if "n" in pool.columns else RERANK_IN
        return pool.select(*[F.col(name).cast(kind) for name, kind in (c.split() for c in columns.split(", "))]).mapInArrow(_rerank(k, d), RERANK_SCHEMA)
    vocab = _vocabulary(item_genres)
    g = item_genres.select("movieId", _item_mask(vocab).alias("mask"))
    sm = _seed_masks(seed_sets, vocab)
    empty = F.array(*[F.lit(0).cast("long")] * max(1, -(-len(vocab) // WORD_BITS)))
    x = pool.join(g, "movieId", "left").withColumn("mask", F.coalesce("mask", empty))
    x = x.join(sm, "profile_id", "left")
    x = x.withColumn("pen0", F.aggregate(F.coalesce("seed_masks", F.array().cast("array<array<long>>")), F.lit(0.0),
                                         lambda acc, m: F.greatest(acc, _jac_expr(F.col("mask"), m))))
    if d < 1.0:
        w = Window.partitionBy("profile_id")
        kth = F.max(F.when(F.col("pool_rank") == k, F.col("score"))).over(w)
        margin = R.DIVERSITY_PENALTY_SCALE * d / (1.0 - d)
        x = x.withColumn("_kth", kth).where(F.col("_kth").isNull() | (F.col("score") >= F.col("_kth") - F.lit(margin)))
    x = x.withColumn("pen0", F.array("pen0"))
    x = x.select(*[F.col(name).cast(kind) for name, kind in (c.split() for c in RERANK_IN.split(", "))])
    # one shuffle by profile, rows of a profile contiguous: walk the groups in numpy instead
    # of paying a per-group Arrow round trip (a group is at most pool_limit rows)
    x = x.repartition("profile_id").sortWithinPartitions("profile_id", "pool_rank")
    return x.mapInArrow(_rerank(k, d), RERANK_SCHEMA)


def seed_genre_sets(profiles: DataFrame, item_genres: DataFrame) -> DataFrame:
    """(profile_id, seed_sets): genre sets of the seeds in seed order (empty if unknown)."""
    s = (profiles.where(F.col("role") == "seed").join(item_genres.select("movieId", "genre_set"),
                                                      "movieId", "left")
         .select("profile_id", "pos", F.coalesce("genre_set", F.array().cast("array<string>")).alias("g")))
    return s.groupBy("profile_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "g"))), lambda t: t["g"]).alias("seed_sets"))


def genre_overlap(candidates: DataFrame, picked: DataFrame) -> DataFrame:
    """Max Jaccard of each candidate's genre set with the picked sets of its profile
    (0 when either set is empty): (profile_id, movieId, overlap)."""
    x = candidates.join(picked.select("profile_id", F.col("genre_set").alias("p")), "profile_id")
    return x.groupBy("profile_id", "movieId").agg(F.max(jaccard(F.col("genre_set"), F.col("p"))).alias("overlap"))


def display_order(recs: DataFrame) -> DataFrame:
    """The shown list is re-sorted by score (stable: pick order breaks ties)."""
    w = Window.partitionBy("profile_id").orderBy(F.col("score").desc(), F.col("rank"))
    return recs.withColumn("display_rank", F.row_number().over(w))


def match_percent(score: str = "score"):
    """(clipped score, '.0%' text of the score, band of the clipped score)."""
    from ..functions.columns import pct0

    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score)))
    band = F.lit(R.MATCH_BAND_DEFAULT)
    for lo, label in reversed(R.MATCH_BANDS):
        band = F.when(clipped >= lo, F.lit(label)).otherwise(band)
    return clipped, F.concat(pct0(score), F.lit("%")), band
