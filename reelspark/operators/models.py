"""Rating models on Spark.

* ``baseline_mean``: the training mean.
* ``gmf``: matrix factorisation by Spark ML's ALS (dot product of user and movie factors:
  the same prediction form, trained by alternating least squares instead of Adam).
* ``neural_cf`` / ``neumf`` / ``content_net`` / ``hybrid_net``: one shared MLP head
  (hidden 128, 64, ReLU) over a per-row feature vector built from the ALS factors and the
  content vectors. Each epoch broadcasts the weights, every task runs mini-batch Adam (lr 1e-3,
  weight decay 1e-5) over its partition and returns its weights, and the driver averages them
  by row count (parameter averaging). The factors are not trained jointly with the head.

Rows meet factors on a grid of user blocks x movie blocks (``deal``): a rating goes to one cell
as ids, a factor once to each cell that has a rating of it, and the task looks the factors up
in numpy. No row that carries factors is shuffled or stored.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import trimmed
from ..session import apply_runtime_conf, checkpoint_root, scratch_path

MODEL_TYPES = {"gmf": "cf", "neural_cf": "cf", "neumf": "cf", "content_net": "content", "hybrid_net": "hybrid"}
MODEL_NAMES = {"gmf": "GMF", "neural_cf": "NeuralCF", "neumf": "NeuMF", "content_net": "ContentNet",
               "hybrid_net": "HybridNet", "baseline": "Baseline (global mean)"}


@dataclass(frozen=True)
class ModelConfig:
    embed_dim: int = 64
    hidden: tuple[int, ...] = (128, 64)
    epochs: int = 5
    batch_size: int = 256
    lr: float = 1e-3
    weight_decay: float = 1e-5
    als_iters: int = 10
    als_reg: float = 0.1
    seed: int = 42
    extra: dict = field(default_factory=dict)

    def fingerprint(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, default=str)


# ------------------------------------------------------------------------ metrics

def rmse_mae(pred: DataFrame, label: str = "rating", prediction: str = "prediction") -> DataFrame:
    d = F.col(prediction) - F.col(label)
    return pred.agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"))


def _grouped_metrics(pred: DataFrame, by: str) -> DataFrame:
    d = F.col("prediction") - F.col("rating")
    return pred.groupBy(by).agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"))


def _metrics(pred: DataFrame) -> tuple[float, float]:
    r = rmse_mae(pred).first()
    return float(r["rmse"]), float(r["mae"])


# ------------------------------------------------------------------------ baseline

def global_mean(train: DataFrame) -> float:
    return float(train.agg(F.avg("rating")).first()[0])


def baseline_metrics(train: DataFrame, val: DataFrame, test: DataFrame) -> dict:
    mean = global_mean(train)
    vr, vm = _metrics(val.withColumn("prediction", F.lit(mean)))
    tr, tm = _metrics(test.withColumn("prediction", F.lit(mean)))
    return {"model": MODEL_NAMES["baseline"], "model_type": "baseline", "val_RMSE": vr, "val_MAE": vm,
            "test_RMSE": tr, "test_MAE": tm}


# ------------------------------------------------------------------------ ALS (gmf)

#: Spark ML's own number of ALS blocks, and the ratings from which there are more: a task holds the factors
#: that all ratings of its block need.
ALS_BLOCKS = 10
ALS_BLOCK_RATINGS = 2_000_000


def als_blocks(ratings: int) -> int:
    return max(ALS_BLOCKS, -(-ratings // ALS_BLOCK_RATINGS))


def fit_als(train: DataFrame, cfg: ModelConfig):
    """ALS factors. A checkpoint of each iteration lets go of the shuffles before it; without it the
    factors that all iterations sent stay on disk to the end."""
    from pyspark.ml.recommendation import ALS

    checkpoint_root(train.sparkSession)
    blocks = als_blocks(train.count())
    als = ALS(rank=cfg.embed_dim, maxIter=cfg.als_iters, regParam=cfg.als_reg, userCol="userId", itemCol="movieId",
              ratingCol="rating", coldStartStrategy="drop", seed=cfg.seed, checkpointInterval=1,
              numUserBlocks=blocks, numItemBlocks=blocks)
    data = train.select(F.col("userId").cast("int"), F.col("movieId").cast("int"), F.col("rating").cast("float"))
    return als.fit(data)


def als_predict(model, rows: DataFrame) -> DataFrame:
    x = rows.select(F.col("userId").cast("int").alias("userId"), F.col("movieId").cast("int").alias("movieId"),
                    *[c for c in rows.columns if c not in ("userId", "movieId")])
    return model.transform(x).withColumn("prediction", F.col("prediction").cast("double"))


# ------------------------------------------------------------------------ MLP head

def _layout(d_in: int, hidden: tuple[int, ...], d_gmf: int) -> list[tuple[str, tuple[int, ...]]]:
    dims = [d_in, *hidden]
    shapes = []
    for i in range(len(hidden)):
        shapes += [(f"W{i}", (dims[i], dims[i + 1])), (f"b{i}", (dims[i + 1],))]
    shapes += [("wo", (dims[-1],)), ("bo", (1,))]
    if d_gmf:
        shapes += [("wg", (d_gmf,))]
    return shapes


def _unflatten(theta: np.ndarray, layout) -> dict:
    out, pos = {}, 0
    for name, shape in layout:
        n = int(np.prod(shape))
        out[name] = theta[pos:pos + n].reshape(shape)
        pos += n
    return out


def _init(layout, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = []
    for name, shape in layout:
        if name.startswith("W"):
            parts.append(rng.normal(0, math.sqrt(2.0 / shape[0]), size=shape).ravel())
        elif name in ("wo", "wg"):
            parts.append(rng.normal(0, math.sqrt(1.0 / shape[0]), size=shape).ravel())
        else:
            parts.append(np.zeros(shape).ravel())
    return np.concatenate(parts)


def _forward(p: dict, X: np.ndarray, G: np.ndarray | None, n_hidden: int):
    acts = [X]
    h = X
    for i in range(n_hidden):
        h = h @ p[f"W{i}"]
        h += p[f"b{i}"]
        np.maximum(0.0, h, out=h)
        acts.append(h)
    y = h @ p["wo"] + p["bo"][0]
    if G is not None:
        y = y + G @ p["wg"]
    return y, acts


def _grad(p: dict, X, G, y_true, n_hidden: int, g: dict) -> float:
    """The gradient, into the arrays ``g`` (of the weights' shapes); returns the squared error."""
    y, acts = _forward(p, X, G, n_hidden)
    err = y - y_true                      # d(0.5*sum err^2)/dy; the caller scales by 2/n
    np.matmul(acts[-1].T, err, out=g["wo"])
    g["bo"][0] = err.sum()
    if G is not None:
        np.matmul(G.T, err, out=g["wg"])
    delta = np.outer(err, p["wo"])
    for i in reversed(range(n_hidden)):
        delta *= acts[i + 1] > 0
        np.matmul(acts[i].T, delta, out=g[f"W{i}"])
        np.sum(delta, axis=0, out=g[f"b{i}"])
        if i > 0:
            delta = delta @ p[f"W{i}"].T
    return float((err * err).sum())


class _Adam:
    """Mini-batch Adam from given weights, its moments from zero. All arrays are updated in place."""

    def __init__(self, theta: np.ndarray, layout, n_hidden: int, cfg: "ModelConfig"):
        self.theta, self.n_hidden, self.cfg = np.array(theta, dtype=np.float64), n_hidden, cfg
        self.m1, self.m2, self.grad, self.x, self.z = (np.zeros_like(self.theta) for _ in range(5))
        self.p, self.g = _unflatten(self.theta, layout), _unflatten(self.grad, layout)
        self.t, self.loss = 0, 0.0

    def step(self, X, G, y) -> None:
        b1, b2, eps = 0.9, 0.999, 1e-8
        theta, m1, m2, grad, x, z = self.theta, self.m1, self.m2, self.grad, self.x, self.z
        self.loss += _grad(self.p, X, G, y, self.n_hidden, self.g)
        grad *= 2.0 / len(y)
        grad += np.multiply(theta, self.cfg.weight_decay, out=x)
        self.t += 1
        m1 *= b1
        m1 += np.multiply(grad, 1 - b1, out=x)
        m2 *= b2
        np.multiply(grad, 1 - b2, out=x)
        m2 += np.multiply(x, grad, out=x)
        np.sqrt(np.divide(m2, 1 - b2 ** self.t, out=z), out=z)
        z += eps
        np.multiply(np.divide(m1, 1 - b1 ** self.t, out=x), self.cfg.lr, out=x)
        theta -= np.divide(x, z, out=x)


TRAIN_SCHEMA = T.StructType([T.StructField("model", T.StringType()), T.StructField("w", T.ArrayType(T.DoubleType()))])


def _train_fn(bc, dealt: "Dealt", layouts: dict[str, list], n_hidden: int, cfg: "ModelConfig", epoch: int):
    """mapInArrow body: local mini-batch Adam of each kind over this partition's rows, starting from the
    broadcast weights; yields one vector a kind: weights·n, squared-error sum, n. Rows meet their factors
    once for all kinds, which see them in the same order."""
    def run(batches):
        from pyspark import TaskContext

        heads = {kind: _Adam(bc.value[kind], layout, n_hidden, cfg) for kind, layout in layouts.items()}
        n = 0
        tc = TaskContext.get()
        rng = np.random.default_rng([cfg.seed, epoch, tc.partitionId() if tc else 0])
        for rows, u, m, c, _ in _looked_up(batches, dealt):
            y = rows.column("rating").to_numpy(zero_copy_only=False)
            order = rng.permutation(len(y))
            u, m, c, y = u[order], m[order], c[order], y[order]
            for s in range(0, len(order), cfg.batch_size):
                some = slice(s, s + cfg.batch_size)
                for kind, adam in heads.items():
                    adam.step(*features(kind, u[some], m[some], c[some]), y[some])
            n += len(y)
        if n:   # weights·n, then the squared-error sum and the row count, as one vector
            w = [np.concatenate([a.theta * n, [a.loss, float(n)]]) for a in heads.values()]
            yield pa.RecordBatch.from_pydict({"model": pa.array(list(heads)), "w": pa.array(w, pa.list_(pa.float64()))})
    return trimmed(run)


def _pred_fn(bc, dealt: "Dealt", heads: dict[str, "MLPModel | None"], keep: list[str]):
    """mapInArrow body: for each head the kept columns of each row and its prediction. Without a head (``gmf``)
    the product of the factors, of the rows whose user and movie have one."""
    def run(batches):
        weights = {kind: _unflatten(bc.value[kind], h.layout) for kind, h in heads.items() if h}
        for rows, u, m, c, seen in _looked_up(batches, dealt):
            for kind, h in heads.items():
                if h is None:
                    y = (u.astype(np.float32) * m.astype(np.float32)).astype(np.float64).sum(axis=1)
                else:
                    X, G = features(kind, u, m, c)
                    y, _ = _forward(weights[kind], X, G, h.n_hidden)
                out = pa.RecordBatch.from_pydict({"model": pa.array([kind] * len(y)), **{k: rows.column(k) for k in keep},
                                                  "prediction": pa.array(y, pa.float64())})
                yield out if h is not None else out.filter(pa.array(seen))
    return trimmed(run)


# ------------------------------------------------------------------------ rows and factors by cell

#: Bytes of the factors of one block, which a task holds; and of the feature vectors of the rows of a cell, at least.
BLOCK_BYTES = 128 << 20
CELL_BYTES = 1 << 20
MOVIE, USER, ROW = 0, 1, 2


@dataclass
class Dealt:
    """Rows and their factors by cell, one partition a cell: in each, the factors come first."""

    table: DataFrame
    rank: int
    dim: int
    packed: bool = False

    def __getstate__(self):          # tasks take the numbers, not the table
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    def of(self, name: str) -> DataFrame:
        """The cells with the rows of one name."""
        return self.table.where((F.col("kind") < ROW) | (F.col("name") == name))


def grid(cells: int, user_bytes: int, movie_bytes: int) -> tuple[int, int]:
    """User blocks and movie blocks: as many cells as asked for, more where a block would be too large."""
    across = max(1, math.isqrt(cells), -(-user_bytes // BLOCK_BYTES))
    return across, max(1, cells // across, -(-movie_bytes // BLOCK_BYTES))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder: computed once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deal(rows: dict[str, DataFrame], user_f: DataFrame, item_f: DataFrame, content: DataFrame, dim: int,
         most: int | None = None) -> Dealt:
    """Rows (userId, movieId, ...) of each name, of the same columns, dealt to a grid with the factors and
    content vectors that occur in each cell; no row is dropped. ``most``: cells wanted at most. The whole
    row travels as the column ``row``. A factor goes to as many cells as it has rows at most, so what is
    sent grows no faster than the rows."""
    spark = user_f.sparkSession
    apply_runtime_conf(spark)
    first = user_f.select(F.size("features").alias("n")).first()
    rank = first["n"] if first else 0
    cells = max(1, min(spark.sparkContext.defaultParallelism, most or 1 << 30))
    across, down = grid(cells, 4 * rank * user_f.count(), (4 * rank + 8 * dim) * item_f.count())
    ub = F.pmod(F.xxhash64("user", F.lit("user")), F.lit(across)).cast("int")
    mb = F.pmod(F.xxhash64("movie", F.lit("movie")), F.lit(down)).cast("int")
    cell = F.col("ub") * down + F.col("mb")

    pairs = None
    for name, df in rows.items():
        rating = F.col("rating").cast("double") if "rating" in df.columns else F.lit(None).cast("double")
        x = df.select(F.lit(name).alias("name"), F.col("userId").cast("long").alias("user"), F.col("movieId").cast("long").alias("movie"),
                      rating.alias("rating"), F.struct(*df.columns).alias("row"))
        pairs = x if pairs is None else pairs.union(x)
    pairs = pairs.withColumn("ub", ub).withColumn("mb", mb)

    users = user_f.select(F.col("id").cast("long").alias("user"), F.col("features").cast("array<float>").alias("factor"))
    movies = (item_f.select(F.col("id").cast("long").alias("movie"), F.col("features").cast("array<float>").alias("factor"))
              .join(content.select(F.col("movieId").cast("long").alias("movie"), F.col("content").cast("array<double>").alias("content")),
                    "movie", "full"))

    # an empty list stands for none: Arrow's writer passes over all null lists at the end of a batch again
    # whenever its size is asked for, which Spark does at each row
    none = F.array()

    def line(kind, user, movie, name=None, rating=None, factor=none, content=none, row=None):
        return [cell.alias("cell"), F.lit(kind).cast("tinyint").alias("kind"), *[
            (F.lit(None) if c is None else c).cast(t).alias(n) for n, c, t in (
                ("user", user, "long"), ("movie", movie, "long"), ("name", name, "string"), ("rating", rating, "double"),
                ("factor", factor, "array<float>"), ("content", content, "array<double>"), ("row", row, pairs.schema["row"].dataType))]]

    def ordered(lines, order):
        return lines.withColumn("place", order)

    # factors by id; the rows of a name mixed, whatever order they came in. The sort compares a column: an
    # expression would be worked out at every comparison
    of_users = ordered(pairs.select("user", "ub", "mb").distinct().join(users, "user").select(
        *line(USER, F.col("user"), None, factor=F.col("factor"))), F.col("user"))
    of_movies = ordered(pairs.select("movie", "ub", "mb").distinct().join(movies, "movie").select(
        *line(MOVIE, None, F.col("movie"), factor=F.coalesce("factor", none.cast("array<float>")),
              content=F.coalesce("content", none.cast("array<double>")))), F.col("movie"))
    of_rows = ordered(pairs.select(*line(ROW, F.col("user"), F.col("movie"), F.col("name"), F.col("rating"), row=F.col("row"))),
                      F.xxhash64("user", "movie", "rating"))
    table = (of_movies.unionByName(of_users).unionByName(of_rows).repartitionById(across * down, F.col("cell"))
             .sortWithinPartitions("cell", "kind", "name", "place").drop("place"))
    return Dealt(table, rank, dim)


def _stretches(batch: pa.RecordBatch):
    """The stretches of a batch that have one cell, kind and name."""
    if not batch.num_rows:
        return
    code = batch.column("name").dictionary_encode().indices.fill_null(-1)
    key = np.stack([batch.column("cell").to_numpy(), batch.column("kind").to_numpy(), code.to_numpy()])
    cuts = (np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(a, b - a)


PACKED = ("cell int, kind tinyint, name string, user array<long>, movie array<long>, rating array<double>, "
          "factor array<array<float>>, content array<array<double>>")


def packed(dealt: Dealt) -> Dealt:
    """The same cells with a stretch of rows in each line, written to the checkpoint folder: three numbers a rating."""
    def run(batches):
        for batch in batches:
            for part in _stretches(batch):
                row = part.column("kind")[0].as_py() == ROW
                has = ("user", "movie", "rating") if row else ("user", "movie", "factor", "content")
                line = {c: part.slice(0, 1).column(c) for c in ("cell", "kind", "name")}
                for c in ("user", "movie", "rating", "factor", "content"):
                    x = part.column(c)
                    line[c] = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.concat_arrays([x])) if c in has else (
                        pa.nulls(1, pa.list_(x.type)))
                yield pa.RecordBatch.from_pydict(line)

    return Dealt(dealt.table.drop("row").mapInArrow(trimmed(run), PACKED).checkpoint(eager=True), dealt.rank, dealt.dim, True)


def _parts(batches, is_packed: bool):
    """The stretches of a partition of ``deal``, in order."""
    for batch in batches:
        if not is_packed:
            yield from _stretches(batch)
            continue
        for i in range(batch.num_rows):
            line = {c: batch.column(c)[i].values for c in ("user", "movie", "rating", "factor", "content")}
            n = max(len(x) for x in line.values() if x is not None)
            line = {c: pa.nulls(n, batch.schema.field(c).type.value_type) if x is None else x for c, x in line.items()}
            yield pa.RecordBatch.from_pydict({c: pa.array([batch.column(c)[i].as_py()] * n, batch.schema.field(c).type)
                                              for c in ("cell", "kind", "name")} | line)


def _there(lists: pa.Array) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy() > 0


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of one length as a matrix; zeros where a list is empty or null."""
    out = np.zeros((len(lists), width), dtype=lists.type.value_type.to_pandas_dtype())
    out[_there(lists)] = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


class _Factors:
    """Factors of one side of a cell, which come sorted by id; ``content``: whether it has content vectors."""

    def __init__(self, id_: str, rank: int, dim: int, content: bool):
        # a row of zeros at the end
        self.id, self.found = id_, None
        self.parts = [[], [], [], []]
        self.last = [np.empty(0, np.int64), np.zeros((1, rank), np.float32), np.zeros(1, bool), np.zeros((1, dim))]
        self.rank, self.dim, self.content = rank, dim, content

    def add(self, batch: pa.RecordBatch) -> None:
        factor = batch.column("factor")
        got = [batch.column(self.id).to_numpy(), _matrix(factor, self.rank), _there(factor)]
        for kept, x in zip(self.parts, [*got, _matrix(batch.column("content"), self.dim)] if self.content else got):
            kept.append(x)

    def at(self, rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Factor, whether there is one, and content of each row's id; zeros for those that have none."""
        if self.found is None:
            self.found = []
            for kept, last in zip(self.parts, self.last):       # column by column: the parts of one are held twice
                self.found.append(np.concatenate([*kept, last]))
                kept.clear()
        ids, factor, there, content = self.found
        column = rows.column(self.id)
        asked = column.fill_null(0).to_numpy(zero_copy_only=False)
        place = np.searchsorted(ids, asked)
        hit = np.append(ids, 0)[place] == asked
        hit &= (place < len(ids)) & column.is_valid().to_numpy(zero_copy_only=False)
        place[~hit] = len(ids)
        return factor[place].astype(np.float64), there[place], content[place] if self.content else None


def _looked_up(batches, dealt: Dealt):
    """(rows, user factors, movie factors, content, whether both factors are there) of a partition of ``deal``."""
    rank, dim = dealt.rank, dealt.dim
    at, sides = None, {}
    for part in _parts(batches, dealt.packed):
        cell, kind = part.column("cell")[0].as_py(), part.column("kind")[0].as_py()
        if cell != at:
            at, sides = cell, {}                # the cell before goes first
            sides = {MOVIE: _Factors("movie", rank, dim, True), USER: _Factors("user", rank, dim, False)}
        if kind != ROW:
            sides[kind].add(part)
            continue
        u, known_u, _ = sides[USER].at(part)
        m, known_m, c = sides[MOVIE].at(part)
        yield part, u, m, c, known_u & known_m


def features(kind: str, u: np.ndarray, m: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """(x, gx) of a model kind from user factors, movie factors and content."""
    if kind == "neural_cf":
        return np.hstack([u, m]), None
    if kind == "neumf":
        return np.hstack([u, m]), u * m
    if kind == "content_net":
        return np.hstack([u, c]), None
    if kind == "hybrid_net":
        return np.hstack([u, m, c]), None
    raise ValueError(kind)


@dataclass
class MLPModel:
    kind: str
    layout: list
    theta: np.ndarray
    n_hidden: int
    has_g: bool
    history: list

    def predict(self, dealt: Dealt, name: str, keep=("rating",)) -> DataFrame:
        return _predicted(dealt, name, keep, self)


def _predictions(dealt: Dealt, name: str, keep, heads: dict[str, MLPModel | None]) -> DataFrame:
    """For each head (None: the factors alone) the kept columns of the rows of one name, ``prediction`` and the
    head's name as ``model``; rows meet their factors once for all heads."""
    table = dealt.of(name)
    bc = table.sparkSession.sparkContext.broadcast({kind: h.theta for kind, h in heads.items() if h})
    types = [T.StructField("rating", T.DoubleType()) if c == "rating" else table.schema[c] for c in keep]
    return table.mapInArrow(_pred_fn(bc, dealt, heads, list(keep)), T.StructType(
        [T.StructField("model", T.StringType()), *types, T.StructField("prediction", T.DoubleType())]))


def _predicted(dealt: Dealt, name: str, keep, head: MLPModel | None) -> DataFrame:
    """The kept columns of the rows of one name, and ``prediction``: of a head, or of the factors alone."""
    return _predictions(dealt, name, keep, {head.kind if head else "gmf": head}).drop("model")


def _metrics_of(dealt: Dealt, name: str, heads: dict[str, MLPModel | None]) -> dict[str, tuple[float, float]]:
    """RMSE and MAE of each head on the rows of one name."""
    got = _grouped_metrics(_predictions(dealt, name, ["rating"], heads), "model").collect()
    found = {r["model"]: (float(r["rmse"]), float(r["mae"])) for r in got}
    if missing := set(heads) - set(found):
        raise ValueError(f"no rows {name} to predict by {sorted(missing)}")
    return found


def fit_mlps(dealt: Dealt, kinds, mean: float, cfg: ModelConfig, train: str = "train", val: str | None = None) -> dict[str, MLPModel]:
    """Data-parallel training by parameter averaging, of all kinds at once: per epoch, one Spark job in which
    every task runs mini-batch Adam (lr, weight decay) over its cell's rows starting from the
    broadcast weights; the driver averages the returned weights by row count. Adam's moments
    start anew with each epoch and task (only the weights are averaged). The driver holds only
    the weights. ``mean``: the training mean, to start from. ``train`` and ``val``: the names of the rows."""
    data = dealt.of(train)
    sc = data.sparkSession.sparkContext
    n_hidden = len(cfg.hidden)
    models = {}
    for kind in kinds:
        x, g = features(kind, *[np.zeros((1, n)) for n in (dealt.rank, dealt.rank, dealt.dim)])
        layout = _layout(x.shape[1], cfg.hidden, 0 if g is None else g.shape[1])
        theta = _init(layout, cfg.seed)
        _unflatten(theta, layout)["bo"][0] = mean            # start from the global mean
        models[kind] = MLPModel(kind, layout, theta, n_hidden, g is not None, [])
    layouts = {kind: m.layout for kind, m in models.items()}
    for epoch in range(1, cfg.epochs + 1 if models else 1):
        bc = sc.broadcast({kind: m.theta for kind, m in models.items()})
        # element-wise sum of the per-task vectors inside Spark (partial sums per task, then
        # one row per weight): the driver receives one vector a kind, not one per partition
        summed = (data.mapInArrow(_train_fn(bc, dealt, layouts, n_hidden, cfg, epoch), TRAIN_SCHEMA)
                  .select("model", F.posexplode("w").alias("i", "v")).groupBy("model", "i").agg(F.sum("v").alias("v"))
                  .orderBy("model", "i").collect())
        bc.destroy()
        if not summed:
            break
        train_rmse = {}
        for kind, m in models.items():
            vec = np.array([r["v"] for r in summed if r["model"] == kind])
            m.theta = vec[:-2] / vec[-1]
            train_rmse[kind] = math.sqrt(vec[-2] / vec[-1])      # weighted by rows
        of_val = _metrics_of(dealt, val, models) if val is not None else {}
        for kind, m in models.items():
            m.history.append({"epoch": epoch, "train_RMSE": train_rmse[kind], "val_RMSE": of_val[kind][0] if of_val else None})
    return models


def fit_mlp(dealt: Dealt, kind: str, mean: float, cfg: ModelConfig, train: str = "train", val: str | None = None) -> MLPModel:
    return fit_mlps(dealt, [kind], mean, cfg, train, val)[kind]


# ------------------------------------------------------------------------ one fitted model

@dataclass
class RatingModel:
    """A fitted model of any kind: factor tables, content table and (but for gmf) the head."""

    kind: str
    user_f: DataFrame
    item_f: DataFrame
    content: DataFrame
    dim: int
    head: MLPModel | None = None
    cells: Dealt | None = None          # the rows it was trained on, as long as the session lasts

    @property
    def history(self) -> list[dict]:
        return self.head.history if self.head else []

    def score(self, rows: DataFrame) -> DataFrame:
        """All rows with ``prediction`` (zeros stand for what the model has not seen; ``gmf`` drops those rows)."""
        dealt = deal({"rows": stored(rows, "model-rows")}, self.user_f, self.item_f, self.content, self.dim)
        keep = [c for c in ("userId", "movieId", "rating") if c in rows.columns] if self.head else rows.columns
        return _predicted(dealt, "rows", ["row"], self.head).select(*[F.col("row")[c].alias(c) for c in keep], "prediction")

    def refit(self, rows: DataFrame) -> DataFrame:
        """(rating, prediction) of the rows it was trained on."""
        return self.score(rows) if self.cells is None else _predicted(self.cells, "train", ["rating"], self.head)

    def predict(self, pairs: DataFrame) -> DataFrame:
        """(userId, movieId, ..., predicted_rating) of the pairs whose user and movie were seen
        in training; an error when there is none."""
        known = (pairs.join(self.user_f.select(F.col("id").cast("long").alias("userId")), "userId", "left_semi")
                 .join(self.item_f.select(F.col("id").cast("long").alias("movieId")), "movieId", "left_semi"))
        if known.isEmpty():
            raise ValueError("none of the pairs has a user and a movie that the model was trained on")
        return self.score(known).withColumnRenamed("prediction", "predicted_rating")

    def save(self, path: str) -> None:
        """Parquet tables under ``path``; the head last, so a partial write does not load."""
        for name, df in (("users", self.user_f), ("items", self.item_f), ("content", self.content)):
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        head = self.head
        meta = {"kind": self.kind, "dim": self.dim}
        if head:
            meta |= {"layout": [[n, list(shape)] for n, shape in head.layout], "n_hidden": head.n_hidden, "has_g": head.has_g,
                     "history": head.history}
        self.user_f.sparkSession.createDataFrame(
            [(json.dumps(meta), [float(x) for x in head.theta] if head else [])], "meta string, theta array<double>"
        ).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")

    @staticmethod
    def load(spark, path: str) -> "RatingModel":
        row = spark.read.parquet(f"{path}/model").first()
        meta = json.loads(row["meta"])
        head = None
        if "layout" in meta:
            head = MLPModel(meta["kind"], [(n, tuple(shape)) for n, shape in meta["layout"]], np.array(row["theta"]),
                            meta["n_hidden"], meta["has_g"], meta["history"])
        users, items, content = (spark.read.parquet(f"{path}/{n}") for n in ("users", "items", "content"))
        return RatingModel(meta["kind"], users, items, content, meta["dim"], head)


def training_cells(n: int, rows: dict[str, DataFrame], als, content: DataFrame, dim: int) -> Dealt:
    """The rows to train on ("train", ``n`` of them) and others dealt once, for any number of models and
    epochs. A model without a head (``gmf``) is trained before and needs only the others."""
    checkpoint_root(content.sparkSession)
    most = max(1, n * 8 * (2 * als.rank + dim) // CELL_BYTES)
    return packed(deal(rows, als.userFactors, als.itemFactors, content, dim, most))


def narrow(rows: DataFrame, name: str) -> DataFrame:
    return stored(rows.select("userId", "movieId", "rating"), name)


def fit_models(train: DataFrame, kinds, content: DataFrame, dim: int, cfg: ModelConfig,
               val: DataFrame | None = None, als=None, dealt: Dealt | None = None) -> dict[str, RatingModel]:
    """A model of each kind, over one ALS fit and one dealing of the rows; ``als``: factors fitted to the same
    rows before; ``dealt``: the rows "train" (and "val", if given) dealt before."""
    if dealt is None:
        train = narrow(train, "model-train")
    als = als or fit_als(train, cfg)
    models = {kind: RatingModel(kind, als.userFactors, als.itemFactors, content, dim) for kind in kinds}
    heads = [kind for kind in kinds if kind != "gmf"]
    if heads:
        if dealt is None:
            others = {} if val is None else {"val": narrow(val, "model-val")}
            dealt = training_cells(train.count(), {"train": train} | others, als, content, dim)
        for kind, head in fit_mlps(dealt, heads, global_mean(train), cfg, val=None if val is None else "val").items():
            models[kind].head, models[kind].cells = head, dealt
    return models


def fit_model(train: DataFrame, kind: str, content: DataFrame, dim: int, cfg: ModelConfig,
              val: DataFrame | None = None, als=None, dealt: Dealt | None = None) -> RatingModel:
    """One model of a kind (see ``fit_models``)."""
    return fit_models(train, [kind], content, dim, cfg, val, als, dealt)[kind]


# ------------------------------------------------------------------------ evaluation

ALL_KINDS = ("gmf", "neural_cf", "neumf", "content_net", "hybrid_net")


def evaluate_all(train: DataFrame, val: DataFrame, test: DataFrame, content: DataFrame, dim: int, kinds=ALL_KINDS,
                 cfg: ModelConfig = ModelConfig()) -> tuple[list[dict], dict[str, RatingModel]]:
    """Baseline + each model: val/test RMSE and MAE rows, and the fitted models by kind."""
    train, val, test = (narrow(df, f"model-{name}") for name, df in (("train", train), ("val", val), ("test", test)))
    results = [baseline_metrics(train, val, test)]
    als = fit_als(train, cfg)
    others = {"val": val, "test": test}
    dealt = training_cells(train.count(), others if tuple(kinds) == ("gmf",) else {"train": train} | others, als, content, dim)
    fitted = fit_models(train, kinds, content, dim, cfg, val, als, dealt)
    heads = {kind: m.head for kind, m in fitted.items()}
    on_val, on_test = (_metrics_of(dealt, name, heads) for name in ("val", "test"))
    for kind in kinds:
        (vr, vm), (tr, tm) = on_val[kind], on_test[kind]
        results.append({"model": MODEL_NAMES[kind], "model_type": MODEL_TYPES[kind], "val_RMSE": vr, "val_MAE": vm,
                        "test_RMSE": tr, "test_MAE": tm})
    return results, fitted


def best_kind(results: list[dict]) -> str:
    """Kind of the model with the least validation RMSE, the baseline aside."""
    models = [r for r in results if r["model_type"] != "baseline"]
    if not models:
        raise ValueError("no model was evaluated")
    best = min(models, key=lambda r: r["val_RMSE"])["model"]
    return next(k for k, name in MODEL_NAMES.items() if name == best)


def train_and_select(train: DataFrame, val: DataFrame, test: DataFrame, content: DataFrame, dim: int, kinds=ALL_KINDS,
                     cfg: ModelConfig = ModelConfig()) -> tuple[list[dict], RatingModel]:
    """All kinds fitted and compared; the best one by validation RMSE."""
    results, fitted = evaluate_all(train, val, test, content, dim, kinds, cfg)
    return results, fitted[best_kind(results)]


RESULT_SCHEMA = "model string, model_type string, val_RMSE double, val_MAE double, test_RMSE double, test_MAE double"


def comparison_table(spark, results: list[dict]) -> DataFrame:
    """Sorted by validation RMSE; ``selected`` marks the best non-baseline model."""
    df = spark.createDataFrame([tuple(r[k] for k in ("model", "model_type", "val_RMSE", "val_MAE", "test_RMSE", "test_MAE"))
                                for r in results], RESULT_SCHEMA)
    best = [r for r in results if r["model_type"] != "baseline"]
    name = MODEL_NAMES[best_kind(results)] if best else ""
    return df.withColumn("selected", F.col("model") == F.lit(name)).orderBy("val_RMSE")


def report(spark, results: list[dict], histories: dict[str, list[dict]], counts: dict[str, int], mean: float) -> DataFrame:
    """One row: the best model's block, the global mean, rows per split, every model's metrics
    and per-epoch histories."""
    best = best_kind(results)
    block = next(r for r in results if r["model"] == MODEL_NAMES[best])
    return spark.createDataFrame([(
        {k: str(v) for k, v in block.items()}, mean, counts, json.dumps(results),
        json.dumps(histories))],
        "best map<string,string>, global_mean double, row_counts map<string,long>, models string, histories string")
