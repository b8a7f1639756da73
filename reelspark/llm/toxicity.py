"""Toxicity by a factorization machine over hashed terms.

A text's features are its distinct words (ASCII lower-cased) and the beginnings of 4, 5 and 6
bytes of longer ones (inflected and compound forms share them), hashed into 2 ** BITS slots.
Its margin is

    bias + sum_i w_i + sum_(i < j) <v_i, v_j>

over its slots: beside a weight, each slot has a vector of FACTORS numbers, and two terms that
mean something together only (an insult and the group it is aimed at) get vectors that fit
each other, which the weights alone cannot say. The pair sum is half of |sum_i v_i|^2 -
sum_i |v_i|^2, so a text costs its number of slots. The score is the logistic function of the
margin.

Both parts are learned by AdaGrad in numpy on the driver, on a bounded sample: about
``rows_per_label`` labelled texts with label 1 and three times as many with label 0, chosen by the hash of
their doc_id, each sent as its distinct slots (at most 2 ** BITS). Slots in fewer than
LEAST_TEXTS sampled texts say nothing (weight 0). All other work covers whole texts of all rows,
streams by, and needs no shuffle; what is broadcast is the two tables, of fixed size.

Learning looks at text and label only, and leaves out the rows whose crc32(doc_id) mod 4 is 2;
scoring looks at the text only.

Defined results: a null text, one without a word, and one with no known slot get the score of
the bias. Without labels, or with labels of one kind only, every score is the share of label 1
(0 without any). Labels that are null, or on unknown doc_ids, are not learned from; a doc_id with
several labels takes the greatest. Rows without doc_id are scored, but not learned from and not
held out. Rows that repeat are scored alike, and count once in learning.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import apply_runtime_conf
from .components import carried_type, pick
from .langid import held_out
from .words import Words, batches, mix

BITS = 17
FACTORS = 8
BEGINNINGS = (4, 5, 6)
ROWS_PER_LABEL = 2000
CLEAN_TO_TOXIC = 3
LEAST_TEXTS = 20
PAIRED = 1024
LEAST_SURPRISE = 3.0
CALIBRATION = 5
EPOCHS = 12
RATE = 0.3
DECAY = 1e-3
VECTOR_RATE = 0.1
VECTOR_DECAY = 1e-3
SPREAD = 0.05
START = 0.01
RIDGE = 1e-3
LIMIT = 0.3

U64 = np.uint64


def _beginning_table() -> np.ndarray:
    """A random value for each of the first bytes of a word and each byte, A-Z as a-z."""
    table = mix(np.arange(1, max(BEGINNINGS) * 256 + 1, dtype=U64) * U64(0xC2B2AE3D27D4EB4F)).reshape(-1, 256)
    table[:, ord("A"):ord("Z") + 1] = table[:, ord("a"):ord("z") + 1]
    return table


_BEGINNING = _beginning_table()


def slots(words: Words, alive: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, slot) of the distinct slots of all documents, by document; with ``alive`` (one
    flag for each slot) of those slots only."""
    docs, h = words.docs_of_words(), words.hashes
    found = [(docs, (h >> U64(64 - BITS)).astype(np.int64))]
    size, starts = words.ends - words.starts, words.starts
    value = np.zeros(len(h), dtype=U64)
    for j in range(max(BEGINNINGS)):
        longer = np.flatnonzero(size > j) if j else np.arange(len(h))
        value[longer] += _BEGINNING[j].take(words.data[starts[longer] + j])
        if j + 1 in BEGINNINGS:
            rest = size > j + 1
            found.append((docs[rest], (mix(value[rest] + U64(j)) >> U64(64 - BITS)).astype(np.int64)))
    docs, at = (np.concatenate(x) for x in zip(*found))
    if alive is not None:
        here = alive[at]
        docs, at = docs[here], at[here]
    both = np.unique((docs << BITS) | at)
    return both >> BITS, both & ((1 << BITS) - 1)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    bias: float
    weights: np.ndarray         # 2 ** BITS
    vectors: np.ndarray         # 2 ** BITS x factors
    alive: np.ndarray           # slots with a weight
    pairs: bool = True          # False: the additive part only
    scale: float = 1.0
    shift: float = 0.0

    def margins(self, n_docs: int, docs: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Margin of each document from the (document, slot) pairs, sorted by document."""
        out = np.full(n_docs, self.bias)
        if len(docs):
            first = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
            v = self.vectors[at]
            part = np.add.reduceat(self.weights[at], first, dtype=np.float64)
            if self.pairs:
                total = np.add.reduceat(v, first, axis=0, dtype=np.float64)
                squares = np.add.reduceat(np.einsum("ij,ij->i", v, v), first, dtype=np.float64)
                part += 0.5 * ((total * total).sum(axis=1) - squares)
            out[docs[first]] += part
        return out

    def score(self, words: Words) -> np.ndarray:
        return _logistic(self.scale * self.margins(words.n_docs, *slots(words, self.alive)) + self.shift)


def constant(share: float) -> Model:
    """The same score for every text."""
    bias = float(np.log(share / (1 - share))) if 0 < share < 1 else (40.0 if share else -40.0)
    return Model(bias, np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS, 1), np.float32), np.zeros(1 << BITS, bool))


def train(sample: list[tuple[int, np.ndarray]], pairs: bool = True, epochs: int = EPOCHS, rate: float = RATE,
          decay: float = DECAY, batch: int = 64, seed: int = 11) -> Model:
    """sample: (label, distinct slots) of each text, in a fixed order. ``pairs=False`` learns the
    additive part alone (what the pairs add can be measured with it)."""
    labels = np.array([label for label, _ in sample], dtype=np.float64)
    if not len(labels) or labels.min() == labels.max():
        return constant(float(labels.max()) if len(labels) else 0.0)
    texts = np.bincount(np.concatenate([s for _, s in sample]), minlength=1 << BITS)
    alive = texts >= min(LEAST_TEXTS, max(2, len(sample) // 100))
    known = np.flatnonzero(alive)
    dense = np.full(1 << BITS, -1)
    dense[known] = np.arange(len(known))
    rows = [dense[s[alive[s]]] for _, s in sample]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    check, learn = order[:len(order) // CALIBRATION], order[len(order) // CALIBRATION:]
    w, v = np.zeros(len(known), np.float32), rng.normal(0, SPREAD, (len(known), FACTORS)).astype(np.float32)
    share = labels[learn].mean()
    mine = np.concatenate([rows[i] for i in learn])
    seen = np.bincount(mine, minlength=len(known))
    toxic = np.bincount(mine, np.repeat(labels[learn], [len(rows[i]) for i in learn]), minlength=len(known))
    surprise = np.abs(toxic - share * seen) / np.sqrt(np.maximum(share * (1 - share) * seen, 1e-9))
    v[np.argsort(-surprise, kind="stable")[PAIRED:]] = 0              # zero vectors stay zero
    v[surprise < LEAST_SURPRISE] = 0
    w_seen, v_seen = np.full(len(known), START, np.float32), np.full((len(known), FACTORS), START, np.float32)
    bias, bias_seen = float(np.log(labels.mean() / (1 - labels.mean()))), START
    for epoch in range(epochs):
        paired = pairs and epoch >= epochs // 3      # the vectors learn what the weights leave
        order = rng.permutation(learn)
        for a in range(0, len(order), batch):
            chosen = order[a:a + batch]
            sizes = np.array([len(rows[i]) for i in chosen])
            at = np.concatenate([rows[i] for i in chosen])
            if not len(at):
                continue
            of = np.repeat(np.arange(len(chosen)), sizes)
            slot, inverse = np.unique(at, return_inverse=True)
            x = np.zeros((len(chosen), len(slot)), np.float32)                # a batch of texts by its slots
            x[of, inverse] = 1.0
            ws, vs = w[slot], v[slot]
            total = x @ vs
            margin = bias + x @ ws
            if paired:
                margin += 0.5 * ((total * total).sum(axis=1) - x @ (vs * vs).sum(axis=1))
            error = ((_logistic(margin) - labels[chosen]) / len(chosen)).astype(np.float32)
            back = x.T @ error
            gradient = back + decay * ws
            w_seen[slot] += gradient * gradient
            w[slot] = ws - rate * gradient / np.sqrt(w_seen[slot])
            bias_seen += float(error.sum()) ** 2
            bias -= rate * float(error.sum()) / bias_seen ** 0.5
            if paired:
                gradient = x.T @ (error[:, None] * total) - back[:, None] * vs + VECTOR_DECAY * vs
                v_seen[slot] += gradient * gradient
                v[slot] = vs - VECTOR_RATE * gradient / np.sqrt(v_seen[slot])
    weights, vectors = np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS, FACTORS), np.float32)
    weights[known], vectors[known] = w, v
    model = Model(bias, weights, vectors, alive, pairs)
    held = [sample[i][1][alive[sample[i][1]]] for i in check]
    docs, at = np.repeat(np.arange(len(held)), [len(h) for h in held]), np.concatenate([*held, np.empty(0, np.int64)])
    model.scale, model.shift = calibrated(model.margins(len(held), docs, at), labels[check])
    return model


def calibrated(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Scale and shift that fit the logistic function of scaled margins to labels not learned
    from; the labels are smoothed by one text of the other kind."""
    n = np.array([(labels == 0).sum(), (labels == 1).sum()])
    if not n.all():
        return 1.0, 0.0
    target = np.where(labels == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    weight = np.full(len(labels), 1 / len(labels))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    start = np.array([1.0, 0.0])
    fit = start

    def loss(f):
        z = x @ f
        return (weight * (np.logaddexp(0, z) - target * z)).sum() + RIDGE * ((f - start) ** 2).sum()

    for _ in range(50):                                     # Newton's method with halved steps
        p = _logistic(x @ fit)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 2 * RIDGE * np.eye(2),
                               x.T @ (weight * (p - target)) + 2 * RIDGE * (fit - start))
        size = 1.0
        while size > 1e-3 and loss(fit - size * step) > loss(fit):
            size /= 2
        fit = fit - size * step
    return (float(fit[0]), float(fit[1])) if fit[0] > 0 else (1.0, 0.0)


def sample(spark: SparkSession, documents: DataFrame, labels: DataFrame,
           rows_per_label: int = ROWS_PER_LABEL) -> list[tuple[int, np.ndarray]]:
    """(label, distinct slots) of the sampled texts, in the order of label, doc_id and slots. The
    chance of a row follows from a count of its label; doc_ids are chosen by their hash."""
    marked = (pick(labels, doc_id="long", toxic="int").where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out())
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    number = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bound = {1: rows_per_label, 0: CLEAN_TO_TOXIC * rows_per_label}
    share = F.when(F.col("toxic") == 1, F.lit(bound[1] / max(number.get(1, 0), 1))).otherwise(F.lit(bound[0] / max(number.get(0, 0), 1)))
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(13)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = marked.where(place < share)                              # about the two bounds, whatever the input's size
    texts = (pick(documents, doc_id="long", text="string").where("doc_id IS NOT NULL AND text IS NOT NULL")
             .join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "text"]))

    def take(rows):
        for batch in rows:
            found = []
            for a, b, words in batches(batch.column("text"), "alnum", lower=True):
                docs, at = slots(words)
                found += np.split(at, np.searchsorted(docs, np.arange(1, b - a)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"),
                                              "slots": pa.array([f.astype("<u4").tobytes() for f in found], pa.binary())})

    got = texts.mapInArrow(take, "doc_id long, toxic int, slots binary").collect()
    got.sort(key=lambda r: (r["toxic"], r["doc_id"], bytes(r["slots"])))
    return [(r["toxic"], np.frombuffer(r["slots"], "<u4").astype(np.int64)) for r in got]


def fit(spark: SparkSession, documents: DataFrame, labels: DataFrame, rows_per_label: int = ROWS_PER_LABEL) -> Model:
    """Learns from the labelled texts that are not held out."""
    return train(sample(spark, documents, labels, rows_per_label))


def classify(spark: SparkSession, documents: DataFrame, labels: DataFrame | None = None, model: Model | None = None,
             limit: float = LIMIT, carry: list[str] = ()) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, held_out, score, predicted), and the columns named in
    ``carry`` as one struct column ``carried``. A model is fitted to ``labels(doc_id, toxic)``
    unless one is given."""
    apply_runtime_conf(spark)
    docs = pick(documents, list(carry), doc_id="long", text="string").withColumn("held_out", held_out())
    shared = spark.sparkContext.broadcast(model or fit(spark, documents, labels))

    def predict(rows):
        m: Model = shared.value
        for batch in rows:
            parts = [m.score(words) for _, _, words in batches(batch.column("text"), "alnum", lower=True)]
            score = np.concatenate(parts) if parts else np.empty(0)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": pa.array(score),
                "predicted": pa.array((score >= limit).astype(np.int32)), "carried": batch.column("carried")})

    out = docs.mapInArrow(predict, f"doc_id long, held_out boolean, score double, predicted int, carried {carried_type(docs)}")
    return out if carry else out.drop("carried")
