"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its subwords (byte sequences of 3 and 4 of the
lower-cased text that touch a word border at their ends only), hashed into a fixed number of
rows; a linear layer and a softmax give the languages' probabilities. Both layers are
trained by stochastic gradient descent in numpy on the driver, on a bounded sample: at most
``rows_per_language`` labelled rows of each language, chosen by the hash of their doc_id,
each sent as its subword counts (bounded by the number of rows of the table). All other
work covers whole texts of all rows. For prediction the two layers are one table of a
number per subword and language, so a text costs one lookup per subword.

A fifth of the sample is kept for calibration: a temperature fits the probabilities to it,
and the rejection limit is the highest score (below a half) that would still reject at
most ``reject_share`` of its rightly classified rows.

Defined results: a null text or one without a letter is ``und`` with score 0, rejected.
Without any labelled row everything is ``und``. Equal scores go to the first language in
alphabetical order. Rows without doc_id are classified, but not learned from and not held
out. Rows that repeat are classified alike.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrow import trimmed
from ..session import apply_runtime_conf
from .components import carried_type, pick
from .words import slices

BITS = 15
DIM = 16
ROWS_PER_LANGUAGE = 600
EPOCHS = 6
RATE = 4.0
REJECT_SHARE = 0.002
UNDETERMINED = "und"

_LETTER = re.compile(r"[^\W\d_]")
#: ASCII bytes that are not letters are borders.
_BORDERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def _subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all subwords of the texts (2 ** BITS: not a subword) for every byte and
    length, and the texts' offsets: entries of a text lie at [offset, next offset) of both
    columns."""
    raw = [b" %s " % t.lower().encode("utf-8", "surrogatepass").translate(_BORDERS) for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    b = np.frombuffer(b"".join(raw) + b"   ", dtype=np.uint8)
    n = len(b) - 3
    border = b == 0x20
    v = b[:n].astype(np.uint32)
    v <<= np.uint32(8)
    v |= b[1:n + 1]
    v <<= np.uint32(8)
    v |= b[2:n + 2]
    out = np.empty((2, n), dtype=np.uint32)
    out[0] = (v * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    out[0][border[1:n + 1]] = 1 << BITS
    v <<= np.uint32(8)
    v |= b[3:n + 3]
    out[1] = (v * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)
    out[1][border[1:n + 1] | border[2:n + 2]] = 1 << BITS
    ends = offsets[1:]
    for length in (3, 4):                # those that run over the text's end
        for back in range(1, length):
            out[length - 3][ends - back] = 1 << BITS
    return out, offsets


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray          # languages x (2 ** BITS + 1), the last column 0
    bias: np.ndarray
    temperature: float = 1.0
    limit: float = 0.0

    def logits(self, texts: list[str]) -> np.ndarray:
        found, offsets = _subwords(texts)
        starts = offsets[:-1]
        number = np.add.reduceat((found < 1 << BITS).sum(axis=0), starts).astype(np.float64)
        out = np.empty((len(texts), len(self.languages)))
        for k, row in enumerate(self.table):
            out[:, k] = np.add.reduceat(row.take(found[0]) + row.take(found[1]), starts, dtype=np.float64)
        return (out / np.maximum(number, 1)[:, None] + self.bias) / self.temperature

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of each text."""
        out = [(UNDETERMINED, 0.0, True)] * len(texts)
        rows = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.languages else []
        if rows:
            p = _softmax(self.logits([texts[i] for i in rows]))
            best = p.argmax(axis=1)
            for i, k, score in zip(rows, best.tolist(), p.max(axis=1).tolist()):
                out[i] = (self.languages[k], min(score, 1.0), score < self.limit)
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(sample: list[tuple[str, np.ndarray, np.ndarray]], reject_share: float = REJECT_SHARE,
          epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """sample: (language, subword rows, their counts) of each labelled text, in a fixed order."""
    languages = sorted({lang for lang, _, _ in sample})
    if not languages:
        return Model([], np.zeros((0, (1 << BITS) + 1), dtype=np.float32), np.zeros(0))
    of = {lang: k for k, lang in enumerate(languages)}
    rng = np.random.default_rng(seed)
    embedding = rng.uniform(-1 / DIM, 1 / DIM, ((1 << BITS) + 1, DIM))
    weights, bias = np.zeros((DIM, len(languages))), np.zeros(len(languages))
    order = rng.permutation(len(sample))
    check, learn = order[:len(order) // 5], order[len(order) // 5:]
    total = max(1, epochs * len(learn))
    for step, i in enumerate(np.concatenate([rng.permutation(learn) for _ in range(epochs)]) if len(learn) else []):
        lang, rows, counts = sample[i]
        share = counts / counts.sum()
        mean = share @ embedding[rows]
        error = _softmax(mean @ weights + bias)
        error[of[lang]] -= 1
        lr = rate * (1 - step / total)
        back = weights @ error
        weights -= lr * np.outer(mean, error)
        bias -= 0.01 * lr * error
        embedding[rows] -= lr * np.outer(share, back)
    table = np.zeros((len(languages), (1 << BITS) + 1), dtype=np.float32)
    table[:, :-1] = (embedding[:-1] @ weights).T
    model = Model(languages, table, bias)
    if len(check):
        logits = np.array([table[:, sample[i][1]] @ (sample[i][2] / sample[i][2].sum()) + bias for i in check])
        truth = np.array([of[sample[i][0]] for i in check])
        at = np.arange(len(check))

        def loss(t):
            return -np.log(np.maximum(_softmax(logits / t)[at, truth], 1e-12)).mean()

        model.temperature = min(2.0 ** np.linspace(-3, 4, 57), key=loss)
        p = _softmax(logits / model.temperature)
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == truth])
        if len(right):
            model.limit = float(min(0.5, right[int(reject_share * len(right))]))
    return model


def held_out(doc_id="doc_id"):
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(spark: SparkSession, documents: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Learns from text and lang of rows that are not held out."""
    sample = (documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
              .select("lang", F.col("doc_id"), F.xxhash64("text").alias("t")))
    chosen = (sample.select("lang", "doc_id", "t", F.row_number().over(
        Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "t")).alias("r"))
        .where(F.col("r") <= rows_per_language).drop("r").distinct())
    texts = (documents.select("lang", "doc_id", "text").withColumn("t", F.xxhash64("text"))
             .join(F.broadcast(chosen), ["lang", "doc_id", "t"], "left_semi").select("lang", "doc_id", "text"))

    def count(rows):
        for batch in rows:
            lang, ids, blobs, counts = [], [], [], []
            for name, doc, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "doc_id", "text"))):
                if not _LETTER.search(text):
                    continue
                found, _ = _subwords([text])
                row, n = np.unique(found, return_counts=True)
                row, n = row[row < 1 << BITS], n[row < 1 << BITS]
                if len(row):
                    lang.append(name)
                    ids.append(doc)
                    blobs.append(row.astype("<u2").tobytes())
                    counts.append(n.astype("<u4").tobytes())
            yield pa.RecordBatch.from_pydict({"lang": pa.array(lang, pa.string()), "doc_id": pa.array(ids, pa.int64()),
                                              "rows": pa.array(blobs, pa.binary()), "counts": pa.array(counts, pa.binary())})

    found = texts.mapInArrow(trimmed(count), "lang string, doc_id long, rows binary, counts binary").collect()
    found.sort(key=lambda r: (r["lang"], r["doc_id"], bytes(r["rows"])))
    return train([(r["lang"], np.frombuffer(r["rows"], "<u2").astype(np.int64), np.frombuffer(r["counts"], "<u4").astype(np.float64))
                  for r in found])


def classify(spark: SparkSession, documents: DataFrame, model: Model | None = None, carry: list[str] = ()) -> DataFrame:
    """documents(doc_id, text, lang) -> (doc_id, text, held_out, lang_pred, score, rejected),
    and the columns named in ``carry`` as one struct column ``carried``."""
    apply_runtime_conf(spark)
    docs = pick(documents, list(carry), doc_id="long", text="string", lang="string")
    shared = spark.sparkContext.broadcast(model or fit(spark, docs))

    def predict(rows):
        m: Model = shared.value
        for batch in rows:
            texts = batch.column("text").to_pylist()
            offsets = np.concatenate(([0], np.cumsum([len(t or "") + 2 for t in texts]))) if texts else np.zeros(1, np.int64)
            found = [p for a, b in slices(offsets, 1 << 18) for p in m.predict(texts[a:b])]
            lang, score, rejected = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "text": batch.column("text"), "held_out": batch.column("held_out"),
                "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()),
                "rejected": pa.array(rejected, pa.bool_()), "carried": batch.column("carried")})

    out = docs.drop("lang").withColumn("held_out", held_out())
    out = out.mapInArrow(trimmed(predict), "doc_id long, text string, held_out boolean, lang_pred string, score double, "
                                  f"rejected boolean, carried {carried_type(out)}")
    return out if carry else out.drop("carried")
