"""Periodic run detection: an online sparse dynamic programme over the diagonals of a text.

A run is a stretch of words with smallest period q (words q apart are identical) that no
neighbouring word extends, of at least ``max(least, times * q)`` words.

Word i lies on the diagonal of lag q when it equals word i - q. A run is a stretch of words on
one diagonal; going through the words, a lag is active while its match length grows by one
with every word, and when it ends with a sufficient length the run is emitted. Frequent words
have too many earlier occurrences to keep all their lags, so only lags that can belong to a
run become active: a run of period q holds at least (times - 1) * q >= 2q words on its
diagonal, so for lags in (K / 2, K] it holds a sequence of K words that occurred q words
before. Those K words cover a period, so within the run q is the distance to their *nearest*
earlier occurrence, and a smaller distance would be a smaller period. Therefore, for K = 1, 2,
4, ... each place has at most one active lag, the distance to the nearest earlier occurrence
of the K words from there on; the match length of that lag grows while the next place has the
same lag, and what ends with sufficient length is a run with smallest period q. Sequences of
2K words are pairs of sequences of K words, and only places whose sequence occurs twice in
the document stay, so most texts are done after a few K.

All places of a batch of documents (bounded bytes, or one longer text) take a step together,
in numpy; the work is n log n for any text, however often its words occur, and the memory of a
task follows its longest single text. There is no shuffle.

Defined results: a null text, or one without words, has no runs and its collapsed text is
empty. Rows without doc_id and rows that repeat are worked like all others. An empty table
gives an empty one. 64-bit hashes stand for words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import apply_runtime_conf
from .components import carried_type, pick
from .words import Words, batches

LEAST = 6
TIMES = 4
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS = "array<struct<start long, length long, period long>>"


def nearest_earlier(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sequences ``ids`` at the ascending places ``at``: the lag to the nearest earlier place
    with the same id (0: none), and which of them occur more than once."""
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    lag = np.zeros(len(ids), dtype=np.int64)
    lag[order[1:][same]] = (at[order[1:]] - at[order[:-1]])[same]
    twice = np.zeros(len(ids), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return lag, twice


def ended(lag: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First entry and number of steps of every maximal stretch of consecutive places with one lag."""
    go_on = (at[1:] == at[:-1] + 1) & (lag[1:] == lag[:-1])
    first = np.flatnonzero(np.append(True, ~go_on))
    return first, np.diff(np.append(first, len(lag)))


def find(words: Words, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, period) of all runs of the documents, by document, start and period."""
    n = len(words)
    docs = words.docs_of_words()
    at = np.arange(n)
    _, ids = np.unique(words.hashes, return_inverse=True)
    ids = ids.astype(np.int64) * max(words.n_docs, 1) + docs         # sequences of one document only
    starts, lengths, periods = [], [], []
    k = 1
    while len(at):
        lag, twice = nearest_earlier(ids, at)
        active = np.flatnonzero((lag > k // 2) & (lag <= k))
        if len(active):
            first, steps = ended(lag[active], at[active])
            q = lag[active][first]
            length = steps + q + (k - 1)
            enough = length >= np.maximum(least, times * q)
            starts.append((at[active][first] - q)[enough])
            lengths.append(length[enough])
            periods.append(q[enough])
        # sequences of 2k words: two of k words that both occur twice
        at, ids = at[twice], ids[twice]
        if not len(at):
            break
        _, ids = np.unique(ids, return_inverse=True)
        after = np.minimum(np.searchsorted(at, at + k), len(at) - 1)
        pair = (at[after] == at + k) & (docs[at[after]] == docs[at])
        ids = (ids.astype(np.int64) * (int(ids.max()) + 1) + ids[after])[pair]
        at = at[pair]
        k *= 2
    if not starts:
        none = np.empty(0, dtype=np.int64)
        return none, none, none
    start, length, period = (np.concatenate(x) for x in (starts, lengths, periods))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def collapsed(words: Words, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> Iterator[str]:
    """Each document's words, without those that a run holds after its first period, joined by
    one space."""
    n = len(words)
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, start + length, -1)
    keep = np.cumsum(cover[:-1]) == 0
    size = np.where(keep, words.ends - words.starts + 1, 0)         # with the space after it
    out = np.full(int(size.sum()), 0x20, dtype=np.uint8)
    place = np.concatenate(([0], np.cumsum(size)))
    kept = np.flatnonzero(keep)
    if len(kept):
        lengths = words.ends[kept] - words.starts[kept]
        shift = np.repeat(words.starts[kept], lengths)
        inside = np.arange(len(shift)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[np.repeat(place[kept], lengths) + inside] = words.data[shift + inside]
    raw = out.tobytes()
    for a, b in zip(place[words.bounds[:-1]].tolist(), place[words.bounds[1:]].tolist()):
        yield raw[a:max(b - 1, a)].decode("utf-8", "replace")


def find_runs(spark: SparkSession, documents: DataFrame, least: int = LEAST, times: int = TIMES,
              carry: list[str] = ()) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, n_words, runs, collapsed), and the columns named in
    ``carry`` as one struct column ``carried``: the runs by start, then period, and the words left
    when each run keeps its first period only, joined by one space. ``times`` is 3 at least (the
    step from K to 2K needs 2q words on the diagonal)."""
    if times < 3 or least < 2:
        raise ValueError("runs have three periods and two words at least")
    apply_runtime_conf(spark)
    docs = pick(documents, list(carry), doc_id="long", text="string")

    def scan(rows):
        for batch in rows:
            n_words, bounds, texts = [], [0], []
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for _, _, words in batches(batch.column("text")):
                start, length, period = find(words, least, times)
                n_words.append(np.diff(words.bounds))
                cut = np.searchsorted(start, words.bounds[1:])
                own = np.searchsorted(words.bounds, start, side="right") - 1
                found.append((start - words.bounds[own], length, period))
                texts += list(collapsed(words, start, length, period))
                bounds += (cut + bounds[-1]).tolist()
            start, length, period = (np.concatenate(x) if found else np.empty(0, np.int64)
                                     for x in (zip(*found) if found else ((), (), ())))
            runs = pa.ListArray.from_arrays(
                pa.array(bounds, pa.int32()),
                pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(RUN)))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "n_words": pa.array(np.concatenate(n_words) if n_words else [], pa.int64()),
                "runs": runs, "collapsed": pa.array(texts, pa.string()), "carried": batch.column("carried")})

    out = docs.mapInArrow(scan, f"doc_id long, n_words long, runs {RUNS}, collapsed string, carried {carried_type(docs)}")
    return out if carry else out.drop("carried")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; the first of equal ones."""
    return F.aggregate(runs, F.lit(None).cast(RUNS[6:-1]), lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def digest(found: DataFrame) -> DataFrame:
    """Per document: number of runs, the strongest one, and digests of all runs and the text left."""
    best = found.withColumn("best", strongest(F.col("runs")))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(F.expr("1000 * best.length div best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))


def with_planted_tails(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text) in which every tenth text, by the crc32 h of its doc_id, ends
    periodically: with g = h div 10, n its words and a = g mod n, word i >= a becomes the original
    word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8). Other texts, and rows without
    doc_id, stay as they are."""
    docs = pick(documents, doc_id="long", text="string")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    # regexp_extract_all runs for the texts concerned only
    docs = docs.withColumn("h", h).withColumn(
        "w", F.expr(r"CASE WHEN h % 10 = 0 THEN regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0) END"))
    docs = docs.withColumn("n", F.size("w").cast("long")).withColumn("g", F.expr("h div 10"))
    docs = docs.withColumn("a", F.expr("CASE WHEN n > 0 THEN g % n END"))
    docs = docs.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = F.expr("concat_ws(' ', transform(w, (x, i) -> IF(i < a, x, element_at(w, CAST(1 + a + (i - a) % p AS INT)))))")
    return docs.select("doc_id", F.when(F.col("a").isNotNull(), tail).otherwise(F.col("text")).alias("text"))
