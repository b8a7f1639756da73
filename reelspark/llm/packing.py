"""Best-fit packing of documents into fixed-length sequences, with certified bin counts.

Documents are encoded, ended by the end id, and cut into pieces only where they are longer
than a sequence. Pieces are dealt at random into partitions of bounded size, and each
partition is packed by best-fit decreasing. A lower bound for its pieces, the largest of
those that two families of dual-feasible functions give, certifies its number of bins: a
partition that meets the bound can't be packed better alone. What can still be gained lies
between partitions: each gives its least-filled bin to the exchange, and a partition with a
gap to its bound also gives as many further bins (least filled first) as it is over, and as
many full ones for finer choice. Exchanged pieces meet in an eighth of the partitions and
are packed again, until one partition is left. The volume exchanged falls with each round;
nothing is ever gathered but the last handful of bins.

Defined results: a null or empty text is one piece that holds the end id; a document of a
multiple of the capacity has only full pieces; rows that repeat are packed each; rows
without doc_id are packed too.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import trimmed
from ..session import apply_runtime_conf
from .components import pick, written
from .tokens import MAX_CHUNKS, encoder, texts_of

CAPACITY = 4096
END_ID = 1
PIECES_PER_PARTITION = 50_000
FAN_IN = 8


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing of these lengths needs, by dual-feasible functions.

    f(x) is dual-feasible if the values of lengths that fit one bin sum to 1 at most; then
    the sum over all lengths bounds the bins from below. Used are, for each cut c up to half
    the capacity, "x above capacity - c counts 1, x below c counts 0, else x / capacity", and
    for each whole k, "(k + 1) x / capacity, rounded down unless whole, over k"."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    number = np.concatenate(([0], np.cumsum(count)))
    volume = np.concatenate(([0], np.cumsum(count * np.arange(capacity + 1))))
    c = np.arange(capacity // 2 + 1)
    large = number[-1] - number[capacity - c + 1]
    middle = volume[capacity - c + 1] - volume[c]
    best = int((large + -(-middle // capacity)).max())
    x = np.flatnonzero(count)
    for k in range(1, 65):
        y = (k + 1) * x
        value = np.where(y % capacity == 0, k * x // capacity, y // capacity)      # times k, rounded down
        best = max(best, int(-(-(value * count[x]).sum() // k)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each piece, and the fill of each bin. Bins with
    the same space left are one stack; a bit mask over the spaces finds the tightest one."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n_bins = 0, 0
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = mask >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            b = stacks[space].pop()
            if not stacks[space]:
                mask &= ~(1 << space)
        else:
            space, b = capacity, n_bins
            n_bins += 1
        bins[i], offsets[i] = b, capacity - space
        left = space - n
        if left:
            stacks[left].append(b)
            mask |= 1 << left
    fill = np.bincount(bins, weights=lengths, minlength=n_bins).astype(np.int64)
    return bins, offsets, fill


def pieces(documents: DataFrame, tokenizer: str | None, capacity: int, max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document. ``max_chunks``: of the encoder's table,
    for memory against speed."""
    docs = pick(documents, doc_id="long", text="string")

    def cut(rows):
        e = encoder(tokenizer)
        e.max_chunks = max_chunks
        end, width = END_ID.to_bytes(4, "little"), 4 * capacity
        for batch in rows:
            row, piece, length, crc = [], [], [], []
            for a, _, texts in texts_of(batch.column("text")):
                for d, ids in enumerate(e.encode(texts), a):
                    ids += end
                    for k in range(0, len(ids), width):
                        part = ids[k:k + width]
                        row.append(d)
                        piece.append(k // width)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
            piece = np.array(piece, dtype=np.int32)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").take(pa.array(row, pa.int64())), "piece": pa.array(piece),
                "start": pa.array(piece.astype(np.int64) * capacity), "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64())})
        e.forget()

    return docs.mapInArrow(trimmed(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pack(capacity: int, round_: int, last: bool):
    def pack(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        lengths = df["length"].to_numpy()
        bins, offsets, fill = best_fit(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        keep = np.ones(len(fill), dtype=bool)
        if not last:
            order = np.argsort(fill, kind="stable")
            over = len(fill) - bound
            keep[order[:1 + over]] = False
            keep[order[len(order) - over:]] = False
        return df.assign(sequence_id=((round_ << 56) | (int(key[0]) << 28)) + bins, offset=offsets, bins=len(fill),
                         bound=bound, kept=keep[bins])[
            ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "bins", "bound", "kept"]]

    return pack


def pack_documents(spark: SparkSession, documents: DataFrame, tokenizer: str | None = None,
                   capacity: int = CAPACITY, per_partition: int = PIECES_PER_PARTITION,
                   max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """documents(doc_id, text) -> a row per piece: (doc_id, piece, start, length, ids_crc32,
    sequence_id, offset, bins, bound): the last two are the certificate of the partition
    that fixed the piece's sequence (its bins, and the lower bound for its pieces)."""
    apply_runtime_conf(spark)
    left = written(spark, pieces(documents, tokenizer, capacity, max_chunks), "packing-pieces")
    parts = max(1, -(-left.count() // per_partition))
    done, round_ = None, 0
    while True:
        bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(round_)), F.lit(parts)).cast("int")
        packed = written(spark, left.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(
            _pack(capacity, round_, parts == 1),
            PIECE + ", sequence_id long, offset long, bins long, bound long, kept boolean"), "packing-round")
        kept = packed.where("kept").drop("kept")
        done = kept if done is None else done.union(kept)
        if parts == 1:
            return done
        left = packed.where("NOT kept").select("doc_id", "piece", "start", "length", "ids_crc32")
        parts, round_ = -(-parts // FAN_IN), round_ + 1
