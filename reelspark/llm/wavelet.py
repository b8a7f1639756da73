"""Token ids as wavelet-matrix files: one compressed file per shard of documents.

A shard holds consecutive documents (ascending doc_id) as one sequence of token ids. Its
wavelet matrix has one bit-plane per bit of an id, highest first; each plane is the ids'
bits after the ids were split, in order, into those with the previous bit 0 and 1. With the
count of ones before each block of a plane, rank and select answer, from the file alone:
the token at a place, how often a token occurs in a range, and where its k-th
occurrence is. Planes are compressed in blocks, and a query reads only the blocks it needs.

File format (little-endian): ``WVM1``; u32 length of a JSON header; the header (tokens,
levels, docs, and the byte ranges of what follows); doc ids (i64) with a null flag each
(u8) and lengths (u32), compressed; per level the compressed blocks' ends (u64) and the ones
before each block (u64), and the blocks (2 ** 16 bits each), compressed by zstd.

Spark job: documents are encoded where they are read, dealt by doc_id ranges, sorted, and
cut into shards as they stream by; a shard is one record, written by Spark's committer (so
a lost executor leaves no half file) as one file of the output folder. The ranges come
from the quantiles of doc_id over all rows.

Defined results: a null or empty text has only its end id. Rows that repeat are kept, side
by side. Rows without doc_id come first. An empty table gives no shard.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import apply_runtime_conf, scratch_path
from .components import pick
from .tokens import encoder, texts_of

BLOCK = 1 << 16
SHARD_TOKENS = 1 << 20
ROWS_PER_PART = 10_000
END_ID = 1


def encode_shard(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """The file of some documents: all their ids in a row, and the documents' lengths."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    docs = b"".join((np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
                     np.array([d is None for d in doc_ids], dtype="u1").tobytes(),
                     lengths.astype("<u4").tobytes()))
    parts, ranges, at = [], [], 0

    def add(blob: bytes) -> list[int]:
        nonlocal at
        parts.append(blob)
        at += len(blob)
        return [at - len(blob), at]

    header = {"tokens": len(ids), "levels": levels, "docs": len(doc_ids), "doc_range": add(squeeze(docs)), "planes": ranges}
    x = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    for level in range(levels):
        bit = (x & x.dtype.type(1 << (levels - 1 - level))) != 0
        packed = np.packbits(bit)
        blocks = [squeeze(packed[i:i + BLOCK // 8]) for i in range(0, len(packed), BLOCK // 8)]
        counted = np.bitwise_count(packed)
        ones = [int(counted[i:i + BLOCK // 8].sum(dtype=np.int64)) for i in range(0, len(packed), BLOCK // 8)]
        before = np.concatenate(([0], np.cumsum(ones, dtype=np.int64)))
        ranges.append({"ones": int(before[-1]), "blocks": len(blocks),
                       "before": add(before[:-1].astype("<u8").tobytes()),
                       "ends": add(np.cumsum([len(b) for b in blocks]).astype("<u8").tobytes()),
                       "data": add(b"".join(blocks))})
        if level + 1 < levels:
            x = np.concatenate((x.take(np.flatnonzero(~bit)), x.take(np.flatnonzero(bit))))
    head = json.dumps(header).encode()
    return b"".join((b"WVM1", len(head).to_bytes(4, "little"), head, *parts))


class WaveletFile:
    """Reads the bytes of one file. Positions count the shard's tokens from 0."""

    def __init__(self, blob: bytes):
        blob = memoryview(blob)
        if blob[:4] != b"WVM1":
            raise ValueError("not a wavelet-matrix file")
        n = int.from_bytes(blob[4:8], "little")
        self.header = json.loads(bytes(blob[8:8 + n]))
        self.body = blob[8 + n:]
        self.n, self.levels = self.header["tokens"], self.header["levels"]
        self.planes = self.header["planes"]
        docs, k = self._unpacked(self.header["doc_range"]), self.header["docs"]
        null = np.frombuffer(docs, dtype="u1", count=k, offset=8 * k)
        self.doc_ids = [None if z else int(d) for d, z in zip(np.frombuffer(docs, "<i8", k), null)]
        self.lengths = np.frombuffer(docs, "<u4", k, 9 * k).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.block = lru_cache(maxsize=256)(self._block)

    def _unpacked(self, span: list[int]) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.body[span[0]:span[1]])

    def _numbers(self, span: list[int]) -> np.ndarray:
        return np.frombuffer(self.body[span[0]:span[1]], dtype="<u8")

    def _block(self, level: int, b: int) -> bytes:
        plane = self.planes[level]
        ends = self._numbers(plane["ends"])
        first = plane["data"][0]
        return self._unpacked([first + int(ends[b - 1] if b else 0), first + int(ends[b])])

    def _ones(self, level: int, i: int) -> int:
        """Ones of the plane before place i."""
        b, rest = divmod(i, BLOCK)
        if i >= self.n:
            return self.planes[level]["ones"]
        total = int(self._numbers(self.planes[level]["before"])[b])
        if rest:
            raw = self.block(level, b)
            total += int.from_bytes(raw[:rest // 8], "big").bit_count()
            if rest % 8:
                total += (raw[rest // 8] >> (8 - rest % 8)).bit_count()
        return total

    def _down(self, level: int, i: int, bit: int) -> int:
        ones = self._ones(level, i)
        return self.n - self.planes[level]["ones"] + ones if bit else i - ones

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for level in range(self.levels):
            b, rest = divmod(i, BLOCK)
            bit = self.block(level, b)[rest // 8] >> (7 - rest % 8) & 1
            token = token << 1 | bit
            i = self._down(level, i, bit)
        return token

    def _range(self, token: int, a: int, b: int) -> tuple[int, int]:
        for level in range(self.levels):
            bit = token >> (self.levels - 1 - level) & 1
            a, b = self._down(level, a, bit), self._down(level, b, bit)
        return a, b

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        """Occurrences of the token in places a to b - 1."""
        b = self.n if b is None else b
        if token >> self.levels or a >= b:
            return 0
        a, b = self._range(token, a, b)
        return b - a

    def select(self, token: int, k: int) -> int | None:
        """Place of the token's occurrence number k (from 0), or None."""
        if k < 0 or k >= self.count(token):
            return None
        i = self._range(token, 0, self.n)[0] + k
        for level in reversed(range(self.levels)):
            bit = token >> (self.levels - 1 - level) & 1
            zeros = self.n - self.planes[level]["ones"]
            rank = i - zeros if bit else i
            lo, hi = 0, self.n - 1                      # the place with ``rank`` such bits before it
            while lo < hi:
                mid = (lo + hi) // 2 + 1
                ones = self._ones(level, mid)
                if (ones if bit else mid - ones) <= rank:
                    lo = mid
                else:
                    hi = mid - 1
            i = lo
        return i

    def doc(self, d: int) -> list[int]:
        """The ids of the shard's document number d."""
        return [self.access(i) for i in range(self.starts[d], self.starts[d] + self.lengths[d])]

    def tokens(self) -> np.ndarray:
        """All ids, rebuilt plane by plane from the lowest bit up."""
        x = np.zeros(self.n, dtype=np.uint16 if self.levels <= 16 else np.uint32)
        for level in reversed(range(self.levels)):
            plane = self.planes[level]
            packed = b"".join(self._block(level, b) for b in range(plane["blocks"]))
            bit = np.unpackbits(np.frombuffer(packed, dtype=np.uint8), count=self.n).view(bool)
            zeros = self.n - plane["ones"]
            up = np.empty_like(x)
            up[np.flatnonzero(~bit)] = x[:zeros]
            up[np.flatnonzero(bit)] = x[zeros:] | x.dtype.type(1 << (self.levels - 1 - level))
            x = up
        return x


def id_type(n_ids: int) -> str:
    return "<u2" if n_ids <= 1 << 16 else "<u4"


def encode_documents(spark: SparkSession, documents: DataFrame, tokenizer: str | None = None,
                     rows_per_part: int = ROWS_PER_PART) -> tuple[DataFrame, int]:
    """(doc_id, part, ids) of every document, and the number of parts: part numbers follow
    doc_id. ``ids`` are little-endian numbers, the end id included, of 16 bits where the
    vocabulary fits and of 32 bits elsewhere (``id_type``): they are the bulk of the shuffle."""
    docs = pick(documents, doc_id="long", text="string")
    parts = max(1, -(-docs.count() // rows_per_part))
    at = [i / parts for i in range(1, parts)]
    bounds = docs.agg(F.percentile_approx("doc_id", at, 100 * parts).alias("b")).first()["b"] if at else []
    bounds = spark.sparkContext.broadcast(np.array(bounds or [], dtype=np.int64))

    def encode(rows):
        e = encoder(tokenizer)
        end, narrow = END_ID.to_bytes(4, "little"), id_type(e.n_ids)
        for batch in rows:
            ids = batch.column("doc_id")
            part = np.searchsorted(bounds.value, ids.fill_null(np.iinfo(np.int64).min).to_numpy(), side="left")
            for a, b, texts in texts_of(batch.column("text")):
                yield pa.RecordBatch.from_pydict({
                    "doc_id": ids.slice(a, b - a), "part": pa.array(part[a:b].astype(np.int32)),
                    "ids": pa.array([np.frombuffer(x + end, "<u4").astype(narrow).tobytes() for x in e.encode(texts)], pa.binary())})
        e.forget()

    return docs.mapInArrow(encode, "doc_id long, part int, ids binary"), parts


def write_shards(spark: SparkSession, documents: DataFrame, path: str, tokenizer: str | None = None,
                 rows_per_part: int = ROWS_PER_PART, shard_tokens: int = SHARD_TOKENS) -> None:
    """One file per shard in the folder ``path`` (any store Spark writes to)."""
    apply_runtime_conf(spark)
    encoded, parts = encode_documents(spark, documents, tokenizer, rows_per_part)

    def shards(rows):
        kind = id_type(encoder(tokenizer).n_ids)
        held: list[np.ndarray] = []
        docs: list[int | None] = []
        part, shard, start, size = -1, 0, 0, 0

        def close():
            nonlocal held, docs, shard, start, size
            ids = np.concatenate(held)
            row = {"part": [part], "shard": [shard], "start_in_part": [start], "n_tokens": [size], "n_docs": [len(docs)],
                   "file": [encode_shard(ids, docs, np.array([len(h) for h in held]))]}
            held, docs, shard, start, size = [], [], shard + 1, start + size, 0
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([
                ("part", pa.int32()), ("shard", pa.int32()), ("start_in_part", pa.int64()),
                ("n_tokens", pa.int64()), ("n_docs", pa.int64()), ("file", pa.binary())]))

        for batch in rows:
            for doc, p, ids in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), batch.column("ids")):
                if held and (p != part or size >= shard_tokens):
                    yield close()
                if p != part:
                    part, shard, start = p, 0, 0
                held.append(np.frombuffer(ids.as_buffer(), dtype=kind))
                docs.append(doc)
                size += len(held[-1])
        if held:
            yield close()

    (encoded.repartition(2 * parts, "part").sortWithinPartitions("part", "doc_id", "ids")
     .mapInArrow(shards, "part int, shard int, start_in_part long, n_tokens long, n_docs long, file binary")
     .write.option("maxRecordsPerFile", 1).option("compression", "none").parquet(path))


def read_shards(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    """Files of ``path``, and by part number the ids of all parts before (eight bytes for
    each part of ``rows_per_part`` documents; the files themselves are not shuffled)."""
    files = spark.read.parquet(path)
    totals = {r["part"]: r["t"] for r in files.groupBy("part").agg(F.sum("n_tokens").alias("t")).collect()}
    sizes = np.array([totals.get(p, 0) for p in range(max(totals, default=-1) + 1)], dtype=np.int64)
    return files, np.cumsum(sizes) - sizes


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""

    files, base = read_shards(spark, path)
    before = spark.sparkContext.broadcast(base)

    def decode(rows):
        for batch in rows:
            for part, start, blob in zip(batch.column("part").to_pylist(), batch.column("start_in_part").to_pylist(),
                                         batch.column("file")):
                start += int(before.value[part])
                f = WaveletFile(blob.as_buffer())
                ids = f.tokens().astype("<u4").tobytes()
                ends = (4 * (f.starts + f.lengths)).tolist()
                crc = [zlib.crc32(ids[a:b]) for a, b in zip((4 * f.starts).tolist(), ends)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(f.doc_ids, pa.int64()), "start": pa.array(start + f.starts),
                    "n_tokens": pa.array(f.lengths), "ids_crc32": pa.array(crc, pa.int64())})

    return files.select("part", "start_in_part", "file").mapInArrow(
        decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the documents' shards to the shared folder and reads them back."""
    path = scratch_path(spark, "wavelet-shards")
    write_shards(spark, documents, path, tokenizer)
    return read_documents(spark, path)
