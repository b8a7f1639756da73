"""Substring deduplication: words in passages that an earlier document already has.

A window is ``width`` consecutive words of one document, hashed by Rabin-Karp over the
whole text. A window is removed when the same word sequence also starts in a document with
a smaller doc_id; the windows of a document merge into maximal removal intervals. Windows
are judged on the input, not on what is left.

Windows of most texts occur once, so they are not all shuffled. Each window names one of
its inner ``gram``-word sequences, the one with the smallest hash; equal windows name the
same one. Neighbouring windows mostly share it, so a document names few. The named ones of
all documents are counted in Spark, and only windows whose named one occurs in two documents
are counted as whole windows. This loses nothing: a window that occurs in two documents has
a named gram that does. The repeated grams reach the tasks as a fixed-size bitmap; a wrong
hit there (more of them in larger corpora) only sends a window to the exact count.

Neighbouring windows with the same named gram form a run. A run whose whole word sequence
occurs in a document with a smaller id is removed as one interval; the windows of the
other runs (the first of their kind) are counted one by one. Again nothing is lost: the
first document with a window has it in a run of the second kind. Inside long repeated
passages this leaves one copy to count, however many documents have them.

Repeats are combined before each shuffle: runs by partial minima, joined back by the adaptive
skew join; single windows by judging them first against the windows of the same task, so that
a passage in a third of all documents is a row for each task and not for each document. Texts without anything to
remove are not shuffled (a fixed-size bitmap of ids tells most of them).

Defined results: a null or blank text has no words and nothing to remove. Rows that repeat
a doc_id remove nothing from each other; where their texts differ, each loses only its own
passages. Rows without doc_id neither remove nor lose words. A text shorter than a window
keeps all words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrow import trimmed
from ..session import apply_runtime_conf
from . import identity, sketch
from .components import carried_type, freed, pick, written
from .words import Words, batches, mix

BITMAP_BITS = 26
ID_BITS = 24
GRAM = 20
WINDOWS_HELD = 1_000_000


def sliding_min(x: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each run of ``span`` entries, by doubling."""
    reach = 1
    while reach * 2 <= span:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[:len(x) - (span - reach)], x[span - reach:]) if span > reach else x


def named_grams(words: Words, width: int, gram: int) -> np.ndarray:
    """For each window start, the smallest hash among the window's inner grams."""
    if len(words) < width:
        return np.empty(0, dtype=np.uint64)
    return sliding_min(words.sequences(gram), width - gram + 1)


def _runs(words: Words, width: int, gram: int, repeated: np.ndarray):
    """Runs of neighbouring windows of one document with the same, repeated named gram:
    first and last window, and the hash of the run's word sequence."""
    named = named_grams(words, width, gram)
    flagged = words.complete(width)[:len(named)] & sketch.holds(repeated, named)
    same = flagged[1:] & flagged[:-1] & (named[1:] == named[:-1])
    docs_of = words.docs_of_words()[:len(named)]
    same &= docs_of[1:] == docs_of[:-1]
    first = np.flatnonzero(flagged & ~np.append(False, same)[:len(flagged)])
    last = np.flatnonzero(flagged & ~np.append(same, False)[:len(flagged)])
    return first, last, words.spans(first, last + width), docs_of[first]


def _repeated_grams(spark: SparkSession, docs: DataFrame, width: int, gram: int, bits: int) -> np.ndarray:
    """Bitmap of the named grams that occur in two documents."""

    def name(rows):
        for batch in rows:
            ids = batch.column("doc_id").to_numpy()
            for a, b, words in batches(batch.column("text")):
                named = named_grams(words, width, gram)
                whole = np.flatnonzero(words.complete(width)[:len(named)])
                docs_of, named = words.docs_of_words()[whole], named[whole]
                new = np.ones(len(named), dtype=bool)
                new[1:] = (named[1:] != named[:-1]) | (docs_of[1:] != docs_of[:-1])
                new = np.flatnonzero(new)
                yield pa.RecordBatch.from_pydict({"g": pa.array(named[new].view(np.int64)),
                                                  "doc_id": pa.array(ids[a + docs_of[new]])})

    grams = docs.mapInArrow(trimmed(name), "g long, doc_id long")
    return sketch.bitmap(grams.groupBy("g").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
                         .where("low < high").select("g"), "g", bits)


def removal_spans(spark: SparkSession, documents: DataFrame, width: int = 50, gram: int = GRAM,
                  bits: int = BITMAP_BITS, shared=None) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, tag, starts, ends), written to the shared folder: word
    intervals to remove (they may overlap), for the documents that have any; ``tag`` as in
    ``identity``."""
    apply_runtime_conf(spark)
    docs = identity.hashed(pick(documents, doc_id="long", text="string").where(F.col("doc_id").isNotNull()))
    shared = shared or identity.shared_ids(spark, docs)
    repeated = spark.sparkContext.broadcast(_repeated_grams(spark, docs, width, gram, bits))

    def runs(rows):
        for batch in rows:
            ids, tags = batch.column("doc_id").to_numpy(), identity.tags(batch, shared.value)
            for a, b, words in batches(batch.column("text")):
                first, last, h, docs_of = _runs(words, width, gram, repeated.value)
                base = words.bounds[docs_of]
                yield pa.RecordBatch.from_pydict({
                    "r": pa.array(h.view(np.int64)), "doc_id": pa.array(ids[a + docs_of]), "tag": pa.array(tags[a + docs_of]),
                    "start": pa.array((first - base).astype(np.int32)), "end": pa.array((last + width - base).astype(np.int32))})

    found = written(spark, docs.mapInArrow(trimmed(runs), "r long, doc_id long, tag long, start int, end int"), "substring-runs")
    first = found.groupBy(F.col("r").alias("k")).agg(F.min("doc_id").alias("low"))
    judged = written(spark, found.join(first, F.col("r") == F.col("k")).select("r", "doc_id", "tag", "start", "end", "low"),
                     "substring-judged")
    freed(spark, found)
    left = spark.sparkContext.broadcast(_first_keys(judged, bits))

    def windows(rows):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in rows:
            ids, tags = batch.column("doc_id").to_numpy(), identity.tags(batch, shared.value)
            for a, b, words in batches(batch.column("text")):
                first, last, h, docs_of = _runs(words, width, gram, repeated.value)
                keep = np.flatnonzero(sketch.holds(left.value, _key(h, ids[a + docs_of]))) if len(first) else []
                if not len(keep):
                    continue
                first, last, docs_of = first[keep], last[keep], docs_of[keep]
                lengths = last - first + 1
                at = np.repeat(first - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
                docs_of = np.repeat(docs_of, lengths)
                held.append((words.sequences(width).take(at), ids[a + docs_of], tags[a + docs_of], at - words.bounds[docs_of]))
                size += len(at)
                if size >= WINDOWS_HELD:
                    yield _judged_here(held, width)
                    held, size = [], 0
        if held:
            yield _judged_here(held, width)

    single = written(spark, docs.mapInArrow(trimmed(windows), "h long, doc_id long, tag long, start int, end int"), "substring-single")
    # a single window ends ``width`` words on: its end isn't shuffled
    later = (single.where(F.col("h").isNotNull()).select("h", "doc_id", "tag", "start")
             .withColumn("low", F.min("doc_id").over(Window.partitionBy("h"))).where("doc_id > low")
             .select("doc_id", "tag", "start", (F.col("start") + width).alias("end")))
    here = single.where(F.col("h").isNull()).select("doc_id", "tag", "start", "end")
    spans = (judged.where("doc_id > low").select("doc_id", "tag", "start", "end").union(here).union(later)
             .groupBy("doc_id", "tag").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends")))
    spans = written(spark, spans, "substring-spans")
    freed(spark, judged, single)
    return spans


def _judged_here(held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], width: int) -> pa.RecordBatch:
    """Of the windows that a task holds, those that are also in a smaller document of the same
    task are decided: they leave as merged intervals, without hash. Only the others meet the
    windows of other tasks, so a window in very many documents is a row for each task."""
    h, ids, tags, pos = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((ids, h))
    h, ids, tags, pos = h.take(order), ids.take(order), tags.take(order), pos.take(order)
    new = np.append(True, h[1:] != h[:-1])
    later = ids > ids[np.flatnonzero(new)][np.cumsum(new) - 1]
    gone = np.flatnonzero(later)
    d, t, p = ids.take(gone), tags.take(gone), pos.take(gone)
    order = np.lexsort((p, t, d))
    d, t, p = d.take(order), t.take(order), p.take(order)
    starts = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (p[1:] > p[:-1] + width))) if len(d) else np.empty(0, np.int64)
    ends = np.append(starts[1:], len(d)) - 1 if len(d) else starts
    stay = np.flatnonzero(~later)
    return pa.RecordBatch.from_pydict({
        "h": pa.concat_arrays([pa.array(h.take(stay).view(np.int64)), pa.nulls(len(starts), pa.int64())]),
        "doc_id": pa.array(np.concatenate((ids.take(stay), d[starts]))),
        "tag": pa.array(np.concatenate((tags.take(stay), t[starts]))),
        "start": pa.array(np.concatenate((pos.take(stay), p[starts])).astype(np.int32)),
        "end": pa.array((np.concatenate((pos.take(stay), p[ends])) + width).astype(np.int32))})


def _key(runs: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return mix(runs + mix(ids.view(np.uint64)))


def _first_keys(judged: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of the (run, document) pairs that are the first of their run."""

    def keys(rows):
        for batch in rows:
            v = _key(batch.column("r").to_numpy().view(np.uint64), batch.column("doc_id").to_numpy())
            yield pa.RecordBatch.from_pydict({"v": pa.array(v.view(np.int64))})

    return sketch.bitmap(judged.where("doc_id = low").select("r", "doc_id").mapInArrow(trimmed(keys), "v long"), "v", bits)


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal intervals covered by [start, end) intervals."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    cut = np.flatnonzero(starts[1:] > ends[:-1])
    return list(zip(starts[np.append(0, cut + 1)].tolist(), ends[np.append(cut, len(ends) - 1)].tolist()))


def remove_repeats(spark: SparkSession, documents: DataFrame, width: int = 50, gram: int = GRAM,
                   bits: int = BITMAP_BITS, id_bits: int = ID_BITS, carry: list[str] = ()) -> DataFrame:
    """documents -> (doc_id, text, n_words, n_removed, spans, kept_sha256), and the columns
    named in ``carry`` as one struct column ``carried``: ``spans`` are the
    removed word intervals [from, to); ``text`` has the words left, joined by one space,
    where any were removed, and is the text as it was elsewhere; ``kept_sha256`` is of the
    words left, joined by one space."""
    docs = identity.hashed(pick(documents, list(carry), doc_id="long", text="string"))
    shared = identity.shared_ids(spark, docs)
    spans = removal_spans(spark, documents, width, gram, bits, shared)
    hit = spark.sparkContext.broadcast(
        sketch.bitmap(spans.select(F.xxhash64("doc_id").alias("v")), "v", id_bits))

    def cut(batch, starts, ends):
        n_words, n_removed, found, texts, digest = [], [], [], [], []
        for a, b, words in batches(batch.column("text")):
            for d in range(b - a):
                lo, hi = int(words.bounds[d]), int(words.bounds[d + 1])
                s = starts[a + d].values if starts is not None else None
                gone = merged(s.to_numpy(), ends[a + d].values.to_numpy()) if s is not None else []
                keep = np.ones(hi - lo, dtype=bool)
                for x, y in gone:
                    keep[x:y] = False
                left = b" ".join([words.text(w) for w in (lo + np.flatnonzero(keep)).tolist()])
                n_words.append(hi - lo)
                n_removed.append(int(hi - lo - keep.sum()))
                found.append([{"start": x, "end": y} for x, y in gone])
                texts.append(left.decode() if gone else None)
                digest.append(hashlib.sha256(left).hexdigest())
        changed = pa.array(texts, pa.string())
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "text": pc.coalesce(changed, batch.column("text")),
            "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            "spans": pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            "kept_sha256": pa.array(digest, pa.string()), "carried": batch.column("carried")})

    def untouched(rows):
        for batch in rows:
            clear = ~sketch.holds(hit.value, batch.column("v").to_numpy().view(np.uint64))
            if clear.any():
                yield cut(batch.filter(pa.array(clear)), None, None)

    def touched(rows):
        for batch in rows:
            held = sketch.holds(hit.value, batch.column("v").to_numpy().view(np.uint64))
            if held.any():
                kept = batch.filter(pa.array(held))
                yield kept.select(["doc_id", "text", "carried"]).append_column("tag", pa.array(identity.tags(kept, shared.value)))

    def joined(rows):
        for batch in rows:
            yield cut(batch, batch.column("starts"), batch.column("ends"))

    schema = ("doc_id long, text string, n_words long, n_removed long, "
              f"spans array<struct<start int, end int>>, kept_sha256 string, carried {carried_type(docs)}")
    out = docs.mapInArrow(trimmed(untouched), schema).union(
        docs.mapInArrow(trimmed(touched), f"doc_id long, text string, carried {carried_type(docs)}, tag long")
        .join(spans, ["doc_id", "tag"], "left").mapInArrow(trimmed(joined), schema))
    return out if carry else out.drop("carried")
