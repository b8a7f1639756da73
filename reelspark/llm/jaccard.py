"""N-gram Jaccard join by grouped prefixes: which documents share most of their shingles.

A document's set holds its distinct k-word shingles (64-bit hashes); two documents link
when ``100 * |A & B| >= percent * |A | B|``. All shingles are put into one global order,
rare before common; of two sets that link, the first ``n - ceil(t n) + 1`` shingles of each
have one in common (prefix filter). The join runs in these steps:

1. Order: occurrences of all shingles are counted in a fixed-size hashed table. Any order
   gives the same links; a good one only keeps common passages out of the prefixes.
2. Group: documents with equal sets form a class, classes with identical prefix and size
   form a group, and only one prefix per group goes to the index.
3. Filter and verify: rows of the index that share a shingle are compared with one leader
   per shingle and size band; leaders and the classes inside a group are verified on their
   sets. Links found so far are joined into components.
4. The rest: pairs of one shingle whose classes are still in different components are
   expanded to class pairs, filtered by size and position, and verified. A pair already
   in one component needs no check, since the result is the components: a group of n near
   copies costs about n comparisons, not n * n, and no link between components is lost.

Verification streams the members of a leader past its set, in chunks of bounded size, so a
leader with very many members is spread over tasks.

Defined results: a null or blank text has ``n_shingles`` 0 and is linked with nothing; its
component is itself. Rows that repeat a doc_id get a row each; those with the same text are
one document, those with different texts are different ones, each in its own component (by the
smallest doc_id there). Rows without doc_id are linked with nothing and have a null component.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrow import trimmed
from ..session import apply_runtime_conf
from . import identity, sketch
from .components import components, pick, written
from .words import U64, batches

SKETCH_BITS = 22
ID_BITS = 24
MEMBERS_PER_TASK = 2000
COUNTED_AT_ONCE = 1 << 20


def shingle_sets(texts: pa.Array, k: int):
    """(row, sorted distinct shingle hashes) of each text that has words."""
    for a, b, words in batches(texts, "spaced", lower=True):
        grams = words.sequences(k)
        for d in range(b - a):
            lo, hi = int(words.bounds[d]), int(words.bounds[d + 1])
            if hi - lo >= k:
                found = np.sort(grams[lo:hi - k + 1])
                distinct = np.empty(len(found), dtype=bool)
                distinct[0] = True
                np.not_equal(found[1:], found[:-1], out=distinct[1:])
                yield a + d, found[distinct]
            elif hi > lo:
                yield a + d, np.array([words.whole(d)], dtype=U64)


def ranks(docs: DataFrame, k: int, bits: int) -> np.ndarray:
    """For each cell of the hashed count table a coarse rank (0..255) that grows with the
    occurrences of its shingles in all documents."""
    cells = 1 << bits

    def count(rows):
        table = np.zeros(cells, dtype=np.uint32)
        held, waiting = [], 0

        def add():
            at, n = np.unique(np.concatenate(held), return_counts=True)
            table[at] += n.astype(np.uint32)

        for batch in rows:
            for _, _, words in batches(batch.column("text"), "spaced", lower=True):
                grams = words.sequences(k)
                grams = grams[words.complete(k)] if len(grams) else grams
                held.append((grams >> U64(64 - bits)).astype(np.uint32))
                waiting += len(grams)
                if waiting >= COUNTED_AT_ONCE:
                    add()
                    held, waiting = [], 0
        if held:
            add()
        yield from sketch.emit(table)

    counts = sketch.gather(docs.select("text").mapInArrow(trimmed(count), sketch.SCHEMA), cells, "uint32")
    return np.minimum(np.floor(8 * np.log2(1 + counts.astype(np.float64))), 255).astype(np.uint8)


def prefix_length(n, percent: int):
    """Shingles of a set of n that must include one of each set it links with."""
    return n - (percent * n + 99) // 100 + 1


def signatures(spark: SparkSession, docs: DataFrame, shared, k: int, percent: int, bits: int) -> DataFrame:
    """Per document: key, size and digest of its set, digest and shingles of its prefix."""
    rank = spark.sparkContext.broadcast(ranks(docs, k, bits))

    def sign(rows):
        table = rank.value
        for batch in rows:
            n = [0] * batch.num_rows
            set_key, prefix_key, prefix = ([None] * batch.num_rows for _ in range(3))
            for row, found in shingle_sets(batch.column("text"), k):
                order = np.argsort(table[(found >> U64(64 - bits)).astype(np.int64)], kind="stable")
                first = found[order[:prefix_length(len(found), percent)]].tobytes()
                n[row] = len(found)
                set_key[row] = hashlib.md5(found.tobytes()).digest()
                prefix_key[row] = hashlib.md5(first).digest()
                prefix[row] = first
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "x": batch.column("x"), "key": identity.keys(batch, shared.value),
                "n": pa.array(n, pa.int32()),
                "set_key": pa.array(set_key, pa.binary()), "prefix_key": pa.array(prefix_key, pa.binary()),
                "prefix": pa.array(prefix, pa.binary())})
        pa.default_memory_pool().release_unused()      # workers outlive their stages

    return docs.mapInArrow(trimmed(sign), "doc_id long, x long, key long, n int, set_key binary, prefix_key binary, prefix binary")


def _index(groups: DataFrame) -> DataFrame:
    """One row per shingle of each group's prefix: (h, g, n, pos)."""

    def rows(it):
        for batch in it:
            prefixes = [np.frombuffer(p.as_buffer(), dtype=np.int64) for p in batch.column("prefix")]
            if not prefixes:
                continue
            lengths = np.array([len(p) for p in prefixes])
            start = np.cumsum(lengths) - lengths
            yield pa.RecordBatch.from_pydict({
                "h": pa.array(np.concatenate(prefixes)),
                "g": pa.array(np.repeat(batch.column("g").to_numpy(), lengths)),
                "n": pa.array(np.repeat(batch.column("n").to_numpy(), lengths)),
                "pos": pa.array((np.arange(lengths.sum()) - np.repeat(start, lengths)).astype(np.int32))})

    return groups.select("g", "n", "prefix").mapInArrow(trimmed(rows), "h long, g long, n int, pos int")


def _may_link(n1, p1, n2, p2, percent: int):
    """Size and position filter: the overlap that the shared shingle still allows reaches
    what a link of these sizes needs (true for the first shared shingle of every link)."""
    need = F.ceil(F.lit(percent) * (n1 + n2) / F.lit(100 + percent))
    return ((100 * F.least(n1, n2) >= percent * F.greatest(n1, n2))
            & (F.least(n1 - p1, n2 - p2) >= need))


def _sets_of(spark: SparkSession, docs: DataFrame, shared, pairs: DataFrame, k: int) -> DataFrame:
    """(key, shingles) of the documents in ``pairs``. A fixed-size bitmap of their keys
    keeps most others from being shuffled; the semi join removes the rest."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    table = spark.sparkContext.broadcast(
        sketch.bitmap(ids.select(F.xxhash64("id").alias("v")), "v", ID_BITS))

    def pick(rows):
        for batch in rows:
            want = sketch.holds(table.value, identity.key_hashes(batch, shared.value))
            batch = batch.filter(pa.array(want))
            if not batch.num_rows:
                continue
            found = list(shingle_sets(batch.column("text"), k))
            yield pa.RecordBatch.from_pydict({
                "key": identity.keys(batch, shared.value).take(pa.array([r for r, _ in found], pa.int64())),
                "shingles": pa.array([s.tobytes() for _, s in found], pa.binary())})
        pa.default_memory_pool().release_unused()

    return docs.where(F.col("doc_id").isNotNull()).mapInArrow(trimmed(pick), "key long, shingles binary")


def verify(spark: SparkSession, docs: DataFrame, shared, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The rows of pairs(a, b) whose documents link, checked on their whole sets."""
    sets = written(spark, _sets_of(spark, docs, shared, pairs, k), "jaccard-sets").dropDuplicates(["key"])
    tasks = (pairs.groupBy("a").agg(F.count("*").alias("c"))
             .select("a", F.ceil(F.col("c") / MEMBERS_PER_TASK).cast("int").alias("parts")))
    members = (pairs.join(tasks, "a")
               .select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
               .join(sets.withColumnRenamed("key", "b"), "b")
               .select("a", "part", "b", "shingles"))
    leaders = (tasks.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
               .join(sets.withColumnRenamed("key", "a"), "a")
               .select("a", "part", F.lit(None).cast("long").alias("b"), "shingles"))

    def check(rows):
        key, own = None, None
        for batch in rows:
            a, part, b = (batch.column(c).to_pylist() for c in ("a", "part", "b"))
            out = []
            for i, blob in enumerate(batch.column("shingles")):
                found = np.frombuffer(blob.as_buffer(), dtype=np.uint64)
                if b[i] is None:
                    key, own = (a[i], part[i]), found.copy()
                elif key == (a[i], part[i]):
                    at = np.searchsorted(own, found)
                    at[at == len(own)] = 0
                    shared = int((own[at] == found).sum())
                    if 100 * shared >= percent * (len(own) + len(found) - shared):
                        out.append(i)
            yield batch.select(["a", "b"]).take(pa.array(out, pa.int64()))

    return (members.union(leaders).repartition("a", "part").sortWithinPartitions("a", "part", "b")
            .mapInArrow(trimmed(check), "a long, b long"))


def link_documents(spark: SparkSession, documents: DataFrame, k: int = 5, percent: int = 75,
                   sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """documents(doc_id, text, ...) -> (doc_id, n_shingles, component_id), one row per row."""
    return link_rows(spark, documents, k, percent, sketch_bits).select("doc_id", "n_shingles", "component_id")


def link_rows(spark: SparkSession, documents: DataFrame, k: int = 5, percent: int = 75,
              sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """documents(doc_id, text, ...) -> (doc_id, text_key, n_shingles, component_id, first), one
    row per row: ``text_key`` as in ``identity``; ``first`` is true for one document of each
    component, the one with the smallest doc_id (of several with that id, one)."""
    apply_runtime_conf(spark)
    docs = identity.hashed(pick(documents, doc_id="long", text="string"))
    shared = identity.shared_ids(spark, docs)
    signed = written(spark, signatures(spark, docs, shared, k, percent, sketch_bits), "jaccard-signed")
    known = signed.where(F.col("key").isNotNull() & (F.col("n") > 0))
    classes = written(spark, known.groupBy("n", "set_key").agg(
        F.min("key").alias("c"), F.min(F.struct("doc_id", "key")).alias("low"),
        F.min("prefix_key").alias("prefix_key")), "jaccard-classes")
    grouped = written(spark, classes.groupBy("n", "prefix_key").agg(
        F.min("c").alias("g"), F.count("*").alias("members")), "jaccard-groups")
    members = (classes.join(grouped.where("members > 1"), ["n", "prefix_key"])
               .select("g", "c", "n"))
    prefixes = known.select("key", "prefix_key", "prefix").join(
        grouped.select(F.col("g").alias("key"), "prefix_key", "n"), ["key", "prefix_key"]) \
        .dropDuplicates(["key", "prefix_key"]).select(F.col("key").alias("g"), "n", "prefix")

    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)))
    by_shingle = Window.partitionBy("h")
    index = written(spark, _index(prefixes)
                    .withColumn("rows", F.count("*").over(by_shingle)).where("rows > 1")
                    .withColumn("lead", F.min(F.struct("g", "n", "pos")).over(Window.partitionBy("h", band)))
                    .select("h", "g", "n", "pos", "lead"), "jaccard-index")
    first = (index.where(F.col("lead.g") != F.col("g"))
             .where(_may_link(F.col("lead.n"), F.col("lead.pos"), F.col("n"), F.col("pos"), percent))
             .select(F.col("lead.g").alias("a"), F.col("g").alias("b")))
    inside = members.where("g != c").select(F.col("g").alias("a"), F.col("c").alias("b"))
    tried = written(spark, first.union(inside).distinct(), "jaccard-pairs")
    links = written(spark, verify(spark, docs, shared, tried, k, percent), "jaccard-links")
    found = components(spark, links)

    # what is left: rows of a shingle (or classes of a group) in more than one component
    rows = (index.select("h", "g", "n", "pos").join(members.select("g", "c"), "g", "left")
            .select("h", F.coalesce("c", "g").alias("c"), "n", "pos"))
    rows = rows.join(found, rows["c"] == found["id"], "left").select(
        "h", "c", "n", "pos", F.coalesce("component", "c").alias("component"))
    rows = written(spark, rows.withColumn("low", F.min("component").over(by_shingle))
                   .withColumn("high", F.max("component").over(by_shingle))
                   .where("low != high").select("h", "c", "n", "pos", "component"), "jaccard-rest")
    x, y = rows.alias("x"), rows.alias("y")
    rest = (x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.c") < F.col("y.c"))
                   & (F.col("x.component") != F.col("y.component"))
                   & _may_link(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), percent))
            .select(F.col("x.c").alias("a"), F.col("y.c").alias("b")))
    inner = (members.join(found, members["c"] == found["id"], "left")
             .select("g", "c", F.coalesce("component", "c").alias("component")))
    u, v = inner.alias("u"), inner.alias("v")
    rest = rest.union(u.join(v, (F.col("u.g") == F.col("v.g")) & (F.col("u.c") < F.col("v.c"))
                             & (F.col("u.component") != F.col("v.component")))
                      .select(F.col("u.c").alias("a"), F.col("v.c").alias("b")))
    rest = written(spark, rest.distinct().join(tried, ["a", "b"], "left_anti"), "jaccard-pairs")
    if not rest.isEmpty():
        links = links.union(verify(spark, docs, shared, rest, k, percent))
        found = components(spark, links)

    linked = classes.join(found, classes["c"] == found["id"]).select("c", "low", "component")
    lowest = linked.groupBy("component").agg(F.min("low").alias("lowest"))
    of_class = (classes.select("n", "set_key", "c", "low")
                .join(linked.select("c", "component").join(lowest, "component").select("c", "lowest"), "c", "left")
                .select("n", "set_key", F.coalesce("lowest", "low").alias("lowest")))
    return (signed.select("doc_id", "x", "key", "n", "set_key").join(of_class, ["n", "set_key"], "left")
            .select("doc_id", F.col("x").alias("text_key"), F.col("n").cast("long").alias("n_shingles"),
                    F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("lowest.doc_id", "doc_id"))
                    .cast("long").alias("component_id"),
                    F.coalesce(F.col("key") == F.col("lowest.key"), F.col("doc_id").isNotNull()).alias("first")))
