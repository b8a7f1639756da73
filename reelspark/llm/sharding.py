"""Balanced label propagation: shards of equal row counts that keep linked documents together.

Documents are linked through shared link values (equal texts, a cluster, a host): all rows
with the same value are neighbours, without listing their pairs. Every row starts in a
shard drawn by hash. A round joins each linked row with its links' row counts per shard,
and the row wants the shard where most of its neighbours are; equal counts are decided by a
hash of its links, so neighbours agree and no two rounds undo each other. Moves are admitted
under the shards' quotas: rows that want the same shard stand in a fixed number of hash
buckets of their links, the bucket sizes (a small table) are admitted largest first while
they fit, and the first that does not fit is admitted in part. Rounds end when no row
moves. Rows left over because their shard was full are then settled in the shard
with room where most of their neighbours are, so a group larger than a shard fills one
after the other instead of being scattered.

Unlinked rows cut no edge wherever they are, and fill the shards up to the quotas. These
are exact: row counts of two shards differ by one at most. Every step is a join or an
aggregate on hashes; what reaches the driver are the bucket sizes, of fixed number.

Defined results: a null text has size 1, no checksum of characters (that of the empty text),
and no links; empty texts are equal to each other. Rows that repeat are rows of their own
(and linked, as their texts are equal). An empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import apply_runtime_conf
from .components import pick, written

BUCKETS = 4096
ROUNDS = 10


def _numbered(spark: SparkSession, df: DataFrame, by: str, n_values: int, name: str, out: str) -> DataFrame:
    """Numbers the rows of each value of ``by`` (0 .. n_values - 1, or null: not numbered)
    without gaps. Rows are counted as they stream by and written; the counts of each task
    then shift its numbers."""
    from pyspark import TaskContext

    schema = df.schema.simpleString()[len("struct<"):-1] + ",_task:int,_k:bigint"

    def count(rows):
        seen = [0] * n_values
        task = TaskContext.get().partitionId()
        for batch in rows:
            k = []
            for v in batch.column(by).to_pylist():
                if v is None:
                    k.append(None)
                else:
                    k.append(seen[v])
                    seen[v] += 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([task] * batch.num_rows, pa.int32()), pa.array(k, pa.int64())],
                [*batch.schema.names, "_task", "_k"])

    rows = written(spark, df.mapInArrow(count, schema.replace(":", " ")), name)
    sizes = rows.where(F.col(by).isNotNull()).groupBy("_task", by).agg(F.count("*").alias("_n"))
    from pyspark.sql.window import Window

    before = sizes.select("_task", by, (F.sum("_n").over(Window.partitionBy(by).orderBy("_task")) - F.col("_n")).alias("_before"))
    return rows.join(before, ["_task", by], "left").withColumn(out, F.col("_before") + F.col("_k")).drop("_task", "_k", "_before")


def _wanted(linked: DataFrame, labels: DataFrame, shards: list[int]) -> DataFrame:
    """(row, shard, target, bucket): the shard among ``shards`` with most neighbours of each
    row of ``labels``."""
    here = linked.join(labels.select("row", "shard"), "row")
    tallies = here.groupBy(F.col("link").alias("l")).agg(
        *[F.count(F.when(F.col("shard") == s, 1)).alias(f"n{s}") for s in shards])
    sums = (here.join(tallies, here["link"] == tallies["l"]).groupBy("row").agg(
        F.first("shard").alias("shard"), F.sum(F.xxhash64("link") % 1_000_003).alias("seed"),
        *[F.sum(f"n{s}").alias(f"n{s}") for s in shards]))
    best = F.greatest(*[F.struct(F.col(f"n{s}").alias("n"), F.xxhash64("seed", F.lit(s)).alias("h"), F.lit(s).alias("s"))
                        for s in shards]) if len(shards) > 1 else F.struct(F.lit(shards[0]).alias("s"))
    return sums.select("row", "shard", best["s"].alias("target"),
                       F.pmod(F.xxhash64("seed"), F.lit(BUCKETS)).cast("int").alias("bucket"))


def _admit(wanted: DataFrame, quota: dict[int, int]) -> DataFrame:
    """``wanted`` with ``admitted``: whole buckets, largest first, while they fit the quota;
    then part of the first that does not fit, by hash of the row."""
    sizes: dict[int, list[tuple[int, int]]] = {}
    for r in wanted.groupBy("target", "bucket").agg(F.count("*").alias("n")).collect():
        sizes.setdefault(r["target"], []).append((r["n"], r["bucket"]))
    refused: list[tuple[int, int]] = []
    left = dict(quota)
    part: dict[int, int] = {}
    for s, buckets in sizes.items():
        for n, b in sorted(buckets, reverse=True):
            if n <= left[s]:
                left[s] -= n
            elif s not in part:
                part[s] = b
            else:
                refused.append((s, b))
    spark = wanted.sparkSession
    out = wanted.withColumn("admitted", F.lit(True))
    if refused:
        no = spark.createDataFrame(refused, "target int, bucket int").withColumn("no", F.lit(True))
        out = out.join(F.broadcast(no), ["target", "bucket"], "left").withColumn("admitted", F.col("no").isNull()).drop("no")
    if part:
        marginal = F.lit(False)
        for s, b in part.items():
            marginal = marginal | ((F.col("target") == s) & (F.col("bucket") == b))
        fine = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(BUCKETS)).cast("int")
        counts: dict[int, list[tuple[int, int]]] = {}
        for r in wanted.where(marginal).groupBy("target", fine.alias("f")).agg(F.count("*").alias("n")).collect():
            counts.setdefault(r["target"], []).append((r["f"], r["n"]))
        allow = F.lit(False)
        for s, found in counts.items():
            limit, room = 0, left[s]
            for f, n in sorted(found):
                if n > room:
                    break
                room -= n
                limit = f + 1
            allow = allow | ((F.col("target") == s) & (fine < limit))
        out = out.withColumn("admitted", F.when(marginal, allow).otherwise(F.col("admitted")))
    return out


def propagate(spark: SparkSession, rows: DataFrame, links: DataFrame, n_shards: int, rounds: int = ROUNDS) -> DataFrame:
    """rows(row), links(row, link) -> (row, shard) of the linked rows that were placed;
    never more of a shard than its share of all rows. ``row`` must be unique."""
    apply_runtime_conf(spark)
    n = rows.count()
    quota = {s: n // n_shards + (s < n % n_shards) for s in range(n_shards)}
    shared = links.where(F.col("link").isNotNull()).groupBy("link").agg(F.count("*").alias("c")).where("c > 1").select("link")
    linked = written(spark, links.join(shared, "link").select("row", "link"), "shards-links")
    labels = linked.select("row").distinct().withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(n_shards)).cast("int"))
    for _ in range(rounds):
        step = _admit(written(spark, _wanted(linked, labels, list(quota)), "shards-wanted"), quota)
        step = written(spark, step.select("row", F.when(F.col("admitted"), F.col("target")).otherwise(F.col("shard")).alias("shard"),
                                          "admitted", (F.col("admitted") & (F.col("target") != F.col("shard"))).alias("moved")),
                       "shards-labels")
        labels = step.select("row", "shard", "admitted")
        if step.where("moved").isEmpty():
            break
    if "admitted" not in labels.columns:
        labels = labels.withColumn("admitted", F.lit(False))
    # rows that found their shard full: the shards with room, as long as that places any
    while True:
        placed = {r["shard"]: r["n"] for r in labels.where("admitted").groupBy("shard").agg(F.count("*").alias("n")).collect()}
        room = {s: q - placed.get(s, 0) for s, q in quota.items() if q > placed.get(s, 0)}
        if not room or labels.where("NOT admitted").isEmpty():
            break
        wanted = _wanted(linked, labels.where("admitted").select("row", "shard").unionByName(
            labels.where("NOT admitted").select("row", "shard")), list(room))
        loose = written(spark, wanted.join(labels.where("NOT admitted").select("row"), "row", "left_semi"), "shards-wanted")
        step = _admit(loose, room).select("row", F.when(F.col("admitted"), F.col("target")).otherwise(F.col("shard")).alias("shard"), "admitted")
        step = written(spark, step, "shards-step")
        if step.where("admitted").isEmpty():
            break
        labels = written(spark, labels.where("admitted").select("row", "shard", "admitted").union(step), "shards-labels")
    return labels.where("admitted").select("row", "shard")


def shard_documents(spark: SparkSession, documents: DataFrame, n_shards: int = 8) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, size, text_crc32, law, shard, slot, grown_shard),
    documents of equal text linked."""
    apply_runtime_conf(spark)
    rows = written(spark, pick(documents, doc_id="long", text="string").select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2("text", 256)).alias("link")), "shards-rows")
    placed = propagate(spark, rows, rows.select("row", "link"), n_shards)
    n = rows.count()
    quota = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    have = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    both = rows.drop("link").join(placed, "row", "left").withColumn(
        "free", F.when(F.col("shard").isNull(), F.lit(0)))
    both = _numbered(spark, both, "free", 1, "shards-free", "rank")
    fill, end = F.lit(n_shards - 1), 0
    ends = []
    for s in range(n_shards):
        end += quota[s] - have.get(s, 0)
        ends.append(end)
    for s in reversed(range(n_shards)):
        fill = F.when(F.col("rank") < ends[s], F.lit(s)).otherwise(fill)
    filled = both.withColumn("shard", F.coalesce("shard", fill).cast("int")).drop("free", "rank")
    out = _numbered(spark, filled, "shard", n_shards, "shards-filled", "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
