"""Which rows are one document: those with the same doc_id and the same text.

Where an id has one text, the id alone names the document. A fixed-size bitmap tells the tasks
the ids that may have several; their rows are named by a 64-bit hash of id and text. A wrong
hit only names a row by its hash, in all steps alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sketch

SHARED_BITS = 24


def text_key() -> Column:
    """64-bit hash of a row's doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def hashed(docs: DataFrame) -> DataFrame:
    """Adds ``v`` (hash of the id), ``x`` (of id and text) and ``vx`` (of x)."""
    return docs.withColumn("v", F.xxhash64("doc_id")).withColumn("x", text_key()).withColumn("vx", F.xxhash64("x"))


def shared_ids(spark: SparkSession, docs: DataFrame) -> Broadcast:
    """Bitmap of the ids (by ``v``) that have several texts."""
    ids = docs.where(F.col("doc_id").isNotNull()).groupBy("v").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    return spark.sparkContext.broadcast(sketch.bitmap(ids.where("low < high").select("v"), "v", SHARED_BITS))


def _shared(batch: pa.RecordBatch, table: np.ndarray) -> np.ndarray:
    known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
    return known & sketch.holds(table, batch.column("v").to_numpy().view(np.uint64))


def keys(batch: pa.RecordBatch, table: np.ndarray) -> pa.Array:
    """One long for each document: its id, or the hash where the id has several texts."""
    return pc.if_else(pa.array(_shared(batch, table)), batch.column("x"), batch.column("doc_id"))


def key_hashes(batch: pa.RecordBatch, table: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of ``keys``."""
    return np.where(_shared(batch, table), batch.column("vx").to_numpy(), batch.column("v").to_numpy()).view(np.uint64)


def tags(batch: pa.RecordBatch, table: np.ndarray) -> np.ndarray:
    """What tells the texts of one id apart: 0, or the hash where the id has several."""
    return np.where(_shared(batch, table), batch.column("x").to_numpy(), 0)
