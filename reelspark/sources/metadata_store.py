"""The metadata table kept as buckets of movies, for ingests that add few rows to many.

An ingest rewrites only the buckets that its rows fall into (copy-on-write) and adds a pointer,
one row that names the folder of every bucket. Readers follow the newest pointer; it is written
after the data, so a failed or killed ingest changes nothing, and older versions stay readable
until ``vacuum``. One ingest at a time; an ingest that finds a newer version is an error.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import _exists
from .writers import METADATA_ORDER

ROW = ("movieId long, tmdbId long, overview string, cast string, director string, release_year int, "
       "poster_path string, poster_url string, fetch_status string, fetch_error string")
POINTER = "version long, folders array<string>"


class MetadataStore:
    """``buckets`` is fixed when the store's first rows are written: choose it so that a bucket
    is a file of some hundred MB at the size expected."""

    def __init__(self, spark: SparkSession, base: str, buckets: int = 64):
        self.spark, self.base, self.buckets = spark, base.rstrip("/"), buckets

    def _pointers(self) -> list:
        if not _exists(self.spark, f"{self.base}/pointers"):
            return []
        return self.spark.read.schema(POINTER).json(f"{self.base}/pointers").orderBy("version").collect()

    def _folders(self) -> tuple[int, list[str | None]]:
        pointers = self._pointers()
        return (pointers[-1]["version"], pointers[-1]["folders"]) if pointers else (-1, [None] * self.buckets)

    def _rows(self, folders: list[str | None], chosen=None) -> DataFrame:
        paths = [f"{self.base}/{folder}/bucket={b}" for b, folder in enumerate(folders)
                 if folder is not None and (chosen is None or b in chosen)]
        if not paths:
            return self.spark.createDataFrame([], ROW)
        return self.spark.read.schema(ROW).parquet(*paths)

    def _drop(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of the newest version, or of an older one."""
        if version is None:
            return self._rows(self._folders()[1])
        for pointer in self._pointers():
            if pointer["version"] == version:
                return self._rows(pointer["folders"])
        raise ValueError(f"no version {version}")

    def counts(self) -> dict[str, int]:
        """Rows per fetch status, over the whole table."""
        return {r["fetch_status"]: r["n"] for r in self.read().groupBy("fetch_status").agg(F.count(F.lit(1)).alias("n")).collect()}

    def ingest(self, new: DataFrame) -> list[int]:
        """Adds rows with the columns of ``METADATA_ORDER``; a movie's stored row gives way to its new
        one. Returns the buckets that were rewritten; without new rows there is no new version."""
        version, folders = self._folders()
        bucket = F.pmod(F.xxhash64(F.col("movieId").cast("long")), F.lit(len(folders))).cast("int")
        types = {f.split()[0]: f.split()[1] for f in ROW.split(", ")}
        staged = f"{self.base}/new-{uuid.uuid4().hex[:12]}"
        (new.select(*[F.col(c).cast(types[c]) for c in METADATA_ORDER]).withColumn("bucket", bucket)
         .write.option("compression", "zstd").parquet(staged))
        schema = f"{ROW}, bucket int"
        rows = self.spark.read.schema(schema).parquet(staged)
        touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())   # at most the bucket count
        if touched:
            kept = (self._rows(folders, set(touched)).join(rows.select("movieId"), "movieId", "left_anti")
                    .select(*METADATA_ORDER).withColumn("bucket", bucket))
            folder = f"data-{uuid.uuid4().hex[:12]}"
            (kept.unionByName(rows).repartition(len(touched), "bucket").write.option("compression", "zstd")
             .partitionBy("bucket").parquet(f"{self.base}/{folder}"))
            if self._folders()[0] != version:
                raise RuntimeError("another ingest has written a version meanwhile; ingest again")
            named = [folder if b in set(touched) else old for b, old in enumerate(folders)]
            (self.spark.createDataFrame([(version + 1, named)], POINTER).coalesce(1)
             .write.mode("append").json(f"{self.base}/pointers"))
        self._drop(staged)
        return touched

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes the folders that none of the newest ``keep`` versions names; returns them."""
        if keep < 1:
            raise ValueError("keep at least one version")
        pointers = self._pointers()
        live = {f for p in pointers[-keep:] for f in p["folders"]}
        dead = sorted({f for p in pointers[:-keep] for f in p["folders"] if f is not None} - live)
        for folder in dead:
            self._drop(f"{self.base}/{folder}")
        return dead
