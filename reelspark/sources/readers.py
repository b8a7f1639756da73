"""Readers. Schemas are explicit: no inference pass over the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import apply_runtime_conf

RATINGS_SCHEMA = T.StructType([
    T.StructField("userId", T.IntegerType()),
    T.StructField("movieId", T.IntegerType()),
    T.StructField("rating", T.FloatType()),
    T.StructField("timestamp", T.LongType()),
])
MOVIES_SCHEMA = T.StructType([
    T.StructField("movieId", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("genres", T.StringType()),
])
LINKS_SCHEMA = T.StructType([
    T.StructField("movieId", T.IntegerType()),
    T.StructField("imdbId", T.StringType()),
    T.StructField("tmdbId", T.DoubleType()),
])
METADATA_SCHEMA = T.StructType([
    T.StructField("movieId", T.LongType()),
    T.StructField("tmdbId", T.LongType()),
    T.StructField("overview", T.StringType()),
    T.StructField("cast", T.StringType()),
    T.StructField("director", T.StringType()),
    T.StructField("release_year", T.IntegerType()),
    T.StructField("poster_path", T.StringType()),
    T.StructField("poster_url", T.StringType()),
    T.StructField("fetch_status", T.StringType()),
    T.StructField("fetch_error", T.StringType()),
])


def _csv(spark: SparkSession, schema: T.StructType, path: str, multi_line: bool = True) -> DataFrame:
    """A CSV file with a header, its columns taken by name (in any order; others are left
    out), quoted fields with doubled quotes and line breaks. A missing column or a value
    that does not parse is an error. Whole numbers may be written as 1990.0, as writers of
    nullable numbers do. With ``multi_line`` a file is one task; the long ratings table,
    which has no text, is read without it and splits."""
    apply_runtime_conf(spark)
    read = (spark.read.option("header", True).option("mode", "FAILFAST").option("quote", '"').option("escape", '"')
            .option("multiLine", multi_line).option("nullValue", "\u0001"))     # "" is an empty text, nothing is null
    names = read.option("inferSchema", False).csv(path).columns
    missing = [f.name for f in schema if f.name not in names]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    kinds = {f.name: f.dataType for f in schema}
    whole = (T.IntegerType, T.LongType)
    as_read = T.StructType([T.StructField(n, T.DoubleType() if isinstance(kinds.get(n), T.IntegerType)
                                          else kinds.get(n, T.StringType())) for n in names])
    df = read.schema(as_read).csv(path)
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if isinstance(f.dataType, whole)
                       else F.col(f"`{f.name}`") for f in schema])


def scan_ratings(spark: SparkSession, path: str) -> DataFrame:
    """userId int, movieId int, rating float, timestamp long."""
    return _csv(spark, RATINGS_SCHEMA, path, multi_line=False)


def scan_ids(spark: SparkSession, path: str) -> DataFrame:
    """userId, movieId of a file of pairs to predict."""
    schema = T.StructType([T.StructField("userId", T.LongType()), T.StructField("movieId", T.LongType())])
    return _csv(spark, schema, path, multi_line=False)


def scan_movies(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, MOVIES_SCHEMA, path)


def scan_links(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Links with a tmdbId (as int), one row per movie: the first in file order.

    File order is made explicit as (input file, position in the file), which a per-movie
    ``min_by`` reads without sorting the whole table."""
    df = _csv(spark, schema or LINKS_SCHEMA, path).where(F.col("tmdbId").isNotNull())
    df = df.withColumn("_o", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    return (df.groupBy("movieId").agg(F.min_by(F.col("tmdbId"), F.col("_o")).alias("tmdbId"))
            .select("movieId", F.col("tmdbId").cast("int").alias("tmdbId")))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath)


def scan_metadata_csv(spark: SparkSession, path: str) -> DataFrame:
    """The CSV form of the metadata: a field with nothing is null, one with "" is empty."""
    return _csv(spark, METADATA_SCHEMA, path)


def scan_metadata(spark: SparkSession, base: str, stem: str = "metadata_df", required: bool = True) -> DataFrame:
    """Parquet if there, else CSV, else an error (or an empty table when not ``required``)."""
    pq = f"{base.rstrip('/')}/{stem}.parquet"
    csv = f"{base.rstrip('/')}/{stem}.csv"
    if _exists(spark, pq):
        return spark.read.parquet(pq)
    if _exists(spark, csv):
        return scan_metadata_csv(spark, csv)
    if required:
        raise FileNotFoundError(f"{stem} not found under {base}")
    return spark.createDataFrame([], METADATA_SCHEMA)


def scan_pruned(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """Parquet read of the wanted columns that the file has (pruned at the scan)."""
    df = spark.read.parquet(path)
    return df.select(*[c for c in wanted if c in df.columns])


def scan_splits(spark: SparkSession, base: str, splits=("train", "val", "test")) -> DataFrame:
    """Split rows written with ``split=`` partitions; a filter on ``split`` prunes directories."""
    df = spark.read.parquet(base)
    return df.where(F.col("split").isin(*splits))
