"""The pipeline's intermediate tables, derived by Spark from the input tables.

Each is a DataFrame that callers compose; Catalyst prunes what is not needed. The split rows
and the serving catalog are stage tables, as every later job reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.memo import memo_stage
from ..operators import catalog as cat
from ..operators import search as se
from ..sources import fixtures as fx
from ..sources.writers import sink_catalog, sink_splits


def catalog(spark: SparkSession, d: str) -> DataFrame:
    return cat.build_catalog(fx.movie_titles(spark, d), fx.metadata(spark, d))


#: Input tables of the stages.
SPLIT_INPUTS = ["lineitem", "orders", "part"]


def _inputs(d: str) -> list[str]:
    return [f"{d.rstrip('/')}/{t}.parquet" for t in SPLIT_INPUTS]


def split_rows(spark: SparkSession, d: str) -> DataFrame:
    """All rating rows with catalog columns and their ``split`` (the three splits, unioned).

    This is the pipeline's split stage: zstd Parquet, one directory per split, written once
    per session for the same input files. Every later stage scans only the columns and the
    splits it needs, and predicates on the rows reach the scan."""
    return memo_stage(spark, "split_rows", _inputs(d),
                      lambda: cat.split_rows(fx.ratings(spark, d), catalog(spark, d)), sink_splits)


def raw_rows(spark: SparkSession, d: str) -> DataFrame:
    """Ratings left-joined to the catalog: rows of unknown or failed movies keep null columns."""
    return cat.join_ratings(fx.ratings(spark, d), catalog(spark, d), how="left")


def serving(spark: SparkSession, d: str) -> DataFrame:
    """The serving catalog, the second stage table (one row per movie)."""
    return memo_stage(spark, "serving_catalog", _inputs(d),
                      lambda: cat.serving_catalog(split_rows(spark, d), fx.metadata(spark, d), catalog=catalog(spark, d)),
                      sink_catalog)


def search_index(spark: SparkSession, d: str) -> DataFrame:
    """The serving catalog's gram index, the third stage table."""
    return memo_stage(spark, "search_index", _inputs(d), lambda: se.gram_index(serving(spark, d)), se.sink_index)


def model_movie_ids(spark: SparkSession, d: str) -> DataFrame:
    return fx.factors(spark, d).select("movieId")


def split_of(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(F.col("split") == name)
