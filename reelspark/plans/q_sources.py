"""Queries for §2.1 (sources and sinks). Each writes a table Spark derived from the inputs
to the shared checkpoint folder, then reads it back through the reader under test."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as cat
from ..session import scratch_path
from ..sources import fixtures as fx
from ..sources import readers as rd
from ..sources import writers as wr
from . import datasets as ds
from .oracle_views import with_views
from .registry import query


@query("scan_ratings", with_views("""
SELECT CAST(userId AS INTEGER) AS userId, CAST(movieId AS INTEGER) AS movieId, CAST(rating AS FLOAT) AS rating,
 "timestamp" FROM ratings"""))
def scan_ratings(spark, d):
    path = scratch_path(spark, "ratings_csv")
    wr.sink_csv(fx.ratings(spark, d).select("userId", "movieId", "rating", "timestamp"), path)
    return rd.scan_ratings(spark, path)


@query("scan_movies", with_views("""
SELECT CAST(movieId AS INTEGER) AS movieId, title, genres FROM movies"""))
def scan_movies(spark, d):
    path = scratch_path(spark, "movies_csv")
    wr.sink_csv(fx.movie_titles(spark, d), path)
    return rd.scan_movies(spark, path)


@query("scan_links", with_views("""
SELECT CAST(movieId AS INTEGER) AS movieId, CAST(tmdbId AS INTEGER) AS tmdbId FROM (
 SELECT *, row_number() OVER (PARTITION BY movieId ORDER BY link_pos) AS nth FROM links WHERE tmdbId IS NOT NULL) WHERE nth = 1"""))
def scan_links(spark, d):
    path = scratch_path(spark, "links_csv")
    lk = fx.links(spark, d).orderBy("link_pos").select("movieId", F.concat(F.lit("tt"), F.col("movieId").cast("string")).alias("imdbId"),
                                   F.col("tmdbId").cast("double").alias("tmdbId"))
    wr.sink_csv(lk, path)
    return rd.scan_links(spark, path)


@query("scan_metadata", with_views("""
SELECT movieId, tmdbId, overview, "cast", director, release_year, poster_path, poster_url, fetch_status, fetch_error
FROM metadata"""))
def scan_metadata(spark, d):
    base = scratch_path(spark, "metadata")
    wr.sink_metadata(fx.metadata(spark, d), base)
    return rd.scan_metadata(spark, base)


@query("scan_pruned", with_views("""
SELECT userId, movieId, rating, genres, release_year FROM split_rows"""))
def scan_pruned(spark, d):
    path = scratch_path(spark, "rows")
    wr.sink_splits(ds.split_rows(spark, d), path)
    return rd.scan_pruned(spark, path, ["userId", "movieId", "rating", "genres", "release_year", "no_such_column"])


@query("scan_splits", with_views("""
SELECT split, count(*) AS n_rows, sum(rating) AS sum_rating FROM split_rows WHERE split IN ('val', 'test') GROUP BY split"""))
def scan_splits(spark, d):
    path = scratch_path(spark, "splits")
    wr.sink_splits(ds.split_rows(spark, d), path)
    return (rd.scan_splits(spark, path, ("val", "test")).groupBy("split")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("rating").alias("sum_rating")))


@query("sink_splits", with_views("SELECT split, count(*) AS n_rows FROM split_rows GROUP BY split"))
def sink_splits(spark, d):
    path = scratch_path(spark, "splits")
    wr.sink_splits(ds.split_rows(spark, d), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


@query("sink_metadata", with_views("""
SELECT movieId, tmdbId, overview, "cast", director, release_year, poster_path, poster_url, fetch_status, fetch_error
FROM metadata"""))
def sink_metadata(spark, d):
    base = scratch_path(spark, "metadata")
    wr.sink_metadata(fx.metadata(spark, d), base)
    # the CSV form, read back through the reader's CSV branch
    return rd.scan_metadata_csv(spark, f"{base}/metadata_df.csv")


@query("sink_catalog", with_views("SELECT * FROM serving_catalog"))
def sink_catalog(spark, d):
    path = scratch_path(spark, "catalog")
    wr.sink_catalog(ds.serving(spark, d), path)
    return spark.read.parquet(path)


@query("slim_catalog", with_views("""
SELECT movieId, title, genres, director, "cast", release_year, poster_url, rating_count FROM serving_catalog"""))
def slim_catalog(spark, d):
    return cat.slim_catalog(ds.serving(spark, d))
