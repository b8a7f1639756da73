"""Queries for §2.3 (catalog, join, split)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as cat
from ..sources import fixtures as fx
from . import datasets as ds
from .oracle_views import with_views
from .registry import query

SPLIT_COLS = ["userId", "movieId", "rating", "timestamp", "l_orderkey", "l_linenumber", "split"]


@query("build_catalog", with_views("SELECT * FROM catalog"))
def build_catalog(spark, d):
    return ds.catalog(spark, d)


@query("join_ratings", with_views("""
SELECT r.userId, r.movieId, r.rating, r."timestamp", r.l_orderkey, r.l_linenumber,
 k.title, k.genres, k.tmdbId, k.director, k."cast", k.release_year, k.poster_url
FROM ratings r JOIN catalog k ON r.movieId = k.movieId"""))
def join_ratings(spark, d):
    return cat.join_ratings(fx.ratings(spark, d), ds.catalog(spark, d))


@query("narrow_types", with_views("""
SELECT movieId, CAST(release_year AS INTEGER) AS release_year, CAST(title AS VARCHAR) AS title,
 CAST(genres AS VARCHAR) AS genres, CAST(director AS VARCHAR) AS director FROM catalog"""))
def narrow_types(spark, d):
    return cat.narrow_types(ds.catalog(spark, d)).select("movieId", "release_year", "title", "genres", "director")


@query("split_cutoffs", with_views("SELECT c1 AS val_cutoff, c2 AS test_cutoff FROM cutoffs"))
def split_cutoffs(spark, d):
    c1, c2 = cat.split_cutoffs(fx.ratings(spark, d))
    return spark.createDataFrame([(c1, c2)], "val_cutoff double, test_cutoff double")


@query("temporal_split", with_views("""
SELECT r.userId, r.movieId, r.rating, r."timestamp", r.l_orderkey, r.l_linenumber,
 CASE WHEN r."timestamp" < c.c1 THEN 'train' WHEN r."timestamp" < c.c2 THEN 'val' ELSE 'test' END AS split
FROM ratings r CROSS JOIN cutoffs c"""))
def temporal_split(spark, d):
    return cat.temporal_split(fx.ratings(spark, d)).select(*SPLIT_COLS)


@query("split_pipeline", with_views("""
SELECT split, count(*) AS n_rows FROM split_rows GROUP BY split"""))
def split_pipeline(spark, d):
    from ..sources.writers import sink_splits
    from ..session import scratch_path
    from ..sources.readers import scan_splits
    path = scratch_path(spark, "splits")
    sink_splits(ds.split_rows(spark, d), path)
    return scan_splits(spark, path).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


@query("unique_movies", with_views("""
SELECT DISTINCT movieId, genres, release_year FROM split_rows"""))
def unique_movies(spark, d):
    return cat.unique_movies(ds.split_rows(spark, d))


@query("serving_catalog", with_views("SELECT * FROM serving_catalog"))
def serving_catalog(spark, d):
    return ds.serving(spark, d)


@query("search_text", with_views("SELECT movieId, search_text FROM serving_catalog"))
def search_text(spark, d):
    return ds.serving(spark, d).select("movieId", "search_text")


@query("rating_counts", with_views("""
SELECT movieId, CAST(count(*) AS INTEGER) AS rating_count FROM split_rows GROUP BY movieId"""))
def rating_counts(spark, d):
    return cat.rating_counts(ds.split_rows(spark, d))
