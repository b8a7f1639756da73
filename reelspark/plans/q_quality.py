"""Queries for §2.4 (cleaning, audit, sampling)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as qa
from . import datasets as ds
from .oracle_views import with_views
from .registry import query

CLEAN_COLS = ["userId", "movieId", "rating", "timestamp", "genres", "release_year", "l_orderkey", "l_linenumber"]
NOT_NULL = "userId IS NOT NULL AND movieId IS NOT NULL AND rating IS NOT NULL AND genres IS NOT NULL AND release_year IS NOT NULL"


@query("clean_ratings", with_views(f"""
SELECT userId, movieId, rating, "timestamp", genres, release_year, l_orderkey, l_linenumber FROM (
 SELECT *, row_number() OVER (PARTITION BY userId, movieId ORDER BY "timestamp" DESC, l_orderkey DESC, l_linenumber DESC) AS rn
 FROM raw_rows WHERE {NOT_NULL}) t WHERE rn = 1"""))
def clean_ratings(spark, d):
    return qa.clean_ratings(ds.raw_rows(spark, d)).select(*CLEAN_COLS)


@query("clean_stats", with_views(f"""
SELECT count(*) AS rows_in,
 (SELECT count(*) FROM (SELECT DISTINCT userId, movieId FROM raw_rows WHERE {NOT_NULL})) AS rows_out,
 count(*) FILTER (WHERE NOT ({NOT_NULL})) AS dropped_na,
 count(*) - count(*) FILTER (WHERE NOT ({NOT_NULL}))
  - (SELECT count(*) FROM (SELECT DISTINCT userId, movieId FROM raw_rows WHERE {NOT_NULL})) AS dropped_duplicates
FROM raw_rows"""))
def clean_stats(spark, d):
    return qa.clean_stats(ds.raw_rows(spark, d))


@query("audit_missing", with_views("""
SELECT column_name, na_count, rows FROM (
 SELECT count(*) AS rows,
  count(*) FILTER (WHERE userId IS NULL) AS userId, count(*) FILTER (WHERE movieId IS NULL) AS movieId,
  count(*) FILTER (WHERE rating IS NULL) AS rating, count(*) FILTER (WHERE "timestamp" IS NULL) AS "timestamp",
  count(*) FILTER (WHERE genres IS NULL) AS genres, count(*) FILTER (WHERE release_year IS NULL) AS release_year,
  count(*) FILTER (WHERE director IS NULL) AS director, count(*) FILTER (WHERE "cast" IS NULL) AS "cast"
 FROM raw_rows) UNPIVOT (na_count FOR column_name IN (userId, movieId, rating, "timestamp", genres, release_year, director, "cast"))"""))
def audit_missing(spark, d):
    return qa.audit_missing(ds.raw_rows(spark, d))


@query("assert_clean", with_views("""
SELECT * FROM (
 SELECT 'null' AS "check", 'genres' AS column_name, count(*) FILTER (WHERE genres IS NULL) AS n FROM raw_rows
 UNION ALL SELECT 'null', 'release_year', count(*) FILTER (WHERE release_year IS NULL) FROM raw_rows
 UNION ALL SELECT 'null', 'userId', count(*) FILTER (WHERE userId IS NULL) FROM raw_rows
 UNION ALL SELECT 'null', 'movieId', count(*) FILTER (WHERE movieId IS NULL) FROM raw_rows
 UNION ALL SELECT 'null', 'rating', count(*) FILTER (WHERE rating IS NULL) FROM raw_rows
 UNION ALL SELECT 'duplicate_pair', 'userId,movieId',
   count(*) - (SELECT count(*) FROM (SELECT DISTINCT userId, movieId FROM raw_rows)) FROM raw_rows
) WHERE n > 0"""))
def assert_clean(spark, d):
    """The violation table the assertion raises on (here over the raw, uncleaned rows)."""
    return qa.clean_violations(ds.raw_rows(spark, d))


@query("sample_exact_n", with_views("""
SELECT userId, movieId, rating, "timestamp" FROM ratings
ORDER BY md5(concat_ws(':', '42', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR))), l_orderkey, l_linenumber
LIMIT 1000"""))
def sample_exact_n(spark, d):
    from ..sources import fixtures as fx
    return qa.sample_exact_n(fx.ratings(spark, d), 1000, ["l_orderkey", "l_linenumber"], seed=42).select(
        "userId", "movieId", "rating", "timestamp")


@query("full_dataset", with_views(f"""
SELECT userId, movieId, rating, "timestamp", split FROM (
 SELECT *, row_number() OVER (PARTITION BY userId, movieId ORDER BY
   CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END DESC, "timestamp" DESC, l_orderkey DESC, l_linenumber DESC) AS rn
 FROM split_rows WHERE {NOT_NULL}) t WHERE rn = 1"""))
def full_dataset(spark, d):
    return qa.full_dataset(ds.split_rows(spark, d)).select("userId", "movieId", "rating", "timestamp", "split")


@query("eval_universe", with_views("""
SELECT userId, movieId, rating, split FROM split_rows
WHERE split <> 'train'
 AND userId IN (SELECT userId FROM split_rows WHERE split = 'train')
 AND movieId IN (SELECT movieId FROM split_rows WHERE split = 'train')"""))
def eval_universe(spark, d):
    rows = ds.split_rows(spark, d)
    train = ds.split_of(rows, "train")
    return qa.eval_universe(rows.where(F.col("split") != "train"), train).select("userId", "movieId", "rating", "split")
