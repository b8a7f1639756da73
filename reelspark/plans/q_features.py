"""Queries for §2.5 (features and mappings)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import split_genres as _split_genres
from ..operators import features as fe
from ..operators import quality as qa
from ..sources import fixtures as fx
from . import datasets as ds
from .oracle_views import EXTRA_VIEWS, with_views
from .registry import query

NOT_NULL = "userId IS NOT NULL AND movieId IS NOT NULL AND rating IS NOT NULL AND genres IS NOT NULL AND release_year IS NOT NULL"
GLIST = ("CASE WHEN genres IS NULL OR trim(genres) = '' THEN CAST([] AS VARCHAR[]) "
         "ELSE list_filter(string_split(genres, '|'), lambda x: x <> '' AND x <> '(no genres listed)') END")

EXTRA_VIEWS.extend([
    ("train_clean", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY userId, movieId
  ORDER BY "timestamp" DESC, l_orderkey DESC, l_linenumber DESC) AS rn
 FROM split_rows WHERE split = 'train' AND {NOT_NULL}) t WHERE rn = 1"""),
    ("feat_g", f"""
SELECT movieId, release_year, {GLIST} AS glist FROM (SELECT DISTINCT movieId, genres, release_year FROM train_clean) m"""),
    ("vocab", """
SELECT CAST(row_number() OVER (ORDER BY genre) - 1 AS INTEGER) AS idx, genre
FROM (SELECT DISTINCT unnest(glist) AS genre FROM feat_g) g"""),
    ("ystats", """
SELECT med, avg(coalesce(CAST(release_year AS DOUBLE), med)) AS mean,
 stddev_samp(coalesce(CAST(release_year AS DOUBLE), med)) AS sd
FROM feat_g, (SELECT median(CAST(release_year AS DOUBLE)) AS med FROM feat_g) s GROUP BY med"""),
    ("feat_raw", """
SELECT movieId, glist, (coalesce(CAST(release_year AS DOUBLE), med) - mean) / (sd + 1e-8) AS year_z,
 list_transform((SELECT list(genre ORDER BY genre) FROM vocab),
   lambda g: CASE WHEN list_contains(glist, g) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS mh
FROM feat_g, ystats"""),
    ("content", """
SELECT movieId, CASE WHEN nrm > 0 THEN list_transform(v, lambda x: x / nrm) ELSE v END AS content FROM (
 SELECT movieId, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nrm FROM (
  SELECT movieId, list_append(mh, year_z) AS v FROM feat_raw) a) b"""),
    ("movie_map", """
SELECT movieId, CAST(row_number() OVER (ORDER BY movieId) - 1 AS BIGINT) AS midx FROM factors"""),
    ("lookup", """
SELECT m.midx, m.movieId, coalesce(c.content, list_transform(range((SELECT count(*) FROM vocab) + 1),
  lambda i: CAST(0 AS DOUBLE))) AS content
FROM movie_map m LEFT JOIN content c ON m.movieId = c.movieId"""),
])


def train_clean(spark, d):
    return qa.clean_ratings(ds.split_of(ds.split_rows(spark, d), "train"))


def feature_movies(spark, d, splits=("train",)):
    """Distinct (movieId, genres, release_year) of the cleaned rows of the splits. Keeping one row
    per (user, movie) cannot change which movie rows occur, so only the null filter applies."""
    rows = ds.split_rows(spark, d).where(F.col("split").isin(*splits))
    req = F.lit(True)
    for c in qa.REQUIRED_COLS:
        req = req & F.col(c).isNotNull()
    return rows.where(req).select("movieId", "genres", "release_year").distinct()


def content_table(spark, d, splits=("train",)):
    """(movieId, content) for the movies of the splits, and the vector width."""
    vecs, vocab = fe.content_vectors(feature_movies(spark, d, splits))
    return vecs, len(vocab) + 1


def movie_map(spark, d):
    return fe.dense_index(fx.factors(spark, d), "movieId", "midx")


def model_content(spark, d):
    """(midx, movieId, content) for the model's movies (zeros for movies without features)."""
    vecs, dim = content_table(spark, d)
    return fe.content_lookup(movie_map(spark, d), vecs, dim)


@query("split_genres", with_views(f"""
SELECT movieId, array_to_string(glist, '|') AS genre_list, CAST(len(glist) AS INTEGER) AS n_genres
FROM (SELECT movieId, {GLIST} AS glist FROM serving_catalog) t"""))
def split_genres(spark, d):
    g = _split_genres("genres")
    return ds.serving(spark, d).select("movieId", F.array_join(g, "|").alias("genre_list"), F.size(g).alias("n_genres"))


@query("genre_vocabulary", with_views("SELECT idx, genre FROM vocab"))
def genre_vocabulary(spark, d):
    return fe.genre_vocabulary_df(feature_movies(spark, d)).select(F.col("idx").cast("int").alias("idx"), "genre")


@query("genre_multihot", with_views("""
SELECT movieId, array_to_string(list_transform(mh, lambda x: CAST(CAST(x AS INTEGER) AS VARCHAR)), '') AS bits FROM feat_raw"""))
def genre_multihot(spark, d):
    fm = feature_movies(spark, d)
    vocab = fe.genre_vocabulary(fm)
    mh = fe.multihot(vocab)
    return fm.select("movieId", F.array_join(F.transform(mh, lambda x: x.cast("int").cast("string")), "").alias("bits"))


@query("year_zscore", with_views("SELECT movieId, round(year_z, 6) AS year_z FROM feat_raw"))
def year_zscore(spark, d):
    fm = feature_movies(spark, d)
    return fm.select("movieId", F.round(fe.year_z(fe.year_stats(fm)), 6).alias("year_z"))


@query("content_vectors", with_views("""
SELECT movieId, CAST(unnest(range(len(content))) AS INTEGER) AS dim, round(unnest(content), 6) AS value FROM content"""))
def content_vectors(spark, d):
    vecs, _ = content_table(spark, d)
    return vecs.select("movieId", F.posexplode_outer("content").alias("dim", "value")).select(
        "movieId", "dim", F.round("value", 6).alias("value"))


@query("id_mapping", with_views("""
SELECT 'user' AS kind, userId AS id, CAST(row_number() OVER (ORDER BY userId) - 1 AS BIGINT) AS idx
FROM (SELECT DISTINCT userId FROM train_clean) u
UNION ALL
SELECT 'movie' AS kind, movieId AS id, CAST(row_number() OVER (ORDER BY movieId) - 1 AS BIGINT) AS idx
FROM (SELECT DISTINCT movieId FROM train_clean) m"""))
def id_mapping(spark, d):
    tc = train_clean(spark, d)
    u = fe.dense_index(tc, "userId").select(F.lit("user").alias("kind"), F.col("userId").alias("id"), "idx")
    m = fe.dense_index(tc, "movieId").select(F.lit("movie").alias("kind"), F.col("movieId").alias("id"), "idx")
    return u.unionByName(m)


@query("content_lookup", with_views("""
SELECT midx, movieId, CAST(unnest(range(len(content))) AS INTEGER) AS dim, round(unnest(content), 6) AS value FROM lookup"""))
def content_lookup(spark, d):
    return model_content(spark, d).select("midx", "movieId", F.posexplode_outer("content").alias("dim", "value")).select(
        "midx", "movieId", "dim", F.round("value", 6).alias("value"))


@query("encode_rows", with_views("""
SELECT u.uidx, m.midx, t.rating FROM train_clean t
JOIN (SELECT userId, CAST(row_number() OVER (ORDER BY userId) - 1 AS BIGINT) AS uidx FROM (SELECT DISTINCT userId FROM train_clean) x) u
 ON t.userId = u.userId
JOIN (SELECT movieId, CAST(row_number() OVER (ORDER BY movieId) - 1 AS BIGINT) AS midx FROM (SELECT DISTINCT movieId FROM train_clean) y) m
 ON t.movieId = m.movieId"""))
def encode_rows(spark, d):
    tc = train_clean(spark, d)
    um = fe.dense_index(tc, "userId", "uidx")
    mm = fe.dense_index(tc, "movieId", "midx")
    return fe.encode_rows(tc, um, mm)
