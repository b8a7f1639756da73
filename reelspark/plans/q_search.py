"""Queries for §2.7 (search and browse)."""

from __future__ import annotations

from ..functions.rules import FRANCHISE_PATTERNS
from ..operators import search as se
from ..sources import fixtures as fx
from . import datasets as ds
from .oracle_views import EXTRA_VIEWS, with_views
from .registry import query

AS_OF_YEAR = 2025

# queries table and the normalised tokens, in SQL
_QUERIES_SQL = " UNION ALL ".join(
    f"SELECT {i} AS query_id, '{q}' AS query" for i, q in enumerate(fx.FIXTURE_QUERIES))


def _franchise_case(col: str) -> str:
    parts = []
    for name, patterns in FRANCHISE_PATTERNS:
        cond = " OR ".join(f"strpos(lower({col}), '{p}') > 0" for p in patterns)
        parts.append(f"WHEN {cond} THEN '{name}'")
    return "CASE " + " ".join(parts) + " END"


def _franchise_members_sql(col: str) -> str:
    arms = []
    for name, patterns in FRANCHISE_PATTERNS:
        cond = " OR ".join(f"strpos(lower({col}), '{p}') > 0" for p in patterns)
        arms.append(f"SELECT movieId, title, release_year, '{name}' AS franchise FROM serving_catalog WHERE {cond}")
    return " UNION ALL ".join(arms)


EXTRA_VIEWS.extend([
    ("queries", _QUERIES_SQL),
    ("qnorm", """
SELECT query_id, q, list_filter(regexp_split_to_array(q, '\\s+'), lambda t: t <> '') AS tokens FROM (
 SELECT query_id, lower(regexp_replace(query, '^\\s+|\\s+$', '', 'g')) AS q FROM queries)"""),
    ("search_hits", """
SELECT query_id, q, tokens, c.movieId, c.title,
 CAST((CASE WHEN starts_with(lower(c.title), tokens[1]) THEN 10 ELSE 0 END)
  + (CASE WHEN strpos(lower(c.title), q) > 0 THEN 5 ELSE 0 END)
  + list_sum(list_transform(tokens, lambda t: CASE WHEN strpos(lower(c.title), t) > 0 THEN 1 ELSE 0 END)) AS INTEGER) AS search_rank
FROM serving_catalog c JOIN qnorm ON len(tokens) > 0
 AND list_bool_and(list_transform(tokens, lambda t: strpos(c.search_text, t) > 0))"""),
    ("franchise_members", _franchise_members_sql("title")),
])


def _search_sql(limit: int, min_chars: int) -> str:
    return with_views(f"""
SELECT query_id, CAST(pos AS INTEGER) AS pos, movieId, title, search_rank FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY search_rank DESC, movieId) AS pos
 FROM search_hits WHERE length(q) >= {min_chars}) t WHERE pos <= {limit}""")


@query("search_movies", _search_sql(20, 1))
def search_movies(spark, d):
    return se.search_movies(ds.serving(spark, d), fx.queries(spark), limit=20, index=ds.search_index(spark, d))


@query("suggest_movies", _search_sql(8, 2))
def suggest_movies(spark, d):
    return se.suggest_movies(ds.serving(spark, d), fx.queries(spark), limit=8, index=ds.search_index(spark, d))


@query("eligible_first", with_views("""
SELECT query_id, CAST(shown AS INTEGER) AS shown, movieId, title, eligible FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY eligible DESC, pos) AS shown FROM (
  SELECT s.*, CASE WHEN s.movieId IN (SELECT movieId FROM factors) THEN 1 ELSE 0 END AS eligible FROM (
   SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY search_rank DESC, movieId) AS pos
   FROM search_hits WHERE length(q) >= 2) s WHERE pos <= 16) u) v WHERE shown <= 8"""))
def eligible_first(spark, d):
    return se.eligible_first(ds.serving(spark, d), fx.queries(spark), ds.model_movie_ids(spark, d), index=ds.search_index(spark, d))


@query("movies_by_ids", with_views("""
SELECT p.profile_id, p.pos, c.movieId, c.title, c.genres, c.release_year
FROM seeds p JOIN serving_catalog c ON p.movieId = c.movieId"""))
def movies_by_ids(spark, d):
    return se.movies_by_ids(ds.serving(spark, d), fx.seed_profiles(spark, d)).select(
        "profile_id", "pos", "movieId", "title", "genres", "release_year")


@query("movie_label", with_views("""
SELECT movieId, concat(title, ' (', coalesce(CAST(release_year AS VARCHAR), '?'), ') — ', coalesce(genres, '')) AS label
FROM serving_catalog"""))
def movie_label(spark, d):
    return se.movie_labels(ds.serving(spark, d))


@query("detect_franchise", with_views(f"""
SELECT movieId, title, franchise FROM (SELECT movieId, title, {_franchise_case('title')} AS franchise FROM serving_catalog)
WHERE franchise IS NOT NULL"""))
def detect_franchise(spark, d):
    return se.detect_franchise(ds.serving(spark, d))


@query("franchise_suggestions", with_views(f"""
SELECT profile_id, CAST(pos AS INTEGER) AS pos, movieId, title, franchise, concat('More in the ', franchise, ' series') AS reason FROM (
 SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY franchise, release_year ASC NULLS LAST, movieId) AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY profile_id, movieId ORDER BY franchise) AS f1 FROM (
   SELECT pf.profile_id, m.movieId, m.title, m.release_year, m.franchise
   FROM (SELECT DISTINCT s.profile_id, {_franchise_case('c.title')} AS franchise
         FROM seeds s JOIN serving_catalog c ON s.movieId = c.movieId) pf
   JOIN franchise_members m ON pf.franchise = m.franchise
   WHERE NOT EXISTS (SELECT 1 FROM seeds s2 WHERE s2.profile_id = pf.profile_id AND s2.movieId = m.movieId)) a) b
 WHERE f1 = 1) c WHERE pos <= 8"""))
def franchise_suggestions(spark, d):
    return se.franchise_suggestions(ds.serving(spark, d), fx.seed_profiles(spark, d))


@query("title_year", with_views("""
SELECT movieId, CAST(NULLIF(regexp_extract(title, '\\((\\d{4})\\)', 1), '') AS INTEGER) AS title_year FROM serving_catalog"""))
def title_year(spark, d):
    return se.title_years(ds.serving(spark, d))


@query("latest_movies", with_views(f"""
SELECT CAST(row_number() OVER (ORDER BY title_year DESC, rating_count DESC, movieId DESC) AS INTEGER) AS pos,
 movieId, title, title_year, rating_count, poster_url FROM (
 SELECT movieId, title, poster_url, coalesce(rating_count, 0) AS rating_count,
  CAST(NULLIF(regexp_extract(title, '\\((\\d{{4}})\\)', 1), '') AS INTEGER) AS title_year
 FROM serving_catalog WHERE movieId IN (SELECT movieId FROM factors)) t
WHERE title_year BETWEEN {max(2015, AS_OF_YEAR - 8)} AND {AS_OF_YEAR + 1} AND poster_url IS NOT NULL AND length(poster_url) > 0
ORDER BY title_year DESC, rating_count DESC, movieId DESC LIMIT 12"""))
def latest_movies(spark, d):
    return se.latest_movies(ds.serving(spark, d), AS_OF_YEAR, limit=12, eligible_ids=ds.model_movie_ids(spark, d))


@query("prune_unsupported", with_views("""
SELECT profile_id, movieId, pos FROM profiles WHERE role = 'seed' AND movieId IN (SELECT movieId FROM factors)"""))
def prune_unsupported(spark, d):
    return se.prune_unsupported(fx.seed_profiles(spark, d), ds.model_movie_ids(spark, d)).select("profile_id", "movieId", "pos")
