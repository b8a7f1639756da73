"""Queries for §2.2 (metadata ingest)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metadata as md
from ..session import scratch_path
from ..sources import fixtures as fx
from ..sources.metadata_store import MetadataStore
from .oracle_views import EXTRA_VIEWS, with_views
from .registry import query

EXTRA_VIEWS.extend([
    ("parsed", """
SELECT tmdbId, coalesce(json_extract_string(body, '$.overview'), '') AS overview,
 array_to_string(list_filter(list_transform(
   (CAST(coalesce(json_extract(body, '$.credits.cast'), '[]') AS JSON[]))[1:5],
   lambda p: trim(coalesce(json_extract_string(p, '$.name'), ''))), lambda n: n <> ''), ', ') AS "cast",
 coalesce(trim(coalesce(json_extract_string(list_filter(CAST(coalesce(json_extract(body, '$.credits.crew'), '[]') AS JSON[]),
   lambda p: json_extract_string(p, '$.job') = 'Director')[1], '$.name'), '')), '') AS director,
 CASE WHEN length(json_extract_string(body, '$.release_date')) >= 4
   THEN TRY_CAST(substr(json_extract_string(body, '$.release_date'), 1, 4) AS INTEGER) END AS release_year,
 coalesce(json_extract_string(body, '$.poster_path'), '') AS poster_path,
 CASE WHEN coalesce(json_extract_string(body, '$.poster_path'), '') <> ''
   THEN concat('https://image.tmdb.org/t/p/w500', json_extract_string(body, '$.poster_path')) ELSE '' END AS poster_url,
 CASE WHEN valid THEN 'ok' ELSE 'error' END AS fetch_status,
 CASE WHEN valid THEN '' ELSE concat('Not a title record: ', payload) END AS fetch_error
FROM (SELECT tmdbId, payload, json_valid(payload) AS valid, CASE WHEN json_valid(payload) THEN payload ELSE '{}' END AS body FROM payload)"""),
    ("clinks", """SELECT movieId, CAST(tmdbId AS BIGINT) AS tmdbId FROM (
 SELECT *, row_number() OVER (PARTITION BY movieId ORDER BY link_pos) AS nth FROM links WHERE tmdbId IS NOT NULL) WHERE nth = 1"""),
    ("pending", "SELECT * FROM clinks WHERE movieId NOT IN (SELECT movieId FROM metadata_cache)"),
])


@query("rated_links", with_views("SELECT * FROM clinks WHERE movieId IN (SELECT movieId FROM ratings)"))
def rated_links(spark, d):
    return md.rated_links(fx.links(spark, d), fx.ratings(spark, d))


@query("pending_links", with_views("SELECT * FROM pending"))
def pending_links(spark, d):
    return md.pending_links(fx.links(spark, d), fx.metadata_cache(spark, d))


@query("payload_parse", with_views("SELECT * FROM parsed"))
def payload_parse(spark, d):
    return md.payload_parse(fx.payload(spark, d))


@query("extract_cast", with_views('SELECT tmdbId, "cast" FROM parsed'))
def extract_cast(spark, d):
    return md.payload_parse(fx.payload(spark, d)).select("tmdbId", "cast")


@query("extract_director", with_views("SELECT tmdbId, director FROM parsed"))
def extract_director(spark, d):
    return md.payload_parse(fx.payload(spark, d)).select("tmdbId", "director")


@query("parse_release_year", with_views("SELECT tmdbId, release_year FROM parsed"))
def parse_release_year(spark, d):
    return md.payload_parse(fx.payload(spark, d)).select("tmdbId", "release_year")


@query("poster_url", with_views("SELECT tmdbId, poster_url FROM parsed"))
def poster_url(spark, d):
    return md.payload_parse(fx.payload(spark, d)).select("tmdbId", "poster_url")


@query("metadata_upsert", with_views("""
SELECT movieId, tmdbId, overview, "cast", director, release_year, poster_path, poster_url, fetch_status, fetch_error FROM metadata_cache
UNION ALL
SELECT p.movieId, p.tmdbId, x.overview, x."cast", x.director, x.release_year, x.poster_path, x.poster_url,
 coalesce(x.fetch_status, 'not_found') AS fetch_status, coalesce(x.fetch_error, 'Movie not found on TMDb') AS fetch_error
FROM pending p LEFT JOIN parsed x ON p.tmdbId = x.tmdbId"""))
def metadata_upsert(spark, d):
    pend = md.pending_links(fx.links(spark, d), fx.metadata_cache(spark, d))
    return md.metadata_upsert(fx.metadata_cache(spark, d), pend, fx.payload(spark, d))


@query("metadata_ingest", with_views("""
SELECT movieId, tmdbId, overview, "cast", director, release_year, poster_path, poster_url, fetch_status, fetch_error,
 count(*) FILTER (fetch_status = 'ok') OVER () AS ok_total, count(*) OVER () AS rows_total
FROM (SELECT movieId, tmdbId, overview, "cast", director, release_year, poster_path, poster_url, fetch_status, fetch_error FROM metadata_cache
 UNION ALL
 SELECT p.movieId, p.tmdbId, x.overview, x."cast", x.director, x.release_year, x.poster_path, x.poster_url,
  coalesce(x.fetch_status, 'not_found'), coalesce(x.fetch_error, 'Movie not found on TMDb')
 FROM pending p LEFT JOIN parsed x ON p.tmdbId = x.tmdbId)"""))
def metadata_ingest(spark, d):
    """The upsert through the bucketed store: the cache as its first version, then the pending links."""
    store = MetadataStore(spark, scratch_path(spark, "metadata-store"), buckets=16)
    store.ingest(fx.metadata_cache(spark, d))
    store.ingest(md.fetched_rows(md.pending_links(fx.links(spark, d), store.read()), fx.payload(spark, d)))
    counts = store.counts()
    return (store.read().withColumn("ok_total", F.lit(counts.get("ok", 0)).cast("long"))
            .withColumn("rows_total", F.lit(sum(counts.values())).cast("long")))


@query("movies_with_metadata", with_views("""
SELECT m.movieId, m.title, m.genres, md.tmdbId, md.overview, md."cast", md.director, md.release_year, md.poster_path,
 md.poster_url, md.fetch_status, md.fetch_error
FROM movies m JOIN metadata md ON m.movieId = md.movieId"""))
def movies_with_metadata(spark, d):
    return md.movies_with_metadata(fx.movie_titles(spark, d), fx.metadata(spark, d))
