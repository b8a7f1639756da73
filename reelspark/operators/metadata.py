"""Metadata ingest, re-aimed: instead of calling a web API one title at a
time, a table of raw JSON payloads (one per fetched id) is parsed by Spark in bulk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules as R

PAYLOAD_SCHEMA = T.StructType([
    T.StructField("overview", T.StringType()),
    T.StructField("poster_path", T.StringType()),
    T.StructField("release_date", T.StringType()),
    T.StructField("credits", T.StructType([
        T.StructField("cast", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))),
        T.StructField("crew", T.ArrayType(T.StructType([T.StructField("job", T.StringType()),
                                                        T.StructField("name", T.StringType())]))),
    ])),
])
METADATA_ORDER = ["movieId", "tmdbId", "overview", "cast", "director", "release_year",
                  "poster_path", "poster_url", "fetch_status", "fetch_error"]
NOT_FOUND_ERROR = "Movie not found on TMDb"
BROKEN_ERROR = "Not a title record: "


def strip(text: Column) -> Column:
    """Text without the white space (tabs and line ends too) at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def extract_cast(cast: Column, limit: int = R.TOP_CAST) -> Column:
    """First ``limit`` names, trimmed; empty names dropped after the cut; joined ', '."""
    names = F.transform(F.slice(F.coalesce(cast, F.array()), 1, limit), lambda p: strip(F.coalesce(p["name"], F.lit(""))))
    return F.array_join(F.filter(names, lambda n: n != ""), ", ")


def extract_director(crew: Column) -> Column:
    """Name of the first crew entry with job 'Director', trimmed; '' if none."""
    d = F.try_element_at(F.filter(F.coalesce(crew, F.array()), lambda p: p["job"] == "Director"), F.lit(1))
    return F.coalesce(strip(F.coalesce(d["name"], F.lit(""))), F.lit(""))


def parse_release_year(date: Column) -> Column:
    """First four characters as an int; null if shorter or not a number."""
    return F.when(F.length(date) >= 4, F.substring(date, 1, 4).try_cast("int"))


def poster_url(path: Column) -> Column:
    return F.when(F.coalesce(path, F.lit("")) != "", F.concat(F.lit(R.POSTER_BASE), path)).otherwise(F.lit(""))


def payload_parse(payloads: DataFrame) -> DataFrame:
    """(tmdbId, payload JSON) -> parsed metadata fields with fetch_status 'ok', or 'error'
    with the reason and no fields for a body that is not the JSON of one title. A body that
    is a failed fetch's message is kept in the reason."""
    schema = T.StructType([*PAYLOAD_SCHEMA.fields, T.StructField("_corrupt", T.StringType())])
    j = payloads.select("tmdbId", "payload", F.from_json("payload", schema, {"columnNameOfCorruptRecord": "_corrupt"}).alias("j"))
    broken = F.col("payload").isNull() | F.col("j").isNull() | F.col("j._corrupt").isNotNull() \
        | ~F.coalesce(strip(F.col("payload")).startswith("{"), F.lit(False))
    path = F.coalesce(F.col("j.poster_path"), F.lit(""))
    fields = {
        "overview": F.coalesce(F.col("j.overview"), F.lit("")),
        "cast": extract_cast(F.col("j.credits.cast")),
        "director": extract_director(F.col("j.credits.crew")),
        "release_year": parse_release_year(F.col("j.release_date")),
        "poster_path": path,
        "poster_url": poster_url(path),
    }
    reason = F.concat(F.lit(BROKEN_ERROR), F.coalesce(F.col("payload"), F.lit("")))
    return j.select(
        "tmdbId",
        *[F.when(broken, F.lit(None) if name == "release_year" else F.lit("")).otherwise(value).alias(name)
          for name, value in fields.items()],
        F.when(broken, F.lit("error")).otherwise(F.lit("ok")).alias("fetch_status"),
        F.when(broken, reason).otherwise(F.lit("")).alias("fetch_error"),
    )


def clean_links(links: DataFrame) -> DataFrame:
    """Links with a tmdbId, as int, one per movie: the first in the table's order, which is
    its column ``link_pos`` if there is one, else the order in which Spark reads the rows."""
    pos = F.col("link_pos") if "link_pos" in links.columns else F.monotonically_increasing_id()
    ordered = links.where(F.col("tmdbId").isNotNull()).select("movieId", "tmdbId", pos.alias("_pos"))
    return ordered.groupBy("movieId").agg(F.min_by("tmdbId", "_pos").cast("long").alias("tmdbId"))


def rated_links(links: DataFrame, ratings: DataFrame) -> DataFrame:
    """Links whose movie has at least one rating (semi join on distinct rated ids)."""
    rated = ratings.select("movieId").distinct()
    return clean_links(links).join(rated, "movieId", "left_semi")


def pending_links(links: DataFrame, existing: DataFrame, limit: int | None = None,
                  retry_errors: bool = False) -> DataFrame:
    """Links not in the metadata yet (rows with status 'error' count as done unless
    ``retry_errors``); with ``limit``, the first ``limit`` by movieId."""
    done = existing if not retry_errors else existing.where(F.col("fetch_status") != "error")
    p = clean_links(links).join(done.select("movieId").distinct(), "movieId", "left_anti")
    return p.orderBy("movieId").limit(limit) if limit is not None else p


def fetched_rows(pending: DataFrame, payloads: DataFrame) -> DataFrame:
    """One row per pending link: parsed when a payload exists, else a 'not_found' row. Fixed
    column order."""
    parsed = payload_parse(payloads)
    new = pending.join(parsed, "tmdbId", "left")
    found = F.col("fetch_status").isNotNull()
    return new.select(
        "movieId", "tmdbId", "overview", "cast", "director", "release_year", "poster_path", "poster_url",
        F.when(found, F.col("fetch_status")).otherwise(F.lit("not_found")).alias("fetch_status"),
        F.when(found, F.col("fetch_error")).otherwise(F.lit(NOT_FOUND_ERROR)).alias("fetch_error"),
    )


def metadata_upsert(existing: DataFrame, pending: DataFrame, payloads: DataFrame) -> DataFrame:
    """Existing rows + one new row per pending link. (``MetadataStore.ingest`` keeps the table in
    buckets and rewrites only those with new rows.)"""
    new = fetched_rows(pending, payloads)
    old = existing.select(*[F.col(c).cast(new.schema[c].dataType) for c in METADATA_ORDER])
    return old.unionByName(new.select(*METADATA_ORDER))


def movies_with_metadata(movies: DataFrame, metadata: DataFrame) -> DataFrame:
    """movies ⋈ every metadata row (any status), inner."""
    return movies.join(metadata, "movieId")
