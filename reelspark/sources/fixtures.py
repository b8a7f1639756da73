"""Input views of FIXTURES.md, derived by Spark from the given parquet tables.

Each function reads only the columns it needs, so the parquet scan is pruned. The
views are what the library's operators consume: ratings, movies, links, metadata,
payload, feedback events, profiles and movie factors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.feedback import feedback_state
from .tables import table

# FIXED VALUES (test-data definition, FIXTURES.md): the 13 genres the rule tables name.
FIXTURE_GENRES = [
    "Action", "Adventure", "Thriller", "Mystery", "Crime", "Sci-Fi", "Fantasy",
    "Drama", "Romance", "War", "Horror", "Comedy", "Family",
]
# FIXED VALUES (test-data definition): title prefixes by movieId % 50.
FIXTURE_TITLE_PREFIX = {7: "Star Wars ", 11: "Harry Potter ", 13: "Mission: Impossible ",
                        17: "Avengers ", 19: "Skyfall ", 23: "The Hobbit "}
# FIXED VALUES (test-data definition): search queries.
FIXTURE_QUERIES = ["star wars", "red widget", "sci-fi brand#1", "  Skyfall  ", "ring 19", "x", ""]


#: Test-data definition: a profile has at most so many seeds, as many as the feature allows.
MAX_SEEDS = 10


def _genre_at(idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(g) for g in FIXTURE_GENRES]), (idx % 13 + 1).cast("int"))


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """movieId, title_year, title, genres, director, release_year, poster_url, fetch_status."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    t = p.select(
        F.col("p_partkey").cast("long").alias("movieId"), "p_name", "p_brand", "p_size",
        (F.lit(1930) + (F.col("p_partkey") * 7 + F.col("p_size")) % 97).cast("int").alias("title_year"),
        _genre_at(F.col("p_partkey")).alias("g1"),
        _genre_at(F.col("p_size")).alias("g2"),
        _genre_at(F.col("p_partkey") + F.col("p_size") * 3).alias("g3"),
    )
    mid = F.col("movieId")
    prefix = F.lit("")
    for k in sorted(FIXTURE_TITLE_PREFIX, reverse=True):
        prefix = F.when(mid % 50 == k, F.lit(FIXTURE_TITLE_PREFIX[k])).otherwise(prefix)
    year_part = F.when(mid % 29 == 0, F.lit("")).otherwise(
        F.concat(F.lit(" ("), F.col("title_year").cast("string"), F.lit(")")))
    title = F.concat(prefix, F.col("p_name"), F.lit(" "), mid.cast("string"), year_part)
    genres = (
        F.when(mid % 97 == 5, F.lit(None).cast("string"))
        .when(F.col("p_size") % 10 == 0, F.lit("(no genres listed)"))
        .otherwise(F.concat(
            F.col("g1"),
            F.when(F.col("g2") != F.col("g1"), F.concat(F.lit("|"), F.col("g2"))).otherwise(F.lit("")),
            F.when((F.col("g3") != F.col("g1")) & (F.col("g3") != F.col("g2")),
                   F.concat(F.lit("|"), F.col("g3"))).otherwise(F.lit("")),
        ))
    )
    poster = (F.when(mid % 11 == 0, F.lit(None).cast("string")).when(mid % 11 == 1, F.lit(""))
              .otherwise(F.concat(F.lit("https://img.example/"), mid.cast("string"), F.lit(".jpg"))))
    status = (F.when(mid % 23 == 0, F.lit("not_found")).when(mid % 31 == 0, F.lit("error"))
              .otherwise(F.lit("ok")))
    return t.select(
        "movieId", "title_year", title.alias("title"), genres.alias("genres"),
        F.col("p_brand").alias("director"),
        F.when(mid % 37 == 0, F.lit(None).cast("int")).otherwise(F.col("title_year")).alias("release_year"),
        poster.alias("poster_url"), status.alias("fetch_status"),
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """userId, movieId, rating, timestamp plus the unique tie key (l_orderkey, l_linenumber)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_shipdate")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(od, li.l_orderkey == od.o_orderkey).select(
        F.col("o_custkey").alias("userId"),
        F.col("l_partkey").alias("movieId"),
        (((F.col("l_quantity").cast("int") - 1) % 10) * 0.5 + 0.5).cast("double").alias("rating"),
        F.unix_timestamp("l_shipdate").alias("timestamp"),
        "l_orderkey", "l_linenumber",
    )


def feedback_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, session_id, movieId, vote (+1 / -1)."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    return ev.where(F.col("event_type").isin("click", "purchase", "error")).select(
        "event_id", "ts", F.col("user_id").alias("session_id"),
        F.get_json_object("props", "$.k").cast("long").alias("movieId"),
        F.when(F.col("event_type").isin("click", "purchase"), F.lit(1)).otherwise(F.lit(-1)).alias("vote"),
    )


def favourite_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Favourites events per session: view = add, error = remove, signup = clear-all."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    return ev.where(F.col("event_type").isin("view", "error", "signup")).select(
        "event_id", "ts", F.col("user_id").alias("session_id"),
        F.get_json_object("props", "$.k").cast("long").alias("movieId"),
        F.when(F.col("event_type") == "view", F.lit("add")).when(F.col("event_type") == "error", F.lit("remove"))
        .otherwise(F.lit("clear")).alias("action"),
    )


def _tmdb_id(mid: Column) -> Column:
    return F.when(mid % 41 == 0, F.lit(None).cast("long")).otherwise(mid + 100000)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """movieId, tmdbId, link_pos: the links table in its own order. Every seventh movie has a
    second, later link with a smaller tmdbId, which loses."""
    m = movies(spark, sf_dir).select("movieId")
    mid = F.col("movieId")
    first = m.select("movieId", _tmdb_id(mid).alias("tmdbId"), (2 * mid).alias("link_pos"))
    again = m.where(mid % 7 == 0).select("movieId", (mid + 50).alias("tmdbId"), (2 * mid + 1).alias("link_pos"))
    return first.unionByName(again)


def payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tmdbId, payload: the raw JSON body a metadata fetch returns (only found titles)."""
    m = movies(spark, sf_dir).select("movieId", "title_year", "director")
    mid = F.col("movieId")
    cast_offsets = [0, 31, None, 93, 124, 155, 186]   # the third name is blank on purpose
    cast = F.array(*[
        F.struct((F.lit("") if off is None else F.concat(F.lit("Actor "), ((mid + off) % 200).cast("string"))).alias("name"))
        for off in cast_offsets
    ])
    writer = F.struct(F.lit("Writer").alias("job"), F.lit("W").alias("name"))
    director = F.struct(F.lit("Director").alias("job"), F.col("director").alias("name"))
    crew = F.when(mid % 19 == 0, F.array(writer)).otherwise(F.array(writer, director))
    body = F.struct(
        F.concat(F.lit("Plot "), mid.cast("string")).alias("overview"),
        F.when(mid % 11 < 2, F.lit("")).otherwise(F.concat(F.lit("/"), mid.cast("string"), F.lit(".jpg"))).alias("poster_path"),
        F.when(mid % 37 == 0, F.lit("")).otherwise(F.concat(F.col("title_year").cast("string"), F.lit("-06-01"))).alias("release_date"),
        F.struct(cast.alias("cast"), crew.alias("crew")).alias("credits"),
    )
    broken = F.when(mid % 46 == 9, F.lit("upstream timeout")).when(mid % 46 == 18, F.substring(F.to_json(body), 1, 40))
    return m.where(mid % 23 != 0).select((mid + 100000).alias("tmdbId"), F.coalesce(broken, F.to_json(body)).alias("payload"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata table (all fetch statuses), in its fixed column order."""
    m = movies(spark, sf_dir)
    mid = F.col("movieId")
    return m.select(
        "movieId", _tmdb_id(mid).alias("tmdbId"),
        F.concat(F.lit("Plot "), mid.cast("string")).alias("overview"),
        F.concat(F.lit("Actor "), (mid % 200).cast("string"), F.lit(", Actor "), ((mid + 31) % 200).cast("string")).alias("cast"),
        "director", "release_year",
        F.when(F.col("poster_url").isNull() | (F.col("poster_url") == ""), F.lit(""))
        .otherwise(F.concat(F.lit("/"), mid.cast("string"), F.lit(".jpg"))).alias("poster_path"),
        "poster_url", "fetch_status",
        F.when(F.col("fetch_status") == "error", F.lit("timeout"))
        .when(F.col("fetch_status") == "not_found", F.lit("Movie not found on TMDb")).otherwise(F.lit("")).alias("fetch_error"),
    )


def metadata_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows already fetched before a metadata run: every third movie."""
    return metadata(spark, sf_dir).where(F.col("movieId") % 3 == 0)


def movie_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw movies file: movieId, title, genres."""
    return movies(spark, sf_dir).select("movieId", "title", "genres")


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movie factor table: movieId, factor array<double> (64). Its ids are the model's movies."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return e.select(F.col("vec_id").alias("movieId"),
                    F.transform("embedding", lambda x: x.cast("double")).alias("factor"))


def queries(spark: SparkSession) -> DataFrame:
    rows = [(i, q) for i, q in enumerate(FIXTURE_QUERIES)]
    return spark.createDataFrame(rows, "query_id long, query string")


def seed_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user is a profile; seeds are their ten best-rated model movies with genres and year.

    One row per (user, movie) first (the latest rating wins), as a hash aggregate; the
    top ten per user are then a window-group-limit (partial top-k before the shuffle).
    """
    from pyspark.sql import Window

    r = ratings(spark, sf_dir)
    m = movies(spark, sf_dir).where(F.col("genres").isNotNull() & F.col("release_year").isNotNull()).select("movieId")
    known = factors(spark, sf_dir).select("movieId")
    last = (r.join(m, "movieId", "left_semi").join(known, "movieId", "left_semi")
            .groupBy("userId", "movieId")
            .agg(F.max_by(F.struct("rating", "timestamp"),
                          F.struct("timestamp", "l_orderkey", "l_linenumber")).alias("v"))
            .select("userId", "movieId", F.col("v.rating").alias("rating"), F.col("v.timestamp").alias("timestamp")))
    w = Window.partitionBy("userId").orderBy(F.col("rating").desc(), F.col("timestamp"), F.col("movieId"))
    return (last.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= MAX_SEEDS)
            .select(F.col("userId").alias("profile_id"), "movieId", F.col("pos").cast("int").alias("pos"),
                    F.lit("seed").alias("role")))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds plus likes / dislikes from the final feedback state of the same session id."""
    seeds = seed_profiles(spark, sf_dir)
    state = feedback_state(feedback_events(spark, sf_dir))
    fb = state.join(seeds.select("profile_id").distinct(), state.session_id == seeds.profile_id, "left_semi")
    fb = fb.select(F.col("session_id").alias("profile_id"), "movieId", F.lit(0).alias("pos"),
                   F.when(F.col("vote") > 0, F.lit("like")).otherwise(F.lit("dislike")).alias("role"))
    return seeds.unionByName(fb)
