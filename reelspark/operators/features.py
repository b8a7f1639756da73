"""Item features and id mappings.

Content vector of a movie: multi-hot over the sorted genre vocabulary, then the year
z-score (null year -> median; mean and sample std taken after the fill), L2-normalised
(an all-zero vector stays zero). Vectors are ``array<double>``.

The vocabulary and the three year statistics are small aggregates (a few dozen genres,
three numbers); they are computed by Spark and inlined into the vector expression as
literals, so the per-movie work is one projection with no join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import split_genres


def feature_stats(movies: DataFrame, genres: str = "genres", year: str = "release_year"):
    """(vocabulary, (median, mean, sample std)) in ONE aggregate pass: the distinct genre
    lists (bounded by the number of genre combinations), the exact median of the years
    (one count per distinct year), and the sums that give mean and std after the median fill."""
    from ..functions.memo import memo_stat

    y = F.col(year).cast("double")
    src = movies.select(split_genres(genres).alias("_g"), y.alias("_y"))

    def compute():
        r = src.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_g")))).alias("vocab"),
                    F.median("_y").alias("med"), F.sum("_y").alias("s"), F.sum(F.col("_y") * F.col("_y")).alias("ss"),
                    F.count("_y").alias("k"), F.count(F.lit(1)).alias("n")).first()
        vocab = list(r["vocab"] or [])
        med = r["med"]
        if med is None:
            return vocab, (None, None, None)
        n, k = r["n"], r["k"]
        s = r["s"] + (n - k) * med
        ss = r["ss"] + (n - k) * med * med
        mean = s / n
        std = math.sqrt(max(ss - n * mean * mean, 0.0) / (n - 1)) if n > 1 else None
        return vocab, (med, mean, std)

    return memo_stat(src, "feature_stats", compute)


def genre_vocabulary(movies: DataFrame, genres: str = "genres") -> list[str]:
    """Sorted distinct genres (bounded by the genre count, so it is collected)."""
    return feature_stats(movies, genres)[0]


def genre_vocabulary_df(movies: DataFrame, genres: str = "genres") -> DataFrame:
    from pyspark.sql import Window

    d = movies.select(F.explode(split_genres(genres)).alias("genre")).distinct()
    return d.select((F.row_number().over(Window.orderBy("genre")) - 1).alias("idx"), "genre")


def multihot(vocab: list[str], genres: str | Column = "genres") -> Column:
    """array<double>: 1.0 where the vocabulary genre is present; unknown genres ignored.
    ``genres`` may be a genres string column or an already split array column."""
    g = genres if isinstance(genres, Column) else split_genres(genres)
    if not vocab:
        return F.array().cast("array<double>")
    voc = F.array(*[F.lit(v) for v in vocab])
    return F.transform(voc, lambda v: F.when(F.array_contains(g, v), F.lit(1.0)).otherwise(F.lit(0.0)))


def year_stats(movies: DataFrame, year: str = "release_year") -> tuple[float | None, float | None, float | None]:
    """(median, mean, sample std) with nulls filled by the median."""
    return feature_stats(movies, year=year)[1]


def year_z(stats, year: str = "release_year") -> Column:
    med, mean, std = stats
    if med is None:                      # no year at all: pandas fills NaN and the z is NaN
        return F.lit(float("nan"))
    std = float("nan") if std is None else std
    return (F.coalesce(F.col(year).cast("double"), F.lit(med)) - F.lit(mean)) / (F.lit(std) + F.lit(1e-8))


def l2_normalize(df: DataFrame, col: str, out: str) -> DataFrame:
    """``out`` = ``col`` / its L2 norm (zero vectors stay zero). The norm is a column of its
    own, so the per-element division reads it instead of re-evaluating it in the lambda."""
    norm = F.sqrt(F.aggregate(F.col(col), F.lit(0.0), lambda acc, x: acc + x * x))
    df = df.withColumn("_norm", norm)
    return df.withColumn(out, F.when(F.col("_norm") > 0, F.transform(col, lambda x: x / F.col("_norm")))
                         .otherwise(F.col(col))).drop("_norm")


def content_vectors(movies: DataFrame, vocab: list[str] | None = None, stats=None) -> tuple[DataFrame, list[str]]:
    """(movieId, content) for the given movies, and the vocabulary used. Each step is its own
    column (genres once, raw vector once, norm once): lambdas get no common-subexpression
    elimination, so nothing heavy is referenced from inside one."""
    vocab = genre_vocabulary(movies) if vocab is None else vocab
    stats = year_stats(movies) if stats is None else stats
    x = movies.select("movieId", "release_year", split_genres("genres").alias("_g"))
    x = x.select("movieId", F.concat(multihot(vocab, F.col("_g")), F.array(year_z(stats))).alias("_raw"))
    return l2_normalize(x, "_raw", "content").select("movieId", "content"), vocab


def dense_index(ids: DataFrame, col: str, idx: str = "idx") -> DataFrame:
    """Sorted distinct ids -> 0..n-1 without pulling them into one task.

    Range-partition and sort the distinct ids; ``monotonically_increasing_id`` then carries
    (partition, position); per-partition counts (one row per partition) give the offsets.
    The ranked table is checkpointed so both uses see the same assignment, also after a
    lost executor.
    """
    d = ids.select(col).where(F.col(col).isNotNull()).distinct()
    r = d.repartitionByRange(col).sortWithinPartitions(col).withColumn("_m", F.monotonically_increasing_id())
    r = r.select(col, F.shiftright("_m", 33).alias("_p"), (F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).alias("_r"))
    r = r.checkpoint(eager=True)
    counts = r.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    from pyspark.sql import Window

    offs = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
                         .alias("_off"))
    offs = offs.select("_p", F.coalesce("_off", F.lit(0)).alias("_off"))
    return r.join(F.broadcast(offs), "_p").select(col, (F.col("_off") + F.col("_r")).alias(idx))


def content_lookup(mapping: DataFrame, vectors: DataFrame, dim: int, idx: str = "midx") -> DataFrame:
    """(idx, movieId, content): vector per mapped movie, zeros where it has none."""
    zeros = F.array_repeat(F.lit(0.0), dim)
    return (mapping.join(vectors, "movieId", "left")
            .select(idx, "movieId", F.coalesce(F.col("content"), zeros).alias("content")))


def encode_rows(rows: DataFrame, user_map: DataFrame, movie_map: DataFrame, check: bool = True) -> DataFrame:
    """(uidx, midx, rating). An id missing from a mapping is an error."""
    if check:
        missing = (rows.join(user_map, "userId", "left_anti").limit(1).count()
                   + rows.join(movie_map, "movieId", "left_anti").limit(1).count())
        if missing:
            raise ValueError("rows contain user or movie ids that are not in the mappings")
    return (rows.join(user_map, "userId").join(movie_map, "movieId")
            .select("uidx", "midx", F.col("rating").cast("double").alias("rating")))
