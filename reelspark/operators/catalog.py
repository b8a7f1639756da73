"""Catalog, rating join and time split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import search_text as _search_text

# FIXED VALUES: column orders of the catalog tables.
MOVIE_COLUMNS = ["movieId", "title", "genres", "tmdbId", "director", "cast", "release_year", "poster_url", "overview"]
SERVING_COLUMNS = ["movieId", "title", "genres", "director", "cast", "release_year", "poster_url"]
SPLITS = ["train", "val", "test"]


def build_catalog(movies: DataFrame, metadata: DataFrame) -> DataFrame:
    """movies ⋈ metadata where the fetch succeeded, in the fixed column order."""
    ok = metadata.where(F.col("fetch_status") == "ok").drop("fetch_status")
    joined = movies.join(ok, "movieId")
    return joined.select(*[c for c in MOVIE_COLUMNS if c in joined.columns])


def movie_columns(catalog: DataFrame, slim: bool = True) -> list[str]:
    cols = [c for c in MOVIE_COLUMNS if c in catalog.columns]
    return [c for c in cols if c != "overview"] if slim else cols


def join_ratings(ratings: DataFrame, catalog: DataFrame, slim: bool = True, how: str = "inner") -> DataFrame:
    """ratings ⋈ catalog (inner). The catalog is one row per movie: broadcast when its
    estimated size allows, else a shuffle join (the size check is in ``small_side_join``)."""
    cat = catalog.select(*movie_columns(catalog, slim))
    return narrow_types(ratings.join(cat, "movieId", how))


def narrow_types(df: DataFrame) -> DataFrame:
    """Year to int, text columns to string."""
    out = df
    if "release_year" in df.columns:
        out = out.withColumn("release_year", F.col("release_year").cast("int"))
    for c in ("title", "genres", "director", "cast", "poster_url", "overview"):
        if c in df.columns:
            out = out.withColumn(c, F.col(c).cast("string"))
    return out


def check_ratios(train_ratio: float, val_ratio: float, test_ratio: float) -> None:
    total = train_ratio + val_ratio + test_ratio
    if abs(total - 1.0) > 1e-9:
        raise ValueError(f"ratios must sum to 1, got {total}")


def exact_quantiles(df: DataFrame, column: str, probs: list[float], bucket: int = 86400) -> list[float | None]:
    """Exact, linearly interpolated quantiles of an integer column (pandas / ``quantile_cont``).

    A single ``percentile`` aggregate keeps one count per distinct value in one buffer.
    Instead: (1) counts per coarse bucket (a day of seconds: bounded by the time range),
    locate the bucket holding each needed rank; (2) counts per distinct value inside only
    those buckets (at most ``bucket`` values each); read the order statistics off the
    cumulative counts. Only the two small count tables reach the driver.
    """
    x = F.col(column)
    b = F.floor(x / F.lit(bucket)).cast("long")
    bucket_counts = (df.where(x.isNotNull()).groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("n"))
                     .orderBy("b").collect())
    n = sum(r["n"] for r in bucket_counts)
    if n == 0:
        return [None for _ in probs]
    ranks: set[int] = set()
    plan = []
    for p in probs:
        pos = p * (n - 1)
        lo = int(pos // 1)
        hi = min(lo + 1, n - 1)
        plan.append((lo, hi, pos - lo))
        ranks.update((lo, hi))
    starts = []
    acc = 0
    for r in bucket_counts:
        starts.append((r["b"], acc, acc + r["n"]))
        acc += r["n"]
    where = {}
    for rank in ranks:
        for bkey, s, e in starts:
            if s <= rank < e:
                where[rank] = (bkey, s)
                break
    wanted = sorted({bkey for bkey, _ in where.values()})
    vals = (df.where(b.isin(wanted)).groupBy(b.alias("b"), x.alias("v")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy("b", "v").collect())
    per_bucket: dict[int, list[tuple[int, int]]] = {}
    for r in vals:
        per_bucket.setdefault(r["b"], []).append((r["v"], r["n"]))
    value_at = {}
    for rank, (bkey, s) in where.items():
        acc = s
        for v, c in per_bucket[bkey]:
            if acc <= rank < acc + c:
                value_at[rank] = float(v)
                break
            acc += c
    out = []
    for lo, hi, frac in plan:
        out.append(value_at[lo] + (value_at[hi] - value_at[lo]) * frac)
    return out


def split_cutoffs(ratings: DataFrame, train_ratio: float = 0.7, val_ratio: float = 0.1) -> tuple[float, float]:
    """(val cutoff, test cutoff): time quantiles at train_ratio and train_ratio + val_ratio."""
    from ..functions.memo import memo_stat

    probs = [train_ratio, train_ratio + val_ratio]
    c1, c2 = memo_stat(ratings.select("timestamp"), f"quantiles{probs}",
                       lambda: exact_quantiles(ratings, "timestamp", probs))
    return c1, c2


def split_label(ts: str, c1: float, c2: float):
    t = F.col(ts)
    return F.when(t < F.lit(c1), F.lit("train")).when(t < F.lit(c2), F.lit("val")).otherwise(F.lit("test"))


def temporal_split(df: DataFrame, train_ratio: float = 0.7, val_ratio: float = 0.1,
                   test_ratio: float = 0.2, cutoffs: tuple[float, float] | None = None) -> DataFrame:
    """Adds ``split``: < c1 train, [c1, c2) val, >= c2 test."""
    check_ratios(train_ratio, val_ratio, test_ratio)
    c1, c2 = cutoffs or split_cutoffs(df, train_ratio, val_ratio)
    return df.withColumn("split", split_label("timestamp", c1, c2))


def split_rows(ratings: DataFrame, catalog: DataFrame, train_ratio: float = 0.7, val_ratio: float = 0.1,
               test_ratio: float = 0.2, slim: bool = True) -> DataFrame:
    """Cutoffs from all ratings (before the join), then the catalog join: rows with ``split``."""
    check_ratios(train_ratio, val_ratio, test_ratio)
    c1, c2 = split_cutoffs(ratings, train_ratio, val_ratio)
    labelled = ratings.withColumn("split", split_label("timestamp", c1, c2))
    return join_ratings(labelled, catalog, slim=slim)


def split_ord(split: str = "split"):
    return (F.when(F.col(split) == "train", F.lit(0)).when(F.col(split) == "val", F.lit(1))
            .otherwise(F.lit(2)))


def unique_movies(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per movie: all its columns from the movie's first row by (split, timestamp,
    user), in one aggregate with partial results before the shuffle."""
    cols = columns or ["movieId", "genres", "release_year"]
    rest = [c for c in cols if c != "movieId"]
    first = F.min_by(F.struct(*rest), F.struct(split_ord(), "timestamp", "userId"))
    return rows.groupBy("movieId").agg(first.alias("_f")).select(*[c if c == "movieId" else F.col(f"_f.{c}").alias(c) for c in cols])


def rating_counts(rows: DataFrame) -> DataFrame:
    """Ratings per movie over all rows (partial counts before the shuffle)."""
    return rows.groupBy("movieId").agg(F.count(F.lit(1)).cast("int").alias("rating_count"))


def serving_catalog(rows: DataFrame, metadata: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Unique movies over the splits + overview of ok metadata + search text + rating counts.

    With the ``catalog`` the split rows were joined to, the movie columns are a function of
    movieId: a hash count per movie joined back to the (one row per movie) catalog, whose
    ``overview`` is the ok metadata's. Without it, one aggregation over the rows takes both.
    """
    if catalog is not None:
        counts = rows.groupBy("movieId").agg(F.count(F.lit(1)).cast("int").alias("rating_count"))
        cols = [c for c in SERVING_COLUMNS if c in catalog.columns]
        out = counts.join(catalog.select(*cols, "overview"), "movieId")
        return out.select(*cols, "overview", _search_text().alias("search_text"), "rating_count")
    cols = [c for c in SERVING_COLUMNS if c in rows.columns]
    per_movie = unique_movies(rows, cols).join(rating_counts(rows), "movieId")
    ov = metadata.where(F.col("fetch_status") == "ok").select("movieId", "overview")
    out = per_movie.join(ov, "movieId", "left")
    return out.select(*cols, "overview", _search_text().alias("search_text"), "rating_count")


def slim_catalog(catalog: DataFrame) -> DataFrame:
    return catalog.drop("overview", "search_text")
