"""Cleaning, audit and sampling.

"Keep last" is made explicit: the latest row by ``order`` (timestamp, then a unique tie
key) wins. It is computed with ``max_by``, an aggregate with partial results before the
shuffle: duplicates are combined where they are read, and a user with a huge history is
spread over the tasks by (user, movie). (Spark runs it as a sort aggregate, as the kept row
is a struct.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import split_ord

REQUIRED_COLS = ("userId", "movieId", "rating", "genres", "release_year")
AUDIT_COLS = ("userId", "movieId", "rating", "timestamp", "genres", "release_year", "director", "cast")
PAIR = ("userId", "movieId")
DEFAULT_ORDER = ("timestamp", "l_orderkey", "l_linenumber")


def _any_null(cols) -> F.Column:
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.col(c).isNull()
    return cond


def keep_last(df: DataFrame, key=PAIR, order=DEFAULT_ORDER) -> DataFrame:
    """One row per ``key``: the one with the greatest ``order``."""
    order = [c for c in order if c in df.columns]
    rest = [c for c in df.columns if c not in key]
    agg = (df.groupBy(*key)
           .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")))
    return agg.select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def clean_ratings(df: DataFrame, required=REQUIRED_COLS, order=DEFAULT_ORDER) -> DataFrame:
    """Drop rows with a null among ``required``; then one row per (user, movie), the last."""
    req = [c for c in required if c in df.columns]
    return keep_last(df.where(~_any_null(req)), PAIR, order)


def clean_stats(df: DataFrame, required=REQUIRED_COLS) -> DataFrame:
    """rows_in, rows_out, dropped_na, dropped_duplicates in one pass plus a distinct-pair count."""
    req = [c for c in required if c in df.columns]
    nn = ~_any_null(req)
    stats = df.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(~nn).alias("dropped_na"),
        F.count_distinct(F.when(nn, F.struct(*PAIR))).alias("rows_out"),
    )
    return stats.select(
        "rows_in", "rows_out", "dropped_na",
        (F.col("rows_in") - F.col("dropped_na") - F.col("rows_out")).alias("dropped_duplicates"),
    )


def audit_missing(df: DataFrame, columns=AUDIT_COLS) -> DataFrame:
    """(column_name, na_count, rows): nulls per column, one aggregation pass."""
    cols = [c for c in columns if c in df.columns]
    wide = df.agg(F.count(F.lit(1)).alias("rows"),
                  *[F.count_if(F.col(c).isNull()).alias(f"na_{i}") for i, c in enumerate(cols)])
    stacked = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"na_{i}").alias("na_count")) for i, c in enumerate(cols)
    ]))
    return wide.select("rows", stacked.alias("s")).select("s.column_name", "s.na_count", "rows")


def clean_violations(df: DataFrame, required=REQUIRED_COLS) -> DataFrame:
    """(check, column_name, n) rows; empty when the data is clean."""
    req = [c for c in required if c in df.columns]
    wide = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"na_{i}") for i, c in enumerate(req)],
        (F.count(F.lit(1)) - F.count_distinct(F.struct(*PAIR))).alias("dups"),
    )
    items = [F.struct(F.lit("null").alias("check"), F.lit(c).alias("column_name"), F.col(f"na_{i}").alias("n"))
             for i, c in enumerate(req)]
    items.append(F.struct(F.lit("duplicate_pair").alias("check"), F.lit("userId,movieId").alias("column_name"),
                          F.col("dups").alias("n")))
    return wide.select(F.explode(F.array(*items)).alias("v")).select("v.*").where(F.col("n") > 0)


def assert_clean(df: DataFrame, required=REQUIRED_COLS) -> None:
    bad = clean_violations(df, required).collect()   # at most len(required) + 1 rows
    if bad:
        raise ValueError("ratings not clean: " + ", ".join(f"{r['check']}:{r['column_name']}={r['n']}" for r in bad))


def sample_key(cols, seed: int) -> F.Column:
    """Seeded uniform order: md5 of 'seed:key'. md5 is also in SQL engines, so a sample can be replayed."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


#: Hex digits of the key that one histogram looks at, and the rows a boundary bucket may hold.
DIGITS = 3
BUCKET_ROWS = 10_000


def sample_exact_n(df: DataFrame, n: int, key_cols, seed: int = 42, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Exactly ``n`` rows (all if fewer), uniform without replacement, reproducible: those with the
    ``n`` least keys, equal keys by ``key_cols``.

    A radix selection: a histogram of the keys' leading digits (at most 4096 counts) tells the
    bucket that holds the n-th key; it is looked at by further digits until it is small. The rows
    below it are a filter of the scan, in all its partitions; only the rest, out of the small
    bucket, is sorted. (If that many rows share a whole key, they are in one bucket.)"""
    if n <= 0:
        return df.limit(0)
    keyed = df.withColumn("_k", sample_key(key_cols, seed))
    prefix, left = "", n
    while len(prefix) < 32:
        digits = F.substring("_k", len(prefix) + 1, DIGITS)
        inside = keyed.where(F.col("_k").startswith(prefix)) if prefix else keyed
        counts = sorted((r["d"], r["n"]) for r in inside.groupBy(digits.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect())
        if not prefix and sum(c for _, c in counts) <= n:
            return df
        for found, size in counts:
            if left <= size:
                break
            left -= size
        prefix += found
        if size <= bucket_rows:
            break
    below = keyed.where(F.substring("_k", 1, len(prefix)) < prefix)
    rest = keyed.where(F.col("_k").startswith(prefix)).orderBy("_k", *key_cols).limit(left)
    return below.unionByName(rest).drop("_k")


def full_dataset(rows: DataFrame, required=REQUIRED_COLS, order=DEFAULT_ORDER) -> DataFrame:
    """Clean each split, union, then one row per pair preferring the later split.

    Equivalent to keep-last with (split order, row order) as the order key; both steps are
    hash aggregates on (user, movie), the second reusing the first one's partitioning.
    """
    req = [c for c in required if c in rows.columns]
    o = [c for c in order if c in rows.columns]
    per_split = keep_last(rows.where(~_any_null(req)), ("userId", "movieId", "split"), o)
    ranked = per_split.withColumn("_split_ord", split_ord())
    return keep_last(ranked, PAIR, ("_split_ord", *o)).drop("_split_ord")


def eval_universe(rows: DataFrame, train: DataFrame) -> DataFrame:
    """Rows whose user and movie both occur in ``train`` (two semi joins on distinct ids)."""
    users = train.select("userId").distinct()
    movies = train.select("movieId").distinct()
    return rows.join(users, "userId", "left_semi").join(movies, "movieId", "left_semi")
