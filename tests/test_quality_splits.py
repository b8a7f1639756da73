"""Cleaning, splitting and genre rules on hand-made rows (FIXTURES.md §4)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.functions.columns import genre_set, split_genres
from reelspark.operators import catalog as cat
from reelspark.operators import features as fe
from reelspark.operators import quality as qa

RAW = "userId long, movieId long, rating double, timestamp long, genres string, release_year int, l_orderkey long, l_linenumber int"


def test_clean_drops_nulls_and_keeps_last(spark):
    rows = [
        (1, 10, 4.0, 100, "A", 1990, 1, 1),
        (1, 10, 2.0, 200, "A", 1990, 2, 1),     # later: wins
        (1, 11, None, 100, "A", 1990, 3, 1),    # null rating
        (2, 10, 3.0, 100, None, 1990, 4, 1),    # null genres
        (2, 11, 3.0, 100, "B", None, 5, 1),     # null year
        (3, 12, 1.0, 500, "C", 2000, 7, 1),     # same timestamp: higher tie key wins
        (3, 12, 5.0, 500, "C", 2000, 6, 2),
    ]
    df = spark.createDataFrame(rows, RAW)
    out = {(r.userId, r.movieId): r.rating for r in qa.clean_ratings(df).collect()}
    assert out == {(1, 10): 2.0, (3, 12): 1.0}
    st = qa.clean_stats(df).first()
    assert (st.rows_in, st.rows_out, st.dropped_na, st.dropped_duplicates) == (7, 2, 3, 2)
    bad = {(r.check, r.column_name): r.n for r in qa.clean_violations(df).collect()}
    assert bad[("null", "rating")] == 1 and bad[("duplicate_pair", "userId,movieId")] == 2
    with pytest.raises(ValueError):
        qa.assert_clean(df)
    qa.assert_clean(qa.clean_ratings(df))


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(0)
    xs = rng.integers(0, 10 * 86400, size=5000)
    df = spark.createDataFrame([(int(x),) for x in xs], "timestamp long")
    for p in (0.0, 0.3, 0.7, 0.8, 1.0):
        got = cat.exact_quantiles(df, "timestamp", [p])[0]
        assert got == pytest.approx(float(np.quantile(xs, p)), abs=1e-6)


def test_split_equal_timestamps_and_ratio_check(spark):
    df = spark.createDataFrame([(i, 5) for i in range(10)], "userId long, timestamp long")
    out = cat.temporal_split(df).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in out} == {"test": 10}      # train and val are empty
    with pytest.raises(ValueError):
        cat.temporal_split(df, 0.7, 0.2, 0.2)


def test_split_is_a_partition(spark):
    df = spark.createDataFrame([(i, i * 37 % 101) for i in range(500)], "userId long, timestamp long")
    s = cat.temporal_split(df)
    assert s.count() == 500 and s.where(F.col("split").isNull()).count() == 0


def test_genre_rules(spark):
    df = spark.createDataFrame([(None,), ("  ",), ("(no genres listed)",), ("A||B",), ("B|A|B",)], "genres string")
    got = [r[0] for r in df.select(split_genres("genres")).collect()]
    assert got == [[], [], [], ["A", "B"], ["B", "A", "B"]]
    assert df.select(genre_set("genres")).collect()[-1][0] == ["B", "A"]
    vocab = ["A", "C"]                               # unknown genre B is ignored
    mh = df.select(fe.multihot(vocab)).collect()
    assert mh[3][0] == [1.0, 0.0]


def test_content_vectors_zero_and_norm(spark):
    df = spark.createDataFrame([(1, "A|B", 1990), (2, "B", None), (3, None, 2000)],
                               "movieId long, genres string, release_year int")
    vecs, vocab = fe.content_vectors(df)
    assert vocab == ["A", "B"]
    for r in vecs.collect():
        n = float(np.linalg.norm(r.content))
        assert n == pytest.approx(1.0) or n == 0.0


def test_dense_index_is_dense_and_sorted(spark):
    ids = spark.range(0, 5000, 7).withColumnRenamed("id", "movieId").repartition(13)
    m = fe.dense_index(ids, "movieId").orderBy("movieId").collect()
    assert [r.idx for r in m] == list(range(len(m)))
    assert [r.movieId for r in m] == list(range(0, 5000, 7))


def test_sample_is_the_least_keys_in_any_bucket_size(spark):
    import hashlib

    rows = [(i, i % 7) for i in range(3000)] + [(5, 1)] * 40
    df = spark.createDataFrame(rows, "a long, b long").repartition(5)
    key = {r: hashlib.md5(f"9:{r[0]}:{r[1]}".encode()).hexdigest() for r in rows}
    least = sorted(rows, key=lambda r: (key[r], r))
    for n, bucket in ((1, 10_000), (17, 1), (500, 3), (2999, 1), (3040, 5), (5000, 5), (0, 5)):
        got = qa.sample_exact_n(df, n, ["a", "b"], seed=9, bucket_rows=bucket)
        assert sorted(map(tuple, got.collect())) == sorted(least[:n]), n
    assert qa.sample_exact_n(df.where("a < 0"), 3, ["a", "b"]).count() == 0
