"""Readers on files as they are, metadata parsing, stage tables and their reuse."""

import os

import pytest
from pyspark.sql import functions as F

from reelspark.operators import catalog as cat
from reelspark.operators import explain as ex
from reelspark.operators import metadata as md
from reelspark.plans import datasets as ds
from reelspark.sources import readers as rd
from reelspark.sources import stages as st
from reelspark.sources import writers as wr
from reelspark.sources.metadata_store import MetadataStore

SF = "/root/testdata/sf0.001"


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return f"file://{path}"


def test_movies_with_doubled_quotes_commas_and_line_breaks(spark, tmp_path):
    path = write(tmp_path / "movies.csv", 'movieId,title,genres\n1,"The ""Great"" Cats (1998)",Drama\n'
                 '2,"One, ""Two"", Three (2001)",Comedy|Drama\n3,"Two\nlines",""\n4,,\n')
    rows = {r.movieId: (r.title, r.genres) for r in rd.scan_movies(spark, path).collect()}
    assert rows == {1: ('The "Great" Cats (1998)', "Drama"), 2: ('One, "Two", Three (2001)', "Comedy|Drama"),
                    3: ("Two\nlines", ""), 4: (None, None)}


def test_columns_are_taken_by_name(spark, tmp_path):
    path = write(tmp_path / "ratings.csv", "movieId,userId,extra,timestamp,rating\n10,1,x,100,4.5\n")
    assert [tuple(r) for r in rd.scan_ratings(spark, path).select("userId", "movieId", "rating", "timestamp").collect()] == [(1, 10, 4.5, 100)]
    with pytest.raises(ValueError, match="userId"):
        rd.scan_ratings(spark, write(tmp_path / "bad.csv", "movie,foo\n1,2\n"))
    links = write(tmp_path / "links.csv", "imdbId,movieId,tmdbId\ntt1,1,50.0\ntt1,1,20\ntt2,2,\n")
    assert [tuple(r) for r in rd.scan_links(spark, links).collect()] == [(1, 50)]
    with pytest.raises(Exception):
        rd.scan_ratings(spark, write(tmp_path / "broken.csv", "userId,movieId,rating,timestamp\nx,1,2,3\n")).collect()


def test_metadata_csv_branch_and_missing_files(spark, tmp_path):
    os.makedirs(tmp_path / "m")
    write(tmp_path / "m" / "metadata_df.csv", ",".join(md.METADATA_ORDER) + '\n7,107,"Line one\nline two","A, B",D,1990.0,,"",ok,""\n')
    got = rd.scan_metadata(spark, f"file://{tmp_path}/m").first()
    assert (got.movieId, got.overview, got["cast"], got.release_year, got.poster_path, got.poster_url) == (
        7, "Line one\nline two", "A, B", 1990, None, "")
    with pytest.raises(FileNotFoundError):
        rd.scan_metadata(spark, f"file://{tmp_path}/none")
    assert rd.scan_metadata(spark, f"file://{tmp_path}/none", required=False).collect() == []


def test_broken_payloads_and_names(spark):
    rows = [(1, '{"overview":"x","credits":{"cast":[{"name":"\\tBob\\n"},{"name":" "}],"crew":[{"job":"Director","name":"\u00a0Ann "}]}}'),
            (2, "<html>502</html>"), (3, '{"overview": "cut'), (4, None), (5, "[]"), (6, "{}")]
    got = {r.tmdbId: r for r in md.payload_parse(spark.createDataFrame(rows, "tmdbId long, payload string")).collect()}
    assert (got[1]["cast"], got[1].director, got[1].fetch_status) == ("Bob", "Ann", "ok")
    assert [got[i].fetch_status for i in range(1, 7)] == ["ok", "error", "error", "error", "error", "ok"]
    assert "502" in got[2].fetch_error and got[2].overview == "" and got[2].release_year is None


def test_first_link_counts(spark):
    links = spark.createDataFrame([(1, None, 0), (1, 50, 1), (1, 20, 2), (2, None, 3)], "movieId long, tmdbId long, link_pos long")
    assert [tuple(r) for r in md.clean_links(links).collect()] == [(1, 50)]
    assert [tuple(r) for r in md.clean_links(links.drop("link_pos").coalesce(1)).collect()] == [(1, 50)]


def test_unique_movies_takes_one_rows_columns(spark):
    rows = [(1, "B", 2001, "val", 5, 1), (1, "A", 2000, "train", 9, 2), (1, None, 1999, "train", 9, 3), (2, None, None, "test", 1, 1)]
    df = spark.createDataFrame(rows, "movieId long, genres string, release_year int, split string, timestamp long, userId long")
    assert sorted(tuple(r) for r in cat.unique_movies(df.repartition(4)).collect()) == [(1, "A", 2000), (2, None, None)]


def test_stage_tables_prune_and_push_down(spark):
    plan = cat.rating_counts(ds.split_rows(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<movieId:bigint>" in plan and "ExistingRDD" not in plan
    train = ds.split_of(ds.split_rows(spark, SF), "train").where(F.col("rating") >= 4).select("userId")
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(rating,4.0)" in plan and "PartitionFilters: [isnotnull(split" in plan
    assert ds.serving(spark, SF).inputFiles() == ds.serving(spark, SF).inputFiles()


def test_stage_reuse_survives_failed_builds_and_new_inputs(spark, tmp_path):
    base, source = f"file://{tmp_path}/stages", f"file://{tmp_path}/in"
    spark.range(3).write.parquet(source)

    def run(fp, build=lambda: spark.read.parquet(source), **kw):
        df, reused = st.stage(spark, base, "s", fp, build, inputs=[source], **kw)
        return df.count(), reused

    assert run("a") == (3, False) and run("a") == (3, True) and run("b") == (3, False)

    def fails():
        return spark.range(5).select(F.raise_error(F.lit("stop")).alias("id"))

    with pytest.raises(Exception, match="stop"):
        run("c", fails)
    assert run("b") == (3, True) and run("b", fresh=True) == (3, False)
    spark.range(4).write.mode("overwrite").parquet(source)
    assert run("b") == (4, False)


def test_sinks_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, "train", 4.0), (2, "val", 3.0)], "userId long, split string, rating double")
    wr.sink_splits(rows, f"file://{tmp_path}/splits")
    assert sorted(r.split for r in rd.scan_splits(spark, f"file://{tmp_path}/splits").collect()) == ["train", "val"]
    assert rd.scan_splits(spark, f"file://{tmp_path}/splits", ("val",)).count() == 1


def test_cohort_of_a_blockbuster(spark):
    """One movie seeded by most profiles, and parts of a set's fans counted apart."""
    ratings = [(u, 1, 5.0) for u in range(400)] + [(u, 2 + (u % 7), 4.5) for u in range(400)] + [(u, 50, 2.0) for u in range(400)]
    ratings += [(u, 3, 4.0) for u in range(0, 400, 9)]
    rows = spark.createDataFrame(ratings, "userId long, movieId long, rating double")
    profiles = spark.createDataFrame([(p, 1, 1, "seed") for p in range(300)] + [(999, 2, 1, "seed"), (999, 1, 2, "seed"), (1000, 2, 1, "seed")],
                                     "profile_id long, movieId long, pos int, role string")
    high = [(u, m) for u, m, r in ratings if r >= 4]

    def brute(seeds):
        fans = {u for u, m in high if m in seeds}
        counts = {}
        for u, m in high:
            if u in fans and m not in seeds:
                counts[m] = counts.get(m, 0) + 1
        return sorted(counts.items(), key=lambda t: (-t[1], t[0]))[:4]

    for batch in (10_000, 7):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        try:
            got = {}
            for r in ex.cohort_counts(rows, profiles, top=4).orderBy("cohort_rank").collect():
                got.setdefault(r.profile_id, []).append((r.movieId, r.n_high))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(got) == 302
        assert got[0] == got[299] == brute({1}) and got[999] == brute({1, 2}) and got[1000] == brute({2})


def test_block_product_in_small_pieces(monkeypatch):
    """Blocks cut anywhere and products of few entries add up to the same counts."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    users, ids, fan = rng.integers(0, 30, 900), rng.integers(0, 12, 900), rng.random(900) < 0.3
    order = np.argsort(users, kind="stable")
    rows = pa.table({"userId": users[order], "id": ids[order], "fan": fan[order]})
    expected = {}
    for u, s in {(u, s) for u, s, f in zip(users, ids, fan) if f}:
        for v, m, f in zip(users, ids, fan):
            if v == u and not f:
                expected[s, m] = expected.get((s, m), 0) + 1
    for entries, size in ((4_000_000, 900), (50, 37), (1, 1)):
        monkeypatch.setattr(ex, "ENTRIES_AT_ONCE", entries)
        got = {}
        for part in ex._block_product(iter(rows.to_batches(max_chunksize=size))):
            for r in part.to_pylist():
                for m, n in zip(r["movies"], r["counts"]):
                    got[r["set_id"], m] = got.get((r["set_id"], m), 0) + n
        assert got == expected


def test_fans_of_hot_movies_are_bitmaps(spark):
    import random

    rng = random.Random(8)
    users = [-70_000, -32_768, -32_767, -1, 0, 1, 2, 32_768, 32_769, 65_536, 65_537, 10**9]
    ratings = {(u, m) for m in (1, 2, 3) for u in users} | {(rng.randrange(40_000), rng.choice([1, 4, 5])) for _ in range(900)}
    rows = spark.createDataFrame([(u, m, 4.5) for u, m in ratings] + [(5, 1, 2.0), (None, 1, 5.0)], "userId long, movieId long, rating double")
    profiles = spark.createDataFrame([(p, m, i, "seed") for p, seeds in ((1, (1, 4)), (2, (1, 4)), (3, (5,)), (4, (2, 3, 9))) for i, m in enumerate(seeds)],
                                     "profile_id long, movieId long, pos int, role string")
    seeds = {1: {1, 4}, 2: {1, 4}, 3: {5}, 4: {2, 3, 9}}
    expected = sorted({(p, u) for p, own in seeds.items() for u, m in ratings if m in own})
    for hot in (1, 5, 300, 10**6):
        got = sorted(tuple(r) for r in ex.fan_users(rows, profiles, hot_users=hot).collect())
        assert got == expected, hot


def test_no_shared_folder_on_a_cluster_is_an_error():
    from reelspark.session import checkpoint_root

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(Session())


def test_entry_without_the_llm_operators(monkeypatch):
    """A library that only the llm operators need may be missing: all other queries stay."""
    import importlib
    import sys

    import __spark_entry__ as entry

    kept = {name: module for name, module in sys.modules.items() if name.startswith("reelspark.llm") or name == "corpus_pipeline"}
    for name in kept:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "zstandard", None)
    importlib.reload(entry)
    assert "recommend" in entry.queries() and "recommend" in entry.oracle_sql()
    assert "op6_wavelet_ids" not in entry.queries()
    for name in [n for n in sys.modules if n.startswith("reelspark.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    sys.modules.update(kept)


def test_metadata_store_rewrites_only_touched_buckets(spark, tmp_path):
    def rows(ids, status):
        return spark.createDataFrame([(i, i + 100, "o", "c", "d", 1990, "", "", status, "") for i in ids],
                                     "movieId int, tmdbId int, overview string, cast string, director string, release_year int, "
                                     "poster_path string, poster_url string, fetch_status string, fetch_error string")

    def state(version=None):
        return {r["movieId"]: r["fetch_status"] for r in store.read(version).collect()}

    store = MetadataStore(spark, f"file://{tmp_path}/store", buckets=8)
    assert store.read().collect() == [] and store.counts() == {}
    assert store.ingest(rows([], "ok")) == [] and store.read().collect() == []
    assert store.ingest(rows(range(200), "ok")) == list(range(8))
    files = set(store.read().inputFiles())
    touched = store.ingest(rows([3, 500], "error"))
    assert 1 <= len(touched) <= 2
    kept = files & set(store.read().inputFiles())
    assert len({f.split("bucket=")[1].split("/")[0] for f in kept}) == 8 - len(touched)
    assert state() == {**{i: "ok" for i in range(200)}, 3: "error", 500: "error"}
    assert store.counts() == {"ok": 199, "error": 2}
    assert state(0) == {i: "ok" for i in range(200)}
    store = MetadataStore(spark, f"file://{tmp_path}/store", buckets=3)      # the stored bucket count holds
    store.ingest(rows([3], "ok"))
    assert store.counts() == {"ok": 200, "error": 1} and len(state()) == 201
    assert store.vacuum(keep=3) == []
    store.ingest(rows(range(600), "ok"))
    assert len(store.vacuum(keep=1)) >= 2 and store.counts() == {"ok": 600}
    with pytest.raises(ValueError):
        store.read(99)
