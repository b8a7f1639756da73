"""Round 3: work that must not grow faster than its tables (small tables, plans and counts)."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from reelspark.functions.rules import FRANCHISE_PATTERNS
from reelspark.operators import explain as ex
from reelspark.operators import recommend as rc
from reelspark.operators import search as se
from reelspark.sources import writers as wr
from reelspark.streaming import state as vs


def _items(spark, n=40):
    rows = [(i, [float(i % 3), 1.0], [float(i % 7 + 1), float(i % 5), 1.0]) for i in range(n)]
    return spark.createDataFrame(rows, "movieId long, content array<double>, factor array<double>")


def _profiles(spark, n=120):
    rows = [(p, (p * 7 + k) % 40, k, role) for p in range(n) for k, role in enumerate(("seed", "seed", "like", "dislike"))]
    return spark.createDataFrame(rows, "profile_id long, movieId long, pos int, role string")


def test_profile_blocks_follow_the_cores_and_not_the_profiles(spark, monkeypatch):
    monkeypatch.setattr(rc, "PROFILE_BLOCK", 1)
    across, down = rc._grid(_profiles(spark), _items(spark))
    assert across == 1 and down <= max(2 * spark.sparkContext.defaultParallelism, 8) < 120


def test_pool_of_one_item_block_needs_no_shuffle_after_scoring(spark, monkeypatch):
    p = rc.RecParams(top_k=3, diversity=0.0)
    pool = rc.candidate_pool(_profiles(spark), _items(spark), p)
    plan = pool._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    one = sorted(map(tuple, pool.select("profile_id", "pool_rank", "movieId", F.round("score", 9)).collect()))
    assert {m for pid, _, m, _ in one if pid == 0} == set(range(4, 40))
    monkeypatch.setattr(rc, "ITEM_BLOCK_BYTES", 500)
    many = rc.candidate_pool(_profiles(spark), _items(spark), p)
    assert sorted(map(tuple, many.select("profile_id", "pool_rank", "movieId", F.round("score", 9)).collect())) == one


def test_profile_means_without_partial_aggregates(spark):
    profiles = _profiles(spark, 5).union(spark.createDataFrame([(None, 1, 0, "seed")], "profile_id long, movieId long, pos int, role string"))
    got = rc.profile_vectors(profiles, _items(spark), {"content": "c", "factor": "f"})
    assert "ObjectHashAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    found = {r.profile_id: (list(r.c), list(r.f)) for r in got.collect()}
    own = [(7 + k) % 40 for k in range(3)]
    assert found[1] == ([sum(float(m % 3) for m in own) / 3, 1.0], [sum(m % 7 + 1.0 for m in own) / 3, sum(float(m % 5) for m in own) / 3, 1.0])
    assert found[None] == ([1.0, 1.0], [2.0, 1.0, 1.0]) and len(found) == 6


def test_franchise_titles_are_cut_before_the_join(spark):
    (f1, p1), (f2, p2) = sorted(FRANCHISE_PATTERNS)[:2]
    title = {0: p1[0], 1: p2[0], 2: f"{p1[0]} {p2[0]}"}
    cat = [(i, f"{title[i % 3]} {i}", None if i % 11 == 0 else 1950 + i * 13 % 70) for i in range(300)]
    picks = [(1, 0), (1, 1), (2, 2), (2, 5), (2, 8), (3, 299)] + [(4, 3 * i) for i in range(100)] + [(5, 7)]
    catalog = spark.createDataFrame(cat, "movieId long, title string, release_year int")
    got = se.franchise_suggestions(catalog, spark.createDataFrame([(*x, "seed") for x in picks], "profile_id long, movieId long, role string"))
    franchises = {m: [n for n, ps in sorted(FRANCHISE_PATTERNS) if any(x in t for x in ps)] for m, t, _ in cat}
    year = {m: y for m, _, y in cat}
    first = {m: next(n for n, ps in FRANCHISE_PATTERNS if any(x in t for x in ps)) for m, t, _ in cat}
    want = []
    for p in sorted({p for p, _ in picks}):
        seeds = {m for q, m in picks if q == p}
        mine = {first[m] for m in seeds}
        listed = sorted((min(f for f in franchises[m] if f in mine), year[m] is None, year[m] or 0, m)
                        for m in franchises if m not in seeds and mine & set(franchises[m]))
        want += [(p, i, m, f) for i, (f, _, _, m) in enumerate(listed[:8], 1)]
    assert sorted(map(tuple, got.select("profile_id", "pos", "movieId", "franchise").collect())) == want
    assert "nth" in got._jdf.queryExecution().executedPlan().toString()


def test_splits_are_written_without_sorting_the_rows(spark, tmp_path, monkeypatch):
    seen, write = [], DataFrameWriter.parquet

    def spy(self, *a, **k):
        seen.append(int(spark.conf.get(wr.WRITERS, "0")))
        return write(self, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", spy)
    rows = spark.range(1000).select("id", F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("id") % 3 + 1).cast("int")).alias("split"))
    before = spark.conf.get(wr.WRITERS, "0")
    wr.sink_splits(rows, f"{tmp_path}/rows")
    assert seen[0] >= 3 and spark.conf.get(wr.WRITERS, "0") == before
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/rows").groupBy("split").count().collect())) == [
        ("test", 333), ("train", 334), ("val", 333)]


def test_cohort_entries_are_unpacked_after_the_last_shuffle(spark):
    rows = spark.createDataFrame([(u, m, 5.0) for u in range(30) for m in range(u % 5, 20, 3)], "userId long, movieId long, rating double")
    profiles = _profiles(spark, 10)
    cat = spark.createDataFrame([(i, f"T{i}", "Drama", 1990) for i in range(40)], "movieId long, title string, genres string, release_year int")
    noted = ex.noted_cohorts(rows, profiles, cat)
    plain = ex.cohort_notes(ex.cohort_counts(rows, profiles), profiles, cat)
    assert sorted(map(tuple, noted.collect())) == sorted(map(tuple, plain.collect())) != []
    plan = noted._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[:plan.index("Generate")]
    recs = plain.select("profile_id", "movieId").limit(25).union(spark.createDataFrame([(1, 39)], "profile_id long, movieId long"))
    want = {(r.profile_id, r.movieId): r.note for r in plain.collect()}
    assert all(want.get((r.profile_id, r.movieId)) == r.note for r in ex.note_recs(recs, rows, profiles, cat).collect())


def test_votes_of_many_keys_are_folded_in_one_call():
    seqs = [list(p) for n in range(1, 6) for p in itertools.product([1, -1], repeat=n)]
    want = {}
    for k, votes in enumerate(seqs):
        v = 0
        for x in votes:
            v = 0 if v == x else x
        want[k] = v
    events = np.array([(7, k, v, 1_000_000 * i, i, 0) for k, votes in enumerate(seqs) for i, v in enumerate(votes, 1)], dtype=np.int64)
    for cut in range(6):                                   # the votes up to the cut come in an earlier batch
        early = events[:, 4] <= cut
        first, kept = vs._fold_votes(np.empty((0, 6), np.int64), events[early], 0, 10_000) if early.any() else ([], np.empty((0, 6), np.int64))
        got = {int(r[1]): int(r[2]) for r in first}
        if (~early).any():
            got |= {int(r[1]): int(r[2]) for r in vs._fold_votes(kept, events[~early], 0, 10_000)[0]}
        assert got == want
    # three keys: one expires, one has an event in the same batch, one never expires
    kept = np.array([(1, 1, 1, 5, 1, 100), (1, 2, 1, 5, 2, 100), (1, 3, -1, 5, 3, vs.NEVER)], dtype=np.int64)
    emit, left = vs._fold_votes(kept, np.array([(1, 2, -1, 300_000, 9, 0)], dtype=np.int64), 200, 1000)
    assert emit[:, :3].tolist() == [[1, 1, 0], [1, 2, -1]] and left[:, 1].tolist() == [2, 3] and left[0, 5] == 1300



def test_gram_index_is_made_without_a_shuffle(spark):
    cat = spark.createDataFrame([(i, f"film {i}") for i in range(50)], "movieId long, search_text string")
    index = se.gram_index(cat)
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    assert index.where("gram = 'm 4'").count() == 11
