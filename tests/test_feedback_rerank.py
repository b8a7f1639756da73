"""Vote folding (batch and stream) and the greedy rerank against brute-force Python."""

import datetime as dt
import itertools
import tempfile

import numpy as np
import pandas as pd
import pytest

from reelspark.operators import feedback as fb
from reelspark.operators import recommend as rc

EV = "event_id long, ts timestamp_ntz, session_id long, movieId long, vote int"


def fold(votes):
    state = 0
    for v in votes:
        state = 0 if state == v else v
    return state


def _events(seqs):
    rows, eid = [], 0
    t0 = dt.datetime(2024, 1, 1)
    for key, votes in enumerate(seqs):
        for i, v in enumerate(votes):
            rows.append((eid, t0 + dt.timedelta(minutes=i), 1, key, v))
            eid += 1
    return rows


def test_vote_fold_all_short_sequences(spark):
    seqs = [list(p) for n in range(1, 6) for p in itertools.product([1, -1], repeat=n)]
    df = spark.createDataFrame(_events(seqs), EV)
    got = {r.movieId: r.vote for r in fb.feedback_state(df).collect()}
    for key, votes in enumerate(seqs):
        assert got.get(key, 0) == fold(votes), votes


def test_stream_state_equals_batch_across_micro_batches(spark):
    from reelspark.streaming.state import feedback_state_stream, run_in_chunks

    # '+ + +' split over two micro-batches, '+ -', '- - +'
    seqs = [[1, 1, 1], [1, -1], [-1, -1, 1], [1, -1, -1]]
    df = spark.createDataFrame(_events(seqs), EV)
    d = tempfile.mkdtemp(prefix="fbstream-", dir="/tmp")
    final = run_in_chunks(spark, df, df.schema, feedback_state_stream, ["session_id", "movieId"],
                          f"{d}/src", f"{d}/sink", f"{d}/ckpt", chunks=2)
    streamed = {r.movieId: r.vote for r in final.collect() if r.vote != 0}
    batch = {r.movieId: r.vote for r in fb.feedback_state(df).collect()}
    assert streamed == batch == {0: 1, 1: -1, 2: 1}


def test_vote_zero_counts_against_and_null_is_no_vote(spark):
    rows = _events([[0], [1, 0], [0, 0], [None, 1], [None]])
    got = {r.movieId: r.vote for r in fb.feedback_state(spark.createDataFrame(rows, EV)).collect()}
    assert got == {0: -1, 1: -1, 3: 1}


def test_favourites_remove_and_unknown_action(spark):
    schema = "event_id long, ts timestamp_ntz, session_id long, movieId long, action string"
    t = dt.datetime(2024, 1, 1)
    rows = [(i, t, 1, m, a) for i, (a, m) in enumerate(
        [("add", 1), ("add", 2), ("remove", 1), ("add", 3), ("add", 1), ("remove", 9), ("add", None)])]
    got = [(r.slot, r.movieId) for r in fb.favourites_state(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(got) == [(1, 2), (2, 3), (3, 1)]
    full = [(i, t, 1, i, "add") for i in range(12)] + [(20, t, 1, 0, "remove"), (21, t, 1, 11, "add")]
    got = sorted((r.slot, r.movieId) for r in fb.favourites_state(spark.createDataFrame(full, schema)).collect())
    assert [m for _, m in got] == [1, 2, 3, 4, 5, 6, 7, 8, 9, 11]
    with pytest.raises(Exception, match="unknown favourites action"):
        fb.favourites_state(spark.createDataFrame([(0, t, 1, 1, "pin")], schema)).collect()


def test_stream_drops_late_votes_and_keeps_rows_without_time(spark):
    from reelspark.streaming.state import feedback_state_stream, run_in_chunks

    t = dt.datetime(2024, 1, 1)
    rows = [(0, t, 1, 1, 1), (1, None, 1, 5, 1), (2, t + dt.timedelta(hours=10), 1, 2, 1), (3, t + dt.timedelta(hours=20), 1, 3, 1)]
    df = spark.createDataFrame(rows, EV)
    d = tempfile.mkdtemp(prefix="late-", dir="/tmp")
    final = run_in_chunks(spark, df, df.schema, feedback_state_stream, ["session_id", "movieId"], f"{d}/src", f"{d}/sink",
                          f"{d}/ckpt", chunks=2)
    assert {r.movieId: r.vote for r in final.collect()} == {1: 1, 5: 1, 2: 1, 3: 1}
    # seven hours behind the newest event: beyond the watermark, so it changes nothing
    late = spark.createDataFrame([(4, t + dt.timedelta(hours=13), 1, 3, 1)], EV)
    late.write.mode("append").parquet(f"{d}/src")
    again = run_in_chunks(spark, df.limit(0), df.schema, feedback_state_stream, ["session_id", "movieId"], f"{d}/src", f"{d}/sink",
                          f"{d}/ckpt", chunks=1)
    assert {r.movieId: r.vote for r in again.collect()}[3] == 1


def test_favourites_add_cap_and_clear(spark):
    rows = [(i, dt.datetime(2024, 1, 1, 0, i), 7, m, "add") for i, m in enumerate([5, 5, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12])]
    rows.append((100, dt.datetime(2024, 1, 2), 8, None, "clear"))
    rows.append((101, dt.datetime(2024, 1, 3), 8, 3, "add"))
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, session_id long, movieId long, action string")
    got = {}
    for r in fb.favourites_state(df).collect():
        got.setdefault(r.session_id, []).append((r.slot, r.movieId))
    assert [m for _, m in sorted(got[7])] == [5, 1, 2, 3, 4, 6, 7, 8, 9, 10]   # repeat ignored, refused at 10
    assert [m for _, m in sorted(got[8])] == [3]


def overlap(a, b):
    """Share of the genres of two sets that both have; an empty set shares none."""
    return len(a & b) / len(a | b) if a and b else 0.0


def check_greedy(ranked, pool, seed_sets, k, d):
    """A list is the diverse ranking if, at each place, no candidate that is not listed
    before has a higher adjusted score, and none of a lower pool rank an equal one."""
    assert len(ranked) == len(set(ranked)) == min(k, len(pool))
    rank = {m: i for i, (m, _, _) in enumerate(pool)}
    score = {m: s for m, s, _ in pool}
    genres = {m: g for m, _, g in pool}
    weight = min(max(d, 0.0), 1.0)
    if weight <= 0.05 or k <= 1:
        assert ranked == [m for m, _, _ in pool][:k]
        return
    for place, chosen in enumerate(ranked):
        shown = [*seed_sets, *(genres[m] for m in ranked[:place])]

        def adjusted(m):
            worst = max((overlap(genres[m], g) for g in shown), default=0.0)
            return (1 - weight) * score[m] - weight * worst * 0.35

        best = adjusted(chosen)
        for other in set(score) - set(ranked[:place + 1]):
            assert adjusted(other) < best or (adjusted(other) == best and rank[other] > rank[chosen]), (place, chosen, other)


@pytest.mark.parametrize("d,k", [(0.0, 5), (0.05, 5), (0.35, 5), (1.0, 5), (2.0, 5), (0.35, 1), (0.35, 50)])
def test_rerank_matches_brute_force(spark, d, k):
    rng = np.random.default_rng(int(d * 100) + k)
    genres = ["A", "B", "C", "D", "E"]
    pool = []
    for m in range(30):
        g = frozenset(x for x in genres if rng.random() < 0.4)
        s = float(np.round(rng.random(), 2))            # coarse scores: ties happen
        pool.append((m, s, g))
    pool.sort(key=lambda t: (-t[1], t[0]))
    seed_sets = [frozenset({"A", "B"}), frozenset()]
    pdf = pd.DataFrame({"profile_id": 1, "movieId": [m for m, _, _ in pool], "score": [s for _, s, _ in pool],
                        "content_score": 0.0, "collaborative_score": 0.0,
                        "pool_rank": list(range(1, len(pool) + 1))})
    pool_df = spark.createDataFrame(pdf)
    genres_df = spark.createDataFrame([(m, sorted(g)) for m, _, g in pool], "movieId long, genre_set array<string>")
    seeds_df = spark.createDataFrame([(1, [sorted(x) for x in seed_sets])], "profile_id long, seed_sets array<array<string>>")
    got = rc.diversity_rerank(pool_df, genres_df, seeds_df, rc.RecParams(top_k=k, diversity=d)).orderBy("rank").collect()
    check_greedy([r.movieId for r in got], pool, seed_sets, k, d)


def test_rerank_with_many_genres(spark):
    """More genres than one bitmask word holds."""
    rng = np.random.default_rng(5)
    genres = [f"g{i:03d}" for i in range(150)]
    pool = [(m, float(np.round(rng.random(), 2)), frozenset(rng.choice(genres, 6).tolist())) for m in range(40)]
    pool.sort(key=lambda t: (-t[1], t[0]))
    seed_sets = [frozenset(genres[:5]), frozenset(genres[100:106])]
    pdf = pd.DataFrame({"profile_id": 1, "movieId": [m for m, _, _ in pool], "score": [s for _, s, _ in pool],
                        "content_score": 0.0, "collaborative_score": 0.0, "pool_rank": list(range(1, len(pool) + 1))})
    genres_df = spark.createDataFrame([(m, sorted(g)) for m, _, g in pool], "movieId long, genre_set array<string>")
    seeds_df = spark.createDataFrame([(1, [sorted(x) for x in seed_sets])], "profile_id long, seed_sets array<array<string>>")
    got = rc.diversity_rerank(spark.createDataFrame(pdf), genres_df, seeds_df, rc.RecParams(top_k=12, diversity=0.6))
    check_greedy([r.movieId for r in got.orderBy("rank").collect()], pool, seed_sets, 12, 0.6)


def test_groups_are_whole_however_batches_are_cut():
    import pyarrow as pa

    from reelspark.functions.arrow import whole_groups

    ids = [1] * 5 + [2] + [3] * 9 + [4] * 2 + [7]
    table = pa.table({"profile_id": ids, "v": list(range(len(ids)))})
    for size in (1, 2, 3, 5, 100):
        batches = [b for t in (table.slice(0, 6), table.slice(6)) for b in [*t.to_batches(max_chunksize=size), t.to_batches()[0].slice(0, 0)]]
        found = [t.to_pydict() for t in whole_groups(iter(batches), "profile_id")]
        assert sum((t["v"] for t in found), []) == table["v"].to_pylist()
        seen = [set(t["profile_id"]) for t in found]
        assert sum(len(x) for x in seen) == len(set(ids))
    assert list(whole_groups(iter([]), "profile_id")) == []


def test_favourites_stream_matches_python_fold(spark):
    from reelspark.streaming.state import favourites_stream, run_in_chunks

    rng = np.random.default_rng(3)
    rows, eid = [], 0
    t0 = dt.datetime(2024, 1, 1)
    for session in range(4):
        for i in range(40):
            action = rng.choice(["add", "add", "add", "remove", "clear"], p=[0.3, 0.3, 0.2, 0.15, 0.05])
            rows.append((eid, t0 + dt.timedelta(minutes=eid), session, int(rng.integers(0, 15)), str(action)))
            eid += 1

    def fold(events, cap=10):
        fav = []
        for _, _, _, m, a in events:
            if a == "add" and m not in fav and len(fav) < cap:
                fav.append(m)
            elif a == "remove" and m in fav:
                fav.remove(m)
            elif a == "clear":
                fav = []
        return ",".join(map(str, fav))

    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, session_id long, movieId long, action string")
    d = tempfile.mkdtemp(prefix="favstream-", dir="/tmp")
    final = run_in_chunks(spark, df, df.schema, favourites_stream, ["session_id"], f"{d}/src", f"{d}/sink",
                          f"{d}/ckpt", chunks=3)
    got = {r.session_id: r.favourites for r in final.collect()}
    want = {s: fold([r for r in rows if r[2] == s]) for s in range(4)}
    assert got == want
