"""Round 4: work per row that must not grow with the batch, the kinds or the block (small tables, plans and counts)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from reelspark.operators import models as mo
from reelspark.operators import recommend as rc
from reelspark.plans import recommend_job as job


def _ratings(spark, n=400):
    rng = np.random.default_rng(3)
    rows = [(int(u), int(m), float(r)) for u, m, r in zip(rng.integers(0, 40, n), rng.integers(0, 30, n), rng.integers(1, 11, n) / 2)]
    return spark.createDataFrame(rows, "userId long, movieId long, rating double").dropDuplicates(["userId", "movieId"])


def _tables(spark):
    users = spark.createDataFrame([(i, [float(i), 1.0, 2.0]) for i in range(40)], "id int, features array<float>")
    movies = spark.createDataFrame([(i, [1.0, float(i), 3.0]) for i in range(25)], "id int, features array<float>")
    content = spark.createDataFrame([(i, [float(i), 0.5]) for i in range(5, 30)], "movieId long, content array<double>")
    return users, movies, content


def test_no_null_list_is_sent_to_python(spark):
    """Arrow's writer passes over all null lists at the end of a batch at each row."""
    dealt = mo.deal({"train": _ratings(spark)}, *_tables(spark), 2)
    assert dealt.table.where("factor IS NULL OR content IS NULL").count() == 0
    found = dealt.table.where(F.col("kind") == mo.MOVIE).select("movie", F.size("factor"), F.size("content")).distinct().collect()
    assert sorted(map(tuple, found)) == [(i, 3 if i < 25 else 0, 2 if i >= 5 else 0) for i in range(30)]


def test_dealt_rows_are_sorted_by_columns(spark):
    """A hash in the sort order would be worked out at each comparison."""
    plan = mo.deal({"train": _ratings(spark)}, *_tables(spark), 2).table._jdf.queryExecution().optimizedPlan().toString()
    sort = next(line for line in plan.splitlines() if "Sort [" in line)
    assert "xxhash64" not in sort and "CASE" not in sort


def test_all_kinds_are_trained_in_one_job_an_epoch(spark, monkeypatch):
    rows = _ratings(spark)
    kinds = [k for k in mo.ALL_KINDS if k != "gmf"]
    cfg = mo.ModelConfig(embed_dim=3, epochs=2, batch_size=16)
    dealt = mo.packed(mo.deal({"train": rows, "val": rows.limit(50)}, *_tables(spark), 2))
    asked, of = [], mo.Dealt.of
    monkeypatch.setattr(mo.Dealt, "of", lambda self, name: asked.append(name) or of(self, name))
    together = mo.fit_mlps(dealt, kinds, 3.0, cfg, val="val")
    assert asked == ["train", "val", "val"]
    for kind in kinds:
        alone = mo.fit_mlp(dealt, kind, 3.0, cfg, val="val")
        assert np.allclose(alone.theta, together[kind].theta, rtol=0, atol=1e-12)
        assert np.allclose([list(h.values()) for h in alone.history], [list(h.values()) for h in together[kind].history])


def test_adam_in_place_takes_the_steps_of_the_formula():
    rng = np.random.default_rng(5)
    cfg = mo.ModelConfig(hidden=(7, 4))
    layout = mo._layout(6, cfg.hidden, 3)
    theta = mo._init(layout, 1)
    X, G, y = rng.normal(size=(20, 6)), rng.normal(size=(20, 3)), rng.normal(size=20)
    adam = mo._Adam(theta, layout, 2, cfg)
    want, m1, m2, loss = theta.copy(), 0.0, 0.0, 0.0
    for t in range(1, 5):
        def squares(w):
            err = mo._forward(mo._unflatten(w, layout), X, G, 2)[0] - y
            return (err * err).sum()

        loss += squares(want)
        slope = np.array([(squares(want + e) - squares(want - e)) / 2e-6 for e in 1e-6 * np.eye(len(want))])
        grad = slope / len(y) + cfg.weight_decay * want
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
        want = want - cfg.lr * (m1 / (1 - 0.9 ** t)) / (np.sqrt(m2 / (1 - 0.999 ** t)) + 1e-8)
        adam.step(X, G, y)
    assert np.allclose(adam.theta, want, atol=1e-5) and np.isclose(adam.loss, loss)


def test_als_blocks_follow_the_ratings(spark, monkeypatch):
    from pyspark.ml.recommendation import ALS

    asked, fit = [], ALS.fit
    monkeypatch.setattr(ALS, "fit", lambda self, data: asked.append((self.getNumUserBlocks(), self.getNumItemBlocks())) or fit(self, data))
    train = _ratings(spark)
    n = train.count()
    cfg = mo.ModelConfig(embed_dim=4, als_iters=1)
    mo.fit_als(train, cfg)
    monkeypatch.setattr(mo, "ALS_BLOCK_RATINGS", n // 12)
    mo.fit_als(train, cfg)
    assert asked == [(10, 10), (13, 13)] and mo.als_blocks(mo.ALS_BLOCK_RATINGS * 66) == 66


def _scored(spark, n=60, twice=False):
    """Items with genre sets (some of them near copies of others; one twice) and profiles with all roles."""
    rng = np.random.default_rng(11)
    content, factor = rng.normal(size=(n, 4)), rng.normal(size=(n, 5))
    content[n // 2:], factor[n // 2:] = content[:n - n // 2] * (1 + 1e-9), factor[:n - n // 2] + 1e-10
    genres = [[g for g in ("Drama", "War", "Comedy", "Horror") if rng.random() < 0.4] for _ in range(n)]
    rows = [(i, [*map(float, content[i])], [*map(float, factor[i])], genres[i]) for i in range(n)]
    rows += [(2, *rows[2][1:3], ["Family"]), rows[7]] if twice else []
    items = spark.createDataFrame(rows, "movieId long, content array<double>, factor array<double>, genre_set array<string>")
    profiles = [(p, int(m), k, "seed") for p in range(25) for k, m in enumerate(rng.integers(0, n, 4))]
    profiles += [(p, int(m), 0, role) for p in range(0, 25, 3) for m, role in zip(rng.integers(0, n, 2), ("like", "dislike"))]
    return items, spark.createDataFrame(profiles, "profile_id long, movieId long, pos int, role string"), content, factor


def _wanted(profiles, content, factor, p):
    """All scores of a profile in double precision, by definition."""
    def unit(m):
        return m / np.linalg.norm(m, axis=-1, keepdims=True)

    of = {}
    for r in profiles.collect():
        of.setdefault(r.profile_id, {"seed": [], "like": [], "dislike": []})[r.role].append(r.movieId)
    cu, fu = unit(content), unit(factor)
    for pid, x in of.items():
        own = x["seed"] + x["like"]
        c, cf = cu @ unit(content[own].mean(axis=0)), fu @ unit(factor[own].mean(axis=0))
        h = p.content_weight * c + p.collab_weight * cf
        s = h.copy()
        s[list(set(x["dislike"]))] -= p.dislike_penalty
        s[list(set(x["like"]))] += p.like_boost
        for role, weight in (("like", p.similarity_weight), ("dislike", -p.similarity_weight)):
            if x[role]:
                s += weight * (fu @ unit(factor[x[role]].mean(axis=0)))
        yield pid, {m for v in x.values() for m in v}, {"content": c, "collab": cf, "hybrid": h, "adjusted": s}


def test_single_precision_only_chooses_what_is_scored(spark, monkeypatch):
    monkeypatch.setattr(rc, "PAIRS_AT_ONCE", 7)
    items, profiles, content, factor = _scored(spark)
    p = rc.RecParams(top_k=3, diversity=0.0)
    pool, cut = ({}, {})
    for r in rc.candidate_pool(profiles, items, p).collect():
        pool.setdefault(r.profile_id, []).append((r.pool_rank, r.movieId, r.score, r.content_score))
    for r in rc.plain_top_k(rc.candidate_pool(profiles, items, p, rc.pick_margin(p)), 3).collect():
        cut.setdefault(r.profile_id, []).append((r.pool_rank, r.movieId, r.score, r.content_score))
    stats = {r.profile_id: r for r in rc.similarity_stats(profiles, items, p).collect()}
    for pid, known, want in _wanted(profiles, content, factor, p):
        s = want["adjusted"]
        got = sorted(pool[pid])
        assert sorted(m for _, m, _, _ in got) == sorted(set(range(60)) - known)
        assert all(abs(s[m] - score) < 1e-12 and abs(want["content"][m] - c) < 1e-12 for _, m, score, c in got)
        assert [score for _, _, score, _ in got] == sorted((x[2] for x in got), reverse=True)
        assert [x[:2] for x in sorted(cut[pid])] == [x[:2] for x in got[:3]]
        for kind, v in want.items():
            r = stats[pid]
            assert r[f"{kind}_n"] == 60 and abs(r[f"{kind}_sum"] - v.sum()) < 1e-9 and abs(r[f"{kind}_max"] - v.max()) < 1e-12
            assert r[f"{kind}_argmax"] == np.flatnonzero(v >= v.max() - 1e-12).min()
    one = rc.similarity_stats(profiles, items, p, ("collab",))
    assert one.columns == ["profile_id", "collab_n", "collab_sum", "collab_max", "collab_argmax"]
    assert {r.profile_id: r.collab_argmax for r in one.collect()} == {k: r.collab_argmax for k, r in stats.items()}


def test_low_kth_is_reached_by_k_entries():
    rng = np.random.default_rng(2)
    for n, k in ((5, 5), (7, 3), (100, 4), (1000, 10), (1003, 3), (5000, 300)):
        s = rng.normal(size=(6, n)).astype(np.float32)
        low = rc._low_kth(s, k)
        exact = np.sort(s, axis=1)[:, ::-1][:, k - 1] if n > k else np.full(6, -np.inf)
        assert (low <= exact).all() and ((s >= low[:, None]).sum(axis=1) >= min(n, k)).all()
        assert ((s >= low[:, None]).sum(axis=1) <= 1.5 * k + 10).all() or n <= k


def test_rerank_follows_the_scoring_without_joins(spark, monkeypatch):
    for twice in (False, True):
        items, profiles, _, _ = _scored(spark, twice=twice)
        p = rc.RecParams(top_k=4, diversity=0.6)
        sets = rc.seed_genre_sets(profiles, items)
        plain = rc.diversity_rerank(rc.candidate_pool(profiles, items, p), items, sets, p)
        want = sorted((r.profile_id, r["rank"], r.movieId, r.pool_rank) for r in plain.collect())
        got = job.rank_for(profiles, items, p)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        above = plan[:plan.index("MapInArrow", plan.index("MapInArrow") + 1)]
        assert not any(x in above for x in ("Join", "Window", "Repartition"))
        assert sorted((r.profile_id, r["rank"], r.movieId, r.pool_rank) for r in got.collect()) == want != []
        monkeypatch.setattr(rc, "ITEM_BLOCK_BYTES", 1500)
        assert rc._grid(profiles, items)[0] > 2
        many = job.rank_for(profiles, items, p)
        assert sorted((r.profile_id, r["rank"], r.movieId, r.pool_rank) for r in many.collect()) == want
        monkeypatch.undo()


def test_cells_hold_no_null_list(spark):
    items, profiles, _, _ = _scored(spark)
    cells = rc._in_cells(rc.scoring_inputs(profiles, items), items, 1, 2)
    lists = [c for c, t in cells.dtypes if t.startswith("array")]
    assert len(lists) == 8 and cells.where(" OR ".join(f"{c} IS NULL" for c in lists)).count() == 0
