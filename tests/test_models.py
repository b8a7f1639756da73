"""Models on a planted low-rank table: quality, selection, saving, and use in the recommender."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.operators import models as mo


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(7)
    U, M, k = 120, 80, 3
    u = rng.normal(size=(U, k))
    m = rng.normal(size=(M, k))
    rows = []
    for i in range(U):
        for j in rng.choice(M, size=40, replace=False):
            r = float(np.clip(np.round((3.0 + u[i] @ m[j]) * 2) / 2, 0.5, 5.0))
            rows.append((i, int(j), r, int(rng.integers(0, 1000))))
    df = spark.createDataFrame(rows, "userId long, movieId long, rating double, timestamp long")
    train = df.where(F.col("timestamp") < 700)
    val = df.where((F.col("timestamp") >= 700) & (F.col("timestamp") < 850))
    test = df.where(F.col("timestamp") >= 850)
    content = spark.createDataFrame([(j, [float(x) for x in m[j]]) for j in range(M)], "movieId long, content array<double>")
    return train, val, test, content, k


CFG = mo.ModelConfig(embed_dim=8, als_iters=10, als_reg=0.05, epochs=5, batch_size=64, lr=3e-3)


@pytest.fixture(scope="module")
def evaluated(planted):
    train, val, test, content, k = planted
    return mo.evaluate_all(train, val, test, content, k, cfg=CFG)


def test_models_beat_baseline(evaluated):
    results, models = evaluated
    base = results[0]
    assert len(results) == 6 and set(models) == set(mo.ALL_KINDS)
    for r in results[1:]:
        assert r["val_RMSE"] < base["val_RMSE"] and r["test_RMSE"] < base["test_RMSE"], (r, base)
    assert all(len(models[k].history) == CFG.epochs for k in mo.ALL_KINDS if k != "gmf")


def test_selection_save_load_and_predict(spark, planted, evaluated, tmp_path):
    train, _, test, _, _ = planted
    results, models = evaluated
    best = mo.best_kind(results)
    assert min(r["val_RMSE"] for r in results[1:]) == next(r["val_RMSE"] for r in results if r["model"] == mo.MODEL_NAMES[best])
    for kind in ("gmf", "content_net", "neumf"):
        path = f"file://{tmp_path}/{kind}"
        models[kind].save(path)
        loaded = mo.RatingModel.load(spark, path)
        pairs = test.select("userId", "movieId").union(spark.createDataFrame([(9999, 1), (1, 9999)], "a long, b long"))
        a, b = ({(r.userId, r.movieId): round(r.predicted_rating, 5) for r in m.predict(pairs).collect()} for m in (models[kind], loaded))
        assert a == b and len(a) == test.select("userId", "movieId").distinct().count() and (9999, 1) not in a
    with pytest.raises(ValueError, match="trained"):
        models["gmf"].predict(spark.createDataFrame([(9999, 9999)], "userId long, movieId long"))


def test_unseen_users_and_movies_are_scored_not_dropped(spark, evaluated):
    _, models = evaluated
    rows = spark.createDataFrame([(9999, 1, 3.0), (1, 9999, 3.0), (1, 1, 3.0)], "userId long, movieId long, rating double")
    for kind in ("content_net", "hybrid_net", "neural_cf"):
        assert models[kind].score(rows).count() == 3


def test_report(spark, planted, evaluated):
    results, models = evaluated
    row = mo.report(spark, results, {k: m.history for k, m in models.items()}, {"train": 1, "val": 2, "test": 3}, 3.5).first()
    assert row.best["model"] == mo.MODEL_NAMES[mo.best_kind(results)] and row.global_mean == 3.5
    assert row.row_counts == {"train": 1, "val": 2, "test": 3} and "val_RMSE" in row.histories


def test_recommending_on_own_tables_with_trained_factors(spark, evaluated):
    from reelspark.operators import recommend as rc
    from reelspark.plans import recommend_job as job

    _, models = evaluated
    catalog = spark.createDataFrame([(j, f"Film {j} (20{j % 10:02d})", "Drama" if j % 2 else "Comedy|Drama", 2000 + j % 10, "")
                                     for j in range(80)], "movieId long, title string, genres string, release_year int, poster_url string")
    items = job.items_for(catalog, job.model_factors(models["gmf"]))
    profiles = spark.createDataFrame([(1, 3, 1, "seed"), (1, 4, 2, "seed"), (1, 5, 0, "dislike"), (2, 7, 1, "seed"), (3, 999, 1, "seed")],
                                     "profile_id long, movieId long, pos int, role string")
    ready = job.ready_for(profiles, items.select("movieId"))
    rated = spark.createDataFrame([(1, 3, 5.0), (1, 9, 5.0)], "userId long, movieId long, rating double")
    got = job.recommend_for(ready, catalog, items, rc.RecParams(top_k=5, diversity=0.3), rated).collect()
    assert {r.profile_id for r in got} == {1, 2} and len(got) == 10
    assert not {r.movieId for r in got if r.profile_id == 1} & {3, 4, 5} and all(r.explanations and r.headline for r in got)
    shown = job.suggestions_for(ready, catalog, items, limit=4).collect()
    assert sorted((r.profile_id, r.pos) for r in shown) == [(p, i) for p in (1, 2) for i in range(1, 5)]


def test_lifecycle_queries_choose_from_all_kinds(spark, planted, evaluated, monkeypatch, tmp_path):
    from reelspark.plans import q_models as q

    train, val, test, content, k = planted
    results, models = evaluated
    least = min(r["val_RMSE"] for r in results)
    ranked = [r | {"val_RMSE": least / 2} if r["model"] == mo.MODEL_NAMES["neumf"] else r for r in results]
    asked = []

    def known(tr, va, te, vecs, dim, kinds=mo.ALL_KINDS, cfg=None):
        asked.append(tuple(kinds))
        names = {mo.MODEL_NAMES[i] for i in kinds}
        return [r for r in ranked if r["model_type"] == "baseline" or r["model"] in names], {i: models[i] for i in kinds}

    rows = f"{tmp_path}/rows"
    train.write.parquet(rows)
    monkeypatch.setattr(mo, "evaluate_all", known)
    monkeypatch.setattr(q, "eval_sets", lambda spark, d: (train, val, test))
    monkeypatch.setattr(q, "content_table", lambda spark, d, splits=None: (content, k))
    monkeypatch.setattr(q.ds, "split_rows", lambda spark, d: spark.read.parquet(rows))
    _, model, _ = q._selected(spark, "planted")
    assert model.kind == "neumf"
    pairs = test.select("userId", "movieId")
    want = {(r.userId, r.movieId): round(r.predicted_rating, 5) for r in models["neumf"].predict(pairs).collect()}
    assert {(r.userId, r.movieId): round(r.predicted_rating, 5) for r in q.predict(spark, "planted").collect()} == want
    got = q.batch_predict_io(spark, "planted").collect()
    assert {(r.userId, r.movieId): round(r.predicted_rating, 5) for r in got} == want
    assert {tuple(r) for r in q.batch_predict_ids(spark, "planted").collect()} == set(want)
    named = [r.model for r in q.model_comparison(spark, "planted").where("selected").collect()]
    assert named == [mo.MODEL_NAMES["neumf"]]
    got = {r.model: r for r in q.evaluate_model(spark, "planted").collect()}
    assert len(got) == 6
    for kind in mo.ALL_KINDS:
        assert [h.epoch for h in got[mo.MODEL_NAMES[kind]].history] == [h["epoch"] for h in models[kind].history]
    assert len(got[mo.MODEL_NAMES["hybrid_net"]].history) == 5
    assert asked == [mo.ALL_KINDS]


def test_retraining_has_features_of_all_movies(spark, monkeypatch):
    """A movie that only the test split has gets its own features when all splits are trained on."""
    from reelspark.plans import q_features, q_models

    rows = spark.createDataFrame(
        [(u, m, 4.0 - (u + m) % 3, 10 * u + m, genres, year, split, u, m) for m, genres, year, split in
         ((1, "Drama", 1990, "train"), (2, "Comedy|Drama", 2000, "train"), (3, "War", 2010, "val"), (4, "Horror", 2020, "test"))
         for u in range(6)],
        "userId long, movieId long, rating double, timestamp long, genres string, release_year int, split string, l_orderkey long, l_linenumber long")
    monkeypatch.setattr(q_features.ds, "split_rows", lambda spark, d: rows)
    of_train, n = q_features.content_table(spark, "planted")
    of_all, m = q_features.content_table(spark, "planted", splits=("train", "val", "test"))
    assert {r.movieId for r in of_train.collect()} == {1, 2} and n == 3
    assert {r.movieId for r in of_all.collect()} == {1, 2, 3, 4} and m == 5
    asked = []

    class Kind:
        kind = "content_net"

    def fitted(full, kind, vecs, dim, cfg):
        asked.append(({r.movieId for r in vecs.collect()}, dim, full.count()))
        raise RuntimeError("far enough")

    monkeypatch.setattr(q_models, "_selected", lambda spark, d: (None, Kind, None))
    monkeypatch.setattr(q_models.mo, "fit_model", fitted)
    with pytest.raises(RuntimeError, match="far enough"):
        q_models.retrain_full(spark, "planted")
    assert asked == [({1, 2, 3, 4}, 5, 24)]


def test_rows_meet_their_factors_on_the_grid(spark, planted, evaluated, monkeypatch):
    """Every row of a name once, with the factors and content of its own ids, whatever the grid."""
    train, _, _, content, k = planted
    model = evaluated[1]["hybrid_net"]
    monkeypatch.setattr(mo, "BLOCK_BYTES", 1000)
    rows = train.select("userId", "movieId", "rating").union(
        spark.createDataFrame([(9999, 1, 3.0), (1, 9999, 3.0), (None, 1, 3.0), (1, 1, 2.0), (1, 1, 2.0)], train.drop("timestamp").schema))
    dealt = mo.deal({"a": rows, "b": rows.limit(0)}, model.user_f, model.item_f, content, k)
    assert dealt.table.rdd.getNumPartitions() > 9
    u, m = ({r.id: np.array(r.features, dtype=float) for r in f.collect()} for f in (model.user_f, model.item_f))
    c = {r.movieId: r.content for r in content.collect()}
    want = []
    for r in rows.collect():
        x = np.concatenate([u.get(r.userId, np.zeros(8)), m.get(r.movieId, np.zeros(8)), c.get(r.movieId, np.zeros(k))])
        y, _ = mo._forward(mo._unflatten(model.head.theta, model.head.layout), x[None], None, 2)
        want.append((str(r.userId), r.movieId, r.rating, round(float(y[0]), 6)))
    got = [(str(r.row.userId), r.row.movieId, r.row.rating, round(r.prediction, 6))
           for r in mo._predicted(dealt, "a", ["row"], model.head).collect()]
    assert sorted(got) == sorted(want)
    assert sorted(round(r.prediction, 6) for r in mo._predicted(mo.packed(dealt), "a", ["rating"], model.head).collect()) == sorted(
        w[3] for w in want)


def test_training_stores_no_wide_rows_and_lets_go_of_als_shuffles(spark, planted, monkeypatch):
    from pyspark.ml.recommendation import ALS

    train, _, _, content, k = planted
    asked, fit = [], ALS.fit
    monkeypatch.setattr(ALS, "fit", lambda self, data: asked.append(self.getCheckpointInterval()) or fit(self, data))
    cfg = mo.ModelConfig(embed_dim=64, als_iters=2, epochs=1)
    als = mo.fit_als(train, cfg)
    assert asked == [1] and spark.sparkContext.getCheckpointDir()
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())

    def stored():
        return fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(fs).getLength()

    before = stored()
    mo.fit_model(train, "hybrid_net", content, k, cfg, als=als)
    assert stored() - before < train.count() * 8 * (64 + 64 + k) / 4
