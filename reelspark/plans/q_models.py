"""Queries for §2.6 (rating models) and the model-side sinks of §2.1."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.memo import memo_stat
from ..operators import models as mo
from ..operators import quality as qa
from ..session import scratch_path
from ..sources import readers as rd
from ..sources import stages as st
from ..sources import writers as wr
from . import datasets as ds
from .oracle_views import EXTRA_VIEWS, with_views
from .q_features import NOT_NULL, content_table, train_clean
from .registry import query

CFG = mo.ModelConfig()


def _clean(name: str) -> str:
    return f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY userId, movieId
  ORDER BY "timestamp" DESC, l_orderkey DESC, l_linenumber DESC) AS rn
 FROM split_rows WHERE split = '{name}' AND {NOT_NULL}) t
WHERE rn = 1 AND userId IN (SELECT userId FROM train_clean) AND movieId IN (SELECT movieId FROM train_clean)"""


EXTRA_VIEWS.extend([("val_eval", _clean("val")), ("test_eval", _clean("test"))])


def eval_sets(spark, d):
    """Clean train; clean val / test restricted to users and movies seen in train."""
    rows = ds.split_rows(spark, d)
    tr = train_clean(spark, d)
    va = qa.eval_universe(qa.clean_ratings(ds.split_of(rows, "val")), tr)
    te = qa.eval_universe(qa.clean_ratings(ds.split_of(rows, "test")), tr)
    return tr, va, te


def _r6(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("baseline_mean", with_views("""
SELECT 'Baseline (global mean)' AS model, 'baseline' AS model_type,
 round(sqrt(avg((m - v.rating) * (m - v.rating))), 6) AS val_RMSE, round(avg(abs(m - v.rating)), 6) AS val_MAE,
 (SELECT round(sqrt(avg((m - t.rating) * (m - t.rating))), 6) FROM test_eval t) AS test_RMSE,
 (SELECT round(avg(abs(m - t.rating)), 6) FROM test_eval t) AS test_MAE
FROM val_eval v, (SELECT avg(rating) AS m FROM train_clean) g GROUP BY m"""))
def baseline_mean(spark, d):
    tr, va, te = eval_sets(spark, d)
    r = mo.baseline_metrics(tr, va, te)
    return _r6(spark.createDataFrame([tuple(r.values())], mo.RESULT_SCHEMA))


@query("rmse_mae", with_views("""
SELECT split, round(sqrt(avg((m - rating) * (m - rating))), 6) AS rmse, round(avg(abs(m - rating)), 6) AS mae
FROM (SELECT 'val' AS split, rating FROM val_eval UNION ALL SELECT 'test', rating FROM test_eval) x,
 (SELECT avg(rating) AS m FROM train_clean) g GROUP BY split"""))
def rmse_mae(spark, d):
    tr, va, te = eval_sets(spark, d)
    m = mo.global_mean(tr)
    both = va.withColumn("split", F.lit("val")).unionByName(te.withColumn("split", F.lit("test")))
    pred = both.withColumn("prediction", F.lit(m))
    d2 = F.col("prediction") - F.col("rating")
    return pred.groupBy("split").agg(F.round(F.sqrt(F.avg(d2 * d2)), 6).alias("rmse"),
                                     F.round(F.avg(F.abs(d2)), 6).alias("mae"))


def _one_model(spark, d, kind):
    tr, va, te = eval_sets(spark, d)
    vecs, dim = content_table(spark, d)
    results, _ = mo.evaluate_all(tr, va, te, vecs, dim, kinds=(kind,), cfg=CFG)
    return _r6(spark.createDataFrame([tuple(results[-1].values())], mo.RESULT_SCHEMA))


@query("gmf")
def gmf(spark, d):
    return _one_model(spark, d, "gmf")


@query("neural_cf")
def neural_cf(spark, d):
    return _one_model(spark, d, "neural_cf")


@query("neumf")
def neumf(spark, d):
    return _one_model(spark, d, "neumf")


@query("content_net")
def content_net(spark, d):
    return _one_model(spark, d, "content_net")


@query("hybrid_net")
def hybrid_net(spark, d):
    return _one_model(spark, d, "hybrid_net")


@query("fit")
def fit(spark, d):
    """Per-epoch train / validation RMSE of the hybrid head."""
    tr, va, _ = eval_sets(spark, d)
    vecs, dim = content_table(spark, d)
    m = mo.fit_model(tr, "hybrid_net", vecs, dim, CFG, va)
    return spark.createDataFrame([(h["epoch"], h["train_RMSE"], h["val_RMSE"]) for h in m.history],
                                 "epoch int, train_RMSE double, val_RMSE double")


def _evaluated(spark, d):
    """All kinds over one ALS fit, once per session and input files: the metrics, each kind's
    per-epoch history, and the path that the best one by validation RMSE is saved to."""
    def compute():
        tr, va, te = eval_sets(spark, d)
        vecs, dim = content_table(spark, d)
        results, fitted = mo.evaluate_all(tr, va, te, vecs, dim, cfg=CFG)
        path = scratch_path(spark, "model")
        fitted[mo.best_kind(results)].save(path)
        return results, {kind: m.history for kind, m in fitted.items()}, path

    return memo_stat(ds.split_rows(spark, d), "evaluated", compute)


def _selected(spark, d):
    """The best of all kinds by validation RMSE, loaded as saved."""
    results, _, path = _evaluated(spark, d)
    return results, mo.RatingModel.load(spark, path), eval_sets(spark, d)


@query("predict")
def predict(spark, d):
    """Known (user, movie) pairs of the test split scored by the selected model."""
    _, model, (_, _, te) = _selected(spark, d)
    return model.predict(te.select("userId", "movieId", "rating"))


@query("evaluate_model")
def evaluate_model(spark, d):
    """Metrics of the baseline and all kinds, with the per-epoch history of the networks."""
    results, histories, _ = _evaluated(spark, d)
    of_model = {mo.MODEL_NAMES[kind]: [(h["epoch"], h["train_RMSE"], h["val_RMSE"]) for h in found]
                for kind, found in histories.items()}
    return _r6(spark.createDataFrame(
        [(*r.values(), of_model.get(r["model"], [])) for r in results],
        mo.RESULT_SCHEMA + ", history array<struct<epoch int, train_RMSE double, val_RMSE double>>"))


@query("model_comparison")
def model_comparison(spark, d):
    return mo.comparison_table(spark, _evaluated(spark, d)[0])


@query("retrain_full")
def retrain_full(spark, d):
    """The selected kind refitted on all splits (cleaned, later split wins) with features built
    afresh from the movies of all splits: training RMSE."""
    results, model, _ = _selected(spark, d)
    full = mo.narrow(qa.full_dataset(ds.split_rows(spark, d)), "full-rows")
    vecs, dim = content_table(spark, d, splits=("train", "val", "test"))
    again = mo.fit_model(full, model.kind, vecs, dim, CFG)
    rmse, mae = mo._metrics(again.refit(full))
    return spark.createDataFrame([(mo.MODEL_NAMES[model.kind], full.count(), rmse, mae)],
                                 "model string, rows long, train_RMSE double, train_MAE double")


@query("stage_reuse", with_views("""
SELECT run, reused, (SELECT count(*) FROM train_clean) AS rows
FROM (VALUES ('first', false), ('same', true), ('changed', false), ('fresh', false)) AS r(run, reused)"""))
def stage_reuse(spark, d):
    """The clean-train stage built once, then reused on an equal fingerprint, rebuilt when it changes."""
    base = scratch_path(spark, "stages")
    fp = CFG.fingerprint()
    runs = []
    for label, fprint, fresh in (("first", fp, False), ("same", fp, False), ("changed", fp + "x", False),
                                 ("fresh", fp + "x", True)):
        df, reused = st.stage(spark, base, "train_clean", fprint, lambda: train_clean(spark, d), fresh=fresh)
        runs.append((label, reused, df.count()))
    return spark.createDataFrame(runs, "run string, reused boolean, rows long")


def _predicted_in_batch(spark, d):
    """ids from CSV (by name) -> predictions of the selected model -> CSV, read back."""
    _, model, (_, _, te) = _selected(spark, d)
    src = scratch_path(spark, "predict_in")
    wr.sink_csv(te.select("movieId", "userId"), src)
    out = scratch_path(spark, "predict_out")
    wr.sink_csv(model.predict(rd.scan_ids(spark, src)), out)
    return spark.read.option("header", True).schema("userId int, movieId int, predicted_rating double").csv(out)


@query("batch_predict_io")
def batch_predict_io(spark, d):
    """The predictions; a test holds them against the model's own."""
    return _predicted_in_batch(spark, d)


@query("batch_predict_ids", with_views("""
SELECT CAST(t.userId AS INTEGER) AS userId, CAST(t.movieId AS INTEGER) AS movieId FROM test_eval t"""))
def batch_predict_ids(spark, d):
    """The rows of ``batch_predict_io`` that have a prediction, exactly."""
    return _predicted_in_batch(spark, d).where(F.col("predicted_rating").isNotNull()).select("userId", "movieId")


@query("report_sink", with_views(f"""
SELECT count(*) AS rows_train, (SELECT count(*) FROM val_eval) AS rows_val, (SELECT count(*) FROM test_eval) AS rows_test,
 round(avg(rating), 6) AS global_mean, CAST(6 AS BIGINT) AS models, true AS best_is_least FROM train_clean"""))
def report_sink(spark, d):
    """The whole report on the baseline and all kinds, written and read back: row counts and
    mean exactly, the best block against the models' own metrics."""
    tr, va, te = eval_sets(spark, d)
    results, histories, _ = _evaluated(spark, d)
    counts = {"train": tr.count(), "val": va.count(), "test": te.count()}
    base = scratch_path(spark, "report")
    wr.report_sink(mo.comparison_table(spark, results), qa.clean_stats(ds.raw_rows(spark, d)), base,
                   mo.report(spark, results, histories, counts, mo.global_mean(tr)))
    models = spark.read.json(base + "/report/models").where("model_type <> 'baseline'")
    least = models.agg(F.min("val_RMSE").alias("least"), F.count(F.lit(1)).alias("n"))
    got = spark.read.schema("best map<string,string>, global_mean double, row_counts map<string,long>").json(base + "/report/summary")
    return got.join(least).select(
        F.col("row_counts.train").alias("rows_train"), F.col("row_counts.val").alias("rows_val"), F.col("row_counts.test").alias("rows_test"),
        F.round("global_mean", 6).alias("global_mean"), (F.col("n") + 1).alias("models"),
        (F.col("best.val_RMSE").cast("double") == F.col("least")).alias("best_is_least"))
