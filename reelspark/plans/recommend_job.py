"""The composed recommendation jobs. The functions with ``_for`` take a user's own tables:

* ``profiles(profile_id, movieId, pos, role)``: seeds, likes and dislikes;
* ``catalog(movieId, title, genres, release_year, poster_url, ...)``;
* ``factors(movieId, factor array<double>)``: for example ``model_factors`` of a trained model;
* ``rated(userId, movieId, rating)``: for the cohort notes.

The others run them on the tables of a directory (the fixture views).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.columns import genre_set
from ..operators import explain as ex
from ..operators import features as fe
from ..operators import models as mo
from ..operators import recommend as rc
from ..operators import search as se
from ..session import apply_runtime_conf, checkpoint_root
from ..sources import fixtures as fx
from . import datasets as ds
from .q_features import content_table


# ---------------------------------------------------------------------------- on own tables

def model_factors(model: mo.RatingModel) -> DataFrame:
    """(movieId, factor) of a trained model's movies."""
    return model.item_f.select(F.col("id").cast("long").alias("movieId"), F.col("features").cast("array<double>").alias("factor"))


def items_for(catalog: DataFrame, factors: DataFrame, content: DataFrame | None = None, dim: int | None = None) -> DataFrame:
    """(movieId, content, factor, genre_set) of the movies that have a factor and are in the
    catalog. ``content``: ready content vectors of width ``dim``; by default they are
    built from the catalog's genres and years. Movies without one get zeros."""
    if content is None:
        featured = catalog.where(F.col("genres").isNotNull() & F.col("release_year").isNotNull())
        content, vocab = fe.content_vectors(featured.select("movieId", "genres", "release_year"))
        dim = len(vocab) + 1
    it = factors.join(catalog.select("movieId", "genres"), "movieId").join(content, "movieId", "left")
    it = it.select("movieId", F.coalesce("content", F.array_repeat(F.lit(0.0), dim)).alias("content"),
                   "factor", genre_set("genres").alias("genre_set"))
    # bounded by the catalog and read several times: materialise once in the checkpoint folder
    checkpoint_root(it.sparkSession)
    return it.checkpoint(eager=True)


def ready_for(profiles: DataFrame, item_ids: DataFrame) -> DataFrame:
    """Seeds the model does not cover are pruned first (as the picker does); profiles left
    with 0 or more than 10 seeds are then invalid and skipped."""
    seeds = se.prune_unsupported(profiles.where(F.col("role") == "seed"), item_ids)
    p = seeds.unionByName(profiles.where(F.col("role") != "seed"))
    checkpoint_root(p.sparkSession)
    p = p.checkpoint(eager=True)              # read by each of the checks
    return rc.valid_profiles(p, item_ids).checkpoint(eager=True)


def rank_for(profiles: DataFrame, items: DataFrame, params: rc.RecParams) -> DataFrame:
    """Ranked picks per (ready) profile, before explanation."""
    if params.clipped_diversity <= 0.05 or params.top_k <= 1:
        return rc.plain_top_k(rc.candidate_pool(profiles, items, params, rc.pick_margin(params)), params.top_k)
    sets = rc.seed_genre_sets(profiles, items)
    return rc.diversity_rerank(rc.candidate_pool(profiles, items, params, rc.pick_margin(params), sets), items, sets, params)


def recommend_for(profiles: DataFrame, catalog: DataFrame, items: DataFrame, params: rc.RecParams = rc.RecParams(),
                  rated: DataFrame | None = None, explain: bool = True) -> DataFrame:
    """Recommendations for all (ready) profiles with their explanations; cohort notes too if
    the ratings are given."""
    apply_runtime_conf(profiles.sparkSession)
    recs = rc.display_order(rank_for(profiles, items, params))
    if not explain:
        return recs.join(catalog.select("movieId", "title", "genres", "release_year", "poster_url"), "movieId", "left")
    return ex.explain(ex.note_recs(recs, rated, profiles, catalog) if rated is not None else recs, profiles, catalog)


def suggestions_for(profiles: DataFrame, catalog: DataFrame, items: DataFrame, limit: int = 8) -> DataFrame:
    """Franchise titles first (disliked ones dropped after the franchise limit), then hybrid
    picks with diversity off, no repeats, ``limit`` in all, each with its reason."""
    recs = rank_for(profiles, items, rc.RecParams(top_k=limit, diversity=0.0))
    fr = se.franchise_suggestions(catalog, profiles, limit=limit)
    blocked = profiles.where(F.col("role") == "dislike").select("profile_id", "movieId")
    fr = fr.join(blocked, ["profile_id", "movieId"], "left_anti")
    a = fr.select("profile_id", "movieId", F.lit(0).alias("src"), F.col("pos").alias("o"), "reason")
    b = recs.select("profile_id", "movieId", F.lit(1).alias("src"), F.col("rank").alias("o"),
                    F.lit(R.TXT_HYBRID_REASON).alias("reason"))
    seen = profiles.where(F.col("role") == "seed").select("profile_id", "movieId")
    b = b.join(seen, ["profile_id", "movieId"], "left_anti").join(fr.select("profile_id", "movieId"),
                                                                  ["profile_id", "movieId"], "left_anti")
    w = Window.partitionBy("profile_id").orderBy("src", "o")
    out = a.unionByName(b).withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= limit)
    return out.join(catalog.select("movieId", "title"), "movieId", "left").select(
        "profile_id", "pos", "movieId", "title", "reason")


# ---------------------------------------------------------------------------- on a directory

def items(spark: SparkSession, d: str) -> DataFrame:
    """Items of the fixture's factors, with the training movies' content vectors."""
    vecs, dim = content_table(spark, d)
    return items_for(ds.serving(spark, d), fx.factors(spark, d), vecs, dim)


def item_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the movies the model covers (factor ids in the serving catalog), without
    building the item vectors."""
    cat = ds.serving(spark, d).select("movieId")
    return fx.factors(spark, d).select("movieId").join(cat, "movieId", "left_semi")


def ready_profiles(spark: SparkSession, d: str, item_ids: DataFrame) -> DataFrame:
    return ready_for(fx.profiles(spark, d), item_ids)


def core(spark: SparkSession, d: str, params: rc.RecParams):
    """(recs, profiles, items): ranked picks per profile before explanation."""
    it = items(spark, d)
    prof = ready_profiles(spark, d, it.select("movieId"))
    return rank_for(prof, it, params), prof, it


def recommend(spark: SparkSession, d: str, params: rc.RecParams = rc.RecParams()) -> DataFrame:
    it = items(spark, d)
    prof = ready_profiles(spark, d, it.select("movieId"))
    return recommend_for(prof, ds.serving(spark, d), it, params, ds.split_rows(spark, d))


def pick_suggestions(spark: SparkSession, d: str, limit: int = 8) -> DataFrame:
    it = items(spark, d)
    prof = ready_profiles(spark, d, it.select("movieId"))
    return suggestions_for(prof, ds.serving(spark, d), it, limit)
