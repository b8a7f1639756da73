"""Queries for §2.8 (recommendation) and §2.9 (explanation)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.columns import decade_label as _decade_label
from ..functions.columns import genre_set
from ..operators import explain as ex
from ..operators import recommend as rc
from ..sources import fixtures as fx
from . import datasets as ds
from . import recommend_job as job
from .oracle_views import EXTRA_VIEWS, with_views
from .q_features import GLIST
from .q_search import _franchise_case
from .registry import query

P10 = rc.RecParams(top_k=10, diversity=0.0)


def gset(col: str = "genres") -> str:
    """SQL genre set of a genres column (same rules as functions.columns.genre_set)."""
    return "list_distinct(" + GLIST.replace("genres IS NULL", f"{col} IS NULL").replace("trim(genres)", f"trim({col})") \
        .replace("string_split(genres,", f"string_split({col},") + ")"


GSET = gset("genres")


def _cos(a: str, b: str) -> str:
    return (f"(CASE WHEN list_dot_product({a}, {a}) = 0 OR list_dot_product({b}, {b}) = 0 THEN CAST(0 AS DOUBLE) "
            f"ELSE list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) END)")


def _theme_sql(g: str) -> str:
    arms = " ".join(f"WHEN list_has_all({g}, {list(needed)}) THEN '{phrase}'" for needed, phrase in R.THEME_TAGS)
    return f"(CASE {arms} WHEN len({g}) > 0 THEN concat(lower(array_to_string(list_sort({g})[1:3], ', ')), ' storytelling') END)"


def _tags_sql(g: str) -> str:
    arms = ", ".join(f"CASE WHEN list_has_all({g}, {list(needed)}) THEN '{tag}' END" for needed, tag in R.THEME_TAGS)
    return f"list_filter([{arms}], lambda x: x IS NOT NULL)[1:3]"


def _decade_sql(y: str) -> str:
    return f"(CASE WHEN {y} IS NULL THEN NULL ELSE concat(CAST(CAST(floor({y} / 10) * 10 AS BIGINT) AS VARCHAR), 's') END)"


def _pct_sql(x: str) -> str:
    return f"CAST(CAST(round_even(100 * {x}, 0) AS BIGINT) AS VARCHAR)"


def _pool_views(limit: int, k: int) -> list[tuple[str, str]]:
    return [
        (f"pool{k}", f"""
SELECT profile_id, movieId, score, c AS content_score, cf AS collaborative_score,
 CAST(row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, movieId) AS INTEGER) AS pool_rank
FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, movieId) AS srank FROM pairs) t
WHERE srank <= {limit} AND excluded IS NULL"""),
        (f"recs{k}", f"SELECT *, pool_rank AS rank FROM pool{k} WHERE pool_rank <= {k}"),
    ]


EXTRA_VIEWS.extend([
    ("items", f"""
SELECT f.movieId, f.factor, s.genres, {gset('s.genres')} AS gset,
 coalesce(c.content, list_transform(range((SELECT count(*) FROM vocab) + 1), lambda i: CAST(0 AS DOUBLE))) AS content
FROM factors f JOIN serving_catalog s ON f.movieId = s.movieId LEFT JOIN content c ON f.movieId = c.movieId"""),
    ("rprof0", "SELECT * FROM profiles WHERE role <> 'seed' OR movieId IN (SELECT movieId FROM items)"),
    ("rprof", """
SELECT * FROM rprof0 WHERE profile_id IN (
 SELECT profile_id FROM rprof0 GROUP BY profile_id HAVING count(*) FILTER (WHERE role = 'seed') BETWEEN 1 AND 10)"""),
    ("pv_rows", "SELECT r.profile_id, r.role, i.content, i.factor FROM rprof r JOIN items i ON r.movieId = i.movieId"),
    ("pvec", """
SELECT profile_id, kind, list(v ORDER BY dim) AS vec FROM (
 SELECT profile_id, kind, dim, avg(val) AS v FROM (
  SELECT profile_id, 'cmean' AS kind, unnest(range(len(content))) AS dim, unnest(content) AS val FROM pv_rows WHERE role IN ('seed', 'like')
  UNION ALL SELECT profile_id, 'fmean', unnest(range(len(factor))), unnest(factor) FROM pv_rows WHERE role IN ('seed', 'like')
  UNION ALL SELECT profile_id, 'lmean', unnest(range(len(factor))), unnest(factor) FROM pv_rows WHERE role = 'like'
  UNION ALL SELECT profile_id, 'dmean', unnest(range(len(factor))), unnest(factor) FROM pv_rows WHERE role = 'dislike'
 ) u GROUP BY 1, 2, 3) g GROUP BY 1, 2"""),
    ("pv", """
SELECT profile_id, any_value(vec) FILTER (WHERE kind = 'cmean') AS cmean, any_value(vec) FILTER (WHERE kind = 'fmean') AS fmean,
 any_value(vec) FILTER (WHERE kind = 'lmean') AS lmean, any_value(vec) FILTER (WHERE kind = 'dmean') AS dmean
FROM pvec GROUP BY profile_id"""),
    ("pflags", """
SELECT profile_id, movieId, max(CASE WHEN role = 'like' THEN 1 ELSE 0 END) AS is_like,
 max(CASE WHEN role = 'dislike' THEN 1 ELSE 0 END) AS is_dislike, 1 AS excluded
FROM rprof GROUP BY profile_id, movieId"""),
    ("pairs", f"""
SELECT profile_id, movieId, c, cf, h,
 h - CASE WHEN is_dislike = 1 THEN 0.55 ELSE 0 END + CASE WHEN is_like = 1 THEN 0.18 ELSE 0 END
   + 0.15 * coalesce(lc, 0) - 0.15 * coalesce(dc, 0) AS score, excluded FROM (
 SELECT p.profile_id, i.movieId, {_cos('p.cmean', 'i.content')} AS c, {_cos('p.fmean', 'i.factor')} AS cf,
  0.6 * {_cos('p.cmean', 'i.content')} + 0.4 * {_cos('p.fmean', 'i.factor')} AS h,
  {_cos('p.lmean', 'i.factor')} AS lc, {_cos('p.dmean', 'i.factor')} AS dc, x.is_like, x.is_dislike, x.excluded
 FROM pv p CROSS JOIN items i LEFT JOIN pflags x ON x.profile_id = p.profile_id AND x.movieId = i.movieId) t"""),
    *_pool_views(300, 10),
    *_pool_views(240, 8),
    ("seedrows", f"""
SELECT r.profile_id, r.pos, c.title AS s_title, {gset('c.genres')} AS s_gset, c.release_year AS s_year,
 {_decade_sql('c.release_year')} AS s_decade
FROM rprof r JOIN serving_catalog c ON r.movieId = c.movieId WHERE r.role = 'seed'"""),
    ("high", "SELECT userId, movieId FROM split_rows WHERE rating >= 4.0"),
    ("fans", """
SELECT DISTINCT s.profile_id, h.userId FROM rprof s JOIN high h ON s.movieId = h.movieId WHERE s.role = 'seed'"""),
    ("cohort", """
SELECT * FROM (
 SELECT c.*, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY n_high DESC, movieId) AS INTEGER) AS cohort_rank FROM (
  SELECT f.profile_id, h.movieId, count(*) AS n_high FROM fans f JOIN high h ON f.userId = h.userId GROUP BY 1, 2) c
 WHERE NOT EXISTS (SELECT 1 FROM rprof s WHERE s.role = 'seed' AND s.profile_id = c.profile_id AND s.movieId = c.movieId)) t
WHERE cohort_rank <= 200"""),
    ("anchor", """
SELECT profile_id, s_title AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY pos) AS rn FROM seedrows) t
WHERE rn = 1"""),
    ("notes", """
SELECT c.profile_id, c.movieId, c.n_high, c.cohort_rank,
 concat('Highly rated by MovieLens users who also liked ', coalesce(a.anchor, 'your picks'), ' (', format('{:,}', c.n_high),
  ' high ratings)') AS note
FROM cohort c LEFT JOIN anchor a ON c.profile_id = a.profile_id"""),
    ("rec_info", f"""
SELECT r.*, c.title, c.genres, c.release_year, c.poster_url, {gset('c.genres')} AS rec_gset,
 {_decade_sql('c.release_year')} AS rec_decade
FROM recs10 r LEFT JOIN serving_catalog c ON r.movieId = c.movieId"""),
    ("best", """
SELECT * FROM (
 SELECT ri.*, coalesce(s.s_title, 'your picks') AS best_title, coalesce(s.s_gset, CAST([] AS VARCHAR[])) AS best_gset,
  row_number() OVER (PARTITION BY ri.profile_id, ri.movieId ORDER BY
   (len(list_intersect(s.s_gset, ri.rec_gset)) + CASE WHEN ri.rec_decade IS NOT NULL AND s.s_decade IS NOT NULL
     AND ri.rec_decade = s.s_decade THEN 0.5 ELSE 0 END) DESC NULLS LAST, s.pos) AS rn_best
 FROM rec_info ri LEFT JOIN seedrows s ON ri.profile_id = s.profile_id) t WHERE rn_best = 1"""),
    ("modal", """
SELECT profile_id, s_decade AS modal_decade FROM (
 SELECT profile_id, s_decade, row_number() OVER (PARTITION BY profile_id ORDER BY count(*) DESC, min(pos)) AS rn
 FROM seedrows WHERE s_decade IS NOT NULL GROUP BY profile_id, s_decade) t WHERE rn = 1"""),
    ("first2", """
SELECT profile_id, string_agg(s_title, ', ' ORDER BY pos) AS first_titles FROM (
 SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY pos) AS rn FROM seedrows) t WHERE rn <= 2 GROUP BY profile_id"""),
    ("expl0", f"""
SELECT b.*, m.modal_decade, f.first_titles, n.note,
 list_sort(list_intersect(b.best_gset, b.rec_gset))[1:4] AS shared, {_theme_sql('b.rec_gset')} AS theme,
 {_tags_sql('b.rec_gset')} AS tags
FROM best b LEFT JOIN modal m ON b.profile_id = m.profile_id LEFT JOIN first2 f ON b.profile_id = f.profile_id
LEFT JOIN notes n ON b.profile_id = n.profile_id AND b.movieId = n.movieId"""),
    ("expl", f"""
SELECT *, concat('Because you liked **', best_title, '**, ',
  CASE WHEN theme IS NOT NULL THEN concat('this shares **', theme, '**')
       WHEN len(shared) > 0 THEN concat('this shares **', lower(array_to_string(shared, ', ')), '** DNA')
       ELSE 'this fits your taste fingerprint' END, '.') AS headline,
 CASE WHEN len(b0) > 0 THEN b0 ELSE [concat('Recommended based on fit with ', coalesce(first_titles, ''))] END[1:5] AS bullets
FROM (SELECT *, list_filter([
  CASE WHEN len(shared) > 0 THEN concat('Genre overlap with *', best_title, '*: ', array_to_string(shared, ', ')) END,
  CASE WHEN rec_decade IS NOT NULL AND rec_decade = modal_decade THEN concat('Same era (', rec_decade, ') as several of your favorites') END,
  CASE WHEN content_score >= 0.4 THEN concat('Content match ', {_pct_sql('content_score')}, '% — similar genres, era, and metadata profile') END,
  CASE WHEN collaborative_score >= 0.4 THEN concat('HybridNet taste match ', {_pct_sql('collaborative_score')}, '% — users with your picks tend to rate this highly') END,
  note], lambda x: x IS NOT NULL) AS b0 FROM expl0) e"""),
    ("fr8", f"""
SELECT profile_id, CAST(pos AS INTEGER) AS pos, movieId, title, franchise, concat('More in the ', franchise, ' series') AS reason FROM (
 SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY franchise, release_year ASC NULLS LAST, movieId) AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY profile_id, movieId ORDER BY franchise) AS f1 FROM (
   SELECT pf.profile_id, m.movieId, m.title, m.release_year, m.franchise
   FROM (SELECT DISTINCT s.profile_id, {_franchise_case('c.title')} AS franchise
         FROM rprof s JOIN serving_catalog c ON s.movieId = c.movieId WHERE s.role = 'seed') pf
   JOIN franchise_members m ON pf.franchise = m.franchise
   WHERE NOT EXISTS (SELECT 1 FROM rprof s2 WHERE s2.role = 'seed' AND s2.profile_id = pf.profile_id AND s2.movieId = m.movieId)) a) b
 WHERE f1 = 1) c WHERE pos <= 8"""),
    ("fr_kept", """
SELECT * FROM fr8 f WHERE NOT EXISTS (
 SELECT 1 FROM rprof d WHERE d.role = 'dislike' AND d.profile_id = f.profile_id AND d.movieId = f.movieId)"""),
    ("disp", """
SELECT *, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, rank) AS INTEGER) AS display_rank FROM expl"""),
])


# ------------------------------------------------------------------ shared Spark pieces

def _items(spark, d):
    return job.items(spark, d)


def _ready(spark, d):
    it = _items(spark, d)
    return job.ready_profiles(spark, d, it.select("movieId")), it


def _ready_ids(spark, d):
    """Ready profiles when only the covered ids matter (no item vectors built)."""
    return job.ready_profiles(spark, d, job.item_ids(spark, d))


def _recs(spark, d):
    return job.recommend(spark, d, P10)


def _r6(c):
    return F.round(F.col(c), 6).alias(c)


# ------------------------------------------------------------------ §2.8

@query("validate_seeds", with_views("""
SELECT * FROM (
 SELECT profile_id, 'no_seeds' AS problem, CAST(NULL AS BIGINT) AS movieId FROM picks GROUP BY profile_id
  HAVING count(*) FILTER (WHERE role = 'seed') < 1
 UNION ALL SELECT profile_id, 'too_many_seeds', CAST(NULL AS BIGINT) FROM picks GROUP BY profile_id HAVING count(*) > 10
 UNION ALL SELECT profile_id, 'unknown_seed', movieId FROM picks WHERE movieId NOT IN (SELECT movieId FROM items)) v
WHERE profile_id IN (SELECT profile_id FROM picks)"""))
def validate_seeds(spark, d):
    return rc.validate_seeds(picks(spark, d), job.item_ids(spark, d))


def picks(spark, d):
    """Every user's distinct movies rated 5.0, in id order: a raw favourites list per user."""
    r = fx.ratings(spark, d).where(F.col("rating") >= 5.0).select(F.col("userId").alias("profile_id"), "movieId").distinct()
    w = Window.partitionBy("profile_id").orderBy("movieId")
    return r.withColumn("pos", F.row_number().over(w)).withColumn("role", F.lit("seed"))


EXTRA_VIEWS.append(("picks", """
SELECT profile_id, movieId, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY movieId) AS INTEGER) AS pos, 'seed' AS role
FROM (SELECT DISTINCT userId AS profile_id, movieId FROM ratings WHERE rating >= 5.0) t"""))


@query("profile_vectors", with_views("""
SELECT profile_id, kind, CAST(unnest(range(len(vec))) AS INTEGER) AS dim, round(unnest(vec), 6) AS value
FROM pvec WHERE kind IN ('cmean', 'fmean')"""))
def profile_vectors(spark, d):
    prof, it = _ready(spark, d)
    means = rc.profile_vectors(prof, it, {"content": "cmean", "factor": "fmean"})
    u = means.select("profile_id", F.expr("stack(2, 'cmean', cmean, 'fmean', fmean) AS (kind, vec)"))
    return u.select("profile_id", "kind", F.posexplode_outer("vec").alias("dim", "value")).select(
        "profile_id", "kind", "dim", F.round("value", 6).alias("value"))


def _stats_sql(col: str, kind: str) -> str:
    return with_views(f"""
SELECT profile_id, count(*) AS {kind}_n, round(sum({col}), 6) AS {kind}_sum, round(max({col}), 6) AS {kind}_max,
 min(movieId) FILTER (WHERE {col} >= mx - 1e-12) AS {kind}_argmax
FROM (SELECT *, max({col}) OVER (PARTITION BY profile_id) AS mx FROM pairs) t GROUP BY profile_id""")


def _stats(spark, d, kind):
    prof, it = _ready(spark, d)
    st = rc.similarity_stats(prof, it, P10, (kind,))
    return st.select("profile_id", f"{kind}_n", _r6(f"{kind}_sum"), _r6(f"{kind}_max"), f"{kind}_argmax")


@query("content_similarity", _stats_sql("c", "content"))
def content_similarity(spark, d):
    return _stats(spark, d, "content")


@query("collab_similarity", _stats_sql("cf", "collab"))
def collab_similarity(spark, d):
    return _stats(spark, d, "collab")


@query("hybrid_score", _stats_sql("h", "hybrid"))
def hybrid_score(spark, d):
    return _stats(spark, d, "hybrid")


@query("feedback_adjust", _stats_sql("score", "adjusted"))
def feedback_adjust(spark, d):
    return _stats(spark, d, "adjusted")


@query("candidate_pool", with_views("""
SELECT profile_id, pool_rank, movieId, round(score, 6) AS score FROM pool10"""))
def candidate_pool(spark, d):
    prof, it = _ready(spark, d)
    return rc.candidate_pool(prof, it, P10).select("profile_id", F.col("pool_rank").cast("int"), "movieId", _r6("score"))


@query("genre_overlap", with_views("""
SELECT r.profile_id, r.movieId, round(max(CASE WHEN len(i.gset) = 0 OR len(s.s_gset) = 0 THEN 0.0
  ELSE len(list_intersect(i.gset, s.s_gset)) / greatest(len(list_distinct(list_concat(i.gset, s.s_gset))), 1) END), 6) AS overlap
FROM recs10 r JOIN items i ON r.movieId = i.movieId JOIN rprof p ON p.profile_id = r.profile_id AND p.role = 'seed'
JOIN (SELECT r2.profile_id, r2.movieId, coalesce(i2.gset, CAST([] AS VARCHAR[])) AS s_gset FROM rprof r2
      LEFT JOIN items i2 ON r2.movieId = i2.movieId WHERE r2.role = 'seed') s ON s.profile_id = p.profile_id AND s.movieId = p.movieId
GROUP BY r.profile_id, r.movieId"""))
def genre_overlap(spark, d):
    recs, prof, it = job.core(spark, d, P10)
    cand = recs.join(it.select("movieId", "genre_set"), "movieId")
    seeds = (prof.where(F.col("role") == "seed").join(it.select("movieId", "genre_set"), "movieId", "left")
             .select("profile_id", F.coalesce("genre_set", F.array().cast("array<string>")).alias("genre_set")))
    return rc.genre_overlap(cand, seeds).select("profile_id", "movieId", _r6("overlap"))


def _greedy_sql(k: int) -> str:
    """The greedy rerank in SQL: pools, genre sets (as bits) and penalties as lists, one row per
    profile, and one pick per level of a recursive query."""
    return f"""
SELECT profile_id, CAST(pick AS INTEGER) AS rank, movies[chosen] AS movieId, round(scores[chosen], 6) AS score,
 CAST(ranks[chosen] AS INTEGER) AS pool_rank
FROM (
 WITH RECURSIVE genre_list AS MATERIALIZED (SELECT list(g ORDER BY g) AS names FROM (SELECT DISTINCT unnest(gset) AS g FROM items) t),
 bits AS MATERIALIZED (
  SELECT movieId, list_sum(list_transform(gset, lambda g: CAST(1 AS BIGINT) << (list_position(names, g) - 1))) AS b
  FROM items, genre_list),
 of_seeds AS MATERIALIZED (
  SELECT r.profile_id, list(CAST(coalesce(b, 0) AS BIGINT)) AS seeds FROM rprof r LEFT JOIN bits USING (movieId)
  WHERE r.role = 'seed' GROUP BY r.profile_id),
 pools AS MATERIALIZED (
  SELECT profile_id, list(movieId ORDER BY pool_rank) AS movies, list(score ORDER BY pool_rank) AS scores,
   list(pool_rank ORDER BY pool_rank) AS ranks, list(CAST(coalesce(b, 0) AS BIGINT) ORDER BY pool_rank) AS sets
  FROM pool{k} JOIN bits USING (movieId) GROUP BY profile_id),
 step AS (
  SELECT profile_id, movies, scores, ranks, sets, 0 AS pick, CAST(0 AS BIGINT) AS chosen, CAST([] AS BIGINT[]) AS picked,
   list_transform(sets, lambda x: list_max(list_transform(seeds, lambda y:
     CASE WHEN x = 0 OR y = 0 THEN CAST(0 AS DOUBLE) ELSE bit_count(x & y) / bit_count(x | y) END))) AS pen
  FROM pools JOIN of_seeds USING (profile_id)
  UNION ALL
  SELECT profile_id, movies, scores, ranks, sets, pick + 1, best, list_append(picked, best),
   list_transform(range(1, len(sets) + 1), lambda i: greatest(pen[i], CASE WHEN sets[i] = 0 OR sets[best] = 0 THEN CAST(0 AS DOUBLE)
     ELSE bit_count(sets[i] & sets[best]) / bit_count(sets[i] | sets[best]) END))
  FROM (SELECT *, list_position(adjusted, list_max(adjusted)) AS best FROM (
   SELECT *, list_transform(range(1, len(sets) + 1), lambda i: CASE WHEN list_contains(picked, i) THEN CAST('-infinity' AS DOUBLE)
     ELSE CAST(0.65 AS DOUBLE) * scores[i] - CAST(0.35 AS DOUBLE) * CAST(0.35 AS DOUBLE) * pen[i] END) AS adjusted FROM step
   WHERE pick < {k} AND pick < len(sets)) a) c)
 SELECT * FROM step WHERE pick > 0) t"""


@query("diversity_rerank", with_views(_greedy_sql(10)))
def diversity_rerank(spark, d):
    recs, _, _ = job.core(spark, d, rc.RecParams(top_k=10, diversity=0.35))
    return recs.select("profile_id", F.col("rank").cast("int").alias("rank"), "movieId", _r6("score"),
                       F.col("pool_rank").cast("int").alias("pool_rank"))


EXTRA_VIEWS.extend(_pool_views(100, 3))


@query("diversity_rerank_k3", with_views(f"SELECT profile_id, rank, movieId FROM ({_greedy_sql(3).strip()}) g"))
def diversity_rerank_k3(spark, d):
    """The greedy diverse rerank with k = 3 (d = 0.35)."""
    recs, _, _ = job.core(spark, d, rc.RecParams(top_k=3, diversity=0.35))
    return recs.select("profile_id", F.col("rank").cast("int").alias("rank"), "movieId")


FLAT = ("SELECT profile_id, CAST(rank AS INTEGER) AS rank, display_rank, movieId, title, genres, release_year, poster_url, "
        "round(score, 6) AS score, round(content_score, 6) AS content_score, "
        "round(collaborative_score, 6) AS collaborative_score, headline, array_to_string(bullets, ' || ') AS explanations, "
        "array_to_string(tags, ' || ') AS theme_tags FROM disp")


def recommend_flat(spark, d):
    r = _recs(spark, d)
    return r.select("profile_id", F.col("rank").cast("int").alias("rank"), F.col("display_rank").cast("int"),
                    "movieId", "title", "genres", "release_year", "poster_url", _r6("score"), _r6("content_score"),
                    _r6("collaborative_score"), "headline",
                    F.array_join("explanations", " || ").alias("explanations"),
                    F.array_join("theme_tags", " || ").alias("theme_tags"))


@query("recommend", with_views(FLAT))
def recommend(spark, d):
    return recommend_flat(spark, d)


@query("display_order", with_views("SELECT profile_id, CAST(rank AS INTEGER) AS rank, display_rank, movieId FROM disp"))
def display_order(spark, d):
    recs, _, _ = job.core(spark, d, P10)
    return rc.display_order(recs).select("profile_id", F.col("rank").cast("int"), F.col("display_rank").cast("int"), "movieId")


@query("match_percent", with_views(f"""
SELECT profile_id, movieId, round(greatest(0.0, least(1.0, score)), 6) AS match_clipped,
 concat({_pct_sql('score')}, '%') AS match_text,
 CASE WHEN greatest(0.0, least(1.0, score)) >= 0.85 THEN 'Very strong fit' WHEN greatest(0.0, least(1.0, score)) >= 0.70 THEN 'Good fit'
      WHEN greatest(0.0, least(1.0, score)) >= 0.50 THEN 'Moderate fit' ELSE 'Weaker fit' END AS band
FROM recs10"""))
def match_percent(spark, d):
    recs, _, _ = job.core(spark, d, P10)
    clipped, text, band = rc.match_percent("score")
    return recs.select("profile_id", "movieId", F.round(clipped, 6).alias("match_clipped"), text.alias("match_text"),
                       band.alias("band"))


@query("fan_users", with_views("SELECT profile_id, userId FROM fans"))
def fan_users(spark, d):
    prof = _ready_ids(spark, d)
    return ex.fan_users(ds.split_rows(spark, d), prof)


@query("cohort_counts", with_views("SELECT profile_id, movieId, n_high, cohort_rank, note FROM notes"))
def cohort_counts(spark, d):
    prof = _ready_ids(spark, d)
    return ex.noted_cohorts(ds.split_rows(spark, d), prof, ds.serving(spark, d)).select(
        "profile_id", "movieId", "n_high", F.col("cohort_rank").cast("int"), "note")


@query("pick_suggestions", with_views("""
SELECT profile_id, CAST(pos AS INTEGER) AS pos, u.movieId, c.title, reason FROM (
 SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY src, o) AS pos FROM (
  SELECT profile_id, movieId, 0 AS src, pos AS o, reason FROM fr_kept
  UNION ALL
  SELECT r.profile_id, r.movieId, 1, r.rank, 'Similar to your picks (HybridNet)' FROM recs8 r
  WHERE NOT EXISTS (SELECT 1 FROM rprof s WHERE s.role = 'seed' AND s.profile_id = r.profile_id AND s.movieId = r.movieId)
    AND NOT EXISTS (SELECT 1 FROM fr_kept f WHERE f.profile_id = r.profile_id AND f.movieId = r.movieId)) a) u
LEFT JOIN serving_catalog c ON u.movieId = c.movieId WHERE pos <= 8"""))
def pick_suggestions(spark, d):
    return job.pick_suggestions(spark, d)


# ------------------------------------------------------------------ §2.9

@query("decade_label", with_views(f"SELECT movieId, {_decade_sql('release_year')} AS decade FROM serving_catalog"))
def decade_label(spark, d):
    return ds.serving(spark, d).select("movieId", _decade_label("release_year").alias("decade"))


@query("theme_phrase", with_views(f"SELECT movieId, {_theme_sql('g')} AS theme FROM (SELECT movieId, {GSET} AS g FROM serving_catalog) t"))
def theme_phrase(spark, d):
    return ds.serving(spark, d).select("movieId", ex.theme_phrase(genre_set("genres")).alias("theme"))


@query("theme_tags", with_views(f"""
SELECT movieId, array_to_string({_tags_sql('g')}, ' || ') AS theme_tags FROM (SELECT movieId, {GSET} AS g FROM serving_catalog) t"""))
def theme_tags(spark, d):
    return ds.serving(spark, d).select("movieId", F.array_join(ex.theme_tags(genre_set("genres")), " || ").alias("theme_tags"))


@query("best_seed", with_views("SELECT profile_id, movieId, best_title FROM best"))
def best_seed(spark, d):
    recs, prof, _ = job.core(spark, d, P10)
    catalog = ds.serving(spark, d)
    seeds = ex.seed_rows(prof, catalog)
    r = (recs.join(catalog.select("movieId", "genres", "release_year"), "movieId", "left")
         .withColumn("rec_gset", genre_set("genres")).withColumn("rec_decade", _decade_label("release_year")))
    return ex.best_seed(r, seeds).select("profile_id", "movieId", "best_title")


@query("headline", with_views("SELECT profile_id, movieId, headline FROM expl"))
def headline(spark, d):
    return _recs(spark, d).select("profile_id", "movieId", "headline")


@query("bullets", with_views("SELECT profile_id, movieId, array_to_string(bullets, ' || ') AS explanations FROM expl"))
def bullets(spark, d):
    return _recs(spark, d).select("profile_id", "movieId", F.array_join("explanations", " || ").alias("explanations"))


@query("explain", with_views("""
SELECT profile_id, movieId, headline, array_to_string(bullets, ' || ') AS explanations,
 array_to_string(tags, ' || ') AS theme_tags FROM expl"""))
def explain(spark, d):
    return _recs(spark, d).select("profile_id", "movieId", "headline",
                                  F.array_join("explanations", " || ").alias("explanations"),
                                  F.array_join("theme_tags", " || ").alias("theme_tags"))
