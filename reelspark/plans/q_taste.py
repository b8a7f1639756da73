"""Queries for §2.10 (taste profile) and §2.11 (feedback state)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import feedback as fb
from ..operators import taste as ta
from ..sources import fixtures as fx
from . import datasets as ds
from .oracle_views import EXTRA_VIEWS, with_views
from .q_features import GLIST
from .q_recommend import _decade_sql, gset
from .registry import query


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _persona_sql(g: str) -> tuple[str, str, str]:
    quals = [f"(CASE WHEN len(list_intersect({g}, {list(genres)})) >= {mn} THEN len(list_intersect({g}, {list(genres)})) ELSE 0 END)"
             for _, _, genres, mn, _ in R.PERSONA_RULES]
    best = f"greatest({', '.join(quals)})"
    out = []
    for field, dflt in ((0, R.DEFAULT_PERSONA[0]), (1, R.DEFAULT_PERSONA[1]), (4, R.DEFAULT_PERSONA[2])):
        arms = " ".join(f"WHEN {best} > 0 AND {q} = {best} THEN {_q(rule[field])}" for q, rule in zip(quals, R.PERSONA_RULES))
        out.append(f"(CASE {arms} ELSE {_q(dflt)} END)")
    return out[0], out[1], out[2]


def _style_sql(g: str) -> str:
    arms = " ".join(f"WHEN list_has_all({g}, {list(n)}) THEN {_q(lbl)}" for n, lbl in R.STYLE_RULES)
    return f"(CASE {arms} ELSE {_q(R.DEFAULT_STYLE)} END)"


def _themes_sql(g: str) -> str:
    arms = ", ".join(f"CASE WHEN list_has_all({g}, {list(n)}) THEN {_q(t)} END" for n, t in R.THEME_TAGS)
    tags = f"list_filter([{arms}], lambda x: x IS NOT NULL)[1:3]"
    return f"(CASE WHEN len({tags}) > 0 THEN array_to_string({tags}, ' || ') ELSE {_q(R.DEFAULT_THEME)} END)"


EXTRA_VIEWS.extend([
    ("sel", """
SELECT s.profile_id, s.pos, c.genres, c.release_year FROM seeds s JOIN serving_catalog c ON s.movieId = c.movieId"""),
    ("sel_g", f"SELECT profile_id, pos, {GLIST} AS glist, {gset('genres')} AS gset, release_year FROM sel"),
    ("gsum", """
SELECT profile_id, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY n DESC, first) AS INTEGER) AS rank, genre, n FROM (
 SELECT profile_id, genre, count(*) AS n, min(pos * 1000 + gi) AS first FROM (
  SELECT profile_id, pos, unnest(glist) AS genre, unnest(range(len(glist))) AS gi FROM sel_g) u GROUP BY 1, 2) c"""),
    ("dsum", f"""
SELECT profile_id, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY n DESC, first) AS INTEGER) AS rank, decade, n FROM (
 SELECT profile_id, decade, count(*) AS n, min(pos) AS first FROM (
  SELECT profile_id, pos, {_decade_sql('release_year')} AS decade FROM sel) u WHERE decade IS NOT NULL GROUP BY 1, 2) c"""),
    ("allg", "SELECT profile_id, list_distinct(flatten(list(gset))) AS g FROM sel_g GROUP BY profile_id"),
    ("mix", """
SELECT profile_id, CAST(rank AS INTEGER) AS rank, genre, CAST(round_even(n * 100 / total, 0) AS INTEGER) AS pct FROM (
 SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY n DESC, genre) AS rank FROM (
  SELECT profile_id, genre, count(*) AS n, sum(count(*)) OVER (PARTITION BY profile_id) AS total FROM (
   SELECT profile_id, unnest(gset) AS genre FROM sel_g) u GROUP BY 1, 2) c) r WHERE rank <= 6"""),
    ("era_v", """
SELECT s.profile_id, CASE WHEN y0 IS NULL THEN 'Mixed eras'
  WHEN y1 - y0 <= 12 THEN concat(CAST(y0 AS VARCHAR), '–', CAST(y1 AS VARCHAR))
  WHEN d.decade IS NOT NULL THEN concat(d.decade, ' (peak)') ELSE 'Mixed eras' END AS era
FROM (SELECT profile_id, min(release_year) AS y0, max(release_year) AS y1 FROM sel GROUP BY profile_id) s
LEFT JOIN (SELECT profile_id, decade FROM dsum WHERE rank = 1) d ON s.profile_id = d.profile_id"""),
    ("dna", f"""
SELECT a.profile_id,
 coalesce((SELECT string_agg(concat(genre, ' ', CAST(pct AS VARCHAR), '%'), ', ' ORDER BY rank) FROM mix m WHERE m.profile_id = a.profile_id), '') AS genre_pct,
 coalesce((SELECT genre FROM mix m WHERE m.profile_id = a.profile_id AND rank = 1), 'Mixed') AS primary_genre,
 coalesce((SELECT pct FROM mix m WHERE m.profile_id = a.profile_id AND rank = 1), 0) AS primary_pct,
 (SELECT genre FROM mix m WHERE m.profile_id = a.profile_id AND rank = 2) AS secondary_genre,
 (SELECT pct FROM mix m WHERE m.profile_id = a.profile_id AND rank = 2) AS secondary_pct,
 {_style_sql('a.g')} AS style, e.era, {_themes_sql('a.g')} AS themes
FROM allg a LEFT JOIN era_v e ON a.profile_id = e.profile_id"""),
])


def selected(spark, d):
    """Catalog rows of each profile's picks, in pick order (at most ten per profile)."""
    s = fx.seed_profiles(spark, d).select("profile_id", "movieId", "pos")
    return s.join(ds.serving(spark, d).select("movieId", "genres", "release_year"), "movieId")


@query("genre_summary", with_views("SELECT profile_id, rank, genre, n FROM gsum WHERE rank <= 6"))
def genre_summary(spark, d):
    return ta.genre_summary(selected(spark, d), 6).select("profile_id", F.col("rank").cast("int"), "genre", "n")


@query("decade_summary", with_views("SELECT profile_id, rank, decade, n FROM dsum WHERE rank <= 4"))
def decade_summary(spark, d):
    return ta.decade_summary(selected(spark, d), 4).select("profile_id", F.col("rank").cast("int"), "decade", "n")


@query("profile_stats", with_views("""
SELECT c.profile_id,
 coalesce((SELECT string_agg(concat(genre, ':', CAST(n AS VARCHAR)), ', ' ORDER BY rank) FROM gsum g WHERE g.profile_id = c.profile_id AND rank <= 6), '') AS top_genres,
 coalesce((SELECT string_agg(concat(decade, ':', CAST(n AS VARCHAR)), ', ' ORDER BY rank) FROM dsum x WHERE x.profile_id = c.profile_id AND rank <= 4), '') AS top_decades,
 c.count
FROM (SELECT profile_id, count(*) AS count FROM sel GROUP BY profile_id) c"""))
def profile_stats(spark, d):
    return ta.profile_stats(selected(spark, d))


_P = _persona_sql("g")


@query("persona", with_views(f"SELECT profile_id, {_P[0]} AS title, {_P[1]} AS emoji, {_P[2]} AS blurb FROM allg"))
def persona(spark, d):
    return ta.persona(selected(spark, d))


@query("genre_mix", with_views("SELECT profile_id, rank, genre, pct FROM mix"))
def genre_mix(spark, d):
    return ta.genre_mix(selected(spark, d)).select("profile_id", F.col("rank").cast("int"), "genre", "pct")


@query("style", with_views(f"SELECT profile_id, {_style_sql('g')} AS style FROM allg"))
def style(spark, d):
    return ta.all_genres(selected(spark, d)).select("profile_id", ta.style_expr(F.col("genres_all")).alias("style"))


@query("era", with_views("SELECT profile_id, era FROM era_v"))
def era(spark, d):
    return ta.era(selected(spark, d))


@query("dna_themes", with_views(f"SELECT profile_id, {_themes_sql('g')} AS themes FROM allg"))
def dna_themes(spark, d):
    return ta.all_genres(selected(spark, d)).select(
        "profile_id", F.array_join(ta.dna_themes_expr(F.col("genres_all")), " || ").alias("themes"))


@query("taste_dna", with_views("SELECT * FROM dna"))
def taste_dna(spark, d):
    return ta.taste_dna(selected(spark, d))


@query("taste_summary", with_views(f"""
SELECT a.profile_id, concat('As **', {_P[1]}, ' ', {_P[0]}, '**, you lean toward ',
  concat(n.primary_genre, ' (', CAST(n.primary_pct AS VARCHAR), '%)',
   CASE WHEN n.secondary_genre IS NOT NULL THEN concat(', with a strong ', n.secondary_genre, ' streak (',
     CAST(n.secondary_pct AS VARCHAR), '%)') ELSE '' END),
  '. Your style reads as **', n.style, '**, especially from the ',
  coalesce((SELECT string_agg(decade, ', ' ORDER BY rank) FROM dsum x WHERE x.profile_id = a.profile_id AND rank <= 2), 'many eras'),
  ', with ',
  coalesce((SELECT string_agg(genre, ', ' ORDER BY rank) FROM gsum g2 WHERE g2.profile_id = a.profile_id AND rank <= 4), 'varied genres'),
  ' showing up most often.') AS summary
FROM allg a JOIN dna n ON a.profile_id = n.profile_id"""))
def taste_summary(spark, d):
    return ta.taste_summary(selected(spark, d))


# ------------------------------------------------------------------ §2.11 feedback (batch forms)

@query("feedback_state", with_views("SELECT session_id, movieId, vote FROM fb_state"))
def feedback_state(spark, d):
    return fb.feedback_state(fx.feedback_events(spark, d))


@query("liked_disliked", with_views("""
SELECT session_id, array_to_string(list_sort(list(movieId) FILTER (WHERE vote > 0)), ',') AS liked,
 array_to_string(list_sort(list(movieId) FILTER (WHERE vote < 0)), ',') AS disliked
FROM fb_state GROUP BY session_id"""))
def liked_disliked(spark, d):
    ld = fb.liked_disliked(fb.feedback_state(fx.feedback_events(spark, d)))
    return ld.select("session_id", F.array_join("liked", ",").alias("liked"), F.array_join("disliked", ",").alias("disliked"))


@query("feedback_counts", with_views("""
SELECT session_id, count(*) FILTER (WHERE vote > 0) AS n_liked, count(*) FILTER (WHERE vote < 0) AS n_disliked
FROM fb_state GROUP BY session_id"""))
def feedback_counts(spark, d):
    return fb.feedback_counts(fb.feedback_state(fx.feedback_events(spark, d)))


@query("feedback_snapshot", with_views("""
SELECT session_id, string_agg(concat(CAST(movieId AS VARCHAR), ':', CAST(vote AS VARCHAR)), ',' ORDER BY movieId, vote) AS snapshot
FROM fb_state GROUP BY session_id"""))
def feedback_snapshot(spark, d):
    return fb.feedback_snapshot(fb.feedback_state(fx.feedback_events(spark, d)))


EXTRA_VIEWS.extend([
    ("fav_ordered", """
SELECT session_id, movieId, action, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS i
FROM fav_events WHERE movieId IS NOT NULL OR action = 'clear'"""),
    ("fav_fold", """
SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS ids FROM fav_ordered
UNION ALL
SELECT f.session_id, e.i, CASE
  WHEN e.action = 'clear' THEN CAST([] AS BIGINT[])
  WHEN e.action = 'remove' THEN list_filter(f.ids, lambda x: x <> e.movieId)
  WHEN len(f.ids) < 10 AND NOT list_contains(f.ids, e.movieId) THEN list_append(f.ids, e.movieId)
  ELSE f.ids END
FROM fav_fold f JOIN fav_ordered e ON e.session_id = f.session_id AND e.i = f.i + 1"""),
])


@query("favourites_state", with_views("""
SELECT session_id, CAST(generate_subscripts(ids, 1) AS INTEGER) AS slot, unnest(ids) AS movieId
FROM (SELECT session_id, arg_max(ids, i) AS ids FROM fav_fold GROUP BY session_id) last"""))
def favourites_state(spark, d):
    return fb.favourites_state(fx.favourite_events(spark, d)).select("session_id", F.col("slot").cast("int"), "movieId")


KEEP_MS = 3650 * 24 * 3600 * 1000


@query("feedback_state_stream", with_views("SELECT session_id, movieId, vote FROM fb_state"))
def feedback_state_stream(spark, d):
    """The same final state, computed by the streaming operator over four time-ordered
    micro-batches of the feedback events (state carried across batches)."""
    from ..session import scratch_path
    from ..streaming.state import feedback_state_stream as stream_op
    from ..streaming.state import run_in_chunks

    ev = fx.feedback_events(spark, d)
    # state outlives the events of the table, as in the batch fold
    op = lambda events: stream_op(events, timeout_ms=KEEP_MS)
    final = run_in_chunks(spark, ev, ev.schema, op, ["session_id", "movieId"],
                          scratch_path(spark, "fb_src"), scratch_path(spark, "fb_sink"), scratch_path(spark, "fb_ckpt"))
    return final.where(F.col("vote") != 0).select("session_id", "movieId", "vote")
