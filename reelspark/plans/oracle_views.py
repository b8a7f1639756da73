"""The FIXTURES.md views written in DuckDB SQL, as CTEs for the oracle queries.

They are an independent second derivation of the same inputs (the Spark side builds them
with the DataFrame API in ``sources.fixtures``).
"""

from __future__ import annotations

GENRES_CSV = "Action,Adventure,Thriller,Mystery,Crime,Sci-Fi,Fantasy,Drama,Romance,War,Horror,Comedy,Family"

VIEWS: list[tuple[str, str]] = [
    ("movies", f"""
SELECT movieId, title_year,
 concat(CASE movieId % 50 WHEN 7 THEN 'Star Wars ' WHEN 11 THEN 'Harry Potter ' WHEN 13 THEN 'Mission: Impossible '
   WHEN 17 THEN 'Avengers ' WHEN 19 THEN 'Skyfall ' WHEN 23 THEN 'The Hobbit ' ELSE '' END, p_name, ' ', CAST(movieId AS VARCHAR),
   CASE WHEN movieId % 29 = 0 THEN '' ELSE concat(' (', CAST(title_year AS VARCHAR), ')') END) AS title,
 CASE WHEN movieId % 97 = 5 THEN NULL WHEN p_size % 10 = 0 THEN '(no genres listed)'
   ELSE concat(g1, CASE WHEN g2 <> g1 THEN concat('|', g2) ELSE '' END,
     CASE WHEN g3 <> g1 AND g3 <> g2 THEN concat('|', g3) ELSE '' END) END AS genres,
 p_brand AS director,
 CASE WHEN movieId % 37 = 0 THEN NULL ELSE title_year END AS release_year,
 CASE movieId % 11 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('https://img.example/', CAST(movieId AS VARCHAR), '.jpg') END AS poster_url,
 CASE WHEN movieId % 23 = 0 THEN 'not_found' WHEN movieId % 31 = 0 THEN 'error' ELSE 'ok' END AS fetch_status
FROM (SELECT CAST(p_partkey AS BIGINT) AS movieId, p_name, p_brand, p_size,
   CAST(1930 + (p_partkey * 7 + p_size) % 97 AS INTEGER) AS title_year,
   split_part('{GENRES_CSV}', ',', CAST(p_partkey % 13 + 1 AS INTEGER)) AS g1,
   split_part('{GENRES_CSV}', ',', CAST(p_size % 13 + 1 AS INTEGER)) AS g2,
   split_part('{GENRES_CSV}', ',', CAST((p_partkey + p_size * 3) % 13 + 1 AS INTEGER)) AS g3
  FROM part) t"""),
    ("ratings", """
SELECT o_custkey AS userId, l_partkey AS movieId,
 CAST(((CAST(l_quantity AS INTEGER) - 1) % 10) * 0.5 + 0.5 AS DOUBLE) AS rating,
 CAST(epoch(l_shipdate) AS BIGINT) AS "timestamp", l_orderkey, l_linenumber
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    ("feedback", """
SELECT event_id, ts, user_id AS session_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS movieId,
 CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE -1 END AS vote
FROM events WHERE event_type IN ('click', 'purchase', 'error')"""),
    ("fav_events", """
SELECT event_id, ts, user_id AS session_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS movieId,
 CASE WHEN event_type = 'view' THEN 'add' WHEN event_type = 'error' THEN 'remove' ELSE 'clear' END AS action
FROM events WHERE event_type IN ('view', 'error', 'signup')"""),
    ("links", """
SELECT movieId, CASE WHEN movieId % 41 = 0 THEN NULL ELSE movieId + 100000 END AS tmdbId, 2 * movieId AS link_pos FROM movies
UNION ALL
SELECT movieId, movieId + 50 AS tmdbId, 2 * movieId + 1 AS link_pos FROM movies WHERE movieId % 7 = 0"""),
    ("payload", """
SELECT tmdbId, CASE WHEN tmdbId % 46 = 100009 % 46 THEN 'upstream timeout' WHEN tmdbId % 46 = 100018 % 46 THEN substr(body, 1, 40)
 ELSE body END AS payload FROM (
SELECT movieId + 100000 AS tmdbId, concat('{"overview":"Plot ', CAST(movieId AS VARCHAR), '","poster_path":"',
 CASE WHEN movieId % 11 < 2 THEN '' ELSE concat('/', CAST(movieId AS VARCHAR), '.jpg') END,
 '","release_date":"', CASE WHEN movieId % 37 = 0 THEN '' ELSE concat(CAST(title_year AS VARCHAR), '-06-01') END,
 '","credits":{"cast":[',
 concat('{"name":"Actor ', CAST((movieId + 0) % 200 AS VARCHAR), '"}'), ',',
 concat('{"name":"Actor ', CAST((movieId + 31) % 200 AS VARCHAR), '"}'), ',',
 '{"name":""}', ',',
 concat('{"name":"Actor ', CAST((movieId + 93) % 200 AS VARCHAR), '"}'), ',',
 concat('{"name":"Actor ', CAST((movieId + 124) % 200 AS VARCHAR), '"}'), ',',
 concat('{"name":"Actor ', CAST((movieId + 155) % 200 AS VARCHAR), '"}'), ',',
 concat('{"name":"Actor ', CAST((movieId + 186) % 200 AS VARCHAR), '"}'),
 '],"crew":[{"job":"Writer","name":"W"}',
 CASE WHEN movieId % 19 = 0 THEN '' ELSE concat(',{"job":"Director","name":"', director, '"}') END, ']}}') AS body
FROM movies WHERE movieId % 23 <> 0) b"""),
    ("metadata", """
SELECT m.movieId, l.tmdbId, concat('Plot ', CAST(m.movieId AS VARCHAR)) AS overview,
 concat('Actor ', CAST(m.movieId % 200 AS VARCHAR), ', Actor ', CAST((m.movieId + 31) % 200 AS VARCHAR)) AS "cast",
 director, release_year,
 CASE WHEN poster_url IS NULL OR poster_url = '' THEN '' ELSE concat('/', CAST(m.movieId AS VARCHAR), '.jpg') END AS poster_path,
 poster_url, fetch_status,
 CASE fetch_status WHEN 'error' THEN 'timeout' WHEN 'not_found' THEN 'Movie not found on TMDb' ELSE '' END AS fetch_error
FROM movies m JOIN links l ON m.movieId = l.movieId WHERE l.link_pos % 2 = 0"""),
    ("metadata_cache", "SELECT * FROM metadata WHERE movieId % 3 = 0"),
    ("factors", "SELECT vec_id AS movieId, CAST(embedding AS DOUBLE[]) AS factor FROM embeddings"),
    ("catalog", """
SELECT m.movieId, m.title, m.genres, md.tmdbId, md.director, md."cast", md.release_year, md.poster_url, md.overview
FROM movies m JOIN metadata md ON m.movieId = md.movieId WHERE md.fetch_status = 'ok'"""),
    # time cutoffs over all ratings (quantile_cont interpolates like pandas)
    ("cutoffs", """
SELECT quantile_cont("timestamp", 0.7) AS c1, quantile_cont("timestamp", 0.8) AS c2 FROM ratings"""),
    ("split_rows", """
SELECT r.userId, r.movieId, r.rating, r."timestamp", r.l_orderkey, r.l_linenumber,
 CASE WHEN r."timestamp" < c.c1 THEN 'train' WHEN r."timestamp" < c.c2 THEN 'val' ELSE 'test' END AS split,
 k.title, k.genres, k.tmdbId, k.director, k."cast", k.release_year, k.poster_url
FROM ratings r CROSS JOIN cutoffs c JOIN catalog k ON r.movieId = k.movieId"""),
    ("raw_rows", """
SELECT r.userId, r.movieId, r.rating, r."timestamp", r.l_orderkey, r.l_linenumber,
 k.title, k.genres, k.tmdbId, k.director, k."cast", k.release_year, k.poster_url
FROM ratings r LEFT JOIN catalog k ON r.movieId = k.movieId"""),
    ("serving", """
SELECT movieId, any_value(title) AS title, any_value(genres) AS genres, any_value(director) AS director,
 any_value("cast") AS "cast", any_value(release_year) AS release_year, any_value(poster_url) AS poster_url,
 CAST(count(*) AS INTEGER) AS rating_count
FROM split_rows GROUP BY movieId"""),
    ("serving_catalog", """
SELECT s.movieId, s.title, s.genres, s.director, s."cast", s.release_year, s.poster_url, o.overview,
 lower(concat_ws(' ', coalesce(s.title, ''), coalesce(s.genres, ''), coalesce(s.director, ''))) AS search_text,
 s.rating_count
FROM serving s LEFT JOIN (SELECT movieId, overview FROM metadata WHERE fetch_status = 'ok') o ON s.movieId = o.movieId"""),
    # seeds: every user; one row per (user, movie) (latest wins); top ten model movies by rating
    ("seeds", """
SELECT profile_id, movieId, CAST(pos AS INTEGER) AS pos, 'seed' AS role FROM (
 SELECT userId AS profile_id, movieId, row_number() OVER (PARTITION BY userId ORDER BY rating DESC, "timestamp", movieId) AS pos FROM (
  SELECT r.*, row_number() OVER (PARTITION BY r.userId, r.movieId ORDER BY "timestamp" DESC, l_orderkey DESC, l_linenumber DESC) AS rn
  FROM ratings r JOIN movies m ON r.movieId = m.movieId WHERE m.genres IS NOT NULL AND m.release_year IS NOT NULL) x
 WHERE rn = 1 AND movieId IN (SELECT movieId FROM factors)) y WHERE pos <= 10"""),
    # final feedback state: fold of toggles = last vote when its trailing run is odd
    ("fb_runs", """
SELECT session_id, movieId, vote, ts, event_id,
 sum(CASE WHEN prev IS NULL OR prev <> vote THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, movieId ORDER BY ts, event_id
   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_id
FROM (SELECT *, lag(vote) OVER (PARTITION BY session_id, movieId ORDER BY ts, event_id) AS prev FROM feedback) f"""),
    ("fb_state", """
SELECT session_id, movieId, CAST(vote AS INTEGER) AS vote FROM (
 SELECT session_id, movieId, run_id, any_value(vote) AS vote, count(*) AS len,
  max(run_id) OVER (PARTITION BY session_id, movieId) AS last_run
 FROM fb_runs GROUP BY session_id, movieId, run_id) t
WHERE run_id = last_run AND len % 2 = 1"""),
    ("profiles", """
SELECT * FROM seeds
UNION ALL
SELECT session_id AS profile_id, movieId, 0 AS pos, CASE WHEN vote > 0 THEN 'like' ELSE 'dislike' END AS role
FROM fb_state WHERE session_id IN (SELECT profile_id FROM seeds)"""),
]


MARKER = "--@views\n"


def with_views(body: str) -> str:
    """Mark a query body for the fixture CTEs; ``expand`` adds them once all views exist."""
    return MARKER + body.strip()


def expand(sql: str) -> str:
    """Prefix a marked query with the views it references (and theirs, transitively)."""
    import re

    if not sql.startswith(MARKER):
        return sql
    body = sql[len(MARKER):]
    views = VIEWS + EXTRA_VIEWS
    names = [n for n, _ in views]
    sqls = dict(views)

    def refs(text: str) -> set[str]:
        return {n for n in names if re.search(rf"\b{re.escape(n)}\b", text)}

    need: set[str] = set()
    todo = list(refs(body))
    while todo:
        n = todo.pop()
        if n in need:
            continue
        need.add(n)
        todo.extend(refs(sqls[n]) - need - {n})
    ctes = ",\n".join(f"{n} AS ({sqls[n].strip()})" for n in names if n in need)
    return f"WITH RECURSIVE {ctes}\n{body}" if ctes else body


# Views for derived concepts (content vectors, scores, ...) added by the query modules.
EXTRA_VIEWS: list[tuple[str, str]] = []
