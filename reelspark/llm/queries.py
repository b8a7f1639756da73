"""The registered queries of the subpackage: thin calls of its operators on whole tables,
and the DuckDB SQL of those results that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from . import ann, decontaminate, html_text, jaccard, langid, packing, ranked, runs, sharding, substring, token_counts, toxicity, wavelet

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(spark, table(spark, sf_dir, "documents"), n_shards=8)


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark, table(spark, sf_dir, "pages"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(spark, table(spark, sf_dir, "documents"), k=5, percent=75)


OP3_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(
    CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
         WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(id, other) AS (
  SELECT a, b FROM e UNION SELECT r.id, e.b FROM reach r JOIN e ON e.a = r.other),
c AS (SELECT id, least(id, min(other)) AS component FROM reach GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles,
       CAST(coalesce(c.component, d.doc_id) AS BIGINT) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = d.doc_id
"""



def op4_projected_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(spark, vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.classify(spark, table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "lang_pred", "score", "rejected")


def op6_wavelet_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.round_trip(spark, table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, table(spark, sf_dir, "documents"), capacity=4096)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (substring.remove_repeats(spark, table(spark, sf_dir, "documents"), width=50)
            .select("doc_id", "n_words", "n_removed", "kept_sha256"))


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
f AS (SELECT h, min(doc_id) AS low FROM g GROUP BY h),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM g JOIN f USING (h) WHERE doc_id > low),
gone AS (SELECT doc_id, list(p) AS ps FROM hit GROUP BY doc_id),
k AS (
  SELECT w.doc_id, ws, CASE WHEN ps IS NULL THEN ws
    ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda x: NOT list_contains(ps, x)), lambda x: ws[x]) END AS kept
  FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - len(kept) AS BIGINT) AS n_removed,
       sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM k
"""


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_hits(
        spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10))


OP9_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT item, ws, least(len(ws), 10) AS n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i
        FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dg AS (
  SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d JOIN lens ON n <= len(ws))),
occ AS (SELECT dg.doc_id, dg.i, dg.n, win.item FROM dg JOIN win ON dg.n = win.n AND dg.g = win.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.attribute(spark, table(spark, sf_dir, "documents"), rule="majority", max_chars=1000)
    return counts.withColumn("n_tokens", counts["n_tokens"].cast("long"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank_documents(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


OP11_SQL = rf"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
s AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM n),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM tf, s GROUP BY term, nn),
m AS (SELECT doc_id, 100 - 50 + ((50 * n * nn) // ll) AS m FROM n, s),
score AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
      FROM score WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 50
"""


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.find_runs(spark, runs.with_planted_tails(table(spark, sf_dir, "documents")), least=6, times=4))


OP12_SQL = r"""
WITH h AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, xor(list_reduce(
    list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda x, c: list_reduce(list_concat([xor(x, c)], range(8)), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) AS h
  FROM documents),
p AS (SELECT doc_id, ws, h % 10 = 0 AND len(ws) > 0 AS planted, (h // 10) % greatest(len(ws), 1) AS a, 3 + (h // 10) % 8 AS d FROM h),
d AS (
  SELECT doc_id, CASE WHEN planted THEN list_transform(range(len(ws)), lambda i:
    CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % (1 + (len(ws) - a) // d) + 1] END) ELSE ws END AS ws FROM p),
t AS (SELECT doc_id, len(ws) AS n, generate_subscripts(ws, 1) - 1 AS i, unnest(ws) AS w FROM d),
e AS (
  SELECT y.doc_id, y.i, y.i - x.i AS q FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.w = y.w AND x.i < y.i
  WHERE 4 * (y.i - x.i) <= y.n),
g AS (SELECT doc_id, i, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM e),
l AS (
  SELECT doc_id, min(i) - q AS start, count(*) + q AS length, q AS period FROM g GROUP BY doc_id, q, k
  HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (
  SELECT * FROM l WHERE NOT EXISTS (
    SELECT 1 FROM l s WHERE s.doc_id = l.doc_id AND s.period < l.period AND s.start <= l.start
    AND s.start + s.length >= l.start + l.length)),
b AS (
  SELECT doc_id, start, length, period, (1000 * length) // period AS exponent_milli,
         row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS k FROM r),
c AS (
  SELECT doc_id, count(*) AS n_runs,
         string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS text FROM t ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length,
       CAST(period AS BIGINT) AS period, CAST(exponent_milli AS BIGINT) AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN b ON b.doc_id = d.doc_id AND b.k = 1 LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_balanced_shards": op1_balanced_shards,
    "op2_main_text": op2_main_text,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_projected_search": op4_projected_search,
    "op5_language_id": op5_language_id,
    "op6_wavelet_ids": op6_wavelet_ids,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_decontaminate": op9_decontaminate,
    "op10_token_counts": op10_token_counts,
    "op11_ranked_search": op11_ranked_search,
    "op12_word_runs": op12_word_runs,
    "op13_toxicity": op13_toxicity,
}

ORACLES: dict[str, str] = {
    "op3_jaccard_join": OP3_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op9_decontaminate": OP9_SQL,
    "op11_ranked_search": OP11_SQL,
    "op12_word_runs": OP12_SQL,
}
