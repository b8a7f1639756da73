"""Search and browse over the serving catalog.

Searches are set-oriented: a table of queries goes in, ranked hits for all of them come
out. Substring matching is made an equi-join by grams: a title that holds a token holds the
token's three-character grams, so each query is joined on the one of its grams that the
fewest titles hold, and the matches are verified; per-query top-k is a window-group-limit
(partial top-k before the shuffle). The inverted gram index is a stored table, made once per
catalog and pruned by the buckets of the queries' grams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import movie_label as _movie_label
from ..functions.columns import title_year as _title_year
from ..functions.rules import FRANCHISE_PATTERNS, TXT_FRANCHISE_REASON
from ..session import checkpoint_root


def normalize_queries(queries: DataFrame, min_chars: int = 1) -> DataFrame:
    """query_id, q (stripped, lower), tokens; queries shorter than ``min_chars`` dropped."""
    q = F.lower(F.regexp_replace(F.col("query"), r"^\s+|\s+$", ""))
    out = queries.select("query_id", q.alias("q"))
    out = out.withColumn("tokens", F.filter(F.split(F.col("q"), r"\s+"), lambda t: t != ""))
    return out.where((F.length("q") >= min_chars) & (F.size("tokens") > 0))


def gram_index(catalog: DataFrame) -> DataFrame:
    """(bucket, gram, movieId): the grams of one to three characters of every search text. To be stored
    with ``sink_index`` and used by many searches. A search counts the titles of its own grams only: the
    counts of all grams would take the whole index through three shuffles instead of one."""
    rows = catalog.select("movieId", F.explode(_grams(F.col("search_text"))).alias("gram"))
    return rows.select(_bucket().alias("bucket"), "gram", "movieId")


def sink_index(index: DataFrame, path: str) -> None:
    """One folder per bucket, sorted by gram: a search reads the buckets of its grams only, and of
    their files the row groups that can hold them."""
    (index.repartition("bucket").sortWithinPartitions("bucket", "gram", "movieId")
     .write.partitionBy("bucket").parquet(path))


def _bucket() -> Column:
    return F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int")


def search_movies(catalog: DataFrame, queries: DataFrame, limit: int = 20, min_chars: int = 1,
                  index: DataFrame | None = None) -> DataFrame:
    """(query_id, pos, movieId, title, search_rank): every token must be a literal substring of
    the search text; rank = 10·title starts with first token + 5·title has the whole query +
    number of tokens in the title; ties by movieId. ``index``: the catalog's stored gram index;
    without it one is made for this search."""
    qn = normalize_queries(queries, min_chars)
    cat = catalog.select("movieId", "title", "search_text")
    # a hit holds every gram of every token: join on the gram that fewest titles hold
    windows = F.transform("tokens", lambda t: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(t) - (GRAM - 1), F.lit(1))), lambda i: F.substring(t, i, GRAM)))
    grams = qn.select("query_id", F.explode(F.array_distinct(F.flatten(windows))).alias("gram")).withColumn("bucket", _bucket())
    asked = sorted(r["bucket"] for r in grams.select("bucket").distinct().collect())        # BUCKETS at most
    held = (gram_index(catalog) if index is None else index).where(F.col("bucket").isin(asked))
    spread = (held.join(grams.select("bucket", "gram").distinct(), ["bucket", "gram"], "left_semi")
              .groupBy("bucket", "gram").agg(F.count(F.lit(1)).alias("n")))
    rarest = (grams.join(spread, ["bucket", "gram"], "left").groupBy("query_id")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "bucket", "gram")).alias("r"))
              .select("query_id", "r.bucket", "r.gram"))
    hits = (held.join(rarest, ["bucket", "gram"]).select("query_id", "movieId").join(qn, "query_id").join(cat, "movieId")
            .where(F.forall("tokens", lambda t: F.instr(F.col("search_text"), t) > 0)))
    tl = F.lower(F.col("title"))
    rank = (F.when(tl.startswith(F.element_at("tokens", 1)), 10).otherwise(0)
            + F.when(F.instr(tl, F.col("q")) > 0, 5).otherwise(0)
            + F.aggregate(F.col("tokens"), F.lit(0), lambda acc, t: acc + F.when(F.instr(tl, t) > 0, 1).otherwise(0)))
    hits = hits.withColumn("search_rank", rank.cast("int"))
    w = Window.partitionBy("query_id").orderBy(F.col("search_rank").desc(), F.col("movieId"))
    return (hits.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= limit)
            .select("query_id", "pos", "movieId", "title", "search_rank"))


GRAM = 3
BUCKETS = 64


def _grams(text: Column) -> Column:
    """Distinct substrings of length 1..GRAM of a text."""
    def sub(n: int):
        return lambda i: F.substring(text, i, n)      # one-argument lambda: transform passes the element only

    parts = [F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), sub(n))
             for n in range(1, GRAM + 1)]
    return F.array_distinct(F.filter(F.flatten(F.array(*parts)), lambda g: F.length(g) > 0))


def suggest_movies(catalog: DataFrame, queries: DataFrame, limit: int = 8, index: DataFrame | None = None) -> DataFrame:
    return search_movies(catalog, queries, limit=limit, min_chars=2, index=index)


def eligible_first(catalog: DataFrame, queries: DataFrame, eligible_ids: DataFrame,
                   fetch: int = 16, keep: int = 8, index: DataFrame | None = None) -> DataFrame:
    """Of the top ``fetch`` suggestions, model-covered titles first (stable), keep ``keep``."""
    hits = suggest_movies(catalog, queries, limit=fetch, index=index)
    ids = eligible_ids.select("movieId").distinct().withColumn("eligible", F.lit(1))
    flagged = hits.join(ids, "movieId", "left").withColumn("eligible", F.coalesce("eligible", F.lit(0)))
    w = Window.partitionBy("query_id").orderBy(F.col("eligible").desc(), F.col("pos"))
    return (flagged.withColumn("shown", F.row_number().over(w)).where(F.col("shown") <= keep)
            .select("query_id", "shown", "movieId", "title", "eligible"))


def movies_by_ids(catalog: DataFrame, picks: DataFrame) -> DataFrame:
    """Catalog rows for (list_id, movieId, pos) picks, in list order (unknown ids dropped)."""
    return picks.join(catalog, "movieId").orderBy("profile_id", "pos")


def movie_labels(catalog: DataFrame) -> DataFrame:
    return catalog.select("movieId", _movie_label().alias("label"))


def title_years(catalog: DataFrame) -> DataFrame:
    return catalog.select("movieId", _title_year("title").alias("title_year"))


def _franchise_cond(patterns: list[str], title: Column) -> Column:
    cond = F.lit(False)
    for p in patterns:
        cond = cond | (F.instr(title, F.lit(p)) > 0)
    return cond


def franchise_of(title: str | Column = "title") -> Column:
    """First franchise (list order) with a pattern in the lower-case title, else null.
    A CASE chain: evaluated in the projection, no join and no shuffle."""
    t = F.lower(F.col(title) if isinstance(title, str) else title)
    expr = None
    for name, patterns in FRANCHISE_PATTERNS:
        c = _franchise_cond(patterns, t)
        expr = F.when(c, F.lit(name)) if expr is None else expr.when(c, F.lit(name))
    return expr.otherwise(F.lit(None).cast("string"))


def franchises_all(title: str | Column = "title") -> Column:
    """Every franchise with a pattern in the title (array, list order)."""
    t = F.lower(F.col(title) if isinstance(title, str) else title)
    return F.array_compact(F.array(*[F.when(_franchise_cond(p, t), F.lit(n)) for n, p in FRANCHISE_PATTERNS]))


def detect_franchise(catalog: DataFrame) -> DataFrame:
    return (catalog.select("movieId", "title", franchise_of("title").alias("franchise"))
            .where(F.col("franchise").isNotNull()))


def franchise_suggestions(catalog: DataFrame, picks: DataFrame, limit: int = 8) -> DataFrame:
    """Per profile: other titles of its picks' franchises. Franchise name asc, then year asc
    (nulls last), then movieId; a title listed once (under its first franchise); picks excluded."""
    seeds = picks.where(F.col("role") == "seed").select("profile_id", "movieId")
    named = seeds.join(catalog.select("movieId", "title"), "movieId").select("profile_id", franchise_of("title").alias("franchise"))
    pf = named.groupBy("profile_id").agg(F.collect_set("franchise").alias("f"), F.count(F.lit(1)).alias("n_seeds"))
    checkpoint_root(pf.sparkSession)
    pf = pf.where(F.size("f") > 0).select("profile_id", "n_seeds", F.explode("f").alias("franchise")).checkpoint(eager=True)
    # Of a franchise's titles in order, only a profile's seeds and those listed under an earlier franchise
    # are left out, and of the latter there are fewer than ``limit`` if this one is still needed: the
    # first n_seeds + 2 * limit hold all that can be listed.
    most = (pf.agg(F.max("n_seeds")).first()[0] or 0) + 2 * limit
    unordered = (catalog.select("movieId", "title", "release_year", F.explode(franchises_all("title")).alias("franchise"))
                 .groupBy("franchise", "movieId").agg(F.min(F.struct(F.col("release_year").isNull().alias("none"), "release_year", "title")).alias("m"))
                 .select("franchise", "movieId", "m.release_year", "m.title"))
    in_order = Window.partitionBy("franchise").orderBy(F.col("release_year").asc_nulls_last(), "movieId")
    members = unordered.withColumn("nth", F.row_number().over(in_order)).where(F.col("nth") <= most)
    cand = pf.join(members, "franchise").where(F.col("nth") <= F.col("n_seeds") + 2 * limit).drop("n_seeds", "nth")
    cand = cand.join(seeds, ["profile_id", "movieId"], "left_anti")
    first = Window.partitionBy("profile_id", "movieId").orderBy("franchise")
    cand = cand.withColumn("_f", F.row_number().over(first)).where(F.col("_f") == 1)
    w = Window.partitionBy("profile_id").orderBy("franchise", F.col("release_year").asc_nulls_last(), "movieId")
    return (cand.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= limit)
            .select("profile_id", "pos", "movieId", "title", "franchise",
                    F.concat(F.lit(TXT_FRANCHISE_REASON.split("{")[0]), F.col("franchise"),
                             F.lit(TXT_FRANCHISE_REASON.split("}")[1])).alias("reason")))


def latest_movies(catalog: DataFrame, as_of_year: int, limit: int = 12,
                  eligible_ids: DataFrame | None = None) -> DataFrame:
    """Recent titles with a poster: title year in [max(2015, as_of-8), as_of+1]; newest year,
    then most rated, then highest id first; top ``limit``."""
    min_year = max(2015, as_of_year - 8)
    df = catalog.select("movieId", "title", "poster_url", "rating_count", _title_year("title").alias("title_year"))
    df = df.where(F.col("title_year").between(min_year, as_of_year + 1)
                  & F.col("poster_url").isNotNull() & (F.length("poster_url") > 0))
    if eligible_ids is not None:
        df = df.join(eligible_ids.select("movieId").distinct(), "movieId", "left_semi")
    df = df.withColumn("rating_count", F.coalesce(F.col("rating_count"), F.lit(0)))
    order = [F.col("title_year").desc(), F.col("rating_count").desc(), F.col("movieId").desc()]
    top = df.orderBy(*order).limit(limit)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(*order))).select(
        "pos", "movieId", "title", "title_year", "rating_count", "poster_url")


def prune_unsupported(picks: DataFrame, supported_ids: DataFrame) -> DataFrame:
    """Drop picks the model does not cover."""
    return picks.join(supported_ids.select("movieId").distinct(), "movieId", "left_semi")
