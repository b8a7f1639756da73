"""Taste profile, persona and Taste DNA, one row per profile.

``selected`` is the catalog rows of a profile's picks: (profile_id, pos, genres,
release_year). Counts are plain aggregates; "most common" ties go to the value seen first
(pick position, then position in the genre list); in the DNA, whose counts come from
genre sets, ties go to the genre name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.columns import decade_label, fmt, genre_set, split_genres, subset_of


def genre_counts(selected: DataFrame) -> DataFrame:
    """(profile_id, genre, n, first): genre occurrences over the picks' genre lists."""
    ex = selected.select("profile_id", "pos", F.posexplode(split_genres("genres")).alias("gi", "genre"))
    return ex.groupBy("profile_id", "genre").agg(F.count(F.lit(1)).alias("n"),
                                                 F.min(F.struct("pos", "gi")).alias("first"))


def genre_summary(selected: DataFrame, top_n: int) -> DataFrame:
    """(profile_id, rank, genre, n): most common genres, first-seen on ties."""
    w = Window.partitionBy("profile_id").orderBy(F.col("n").desc(), F.col("first"))
    return (genre_counts(selected).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
            .select("profile_id", "rank", "genre", "n"))


def decade_summary(selected: DataFrame, top_n: int) -> DataFrame:
    """(profile_id, rank, decade, n): most common decades, null years skipped."""
    d = selected.select("profile_id", "pos", decade_label("release_year").alias("decade")).where(F.col("decade").isNotNull())
    c = d.groupBy("profile_id", "decade").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    w = Window.partitionBy("profile_id").orderBy(F.col("n").desc(), F.col("first"))
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n).select("profile_id", "rank", "decade", "n")


def _ranked_list(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Collect a small ranked table (≤ top_n rows per profile) into an ordered array."""
    return df.groupBy("profile_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("rank"), value.alias("v")))), lambda s: s["v"]).alias(name))


def profile_stats(selected: DataFrame) -> DataFrame:
    """(profile_id, top_genres, top_decades, count): 'name:n' lists, top 6 genres, top 4 decades."""
    g = _ranked_list(genre_summary(selected, 6), F.concat_ws(":", "genre", F.col("n").cast("string")), "g")
    d = _ranked_list(decade_summary(selected, 4), F.concat_ws(":", "decade", F.col("n").cast("string")), "d")
    n = selected.groupBy("profile_id").agg(F.count(F.lit(1)).alias("count"))
    return (n.join(g, "profile_id", "left").join(d, "profile_id", "left")
            .select("profile_id", F.array_join(F.coalesce("g", F.array().cast("array<string>")), ", ").alias("top_genres"),
                    F.array_join(F.coalesce("d", F.array().cast("array<string>")), ", ").alias("top_decades"), "count"))


def all_genres(selected: DataFrame) -> DataFrame:
    """(profile_id, genres_all): union of the picks' genre sets (bounded by the genre count)."""
    return selected.groupBy("profile_id").agg(
        F.array_distinct(F.flatten(F.collect_list(genre_set("genres")))).alias("genres_all"))


def persona_expr(g: Column) -> tuple[Column, Column, Column]:
    """(title, emoji, blurb): the rule with the largest overlap (≥ its minimum), first on ties."""
    ovs = [F.size(F.array_intersect(g, F.array(*[F.lit(x) for x in genres]))) for _, _, genres, _, _ in R.PERSONA_RULES]
    quals = [F.when(ov >= mn, ov).otherwise(F.lit(0)) for ov, (_, _, _, mn, _) in zip(ovs, R.PERSONA_RULES)]
    best = F.greatest(*quals)
    outs = []
    for field in (0, 1, 4):
        e = None
        for q, rule in zip(quals, R.PERSONA_RULES):
            cond = (best > 0) & (q == best)
            e = F.when(cond, F.lit(rule[field])) if e is None else e.when(cond, F.lit(rule[field]))
        default = R.DEFAULT_PERSONA[{0: 0, 1: 1, 4: 2}[field]]
        outs.append(e.otherwise(F.lit(default)))
    return outs[0], outs[1], outs[2]


def persona(selected: DataFrame) -> DataFrame:
    t, e, b = persona_expr(F.col("genres_all"))
    return all_genres(selected).select("profile_id", t.alias("title"), e.alias("emoji"), b.alias("blurb"))


def genre_mix(selected: DataFrame, top_n: int = 6) -> DataFrame:
    """(profile_id, rank, genre, pct): DNA counts over genre sets; pct = round-half-even of
    100·count/total, total over all genres; ties by genre name."""
    ex = selected.select("profile_id", F.explode(genre_set("genres")).alias("genre"))
    c = ex.groupBy("profile_id", "genre").agg(F.count(F.lit(1)).alias("n"))
    tot = Window.partitionBy("profile_id")
    w = Window.partitionBy("profile_id").orderBy(F.col("n").desc(), F.col("genre"))
    c = c.withColumn("total", F.sum("n").over(tot)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
    return c.select("profile_id", "rank", "genre", F.bround(F.col("n") * 100 / F.col("total"), 0).cast("int").alias("pct"))


def style_expr(g: Column) -> Column:
    e = None
    for needed, label in R.STYLE_RULES:
        cond = subset_of(needed, g)
        e = F.when(cond, F.lit(label)) if e is None else e.when(cond, F.lit(label))
    return e.otherwise(F.lit(R.DEFAULT_STYLE))


def dna_themes_expr(g: Column) -> Column:
    tags = F.slice(F.array_compact(F.array(*[F.when(subset_of(n, g), F.lit(t)) for n, t in R.THEME_TAGS])), 1, 3)
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit(R.DEFAULT_THEME)))


def era(selected: DataFrame) -> DataFrame:
    """'min–max' if the years span at most 12, else '<top decade> (peak)'; 'Mixed eras' without years."""
    span = selected.groupBy("profile_id").agg(F.min("release_year").alias("y0"), F.max("release_year").alias("y1"))
    top = decade_summary(selected, 1).select("profile_id", F.col("decade").alias("peak"))
    x = span.join(top, "profile_id", "left")
    e = (F.when(F.col("y0").isNull(), F.lit(R.TXT_MIXED_ERAS))
         .when(F.col("y1") - F.col("y0") <= 12,
               F.concat(F.col("y0").cast("long").cast("string"), F.lit("–"), F.col("y1").cast("long").cast("string")))
         .when(F.col("peak").isNotNull(), F.concat(F.col("peak"), F.lit(R.TXT_PEAK)))
         .otherwise(F.lit(R.TXT_MIXED_ERAS)))
    return x.select("profile_id", e.alias("era"))


def taste_dna(selected: DataFrame) -> DataFrame:
    """(profile_id, genre_pct, primary_genre, primary_pct, secondary_genre, secondary_pct, style, era, themes)."""
    mix = genre_mix(selected)
    lst = _ranked_list(mix, F.struct("genre", "pct"), "mix")
    g = all_genres(selected)
    x = g.join(lst, "profile_id", "left").join(era(selected), "profile_id", "left")
    mixc = F.coalesce(F.col("mix"), F.array().cast("array<struct<genre:string,pct:int>>"))
    return x.select(
        "profile_id",
        F.array_join(F.transform(mixc, lambda s: F.concat(s["genre"], F.lit(" "), s["pct"].cast("string"), F.lit("%"))),
                     ", ").alias("genre_pct"),
        F.coalesce(F.try_element_at(mixc, F.lit(1))["genre"], F.lit(R.TXT_MIXED_PRIMARY)).alias("primary_genre"),
        F.coalesce(F.try_element_at(mixc, F.lit(1))["pct"], F.lit(0)).alias("primary_pct"),
        F.when(F.size(mixc) > 1, F.try_element_at(mixc, F.lit(2))["genre"]).alias("secondary_genre"),
        F.when(F.size(mixc) > 1, F.try_element_at(mixc, F.lit(2))["pct"]).alias("secondary_pct"),
        style_expr(F.col("genres_all")).alias("style"),
        "era",
        F.array_join(dna_themes_expr(F.col("genres_all")), " || ").alias("themes"),
    )


def taste_summary(selected: DataFrame) -> DataFrame:
    """(profile_id, summary): the written profile."""
    t, e, _ = persona_expr(F.col("genres_all"))
    per = all_genres(selected).select("profile_id", t.alias("p_title"), e.alias("p_emoji"))
    dna = taste_dna(selected)
    g4 = _ranked_list(genre_summary(selected, 4), F.col("genre"), "g4")
    d2 = _ranked_list(decade_summary(selected, 2), F.col("decade"), "d2")
    x = per.join(dna, "profile_id").join(g4, "profile_id", "left").join(d2, "profile_id", "left")
    streak = F.when(F.col("secondary_genre").isNotNull(),
                    fmt(R.TXT_STRONG_STREAK, genre=F.col("secondary_genre"), pct=F.col("secondary_pct").cast("string")))
    pct_line = F.concat(F.col("primary_genre"), F.lit(" ("), F.col("primary_pct").cast("string"), F.lit("%)"),
                        F.coalesce(streak, F.lit("")))
    genres = F.when(F.size(F.coalesce("g4", F.array())) > 0, F.array_join("g4", ", ")).otherwise(F.lit(R.TXT_VARIED_GENRES))
    decades = F.when(F.size(F.coalesce("d2", F.array())) > 0, F.array_join("d2", ", ")).otherwise(F.lit(R.TXT_MANY_ERAS))
    summary = fmt(R.TXT_SUMMARY, emoji=F.col("p_emoji"), title=F.col("p_title"), pct_line=pct_line, style=F.col("style"),
                  decades=decades, genres=genres)
    return x.select("profile_id", summary.alias("summary"))
