"""Column expressions shared by the operators. All are built-in Spark functions, so they
stay inside whole-stage codegen (no Python on the row path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import NO_GENRE


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_genres(genres: str | Column) -> Column:
    """Pipe-separated genres to an array; empties and the no-genre marker dropped; null -> []."""
    g = col(genres)
    parts = F.split(g, r"\|")
    kept = F.filter(parts, lambda x: (x != F.lit("")) & (x != F.lit(NO_GENRE)))
    return F.when(g.isNull() | (F.trim(g) == ""), F.array().cast("array<string>")).otherwise(kept)


def genre_set(genres: str | Column) -> Column:
    """Distinct genres (a set), keeping first-appearance order."""
    return F.array_distinct(split_genres(genres))


def decade_label(year: str | Column) -> Column:
    """'1990s' for 1994; null stays null."""
    y = col(year)
    return F.when(y.isNull(), F.lit(None).cast("string")).otherwise(
        F.concat((F.floor(y.cast("double") / 10) * 10).cast("long").cast("string"), F.lit("s")))


def title_year(title: str | Column) -> Column:
    """First '(dddd)' in the title as an int, else null."""
    y = F.regexp_extract(col(title), r"\((\d{4})\)", 1)
    return F.when(y == "", F.lit(None).cast("int")).otherwise(y.cast("int"))


def search_text(title="title", genres="genres", director="director") -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce(col(title), F.lit("")), F.coalesce(col(genres), F.lit("")),
                               F.coalesce(col(director), F.lit(""))))


def movie_label(title="title", year="release_year", genres="genres") -> Column:
    """'Title (1999 or ?) — genres'."""
    y = F.coalesce(col(year).cast("long").cast("string"), F.lit("?"))
    return F.concat(col(title), F.lit(" ("), y, F.lit(") — "), F.coalesce(col(genres), F.lit("")))


def pct0(x: str | Column) -> Column:
    """Python's ``format(x, '.0%')`` digits: 100*x rounded half-even, as text."""
    return F.bround(col(x) * 100, 0).cast("long").cast("string")


def subset_of(needed: list[str] | tuple[str, ...], have: Column) -> Column:
    """True when every genre in ``needed`` is in the array ``have``."""
    cond = F.lit(True)
    for g in needed:
        cond = cond & F.array_contains(have, F.lit(g))
    return cond


def jaccard(a: Column, b: Column) -> Column:
    """|a ∩ b| / max(|a ∪ b|, 1), 0 if either is empty (sets as arrays)."""
    inter = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        inter.cast("double") / F.greatest(union, F.lit(1)).cast("double"))


def fmt(template: str, **cols: Column) -> Column:
    """concat() for a template with {name} placeholders."""
    import re

    parts = []
    pos = 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        parts.append(cols[m.group(1)])
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts)
