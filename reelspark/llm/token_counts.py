"""Token counts of fields or sections, from one encoding of the whole document.

A document is encoded once, as a whole; its tokens' character spans are joined with the
character intervals of its sections. A token inside one section counts there. A token that
crosses a border is allocated by an explicit rule:

* ``majority``: to the section that holds most of its characters, the earlier one of equals;
* ``start``: to the section that holds its first character;
* ``share``: to each section in proportion to the characters it holds.

Counts of a document's sections add up to its tokens, unless characters lie in no section:
those tokens are counted in a row with a null section.

The interval join is a merge per document: both sides are in text order, so binary searches
of the section starts in the token starts tell the tokens that lie in one section or in none;
the few that cross a border go through ``allocate``. A document's tokens never leave its row.
Sections are either given as a table, joined by doc_id, or derived from the text by ``line_sections``.

Defined results: a null or empty text, or one without sections, has one row with section 0,
from 0 to 0, and no tokens (plus the row of a null section if it has tokens). Rows that
repeat get their own rows. Blank lines are not sections. Where given sections overlap, the
characters belong to the first of them (by start, end, number). An empty table has no rows.
Texts of any length are taken whole; columns with other names are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import apply_runtime_conf
from .components import pick
from .tokens import encoder, texts_of

RULES = ("majority", "start", "share")


def line_sections(text: str, max_chars: int) -> list[tuple[int, int]]:
    """Character intervals of the lines that are not blank; longer lines are cut at every
    ``max_chars`` characters."""
    out, at = [], 0
    for line in text.split("\n"):
        if line and not line.isspace():
            out += [(a, min(a + max_chars, at + len(line))) for a in range(at, at + len(line), max_chars)]
        at += len(line) + 1
    return out


def allocate(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray, rule: str):
    """For each token span [a, b): its (section or -1, weight) parts, and whether it crosses
    a border. An empty span belongs where its place is."""
    for a, b in spans:
        first = int(np.searchsorted(starts, a, "right")) - 1
        parts: dict[int, int] = {}
        at, s = a, max(first, 0)
        while at < b:
            while s < len(starts) and ends[s] <= at:
                s += 1
            if s == len(starts) or starts[s] >= b:
                parts[-1] = parts.get(-1, 0) + b - at
                break
            if starts[s] > at:
                parts[-1] = parts.get(-1, 0) + int(starts[s]) - at
                at = int(starts[s])
            end = min(b, int(ends[s]))
            parts[s] = parts.get(s, 0) + end - at
            at = end
        if not parts:
            parts = {first if first >= 0 and a < ends[first] else -1: 1}
        crosses = len(parts) > 1
        if not crosses:
            yield [(next(iter(parts)), 1.0)], False
        elif rule == "share":
            yield [(k, n / (b - a)) for k, n in parts.items()], True
        elif rule == "start":
            yield [(next(iter(parts)), 1.0)], True
        else:
            inside = {k: n for k, n in parts.items() if k >= 0}
            yield [(max(inside, key=lambda k: (inside[k], -k)), 1.0)], True


def _count(spans: np.ndarray, sections: list[tuple[int, int]], rule: str):
    """Tokens and crossing tokens per section; the last entry is for no section."""
    n = len(sections)
    tokens, crossing = np.zeros(n + 1), np.zeros(n + 1, dtype=np.int64)
    if not n:
        tokens[-1] = len(spans)
        return tokens, crossing
    given = np.array(sections, dtype=np.int64)
    ends = np.maximum.accumulate(given[:, 1])
    starts = np.maximum(given[:, 0], np.append(0, ends[:-1]))
    a, b = spans[:, 0], spans[:, 1]
    border = np.concatenate([[0], np.searchsorted(a, starts), [len(a)]])     # starts among the sorted tokens
    per_section = np.diff(border)
    first = np.repeat(np.arange(-1, n), per_section)
    limit = np.repeat(np.append(-1, ends), per_section)
    after = np.repeat(np.append(starts, np.iinfo(np.int64).max), per_section)
    inside = (a < limit) & (b <= limit)
    outside = (a >= limit) & (b <= after)
    tokens[:-1] += np.bincount(first[inside], minlength=n)
    tokens[-1] += np.count_nonzero(outside)
    for parts, crosses in allocate(spans[~inside & ~outside].tolist(), starts, ends, rule):
        for k, weight in parts:
            tokens[k] += weight
            crossing[k] += crosses
    return tokens, crossing


def attribute(spark: SparkSession, documents: DataFrame, sections: DataFrame | None = None, rule: str = "majority",
              max_chars: int = 1000, tokenizer: str | None = None) -> DataFrame:
    """documents(doc_id, text) [, sections(doc_id, section, start, end) in characters] ->
    (doc_id, section, start, end, n_tokens double, n_crossing)."""
    apply_runtime_conf(spark)
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    docs = pick(documents, doc_id="long", text="string")
    derived = sections is None
    if not derived:
        of_doc = (pick(sections, doc_id="long", start="long", end="long", section="int").where("end > start")
                  .groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "section"))).alias("sections")))
        docs = docs.join(of_doc, "doc_id", "left")

    def count(rows):
        e = encoder(tokenizer)
        for batch in rows:
            given = None if derived else batch.column("sections")
            ids = batch.column("doc_id")
            for a, _, texts in texts_of(batch.column("text")):
                out: dict[str, list] = {k: [] for k in ("row", "section", "start", "end", "n_tokens", "n_crossing")}
                for d, raw in enumerate(texts):
                    text = raw.decode()
                    if given is None:
                        spans = line_sections(text, max_chars)
                        names = list(range(len(spans)))
                    else:
                        have = [s for s in given[a + d].as_py() or () if s["start"] < len(text)]
                        spans = [(s["start"], min(s["end"], len(text))) for s in have]
                        names = [s["section"] for s in have]
                    tokens, crossing = _count(e.spans(text), spans, rule)
                    if not spans:
                        names, spans = [0], [(0, 0)]
                        tokens, crossing = np.append(0.0, tokens), np.append(0, crossing)
                    more = int(tokens[-1] > 0)
                    out["row"] += [a + d] * (len(spans) + more)
                    out["section"] += names + [None] * more
                    out["start"] += [x for x, _ in spans] + [None] * more
                    out["end"] += [y for _, y in spans] + [None] * more
                    out["n_tokens"] += tokens[:len(spans) + more].tolist()
                    out["n_crossing"] += crossing[:len(spans) + more].tolist()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": ids.take(pa.array(out["row"], pa.int64())), "section": pa.array(out["section"], pa.int32()),
                    "start": pa.array(out["start"], pa.int64()), "end": pa.array(out["end"], pa.int64()),
                    "n_tokens": pa.array(out["n_tokens"], pa.float64()), "n_crossing": pa.array(out["n_crossing"], pa.int64())})

    return docs.mapInArrow(count, "doc_id long, section int, start long, end long, n_tokens double, n_crossing long")
