"""Benchmark decontamination with a generalised suffix automaton.

The items are normalised to words (A-Z lower-cased, runs of letters, digits and non-ASCII
bytes) and their word sequences go into one suffix automaton. A document's words are
streamed through it; the automaton's state is the longest run of words, ending at the
current word, that also occurs in an item. Where that length reaches ``width`` words, or a
whole shorter item ends, the words are hit. Spans of hit words are removed; a document whose
hit share exceeds a coverage limit is dropped as a whole.

The item table is what a query set is: it is cut into blocks of bounded words, each block
becomes one automaton of bounded size that is sent to the tasks, and each document passes
through all of them. Documents are never shuffled, and their order and sizes don't matter.

Most words of a text need no automaton step: only stretches whose three-word sequences all
occur in some item can hold a match (a lookup in the items' own small hash set), and only
those are streamed, each from the root state.

Defined results: null or blank texts have no words and are clean; null or blank items
have no windows; items that repeat (same item_id or same text) each count; item_ids are
compared as strings. Items with a null item_id have windows like all others: their words are
hit, and together they are one null entry, the last in the list of items. It counts as one
in ``n_items`` and is left out of ``items_sha256``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import trimmed
from ..session import apply_runtime_conf
from .components import carried_type, pick
from .words import batches

ITEM_WORDS = 50_000
TABLE_BITS = 20

Items = list[tuple[str | None, list[int]]]


class Automaton:
    """Generalised suffix automaton over word hashes. A state stands for word sequences
    that occur at the same places; ``length`` is that of the longest, and ``link`` leads to
    the state of the longest suffix that occurs at more places.

    ``own[v]`` are the windows among v's own sequences, (length, items); ``up[v]`` sums
    up those of all states on the way to the root: (longest, items)."""

    def __init__(self, items: Items, width: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, str | None]] = []
        for item, sequence in items:
            state = 0
            for w in sequence:
                state = self._extend(state, w)
                ends.append((state, item))
        owners: list[set[str]] = [set() for _ in self.next]
        for state, item in ends:
            owners[state].add(item)
        longest_first = sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True)
        self.own: dict[int, list[tuple[int, frozenset[str]]]] = {}
        for v in longest_first:
            if self.length[self.link[v]] >= width:
                owners[self.link[v]] |= owners[v]
            elif self.length[v] >= width:
                self.own[v] = [(width, frozenset(owners[v]))]
        short: dict[tuple[int, int], set[str]] = {}
        for item, sequence in items:
            if 0 < len(sequence) < width:
                state = 0
                for w in sequence:
                    state = self.next[state][w]
                short.setdefault((state, len(sequence)), set()).add(item)
        for (state, n), found in short.items():
            self.own.setdefault(state, []).append((n, frozenset(found)))
        nothing = (0, frozenset())
        self.up: dict[int, tuple[int, frozenset[str]]] = {}
        for v in reversed(longest_first):
            parent = self.link[v]
            n, found = self.up.get(parent, nothing)
            for k, more in self.own.get(parent, ()):
                n, found = max(n, k), found | more
            if n:
                self.up[v] = (n, found)

    def _extend(self, last: int, w: int) -> int:
        """The state of ``last``'s longest sequence followed by w, added if missing."""
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        """A new state for q's sequences of at most length[p] + 1 words."""
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def stream(self, words: list[int]):
        """(i, n, items) for each word i where windows end: the longest has n words."""
        nxt, link, length, own, up = self.next, self.link, self.length, self.own, self.up
        state = matched = 0
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                matched = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                matched += 1
            if state in own or state in up:
                n, found = up.get(state, (0, frozenset()))
                for k, more in own.get(state, ()):
                    if k <= matched:
                        n, found = max(n, k), found | more
                if n:
                    yield i, n, found


class Block:
    """The automaton of some items, and a hashed table of their m-word sequences that
    tells which stretches of a text can hold a window at all."""

    def __init__(self, items: Items, hashed: dict[int, np.ndarray], width: int):
        self.automaton = Automaton(items, width)
        self.shortest = min([width, *(len(s) for _, s in items if s)])
        self.m = min(3, self.shortest)
        self.table = np.zeros(1 << TABLE_BITS, dtype=bool)
        self.table[(hashed[self.m] >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def stretches(self, words) -> list[tuple[int, int]]:
        """Word ranges, each inside one document, that may hold a window."""
        grams = words.sequences(self.m)
        if not len(grams):
            return []
        alive = self.table[(grams >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] & words.complete(self.m)
        edge = np.diff(np.concatenate(([0], alive.view(np.int8), [0])))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        enough = end - start >= self.shortest - self.m + 1
        # m-grams of two documents are never neighbours, since those across a border are out;
        # with m = 1 a stretch can run on into the next document and is cut there
        found = list(zip(start[enough].tolist(), (end[enough] + self.m - 1).tolist()))
        if self.m > 1:
            return found
        out = []
        for a, b in found:
            cuts = words.bounds[np.searchsorted(words.bounds, a, "right"):np.searchsorted(words.bounds, b, "left")]
            points = [a, *sorted(set(cuts.tolist())), b]
            out += [(x, y) for x, y in zip(points, points[1:]) if y > x]
        return out


def blocks_of(items: DataFrame, width: int, limit: int = ITEM_WORDS) -> list[Block]:
    """Items as blocks of at most ``limit`` words (or one longer item). Rows are streamed
    to the driver partition by partition; the number of blocks follows the item table."""
    out: list[Block] = []
    rows = pick(items, item_id="string", text="string")
    held: Items = []
    hashed: dict[int, list[np.ndarray]] = {1: [], 2: [], 3: []}
    size = 0

    def close():
        nonlocal held, hashed, size
        if held:
            out.append(Block(held, {m: np.concatenate(h) for m, h in hashed.items()}, width))
        held, hashed, size = [], {1: [], 2: [], 3: []}, 0

    for row in rows.toLocalIterator():
        for _, _, words in batches(pa.array([row["text"]], pa.string()), "alnum", lower=True):
            if not len(words):
                continue
            if size + len(words) > limit:
                close()
            held.append((row["item_id"], words.hashes.tolist()))
            size += len(words)
            for m in hashed:
                hashed[m].append(words.sequences(m))
    close()
    return out


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _scan(docs: DataFrame, block) -> DataFrame:
    """Adds the block's hits to the documents' spans (word intervals [start, end)) and items."""

    def scan(rows):
        b: Block = block.value
        for batch in rows:
            old_spans, old_items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            n_words, spans, items = [], [], []
            for first, last, words in batches(batch.column("text"), "alnum", lower=True):
                n_words += np.diff(words.bounds).tolist()
                hits: dict[int, list[tuple[int, int]]] = {}
                found: dict[int, set[str]] = {}
                for x, y in b.stretches(words):
                    d = int(np.searchsorted(words.bounds, x, "right")) - 1
                    base = int(words.bounds[d])
                    for i, n, which in b.automaton.stream(words.hashes[x:y].tolist()):
                        hits.setdefault(d, []).append((x + i + 1 - n - base, x + i + 1 - base))
                        found.setdefault(d, set()).update(which)
                for d in range(last - first):
                    have = [(s["start"], s["end"]) for s in old_spans[first + d]]
                    spans.append([{"start": s, "end": e} for s, e in merged(have + hits.get(d, []))])
                    items.append(sorted({*old_items[first + d], *found.get(d, ())}, key=lambda i: (i is None, i or "")))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "text": batch.column("text"),
                "n_words": pa.array(n_words, pa.int64()), "spans": pa.array(spans, SPANS),
                "items": pa.array(items, pa.list_(pa.string())), "carried": batch.column("carried")})

    return docs.mapInArrow(trimmed(scan), "doc_id long, text string, n_words long, spans array<struct<start int, end int>>, "
                                 f"items array<string>, carried {carried_type(docs)}")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching intervals joined."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def find_hits(spark: SparkSession, documents: DataFrame, items: DataFrame, width: int = 10,
              carry: list[str] = ()) -> DataFrame:
    """documents(doc_id, text), items(item_id, text) -> (doc_id, text, n_words, spans, items,
    carried): the merged word intervals inside an occurrence of a window, the items (as
    strings, in order, null last) that have an occurring window, and a struct of the columns ``carry``."""
    apply_runtime_conf(spark)
    empty = F.from_json(F.lit("[]"), "array<struct<start int, end int>>")
    docs = pick(documents, list(carry), doc_id="long", text="string").select(
        "doc_id", "text", F.lit(0).cast("long").alias("n_words"), empty.alias("spans"),
        F.array().cast("array<string>").alias("items"), "carried")
    for block in blocks_of(items, width) or [Block([], {m: np.empty(0, dtype=np.uint64) for m in (1, 2, 3)}, width)]:
        docs = _scan(docs, spark.sparkContext.broadcast(block))
    return docs


def digest(hits: DataFrame) -> DataFrame:
    """Per document: words, hit words, items, digest of the items, and the flag."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def remove_hits(spark: SparkSession, documents: DataFrame, items: DataFrame, width: int = 10,
                max_span: int = 0, max_coverage: float = 0.5, carry: list[str] = ()) -> DataFrame:
    """documents -> (doc_id, text, n_hit, n_words, carried): hit spans longer than ``max_span`` words
    are cut out of the text (with the bytes between their words; a space is left in their
    place), and documents with more than ``max_coverage`` of their words in such spans are
    dropped. Texts without such spans stay as they are, nulls included."""
    hits = find_hits(spark, documents, items, width, carry)

    def cut(rows):
        for batch in rows:
            spans = batch.column("spans").to_pylist()
            texts = batch.column("text")
            out, keep, n_hit, n_words = [], [], [], []
            for first, last, words in batches(texts, "alnum", lower=True):
                for d in range(last - first):
                    lo, hi = int(words.bounds[d]), int(words.bounds[d + 1])
                    long = [(s["start"], s["end"]) for s in spans[first + d] if s["end"] - s["start"] > max_span]
                    if not long:
                        keep.append(first + d)
                        out.append(None)
                    else:
                        hit = sum(e - s for s, e in long)
                        if hit > max_coverage * (hi - lo):
                            continue
                        keep.append(first + d)
                        out.append((first + d, [(int(words.starts[lo + s]), int(words.ends[lo + e - 1])) for s, e in long],
                                    words.data, int(words.doc_offsets[d]), int(words.doc_offsets[d + 1])))
                    n_hit.append(sum(e - s for s, e in long))
                    n_words.append(hi - lo)
            kept = texts.take(pa.array(keep, pa.int64())).to_pylist()
            for j, change in enumerate(out):
                if change:
                    _, ranges, data, at, end = change
                    parts = []
                    for s, e in ranges:
                        parts.append(data[at:s].tobytes())
                        at = e
                    parts.append(data[at:end].tobytes())
                    kept[j] = b" ".join(p.strip() for p in parts).strip().decode()
            rows_ = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").take(rows_), "text": pa.array(kept, pa.string()),
                "n_hit": pa.array(n_hit, pa.int64()), "n_words": pa.array(n_words, pa.int64()),
                "carried": batch.column("carried").take(rows_)})

    return hits.mapInArrow(trimmed(cut), f"doc_id long, text string, n_hit long, n_words long, carried {carried_type(hits)}")
