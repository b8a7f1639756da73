"""Ranked search and periodic runs against brute force; the factorization machine on planted labels."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from reelspark.llm import ranked, runs, toxicity

from .test_pairs_and_spans import SPACED, ascii_lower, benchmark_items, frame

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# ------------------------------------------------------------------ ranked search

def brute_ranking(docs, items, k):
    counts = [(i, Counter(TERM.findall(ascii_lower(t or "")))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_all = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall(ascii_lower(t or "")))
    out = []
    for item, terms in asked.items():
        found = []
        for i, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_all
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                        for t in terms if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return sorted(out, key=str)


def some_texts(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["É", "Ärger", "a-b", "X_y", "the", "The"]
    weights = [1 / (j + 1) for j in range(len(words))]
    texts = [" ".join(rng.choices(words, weights, k=rng.choice([0, 1, 3, 10, 40, 90]))) for _ in range(n)]
    texts += [texts[3]] * 30 + [None, "", " .,- ", "the " * 30_000]
    return texts


@pytest.mark.parametrize("seed,leaf,item_bytes,first", [(1, 2, 1 << 20, 10_000), (2, 16, 60, 20), (3, 4, 1 << 20, 0)])
def test_ranking_equals_brute_force(spark, monkeypatch, seed, leaf, item_bytes, first):
    monkeypatch.setattr(ranked.Tree.__init__, "__defaults__", (leaf, 600))
    monkeypatch.setattr(ranked, "FIRST_DOCUMENTS", first)
    texts = some_texts(seed)
    ids = random.Random(seed).sample(range(-50, 900), len(texts))
    docs = [*zip(ids, texts), (ids[4], texts[4]), (None, texts[3]), (None, None)]
    items = [(1, "the w1 w5 W5 x_y"), (2, "nothing here"), (3, None), (4, "Ärger é a"), (5, texts[5] or "w2"), (1, "w30 w31"),
             (None, "w2 w3"), (6, "the"), (7, "w39 w38 w37 w36 w35 w34")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = ranked.rank_documents(spark, frame(spark, docs), benchmark_items(spark, items), k=7, item_bytes=item_bytes).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((tuple(r) for r in got), key=str) == brute_ranking(docs, items, 7)


def test_ranking_of_empty_tables(spark):
    docs, items = frame(spark, [(1, "a b"), (2, None)]), benchmark_items(spark, [(1, "a")])
    assert ranked.rank_documents(spark, frame(spark, []), items).collect() == []
    assert ranked.rank_documents(spark, frame(spark, [(1, None), (2, "")]), items).collect() == []
    assert ranked.rank_documents(spark, docs, benchmark_items(spark, [])).collect() == []
    assert ranked.rank_documents(spark, docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_bounds_hold_and_skip(spark):
    rng = np.random.default_rng(4)
    n_terms = 60
    vectors = [np.unique(np.floor(n_terms * rng.random(25) ** 3).astype(int)) for _ in range(800)]
    tfs = [rng.integers(1, 9, len(v)) for v in vectors]
    m = rng.integers(60, 400, len(vectors))
    tree = ranked.Tree(vectors, tfs, m, np.arange(len(vectors)), n_terms, leaf=4)
    asked, w = np.array([40, 50, 55, 59]), np.array([900, 1500, 2000, 4000])
    weight_of = np.zeros(n_terms, np.int64)
    weight_of[asked] = w
    bound = tree.bounds(asked, w)
    for x in range(len(tree.low)):
        assert tree.scores(tree.low[x], tree.high[x], weight_of).max() <= bound[x]
    best = ranked.Best(5)
    assert ranked.search(tree, asked, w, weight_of, best) < len(vectors) / 2
    assert best.scores.tolist() == sorted(tree.scores(0, len(vectors), weight_of).tolist(), reverse=True)[:5]


# ------------------------------------------------------------------ periodic runs

def brute_runs(w, least=6, times=4):
    out = []
    for q in range(1, len(w) // times + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            s, n = i - q, j - i + q
            if n >= max(least, times * q) and not any(all(w[x] == w[x - p] for x in range(s + p, s + n)) for p in range(1, q)):
                out.append((s, n, q))
            i = j + 1 if j == i else j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_digest(doc, text):
    w = SPACED.findall(text or "")
    found = brute_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = None
    for s, n, q in found:
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    s, n, q = best or (None, None, None)
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc, len(found), s, n, q, 1000 * n // q if best else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def planted(doc, text):
    w = SPACED.findall(text or "")
    h, n = zlib.crc32(str(doc).encode()), len(w)
    g = h // 10
    if doc is None or h % 10 or not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(n))


def repeating_texts(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(120):
        v = [f"w{i}" for i in range(rng.choice([1, 2, 3, 6]))] + ["É"]
        w = [rng.choice(v) for _ in range(rng.choice([0, 1, 5, 20, 60, 150]))]
        for _ in range(rng.choice([0, 1, 2])):
            if w:
                a = rng.randrange(len(w))
                p = rng.randrange(1, 1 + max(1, (len(w) - a) // rng.choice([3, 4, 5])))
                w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
        texts.append(rng.choice([" ", "\n", "\t "]).join(w))
    return texts + [None, "", " \n", texts[7], " ".join(["x", "y"] * 40_000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_equal_brute_force(spark, seed):
    docs = list(enumerate(repeating_texts(seed), start=-10)) + [(3, "z " * 9), (None, "z " * 9)]
    short = [d for d in docs if not d[1] or len(d[1]) < 10_000]
    got = runs.digest(runs.find_runs(spark, runs.with_planted_tails(frame(spark, docs)))).collect()
    assert len(got) == len(docs)
    expected = {brute_digest(i, planted(i, t)) for i, t in short}
    assert expected <= {tuple(r) for r in got}
    long = next(r for r in runs.find_runs(spark, frame(spark, docs), carry=["h"]).collect() if r["n_words"] == 80_000)
    assert [tuple(x) for x in long["runs"]] == [(0, 80_000, 2)] and long["collapsed"] == "x y" and long["carried"]["h"] == "x"
    assert runs.find_runs(spark, frame(spark, [])).collect() == []


# ------------------------------------------------------------------ toxicity

def labelled(spark, n, seed):
    """Toxic is an insult in the company of the group it is aimed at, and neither alone."""
    rng = random.Random(seed)
    insults, groups = ["grumblor", "snarvik", "plooter"], ["northers", "valefolk", "islanders"]
    docs, labels = [], []
    for i in range(n):
        words = [f"word{rng.randrange(400)}" for _ in range(rng.choice([8, 30, 60]))]
        a, b, kind = rng.randrange(3), rng.randrange(3), rng.randrange(4)
        b = a if kind == 1 else b
        words += [insults[a], groups[b]] if kind < 2 else [rng.choice([insults[a], groups[b]])] if kind == 2 else []
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(kind < 2 and a == b), None, "x"))
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int, quality int, text string")


def test_toxicity_learns_pairs(spark):
    docs, labels = labelled(spark, 3000, 5)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    sample = toxicity.sample(spark, frame(spark, docs), labels)
    assert {zlib.crc32(str(i).encode()) % 4 == 2 for i, _ in docs} == {True, False}

    def accuracy(model):
        rows = toxicity.classify(spark, frame(spark, docs), model=model, limit=0.5).where("held_out").collect()
        assert len(rows) > 500 and all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
        return sum(r["predicted"] == truth[r["doc_id"]] for r in rows) / len(rows)

    both, alone = accuracy(toxicity.train(sample)), accuracy(toxicity.train(sample, pairs=False))
    assert both > 0.93 and both > alone + 0.1, (both, alone)


def test_toxicity_edges(spark):
    docs, labels = labelled(spark, 400, 6)
    odd = [(900, None), (901, ""), (902, " .,"), (903, "word1 " * 30_000), (904, "nowhere seen"), (None, docs[0][1]), docs[3], docs[3]]
    marks = labels.union(spark.createDataFrame([(900, 1, None, ""), (1, None, None, ""), (None, 1, None, ""), (2, 1, None, ""), (7777, 0, None, "")],
                                               labels.schema))
    got = toxicity.classify(spark, frame(spark, docs + odd), marks, carry=["h"]).collect()
    assert len(got) == len(docs) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["score"])
    assert len(by[docs[3][0]]) == 1 and len(by[900] | by[901] | by[902] | by[904]) == 1
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {False} and got[0]["carried"]["h"] == "x"
    empty = spark.createDataFrame([], labels.schema)
    assert {r["score"] for r in toxicity.classify(spark, frame(spark, docs), empty).collect()} == {toxicity._logistic(np.array([-40.0]))[0]}
    ones = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.classify(spark, frame(spark, docs), ones).collect()} == {1}
    assert toxicity.classify(spark, frame(spark, []), labels).collect() == []
