"""Jaccard join, substring dedup and decontamination against brute force."""

import hashlib
import random
import re

import pytest

from reelspark.llm import decontaminate, jaccard, substring

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, n int, h string, TEXT string, component string"


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None, "x", "other", None) for i, t in rows], DOCS)


def corpus(seed, vocabulary=9):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["É", "A,b"]

    def text(n):
        return rng.choice([" ", "  ", "\n"]).join(rng.choice(words) for _ in range(n))

    texts = [text(rng.choice([1, 3, 4, 5, 6, 12, 30])) for _ in range(40)]
    for _ in range(30):
        base = rng.choice(texts).split()
        if len(base) > 3:
            base[rng.randrange(len(base))] = "edit"
        texts.append(" ".join(base))
    texts += [texts[0]] * 5 + [texts[5].upper(), None, "", " \t\n", texts[3], text(6000)]
    rng.shuffle(texts)
    ids = rng.sample(range(-50, 500), len(texts))
    return list(zip(ids, texts))


def shingles(t, k):
    w = SPACED.findall(ascii_lower(t or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, seed):
    rows = corpus(seed)
    sets = {i: shingles(t, 2) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = {i: (len(s), find(i)) for i, s in sets.items()}
    got = jaccard.link_documents(spark, frame(spark, rows), k=2, percent=75, sketch_bits=12).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_jaccard_hot_group_and_edges(spark):
    base = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(300):                       # near copies of one text, in a third of all rows
        own = list(base)
        own[i % 60] = f"x{i}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(f"u{i}_{j}" for j in range(40))) for i in range(600)]
    rows += [(2000, rows[0][1]), (2000, rows[0][1]), (None, rows[0][1]), (None, None), (3000, None)]
    got = jaccard.link_documents(spark, frame(spark, rows), sketch_bits=14).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"]))
    assert all(by[i][0][1] == 0 for i in range(300)) and [c for _, c in by[2000]] == [0, 0]
    assert all(by[1000 + i] == [(36, 1000 + i)] for i in range(600))
    assert sorted(by[None]) == [(0, None), (56, None)] and by[3000] == [(0, 3000)]
    assert jaccard.link_documents(spark, frame(spark, []), sketch_bits=12).collect() == []


def brute_removed(rows, width):
    words = {i: SPACED.findall(t or "") for i, t in rows}
    first = {}
    for i in sorted(k for k in words if k is not None):
        for j in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][j:j + width]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        if i is not None:
            for j in range(len(w) - width + 1):
                if first[tuple(w[j:j + width])] < i:
                    gone.update(range(j, j + width))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed,width,gram", [(3, 6, 3), (4, 5, 5), (5, 12, 2)])
def test_substring_removal(spark, seed, width, gram):
    rows = corpus(seed, vocabulary=4)
    shared = " ".join(f"p{i}" for i in range(20))
    rows += [(900 + i, f"a{i} {shared} b{i}") for i in range(20)] + [(None, shared)]
    got = substring.remove_repeats(spark, frame(spark, rows), width=width, gram=gram, bits=16, id_bits=10, carry=["h"]).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == brute_removed(rows, width)
    texts = dict(rows)
    for r in got:
        assert r["carried"]["h"] == "x"
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
        if not r["n_removed"]:
            assert r["text"] == texts[r["doc_id"]]
        else:
            assert hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"]


def test_substring_edges(spark):
    assert substring.remove_repeats(spark, frame(spark, []), bits=12, id_bits=10).collect() == []
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, long), (2, long), (3, "short"), (3, "short"), (4, None)]
    got = {r["doc_id"]: r for r in substring.remove_repeats(spark, frame(spark, rows), bits=20, id_bits=10).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] == 30_000 and got[2]["text"] == ""
    assert [(s["start"], s["end"]) for s in got[2]["spans"]] == [(0, 30_000)] and got[3]["n_removed"] == 0


def thue_morse(n, a, b):
    return [b if bin(i).count("1") % 2 else a for i in range(n)]


def test_regular_sequences_differ(spark):
    """Texts on which polynomial hashes modulo 2 ** 64 collide: one long word, and two words in turn."""
    letters = ["".join(thue_morse(4096, x, y)) for x, y in ("ab", "ba")]
    words = [" ".join(thue_morse(4096, x, y)) for x, y in (("x", "y"), ("y", "x"))]
    rows = [(1, letters[0]), (2, letters[1]), (3, words[0]), (4, words[1])]
    assert {r["component_id"] for r in jaccard.link_documents(spark, frame(spark, rows[:2])).collect()} == {1, 2}
    hits = decontaminate.digest(decontaminate.find_hits(spark, frame(spark, rows[:2]), benchmark_items(spark, [(9, letters[0])])))
    assert {r["doc_id"]: r["contaminated"] for r in hits.collect()} == {1: True, 2: False}
    from reelspark.llm.words import batches
    import pyarrow as pa

    _, _, found = next(batches(pa.array([t for _, t in rows])))
    assert len({found.whole(d) for d in range(4)}) == 4
    cut = found.spans(found.bounds[2:4], found.bounds[2:4] + 2048)
    assert cut[0] != cut[1] and found.whole(2) == found.spans(found.bounds[2:3], found.bounds[3:4])[0]


def brute_hits(docs, items, width):
    windows = set()
    for item, t in items:
        w = ALNUM.findall(ascii_lower(t or ""))
        if w:
            n = min(width, len(w))
            windows |= {(tuple(w[i:i + n]), item) for i in range(len(w) - n + 1)}
    out = []
    for i, t in docs:
        w = ALNUM.findall(ascii_lower(t or ""))
        hit, found = set(), set()
        for seq, item in windows:
            for j in range(len(w) - len(seq) + 1):
                if tuple(w[j:j + len(seq)]) == seq:
                    hit.update(range(j, j + len(seq)))
                    found.add(item)
        named = ",".join(sorted(str(item) for item in found if item is not None))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(named.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def benchmark_items(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, n_words string")


@pytest.mark.parametrize("seed,width,limit", [(6, 4, 50_000), (7, 3, 12), (8, 10, 30)])
def test_decontamination_hits(spark, monkeypatch, seed, width, limit):
    rng = random.Random(seed)
    docs = corpus(seed, vocabulary=5)
    items = [(i, " ".join(rng.choice(["w0", "W1", "w2,", "w3", "É", "w4"]) for _ in range(rng.choice([1, 2, 3, 5, 14]))))
             for i in range(12)]
    if seed == 8:
        items = [(i, t) for i, t in items if len(t.split()) > 3]
    items += [(50, docs[4][1]), (51, docs[4][1]), (50, items[0][1]), (None, "w0 w1"), (60, None), (61, " ., ")]
    monkeypatch.setattr(decontaminate.blocks_of, "__defaults__", (limit,))
    hits = decontaminate.find_hits(spark, frame(spark, docs), benchmark_items(spark, items), width=width)
    got = sorted((tuple(r) for r in decontaminate.digest(hits).collect()), key=str)
    assert got == brute_hits(docs, items, width)


def test_decontamination_removal(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    clean = "one two three, four.\nfive six seven eight nine ten eleven"
    docs = [(1, f"Before this. {item.upper()}! After that, {clean}"), (2, clean), (3, item), (4, None), (5, ""), (None, clean)]
    out = {r["doc_id"]: r for r in decontaminate.remove_hits(
        spark, frame(spark, docs), benchmark_items(spark, [(7, item)]), carry=["h"]).collect()}
    assert set(out) == {1, 2, 4, 5, None}
    assert out[1]["text"].startswith("Before this. ! After that, one two") and out[1]["n_hit"] == 11
    assert out[2]["text"] == clean and out[4]["text"] is None and out[5]["text"] == "" and out[2]["carried"]["h"] == "x"
    none = decontaminate.digest(decontaminate.find_hits(spark, frame(spark, docs), benchmark_items(spark, []))).collect()
    assert len(none) == 6 and not any(r["contaminated"] for r in none)
    assert decontaminate.find_hits(spark, frame(spark, []), benchmark_items(spark, [(7, item)])).collect() == []


def test_decontamination_items_without_id(spark, monkeypatch):
    windows = ["alpha beta gamma delta", "epsilon zeta eta theta"]
    docs = [(1, f"x {windows[0]} y"), (2, f"{windows[1]} and {windows[0]}"), (3, "x y"), (4, f"kappa lambda mu nu {windows[0]}")]
    items = [(None, windows[0]), (None, windows[1]), (7, "kappa lambda mu nu")]
    for limit in (50_000, 4):
        monkeypatch.setattr(decontaminate.blocks_of, "__defaults__", (limit,))
        hits = decontaminate.find_hits(spark, frame(spark, docs), benchmark_items(spark, items), width=4)
        assert {r["doc_id"]: r["items"] for r in hits.collect()} == {1: [None], 2: [None], 3: [], 4: ["7", None]}
        got = {r["doc_id"]: r for r in decontaminate.digest(hits).collect()}
        assert {i: (r["n_hit"], r["n_items"], r["contaminated"]) for i, r in got.items()} == {
            1: (4, 1, True), 2: (8, 1, True), 3: (0, 0, False), 4: (8, 2, True)}
        assert got[1]["items_sha256"] == hashlib.sha256(b"").hexdigest() and got[4]["items_sha256"] == hashlib.sha256(b"7").hexdigest()
    kept = decontaminate.remove_hits(spark, frame(spark, docs), benchmark_items(spark, items), width=4, max_coverage=0.7)
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == {1: "x y", 3: "x y"}
