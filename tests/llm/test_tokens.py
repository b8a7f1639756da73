"""Encoding, wavelet files, packing and section counts against the library and brute force."""

import itertools
import random
import zlib

import numpy as np
import pytest

from reelspark.llm import packing, token_counts, tokens, wavelet
from reelspark.llm.tokens import encoder

TEXTS = [
    None, "", "  \n", "plain words, and more words.", "A<|endoftext|>b <|STARTOFTEXT|>", "don't DON'T it's 'tis", "ÉÀ éà ß ẞ İ Σ ΑΣ.",
    "x\x85y\xa0z　w", "\x1c a\x1db a\x00b", "...,,. .,!? a.b,c. 12.5, 1st", "日本語 テスト。", "wórd İ K Å ﬁ ª² x².",
    "naïve, NAÏVE! naïve?! (naïve)", " ".join(f"Long{i}, text{i}" for i in range(9000)), "same", "same",
]
DOCS = "doc_id long, text string, ids binary, part string, Doc_Id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, "x") for i, t in rows], DOCS)


def ids_of(text):
    return encoder(None).full.encode(text or "", add_special_tokens=False).ids


def test_chunked_ids_are_the_librarys():
    e = encoder(None)
    got = e.encode([(t or "").encode() for t in TEXTS])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids_of(t) for t in TEXTS]


def test_wavelet_queries():
    rng = random.Random(3)
    for n, top in ((1, 1), (500, 7), (140_000, 49_000)):
        ids = np.array([rng.randrange(top) if rng.random() < 0.5 else rng.randrange(min(top, 5)) for _ in range(n)], dtype=np.uint32)
        f = wavelet.WaveletFile(wavelet.encode_shard(ids, [None, 9], np.array([n // 3, n - n // 3])))
        assert (f.tokens() == ids).all() and f.doc_ids == [None, 9]
        for i in [0, n - 1, *(rng.randrange(n) for _ in range(15))]:
            assert f.access(i) == ids[i]
        for t in {int(ids[0]), int(ids[-1]), top + 70_000, 0, 3}:
            at = np.flatnonzero(ids == t)
            a, b = sorted((rng.randrange(n + 1), rng.randrange(n + 1)))
            assert f.count(t) == len(at) and f.count(t, a, b) == int((ids[a:b] == t).sum())
            for k in {0, len(at) // 2, len(at) - 1} - {-1}:
                assert f.select(t, k) == (int(at[k]) if k < len(at) else None)
            assert f.select(t, len(at)) is None
    assert f.doc(0)[:20] == ids[:20].tolist()


def test_wavelet_round_trip(spark, tmp_path):
    rows = list(zip([5, 3, None, -2, 8, 9, 11, 12, 13, 14, 15, 16, 17, 100, 20, 20], TEXTS))
    path = f"file://{tmp_path}/shards"
    wavelet.write_shards(spark, frame(spark, rows), path, rows_per_part=4, shard_tokens=40)
    got = wavelet.read_documents(spark, path).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    start, want = 0, []
    for i, t in order:
        ids = np.array(ids_of(t) + [1], dtype="<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert wavelet.round_trip(spark, frame(spark, [])).collect() == []


def test_lower_bound_is_below_the_optimum():
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.choice([10, 12, 30])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 7))]

        def fits(n):
            return any(all(sum(x for x, b in zip(lengths, at) if b == k) <= capacity for k in range(n))
                       for at in itertools.product(range(n), repeat=len(lengths)))

        best = next(n for n in range(1, 8) if fits(n))
        bound = packing.lower_bound(np.array(lengths), capacity)
        bins, offsets, fill = packing.best_fit(np.array(lengths), capacity)
        assert -(-sum(lengths) // capacity) <= bound <= best <= len(fill)
        assert fill.max() <= capacity and fill.sum() == sum(lengths)
        for b in range(len(fill)):
            spans = sorted((o, o + n) for o, n, k in zip(offsets, lengths, bins) if k == b)
            assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
    assert packing.lower_bound(np.array([], dtype=np.int64), 10) == 0


def test_packing(spark):
    rng = random.Random(2)
    rows = list(enumerate(TEXTS)) + [(None, "no id")]
    rows += [(100 + i, " ".join(rng.choice(["aa", "bb", "cc"]) for _ in range(rng.randint(1, 60)))) for i in range(400)]
    rows += [(600, rows[30][1]), (600, rows[30][1])]
    got = packing.pack_documents(spark, frame(spark, rows), capacity=64, per_partition=60).collect()
    want = []
    for i, t in rows:
        ids = np.array(ids_of(t) + [1], dtype="<u4")
        for k in range(0, len(ids), 64):
            want.append((i, k // 64, k, len(ids[k:k + 64]), zlib.crc32(ids[k:k + 64].tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["bound"] <= r["bins"]
    for spans in bins.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]
        assert sum(n for _, n in spans) <= 64
    total = sum(w[3] for w in want)
    assert len(bins) <= -(-total // 64) * 1.02 + 1
    assert packing.pack_documents(spark, frame(spark, [])).collect() == []


def brute_counts(text, sections, rule):
    counts = {}
    for a, b in encoder(None).full.encode(text or "", add_special_tokens=False).offsets:
        parts = {k: min(b, y) - max(a, x) for k, (x, y) in enumerate(sections) if min(b, y) > max(a, x)}
        outside = b - a - sum(parts.values())
        if not parts:
            parts = {None: 1}
        elif rule == "majority":
            parts = {max(parts, key=lambda k: (parts[k], -k)): 1}
        elif rule == "start":
            parts = {next((k for k, (x, y) in enumerate(sections) if x <= a < y), None): 1}
        else:
            parts = {k: n / (b - a) for k, n in parts.items()} | ({None: outside / (b - a)} if outside else {})
        for k, w in parts.items():
            counts[k] = counts.get(k, 0) + w
    return counts


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_counts(spark, rule):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, "Hyperextraordinary straßenbahn\n\nüberlänge wörterbuch"), (None, "no id here")]
    got = {}
    for r in token_counts.attribute(spark, frame(spark, rows), rule=rule, max_chars=7).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert len(got) == len(rows)
    for i, t in rows:
        sections = token_counts.line_sections(t or "", 7)
        assert sum(r["n_tokens"] for r in got[i]) == pytest.approx(len(ids_of(t)))
        if i == 13:
            continue                        # the long text: its total is enough
        want = brute_counts(t, sections, rule)
        if not sections:
            assert [(r["section"], r["start"], r["end"], r["n_tokens"]) for r in got[i]] == [(0, 0, 0, 0.0)]
            continue
        assert {r["section"]: pytest.approx(r["n_tokens"]) for r in got[i] if r["n_tokens"]} == want
        assert [(r["start"], r["end"]) for r in sorted(got[i], key=lambda r: (r["section"] is None, r["section"]))
                if r["section"] is not None] == sections


def test_whole_offsets(monkeypatch):
    """Spans of one encoding with the library's normalizer, whatever the letters and the cuts."""
    e = encoder(None)
    texts = [t or "" for t in TEXTS] + ["Ünïted ÅNGSTRÖM\u00a0Žižek\u2003x", "İstanbul ΣΊΣΥΦΟΣ e\u0301té", "a <|endoftext|> b", " \n"]
    texts += ["".join(f"a{chr(c)}B{chr(c)}{chr(c)} " for c in range(first, first + 64)) for first in range(0, 0x2C0, 64)]
    for limit in (tokens.MAX_CHARS, 5):
        monkeypatch.setattr(tokens, "MAX_CHARS", limit)
        for t in texts[:13] + texts[14:] if limit == 5 else texts:
            want = e.full.encode(t, add_special_tokens=False).offsets
            assert [tuple(x) for x in e.spans(t).tolist()] == want


def test_overlapping_sections_and_empty_table(spark):
    """Characters of overlapping sections belong to the first of them."""
    rows = [(1, "one two three four five six")]
    spans = [(1, 0, 0, 13), (1, 1, 4, 8), (1, 2, 4, 18), (1, 3, 19, 27)]
    sections = spark.createDataFrame(spans, "doc_id long, section int, start long, end long")
    got = token_counts.attribute(spark, frame(spark, rows), sections).collect()
    want = brute_counts(rows[0][1], [(0, 13), (13, 13), (13, 18), (19, 27)], "majority")
    assert {r["section"]: r["n_tokens"] for r in got if r["n_tokens"]} == want
    assert [(r["start"], r["end"]) for r in got if r["section"] is not None] == [s[2:] for s in spans]
    assert token_counts.attribute(spark, frame(spark, []), sections).collect() == []
    assert token_counts.attribute(spark, frame(spark, [])).collect() == []


def test_given_sections(spark):
    rows = [(1, "Hyperextraordinary words stand here, überlang"), (2, "without sections"), (3, None)]
    spans = [(1, 7, 0, 5), (1, 8, 9, 24), (1, 9, 30, 900), (1, 5, 3, 3), (4, 0, 0, 9)]
    sections = spark.createDataFrame([(*s, "x") for s in spans], "doc_id long, section int, start long, end long, text string")
    for rule in token_counts.RULES:
        got = token_counts.attribute(spark, frame(spark, rows), sections, rule=rule).collect()
        want = brute_counts(rows[0][1], [(0, 5), (9, 24), (30, 45)], rule)
        have = {r["section"]: r["n_tokens"] for r in got if r["doc_id"] == 1 and r["n_tokens"]}
        assert have == {None if k is None else [7, 8, 9][k]: pytest.approx(v) for k, v in want.items()}
        assert [(r["section"], r["n_tokens"]) for r in got if r["doc_id"] == 2] == [(0, 0.0), (None, len(ids_of(rows[1][1])))]
    with pytest.raises(ValueError):
        token_counts.attribute(spark, frame(spark, rows), rule="other")


def test_packing_with_a_small_table_of_chunks_and_trimmed_tasks(spark, monkeypatch):
    """The bound of the encoder's table changes no row; a task ends by giving memory back, also when cut short."""
    from reelspark.functions import arrow

    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}, Ünder{j}" for j in range(60))) for i in range(40)], "doc_id long, text string")
    a, b = (sorted(tuple(r) for r in packing.pieces(docs, None, 4096, n).collect()) for n in (600_000, 50))
    assert a == b and len(a) == 40
    e = tokens.Encoder(None)
    e.max_chunks = 50
    for i in range(40):
        e.encode([f"one{i} two{i}".encode()])
    assert len(e.known) < 60
    calls = []
    monkeypatch.setattr(arrow.ctypes, "CDLL", lambda name: type("C", (), {"malloc_trim": staticmethod(calls.append)}))
    assert list(arrow.trimmed(lambda rows: (2 * x for x in rows))([1, 2])) == [2, 4] and calls == [0]
    cut = arrow.trimmed(lambda rows: iter(rows))([1, 2])
    assert next(cut) == 1
    cut.close()
    assert calls == [0, 0]
