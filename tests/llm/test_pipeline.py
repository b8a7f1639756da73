"""The corpus pipeline, stage by stage against brute force on the stage's own input."""

import hashlib

import numpy as np
import pytest

from tests.llm.test_pairs_and_spans import ALNUM, ascii_lower, brute_hits, brute_removed, shingles
from tests.llm.test_tokens import ids_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Inputs and outputs of each stage: the small documents and some planted rows."""
    import corpus_pipeline as c
    from reelspark.llm.components import written
    from reelspark.sources.tables import table

    docs = table(spark, SF, "documents")
    first = {r["doc_id"]: r["text"] for r in docs.collect()}
    long = max(first.values(), key=len)
    item = next(r["text"] for r in table(spark, SF, "benchmark").collect() if len(r["text"].split()) > 15)
    words = long.split()
    planted = [(9000, long), (9001, " ".join(words[:-3])), (9002, None), (9003, "12 !!"), (9004, item), (9005, " ".join(f"the{i}n and" for i in range(60)) + " " + item),
               (9006, " ".join(f"the{i}er of" for i in range(80)) + " " + " ".join(words[100:180]))]
    docs = docs.select(*c.COLUMNS).union(spark.createDataFrame(
        [(i, t, "en", "planted", len(t or "")) for i, t in planted], "doc_id long, text string, lang string, source string, n_chars long"))
    out = [("documents", docs)]
    for name, stage in c.STAGES:
        out.append((name, written(spark, stage(spark, out[-1][1], SF), f"test-{name}")))
    return {name: df for name, df in out}


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_and_lengths(stages):
    names = list(stages)
    for name in names[1:-1]:
        assert stages[name].columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert all(r["n_chars"] == len(r["text"]) for r in stages[name].collect())


def test_language_stage_keeps_clean_documents(stages):
    before, after = texts(stages["documents"]), texts(stages["language_id"])
    assert before.keys() - after.keys() == {9002, 9003}
    assert all(before[i] == t for i, t in after.items())


def test_one_of_each_group_stays(stages):
    before, after = texts(stages["language_id"]), texts(stages["jaccard_join"])
    sets = {i: shingles(t, 5) for i, t in before.items()}
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert after == {i: t for i, t in before.items() if find(i) == i}
    assert not {9000, 9001} & after.keys()


def test_repeated_passages_go(stages):
    before, after = texts(stages["jaccard_join"]), texts(stages["substring_dedup"])
    want = brute_removed(list(before.items()), 50)
    for i, (n, gone, digest) in want.items():
        if n and gone == n:
            assert i not in after
        elif gone:
            assert hashlib.sha256(after[i].encode()).hexdigest() == digest
        else:
            assert after[i] == before[i]
    assert want[9006][1] >= 80


def test_benchmark_passages_go(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = texts(stages["substring_dedup"]), texts(stages["decontaminate"])
    hits = {i: (n, h) for i, n, h, *_ in brute_hits(list(before.items()), items, 10)}
    for i, (n, h) in hits.items():
        if not h:
            assert after[i] == before[i]
        elif h > 0.5 * n:
            assert i not in after
        else:
            assert len(ALNUM.findall(ascii_lower(after[i]))) == n - h
    assert 9004 not in after and hits[9005][1] > 0


def test_everything_left_is_packed(stages):
    left = texts(stages["decontaminate"])
    packed = stages["best_fit_packing"].collect()
    assert sum(r["length"] for r in packed) == sum(len(ids_of(t)) + 1 for t in left.values())
    fill = {}
    for r in packed:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 4096 and len(fill) <= -(-sum(fill.values()) // 4096) + 1
    assert {r["doc_id"] for r in packed} == set(left) and np.all([r["start"] == 4096 * r["piece"] for r in packed])


def test_texts_that_share_an_id(spark):
    """Merged sources: ids that name several texts, some linked, some with repeated passages."""
    import corpus_pipeline as c

    def text(name, n=60):
        return " ".join(f"{name}{i}" for i in range(n))

    passage, near = text("p"), text("a", 59) + " changed"
    rows = [(1, text("a")), (1, text("b")), (2, text("c")), (2, near), (2, near), (3, text("d")), (3, text("e")),
            (4, text("f", 80)), (5, passage), (6, f"{text('g', 70)} {passage}"), (6, f"{text('h', 80)} {text('i', 30)}"),
            (7, f"{passage} {text('j', 30)}"), (7, f"{text('k', 20)} {passage}"), (8, None), (8, ""), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = sorted({r for r in rows if r != (2, near)}, key=str)
    stay = c.jaccard_join(spark, docs, SF)
    assert sorted(((r["doc_id"], r["text"]) for r in stay.collect()), key=str) == want
    cut = sorted(((r["doc_id"], r["text"]) for r in c.substring_dedup(spark, stay, SF).collect()), key=str)
    left = {(6, f"{text('g', 70)} {passage}"): (6, text("g", 70)), (7, f"{passage} {text('j', 30)}"): (7, text("j", 30)),
            (7, f"{text('k', 20)} {passage}"): (7, text("k", 20))}
    assert cut == sorted((left.get(r, r) for r in want), key=str)
