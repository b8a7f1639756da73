"""Sharding, main text, nearest neighbours, language ID and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.llm import ann, html_text, langid, sharding

DOCS = "doc_id long, text string, lang string, shard int, row long, Score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, None, 7, "x") for i, t, g in rows], DOCS)


def check_shards(rows, got, n_shards):
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == sorted(
        ((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows), key=str)
    sizes = [sorted(r["slot"] for r in got if r["shard"] == s) for s in range(n_shards)]
    assert all(s == list(range(len(s))) for s in sizes) and sum(map(len, sizes)) == len(rows)
    assert max(map(len, sizes)) - min(map(len, sizes)) <= 1
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in got)


def test_shards_keep_groups_together(spark):
    rng = random.Random(5)
    texts = [f"single {i}" for i in range(300)]
    for g in range(60):
        texts += [f"group {g}"] * rng.randint(2, 9)
    texts += [None, None, "", ""]
    rng.shuffle(texts)
    rows = [(i if i % 50 else None, t, "en") for i, t in enumerate(texts)]
    got = sharding.shard_documents(spark, frame(spark, rows), 8).collect()
    check_shards(rows, got, 8)
    of = {}
    for r in got:
        of.setdefault(r["text_crc32"], set()).add(r["shard"])
    split = [k for k, s in of.items() if len(s) > 1 and k != zlib.crc32(b"")]      # nulls are not linked
    assert not split


def test_shards_split_a_hot_group_over_few_shards(spark):
    texts = ["hot"] * 250 + [f"pair {i // 2}" for i in range(200)] + [f"one {i}" for i in range(303)]
    rows = [(i, t, None) for i, t in enumerate(texts)]
    got = sharding.shard_documents(spark, frame(spark, rows), 8).collect()
    check_shards(rows, got, 8)
    hot = {r["shard"] for r in got if r["text_crc32"] == zlib.crc32(b"hot")}
    assert len(hot) <= 4                       # 250 of 753 rows need at least three


@pytest.mark.parametrize("n", [0, 1, 5])
def test_shards_of_few_rows(spark, n):
    rows = [(i, "same", None) for i in range(n)]
    check_shards(rows, sharding.shard_documents(spark, frame(spark, rows), 8).collect(), 8)


def test_propagation_follows_links_of_any_kind(spark):
    rows = spark.range(200).select(F.col("id").alias("row"))
    links = rows.select("row", (F.col("row") / 5).cast("int").cast("string").alias("link")).union(
        rows.select("row", F.concat(F.lit("h"), (F.col("row") / 10).cast("int"))))
    got = {r["row"]: r["shard"] for r in sharding.propagate(spark, rows, links, 4).collect()}
    cut = sum(len({got.get(i, -i) for i in range(g, g + 5)}) > 1 for g in range(0, 200, 5))
    assert len(got) > 150 and cut <= 2 and max(list(got.values()).count(s) for s in range(4)) <= 50


PAGE = """<!DOCTYPE html><html><head><title>Site title</title><script>var t="</p>";if(a<b){x()}</script><style>p{margin:0}</style></head>
<body><header><div>Site name and a tagline</div></header><nav><ul><li><a href="/a">One</a></li><li><a href='/b>c'>Two</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies to make the site better for you and for everyone else who visits it.</p></div><!-- <p>no</p> -->
<div class="ad">Buy this very good thing now.</div><article><h1>A heading</h1><p><b>First</b>ly, caf&eacute; &amp; tea &lt;b&gt;<br>next
line.<p>Short.</p><form><label>Mail</label><button>Send</button></form><p>More <a href="#">linked</a> words follow here, quite a few of
them.</p></article><section id="comments"><p>Reader comment that is long enough to look like part of the article text.</p></section>
<aside><p>Sidebar words that are also long enough to look like text.</p></aside><footer>&copy; 2020 Site</footer></body></html>"""


def test_main_text(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 3), (2, None, None, 3), (3, "u", "", 3), (3, "u", "", 3), (4, "u", "<p", 3),
                                   (5, "u", "just some plain words without any markup at all", 3), (None, "u", PAGE[:1500], 3),
                                   (6, "u", "<div class='x'>" * 3000 + "<article><p>" + "word " * 50_000, 3)],
                                  "page_id long, url string, html string, text int")
    rows = html_text.extract(spark, pages).collect()
    got = {r["page_id"]: r for r in rows}
    want = "A heading Firstly, café & tea <b> next line. Short. More linked words follow here, quite a few of them."
    assert got[1]["text"] == want and got[1]["n_chars"] == len(want)
    assert got[2]["text"] == got[3]["text"] == got[4]["text"] == "" and len(rows) == 8
    assert got[5]["text"].startswith("just some plain")
    assert got[6]["n_chars"] == 250_000 - 1
    assert got[None]["text"].startswith("A heading Firstly")
    assert html_text.extract(spark, pages.where("page_id = 99")).collect() == []


def seen(page):
    return " ".join(b.text for b in html_text.blocks(page))


@pytest.mark.parametrize("before", [
    "<svg-icon name='x'></svg-icon>", "<video-player src='x'></video-player>", "<title-bar></title-bar>", "<svg_x>",
    "<svg width='1'/>", "<math/>", "<svg a=b />", "<svg><title/><path d='M0'/></svg>", "<svg><svg>no</svg>no</svg>",
    "<svg><path d='M0'>", "<video>", "<object data=http://a/b/>", "<template>", "<canvas>",
    "<svg><video>no</svg>", "<script>no('<svg>')</script>", "<svg class=a/>no</svg>", "<title>no</title x>"])
def test_text_after_elements_that_are_no_text(before):
    assert seen(f"<p>One</p>{before}<p>two</p>") == "One two"
    assert seen(f"{before}<article><p>One</p><svg>no</svg><video>no</video><p>two</p></article>") == "One two"


def test_raw_text_runs_to_the_end_when_unclosed():
    for tag in ("script", "style", "title", "iframe"):
        assert seen(f"<p>One</p><{tag}><p>two</p>") == "One"
    assert seen("<p>One</p>" + "<svg>" * 20_000 + "<p>two</p>") == "One two"


def test_tree_on_unseen_parts():
    tree = html_text.grow(*html_text.labelled_table())
    x, y = html_text.labelled_table(seed=99)
    assert (html_text.classify(tree, x) == y).mean() > 0.97


VECTORS = "vec_id long, embedding array<double>, score string, region string"


def exact(vectors, k):
    usable = {i: np.array(v) for i, v in vectors}
    out = {}
    for q, x in usable.items():
        if q % 20 == 0:
            scores = sorted(((-float(x @ y), i) for i, y in usable.items() if i != q))[:k]
            out[q] = [(i, -s) for s, i in scores]
    return out


@pytest.mark.parametrize("block_rows,scaled", [(16_384, False), (150, False), (150, True)])
def test_nearest(spark, block_rows, scaled):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 16))
    x = centres[rng.integers(0, 12, 1000)] + 0.4 * rng.standard_normal((1000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True) if not scaled else 1.0
    vectors = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] + [1.0] * 15), (2060, [1.0, 2.0]), (2080, [None] + [1.0] * 15),
           (2100, [float("inf")] + [1.0] * 15), (None, [1.0] * 16)]
    df = spark.createDataFrame([(i, v, "x", None) for i, v in vectors + bad], VECTORS)
    got = {}
    for r in sorted(ann.nearest(spark, df, df.where("vec_id % 20 = 0"), k=20, block_rows=block_rows).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = exact(vectors, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.95 * 20 * len(want)
    scores = {(q, i): float(x[q] @ x[i]) for q in want for i, _ in got[q]}
    assert all(abs(s - scores[q, i]) < 1e-12 for q in got for i, s in got[q])


def test_nearest_ties_and_few_rows(spark):
    rows = [(i, [1.0, 0.0], "x", None) for i in range(60)] + [(i, [0.0, 2.0], "x", None) for i in range(60, 63)] + [(60, [0.0, 2.0], "x", None)]
    df = spark.createDataFrame(rows, VECTORS)
    got = [tuple(r) for r in ann.nearest(spark, df, df.where("vec_id % 20 = 0"), k=20, block_rows=16).collect()]
    for q in (0, 20, 40):
        assert [v for _, _, v, _ in sorted(r for r in got if r[0] == q)] == [i for i in range(21) if i != q][:20]
    assert [(v, s) for _, _, v, s in sorted(r for r in got if r[0] == 60)][:2] == [(61, 4.0), (62, 4.0)]
    few = df.where("vec_id in (20, 61)")
    assert [tuple(r) for r in ann.nearest(spark, few, few.where("vec_id % 20 = 0")).collect()] == [(20, 1, 61, 0.0)]
    none = df.where("vec_id < 0")
    assert ann.nearest(spark, none, none).collect() == []


def test_chi_square_quantile():
    assert ann.chi_square_quantile(0.95, 2) == pytest.approx(5.991, abs=1e-3)
    assert ann.chi_square_quantile(0.99, 8) == pytest.approx(20.090, abs=1e-3)


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    english = next(t for _, t, g in rows if g == "en")
    extra = [(5000, None, "en"), (5001, "", "en"), (5002, "12 34 !!", "de"), (None, english, None), (5003, english * 400, None),
             (5004, "ß", None), (rows[0][0], rows[0][1], rows[0][2])]
    got = langid.classify(spark, frame(spark, rows + extra), carry=["Score"]).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r["doc_id"]: r for r in got}
    truth = {i: g for i, _, g in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert not any(r["rejected"] for r in held)
    assert all((by[i]["lang_pred"], by[i]["score"], by[i]["rejected"]) == ("und", 0.0, True) for i in (5000, 5001, 5002))
    assert by[None]["lang_pred"] == by[5003]["lang_pred"] == "en" and not by[None]["held_out"]
    assert by[5004]["lang_pred"] in {"de", "en", "es", "fr"} and all(0 <= r["score"] <= 1 for r in got)
    unlabelled = langid.classify(spark, frame(spark, [(1, "some words", None)])).collect()
    assert [(r["lang_pred"], r["rejected"]) for r in unlabelled] == [("und", True)]
    assert langid.classify(spark, frame(spark, [])).collect() == []


@pytest.mark.parametrize("page", [
    "<article class='post has-sidebar'><h1>The very title of it</h1><p>{}</p><p>{}</p></article>",
    "<main class='content with-sidebar'><h1>The very title of it</h1><p>{}</p><p>{}</p></main>",
    "<article class='story comment-enabled'><h1>The very title of it</h1><p>{}</p><p>{}</p></article>",
    "<article class='post tag-social category-ads'><h1>The very title of it</h1><p>{}</p><p>{}</p></article>",
    "<article><header class='entry-header'><h1>The very title of it</h1></header><p>{}</p><p>{}</p></article>",
    "<article><div class='article-header'><h1>The very title of it</h1></div><p>{}</p><p>{}</p></article>"])
def test_class_names_do_not_drop_articles(page):
    tree = html_text.grow(*html_text.labelled_table())
    a, b = " ".join(f"alpha{i}" for i in range(60)), " ".join(f"beta{i}" for i in range(40))
    comments = "<ol class='comment-list'><li><article class='comment-body'><p>I say something here about all that</p></article></li></ol>"
    nav = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>"
    got = html_text.main_text(f"<html><body class='has-sidebar'>{nav}{page.format(a, b)}{comments}"
                              f"<div class='sidebar-left'><p>{a.upper()}</p></div></body></html>", tree)
    assert got == f"The very title of it {a} {b}"
