"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is read as one flat sequence of text blocks; block-level tags end a block, inline
tags don't. A block's features are its word count and link density, those of the blocks
before and after it, and what its surroundings say: whether the innermost telling element
around it (by tag, role, class or id) is one of page furniture or of an article, whether it
is a heading or a list item, and whether the page marks an article at all. A decision tree,
grown by Gini impurity on a small labelled table, keeps or drops the block.

The labelled table is made by rule: page parts of known label (``PARTS``) in a fixed order
of shuffles and lengths, read by the same block reader.

Whole pages are read, without limits. Scripts, styles, comments and other raw elements are
no text, nor are closed elements like svg or video, from start tag to their own end tag. Markup
may be broken: unclosed elements end with their parent, a stray end tag is ignored, an unfinished
tag at the end of the page is dropped, and text after it is none. An unclosed element runs to
the end of the page only where HTML says so (``RAW``); others, and those that merely have such
a name in front (svg-icon), are read like any element. Self-closed svg and math are empty.

Defined results: null, empty or text-free pages have an empty text. Rows that repeat get
their own rows.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import apply_runtime_conf
from .components import pick

# Elements by what they mean for the text.
RAW = set("script style title iframe".split())
SKIPPED = "noscript template svg math object canvas audio video".split()
FOREIGN = {"svg", "math"}
INLINE = set("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong
sub sup time tt u var wbr""".split())
FURNITURE_TAGS = set("nav footer aside form menu button select option textarea label fieldset legend dialog input".split())
ARTICLE_TAGS = {"article", "main"}
CONTAINERS = set("""html body div section article main header footer nav aside form menu ul ol dl table tbody thead tfoot tr td th
figure figcaption blockquote details summary dialog fieldset select textarea button label legend center address hgroup""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
FURNITURE_WORDS = set("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist
consent cookie cookies disclaimer discussion disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter
notice notification outbrain overlay pager pagination popup promo promoted promotion recommended related replies reply respond share
sharing sidebar signup skip social sponsor sponsored subscribe taboola tags toolbar topbar tracking widget""".split())
ARTICLE_WORDS = set("article articlebody body content entry main maincontent post postbody story text".split())

COMMENT_WORDS = set("comment comments commentlist discussion disqus replies reply respond".split())
#: Names that say what a page has, not what the element is.
_MODIFIER = re.compile(r"(?:has|with|without|no|is|hide|show)[-_].*|.*[-_](?:enabled|disabled|open|closed)", re.I)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes2>[^>]*)>"
    r"|<[!?][^>]*>"
    r"|<[/a-zA-Z!?][^<>]*\Z", re.S | re.I)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
_UNQUOTED = re.compile(r"=\s*[^\s\"'=<>`]+\Z")     # an unquoted value, a slash at its end included
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")


def _cue(tag: str, attributes: str, in_article: bool) -> int:
    """What an element says of the text inside: -1 furniture, 1 article, 0 nothing."""
    if tag in FURNITURE_TAGS:
        return -1
    said = 0
    if attributes:
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" \
                    or name == "style" and "display:none" in value.lower().replace(" ", ""):
                return -1
            if name == "role":
                if value.lower() in FURNITURE_ROLES:
                    return -1
                said = 1 if value.lower() in ("main", "article") else said
            elif name in ("class", "id", "itemprop") and tag not in ("html", "body"):
                for own in value.split():
                    words = [w.lower() for w in _CAMEL.split(own) if w]
                    if not words or _MODIFIER.fullmatch(own):
                        continue
                    if tag in ARTICLE_TAGS:          # its own tag says more, unless it is a reader's comment
                        if words[0] in COMMENT_WORDS:
                            return -1
                        continue
                    telling = FURNITURE_WORDS.intersection(words)
                    of_article = bool(ARTICLE_WORDS.intersection(words))
                    if telling == {"header"} and (of_article or in_article):
                        said = 1                     # an article's own header
                    elif telling:
                        return -1
                    elif of_article:
                        said = 1
    if tag == "header":
        return 0 if in_article else -1       # a page header, or an article's own
    return 1 if tag in ARTICLE_TAGS else said


@dataclass
class BlockText:
    text: str
    words: int
    links: int
    cue: int
    heading: int
    item: int
    extra: dict = field(default_factory=dict)


def _tokens(page: str) -> list[tuple[int, int, re.Match, bool]]:
    """The page's markup in order: (start, end, match, gone); one that is ``gone`` is a whole
    element that is no text. End tags go to the nearest open start tag of their name."""
    out: list[tuple[int, int, re.Match, bool]] = []
    opened: dict[str, list[int]] = {tag: [] for tag in SKIPPED}
    at = 0
    while token := _TOKEN.search(page, at):
        start, at = token.span()
        tag, attributes, gone = (token["tag"] or "").lower(), token["attributes"] or "", False
        if (tag in RAW or tag in opened) and (not attributes or attributes[0] in " \t\n\f\r/"):
            empty = attributes.endswith("/") and not _UNQUOTED.search(attributes)
            inside = opened["svg"] or opened["math"]
            if token["end"]:
                if opened.get(tag):
                    first, gone = opened[tag][-1], True
                    start = out[first][0]
                    del out[first:]
                    for left in opened.values():
                        while left and left[-1] >= first:
                            left.pop()
            elif tag in RAW and not (empty and inside):
                end, gone = _RAW_END[tag].search(page, at), True
                at = end.end() if end else len(page)
            elif tag in opened and not (empty and (tag in FOREIGN or inside)):
                opened[tag].append(len(out))
        out.append((start, at, token, gone))
    return out


def blocks(page: str) -> list[BlockText]:
    """The text blocks of a page, in order."""
    out: list[BlockText] = []
    stack: list[tuple[str, int]] = []
    pieces: list[str] = []
    linked: list[str] = []
    in_link = 0
    heading = item = 0

    def close():
        nonlocal pieces, linked
        text = " ".join(html.unescape("".join(pieces)).split()) if pieces else ""
        if text:
            cue = next((c for _, c in reversed(stack) if c), 0)
            n_links = len(html.unescape(" ".join(linked)).split())
            words = text.count(" ") + 1
            out.append(BlockText(text, words, min(n_links, words), cue, heading, item))
        pieces, linked = [], []

    def data(piece: str):
        if piece:
            pieces.append(piece)
            if in_link:
                linked.append(piece)

    at = 0
    for start, end, token, gone in _tokens(page):
        data(page[at:start])
        at = end
        tag = (token["tag"] or token["tag2"] or "").lower()
        if not tag or gone:
            if gone:
                close()
            continue
        ends = bool(token["end"] or token["end2"])
        if tag == "br":
            pieces.append(" ")
        elif tag == "a":
            in_link = 0 if ends else 1
        elif tag not in INLINE:
            close()
            in_link = in_link if tag not in CONTAINERS else 0
            heading = int(not ends) if tag in ("h1", "h2", "h3", "h4", "h5", "h6") else 0
            item = int(not ends) if tag in ("li", "dt", "dd") else (item if ends and tag not in ("ul", "ol", "dl") else 0)
            if tag in CONTAINERS and not token.group().endswith("/>"):
                if not ends:
                    attributes = token["attributes"] or token["attributes2"] or ""
                    stack.append((tag, _cue(tag, attributes, any(c > 0 for _, c in stack))))
                elif any(t == tag for t, _ in stack):
                    while stack.pop()[0] != tag:
                        pass
    data(page[at:])
    close()
    return out


FEATURES = ["words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
            "furniture", "article", "heading", "item", "marked"]


def features(found: list[BlockText]) -> np.ndarray:
    n = len(found)
    x = np.zeros((n, len(FEATURES)))
    if not n:
        return x
    words = np.array([b.words for b in found], dtype=float)
    density = np.array([b.links for b in found]) / words
    x[:, 0], x[:, 1] = words, density
    x[1:, 2], x[1:, 3] = words[:-1], density[:-1]
    x[:-1, 4], x[:-1, 5] = words[1:], density[1:]
    cue = np.array([b.cue for b in found])
    x[:, 6], x[:, 7] = cue < 0, cue > 0
    x[:, 8], x[:, 9] = [b.heading for b in found], [b.item for b in found]
    x[:, 10] = (cue > 0).any()
    return x


# The labelled parts: (label, HTML with {n} for so many words, [n] for so many linked words).
PARTS: list[tuple[int, str]] = [
    (0, "<nav><ul><li>[1]</li><li>[2]</li><li>[1]</li></ul></nav>"),
    (0, "<div class='menu'><a href='/'>[3]</a> | [2] | [1]</div>"),
    (0, "<ul><li>[2]</li><li>[4]</li><li>[3]</li></ul>"),
    (0, "<header><div>{3}</div><p>{9}</p></header>"),
    (0, "<div class='ad'>{12}</div>"),
    (0, "<div class='ad-box'>{45}</div>"),
    (0, "<div id='cookie-notice'><p>{30}</p><button>{2}</button></div>"),
    (0, "<aside><h3>{3}</h3><p>{25}</p><ul><li>[6]</li></ul></aside>"),
    (0, "<div class='sidebar'><p>{60}</p></div>"),
    (0, "<form><label>{3}</label><p>{14}</p></form>"),
    (0, "<section id='comments'><h3>{2}</h3><p>{35}</p><p>{80}</p><p>{5}</p></section>"),
    (0, "<div class='comment-list'><div class='comment'>{22}</div></div>"),
    (0, "<footer>{4} [2] {12}</footer>"),
    (0, "<footer><p>{50}</p></footer>"),
    (0, "<div class='share'>[1] [1] [1]</div>"),
    (0, "<div>[3] [4] [2]</div>"),
    (0, "<div>[8] [9] {2} [12] [10]</div>"),
    (0, "<ul><li>[18]</li><li>[22]</li><li>[25]</li></ul>"),
    (0, "<p>{6} [14] {3} [12]</p>"),
    (0, "<div>{3}</div>"),
    (0, "<p>{4} [3]</p>"),
]
#: Furniture without a telling element; only beside an article that is marked as such.
UNMARKED: list[str] = ["<div>{40}</div>", "<div><p>{25}</p><p>{60}</p></div>", "<p>{14}</p>"]
ARTICLES: list[str] = [
    "<article><h1>{7}</h1><p>{60}</p><p>{3}</p><p>{120}</p></article>",
    "<article><h1>{6}</h1><p><b>{30}<br><p>{45}</p><p>{1}</p></article>",
    "<article><header><h1>{5}</h1></header><p>{25} [3] {30}</p><ul><li>{8}</li><li>{12}</li></ul></article>",
    "<main><h2>{4}</h2><p>{70}</p><blockquote>{20}</blockquote><p>{9}</p></main>",
    "<div class='content'><h1>{6}</h1><p>{40}</p><p>{15} [2] {10}</p><p>{2}</p></div>",
    "<div class='post-body'>{33}<br>{50}<p>{5}</p></div>",
    "<div><h1>{6}</h1><p>{55}</p><p>{80}</p><p>{35} [2]</p></div>",
    "<h1>{8}</h1><p>{90}</p><p>{28}</p><p>{64}</p>",
    "<table><tr><td>{70}</td></tr><tr><td>{45}</td></tr></table>",
    "<div><p>{80}</p><p>{6}</p><p>{75}</p><p>{4}</p><p>{60}</p></div>",
    "<article><p>{30}</p><p>[3] {2}</p><p>{4} [5]</p><p>{40}</p></article>",
]


def _written(part: str, rng: random.Random) -> str:
    def words(n: str) -> str:
        k = max(1, round(int(n) * rng.uniform(0.6, 1.5)))
        return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(k))

    part = re.sub(r"\[(\d+)\]", lambda m: f"<a href='#'>{words(m[1])}</a>", part)
    return re.sub(r"\{(\d+)\}", lambda m: words(m[1]), part)


def labelled_table(pages: int = 240, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of made pages, in a fixed order."""
    rng = random.Random(seed)
    xs, ys = [], []
    for i in range(pages):
        parts = [p for p in rng.sample(PARTS, rng.randint(2, 7))]
        article = (1, ARTICLES[i % len(ARTICLES)])
        if blocks(_written(article[1], random.Random(0)))[0].cue > 0:
            parts += [(0, part) for part in rng.sample(UNMARKED, rng.randint(0, 2))]
            rng.shuffle(parts)
        cut = rng.randint(0, len(parts))
        page, labels = "", []
        for label, part in [*parts[:cut], article, *parts[cut:]]:
            one = _written(part, rng)
            labels += [label] * len(blocks(one))
            page += f"<div>{one}</div>" if label else one
        found = blocks(f"<html><body>{page}</body></html>")
        if len(found) == len(labels):
            xs.append(features(found))
            ys += labels
    return np.concatenate(xs), np.array(ys)


@dataclass
class Node:
    keep: bool
    feature: int = -1
    limit: float = 0.0
    low: "Node | None" = None
    high: "Node | None" = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 4) -> Node:
    """A decision tree: the split with the least weighted Gini impurity, ties to the first."""
    node = Node(bool(y.mean() >= 0.5))
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return node
    best = (2 * y.mean() * (1 - y.mean()) * len(y) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        left, right = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(y) - n)
        cost = 2 * (n * left * (1 - left) + (len(y) - n) * right * (1 - right))
        cost[(v[1:] == v[:-1]) | (n < least) | (len(y) - n < least)] = np.inf
        i = int(np.argmin(cost))
        if cost[i] < best[0]:
            best = (float(cost[i]), f, float((v[i] + v[i + 1]) / 2))
    if best[1] < 0:
        return node
    below = x[:, best[1]] <= best[2]
    node.feature, node.limit = best[1], best[2]
    node.low, node.high = grow(x[below], y[below], depth - 1, least), grow(x[~below], y[~below], depth - 1, least)
    return node


def classify(tree: Node, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), dtype=bool)

    def walk(node: Node, rows: np.ndarray):
        if node.feature < 0:
            out[rows] = node.keep
        elif len(rows):
            below = x[rows, node.feature] <= node.limit
            walk(node.low, rows[below])
            walk(node.high, rows[~below])

    walk(tree, np.arange(len(x)))
    return out


def main_text(page: str | None, tree: Node) -> str:
    found = blocks(page) if page else []
    if not found:
        return ""
    return " ".join(b.text for b, keep in zip(found, classify(tree, features(found))) if keep)


def extract(spark: SparkSession, pages: DataFrame, tree: Node | None = None) -> DataFrame:
    """pages(page_id, url, html) -> (page_id, url, text, n_chars)."""
    apply_runtime_conf(spark)
    shared = spark.sparkContext.broadcast(tree or grow(*labelled_table()))

    def read(rows):
        for batch in rows:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [main_text(page, shared.value) for page in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_pydict({
                    "page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(texts, pa.string()),
                    "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return pick(pages, page_id="long", url="string", html="string").mapInArrow(
        read, "page_id long, url string, text string, n_chars long")
