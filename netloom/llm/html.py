"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read into blocks: runs of text between block-level tags, each with
its path in the document tree.  A logistic classifier over what a block looks
like (links, length, punctuation, place, depth, tag) gives each block its costs
as content and as boilerplate, which become the capacities from the source and
to the sink, with what the names of its containers say added; neighbours in
page order and blocks close in the tree are tied by smoothness edges.  The
maximum flow's cut is the cheapest labelling.

The classifier is trained here, from a bounded sample of pages: blocks whose
containers tell what they are are its labels, and those names are none of its
inputs.  The strength of the edges is fitted on the same pages, with the names
left out.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title select button".split())
BLOCK = set(
    "html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
ENDS_P = BLOCK - set("html body option td th tr tbody thead tfoot caption legend summary".split())
ALIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Containers, and words of class, id and role, that are not an article's text.
CHROME_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog"}
CHROME_WORDS = set(
    "ad ads advert adverts advertisement adsense banner breadcrumb breadcrumbs comment comments contentinfo cookie cookies copyright disclaimer disqus "
    "footer header masthead menu modal nav navbar navigation newsletter notice outbrain pager pagination paywall popup promo promoted promotion recommended "
    "related reply replies respond rss search share sharing sidebar signup skip social sponsor sponsored subscribe taboola tags toolbar widget complementary dialog "
    "consent gdpr login topbar discussion reader responses meta".split()
)
ARTICLE_WORDS = set("article articlebody main content story post entry body text".split())

#: Words of CHROME_WORDS that say nothing beside an article's word, as in search-story or post-tags-intro.
WEAK_WORDS = set("search tags meta text reader responses header promoted".split())

# an attribute's value is quoted or runs to white space; quotes elsewhere are characters like others
_VALUE = r"\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+"
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:{_VALUE})?|[\"'])*+)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(rf"([^\s=/>\"']++)(?:\s*+=\s*+({_VALUE}))?")
_NAMES = {"class", "id", "role", "aria-label"}
_WORD = re.compile(r"[a-z]+")

FEATURES = ("bias", "links", "heading", "long", "sentence", "short_item", "paragraph", "item", "commas", "digits", "place", "depth", "links_around")
#: What is believed of each feature before any page is seen, and how firmly.
PRIOR = np.array([0.3, -3.0, 0.6, 1.5, 0.8, -1.2, 0.5, -0.6, 0.5, -0.5, -0.3, 0.0, -1.0])
FIRMNESS = 20.0
#: What a container's name adds to a block's log odds: chrome tag, chrome word, header, article, article word, hidden.
EVIDENCE = np.array([-8.0, -8.0, -3.0, 4.0, 0.6, -10.0])
#: Pages, at most, that the classifier is trained on.
SAMPLE_PAGES = 500
#: Smoothness of neighbours in page order, and of blocks a number of tree steps apart (halved with each).
NEXT, NEAR = 0.6, 0.8
#: Strengths of the edges, of which the one that fits best is taken.
STRENGTHS = (0.25, 0.5, 1.0, 2.0, 4.0)


@dataclass
class Block:
    text: str
    linked: int
    depth: int  # of open elements
    shared: int  # how many of them stood open since the block before
    parents: tuple[int, ...]  # numbers of the parent and the one above it
    flags: tuple[bool, ...]  # chrome_tag, chrome_word, header, article, article_word, hidden
    tag: str


def _marks(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether the names of an element are of chrome, of an article, or hide it."""
    if "=" not in attributes and "hidden" not in attributes.lower():
        return False, False, False
    words, hidden = set(), False
    for name, value in _ATTR.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden":
            hidden = True
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "")
        elif name in _NAMES:
            words |= set(_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
    article = words & ARTICLE_WORDS
    return bool(words & (CHROME_WORDS - WEAK_WORDS if article - WEAK_WORDS else CHROME_WORDS)), bool(article), hidden


def blocks(page: str) -> list[Block]:
    """Text blocks of a page, in order, with references decoded and white space collapsed."""
    out: list[Block] = []
    stack: list[tuple[str, int, tuple[bool, ...]]] = []  # tag, number, flags of it and all above
    standing: Counter = Counter()  # open elements by tag
    held: list[str] = []
    unended: set[str] = set()  # raw tags that no end tag follows
    linked, number, at, low = 0, 0, 0, 0
    none = (False,) * 6

    def close_block() -> None:
        nonlocal linked, low
        if held:
            text = " ".join("".join(held).split())
            if text:
                tag = next((t for t, _, _ in reversed(stack) if t in BLOCK), "")
                out.append(Block(text, linked, len(stack), low, tuple(n for _, n, _ in reversed(stack[-3:-1])), stack[-1][2] if stack else none, tag))
                low = len(stack)
            held.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        text = entities.unescape(raw)
        held.append(text)
        if standing["a"]:
            linked += len(text.strip())

    def close(depth: int) -> None:
        """Ends the open elements from that depth on."""
        nonlocal low
        standing.subtract(t for t, _, _ in stack[depth:])
        del stack[depth:]
        low = min(low, depth)

    def innermost(tag: str) -> int | None:
        return next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag) if standing[tag] > 0 else None

    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            rest = page[at:]
            add(rest if not re.match(r"</?[a-zA-Z!]", rest) else "")
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCK:
                close_block()
            depth = innermost(tag)
            if depth is not None:
                close(depth)
            continue
        if tag in BLOCK:
            close_block()
        if tag in ENDS_P:
            depth = innermost("p")
            if depth is not None:
                close(depth)
        if tag in ALIKE and any(standing[t] > 0 for t in ALIKE[tag]):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ALIKE[tag]:
                    close(i)
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "select", "menu"):
                    break
        if tag in VOID:
            if tag in ("br", "hr"):
                held.append(" ")
            continue
        if tag in RAW:
            end = None if tag in unended else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if end:
                at = end.end()
            elif tag in ("script", "style", "title", "textarea"):  # these run to the page's end, others are taken as they come
                at = len(page)
            else:
                unended.add(tag)
            continue
        if m[3].endswith("/") and tag not in BLOCK:
            continue
        chrome, article, hidden = _marks(tag, m[3])
        above = stack[-1][2] if stack else none
        mine = (tag in CHROME_TAGS, chrome and tag not in ("body", "html", "article", "main"), tag == "header", tag in ("article", "main"), article, hidden)
        number += 1
        stack.append((tag, number, tuple(a or b for a, b in zip(above, mine))))
        standing[tag] += 1
    close_block()
    return out


def features(found: list[Block]) -> np.ndarray:
    """What each block looks like; nothing of it comes from the names of containers."""
    links = np.array([min(1.0, b.linked / len(b.text)) for b in found])
    padded = np.concatenate([links[:1], links, links[-1:]])
    rows = []
    for i, b in enumerate(found):
        n = len(b.text)
        short = n < 40 and b.tag in ("li", "td", "option", "")
        marks = min(1.0, 20 * sum(map(b.text.count, ",;")) / n)
        digits = sum(map(str.isdigit, b.text)) / n
        around = (padded[i] + padded[i + 2]) / 2
        rows.append((1, links[i], b.tag in HEADINGS, min(1.0, n / 200), b.text[-1] in ".!?…\"”»", short, b.tag == "p", b.tag in ("li", "dd", "dt"), marks, digits, i / len(found), min(1.0, b.depth / 20), around))
    return np.array(rows, float).reshape(len(rows), len(FEATURES))


def _teachers(found: list[Block], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose containers tell their label, and the labels."""
    flags = np.array([b.flags for b in found], bool).reshape(len(found), 6)
    chrome = flags[:, 0] | flags[:, 1] | flags[:, 5]
    article = flags[:, 3] & ~chrome & ~flags[:, 2] & (x[:, 1] < 0.5)
    rows = np.flatnonzero(chrome | article)
    return rows, article[rows].astype(float)


def train(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression towards PRIOR, by Newton's method."""
    w = PRIOR.copy()
    if len(y):
        scale = FIRMNESS * len(FEATURES) / max(len(y), 1) + 0.02  # a large sample speaks louder, never alone
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (p - y) / len(y) + scale * (w - PRIOR) / len(FEATURES)
            w -= np.linalg.solve((x.T * (p * (1 - p))) @ x / len(y) + scale / len(FEATURES) * np.eye(len(w)), grad)
    return w


def minimum_cut(content: np.ndarray, boilerplate: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """True for the nodes on the source's side: labels of least total cost.

    content[i] and boilerplate[i] are the costs of either label, and an edge's
    weight is the cost of different labels at its ends.  Nodes that one label
    suits better than all their edges together are settled first; the rest
    goes through augmenting paths (shortest first).
    """
    n = len(content)
    gain = np.asarray(boilerplate, float) - np.asarray(content, float)  # > 0 wants content
    settled = np.zeros(n, bool)
    label = gain > 0
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0) + w
            near[b][a] = near[b].get(a, 0) + w
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if settled[i] or abs(gain[i]) < sum(near[i].values()):
            continue
        settled[i], label[i] = True, gain[i] > 0
        for j, w in near[i].items():
            gain[j] += w if label[i] else -w
            del near[j][i]
            queue.append(j)
        near[i] = {}
    rest = [i for i in range(n) if not settled[i]]
    if not rest:
        return label
    source, sink = n, n + 1
    cap: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest} | {source: {}, sink: {}}
    for i in rest:
        if gain[i] > 0:
            cap[source][i], cap[i][source] = gain[i], 0.0
        elif gain[i] < 0:
            cap[i][sink], cap[sink][i] = -gain[i], 0.0
    while True:
        came, queue = {source: source}, deque([source])
        while queue and sink not in came:
            u = queue.popleft()
            for v, c in cap[u].items():
                if c > 1e-12 and v not in came:
                    came[v] = u
                    queue.append(v)
        if sink not in came:
            break
        path, v = [], sink
        while v != source:
            path.append((came[v], v))
            v = came[v]
        flow = min(cap[u][v] for u, v in path)
        for u, v in path:
            cap[u][v] -= flow
            cap[v][u] = cap[v].get(u, 0.0) + flow
    for i in rest:
        label[i] = i in came
    return label


def _edges(found: list[Block]) -> list[tuple[int, int, float]]:
    out, last = [], {}
    for i, b in enumerate(found):
        if i:
            steps = found[i - 1].depth + b.depth - 2 * b.shared
            out.append((i - 1, i, NEXT * 2.0 ** -max(0, steps - 2)))
        for up, parent in enumerate(b.parents):  # the last block under the same parent or grandparent
            if parent in last and last[parent] != i - 1:
                out.append((last[parent], i, NEAR * 2.0 ** -(up + 1)))
            last[parent] = i
    return out


@dataclass
class Model:
    weights: np.ndarray
    strength: float = 1.0


def labels_of(found: list[Block], model: Model, named: bool = True) -> np.ndarray:
    """Which blocks are content; with `named`, the names of their containers count, too."""
    z = features(found) @ model.weights
    if named:
        z = z + np.array([b.flags for b in found], float).reshape(len(found), 6) @ EVIDENCE
    z = np.clip(z, -12, 12)
    return minimum_cut(np.logaddexp(0, -z), np.logaddexp(0, z), [(a, b, w * model.strength) for a, b, w in _edges(found)])


def main_text(page: str, model: Model | None = None) -> str:
    found = blocks(page)
    if not found:
        return ""
    return "\n\n".join(b.text for b, k in zip(found, labels_of(found, model or Model(PRIOR))) if k)


def fit(pages: DataFrame) -> Model:
    """Weights and the edges' strength, from at most about SAMPLE_PAGES different pages, chosen by a hash of page_id."""
    total = pages.count()
    share = min(1.0, SAMPLE_PAGES / max(1, total))
    chosen = pages.where(F.pmod(F.xxhash64(F.lit(3), "page_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).groupBy("page_id").agg(F.min("html").alias("html")).checkpoint()

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.column("html").to_pylist():
                found = blocks(page or "")
                x = features(found)
                rows, y = _teachers(found, x)
                # a row for each distinct example, with how many blocks it stands for
                kinds, times = np.unique(np.column_stack([x[rows], y]).round(2), axis=0, return_counts=True) if len(rows) else (np.zeros((0, len(FEATURES) + 1)), [])
                yield pa.RecordBatch.from_arrays([pa.array(list(kinds), pa.list_(pa.float64())), pa.array(times, pa.int64())], names=["x", "n"])

    rows = sorted((tuple(r.x), r.n) for r in chosen.select("html").mapInArrow(examples, "x array<double>, n long").groupBy("x").agg(F.sum("n").alias("n")).collect())  # bounded by the sample
    if not rows:
        return Model(PRIOR)
    x = np.repeat(np.array([r[0] for r in rows]), [r[1] for r in rows], axis=0)
    weights = train(x[:, :-1], x[:, -1])

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = np.zeros(len(STRENGTHS), np.int64)
        for batch in batches:
            for page in batch.column("html").to_pylist():
                found = blocks(page or "")
                if found:
                    told, y = _teachers(found, features(found))
                    right += [int((labels_of(found, Model(weights, s), named=False)[told] == (y > 0)).sum()) for s in STRENGTHS]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(STRENGTHS)), pa.int64()), pa.array(right)], names=["which", "right"])

    right = {r.which: r.right for r in chosen.select("html").mapInArrow(tried, "which long, right long").groupBy("which").agg(F.sum("right").alias("right")).collect()}
    return Model(weights, STRENGTHS[max(range(len(STRENGTHS)), key=lambda i: (right.get(i, 0), -i))])


def extract(pages: DataFrame) -> DataFrame:
    """One row per page row: page_id, url, text, n_chars.

    Null and empty html, and pages without content, have an empty text.
    Unclosed and misnested tags are taken as they come, and quotes outside of
    attribute values are characters; a very long page is one page, read in time
    that goes with its length.  Repeated rows get equal texts; other columns are ignored.
    """
    T.prepare(pages.sparkSession)
    model = fit(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page or "", model) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
