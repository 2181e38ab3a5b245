"""Main text of HTML pages by minimum-cut labelling.

A page becomes a list of blocks (runs of text between block-level tags) with
features of their text, tags and ancestors.  A logistic classifier turns the
features into the cost of calling a block content or boilerplate; these are
the capacities to the two terminals of a flow network.  Blocks that follow one
another or share a parent are tied by smoothness edges, heavier the closer they
are in the document tree.  The minimum cut is the labelling.

The classifier is trained on a bounded sample of pages whose own structure
(article and main against navigation, footers and the like) labels blocks, and
is drawn to prior weights, which hold for features the sample doesn't show.

Defined results: null and empty pages have empty text; unclosed tags, comments
and scripts run to the end of what they can contain; text outside any tag is a
block; repeated rows get equal results.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_sample, map_batches

SAMPLE_PAGES = 1500
SAMPLE_BLOCKS = 30_000
# Smoothness: neighbours in the page, and how it falls with distance in the tree.
NEIGHBOUR = 0.8
SIBLING = 0.4

# Element classes of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript template svg head title textarea select iframe object canvas math audio video".split())
RAW = set("script style textarea title".split())
BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
            "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary "
            "table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "button"}
NOT_MAIN = set("nav footer aside form button menu dialog fieldset".split())
# Words in class, id or role that name what an element is.
BAD_NAMES = set("ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments complementary consent "
                "contentinfo cookie cookies copyright dialog disclaimer disqus footer foot form header login masthead menu modal nav "
                "navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related "
                "remark replies reply respond search share sharing sidebar side signup social sponsor sponsored subscribe tags "
                "toolbar tracking widget".split())
GOOD_NAMES = set("article body content entry main post story text".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>")
_ATTR = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME = re.compile(r"[a-z]+")
_GONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Element:
    __slots__ = ("tag", "parent", "depth", "block", "bad", "good", "hidden", "article", "boiler")

    def __init__(self, tag: str, attrs: str, parent: Element | None):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        # The nearest block-level element, itself included.
        self.block: Element = self if parent is None or tag in BLOCK else parent.block
        names: set[str] = set()
        gone = False
        if attrs:
            for m in _ATTR.finditer(attrs):
                key, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
                if key == "style":
                    gone |= bool(_GONE.search(value))
                elif key in ("hidden", "aria-hidden"):
                    gone |= key == "hidden" or value == "true"
                else:
                    names.update(_NAME.findall(_CAMEL.sub(" ", value).lower()))
        up = parent
        self.bad = bool(names & BAD_NAMES) and tag not in ("body", "html", "article", "main") or bool(up and up.bad)
        self.good = bool(names & GOOD_NAMES) and not names & BAD_NAMES or bool(up and up.good)
        self.hidden = gone or tag in HIDDEN or bool(up and up.hidden)
        self.article = tag in ("article", "main") or bool(up and up.article)
        self.boiler = tag in NOT_MAIN or tag == "header" and not (up and up.article) or bool(up and up.boiler)


class Block:
    __slots__ = ("text", "element", "words", "linked", "chars")

    def __init__(self, text: str, element: Element, linked: int, chars: int):
        self.text, self.element, self.linked, self.chars = text, element, linked, chars
        self.words = text.count(" ") + 1


def blocks_of(page: str) -> list[Block]:
    """The visible text blocks of a page, in order.  Takes time in proportion to the page, however deep its tags lie."""
    root = Element("html", "", None)
    here, out = root, []
    opened: dict[str, list[Element]] = {}  # the elements around this place, by tag
    parts: list[str] = []
    linked = in_link = 0

    def flush():
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, here, linked, len(text)))
            parts, linked = [], 0

    def leave(upto: Element):
        nonlocal here
        while here is not upto:
            opened[here.tag].pop()
            here = here.parent

    def close(tag: str):
        """Leaves an open element that the next tag implies the end of, unless a container lies between."""
        if here.block.tag == tag and here.block.parent is not None:
            leave(here.block.parent)

    def tag_end(start: int) -> int:
        """The next ``>``; looked for once however many tags ask for it."""
        nonlocal gt
        if gt < start:
            gt = page.find(">", start)
            gt = n if gt < 0 else gt
        return gt

    at, n, gt = 0, len(page), -1
    while at < n:
        lt = page.find("<", at)
        end = n if lt < 0 else lt
        if end > at and not here.hidden:
            chunk = unescape(page[at:end])
            parts.append(chunk)
            if in_link:
                linked += len(chunk.strip())
        if lt < 0:
            break
        nxt = page[lt + 1:lt + 2]
        if nxt == "!" or nxt == "?":
            if page.startswith("<!--", lt):
                stop = page.find("-->", lt + 4)
                at = n if stop < 0 else stop + 3
            else:
                at = min(n, tag_end(lt) + 1)
            continue
        m = _TAG.match(page, lt)
        if not m:
            stop = tag_end(lt) if nxt.isalpha() or nxt == "/" else n
            if stop < n and page.find("<", lt + 1, stop) < 0:
                at = stop + 1  # a tag with broken quotes
            else:
                if not here.hidden:
                    parts.append("<")  # a plain less-than sign
                at = lt + 1
            continue
        at = m.end()
        closing, tag, attrs = m.group(1), m.group(2).lower(), m.group(3)
        if closing:
            if tag in BLOCK or tag in HIDDEN:
                flush()
            ends = opened.get(tag)
            # An inline end tag must not close a block element.
            if ends and (tag in BLOCK or here.block.depth <= ends[-1].depth):
                leave(ends[-1].parent)
            if tag == "a":
                in_link = 0
            continue
        if tag == "br":
            if not here.hidden:
                parts.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in BLOCK or tag in HIDDEN:
            flush()
            if tag in CLOSES_P:
                close("p")
            if tag in ("li", "td", "th", "tr", "dd", "dt", "option"):
                close(tag)
            in_link = 0
        if tag in RAW:
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = stop.end() if stop else n
            continue
        if attrs.endswith("/") and tag in ("svg", "math"):
            continue
        if tag == "body" or tag == "html":
            if here.tag == "head" or here.hidden:
                leave(root)
        if tag == "a":
            in_link = 1
        here = Element(tag, attrs, here)
        opened.setdefault(tag, []).append(here)
    flush()
    return out


FEATURES = ("bias", "article", "good", "bad", "boiler", "link_share", "all_links", "log_words", "sentence", "heading", "paragraph",
            "list_item", "outside", "many_links", "short")
PRIOR = {"bias": -0.5, "article": 4.0, "good": 1.5, "bad": -7.0, "boiler": -7.0, "link_share": -1.0, "all_links": -1.5, "log_words": 0.3,
         "sentence": 0.5, "heading": 0.3, "paragraph": 1.0, "list_item": -0.2, "outside": -0.3, "many_links": -0.5, "short": -0.3}


def prior_weights() -> np.ndarray:
    return np.array([PRIOR[f] for f in FEATURES])


def features(b: Block) -> tuple[float, ...]:
    e, words = b.element, b.words
    share = min(1.0, b.linked / b.chars)
    tag = e.block.tag
    return (1.0, e.article, e.good, e.bad, e.boiler, share, share > 0.9, min(8, words.bit_length()) / 4, b.text[-1] in ".!?…。",
            tag in ("h1", "h2", "h3", "h4"), tag in ("p", "pre", "blockquote"), tag in ("li", "td", "dd", "dt"), not (e.article or e.good),
            share > 0.5, words < 4)


# ---- minimum cut ----------------------------------------------------------------------------------

def tree_distance(a: Element, b: Element) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


NOTHING = 1e-12


def min_cut(cost: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise, exactly, what they cost: cost[i] > 0 speaks for True and is paid if i is False, -cost[i]
    is paid if a negative one is True, and an edge's weight is paid if its ends differ.

    Max-flow by blocking flows: nodes are put in levels by their distance from those that can still give, and
    one pass saturates every way that leads from level to level, so the work is a few passes over the page
    (as many as there are lengths of ways) and not one search per way.
    """
    n = len(cost)
    near: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    cap: list[float] = []
    for i, j, w in edges:
        near[i].append(len(to))
        near[j].append(len(to) + 1)
        to += (j, i)
        cap += (w, w)
    give = [max(0.0, c) for c in cost]
    take = [max(0.0, -c) for c in cost]
    while True:
        level = [0 if g > NOTHING else -1 for g in give]
        reached = [i for i in range(n) if not level[i]]
        sources, open_way = len(reached), False
        for i in reached:  # grows while it is read
            open_way |= take[i] > NOTHING
            for e in near[i]:
                if cap[e] > NOTHING and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    reached.append(to[e])
        if not open_way:
            return [x >= 0 for x in level]  # what can still be given reaches it: content
        arc = [0] * n  # arcs before this one lead nowhere in these levels
        for source in reached[:sources]:
            _send(source, near, to, cap, give, take, level, arc)


def _send(source: int, near, to, cap, give, take, level, arc) -> None:
    """Sends what a node can give along ways from level to level until none is left."""
    i, way = source, []
    while give[source] > NOTHING:
        if take[i] > NOTHING:
            flow = min(give[source], take[i], *[cap[e] for e in way])
            give[source] -= flow
            take[i] -= flow
            full = None
            for k, e in enumerate(way):
                cap[e] -= flow
                cap[e ^ 1] += flow
                if full is None and cap[e] <= NOTHING:
                    full = k
            if full is not None:  # go on from before the first arc that is full
                i = to[way[full] ^ 1]
                del way[full:]
            continue
        arcs, k = near[i], arc[i]
        while k < len(arcs) and not (cap[arcs[k]] > NOTHING and level[to[arcs[k]]] == level[i] + 1):
            k += 1
        arc[i] = k
        if k < len(arcs):
            way.append(arcs[k])
            i = to[arcs[k]]
        elif way:
            i = to[way.pop() ^ 1]
            arc[i] += 1
        else:
            return


def costs_of(blocks: list[Block], weights: np.ndarray) -> list[float]:
    """What speaks for content (positive) or boilerplate in each block on its own."""
    return (np.array([features(b) for b in blocks], dtype=float).reshape(len(blocks), len(FEATURES)) @ weights).tolist()


def label_blocks(blocks: list[Block], weights: np.ndarray) -> list[bool]:
    """True for content.  Equal costs make a block boilerplate."""
    if not blocks:
        return []
    cost = costs_of(blocks, weights)
    if min(cost) > 0 or max(cost) <= 0:
        return [c > 0 for c in cost]  # no two labels to separate
    edges = []
    seen: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, NEIGHBOUR / max(1, tree_distance(blocks[i - 1].element, b.element))))
        p = id(b.element.parent)
        j = seen.get(p)
        if j is not None and j < i - 1:
            edges.append((j, i, SIBLING))
        seen[p] = i
    return min_cut(cost, edges)


def main_text(page: str | None, weights: np.ndarray) -> str:
    if not page:
        return ""
    blocks = blocks_of(page)
    return "\n".join(b.text for b, keep in zip(blocks, label_blocks(blocks, weights), strict=True) if keep)


def train(rows: np.ndarray, labels: np.ndarray, rounds: int = 200, rate: float = 0.5, pull: float = 0.05) -> np.ndarray:
    """Logistic regression on silver labels, drawn to the prior weights."""
    prior = prior_weights()
    w = prior.copy()
    if not len(rows):
        return w
    square = np.full_like(w, 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        grad = rows.T @ (labels - p) / len(rows) - pull * (w - prior)
        square += grad * grad
        w += rate * grad / np.sqrt(square)
    return w


def _sample_blocks(batch) -> dict:
    out: dict[str, list] = {"label": [], "row": []}
    for page in batch.column(0).to_pylist():
        for b in blocks_of(page or "")[:200]:
            e = b.element
            if e.article or e.boiler or e.bad:
                out["label"].append(int(e.article and not e.boiler and not e.bad))
                out["row"].append([float(x) for x in features(b)])
    return out


def fit(pages: DataFrame, html_col: str = "html", key_col: str = "page_id") -> np.ndarray:
    """Weights from about SAMPLE_PAGES pages by a hash of their key, at most SAMPLE_BLOCKS blocks."""
    n = pages.count()
    picked = pages.where(in_sample("pages", F.col(key_col), SAMPLE_PAGES / max(1, n))).select(F.col(html_col).cast("string"))
    rows = map_batches(picked, _sample_blocks, "label int, row array<double>").limit(SAMPLE_BLOCKS).collect()
    rows = sorted(rows, key=lambda r: (r.label, r.row))
    return train(np.array([r.row for r in rows]), np.array([r.label for r in rows], dtype=float))


def extract(pages: DataFrame, weights: np.ndarray | None = None, id_col: str = "page_id", html_col: str = "html",
            url_col: str = "url") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    weights = fit(pages, html_col, id_col) if weights is None else weights
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batch):
        texts = [main_text(p, shared.value) for p in batch.column(2).to_pylist()]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string"))
    return map_batches(rows, run, "page_id bigint, url string, text string, n_chars bigint")
