"""Main text of HTML pages: a graphical model on the tree of the page.

The page's block elements and the runs of text in them are the nodes of a tree. Each
node is content or not; it has a potential from its features, and one with its parent.
Messages passed up and down the tree by the sum-product rule give every node's
marginal. Both kinds of potentials are trained from labelled pages by the gradient of
the likelihood, which the same messages give. Runs of text that are more likely content
than not make up the text.

The messages of many pages are passed at once, depth by depth.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybook.llm import page_examples

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*+>|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)>)", re.S)
#: The same where a tag without an end has been met: what is not quoted ends at the next `<`.
_SHORT = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*+>|(/?)([a-zA-Z][^\s/><]*+)((?:[^>=<]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'<][^\s><]*+)?+)*+)>)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_UNQUOTED_END = re.compile(r"=\s*[^\s\"']*/\Z")  # this slash belongs to the value
_NAME = re.compile(r"[a-z]+")

# Fixed values of HTML: elements without an end, with raw text, whose subtree is left out, that run within a line, and that end others.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
SKIPPED = frozenset("noscript template svg select button object".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var img wbr".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}}

#: Elements nested deeper become siblings, as in browsers.
DEEPEST = 512
#: Elements and words of classes, ids and roles that are features of their own.
TAGS = "body div section main article p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption nav header footer aside form fieldset address details summary dialog".split()
WORDS = (
    "nav menu header head footer foot sidebar side aside ad ads advert advertisement banner promo sponsor cookie consent notice alert popup modal newsletter subscribe comment comments reply respond discussion "
    "form login search share social related recommended breadcrumb breadcrumbs pagination pager widget tags meta byline author copyright legal disclaimer hidden "
    "article content main post entry body story text page contentinfo navigation complementary"
).split()
_TAG_AT = {t: i for i, t in enumerate(TAGS)}
_WORD_AT = {w: len(TAGS) + i for i, w in enumerate(WORDS)}
_MORE = len(TAGS) + len(WORDS)
#: Further features: text run, length of it in five steps, links in three, a sentence's end, first or last of its siblings, bias.
FEATURES = _MORE + 1 + 5 + 3 + 1 + 2 + 1


@dataclass
class Page:
    """Nodes in page order, parents before children; texts of runs, empty for elements."""

    parent: list[int] = field(default_factory=list)
    active: list[list[int]] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)

    def add(self, parent: int, active: list[int], text: str = "", label: int = -1) -> int:
        self.parent.append(parent)
        self.active.append(active)
        self.text.append(text)
        self.label.append(label)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        return len(self.parent) - 1


def _names(attributes: str) -> list[str]:
    out = []
    for name, value in _ATTRIBUTE.findall(attributes):
        out += [name.lower()] if "hidden" in name.lower() and "false" not in value else _NAME.findall(html.unescape(value).lower())
    return out


class _Tags:
    """The tags of a page from a place on; every `<` is tried once and, after one whose tag never ends, not beyond the next."""

    def __init__(self, source: str):
        self.source, self.last, self.tag = source, source.rfind(">"), _TAG

    def search(self, at: int) -> re.Match | None:
        at = self.source.find("<", at)
        while at >= 0:
            if at > self.last:  # no tag can end any more, but a comment runs to the end of the page
                at = self.source.find("<!--", at)
                return _TAG.match(self.source, at) if at >= 0 else None
            if match := self.tag.match(self.source, at):
                return match
            if self.source[at + 1 : at + 2].strip("/").isalpha():
                self.tag = _SHORT
            at = self.source.find("<", at + 1)
        return None

    def raw_end(self, name: str, at: int) -> int:
        """Where a raw text element ends: behind its end tag, or with the page."""
        match = re.compile(rf"</{re.escape(name)}\b[^>]*+>", re.I).search(self.source, at, self.last + 1)
        return match.end() if match else len(self.source)


def _empty(attributes: str) -> bool:
    return attributes.endswith("/") and not _UNQUOTED_END.search(attributes)


def _skips(tags: _Tags, name: str, at: int, opened: Counter[str]) -> dict[int, int]:
    """Where the page goes on after the SKIPPED element whose start tag ends at `at`, and after those met on the way, by the ends of their start tags.

    Without an end tag, it ends where another one that cannot be in it begins or an element around it ends,
    and what begins at the first block element in it is not left out.
    """
    out: dict[int, int] = {}
    inner, held, blocks, here = [(name, at)], Counter([name]), [], at

    def leave(upto: int, stop: int) -> None:
        for name, start in inner[upto:]:
            held[name] -= 1
            if name in SKIPPED:
                first = bisect_left(blocks, start)
                out[start] = blocks[first] if first < len(blocks) else stop
        del inner[upto:]

    def innermost(name: str) -> int:
        return next(i for i in range(len(inner) - 1, -1, -1) if inner[i][0] == name)

    while inner and (match := tags.search(here)):
        here, name = match.end(), (match[2] or "").lower()
        if not name:
            continue
        if match[1]:
            if held[name]:
                i = innermost(name)
                leave(i + 1, match.start())
                start = inner[i][1]
                leave(i, here)
                if name in SKIPPED:
                    out[start] = here
                    del blocks[bisect_left(blocks, start) :]
            elif opened[name]:
                leave(0, match.start())
        elif name in RAW:
            here = tags.raw_end(name, here)
        elif name not in VOID and not (name in SKIPPED and _empty(match[3])):
            if name in ("button", "select") and held[name]:
                leave(innermost(name), match.start())
                if not inner:
                    break
            if name in _TAG_AT:
                blocks.append(match.start())
            inner.append((name, here))
            held[name] += 1
    leave(0, len(tags.source))
    return out


def parse(source: str, labelled: bool = False) -> Page:
    """The tree of a page, however broken its markup; what scripts, styles and the like hold is left out.

    In a labelled page the attribute `data-content="1"` or `"0"` holds for all text below, until another one.
    """
    page = Page()
    page.add(-1, [], label=0)
    # open elements: name, node of its block, label
    stack: list[tuple[str, int, int]] = [("", 0, 0)]
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    linked = [0, 0]
    skips: dict[int, int] = {}
    tags = _Tags(source)

    def push(name: str, node: int, label: int) -> None:
        stack.append((name, node, label))
        opened[name] += 1

    def settle() -> None:
        text = " ".join("".join(pieces).split())
        if text:
            name, node, label = stack[-1]
            size, ratio = len(text), linked[0] / max(1, linked[1])
            active = [_MORE, _MORE + 1 + min(4, (size > 20) + (size > 60) + (size > 140) + (size > 400)), _MORE + 6 + (ratio > 0.2) + (ratio > 0.7)]
            page.add(node, active + ([_MORE + 9] if text[-1] in ".!?…:;\"”»" else []), text, label)
        pieces.clear()
        linked[:] = 0, 0

    def close(names: frozenset | set, stop: set | frozenset) -> None:
        if not any(opened[x] for x in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                if any(s[0] not in INLINE for s in stack[i:]):
                    settle()
                opened.subtract(s[0] for s in stack[i:])
                del stack[i:]
                return
            if stack[i][0] in stop:
                return

    def say(raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        if text:
            pieces.append(text)
            size = len(text.strip())
            linked[1] += size
            linked[0] += size if opened["a"] else 0

    at = 0
    while match := tags.search(at):
        if match.start() > at:
            say(source[at : match.start()])
        at = match.end()
        name = (match[2] or "").lower()
        if not name:
            continue
        if match[1]:
            if name == "br" or name == "p" and not opened["p"]:
                settle() if name == "p" else pieces.append(" ")
            else:
                close({name}, frozenset() if name not in INLINE else frozenset(("td", "th", "article", "body")))
            continue
        if name in RAW:
            at = tags.raw_end(name, at)
            continue
        if name in SKIPPED:
            if not _empty(match[3]):
                if at not in skips:
                    skips |= _skips(tags, name, at, opened)
                at = skips[at]
            continue
        if name in VOID:
            if name in ("br", "hr"):
                pieces.append(" ")
            if name == "hr":
                settle()
            continue
        label = stack[-1][2]
        if labelled and (own := re.search(r'data-content="([01])"', match[3])):
            label = int(own[1])
        if name in INLINE:
            push(name, stack[-1][1], label)
            continue
        settle()
        if name in ENDS:
            close(ENDS[name], SCOPE[name])
        close({"p"}, frozenset())
        if labelled and not re.search(r'data-content="([01])"', match[3]):
            label = stack[-1][2]
        if name in ("html", "head"):
            push(name, stack[-1][1], label)
            continue
        active = [_TAG_AT[name]] if name in _TAG_AT else []
        active += sorted({_WORD_AT[w] for w in _names(match[3]) if w in _WORD_AT})
        above = stack[-1][1]
        if page.depth[above] >= DEEPEST:
            above = page.parent[above]
        push(name, page.add(above, active, label=label), label)
    say(source[at:])
    settle()
    return page


@dataclass
class Forest:
    """The nodes of many pages."""

    parent: np.ndarray
    page: np.ndarray
    leaf: np.ndarray
    levels: list[np.ndarray]
    rows: np.ndarray
    columns: np.ndarray

    def kinds(self) -> np.ndarray:
        """Which table of parent and child potentials a node has: of an element, of a run."""
        return self.leaf.astype(int)


def forest(pages: list[Page]) -> Forest:
    sizes = np.array([len(p.parent) for p in pages])
    first = np.concatenate(([0], np.cumsum(sizes)))[:-1].astype(int)
    parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + f) for p, f in zip(pages, first, strict=True)])
    depth = np.array([d for p in pages for d in p.depth], int)
    leaf = np.array([bool(t) for p in pages for t in p.text])
    active = [a for p in pages for a in p.active]
    counts = np.array([len(a) for a in active])
    rows, columns = np.repeat(np.arange(len(active)), counts), np.array([c for a in active for c in a], int)
    inner = np.flatnonzero(parent >= 0)
    firsts, lasts = (order[np.unique(parent[order], return_index=True)[1]] for order in (inner, inner[::-1]))
    n = len(parent)
    rows = np.concatenate((rows, firsts, lasts, np.arange(n)))
    columns = np.concatenate((columns, np.full(len(firsts), _MORE + 10), np.full(len(lasts), _MORE + 11), np.full(n, FEATURES - 1)))
    levels = [np.flatnonzero(depth == d) for d in range(1, depth.max() + 1)] if n else []
    return Forest(parent, np.repeat(np.arange(len(pages)), sizes), leaf, levels, rows, columns)


@dataclass
class Model:
    #: Weight of each feature for content, of elements and of runs.
    weights: np.ndarray
    #: Potentials [kind of child][parent is content][child is content].
    pairs: np.ndarray


def marginals(model: Model, trees: Forest) -> tuple[np.ndarray, np.ndarray]:
    """Probability of content of every node, and of each pair of states of a parent and the node."""
    n, kind = len(trees.parent), trees.kinds()
    own = np.zeros((n, 2))
    own[:, 1] = np.bincount(trees.rows, model.weights[kind[trees.rows], trees.columns], minlength=n)
    up, sent = own.copy(), np.zeros((n, 2))
    for level in reversed(trees.levels):
        joint = model.pairs[kind[level]] + up[level, None, :]
        sent[level] = np.logaddexp(joint[:, :, 0], joint[:, :, 1])
        np.add.at(up, trees.parent[level], sent[level])
    both, belief = np.zeros((n, 2, 2)), up.copy()
    for level in trees.levels:
        above = belief[trees.parent[level]] - sent[level]
        joint = above[:, :, None] + model.pairs[kind[level]]
        belief[level] = up[level] + np.logaddexp(joint[:, 0], joint[:, 1])
        joint = joint + up[level, None, :]
        both[level] = np.exp(joint - np.logaddexp.reduce(joint.reshape(len(level), 4), axis=1)[:, None, None])
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50))), both


def train(pages: list[str], steps: int = 250, rate: float = 0.1, decay: float = 0.002) -> Model:
    """Potentials from labelled pages (`parse`, labelled); an element is content if most of the text below it is."""
    parsed = [parse(p, labelled=True) for p in pages]
    trees = forest(parsed)
    n, kind = len(trees.parent), trees.kinds()
    weight = np.array([len(t) for p in parsed for t in p.text], float)
    share = weight * np.array([label for p in parsed for label in p.label])
    for level in reversed(trees.levels):
        np.add.at(weight, trees.parent[level], weight[level])
        np.add.at(share, trees.parent[level], share[level])
    label = (share > 0.5 * weight).astype(int)
    inner = trees.parent >= 0
    seen = np.zeros((n, 2, 2))
    seen[inner, label[trees.parent[inner]], label[inner]] = 1
    model = Model(np.zeros((2, FEATURES)), np.zeros((2, 2, 2)))
    first, second = [np.zeros_like(model.weights), np.zeros_like(model.pairs)], [np.zeros_like(model.weights), np.zeros_like(model.pairs)]
    for step in range(1, steps + 1):
        p, both = marginals(model, trees)
        wrong = (label - p)[trees.rows] / len(pages)
        by_weight = np.bincount(kind[trees.rows] * FEATURES + trees.columns, wrong, minlength=2 * FEATURES).reshape(2, FEATURES) - decay * model.weights
        by_pair = np.stack([(seen - both)[kind == k].sum(axis=0) for k in (0, 1)]) / len(pages) - decay * model.pairs
        for i, (values, gradient) in enumerate(((model.weights, by_weight), (model.pairs, by_pair))):
            first[i] += 0.1 * (gradient - first[i])
            second[i] += 0.01 * (gradient * gradient - second[i])
            values += rate * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    return model


def texts(model: Model, pages: list[str]) -> list[str]:
    """The main text of each page: its content runs, in page order, joined by one space."""
    parsed = [parse(p) for p in pages]
    if not parsed:
        return []
    trees = forest(parsed)
    content = (marginals(model, trees)[0] >= 0.5) & trees.leaf
    runs = [t for p in parsed for t in p.text]
    out: list[list[str]] = [[] for _ in pages]
    for i in np.flatnonzero(content):
        out[trees.page[i]].append(runs[i])
    return [" ".join(x) for x in out]


def extracted(pages: DataFrame, labelled: list[str] | None = None) -> DataFrame:
    """One row per row of (page_id, url, html): page_id, url, text, n_chars (code points).

    The model is trained on `labelled` pages, or on the bounded set that `page_examples`
    makes. A null or empty html, and one without content, gives an empty text. Repeated
    rows stay; other columns are not read.
    """
    model = train(page_examples.pages() if labelled is None else labelled)
    sent = pages.sparkSession.sparkContext.broadcast(model)  # two small tables

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = texts(sent.value, [x or "" for x in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
