"""Operator 4, HTML extraction by a tree-structured graphical model.

The DOM is the graph: a binary variable for each element and text node (content or not), a unary potential from its
features, and a pairwise potential on each parent-child edge. Sum-product passes messages from the leaves up and from
the root down and so gives exact marginals. The weights maximise the likelihood of labelled pages; its gradient comes
from the same messages. All pages of a batch form one forest that is handled level by level with NumPy.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*'|[\"'])[^>\"']*)*)(?:>|\Z))", re.S)
RAW = frozenset("script style noscript template textarea svg iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
#: Which open elements a start tag ends, up to the nearest of the second set.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Tags with a weight of their own; others share the last. article and main are left out: they mark the labels.
TAGS = "#text a b blockquote body br code div em footer form h1 h2 h3 h4 h5 h6 head header html i img li nav aside ol p pre section span strong table td th title tr ul figure button input ?".split()
TAG_ID = {t: i for i, t in enumerate(TAGS)}
CLASS_AGAINST = re.compile(r"(?i)(?:^|[\s\"'_-])(?:ads?|advert\w*|banner|nav\w*|menu|foot\w*|side\w*|comment\w*|promo\w*|share|social|related|cookie\w*|breadcrumb\w*|login)(?:$|[\s\"'_-])")
CLASS_FOR = re.compile(r"(?i)(?:^|[\s\"'_-])(?:content|post|entry|text|story|body|article)(?:$|[\s\"'_-])")
STOPS = re.compile(r"[.,;:!?]")
NOT_CONTENT = frozenset("nav aside footer header form button head title".split())
#: Nesting that the parser follows.
MAX_DEPTH = 512
#: Edge kinds, by the child: text, inline element, block element.
EDGES = 3
N_NUM = 12
N_FEATURES = N_NUM + 2 * len(TAGS)


@dataclass
class Tree:
    """Nodes in document order; parent[i] < i, and -1 for the root. text is '' for elements."""

    parent: list[int]
    tag: list[str]
    text: list[str]
    attrs: list[str]


def parse(page: str | None) -> Tree:
    """The DOM of a page, as far as the model needs it. Broken HTML never fails: unknown end tags are ignored, open
    elements end with the page, and an open paragraph ends where a block starts. What is nested more than MAX_DEPTH deep
    becomes a child of the element at that depth, as in browsers. Null and '' give a root alone. The time is linear in
    the length of the page: the places of the open elements are kept by tag, and nothing walks up the stack."""
    t = Tree([-1], ["html"], [""], [""])
    stack, at, page = [0], 0, page or ""
    places: dict[str, list[int]] = {}  # on the stack, by tag, without the root
    blocks: list[int] = []  # on the stack, of elements in BLOCK

    def add(tag: str, text: str, attrs: str) -> int:
        t.parent.append(stack[min(len(stack), MAX_DEPTH) - 1])
        t.tag.append(tag)
        t.text.append(text)
        t.attrs.append(attrs)
        return len(t.parent) - 1

    def words(upto: int) -> None:
        s = page[at:upto]
        s = " ".join((html.unescape(s) if "&" in s else s).split())
        if s:
            add("#text", s, "")

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            tag = t.tag[stack.pop()]
            places[tag].pop()
            if tag in BLOCK:
                blocks.pop()

    pos = 0
    while m := TOKEN.search(page, pos):
        words(m.start())
        at = pos = max(m.end(), m.start() + 1)
        name = m.group(2)
        if not name:
            continue
        name = name.lower()
        if m.group(1):
            if places.get(name):
                close(places[name][-1])
            continue
        if name in RAW:
            if not m.group(3).endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, pos)
                at = pos = end.end() if end else len(page)
            continue
        if name == "html":
            continue
        if name in BLOCK and blocks and t.tag[stack[blocks[-1]]] == "p":
            close(blocks[-1])
        if name in CLOSES:
            ends, stops = CLOSES[name]
            stop = max((places[s][-1] for s in stops if places.get(s)), default=0)
            first = [p[i] for e in ends if (p := places.get(e)) and (i := bisect.bisect_right(p, stop)) < len(p)]
            if first:
                close(min(first))
        i = add(name, "", m.group(3))
        if name not in VOID and not m.group(3).endswith("/"):
            places.setdefault(name, []).append(len(stack))
            if name in BLOCK:
                blocks.append(len(stack))
            stack.append(i)
    words(len(page))
    return t


def labels(t: Tree) -> np.ndarray | None:
    """1 for nodes in an article or main element and in no boilerplate element there; None if the page has neither."""
    if not {"article", "main"} & set(t.tag):
        return None
    y = np.zeros(len(t.tag), np.int64)
    for i, tag in enumerate(t.tag):
        p = t.parent[i]
        y[i] = tag not in NOT_CONTENT and (tag in ("article", "main") or (p >= 0 and y[p]))
    return y


@dataclass
class Forest:
    """Trees side by side. num: the numeric features; tag, parent_tag: numbers of the tags, each a feature of its own;
    levels: node numbers by depth; edge: kind of the edge to the parent."""

    parent: np.ndarray
    num: np.ndarray
    tag: np.ndarray
    parent_tag: np.ndarray
    edge: np.ndarray
    levels: list[np.ndarray]
    starts: np.ndarray

    def scores(self, unary: np.ndarray) -> np.ndarray:
        """Features times weights, for each node."""
        return self.num @ unary[:N_NUM] + unary[N_NUM + self.tag] + unary[N_NUM + len(TAGS) + self.parent_tag]

    def sums(self, of: np.ndarray) -> np.ndarray:
        """For each feature, its sum over the nodes times of: the transpose of scores()."""
        return np.concatenate([self.num.T @ of, np.bincount(self.tag, of, len(TAGS)), np.bincount(self.parent_tag, of, len(TAGS))])


def forest(trees: list[Tree]) -> Forest:
    starts = np.cumsum([0] + [len(t.tag) for t in trees])
    n = int(starts[-1])
    parent = np.concatenate([np.array(t.parent) + np.where(np.array(t.parent) < 0, 0, s) for t, s in zip(trees, starts)]) if trees else np.zeros(0, np.int64)
    tags = [g for t in trees for g in t.tag]
    tag = np.array([TAG_ID.get(g, len(TAGS) - 1) for g in tags], np.int64)
    text = [s for t in trees for s in t.text]
    attrs = [a for t in trees for a in t.attrs]
    own = np.array([len(s) for s in text], np.float64)
    stops = np.array([len(STOPS.findall(s)) if s else 0 for s in text], np.float64)
    spaces = np.array([s.count(" ") + 1 if s else 0 for s in text], np.float64)
    against = np.array([bool(a) and bool(CLASS_AGAINST.search(a)) for a in attrs], np.float64)
    pro = np.array([bool(a) and bool(CLASS_FOR.search(a)) for a in attrs], np.float64)
    depth, levels = np.zeros(n, np.int64), []
    at = np.flatnonzero(parent < 0)
    is_parent = np.argsort(parent, kind="stable")
    first, last = np.searchsorted(parent[is_parent], np.arange(n)), np.searchsorted(parent[is_parent], np.arange(n), side="right")
    while len(at):
        levels.append(at)
        depth[at] = len(levels) - 1
        counts = last[at] - first[at]
        at = is_parent[np.repeat(first[at], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)] if counts.sum() else at[:0]
    linked = np.array([g == "a" for g in tags], bool)
    bad = against.copy()
    for level in levels[1:]:
        linked[level] |= linked[parent[level]]
        bad[level] = np.maximum(bad[level], bad[parent[level]])
    below, links = own.copy(), np.where(linked, own, 0.0)
    for level in levels[:0:-1]:
        np.add.at(below, parent[level], below[level])
        np.add.at(links, parent[level], links[level])
    p = np.where(parent < 0, np.arange(n), parent)  # a root stands for its own parent
    size = np.repeat(np.diff(starts), np.diff(starts))
    place = (np.arange(n) - np.repeat(starts[:-1], np.diff(starts))) / np.maximum(size, 1)
    kids = (last - first).astype(np.float64)
    isin = tag == 0
    num = [np.ones(n), np.log1p(own) / 4, np.log1p(below) / 6, links / np.maximum(below, 1), stops / np.maximum(spaces, 1), np.log1p(spaces) / 3, bad, pro, np.minimum(depth, 20) / 10, place, np.log1p(kids[p]) / 3, np.log1p(below[p]) / 6]
    num = np.stack(num, axis=1) if n else np.zeros((0, N_NUM))
    edge = np.where(isin, 0, np.array([2 if g in BLOCK else 1 for g in tags], np.int64)) if n else np.zeros(0, np.int64)
    return Forest(parent, num, tag, tag[p], edge, levels, starts)


@dataclass
class Weights:
    """unary: log-odds of content from the features; pair[kind, parent state, child state]: edge potentials."""

    unary: np.ndarray
    pair: np.ndarray


def sum_product(f: Forest, w: Weights, edges: bool = True) -> tuple[np.ndarray, np.ndarray | None, float]:
    """(marginals of state 1, edge marginals [n, parent state, child state] with zeros at roots, log partition). Without
    edges their marginals are left out."""
    n = len(f.parent)
    up = np.zeros((n, 2))
    up[:, 1] = f.scores(w.unary)
    psi = w.pair[f.edge]
    msg = np.zeros((n, 2))
    for level in f.levels[:0:-1]:
        msg[level] = np.logaddexp.reduce(up[level][:, None, :] + psi[level], axis=2)
        np.add.at(up, f.parent[level], msg[level])
    full, pairs = up.copy(), np.zeros((n, 2, 2)) if edges else None
    log_z = float(np.logaddexp.reduce(up[f.levels[0]], axis=1).sum()) if f.levels else 0.0
    for level in f.levels[1:]:
        rest = full[f.parent[level]] - msg[level]
        full[level] = np.logaddexp.reduce(rest[:, :, None] + psi[level], axis=1) + up[level]
        if pairs is None:
            continue
        joint = rest[:, :, None] + psi[level] + up[level][:, None, :]
        joint -= np.logaddexp.reduce(joint.reshape(len(level), 4), axis=1)[:, None, None]
        pairs[level] = np.exp(joint)
    return 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -500, 500))), pairs, log_z


def train(pages: list[str], steps: int = 200, rate: float = 0.1, l2: float = 1e-3) -> Weights | None:
    """Maximum likelihood with a Gaussian prior, by Adam. None if no page has labels."""
    both = [(t, y) for t in map(parse, pages) if (y := labels(t)) is not None]
    if not both:
        return None
    f, y = forest([t for t, _ in both]), np.concatenate([y for _, y in both])
    child = np.flatnonzero(f.parent >= 0)
    seen = np.zeros((EDGES, 2, 2))
    np.add.at(seen, (f.edge[child], y[f.parent[child]], y[child]), 1)
    w = np.zeros(N_FEATURES + EDGES * 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        p, pairs, _ = sum_product(f, Weights(w[:N_FEATURES], w[N_FEATURES:].reshape(EDGES, 2, 2)))
        expected = np.zeros((EDGES, 2, 2))
        np.add.at(expected, f.edge[child], pairs[child])
        g = np.concatenate([f.sums(y - p), (seen - expected).ravel()]) / len(y) - l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return Weights(w[:N_FEATURES], w[N_FEATURES:].reshape(EDGES, 2, 2))


def content(pages: list[str | None], w: Weights, threshold: float) -> Iterator[tuple[str, int, int, float]]:
    """(text, text nodes, kept text nodes, mean marginal of the text nodes) of each page. Kept nodes of one block are
    joined by spaces, blocks by line breaks."""
    trees = [parse(p) for p in pages]
    f = forest(trees)
    marginal, _, _ = sum_product(f, w, edges=False)
    for t, s in zip(trees, f.starts):
        lines, last, n, kept, total = [], -1, 0, 0, 0.0
        for i, text in enumerate(t.text):
            if not text:
                continue
            n += 1
            total += marginal[s + i]
            if marginal[s + i] < threshold:
                continue
            kept += 1
            block = t.parent[i]
            while block > 0 and t.tag[block] not in BLOCK:
                block = t.parent[block]
            if block == last:
                lines[-1] += " " + text
            else:
                lines.append(text)
            last = block
        yield "\n".join(lines), n, kept, total / n if n else 0.0


def training_pages(pages: DataFrame, n: int) -> list[str]:
    """The n labelled pages that come first by a hash of the page; all if there are fewer.

    Ordering alone would send n whole pages from every task to the driver. As hashes are even, the first ones lie
    below a bound that follows from the number of pages; only pages below it are looked at. Should too few of them be
    labelled, the bound is raised.
    """
    total, order = pages.count(), F.xxhash64("html", "page_id")
    share = 8 * n / max(total, 1)
    while True:
        below = pages if share >= 1 else pages.where(order < F.lit(int(-(1 << 63) + share * (1 << 64))))
        found = below.where(F.col("html").rlike("(?i)<(article|main)[\\s>]")).select("html").orderBy(order, "html").limit(n).collect()
        if len(found) == n or share >= 1:
            return [r[0] for r in found]
        share *= 16


def portions(b: pa.RecordBatch, rows: int = 128, characters: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """b in order, in slices of at most so many rows and, unless one page alone has more, so many bytes of pages."""
    sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and (i - start == rows or total + n > characters):
            yield b.slice(start, i - start)
            start, total = i, 0
        total += n
    if b.num_rows:
        yield b.slice(start)


def extract_content(pages: DataFrame, train_pages: int = 400, threshold: float = 0.5) -> DataFrame:
    """Operator 4. One row for each row of pages (page_id, html): page_id, content, n_texts, n_kept, mean_marginal.

    The model is fitted on at most train_pages labelled pages (those with an article or main element), the least by a
    hash of the page. Null and empty pages have content '' and no texts; so have all pages if none is labelled.
    """
    w = train(training_pages(pages, train_pages))
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in portions(b):
                texts = part.column(1).to_pylist()
                rows = list(content(texts, w, threshold)) if w else [("", 0, 0, 0.0)] * len(texts)
                text, n, kept, mean = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.string()), pa.array(n, pa.int32()), pa.array(kept, pa.int32()), pa.array(mean, pa.float64())], names=["page_id", "content", "n_texts", "n_kept", "mean_marginal"])

    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, content string, n_texts int, n_kept int, mean_marginal double")
