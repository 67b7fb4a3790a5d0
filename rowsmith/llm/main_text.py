"""Main text of web pages: boosted trees over the nodes of the DOM, decoded by hierarchy.

Every block element and every run of text is a node with features of its subtree (text, links,
blocks), its tag and attribute words and those of its ancestors, its depth and its siblings.
Gradient-boosted trees give each node the odds that it holds main text. The labelling with the
highest likelihood is then found under the rule that what is inside a dropped node is dropped:
from the leaves up each node adds what its children are worth, from the root down it is decided.

The trees are trained on made-up layouts with known main text, and on a bounded sample of the
pages themselves whose markup names their article.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dom import Page, read
from .layouts import Layout
from .learning import about
from .words import row_slices

LAYOUTS = 800       # made-up pages trained on
SAMPLE_PAGES = 300  # pages of the table trained on, where their markup names the article,
SAMPLE_CHARS = 200_000  # if no longer than this (in training only; every page is extracted whole)
TREES, DEPTH, BINS, RATE, RIDGE = 60, 4, 32, 0.25, 1.0
SMOOTHING = 4.0     # added to the counts behind a word's weight
PAGE_SLICE = 2 << 20
NOT_MAIN = frozenset("nav footer aside header form".split())

FEATURES = [
    "tag", "words_least", "words_most", "above_least", "above_most", "depth", "chars", "of_page", "link_share", "blocks", "block_chars",
    "longest_block", "stops_per_word", "begins_at", "ends_at", "place_among_siblings", "siblings", "sibling_chars", "of_parent", "same_tag",
    "chars_before", "chars_after", "parent_link_share", "controls", "children", "is_text",
]


@dataclass
class Nodes:
    """Nodes of several pages after each other; a parent comes before its children, -1 is none."""

    page: np.ndarray
    parent: np.ndarray
    tag: list[str]
    tokens: list[tuple[str, ...]]
    text: list[str]
    linked: np.ndarray
    controls: np.ndarray

    @classmethod
    def of(cls, pages: list[Page]) -> Nodes:
        sizes = [len(p.parent) for p in pages]
        base = np.cumsum([0, *sizes[:-1]]) if sizes else np.zeros(0, np.int64)
        parent = np.array([q for p in pages for q in p.parent], np.int64)
        page = np.repeat(np.arange(len(pages)), sizes)
        return cls(
            page, np.where(parent < 0, -1, parent + base[page]) if len(parent) else parent, [t for p in pages for t in p.tag], [t for p in pages for t in p.tokens],
            [t for p in pages for t in p.text], np.array([n for p in pages for n in p.linked], float), np.array([n for p in pages for n in p.controls], float),
        )

    def levels(self) -> list[np.ndarray]:
        """Nodes by depth, from the roots on."""
        out, depth = [], self.depth()
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange((depth.max() if len(depth) else -1) + 2))
        for a, b in zip(cuts[:-1], cuts[1:]):
            out.append(order[a:b])
        return out

    def depth(self) -> np.ndarray:
        depth, parent = [0] * len(self.parent), self.parent.tolist()
        for i, p in enumerate(parent):
            if p >= 0:
                depth[i] = depth[p] + 1
        return np.array(depth, np.int64)


def features(nodes: Nodes, weights: dict[str, float]) -> np.ndarray:
    """FEATURES of every node; ``weights`` are those of tags (``<tag>``) and attribute words."""
    n, parent, levels = len(nodes.parent), nodes.parent, nodes.levels()
    x = np.zeros((n, len(FEATURES)))
    if not n:
        return x
    col = {name: x[:, i] for i, name in enumerate(FEATURES)}
    inner = np.flatnonzero(parent >= 0)
    own = np.array([len(t) for t in nodes.text], float)
    leaf = own > 0
    stops = np.array([t.count(".") + t.count(",") + t.count("!") + t.count("?") + t.count(";") if t else 0 for t in nodes.text], float)
    words = np.array([t.count(" ") + 1 if t else 0 for t in nodes.text], float)
    sums = {"chars": own.copy(), "linked": nodes.linked.copy(), "blocks": leaf.astype(float), "stops": stops, "words": words, "controls": nodes.controls.copy()}
    longest = own.copy()
    for level in reversed(levels[1:]):
        for total in sums.values():
            np.add.at(total, parent[level], total[level])
        np.maximum.at(longest, parent[level], longest[level])
    chars, blocks = sums["chars"], np.maximum(sums["blocks"], 1)
    page_chars = np.bincount(nodes.page, own)[nodes.page]
    before = np.cumsum(own) - own  # text before a node, in page order
    page_start = np.zeros(int(nodes.page.max()) + 1)
    np.add.at(page_start, nodes.page, own)
    page_start = np.concatenate([[0], np.cumsum(page_start)[:-1]])[nodes.page]
    tags = {t: weights.get(f"<{t}>", 0.0) for t in set(nodes.tag)}
    col["tag"][:] = [tags[t] for t in nodes.tag]
    spans = {t: (min((weights.get(w, 0.0) for w in t), default=0.0), max((weights.get(w, 0.0) for w in t), default=0.0)) for t in set(nodes.tokens)}
    both = np.array([spans[t] for t in nodes.tokens])
    col["words_least"][:], col["words_most"][:] = np.minimum(both[:, 0], 0), np.maximum(both[:, 1], 0)
    low, high = np.minimum(both[:, 0], np.minimum(col["tag"], 0)), np.maximum(both[:, 1], np.maximum(col["tag"], 0))
    for d, level in enumerate(levels):
        col["depth"][level] = d
        if d:
            up = parent[level]
            col["above_least"][level] = np.minimum(col["above_least"][up], low[up])
            col["above_most"][level] = np.maximum(col["above_most"][up], high[up])
    col["chars"][:] = np.log1p(chars)
    col["of_page"][:] = chars / np.maximum(page_chars, 1)
    col["link_share"][:] = sums["linked"] / np.maximum(chars, 1)
    col["blocks"][:] = np.log1p(sums["blocks"])
    col["block_chars"][:] = np.log1p(chars / blocks)
    col["longest_block"][:] = np.log1p(longest)
    col["stops_per_word"][:] = sums["stops"] / np.maximum(sums["words"], 1)
    col["begins_at"][:] = (before - page_start) / np.maximum(page_chars, 1)
    col["ends_at"][:] = (before - page_start + chars) / np.maximum(page_chars, 1)
    # siblings: by parent, in page order; pages themselves are parents of their roots
    group = np.where(parent >= 0, parent, n + nodes.page)
    order = np.argsort(group, kind="stable")
    g = group[order]
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    size = np.diff(np.append(first, n))
    place = np.arange(n) - np.repeat(first, size)
    col["siblings"][order] = np.log1p(np.repeat(size, size))
    col["place_among_siblings"][order] = place / np.repeat(size, size)
    total = np.repeat(np.add.reduceat(chars[order], first), size)
    col["sibling_chars"][order] = np.log1p((total - chars[order]) / np.maximum(np.repeat(size, size) - 1, 1))
    col["of_parent"][order] = chars[order] / np.maximum(total, 1)
    previous, following = np.zeros(n), np.zeros(n)
    same = g[1:] == g[:-1]
    previous[1:][same], following[:-1][same] = chars[order][:-1][same], chars[order][1:][same]
    col["chars_before"][order], col["chars_after"][order] = np.log1p(previous), np.log1p(following)
    codes = {t: i for i, t in enumerate(tags)}
    kind = group * len(codes) + np.array([codes[t] for t in nodes.tag])
    _, inverse, alike = np.unique(kind, return_inverse=True, return_counts=True)
    number = np.zeros(n)
    number[order] = np.repeat(size, size)
    col["same_tag"][:] = alike[inverse] / number
    col["parent_link_share"][inner] = col["link_share"][parent[inner]]
    col["controls"][:] = sums["controls"] / blocks
    col["children"][:] = np.log1p(np.bincount(parent[inner], minlength=n))
    col["is_text"][:] = leaf
    return x


@dataclass
class Boosted:
    """Complete trees over binned features: feature and bin of each cut, and the value of each leaf."""

    cuts: list[np.ndarray]
    base: float
    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(c, v, "right") for c, v in zip(self.cuts, x.T)], axis=1).astype(np.uint8)
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, bin_, value in zip(self.feature, self.bin, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (bins[rows, feature[at]] > bin_[at])
            total += value[at - (2**DEPTH - 1)]
        return total


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Gradient boosting of the logistic loss with histograms of binned features."""
    cuts = [np.unique(np.quantile(v, np.arange(1, BINS) / BINS)) for v in x.T]
    bins = np.stack([np.searchsorted(c, v, "right") for c, v in zip(cuts, x.T)], axis=1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    total, inner = np.full(len(y), base), 2**DEPTH - 1
    model = Boosted(cuts, base, np.zeros((TREES, inner), np.int64), np.full((TREES, inner), BINS, np.int64), np.zeros((TREES, inner + 1)))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h, at = y - p, p * (1 - p), np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            start, count = 2**level - 1, 2**level
            gain, best = np.full(count, 1e-9), np.zeros((count, 2), np.int64) + [0, BINS]
            for f in range(x.shape[1]):
                cell = (at - start) * BINS + bins[:, f]
                sums_g = np.cumsum(np.bincount(cell, g, count * BINS).reshape(count, BINS), axis=1)
                sums_h = np.cumsum(np.bincount(cell, h, count * BINS).reshape(count, BINS), axis=1)
                all_g, all_h = sums_g[:, -1:], sums_h[:, -1:]
                gains = sums_g**2 / (sums_h + RIDGE) + (all_g - sums_g) ** 2 / (all_h - sums_h + RIDGE) - all_g**2 / (all_h + RIDGE)
                top = gains[:, :-1].argmax(1)
                better = gains[np.arange(count), top] > gain
                gain[better], best[better] = gains[np.arange(count), top][better], np.stack([np.full(count, f), top], axis=1)[better]
            model.feature[t, start:start + count], model.bin[t, start:start + count] = best.T
            at = 2 * at + 1 + (bins[np.arange(len(y)), model.feature[t][at]] > model.bin[t][at])
        leaf = at - inner
        model.value[t] = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + RIDGE)
        total += model.value[t][leaf]
    return model


def word_weights(nodes: Nodes, y: np.ndarray) -> dict[str, float]:
    """Log odds of tags and attribute words: of the nodes that have them, and with all below them main or not."""
    base = float(np.log((y.sum() + 1) / ((1 - y).sum() + 1)))
    seen: dict[str, list[float]] = {}
    for tag, tokens, label in zip(nodes.tag, nodes.tokens, y.tolist()):
        for word in (f"<{tag}>", *set(tokens)):
            pair = seen.setdefault(word, [0.0, 0.0])
            pair[int(label)] += 1
    return {w: float(np.log((b + SMOOTHING * np.exp(base) / (1 + np.exp(base))) / (a + SMOOTHING / (1 + np.exp(base)))) - base) for w, (a, b) in seen.items()}


def decode(nodes: Nodes, margin: np.ndarray) -> np.ndarray:
    """Nodes kept in the likeliest labelling without contradictions.

    What is inside a dropped node is dropped, and a kept element keeps at least one of its
    children; so an element without any text is dropped, and if a page's root is worth keeping,
    so is some text. Worth is the gain in log likelihood of keeping a node as well as it can be.
    """
    levels, parent = nodes.levels(), nodes.parent
    worth = np.where([bool(t) for t in nodes.text], margin, -np.inf)
    gain, best = np.zeros(len(parent)), np.full(len(parent), -np.inf)  # of children: all that gain, and the best
    for level in reversed(levels):
        inner = level[best[level] > -np.inf]
        worth[inner] = margin[inner] + np.where(best[inner] > 0, gain[inner], best[inner])
        below = level[parent[level] >= 0]
        np.add.at(gain, parent[below], np.maximum(worth[below], 0))
        np.maximum.at(best, parent[below], worth[below])
    kept = worth > 0
    for level in levels[1:]:
        up = parent[level]
        kept[level] = kept[up] & (kept[level] | ((best[up] <= 0) & (worth[level] == best[up])))
    return kept


@dataclass
class Extractor:
    weights: dict[str, float]
    trees: Boosted

    def texts(self, pages: list[Page]) -> list[str]:
        """The main text of each page: kept blocks in page order, one a line."""
        nodes = Nodes.of(pages)
        out: list[list[str]] = [[] for _ in pages]
        if nodes.tag:
            kept = decode(nodes, self.trees.margin(features(nodes, self.weights)))
            for i in np.flatnonzero(kept).tolist():
                if nodes.text[i]:
                    out[nodes.page[i]].append(nodes.text[i])
        return ["\n".join(blocks) for blocks in out]


def _labelled(page: Page, main: list[str]) -> list[float]:
    """1 for the leaves with the main blocks, matched in order, and for all that contain one."""
    label, at = [0.0] * len(page.parent), 0
    for i, text in enumerate(page.text):
        if text and at < len(main) and text == " ".join(main[at].split()):
            label[i], at = 1.0, at + 1
    return _upwards(page, label)


def _upwards(page: Page, label: list[float]) -> list[float]:
    for i in range(len(label) - 1, -1, -1):
        if label[i] and page.parent[i] >= 0:
            label[page.parent[i]] = 1.0
    return label


def _named(page: Page) -> list[float] | None:
    """Labels of a page with one ``article`` or, without any, one ``main``; else none.

    Elements inside that are menus, headers, footers, asides or forms are not main text.
    """
    wanted = next((t for t in ("article", "main") if page.tag.count(t) == 1), None)
    if wanted is None or (wanted == "main" and "article" in page.tag):
        return None
    inside, label = [False] * len(page.parent), [0.0] * len(page.parent)
    for i, (p, tag, text) in enumerate(zip(page.parent, page.tag, page.text)):
        inside[i] = tag == wanted or (p >= 0 and inside[p] and tag not in NOT_MAIN)
        label[i] = float(bool(text) and inside[i])
    return _upwards(page, label) if any(label) else None


def learn(pages: DataFrame | None = None, id_col: str = "page_id", html_col: str = "html", layouts: int = LAYOUTS, sample_pages: int = SAMPLE_PAGES) -> Extractor:
    """Train on ``layouts`` made-up pages and about ``sample_pages`` rows of ``pages``."""
    read_pages, labels = [], []
    for seed in range(layouts):
        layout = Layout(seed)
        page = read(layout.html)
        read_pages.append(page)
        labels += _labelled(page, layout.main)
    if pages is not None:
        rows = about(pages.where(F.char_length(html_col) <= SAMPLE_CHARS).select(F.col(id_col).alias("id"), F.col(html_col).alias("html")), F.xxhash64("id"), sample_pages)
        for html in sorted(r["html"] for r in rows.collect()):
            page = read(html)
            named = _named(page)
            if named is not None:
                read_pages.append(page)
                labels += named
    nodes, y = Nodes.of(read_pages), np.array(labels)
    weights = word_weights(nodes, y)
    return Extractor(weights, boost(features(nodes, weights), y))


def extract(pages: DataFrame, model: Extractor, html_col: str = "html") -> DataFrame:
    """``(row, text)``: the main text of each page; ``row`` is a struct of all columns of ``pages``.

    Blocks are in page order, one a line, with character references decoded and white space made
    one blank; a null or empty page, or one without main text, has the empty text. Pages are read
    whole; repeated rows stay; an empty table gives an empty one.
    """
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), F.col(html_col).cast("string").alias("html"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            for part in row_slices(batch, "html", PAGE_SLICE):
                read_pages = [read(html or "", known) for html in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(model.texts(read_pages), pa.string())], ["row", "text"])

    return rows.mapInArrow(each, T.StructType([rows.schema["row"], T.StructField("text", T.StringType())]))
