"""Trees of any depth: single trees, forests, bagging and extremely randomised trees.

Nodes with more rows than a task takes are split on the cluster, level by level and for all trees side by side, from sums
over their rows. As soon as a node's rows fit a task they are sent there and the subtree below is
finished in it, to pure leaves. What is drawn at random (bootstrap weights, features of a node, cuts)
comes from hashes of the row's key, the tree, and the node's way from the root, so that the trees do not
depend on how rows lie. Subtrees stay a table; scoring holds all trees where they fit a worker, and else
sends the rows to their subtrees in all trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ...session import cut_lineage
from .base import Fitted, Frame, features_array, first_max, rows_of, sum_over_rows
from .boosting import binned, cut_points
from .stretches import HeldStretches, Stretches, split_large

TASK_ROWS = 100_000         # rows of a subtree finished in one task
NODE_SUMS = 1 << 21         # numbers in one array of large nodes' sums; some models are fitted at a time
ROWS_PER_TASK = 20_000      # and of subtrees that share a task, at least
HELD_NODES = 1 << 21        # nodes that scoring holds at once; of trees with more in all, a subtree at a time
DEALT = 256                 # places that rows without a subtree are dealt to
ALL, ROOT = "all", "sqrt"   # features tried at a node
PADDED, FEW_CLASSES = 256, 16   # nodes of at most as many rows (and classes) are looked into side by side
AT_HAND = 4096              # rows of a node on one feature that are looked into whole
AT_ONCE = 1 << 20           # rows of these at once
SEARCHED = 64               # cuts on one feature that are searched, not followed
PRESORTED = 16              # features of which the rows' order is kept
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit number over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash(a, b) -> np.ndarray:
    golden = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        return _mix(_mix(np.atleast_1d(np.asarray(a, np.uint64)) + golden) ^ (np.atleast_1d(np.asarray(b, np.uint64)) * golden))


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(float) / float(1 << 53)


@dataclass(frozen=True)
class Plan:
    """What kind of trees: ``classes`` 0 for means, ``drawn`` cuts or best ones, and the features tried at a node."""

    classes: int
    trees: int
    drawn: bool
    subset: str
    bootstrap: bool
    seed: int

    @property
    def values(self) -> int:
        return max(1, self.classes)

    def tried(self, key: int, usable: np.ndarray) -> np.ndarray:
        """The features tried at a node: of those with more than one value the first by hash."""
        features = np.flatnonzero(usable)
        if self.subset == ALL:
            return features
        h = _hash(np.uint64(key), features.astype(np.uint64) + np.uint64(1 << 32))
        return np.sort(features[np.argsort(h, kind="stable")][:max(1, math.isqrt(len(usable)))])

    def tried_in(self, keys: np.ndarray, usable: np.ndarray) -> np.ndarray:
        """``tried`` of many nodes, as flags."""
        if self.subset == ALL:
            return usable
        d = usable.shape[1]
        h = _hash(keys[:, None], np.arange(d).astype(np.uint64) + np.uint64(1 << 32))
        order = np.lexsort((h, ~usable), axis=1)[:, :max(1, math.isqrt(d))]
        first = np.zeros(usable.shape, bool)
        np.put_along_axis(first, order, True, 1)
        return first & usable

    def cut_in(self, keys: np.ndarray, feature: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """``cuts`` of many nodes for one feature."""
        cut = low + _uniform(_hash(keys, feature)) * (high - low)
        return np.where(cut >= high, low, cut)

    def cuts(self, key: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """A cut for each feature, drawn evenly between its least and its largest value in the node."""
        cut = low + _uniform(_hash(np.uint64(key), np.arange(len(low)))) * (high - low)
        return np.where(cut >= high, low, cut)

    def root(self, tree: int) -> int:
        return int(_hash(self.seed, tree)[0])

    def weights(self, h: np.ndarray, tree: int) -> np.ndarray:
        """How often each row is in the tree's sample."""
        if not self.bootstrap:
            return np.ones(len(h))
        return np.searchsorted(POISSON, _uniform(_hash(h.view(np.uint64), np.uint64(self.root(tree)))), side="right").astype(float)

    def counted(self, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Per row what is summed: weights by class, or weight, sum and sum of squares."""
        return (y[:, None] == np.arange(self.classes)) * w[:, None] if self.classes else np.column_stack([w, w * y, w * y * y])


def child_key(key: int, side: int) -> int:
    """A 64-bit hash of the way to a node."""
    x = (key * 0x9E3779B97F4A7C15 + 2 * side + 1) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 31)


def child_keys(keys: np.ndarray, side: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(keys * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2 * side + 1))


def middle(low: float, high: float) -> float:
    cut = low + (high - low) / 2
    return low if cut >= high else cut


class Nodes:
    """A growing tree in lists; ``left`` -1 is a leaf, or a node whose rows go to a task (``value`` None)."""

    def __init__(self, key: int):
        self.feature, self.cut, self.left, self.key = [-1], [0.0], [-1], [key]
        self.value: list[list[float] | None] = [None]

    def split(self, node: int, feature: int, cut: float) -> int:
        first = len(self.left)
        self.feature[node], self.cut[node], self.left[node] = feature, cut, first
        self.feature += [-1, -1]
        self.cut += [0.0, 0.0]
        self.left += [-1, -1]
        self.key += [child_key(self.key[node], 0), child_key(self.key[node], 1)]
        self.value += [None, None]
        return first

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.feature), np.array(self.cut), np.array(self.left)


def reached(x: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
    """The last node each row comes to."""
    feature, cut, left = tree[:3]
    at = np.zeros(len(x), np.int64)
    rows = np.arange(len(x)) if left[0] >= 0 else np.zeros(0, np.int64)
    while len(rows):
        here = at[rows]
        at[rows] = left[here] + (x[rows, feature[here]] > cut[here])
        rows = rows[left[at[rows]] >= 0]
    return at


def finder(tree: tuple[np.ndarray, ...]):
    """``reached`` for one tree; in a large tree on one feature the place among its cuts tells the node, however deep."""
    feature, cut, left = tree[:3]
    inner = np.flatnonzero(left >= 0)
    if len(inner) < SEARCHED or feature[inner].any():
        return lambda x: reached(x, tree)
    cuts = np.sort(cut[inner])
    last = reached(np.append(cuts, np.inf)[:, None], tree)
    return lambda x: last[np.searchsorted(cuts, x[:, 0], side="left")]


# -- subtrees in a task -------------------------------------------------------------------------------


def _best_cut(v: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int) -> tuple[float, float]:
    """(worth, cut) of the best cut of one feature, whose values come in order: the sum over both sides of squared
    class weights, or of the squared sum, by the side's weight. Only cuts between different values."""
    ends = np.flatnonzero(v[1:] > v[:-1])
    n = np.cumsum(w)
    if classes:
        by_class = np.argsort(y, kind="stable")
        c, cw = y[by_class].astype(np.int64), w[by_class]
        upto = np.cumsum(cw) - cw
        starts = np.searchsorted(c, np.arange(classes + 1))
        earlier = np.empty(len(y))
        earlier[by_class] = upto - np.append(upto, 0.0)[starts[c]]
        total = np.bincount(y.astype(np.int64), w, classes)
        left = np.cumsum(w * (2 * earlier + w))
        right = (total ** 2).sum() - 2 * np.cumsum(w * total[y.astype(np.int64)]) + left
    else:
        s = np.cumsum(w * y)
        left, right = s ** 2, (s[-1] - s) ** 2
    worth = left[ends] / n[ends] + right[ends] / (n[-1] - n[ends])
    best = int(np.argmax(worth >= worth.max() - 1e-12 * abs(worth.max())))
    return float(worth[best]), middle(v[ends[best]], v[ends[best] + 1])


def _best_cuts(v: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """``_best_cut`` of many small nodes, a row of the arrays each; places behind a node's rows repeat its last value and weigh nothing."""
    n = np.cumsum(w, 1)[:, :-1]
    total, left, right = w.sum(1)[:, None], 0.0, 0.0
    for what in ([w * (y == c) for c in range(classes)] if classes else [w * y]):
        s = np.cumsum(what, 1)
        left, right = left + s[:, :-1] ** 2, right + (s[:, -1:] - s[:, :-1]) ** 2
    with np.errstate(divide="ignore", invalid="ignore"):
        worth = np.where(v[:, 1:] > v[:, :-1], left / n + right / (total - n), -np.inf)
    top = worth.max(1, keepdims=True)
    at = np.argmax(worth >= top - 1e-12 * np.abs(top), 1)
    nodes = np.arange(len(v))
    low, high = v[nodes, at], v[nodes, at + 1]
    cut = low + (high - low) / 2
    return worth[nodes, at], np.where(cut >= high, low, cut)


def _all_best_cuts(v: np.ndarray, y: np.ndarray, w: np.ndarray, starts: np.ndarray, sizes: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(worth, cut) of one feature in each node. The rows of a node lie together, in the order of the feature."""
    worth, cut = np.empty(len(starts)), np.empty(len(starts))
    alone = sizes > (PADDED if classes <= FEW_CLASSES else 0)
    for i in np.flatnonzero(alone):
        here = slice(starts[i], starts[i] + sizes[i])
        worth[i], cut[i] = _best_cut(v[here], y[here], w[here], classes)
    width = 2
    while width // 2 < PADDED:
        some = np.flatnonzero(~alone & (sizes <= width) & (sizes > width // 2))
        for nodes in np.array_split(some, len(some) * width // AT_ONCE + 1) if len(some) else []:
            place = np.arange(width)
            at = starts[nodes, None] + np.minimum(place, sizes[nodes, None] - 1)
            worth[nodes], cut[nodes] = _best_cuts(v[at], y[at], np.where(place < sizes[nodes, None], w[at], 0.0), classes)
        width *= 2
    return worth, cut


def _drawn_worths(left: np.ndarray, y: np.ndarray, w: np.ndarray, starts: np.ndarray, node: np.ndarray, classes: int) -> np.ndarray:
    """What the cut of one feature is worth in each node; ``left`` tells the side of a row, ``node`` its node's number."""
    out = 0.0
    if classes:
        _, code, = np.unique((node * 2 + left) * classes + y.astype(np.int64), return_inverse=True) if len(starts) * 2 * classes > 4 * len(y) else (None, (node * 2 + left) * classes + y.astype(np.int64))
        squares = np.bincount(code, w)[code] * w      # adds up to the squared weight of each class
    for side in (left, ~left):
        weight = np.add.reduceat(np.where(side, w, 0.0), starts)
        if classes:
            out = out + np.add.reduceat(np.where(side, squares, 0.0), starts) / weight
        else:
            out = out + np.add.reduceat(np.where(side, w * y, 0.0), starts) ** 2 / weight
    return out


def _leaf_values(y: np.ndarray, w: np.ndarray, starts: np.ndarray, node: np.ndarray, classes: int) -> np.ndarray:
    if not len(starts):
        return np.zeros((0, max(1, classes)))
    if not classes:
        sums = np.add.reduceat(w * y, starts)[:, None]
    else:
        sums = np.bincount(node * classes + y.astype(np.int64), w, len(starts) * classes).reshape(-1, classes)
    return sums / np.add.reduceat(w, starts)[:, None]


class _Open:
    """The open nodes of a growing tree and their rows: those of a node lie together, in their first order and in that of
    each feature (the latter kept from level to level where features are few)."""

    def __init__(self, x: np.ndarray, root: np.ndarray, presorted: bool):
        """``root`` tells the node that each row begins in."""
        self.x = x
        self.rows = [np.argsort(root, kind="stable")] + [np.lexsort((x[:, j], root)) for j in range(x.shape[1] if presorted else 0)]
        self.sizes = np.bincount(root)
        self._count()

    def _count(self) -> None:
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.node = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def keep(self, kept: np.ndarray) -> None:
        """The nodes in ``kept`` (a flag each) stay."""
        if not kept.all():
            of_rows = kept[self.node]
            self.rows = [r[of_rows] for r in self.rows]
            self.sizes = self.sizes[kept]
            self._count()

    def only(self, nodes: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows of some nodes (a flag each) in the order of feature ``j``, and where each node's begin."""
        of_rows = nodes[self.node]
        sizes = self.sizes[nodes]
        if len(self.rows) > 1:
            rows = self.rows[1 + j][of_rows]
        else:
            rows = self.rows[0][of_rows]
            rows = rows[np.lexsort((self.x[rows, j], self.node[of_rows]))]
        return rows, np.cumsum(sizes) - sizes

    def split(self, feature: np.ndarray, cut: np.ndarray) -> None:
        """Each node becomes two; rows keep their order."""
        goes_left = np.zeros(len(self.x), bool)
        goes_left[self.rows[0]] = self.x[self.rows[0], feature[self.node]] <= cut[self.node]
        lefts = np.add.reduceat(goes_left[self.rows[0]].astype(np.int64), self.starts)
        place = np.arange(len(self.node))
        for i, rows in enumerate(self.rows):
            left = goes_left[rows]
            before = np.cumsum(left) - left
            before -= before[self.starts][self.node]
            first = self.starts[self.node]
            out = np.empty_like(rows)
            out[np.where(left, first + before, lefts[self.node] + place - before)] = rows
            self.rows[i] = out
        self.sizes = np.column_stack([lefts, self.sizes - lefts]).ravel()
        self._count()


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, key: int, plan: Plan) -> tuple[np.ndarray, ...]:
    """(feature, cut, left, value) of a tree to pure leaves over rows that fit; rows come in the order of their keys' hashes."""
    if x.shape[1] > 1 or plan.classes or plan.drawn or len(y) <= AT_HAND:
        return _levels(x, y, w, np.zeros(len(y), np.int64), np.array([key], np.uint64), plan)
    # large nodes on one feature may lose a few rows at a time: no pass over all their rows for each
    top, order = Nodes(key), np.argsort(x[:, 0], kind="stable")
    split_large(top, HeldStretches(x[order, 0], w[order], y[order]), lambda n: n > AT_HAND)
    feature, cut, left = top.arrays()
    value = np.array([v or [0.0] for v in top.value])
    at = finder((feature, cut, left))(x)
    waiting = np.array([v is None for v in top.value]) & (left < 0)
    rows, nodes = np.flatnonzero(waiting[at]), np.flatnonzero(waiting)
    if not len(nodes):
        return feature, cut, left, value
    # the roots of the lower parts take the places of the nodes that wait, their other nodes come behind
    lower = _levels(x[rows], y[rows], w[rows], np.searchsorted(nodes, at[rows]), np.array(top.key, np.uint64)[nodes], plan)
    lower = (*lower[:2], np.where(lower[2] >= 0, lower[2] - len(nodes) + len(left), -1), lower[3])
    for whole, part in zip((feature, cut, left, value), lower):
        whole[nodes] = part[:len(nodes)]
    return tuple(np.concatenate([whole, part[len(nodes):]]) for whole, part in zip((feature, cut, left, value), lower))


def _levels(x: np.ndarray, y: np.ndarray, w: np.ndarray, root: np.ndarray, keys: np.ndarray, plan: Plan) -> tuple[np.ndarray, ...]:
    """Trees from some roots, all nodes of a level at once; ``root`` tells where each row begins, the roots come first."""
    d, classes = x.shape[1], plan.classes
    open_ = _Open(x, root, not plan.drawn and d <= PRESORTED)
    levels, nodes = [], len(keys)
    while len(keys):
        m = len(keys)
        feature, cut, left, value = np.full(m, -1), np.zeros(m), np.full(m, -1), np.zeros((m, plan.values))
        levels.append((feature, cut, left, value))

        def close(leaves: np.ndarray, at: np.ndarray) -> None:
            """Leaves (a flag each) take their values; ``at`` are the places of the open nodes in the level."""
            if leaves.any():
                of_rows = leaves[open_.node]
                rows, sizes = open_.rows[0][of_rows], open_.sizes[leaves]
                value[at[leaves]] = _leaf_values(y[rows], w[rows], np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes), classes)
                open_.keep(~leaves)

        at, label = np.arange(m), y[open_.rows[0]]
        pure = np.minimum.reduceat(label, open_.starts) == np.maximum.reduceat(label, open_.starts)
        close(pure, at)
        at, keys = at[~pure], keys[~pure]
        if not len(at):
            break
        here = x[open_.rows[0]]
        low, high = (f.reduceat(here, open_.starts, axis=0) for f in (np.minimum, np.maximum))
        tried = plan.tried_in(keys, high > low)
        best, by, where = np.zeros(len(at)), np.full(len(at), -1), np.zeros(len(at))
        for j in np.flatnonzero(tried.any(0)):
            some = tried[:, j]
            if plan.drawn:
                drawn = plan.cut_in(keys, j, low[:, j], high[:, j])
                worth = _drawn_worths(here[:, j] <= drawn[open_.node], y[open_.rows[0]], w[open_.rows[0]], open_.starts, open_.node, classes)[some] if some.all() else None
                if worth is None:
                    of_rows = some[open_.node]
                    rows, sizes = open_.rows[0][of_rows], open_.sizes[some]
                    node = np.repeat(np.arange(len(sizes)), sizes)
                    worth = _drawn_worths(x[rows, j] <= drawn[some][node], y[rows], w[rows], np.cumsum(sizes) - sizes, node, classes)
                cuts = drawn[some]
            else:
                rows, starts = open_.only(some, j)
                worth, cuts = _all_best_cuts(x[rows, j], y[rows], w[rows], starts, open_.sizes[some], classes)
            better = (by[some] < 0) | (worth > best[some] * (1 + 1e-12))
            which = np.flatnonzero(some)[better]
            best[which], by[which], where[which] = worth[better], j, cuts[better]
        alike = by < 0
        close(alike, at)
        at, keys, by, where = (v[~alike] for v in (at, keys, by, where))
        if not len(at):
            break
        feature[at], cut[at], left[at] = by, where, nodes + 2 * np.arange(len(at))
        nodes += 2 * len(at)
        open_.split(by, where)
        keys = np.column_stack([child_keys(keys, 0), child_keys(keys, 1)]).ravel()
    return tuple(np.concatenate(v) for v in zip(*levels))


# -- large nodes on the cluster -------------------------------------------------------------------------


class _Upper:
    """The upper part of all trees, split from sums over all rows."""

    def __init__(self, frame: Frame, plan: Plan, task_rows: int):
        self.frame, self.plan = frame, plan
        self.trees = [Nodes(plan.root(t)) for t in range(plan.trees)]
        self.width = plan.classes or 3
        large = [(t, 0) for t in range(plan.trees)] if frame.rows > task_rows else []
        self.table = [np.array(c) for c in cut_points(frame)] if large and not plan.drawn else []
        while large:
            bins = 1 if plan.drawn else max(len(c) for c in self.table) + 1
            at_once = max(1, NODE_SUMS // (frame.width * bins * self.width))
            after = []
            for i in range(0, len(large), at_once):
                some = large[i:i + at_once]
                after += self._drawn(some, task_rows) if plan.drawn else self._best(some, bins, task_rows)
            large = after

    def _slots(self, some: list[tuple[int, int]]) -> tuple[dict[int, tuple], dict[int, np.ndarray]]:
        """The trees of the nodes in ``some``, and for each tree the place in ``some`` of its nodes, or -1."""
        arrays = {t: self.trees[t].arrays() for t, _ in some}
        slots = {t: np.full(len(tree[2]), -1) for t, tree in arrays.items()}
        for i, (t, node) in enumerate(some):
            slots[t][node] = i
        return arrays, slots

    def _sums(self, some: list[tuple[int, int]], prepared, place, places: int) -> np.ndarray:
        """Sums over the rows of each node in ``some`` by feature and ``place(values, slot number of each row, feature)``;
        the values are those of ``prepared(x)``, made once for all trees."""
        plan, width, d = self.plan, self.width, self.frame.width
        arrays, slots = self._slots(some)

        def part(x: np.ndarray, y: np.ndarray, h: np.ndarray) -> np.ndarray:
            total = np.zeros((len(some), d, places, width))
            shown = prepared(x)
            for t, tree in arrays.items():
                mine, w = slots[t][reached(x, tree)], plan.weights(h, t)
                rows = np.flatnonzero((mine >= 0) & (w > 0))
                if not len(rows):
                    continue
                # the nodes of a tree stand together in ``some``
                first, last = slots[t][slots[t] >= 0].min(), slots[t].max() + 1
                mine, w, label = mine[rows], w[rows], y[rows]
                for j in range(d):
                    where = (mine - first) * places + place(shown[rows, j], mine, j)
                    here = total[first:last, j]
                    if plan.classes:    # a row counts for its class alone
                        here += np.bincount(where * width + label.astype(np.int64), w, here.size).reshape(here.shape)
                        continue
                    for k, what in enumerate(plan.counted(label, w).T):
                        here[..., k] += np.bincount(where, what, len(here) * places).reshape(-1, places)
            return total.ravel()

        return sum_over_rows(self.frame, part, len(some) * d * places * width).reshape(len(some), d, places, width)

    def _value(self, sums: np.ndarray) -> list[float]:
        return (sums / sums.sum()).tolist() if self.plan.classes else [float(sums[1] / sums[0])]

    def _weight(self, sums: np.ndarray) -> np.ndarray:
        return sums.sum(-1) if self.plan.classes else sums[..., 0]

    def _worths(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            out = sum(((s ** 2).sum(-1) if self.plan.classes else s[..., 1] ** 2) / self._weight(s) for s in (left, right))
        return np.where((self._weight(left) > 0) & (self._weight(right) > 0), out, -np.inf)

    def _pure(self, sums: np.ndarray) -> bool:
        if self.plan.classes:
            return (sums > 0).sum() <= 1
        n, s, q = sums
        return n * q - s * s <= 1e-12 * n * q

    def _split(self, t: int, node: int, feature: int, cut: float, left: np.ndarray, right: np.ndarray, task_rows: int) -> list[tuple[int, int]]:
        """Split a node; its children that are large and not pure."""
        tree = self.trees[t]
        first = tree.split(node, feature, cut)
        large = []
        for child, sums in ((first, left), (first + 1, right)):
            if self._pure(sums):
                tree.value[child] = self._value(sums)
            elif self._weight(sums) > task_rows:
                large.append((t, child))
        return large

    def _best(self, some: list[tuple[int, int]], bins: int, task_rows: int) -> list[tuple[int, int]]:
        """Best cuts between quantiles."""
        table, after = self.table, []
        sums = self._sums(some, lambda x: binned(x, table).astype(np.int64), lambda v, slot, j: v, bins)
        for (t, node), mine in zip(some, sums):
            total = mine[0].sum(0)
            left = np.cumsum(mine, axis=1)[:, :-1]
            worth = self._worths(left, total - left)
            tried = self.plan.tried(self.trees[t].key[node], np.isfinite(worth).any(1))
            if not len(tried) or self._pure(total):
                self.trees[t].value[node] = self._value(total)
                continue
            top = worth[tried].max()
            i, cut = np.unravel_index(np.argmax(worth[tried] >= top - 1e-12 * abs(top)), worth[tried].shape)
            j = int(tried[i])
            after += self._split(t, node, j, float(table[j][cut]), left[j, cut], total - left[j, cut], task_rows)
        return after

    def _drawn(self, some: list[tuple[int, int]], task_rows: int) -> list[tuple[int, int]]:
        """Drawn cuts: the ends of every feature in every node first, then the sums on both sides of its cut."""
        low, high = self._ends(some)
        cuts = np.array([self.plan.cuts(self.trees[t].key[node], low[i], high[i]) for i, (t, node) in enumerate(some)])
        sums = self._sums(some, lambda x: x, lambda v, slot, j: (v > cuts[slot, j]).astype(np.int64), 2)
        after = []
        for i, (t, node) in enumerate(some):
            total = sums[i, 0].sum(0)
            tried = self.plan.tried(self.trees[t].key[node], high[i] > low[i])
            if not len(tried) or self._pure(total):
                self.trees[t].value[node] = self._value(total)
                continue
            worth = self._worths(sums[i, tried, 0], sums[i, tried, 1])
            best = int(np.argmax(worth >= worth.max() - 1e-12 * abs(worth.max())))
            j = int(tried[best])
            after += self._split(t, node, j, float(cuts[i, j]), sums[i, j, 0], sums[i, j, 1], task_rows)
        return after

    def _ends(self, some: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        plan, d = self.plan, self.frame.width
        arrays, slots = self._slots(some)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, high = np.full((len(some), d), np.inf), np.full((len(some), d), -np.inf)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, _, h = rows_of(batch)
                for t, tree in arrays.items():
                    mine = slots[t][reached(x, tree)]
                    rows = np.flatnonzero((mine >= 0) & (plan.weights(h, t) > 0))
                    if not len(rows):
                        continue
                    rows = rows[np.argsort(mine[rows], kind="stable")]
                    starts = np.flatnonzero(np.append(True, mine[rows][1:] != mine[rows][:-1]))
                    at, here = mine[rows][starts], x[rows]
                    low[at] = np.minimum(low[at], np.minimum.reduceat(here, starts))
                    high[at] = np.maximum(high[at], np.maximum.reduceat(here, starts))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(low.size)), pa.array(low.ravel()), pa.array(high.ravel())], ["place", "low", "high"])

        ends = self.frame.arrays.mapInArrow(each, "place bigint, low double, high double").groupBy("place").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        rows = sorted(ends.collect())
        return np.array([r["low"] for r in rows]).reshape(len(some), d), np.array([r["high"] for r in rows]).reshape(len(some), d)


# -- fitting and scoring ---------------------------------------------------------------------------------

SUBTREE = "tree int, node int, feature array<int>, cut array<double>, left array<int>, value array<double>"


def _tasks(df: DataFrame, subtrees: int) -> int:
    """Tasks for work that is divided by subtree."""
    return int(max(1, min(subtrees, max(8 * df.sparkSession.sparkContext.defaultParallelism, subtrees // 16))))


def fit(frame: Frame, plan: Plan, task_rows: int = TASK_ROWS) -> Forest:
    if frame.rows > task_rows and frame.width == 1 and not plan.classes and not plan.drawn:
        upper = _stretches(frame, plan, task_rows)
    else:
        upper = _Upper(frame, plan, task_rows).trees
    find = [finder(t.arrays()) for t in upper]
    waiting = [np.array([v is None for v in t.value]) for t in upper]
    keys = [list(t.key) for t in upper]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, _, h = rows_of(batch)
            for t in range(plan.trees):
                at, w = find[t](x), plan.weights(h, t)
                rows = pa.array(np.flatnonzero(waiting[t][at] & (w > 0)))
                picked = batch.take(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), t, np.int32)), pa.array(at[rows].astype(np.int32)), pa.array(w[rows]), picked.column("x"), picked.column("y"), picked.column("h")],
                    ["tree", "node", "w", "x", "y", "h"],
                )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (t, node), rows in _groups(batches):
            x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
            feature, cut, left, value = grow(x, rows.column("y").to_numpy(), rows.column("w").to_numpy(), keys[t][node], plan)
            yield pa.RecordBatch.from_arrays(
                [pa.array([t], pa.int32()), pa.array([node], pa.int32()), *[pa.array([v], pa.list_(k)) for v, k in zip((feature.astype(np.int32), cut, left.astype(np.int32), value.ravel()), (pa.int32(), pa.float64(), pa.int32(), pa.float64()))]],
                ["tree", "node", "feature", "cut", "left", "value"],
            )

    dealt = frame.arrays.mapInArrow(deal, "tree int, node int, w double, x array<double>, y double, h bigint")
    # a task for each subtree where there are rows enough: a subtree costs much more than the size of its rows tells
    parts = min(_tasks(frame.df, sum(map(sum, waiting))), math.ceil(frame.rows * plan.trees / ROWS_PER_TASK))
    dealt = dealt.repartition(int(parts), "tree", "node").sortWithinPartitions("tree", "node", "h", "y")
    subtrees = cut_lineage(dealt.mapInArrow(finish, SUBTREE))
    sizes = {r["tree"]: r["n"] for r in subtrees.groupBy("tree").agg(F.sum(F.size("left")).alias("n")).collect()}
    state = {
        "classes": plan.classes, "values": plan.values, "sizes": [len(t.left) + (sizes.get(i) or 0) for i, t in enumerate(upper)],
        "upper": [[t.feature, t.cut, t.left, t.value] for t in upper],
    }
    return Forest(state, tables={"subtrees": subtrees})


def _stretches(frame: Frame, plan: Plan, task_rows: int) -> list[Nodes]:
    """The upper part of all trees on one feature: the best of all cuts, as in a task."""
    trees = []
    for t in range(plan.trees):
        def weigh(batches: Iterator[pa.RecordBatch], t: int = t) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x, y, h = rows_of(batch)
                    w = plan.weights(h, t)
                    yield pa.RecordBatch.from_arrays([pa.array(v[w > 0]) for v in (x[:, 0], w, y)], ["v", "w", "y"])

        trees.append(Nodes(plan.root(t)))
        split_large(trees[t], Stretches(frame.arrays.mapInArrow(weigh, "v double, w double, y double")), lambda n: n > task_rows)
    return trees


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.Table]]:
    """The rows of one (tree, node) after another; no more than a task takes."""
    kept: list[pa.RecordBatch] = []
    known = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t, n = batch.column("tree").to_numpy(), batch.column("node").to_numpy()
        starts = [0, *(np.flatnonzero((t[1:] != t[:-1]) | (n[1:] != n[:-1])) + 1).tolist(), len(t)]
        for a, b in zip(starts, starts[1:]):
            if (key := (int(t[a]), int(n[a]))) != known:
                if kept:
                    yield known, pa.Table.from_batches(kept)
                kept, known = [], key
            kept.append(batch.slice(a, b - a))
    if kept:
        yield known, pa.Table.from_batches(kept)


class Forest(Fitted):
    """The mean over trees of class shares or means. ``state["upper"]`` has the upper nodes, a table the subtrees."""

    def transform(self, df: DataFrame) -> DataFrame:
        keep, sizes, values = df.columns, self.state["sizes"], self.state["values"]
        if sum(sizes) > HELD_NODES:
            out = self._sent(df)
        else:
            out = df.withColumn("_sum", self._chunk(list(range(len(sizes))))(features_array()))
        out = out.withColumn("_mean", F.transform("_sum", lambda v: v / len(sizes)))
        if not self.state["classes"]:
            return out.select(*keep, F.col("_mean")[0].alias("prediction"))
        return out.select(*keep, first_max([F.col("_mean")[c] for c in range(values)]).alias("prediction"), F.col("_mean").alias("probability"))

    def _sent(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_sum``, what all trees say of a row: each row goes to the tasks that have its subtrees, once for every tree,
        and what they say is added up in the order of the trees. A task holds one subtree."""
        vectors = {f.name for f in df.schema if isinstance(f.dataType, VectorUDT)}
        cells = [(vector_to_array(f"`{c}`") if c in vectors else F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]
        rows = cut_lineage(df.select(F.struct(*cells).alias("row"), features_array().alias("x"))).withColumn("id", F.monotonically_increasing_id())
        said = self._told(rows.select("id", "x")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("tree", "value"))).alias("said"))

        def added(c: int):
            return F.aggregate("said", F.lit(0.0), lambda a, v: a + v["value"][c])

        total = F.array(*[added(c) for c in range(self.state["values"])])
        back = [(array_to_vector(f"row.c{i}") if c in vectors else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(df.columns)]
        return rows.select("id", "row").join(said, "id").select(*back, total.alias("_sum"))

    def _told(self, rows: DataFrame) -> DataFrame:
        """(id, tree, value): what each tree says of each row."""
        upper = [(np.array(feature), np.array(cut, float), np.array(left)) for feature, cut, left, _ in self.state["upper"]]
        known = [np.array([v or [0.0] * self.state["values"] for v in value], float) for *_, value in self.state["upper"]]
        waiting = [np.array([v is None for v in value]) & (np.array(left) < 0) for _, _, left, value in self.state["upper"]]
        find = [finder(t) for t in upper]

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Each row once for each tree, with the node whose subtree it needs; rows that the upper nodes answer are dealt
            to negative places."""
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                x, number = batch.column("x"), batch.column("id").to_numpy()
                values = x.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                for t in range(len(upper)):
                    at = find[t](values)
                    place = np.where(waiting[t][at], at, -1 - number % DEALT)
                    yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.full(n, t, np.int32)), pa.array(place), x], ["id", "tree", "place", "x"])

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            holder, held = None, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                trees, places = batch.column("tree").to_numpy(), batch.column("place").to_numpy()
                is_row = batch.column("is_row").to_numpy(zero_copy_only=False)
                given = batch.filter(batch.column("is_row"))
                before = np.append(0, np.cumsum(is_row))
                x = given.column("x").flatten().to_numpy(zero_copy_only=False).reshape(given.num_rows, -1) if given.num_rows else None
                value = np.empty((given.num_rows, known[0].shape[1]))
                # a subtree comes before its rows
                new = (trees[1:] != trees[:-1]) | (places[1:] != places[:-1]) | ~is_row[:-1] | ~is_row[1:]
                starts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
                for a, b in zip(starts, starts[1:]):
                    t = int(trees[a])
                    if not is_row[a]:
                        one = [batch.column(c)[a].values.to_numpy(zero_copy_only=False) for c in ("feature", "cut", "left", "subtree")]
                        holder, held = (t, places[a]), (*one[:3], one[3].reshape(len(one[2]), -1))
                        continue
                    some = slice(before[a], before[b])
                    tree, says = (held[:3], held[3]) if holder == (t, places[a]) else (upper[t], known[t])
                    value[some] = says[finder(tree)(x[some]) if len(tree[2]) < some.stop - some.start else reached(x[some], tree)]
                if given.num_rows:
                    ends = pa.array(np.arange(0, value.size + 1, value.shape[1], dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([given.column("id"), given.column("tree"), pa.ListArray.from_arrays(ends, pa.array(value.ravel()))], ["id", "tree", "value"])

        # empty arrays, since a batch takes as many steps as the square of its rows to write arrays that are null
        arrays = {"feature": "int", "cut": "double", "left": "int", "subtree": "double"}
        dealt = rows.mapInArrow(deal, "id bigint, tree int, place bigint, x array<double>").select(
            "*", F.lit(True).alias("is_row"), *[F.array().cast(f"array<{kind}>").alias(c) for c, kind in arrays.items()]
        )
        subtrees = self.tables["subtrees"].withColumnRenamed("value", "subtree").select(
            F.lit(0).cast("bigint").alias("id"), "tree", F.col("node").cast("bigint").alias("place"), F.array().cast("array<double>").alias("x"),
            F.lit(False).alias("is_row"), *arrays,
        )
        both = dealt.unionByName(subtrees).repartition(_tasks(rows, sum(int(w.sum()) for w in waiting)), "tree", "place")
        return both.sortWithinPartitions("tree", "place", "is_row").mapInArrow(finish, "id bigint, tree int, value array<double>")

    def _chunk(self, numbers: list[int]):
        """A function that adds up what some trees say of a row."""
        trees, values = self._whole(numbers), self.state["values"]

        @pandas_udf("array<double>")
        def said(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            rows = np.stack(x.to_numpy())
            out = np.zeros((len(rows), values))
            for tree in trees:
                out += tree[3][reached(rows, tree)]
            return pd.Series(list(out))

        return said

    def _whole(self, numbers: list[int]) -> list[tuple[np.ndarray, ...]]:
        """Upper nodes and subtrees of some trees in one piece."""
        parts: dict[int, list] = {t: [] for t in numbers}
        table = self.tables["subtrees"].where(F.col("tree").isin(numbers)).select("tree", "node", "feature", "cut", "left", "value").toArrow()
        for t, node, *arrays in zip(*table.columns):     # arrays as they are: lists of numbers would take many times the memory
            f, c, l, v = (a.values.to_numpy(zero_copy_only=False) for a in arrays)
            parts[t.as_py()].append((node.as_py(), f, c, l, v.reshape(len(l), -1)))
        trees = []
        for t in numbers:
            feature, cut, left, value = self.state["upper"][t]
            whole = [np.array(feature), np.array(cut, float), np.array(left), np.array([v or [0.0] * self.state["values"] for v in value])]
            at, pieces = len(left), [whole]
            for node, f, c, l, v in sorted(parts[t], key=lambda p: p[0]):
                # the subtree's root takes the place of the node; its other nodes come behind
                moved = np.where(l >= 0, l + at - 1, -1)
                whole[0][node], whole[1][node], whole[2][node], whole[3][node] = f[0], c[0], moved[0], v[0]
                pieces.append([f[1:], c[1:], moved[1:], v[1:]])
                at += len(l) - 1
            trees.append(tuple(np.concatenate(p) for p in zip(*pieces)))
        return trees


def decision_tree_classifier(frame: Frame, **options) -> Forest:
    return fit(frame, Plan(frame.n_classes, 1, False, ALL, False, frame.seed), **options)


def decision_tree_regressor(frame: Frame, **options) -> Forest:
    return fit(frame, Plan(0, 1, False, ALL, False, frame.seed), **options)


def random_forest_classifier(frame: Frame, trees: int = 100, **options) -> Forest:
    """Trees on bootstrap samples, the square root of the features tried at each node."""
    return fit(frame, Plan(frame.n_classes, trees, False, ROOT, True, frame.seed), **options)


def random_forest_regressor(frame: Frame, trees: int = 100, **options) -> Forest:
    return fit(frame, Plan(0, trees, False, ALL, True, frame.seed), **options)


def bagging_classifier(frame: Frame, trees: int = 10, **options) -> Forest:
    """Full trees on bootstrap samples over all features; class shares are averaged."""
    return fit(frame, Plan(frame.n_classes, trees, False, ALL, True, frame.seed), **options)


def extra_trees_classifier(frame: Frame, trees: int = 100, **options) -> Forest:
    """Trees on all rows; each feature tried at a node is cut once, at random between its ends in the node."""
    return fit(frame, Plan(frame.n_classes, trees, True, ROOT, False, frame.seed), **options)


def extra_trees_regressor(frame: Frame, trees: int = 100, **options) -> Forest:
    return fit(frame, Plan(0, trees, True, ALL, False, frame.seed), **options)
