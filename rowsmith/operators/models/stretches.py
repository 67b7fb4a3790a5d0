"""The upper nodes of a regression tree on one feature, each cut at its very best place however many rows it has.

A node is a stretch of the sorted values. These stay on the cluster, in blocks; the driver has a line for each block: its
weight, sum, and how far the running sum within it strays from a straight way through it. What a cut is worth is a convex
function of the weight and sum on its left, so the corners of what a block may stray to tell the most that any cut within it is
worth. Only blocks that may hold the best cut are fetched; those at the ends of a stretch always are. A target without order
cuts a few rows off an end at a time, so a tree may be thousands of nodes deep: no pass over the rows is made for a node.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1024        # values in a block
HELD_BLOCKS = 512   # blocks the driver holds
FETCHED = 64        # blocks fetched at once
LIKELY = 16         # blocks fetched if any are, the likeliest first
LINES = "first double, last double, size bigint, n double, s double, low double, high double, under double, over double"
EQUAL = 1e-12       # share of the worth within which cuts are equal; the first one is taken


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A line for each block of sorted values."""
    for batch in batches:
        v, n, s, low, high = (batch.column(c).to_numpy() for c in ("v", "n", "s", "low", "high"))
        out = []
        for at in range(0, len(v), BLOCK):
            here = slice(at, at + BLOCK)
            upto_n, upto_s = np.cumsum(n[here]), np.cumsum(s[here])
            strays = upto_s - upto_s[-1] / upto_n[-1] * upto_n
            out.append((v[here][0], v[here][-1], len(upto_n), upto_n[-1], upto_s[-1], low[here].min(), high[here].max(), min(strays.min(), 0.0), max(strays.max(), 0.0)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], [f.split()[0] for f in LINES.split(", ")])


class Stretches:
    """The sorted values with their rows' weights ``n``, sums ``s``, least and largest labels."""

    def __init__(self, rows: DataFrame):
        """``rows``: (v, w, y), the feature, weight and label."""
        values = rows.groupBy("v").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("s"), F.min("y").alias("low"), F.max("y").alias("high"))
        self.values = values.repartitionByRange("v").sortWithinPartitions("v").persist(StorageLevel.MEMORY_AND_DISK)
        found = self.values.mapInArrow(_lines, LINES).toArrow()
        order = np.argsort(found.column("first").to_numpy(), kind="stable")
        for c in found.column_names:
            setattr(self, c, found.column(c).to_numpy()[order])
        self.ends = np.cumsum(self.size)
        self.starts = self.ends - self.size
        self.held: OrderedDict[int, dict[str, np.ndarray]] = OrderedDict()

    def close(self) -> None:
        self.values.unpersist()

    def block_of(self, place: int) -> int:
        return int(np.searchsorted(self.ends, place, side="right"))

    def fetch(self, blocks: list[int]) -> None:
        """Hold some blocks."""
        for b in blocks:
            if b in self.held:
                self.held.move_to_end(b)
        blocks = sorted(b for b in set(blocks) if b not in self.held)
        for at in range(0, len(blocks), FETCHED):
            some = blocks[at:at + FETCHED]
            wanted = None
            for b in some:
                here = F.col("v").between(float(self.first[b]), float(self.last[b]))
                wanted = here if wanted is None else wanted | here
            found = self.values.where(wanted).toArrow().sort_by("v")
            columns = {c: found.column(c).to_numpy() for c in found.column_names}
            at_block = np.searchsorted(columns["v"], [self.first[b] for b in some])
            for b, start in zip(some, at_block):
                self.held[b] = {c: x[start:start + self.size[b]].copy() for c, x in columns.items()}
        while len(self.held) > max(HELD_BLOCKS, len(blocks)):
            self.held.popitem(last=False)

    def part(self, b: int, start: int, stop: int) -> dict[str, np.ndarray]:
        """The places from ``start`` to ``stop`` that are in block ``b``."""
        if b not in self.held:
            self.fetch([b])
        a, z = max(start - self.starts[b], 0), min(stop - self.starts[b], self.size[b])
        return {c: x[a:z] for c, x in self.held[b].items()}

    def about(self, start: int, stop: int) -> tuple[float, float, float, float]:
        """Weight, sum, least and largest label of a stretch."""
        a, z = self.block_of(start), self.block_of(stop - 1)
        whole = slice(a + (start > self.starts[a]), z + (stop == self.ends[z]))
        pieces = [self.part(b, start, stop) for b in {a, z} if not whole.start <= b < whole.stop]
        n, s = (sum(float(p[c].sum()) for p in pieces) + float(getattr(self, c)[whole].sum()) for c in ("n", "s"))
        low = min([p["low"].min() for p in pieces] + self.low[whole].tolist())
        high = max([p["high"].max() for p in pieces] + self.high[whole].tolist())
        return n, s, low, high

    def best_cut(self, start: int, stop: int) -> tuple[int, float]:
        """(place, cut): the first of the best cuts of a stretch is behind ``place``."""
        a, z = self.block_of(start), self.block_of(stop - 1)
        self.fetch([a, z])
        ends = {b: self.part(b, start, stop) for b in (a, z)}
        n, s = (getattr(self, c)[a:z + 1].copy() for c in ("n", "s"))
        for b, part in ends.items():
            n[b - a], s[b - a] = part["n"].sum(), part["s"].sum()
        upto_n, upto_s = np.cumsum(n), np.cumsum(s)
        all_n, all_s = upto_n[-1], upto_s[-1]

        def worth(left_n: np.ndarray, left_s: np.ndarray) -> np.ndarray:
            return left_s ** 2 / left_n + (all_s - left_s) ** 2 / (all_n - left_n)

        seen: dict[int, np.ndarray] = {}

        def look_into(b: int) -> float:
            part, i = ends.get(b) or self.part(b, start, stop), b - a
            before = (upto_n[i - 1], upto_s[i - 1]) if i else (0.0, 0.0)
            last = len(part["n"]) - (b == z)      # no cut behind all
            seen[b] = worth(before[0] + np.cumsum(part["n"][:last]), before[1] + np.cumsum(part["s"][:last]))
            return seen[b].max(initial=-np.inf)

        between = worth(upto_n[:-1], upto_s[:-1])      # cuts behind whole blocks
        top = max([look_into(b) for b in ends] + [between.max(initial=-np.inf)])
        if z - a > 1:
            inner = slice(a + 1, z)
            corners = [(upto_n[i], upto_s[i] + stray) for i in (slice(0, z - a - 1), slice(1, z - a)) for stray in (self.under[inner], self.over[inner])]
            most = np.max([worth(*c) for c in corners], axis=0)
            order = np.argsort(-most, kind="stable")
            at = 0
            while at < len(order) and most[order[at]] >= top - 4 * EQUAL * abs(top):
                some = [int(b) for b in order[at:at + FETCHED] + a + 1 if most[b - a - 1] >= top - 4 * EQUAL * abs(top)]
                if any(b not in self.held for b in some):
                    self.fetch([int(b) for b in order[at:at + max(LIKELY, len(some))] + a + 1])
                top = max([look_into(b) for b in some] + [top])
                at += len(some)
        least = top - EQUAL * abs(top)
        places = [int(self.starts[b] if b > a else start) + int(np.argmax(w >= least)) for b, w in seen.items() if (w >= least).any()]
        places += [int(self.ends[a + i]) - 1 for i in np.flatnonzero(between >= least)[:1]]
        place = min(places)
        low, high = (self._value(p) for p in (place, place + 1))
        cut = low + (high - low) / 2
        return place, low if cut >= high else cut

    def _value(self, place: int) -> float:
        b = self.block_of(place)
        if place == self.starts[b]:
            return float(self.first[b])
        if place == self.ends[b] - 1:
            return float(self.last[b])
        return float(self.part(b, place, place + 1)["v"][0])


class HeldStretches(Stretches):
    """The same of rows that are at hand, in the order of ``v``."""

    def __init__(self, v: np.ndarray, w: np.ndarray, y: np.ndarray):
        at = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        columns = {"v": v[at], "n": np.add.reduceat(w, at), "s": np.add.reduceat(w * y, at), "low": np.minimum.reduceat(y, at), "high": np.maximum.reduceat(y, at)}
        for line in _lines(iter([pa.RecordBatch.from_pydict(columns)])):
            for c in line.schema.names:
                setattr(self, c, line.column(c).to_numpy())
        self.ends = np.cumsum(self.size)
        self.starts = self.ends - self.size
        self.held = {b: {c: x[a:z] for c, x in columns.items()} for b, (a, z) in enumerate(zip(self.starts, self.ends))}

    def fetch(self, blocks: list[int]) -> None:
        """All blocks are at hand."""

    def close(self) -> None:
        """Nothing is kept on the cluster."""


def split_large(nodes, values: Stretches, large: Callable[[float], bool]) -> None:
    """Split the nodes of a tree whose rows' weight is ``large``, as long as their labels and values differ."""
    try:
        open_ = [(0, 0, int(values.ends[-1]) if len(values.ends) else 0)]
        while open_:
            node, start, stop = open_.pop()
            if start == stop:       # possible where a sample of few rows is empty
                continue
            n, s, low, high = values.about(start, stop)
            if low == high or stop - start == 1:
                nodes.value[node] = [s / n]
            elif large(n):
                place, cut = values.best_cut(start, stop)
                first = nodes.split(node, 0, cut)
                open_ += [(first + 1, place + 1, stop), (first, start, place + 1)]
    finally:
        values.close()
