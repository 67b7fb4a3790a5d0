"""Exact nearest neighbours as a two-round partitioned join.

Training rows with equal features are first cut to the k smallest keys (no other of them
can be a neighbour). A small tree of median cuts, built from a bounded sample, divides the
feature space into leaves. Round one compares each query with the rows of its own leaf; the
k-th distance found there bounds the search, and round two sends the query only to leaves
whose box comes that close. Large leaves are cut into blocks on both sides, so a task never
holds more than one block of each, and only the k best per query leave a task. Ties in
distance go to the smaller key. (Two-round scheme: Zhang, Li and Jestes 2012.)

The sample decides only where the cuts are, never the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ...errors import ContractViolation
from ...session import cut_lineage
from .base import Fitted, Frame, shares

LEAF_ROWS = 4_000       # aimed-at training rows per leaf
MAX_LEAVES = 1 << 14    # leaves the driver and every task may hold,
MAX_CELLS = 1 << 19     # fewer where leaves x features would pass this
BLOCK_ROWS = 20_000     # rows of one side of a block
SAMPLE_ROWS = 200_000   # rows (fewer for wide features) that decide the cuts
KEY_TYPES = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string()}


class Cuts:
    """Median cuts in flat arrays: per node its cut, its children or leaf number, and its box."""

    FIELDS = ("axis", "value", "left", "right", "leaf", "low", "high")

    def __init__(self, columns: dict):
        for name in self.FIELDS:
            setattr(self, name, np.asarray(columns[name], dtype=float if name in ("value", "low", "high") else int))
        self.leaves = int((self.leaf >= 0).sum())

    def columns(self) -> dict:
        return {name: getattr(self, name).tolist() for name in self.FIELDS}

    @classmethod
    def build(cls, sample: np.ndarray, leaves: int) -> Cuts:
        d = sample.shape[1]
        nodes: dict[str, list] = {name: [] for name in cls.FIELDS}
        made = 0

        def grow(rows, want, low, high):
            nonlocal made
            here = len(nodes["axis"])
            for name, start in zip(cls.FIELDS, (-1, 0.0, -1, -1, -1, low, high)):
                nodes[name].append(start)
            spans = np.ptp(rows, axis=0) if len(rows) else np.zeros(d)
            j = int(spans.argmax())
            if want < 2 or spans[j] == 0:
                nodes["leaf"][here] = made
                made += 1
                return here
            cut = float(np.median(rows[:, j]))
            if cut >= rows[:, j].max():  # most rows share the largest value: cut below it
                cut = float(rows[rows[:, j] < cut, j].max())
            below = rows[:, j] <= cut
            left_high, right_low = high.copy(), low.copy()
            left_high[j] = right_low[j] = cut
            nodes["axis"][here], nodes["value"][here] = j, cut
            nodes["left"][here] = grow(rows[below], want // 2, low, left_high)
            nodes["right"][here] = grow(rows[~below], want - want // 2, right_low, high)
            return here

        grow(sample, leaves, np.full(d, -np.inf), np.full(d, np.inf))
        return cls(nodes)

    def home(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row."""
        at = np.zeros(len(x), dtype=int)
        while (inner := np.flatnonzero(self.leaf[at] < 0)).size:
            node = at[inner]
            below = x[inner, self.axis[node]] <= self.value[node]
            at[inner] = np.where(below, self.left[node], self.right[node])
        return self.leaf[at]

    def within(self, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, leaf) where the leaf's box is no farther than ``reach`` (squared).

        Walks down the tree level by level and drops a branch once its box is too far.
        """
        rows, nodes = np.arange(len(x)), np.zeros(len(x), dtype=int)
        found_rows, found_leaves = [], []
        while rows.size:
            done = self.leaf[nodes] >= 0
            found_rows.append(rows[done])
            found_leaves.append(self.leaf[nodes[done]])
            rows, nodes = rows[~done], nodes[~done]
            rows = np.concatenate([rows, rows])
            nodes = np.concatenate([self.left[nodes], self.right[nodes]])
            gap = np.maximum(np.maximum(self.low[nodes] - x[rows], x[rows] - self.high[nodes]), 0.0)
            # a hair of slack, so that rounding never drops a leaf
            near = np.einsum("rd,rd->r", gap, gap) <= reach[rows] * (1 + 1e-9)
            rows, nodes = rows[near], nodes[near]
        return np.concatenate(found_rows), np.concatenate(found_leaves)


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Added up feature by feature, in feature order."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = a[:, j][:, None] - b[:, j][None, :]
        total += gap * gap
    return total


def _nearest(queries: pa.Table, train: pa.Table, k: int, schema: pa.Schema) -> pa.Table:
    """For each query of a block its k nearest rows of the other block, ordered by (distance, key)."""
    q, n = _matrix(queries["x"], queries.num_rows), train.num_rows
    # in key order a stable sort by distance settles ties
    train = train.sort_by("k")
    t = _matrix(train["x"], n)
    keys, labels = train["k"].combine_chunks(), train["y"].to_numpy()
    at_once = max(1, 4_000_000 // max(n, 1))
    who, dist, pick = [], [], []
    for start in range(0, len(q), at_once):
        d = squared_distances(q[start : start + at_once], t)
        rows = np.arange(len(d))[:, None]
        if n > k:
            edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
            order = np.stack([
                (c := np.flatnonzero(d[i] <= edge[i]))[np.argsort(d[i][c], kind="stable")[:k]] for i in range(len(d))
            ])
        else:
            order = np.argsort(d, axis=1, kind="stable")
        who.append(np.repeat(np.arange(start, start + len(d)), order.shape[1]))
        dist.append(d[rows, order].ravel())
        pick.append(order.ravel())
    who, dist, pick = np.concatenate(who), np.concatenate(dist), np.concatenate(pick)
    return pa.Table.from_arrays(
        [queries["q"].combine_chunks().take(pa.array(who)), pa.array(dist), keys.take(pa.array(pick)), pa.array(labels[pick])],
        schema=schema,
    )


class Neighbours(Fitted):
    """Nearest training rows of each scored row, whatever its key; class vote or mean label."""

    def nearest(self, df: DataFrame, key: str) -> DataFrame:
        """(key, near): ``near`` lists up to k (distance squared, key, label) in order."""
        s = self.state
        k, train = s["k"], self.tables["train"]
        cuts = Cuts(s["cuts"])
        key_type = df.schema[key].dataType
        if key_type not in KEY_TYPES or train.schema["k"].dataType not in KEY_TYPES:
            raise ContractViolation("nearest neighbours need a whole number or text as the row key")
        out = T.StructType([
            T.StructField("q", key_type), T.StructField("d", T.DoubleType()),
            T.StructField("k", train.schema["k"].dataType), T.StructField("y", T.DoubleType()),
        ])
        arrow = pa.schema([
            ("q", KEY_TYPES[key_type]), ("d", pa.float64()),
            ("k", KEY_TYPES[train.schema["k"].dataType]), ("y", pa.float64()),
        ])
        queries = df.select(F.col(key).alias("q"), vector_to_array("features").alias("x"))

        def homes(batches):
            for b in batches:
                leaf = cuts.home(_matrix(b.column("x"), b.num_rows)) if b.num_rows else np.zeros(0, int)
                yield b.append_column("leaf", pa.array(leaf, pa.int32()))

        at_home = queries.mapInArrow(homes, T.StructType([*queries.schema.fields, T.StructField("leaf", T.IntegerType())]))

        def compare(wanted: DataFrame) -> DataFrame:
            """k best per (query, leaf, block of the leaf)."""
            # one row per leaf: at most MAX_LEAVES
            loads = wanted.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("qn"))
            sizes = train.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("tn"))
            blocks = F.broadcast(loads.join(sizes, "leaf"))
            left = wanted.join(blocks, "leaf").select(
                "q", "x", "leaf",
                F.pmod(F.xxhash64("q"), F.col("qn")).cast("int").alias("qb"),
                F.explode(F.sequence(F.lit(0), F.col("tn") - 1)).alias("tb"),
            )
            right = train.join(blocks, "leaf").select(
                "k", "x", "y", "leaf",
                F.pmod(F.xxhash64("k"), F.col("tn")).cast("int").alias("tb"),
                F.explode(F.sequence(F.lit(0), F.col("qn") - 1)).alias("qb"),
            )

            def best(a: pa.Table, b: pa.Table) -> pa.Table:
                if not a.num_rows or not b.num_rows:
                    return arrow.empty_table()
                return _nearest(a, b, k, arrow)

            group = ("leaf", "qb", "tb")
            return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(best, out)

        def merged(found: DataFrame) -> DataFrame:
            """Per query the k best of its few lists."""
            lists = found.groupBy("q").agg(F.collect_list(F.struct("d", "k", "y")).alias("near"))
            return lists.select("q", F.slice(F.array_sort("near"), 1, k).alias("near"))

        first = merged(compare(at_home))
        if cuts.leaves > 1:
            first = cut_lineage(at_home.join(first, "q", "left"))

            def reach_out(batches):
                for b in batches:
                    if not b.num_rows:
                        continue
                    x = _matrix(b.column("x"), b.num_rows)
                    home, far = b.column("leaf").to_numpy(), b.column("far").to_numpy(zero_copy_only=False)
                    for start in range(0, len(x), 1_000):
                        part = slice(start, start + 1_000)
                        rows, leaves = cuts.within(x[part], far[part])
                        rows += start
                        away = leaves != home[rows]
                        take = pa.array(rows[away])
                        yield pa.RecordBatch.from_arrays(
                            [b.column("q").take(take), b.column("x").take(take), pa.array(leaves[away], pa.int32())],
                            ["q", "x", "leaf"],
                        )

            far = F.when(F.size("near") == k, F.element_at("near", -1)["d"]).otherwise(F.lit(float("inf")))
            wanted = first.select("q", "x", "leaf", far.alias("far")).mapInArrow(reach_out, at_home.schema)
            again = compare(cut_lineage(wanted))
            own = first.select("q", F.inline("near")).select("q", "d", "k", "y")
            first = merged(own.unionByName(again))
        return first.withColumnRenamed("q", key)

    def transform(self, df: DataFrame) -> DataFrame:
        # scored rows need not have a key, and keys may repeat: each row gets a number of its own,
        # written down so that it stays the same
        key = "_scored_row"
        df = cut_lineage(df.withColumn(key, F.monotonically_increasing_id()))
        near = self.nearest(df, key)
        k, classes = self.state["k"], self.state["classes"]
        labels = F.transform("near", lambda n: n["y"])
        if not classes:
            mean = F.aggregate(labels, F.lit(0.0), lambda a, v: a + v) / F.size(labels)
            answer = near.select(key, mean.alias("prediction"))
        else:
            votes = F.transform(
                F.sequence(F.lit(0), F.lit(classes - 1)),
                lambda c: F.size(F.filter(labels, lambda v: v == c)).cast("double"),
            )
            answer = near.select(key, votes.alias("_votes")).select(
                key,
                (F.array_position("_votes", F.array_max("_votes")) - 1).cast("double").alias("prediction"),
                shares(F.col("_votes")).alias("probability"),
            )
        return df.join(answer, key, "left").drop(key)


def neighbours(frame: Frame, k: int = 5, leaf_rows: int = LEAF_ROWS) -> Neighbours:
    rows = frame.df.select(
        F.col(frame.key).alias("k"), vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y")
    )
    # of rows with equal features only the k smallest keys can be neighbours; the limit is
    # applied before the shuffle as well
    place = F.row_number().over(W.partitionBy("x").orderBy("k"))
    train = rows.withColumn("_n", place).where(F.col("_n") <= k).drop("_n")
    most = max(1, min(MAX_LEAVES, MAX_CELLS // frame.width))
    leaves = int(min(most, max(1, frame.rows // leaf_rows)))
    wanted = min(SAMPLE_ROWS, max(10_000, 20_000_000 // max(frame.width, 1)))
    share = min(1.0, wanted / frame.rows)
    if leaves > 1:
        picked = frame.arrays.select("x") if share == 1.0 else frame.arrays.select("x").sample(share, seed=frame.seed)
        points = picked.limit(2 * wanted).toArrow()
        sample = np.unique(_matrix(points["x"], points.num_rows), axis=0)
    else:
        sample = np.zeros((0, frame.width))
    cuts = Cuts.build(sample, leaves)

    def leaf_of(batches):
        for b in batches:
            leaf = cuts.home(_matrix(b.column("x"), b.num_rows)) if b.num_rows else np.zeros(0, int)
            yield b.append_column("leaf", pa.array(leaf, pa.int32()))

    placed = train.mapInArrow(leaf_of, T.StructType([*train.schema.fields, T.StructField("leaf", T.IntegerType())]))
    state = {
        "k": k, "key": frame.key, "classes": frame.n_classes,
        "cuts": cuts.columns(),
    }
    return Neighbours(state, tables={"train": cut_lineage(placed)})


def knn_classifier(frame: Frame, k: int = 5, leaf_rows: int = LEAF_ROWS) -> Neighbours:
    """Majority of the k nearest, ties to the smallest class."""
    return neighbours(frame, k, leaf_rows)


def knn_regressor(frame: Frame, k: int = 5, leaf_rows: int = LEAF_ROWS) -> Neighbours:
    """Mean label of the k nearest."""
    return neighbours(frame, k, leaf_rows)
