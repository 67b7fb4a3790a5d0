"""A Merkle manifest of a dataset: a digest per row, per group and for all, with proofs.

Rows are the leaves of one tree per group. The rows of a group are ordered, and while more than
one node remains, every ``fanout`` consecutive nodes (the last run may have fewer, even one)
become the digest of their digests. The top nodes of the groups, in the order of the groups,
become one root in the same way. A proof lists, from a leaf up to the root, the digests that
stand beside its own in each run.

The trees are computed by time-forward processing. Nodes are labelled by level and place; a node's
digest is a message to its parent, kept in a priority queue ordered by the label of the receiver,
so that a parent finds all its children's digests together when its turn comes. A second sweep
takes the labels backwards and hands each child what it needs to reach the root. The queue
writes sorted runs to a file of its own when it holds too much. Trees are cut into
blocks of some thousand neighbouring leaves: one sweep of a task per block, then the tops
of the blocks are the leaves of the next round. Between rounds only digests are shuffled.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import pickle
import tempfile
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import written
from .order import numbered

BLOCK = 4096        # leaves of one sweep, at most
HELD = 1 << 16      # messages a queue holds in memory
PROOF = "array<struct<left:string,right:string>>"


def digest_of(parts: list[Column]) -> Column:
    """SHA-256 over the parts, each ``-`` if null, else its length in bytes, ``:`` and its text."""
    texts = [p.cast("string") for p in parts]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, run: F.sha2(F.concat(run["left"], node, run["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """One digest for a whole proof: of its digests, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(proof, lambda run: F.concat(run["left"], run["right"]))), 256)


class Messages:
    """A priority queue of (label, message) that keeps at most ``held`` of them in memory.

    When it is full, all it holds is sorted and written as a run to a nameless temporary file of
    the task; the first message of each run stays in view.
    """

    def __init__(self, held: int = HELD):
        self.held = max(1, held)
        self.heap: list[tuple] = []
        self.fronts: list[tuple] = []   # (label, number of the run, message)
        self.runs: list[Any] = []

    def push(self, label: tuple, message: Any) -> None:
        heapq.heappush(self.heap, (label, message))
        if len(self.heap) > self.held:
            self._spill()

    def _spill(self) -> None:
        file = tempfile.TemporaryFile()
        self.heap.sort(key=lambda x: x[0])
        for entry in self.heap:
            pickle.dump(entry, file)
        self.heap.clear()
        file.seek(0)
        self.runs.append(file)
        self._advance(len(self.runs) - 1)

    def _advance(self, run: int) -> None:
        try:
            label, message = pickle.load(self.runs[run])
        except EOFError:
            self.runs[run].close()
            return
        heapq.heappush(self.fronts, (label, run, message))

    def __bool__(self) -> bool:
        return bool(self.heap or self.fronts)

    def first(self) -> tuple:
        """The smallest label."""
        if self.fronts and (not self.heap or self.fronts[0][0] < self.heap[0][0]):
            return self.fronts[0][0]
        return self.heap[0][0]

    def pop(self) -> tuple[tuple, Any]:
        if self.fronts and (not self.heap or self.fronts[0][0] < self.heap[0][0]):
            label, run, message = heapq.heappop(self.fronts)
            self._advance(run)
            return label, message
        return heapq.heappop(self.heap)


def _digest(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def rise(leaves: list[str], levels: int, fanout: int, held: int = HELD) -> tuple[str, list[tuple[int, int, list[str]]]]:
    """The top digest over ``levels`` levels, and every run of children in the order of its parent's label."""
    if not levels:
        return leaves[0], []
    messages, runs, top = Messages(held), [], ""
    for i, leaf in enumerate(leaves):
        messages.push((1, i // fanout, i), leaf)
    while messages:
        level, place, _ = messages.first()
        run = []
        while messages and messages.first()[:2] == (level, place):
            run.append(messages.pop()[1])
        runs.append((level, place, run))
        top = _digest(run)
        if level < levels:
            messages.push((level + 1, place // fanout, place), top)
    return top, runs


def hand_down(runs: list[tuple[int, int, list[str]]], levels: int, fanout: int, above: Any, held: int = HELD) -> Iterator[tuple[int, Any]]:
    """``(leaf, proof)`` from the last leaf to the first; a proof is (left, right, the rest) or what was ``above``."""
    messages = Messages(held)
    messages.push((-levels, 0), above)
    for level, place, run in reversed(runs):
        label, rest = messages.pop()
        assert label == (-level, -place), "a node's proof comes when it is its turn"
        for j, _ in enumerate(run):
            proof = ("".join(run[:j]), "".join(run[j + 1:]), rest)
            messages.push((1 - level, -(place * fanout + j)), proof)
    while messages:
        (_, place), proof = messages.pop()
        yield -place, proof


def _unfolded(proof: Any) -> tuple[list[str], list[str]]:
    """The left and right sides of a linked proof, the lowest first."""
    left, right = [], []
    while proof is not None:
        left.append(proof[0])
        right.append(proof[1])
        proof = proof[2]
    return left, right


def _linked(levels: list[dict]) -> Any:
    proof = None
    for run in reversed(levels):
        proof = (run["left"], run["right"], proof)
    return proof


def _proofs(proofs: list[Any]) -> pa.Array:
    """Linked proofs as an Arrow list of structs."""
    lefts, rights, ends = [], [], [0]
    for proof in proofs:
        left, right = _unfolded(proof)
        lefts += left
        rights += right
        ends.append(len(lefts))
    runs = pa.StructArray.from_arrays([pa.array(lefts, pa.string()), pa.array(rights, pa.string())], ["left", "right"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs)


def _height(rows: int, fanout: int) -> int:
    """Levels above ``rows`` leaves."""
    height = 0
    while rows > 1:
        rows, height = -(-rows // fanout), height + 1
    return height


def _blocks(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.Table]:
    """The rows of one (tree, block) after another; a block has at most ``held`` rows."""
    kept: list[pa.RecordBatch] = []
    known = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(batch.column("tree").to_pylist(), batch.column("block").to_pylist()))
        at = 0
        for i, key in enumerate(keys):
            if key != known:
                if i > at:
                    kept.append(batch.slice(at, i - at))
                if kept:
                    yield pa.Table.from_batches(kept)
                kept, known, at = [], key, i
        kept.append(batch.slice(at))
    if kept:
        yield pa.Table.from_batches(kept)


class Trees:
    """The levels of all trees, a round of blocks apart."""

    def __init__(self, leaves: DataFrame, most: int, fanout: int, block: int):
        """``leaves``: (tree, position, rows, digest, ..); ``most``: rows of the largest tree."""
        self.fanout = fanout
        self.levels = max(1, int(math.log(block, fanout) + 1e-9))   # of a whole block
        self.width = fanout ** self.levels
        self.rounds = [leaves]
        while most > 1:
            self.rounds.append(written(self._risen(self.rounds[-1]), "tops"))
            most = -(-most // self.width)

    def tops(self) -> DataFrame:
        """(tree, digest): the last node of each tree."""
        return self.rounds[-1].select("tree", "digest")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Blocks to tasks, in order."""
        return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "position")

    def _block(self) -> Column:
        return F.expr(f"position div {self.width}").alias("block")

    def _risen(self, nodes: DataFrame) -> DataFrame:
        fanout, width, whole = self.fanout, self.width, self.levels

        def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in _blocks(batches, width):
                n = rows.column("rows")[0].as_py()
                levels = whole if n > width else _height(n, fanout)
                top, _ = rise(rows.column("digest").to_pylist(), levels, fanout)
                yield pa.RecordBatch.from_pydict({
                    "tree": pa.array([rows.column("tree")[0].as_py()], pa.string()), "position": pa.array([rows.column("block")[0].as_py()], pa.int64()),
                    "rows": pa.array([-(-n // width)], pa.int64()), "digest": pa.array([top], pa.string()),
                })

        dealt = self._dealt(nodes.select("tree", self._block(), "position", "rows", "digest"))
        return dealt.mapInArrow(sweep, "tree string, position bigint, rows bigint, digest string")

    def proofs(self, above: DataFrame, told: str) -> DataFrame:
        """Leaves with ``proof`` and what ``above`` (tree, proof, told) says of their tree.

        ``told`` is the type of the column ``told``, handed down with the proofs.
        """
        found = above.select("tree", F.lit(0).cast("bigint").alias("position"), "proof", "told")
        for number in range(len(self.rounds) - 2, -1, -1):
            found = self._handed_down(self.rounds[number], found, told)
            if number:
                found = written(found.select("tree", "position", "proof", "told"), "proofs")
        if len(self.rounds) == 1:
            found = self._beside(self.rounds[0], found)
        return found

    def _beside(self, leaves: DataFrame, found: DataFrame) -> DataFrame:
        """Trees of one leaf each: the proof of the tree is that of the leaf."""
        return leaves.join(found.drop("position"), "tree")

    def _handed_down(self, nodes: DataFrame, above: DataFrame, told: str) -> DataFrame:
        """Every node of a round with its proof; the proof of the block's top stands before the block's nodes."""
        fanout, width, whole = self.fanout, self.width, self.levels
        columns = [c for c in nodes.columns]
        types = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
        heads = above.select(
            *[F.lit(None).cast(types[c]).alias(c) if c not in ("tree", "position") else (F.col("tree") if c == "tree" else F.lit(-1).cast("bigint").alias("position")) for c in columns],
            F.col("position").alias("block"), "proof", "told",
        )
        rows = nodes.select(*columns, self._block(), F.lit(None).cast(PROOF).alias("proof"), F.lit(None).cast(told).alias("told"))

        def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _blocks(batches, width + 1):
                head, rows = block.slice(0, 1), block.slice(1)
                n = rows.column("rows")[0].as_py()
                levels = whole if n > width else _height(n, fanout)
                _, runs = rise(rows.column("digest").to_pylist(), levels, fanout)
                found: list[Any] = [None] * rows.num_rows
                for place, proof in hand_down(runs, levels, fanout, _linked(head.column("proof")[0].as_py())):
                    found[place] = proof
                said = pa.array([head.column("told")[0].as_py()] * rows.num_rows, head.column("told").type)
                whole_rows = rows.select(columns).combine_chunks()
                arrays = [whole_rows.column(c).combine_chunks() if whole_rows.column(c).num_chunks != 1 else whole_rows.column(c).chunk(0) for c in columns]
                yield pa.RecordBatch.from_arrays([*arrays, _proofs(found), said], [*columns, "proof", "told"])

        schema = ", ".join(f"{c} {types[c]}" for c in columns)
        return self._dealt(rows.unionByName(heads)).mapInArrow(sweep, f"{schema}, proof {PROOF}, told {told}")


def manifest(df: DataFrame, fields: list[Column], group: Column, order: Column, carry: dict[str, Column] | None = None, fanout: int = 2, block: int = BLOCK) -> DataFrame:
    """A leaf per row: ``(id, leaf, subroot, root, proof)`` and the columns of ``carry``.

    ``fields`` are what a leaf's digest is made of. ``group`` is read as text; groups are ordered by
    the bytes of it, the null group first. Within a group rows are ordered by ``order``, nulls first, then by
    their digest; rows equal in both are alike and take neighbouring places. ``proof`` lists, from the leaf's run
    up to the last run under the root, the digests left and right of the node in question, joined; a
    run of one has none on either side. ``carry`` names further columns of the row to
    be handed on. Empty texts are texts of no bytes, not nulls. Texts are read once, in the scan;
    only digests, ``order`` and ``carry`` travel. An empty table has no leaves and gives no rows.
    """
    if fanout < 2 or block < fanout:
        raise ValueError("a run takes two nodes at least, a block a run")
    carry = carry or {}
    name = group.cast("string")
    leaves = df.select(
        F.coalesce(F.concat(F.lit("="), name), F.lit("-")).alias("tree"), order.alias("id"), digest_of(fields).alias("digest"),
        F.struct(F.lit(0).alias("_"), *[c.alias(n) for n, c in carry.items()]).alias("carried"), F.monotonically_increasing_id().alias("tie"),
    )
    placed = numbered(written(leaves, "leaves"), "tree", ["id", "digest", "tie"])
    nodes = placed.select("tree", "position", F.col("group_rows").alias("rows"), "digest", "id", "carried")
    trees = Trees(nodes, _largest(placed), fanout, block)
    tops = written(trees.tops().select(F.lit("").alias("all"), "tree", "digest"), "subroots")
    above = numbered(tops, "all", ["tree"])
    forest = Trees(
        above.select(F.col("all").alias("tree"), "position", F.col("group_rows").alias("rows"), "digest", F.col("tree").alias("of")), _largest(above), fanout, block,
    )
    start = forest.tops().select("tree", F.expr(f"cast(array() as {PROOF})").alias("proof"), F.col("digest").alias("told"))
    subroots = forest.proofs(start, "string").select(
        F.col("of").alias("tree"), "proof", F.struct(F.col("digest").alias("subroot"), F.col("told").alias("root")).alias("told"),
    )
    found = trees.proofs(written(subroots, "subroots"), "struct<subroot:string,root:string>")
    return found.select("id", F.col("digest").alias("leaf"), "told.subroot", "told.root", "proof", *[F.col(f"carried.`{n}`") for n in carry])


def _largest(placed: DataFrame) -> int:
    return placed.agg(F.max("group_rows")).first()[0] or 0
