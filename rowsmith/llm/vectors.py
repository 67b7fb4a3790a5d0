"""Near-duplicate embeddings by NN-descent.

Every distinct vector keeps a list of its nearest neighbours found so far. Lists begin with the
nearest in blocks of vectors whose signs along random directions agree, and are refined by
joins of neighbours with neighbours: all that list a vector, or are on its list, are compared
with each other. Lists whose last entry is still over the threshold are saturated and grow.
Entries over the threshold, checked in double precision, give the components. A list can be full
of its own component, so vectors with full lists are searched again for neighbours in other
components only, until no two components join. Within a component all pairs are compared in
blocks, so that every link there is counted however short the lists were. A sample of vectors is
compared with all others to measure what was found: it grows until it holds linked vectors of a
stated number of components, or is the whole table. The search between components goes on until
enough is found; if the last audit is still below, all vectors are compared with all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .files import written
from .graph import components
from .learning import SAMPLE_STEPS

LIST = 10            # neighbours kept at first
LONGEST_LIST = 20    # neighbours kept at most; the comparison within components and the search between them cover the rest
REVERSE = 16         # of those that list a vector, how many meet at it
BLOCK = 1024         # vectors compared with each other to begin the lists
SIGNS = 20           # random directions of a block's key
TABLES = 3           # keys a vector is blocked by
ROUNDS = 6           # refinements between two audits, fewer if little changes
SETTLED = 0.01       # share of list entries that are new, below which lists are settled
AUDITED = 256        # vectors compared with all others at first
GROWTH = 8           # times as many are next, as long as too few of them are linked
ENOUGH = 32          # components that the linked among them must be of, or all vectors are compared
LEAST_RECALL = 0.95  # share of their links that must be found, by vector and by component
AUDITS = 4           # audits before all vectors are compared with all
ASKED = 1 << 20      # numbers of the vectors that a task compares with all at once
SLACK = 0.02         # lists hold rounded vectors: entries this far below the threshold are checked
CHUNK = 2048         # vectors of one component compared in one task are two chunks at most


def units(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, unit)``: vectors scaled to length one; null if null, empty, zero or not finite in any part."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)  # a null part is not finite
            rows = np.repeat(np.arange(len(sizes)), sizes)
            ok = (sizes > 0) & (np.bincount(rows, ~np.isfinite(flat), len(sizes)) == 0)
            flat = np.where(ok[rows], flat, 0.0)
            largest = np.zeros(len(sizes))
            np.maximum.at(largest, rows, np.abs(flat))
            ok &= largest > 0
            flat = flat / np.where(largest > 0, largest, 1)[rows]
            norm = np.sqrt(np.bincount(rows, flat**2, len(sizes)))
            flat = flat / np.where(norm > 0, norm, 1)[rows]
            ends = np.concatenate([[0], np.cumsum(np.where(ok, sizes, 0))]).astype(np.int32)
            unit = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[ok[rows]]), mask=pa.array(~ok))
            yield pa.RecordBatch.from_arrays([batch.column("id"), unit], ["id", "unit"])

    rows = embeddings.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(each, "id bigint, unit array<double>")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    sizes = column.value_lengths().to_numpy()
    out = np.zeros((len(column), width))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
    return out


def _rounded(x: np.ndarray) -> list[bytes]:
    """Vectors in a byte per part, with their scale before."""
    scale = np.maximum(np.abs(x).max(1), 1e-12) / 127
    parts = np.rint(x / scale[:, None]).astype(np.int8)
    return [s.tobytes() + p.tobytes() for s, p in zip(scale.astype(np.float32), parts)]


def _unrounded(column: pa.Array, width: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width + 4)
    return raw[:, 4:].view(np.int8).astype(np.float32) * np.ascontiguousarray(raw[:, :4]).view(np.float32)


def _best(u: np.ndarray, v: np.ndarray, s: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (u, v, s) the ``keep`` best per u, each v once."""
    order = np.lexsort((v, u))
    u, v, s = u[order], v[order], s[order]
    once = np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])) if len(u) else np.zeros(0, bool)
    u, v, s = u[once], v[once], s[once]
    order = np.lexsort((v, -s, u))
    u, v, s = u[order], v[order], s[order]
    best = _ranks(u) < keep
    return u[best], v[best], s[best]


def _ranks(u: np.ndarray) -> np.ndarray:
    """Place of each row within its run of equal ``u``."""
    first = np.flatnonzero(np.append(True, u[1:] != u[:-1])) if len(u) else np.zeros(0, np.int64)
    return np.arange(len(u)) - np.repeat(first, np.diff(np.append(first, len(u))))


def _entries(u: np.ndarray, v: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(s.astype(np.float32))], ["u", "v", "s"])


def _begun(nodes: DataFrame, width: int, seed: int) -> DataFrame:
    """``(u, v, s)``: neighbours of another root within blocks of vectors in order of their signs along random directions."""
    directions = np.random.default_rng(seed).normal(size=(width, SIGNS))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                signs = _matrix(batch.column("unit"), width) @ directions > 0
                key = pa.array(signs @ (1 << np.arange(SIGNS)))
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("root"), batch.column("rounded"), key], ["node", "root", "rounded", "key"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, BLOCK):
            x, node, root = _unrounded(block.column("rounded"), width), block.column("node").to_numpy(), block.column("root").to_numpy()
            s = x @ x.T
            s[root[:, None] == root] = -2
            keep = min(LIST, len(node) - 1)
            if keep > 0:
                near = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
                best = np.take_along_axis(s, near, 1).ravel()
                other = best > -2
                yield _entries(np.repeat(node, keep)[other], node[near].ravel()[other], best[other])

    rows = nodes.select("node", "root", "unit", "rounded").mapInArrow(keyed, "node bigint, root bigint, rounded binary, key bigint")
    parts = max(2, rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartitionByRange(parts, "key", "node").sortWithinPartitions("key", "node").mapInArrow(each, "u bigint, v bigint, s float")


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows in blocks of ``size``; the last may be smaller."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        while sum(h.num_rows for h in held) >= size:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield whole.slice(0, size)
            held = [whole.slice(size)] if whole.num_rows > size else []
    if sum(h.num_rows for h in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


LISTS = "u bigint, v bigint, s float, fresh int, rank int, least float"


def _cut(entries: DataFrame, threshold: float, longest: int) -> DataFrame:
    """The best entries of each list, in the columns of LISTS: LIST of them, or up to ``longest`` that may be links.

    ``fresh`` is 1 for entries that the list did not have before, ``least`` what a new entry of the
    list has to beat.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _whole_groups(batches, "u"):
            u, v, s, fresh = (piece.column(c).to_numpy() for c in ("u", "v", "s", "fresh"))
            order = np.lexsort((fresh, v, u))  # of equal entries the one known before
            u, v, s, fresh = u[order], v[order], s[order], fresh[order]
            once = np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1]))
            u, v, s, fresh = u[once], v[once], s[once], fresh[once]
            order = np.lexsort((v, -s, u))
            u, v, s, fresh = u[order], v[order], s[order], fresh[order]
            rank = _ranks(u)
            near = s >= threshold - SLACK
            keep = (rank < LIST) | (near & (rank < longest))
            u, v, s, fresh, rank, near = u[keep], v[keep], s[keep], fresh[keep], rank[keep], near[keep]
            first = np.flatnonzero(rank == 0)
            size = np.diff(np.append(first, len(u)))
            last = s[first + size - 1]
            least = np.where(size < LIST, -2, np.where(near[first + size - 1] & (size < longest), threshold - SLACK, last)).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(u), pa.array(v), pa.array(s), pa.array(fresh.astype(np.int32)), pa.array(rank.astype(np.int32)), pa.array(np.repeat(least, size))],
                ["u", "v", "s", "fresh", "rank", "least"],
            )

    return entries.select("u", "v", "s", "fresh").repartition("u").sortWithinPartitions("u").mapInArrow(each, LISTS)


def _refined(lists: DataFrame, nodes: DataFrame, width: int, threshold: float, longest: int) -> DataFrame:
    """Lists after all neighbours of each vector, and those it is a neighbour of, have met there; vectors of one root do not."""
    closest = Window.partitionBy("center").orderBy(F.desc("fresh"), F.desc("s"), "member")
    listing = lists.select(F.col("v").alias("center"), F.col("u").alias("member"), "s", "fresh").withColumn("place", F.row_number().over(closest))
    listed = lists.select(F.col("u").alias("center"), F.col("v").alias("member"), "fresh")
    both = listed.unionByName(listing.where(f"place <= {REVERSE}").select("center", "member", "fresh"))
    ends = lists.where("rank = 0").select(F.col("u").alias("member"), "least")
    # written, so that the join below reads both sides from a shuffle and a hub can be split
    carried = cut_lineage(nodes.select(F.col("node").alias("member"), "root", "rounded").join(ends, "member"))
    sent = both.join(carried, "member").select("center", "member", "fresh", "least", "root", "rounded")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _whole_groups(batches, "center"):
            yield _met(piece, width, longest)

    met = sent.repartition("center").sortWithinPartitions("center").mapInArrow(each, "u bigint, v bigint, s float")
    old, new = lists.select("u", "v", "s", F.lit(0).alias("fresh")), met.withColumn("fresh", F.lit(1))
    return cut_lineage(_cut(old.unionByName(new), threshold, longest))


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Sorted rows in pieces of at least ``rows`` that end where a key ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(h.num_rows for h in held) >= rows:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            keys = whole.column(key).to_numpy()
            cut = int(np.argmax(keys == keys[-1]))
            if cut:
                yield whole.slice(0, cut)
            held = [whole.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _met(piece: pa.RecordBatch, width: int, longest: int) -> pa.RecordBatch:
    """Compare the members of each center that differ in root with each other; keep what may enter a list."""
    center, member, fresh = (piece.column(c).to_numpy() for c in ("center", "member", "fresh"))
    order = np.lexsort((-fresh, member, center))  # a member that lists the center and is listed there comes once
    order = order[np.append(True, (center[order][1:] != center[order][:-1]) | (member[order][1:] != member[order][:-1]))]
    piece = piece.take(pa.array(order))
    center, member, fresh = center[order], member[order], fresh[order] > 0
    least, root, x = piece.column("least").to_numpy(), piece.column("root").to_numpy(), _unrounded(piece.column("rounded"), width)
    first = np.flatnonzero(np.append(True, center[1:] != center[:-1]))
    sizes = np.diff(np.append(first, len(center)))
    u, v, s = [], [], []
    for size in np.unique(sizes):  # groups of one size make one product
        of = first[sizes == size]
        for at in range(0, len(of), max(1, (1 << 20) // int(size) ** 2)):
            place = of[at:at + max(1, (1 << 20) // int(size) ** 2), None] + np.arange(size)
            near = x[place] @ x[place].transpose(0, 2, 1)
            new = fresh[place][:, :, None] | fresh[place][:, None, :]
            g, i, j = np.nonzero(new & (near > least[place][:, :, None]) & (root[place][:, :, None] != root[place][:, None, :]))
            u.append(member[place[g, i]])
            v.append(member[place[g, j]])
            s.append(near[g, i, j])
    return _entries(*_best(np.concatenate(u), np.concatenate(v), np.concatenate(s), longest))


def _links(lists: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """``(a, b)``: list entries whose cosine in double precision is at least ``threshold``."""
    near = lists.where(F.col("s") >= threshold - SLACK).select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct()
    one, two = nodes.select(F.col("node").alias("a"), F.col("unit").alias("x")), nodes.select(F.col("node").alias("b"), F.col("unit").alias("y"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            alike = x.value_lengths().to_numpy() == y.value_lengths().to_numpy()
            part = batch.filter(pa.array(alike))
            if part.num_rows:
                x, y = part.column("x"), part.column("y")
                sizes = x.value_lengths().to_numpy()
                cosine = np.add.reduceat(x.flatten().to_numpy() * y.flatten().to_numpy(), np.cumsum(sizes) - sizes)
                keep = pa.array(cosine >= threshold)
                yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], ["a", "b"])

    return near.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(each, "a bigint, b bigint")


def _searched(lists: DataFrame | None, nodes: DataFrame, width: int, threshold: float, seed: int) -> DataFrame:
    """Lists of neighbours of another root, begun with new blocks and refined until they are settled."""
    begun = [_begun(nodes, width, seed + t).withColumn("fresh", F.lit(1)) for t in range(TABLES)]
    lists = begun.pop() if lists is None else lists
    for more in begun:
        lists = lists.unionByName(more)
    lists = cut_lineage(_cut(lists, threshold, LIST))
    longest = LIST
    for _ in range(ROUNDS):
        longest = min(2 * longest, LONGEST_LIST)
        lists = _refined(lists, nodes, width, threshold, longest)
        counts = lists.agg(F.avg("fresh")).first()[0]
        if counts is None or counts < SETTLED:
            break
    return lists


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components, as ``(node, root)``, after more links ``(a, b)`` of vectors or roots: only the roots they join are searched."""
    ends = links
    for side in ("a", "b"):
        of = roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
        ends = ends.join(of, side, "left").withColumn(side, F.coalesce(f"{side}_root", side)).select("a", "b")
    moved = components(ends)
    if moved.isEmpty():
        return roots
    moved = cut_lineage(moved)
    old = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return cut_lineage(old.unionByName(moved.join(roots, "node", "left_anti").select("node", "root")))


def _placed(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``nodes`` with the root of each; a vector without a link is its own."""
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _joined_across(lists: DataFrame, nodes: DataFrame, roots: DataFrame, width: int, threshold: float, seed: int) -> DataFrame:
    """Components after vectors whose lists are full have been searched for links with other components.

    A link is in no list only if both ends have nearer ones enough; these may all be in one
    component each. Lists of the next search leave out the own component, so every pass joins
    components or is the last.
    """
    while True:
        full = lists.where((F.col("rank") >= LIST - 1) & (F.col("s") >= threshold - SLACK)).select(F.col("u").alias("node")).distinct()
        asked = cut_lineage(_placed(nodes.select("node", "unit", "rounded").join(full, "node", "left_semi"), roots))
        if len(asked.select("root").distinct().take(2)) < 2:
            return roots
        across = _searched(None, asked, width, threshold, seed)
        links = cut_lineage(_links(across, asked, threshold))
        if links.isEmpty():
            return roots
        roots, seed = _joined(roots, links), seed + TABLES


def _asked(placed: DataFrame, chosen: DataFrame, width: int, threshold: float) -> DataFrame:
    """``(a, x, y, n)``: how many links the vector ``a`` of root ``x``, one of ``chosen``, has with vectors of root ``y``.

    Both hold ``(node, unit, root)``; every task holds all of ``chosen`` and compares its rows with them.
    """
    mine = chosen.select("node", "unit", "root").toArrow().combine_chunks()
    unit = pa.concat_arrays(mine.column("unit").chunks) if len(mine) else pa.array([], pa.list_(pa.float64()))
    held = placed.sparkSession.sparkContext.broadcast(
        (_matrix(unit, width), unit.value_lengths().to_numpy(), mine.column("node").to_numpy(), mine.column("root").to_numpy())
    )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, lengths, names, roots = held.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                part = part.take(pa.array(np.argsort(part.column("root").to_numpy(), kind="stable")))
                x, size = _matrix(part.column("unit"), width), part.column("unit").value_lengths().to_numpy()
                node, root = part.column("node").to_numpy(), part.column("root").to_numpy()
                first = np.flatnonzero(np.append(True, root[1:] != root[:-1]))
                for at in range(0, len(names), 1024):
                    rows = slice(at, at + 1024)
                    linked = (asked[rows] @ x.T >= threshold) & (lengths[rows, None] == size) & (names[rows, None] != node)
                    some = np.flatnonzero(linked.any(1))
                    counts = np.add.reduceat(linked[some], first, axis=1, dtype=np.int64)
                    i, j = np.nonzero(counts)
                    columns = names[rows][some[i]], roots[rows][some[i]], root[first[j]], counts[i, j]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "x", "y", "n"])

    met = placed.select("node", "unit", "root").mapInArrow(each, "a bigint, x bigint, y bigint, n bigint")
    counts = written(met.groupBy("a", "x", "y").agg(F.sum("n").alias("n")), "asked")
    held.destroy()
    return counts


@dataclass
class Audit:
    """What of the links of a sample is inside components.

    ``by_vector`` is the mean share over the linked vectors, ``by_component`` that over components
    of their vectors' mean; both are 1 if no vector of the whole table is linked. ``missed`` holds
    the roots ``(a, b)`` that links of the sample join.
    """

    by_vector: float
    by_component: float
    components: int
    whole: bool
    missed: DataFrame

    @property
    def enough(self) -> bool:
        return min(self.by_vector, self.by_component) >= LEAST_RECALL


def _audited(placed: DataFrame, width: int, threshold: float, audited: int, least: int | None) -> Audit:
    """Compare about ``audited`` vectors of ``(node, unit, root)`` with all, and more until linked ones of ``least`` components are among them.

    Without ``least``, or if there are not as many, all vectors are compared with all.
    """
    total = max(placed.count(), 1)
    most = max(1, ASKED // width)
    place = F.pmod(F.xxhash64("node", F.lit("audit")), F.lit(SAMPLE_STEPS))
    size, upto, found = min(audited, most), 0, None
    while True:
        begin, upto = upto, min(SAMPLE_STEPS, upto + max(1, SAMPLE_STEPS * size // total))
        part = _asked(placed, placed.where((place >= begin) & (place < upto)), width, threshold)
        found = part if found is None else found.unionByName(part)
        size = min(size * GROWTH, most)
        if least is None and upto < SAMPLE_STEPS:
            continue
        of_vector = found.groupBy("a", "x").agg((F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))
        of_component = of_vector.groupBy("x").agg(F.sum("share").alias("share"), F.count(F.lit(1)).alias("n"))
        row = of_component.agg((F.sum("share") / F.sum("n")).alias("by_vector"), F.avg(F.col("share") / F.col("n")).alias("by_component"), F.count(F.lit(1)).alias("components")).first()
        if upto == SAMPLE_STEPS or row["components"] >= least:
            break
    missed = found.where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    shares = (row["by_vector"], row["by_component"]) if row["components"] else (1.0, 1.0)
    return Audit(*shares, row["components"], upto == SAMPLE_STEPS, missed)


def _joined_exactly(nodes: DataFrame, roots: DataFrame, width: int, threshold: float) -> DataFrame:
    """Components after all vectors have been compared with all."""
    placed = cut_lineage(_placed(nodes.select("node", "unit"), roots))
    return _joined(roots, _audited(placed, width, threshold, ASKED, None).missed)


def _counted(rooted: DataFrame, threshold: float, chunk_rows: int = CHUNK) -> DataFrame:
    """``(node, others)``: for vectors of components, the rows of other vectors that link with them.

    ``rooted`` has ``(node, unit, copies, root)``. Components are dealt into chunks, and every pair
    of chunks is a task's work; rows are copied once a chunk of their own component.
    """
    sizes = cut_lineage(rooted.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("chunks")))
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda d: F.struct(F.least(d, chunk).alias("low"), F.greatest(d, chunk).alias("high")))
    dealt = rooted.join(sizes, "root").select("root", F.explode(cells).alias("cell"), chunk.alias("chunk"), "node", "copies", "unit")
    dealt = dealt.select(
        F.concat_ws("|", "root", "cell.low", "cell.high").alias("group"), (F.col("chunk") == F.col("cell.high")).alias("second"),
        (F.col("cell.low") == F.col("cell.high")).alias("own"), "node", "copies", "unit",
    )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _text_groups(batches, "group"):
            group = piece.column("group").to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            found = np.zeros(piece.num_rows, np.int64)
            copies = piece.column("copies").to_numpy()
            second, own = (piece.column(c).to_numpy(zero_copy_only=False) for c in ("second", "own"))
            lengths = piece.column("unit").value_lengths().to_numpy()
            for a, b in zip(first, np.append(first[1:], len(group))):
                x = _matrix(piece.column("unit").slice(a, b - a), int(lengths[a:b].max()))
                one = np.arange(b - a) if own[a] else np.flatnonzero(~second[a:b])
                two = np.arange(b - a) if own[a] else np.flatnonzero(second[a:b])
                for at in range(0, len(one), 512):
                    rows = one[at:at + 512]
                    linked = (x[rows] @ x[two].T >= threshold) & (lengths[a:b][rows][:, None] == lengths[a:b][two])
                    linked &= rows[:, None] != two
                    found[a + rows] += linked @ copies[a:b][two]
                    if not own[a]:
                        found[a + two] += copies[a:b][rows] @ linked
            yield pa.RecordBatch.from_arrays([piece.column("node"), pa.array(found)], ["node", "others"])

    counted = dealt.repartition("group").sortWithinPartitions("group").mapInArrow(each, "node bigint, others bigint")
    return counted.groupBy("node").agg(F.sum("others").alias("others"))


def _text_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """As ``_whole_groups`` for a key of text."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            if held and part.column(key)[0] != held[-1].column(key)[-1]:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            keys = part.column(key).to_numpy(zero_copy_only=False)
            cut = int(np.argmax(keys == keys[-1]))
            if cut:
                yield pa.Table.from_batches([*held, part.slice(0, cut)]).combine_chunks().to_batches()[0]
                held = []
            held.append(part.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def recall(nodes: DataFrame, rooted: DataFrame, width: int, threshold: float, audited: int = AUDITED) -> float:
    """Mean share, over linked vectors of a sample, of their links that are in a component; see ``_audited``."""
    return _audited(_placed(nodes.select("node", "unit"), rooted.select("node", "root")), width, threshold, audited, ENOUGH).by_vector


def near_duplicates(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """One row per row: ``(id, n_links, component)``.

    ``n_links`` counts the other rows whose cosine is at least ``threshold`` in double precision,
    ``component`` is the smallest id reachable by links, the own id included. Vectors that are
    null, empty, zero or have a null or not finite part, and rows with a null id, link with
    nothing, and neither do vectors of different lengths. Equal vectors are one in the search,
    and link with each other; rows that repeat an id count as rows of their own. Other columns
    are not read, so their names do not matter. An empty table gives an empty one.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    rows = cut_lineage(units(embeddings, id_col, vector_col))
    usable = rows.where("id is not null and unit is not null")
    width = usable.agg(F.max(F.size("unit"))).first()[0]
    alone = rows.where("id is null or unit is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component"))
    if width is None:
        return alone
    distinct = usable.groupBy("unit").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))

    def rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.append_column("rounded", pa.array(_rounded(_matrix(batch.column("unit"), width)), pa.binary()))

    numbered = distinct.select(F.monotonically_increasing_id().alias("node"), "unit", "least", "copies")
    # written, so that the numbers of the vectors never change
    nodes = written(numbered.mapInArrow(rounded, "node bigint, unit array<double>, least bigint, copies bigint, rounded binary"), "vectors")
    lists, roots = None, None
    for audit in range(AUDITS):
        seed = TABLES * AUDITS * audit
        searched = nodes.withColumn("root", F.col("node")) if roots is None else cut_lineage(_placed(nodes.select("node", "unit", "rounded"), roots))
        lists = _searched(None, searched, width, threshold, seed)
        links = _links(lists, nodes, threshold)
        roots = cut_lineage(components(links)) if roots is None else _joined(roots, links)
        roots = _joined_across(lists, nodes, roots, width, threshold, seed + TABLES)
        placed = cut_lineage(_placed(nodes.select("node", "unit"), roots))
        seen = _audited(placed, width, threshold, AUDITED, ENOUGH)
        roots = _joined(roots, seen.missed)
        if seen.whole or seen.enough:
            break
    else:
        roots = _joined_exactly(nodes, roots, width, threshold)
    rooted = cut_lineage(nodes.select("node", "unit", "copies").join(roots, "node"))
    others = _counted(rooted, threshold)
    known = nodes.select("node", "unit", "least", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = cut_lineage(known.join(others, "node", "left").select("unit", "root", "least", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    smallest = cut_lineage(known.groupBy("root").agg(F.min("least").alias("component")))
    of_vector = cut_lineage(known.join(smallest, "root").select("unit", "n_links", "component"))
    return usable.join(of_vector, "unit").select("id", F.col("n_links").cast("bigint").alias("n_links"), "component").unionByName(alone)
