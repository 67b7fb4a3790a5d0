"""SimHash near-duplicates: fingerprints of word shingles, linked by a binary trie self-join.

Fingerprints that differ in at most ``distance`` of 64 bits agree on at least
``blocks - distance`` of ``blocks`` blocks of bits. Each distinct fingerprint therefore goes to
one bucket for every such choice of blocks, and in a bucket the trie of its fingerprints is
joined with itself: pairs of nodes are descended together, differing bits add up, and a pair
over the budget is left. Buckets give out a spanning forest of the links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .graph import components
from .words import row_slices, shingle_starts, single_spaced, text_bytes, words

BITS = 64
FRONTIER = 1 << 19     # node pairs descended at once
BUCKET_ROWS = 200_000  # fingerprints of one bucket searched in one task; larger buckets are split
SUMMED = 1 << 16       # shingles unpacked into bits at once


def fingerprints_of(column: pa.Array, shingle: int, seed: int = 42) -> np.ndarray:
    """64-bit SimHash of each text of an Arrow string column; 0 for a text without words."""
    data, offsets = text_bytes(column)
    found = words(data, offsets, hashed=False)
    text, starts, ends = single_spaced(data, found, lower=True)
    counts = np.diff(found.first)
    at, rows = shingle_starts(found.first, shingle)
    to = at + shingle - 1
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    at, to, rows = np.concatenate([at, found.first[short]]), np.concatenate([to, found.first[short + 1] - 1]), np.concatenate([rows, short])
    ones = np.zeros((len(counts), BITS), np.int64)
    digest = xxhash.xxh64_digest
    for i in range(0, len(at), SUMMED):
        spans = zip(starts[at[i:i + SUMMED]].tolist(), ends[to[i:i + SUMMED]].tolist())
        hashes = np.frombuffer(b"".join([digest(text[s:e], seed) for s, e in spans]), np.uint8).reshape(-1, 8)
        row = rows[i:i + SUMMED]
        cut = np.flatnonzero(np.diff(row, prepend=-1))
        ones[row[cut]] += np.add.reduceat(np.unpackbits(hashes, axis=1), cut, axis=0, dtype=np.int64)
    total = np.bincount(rows, minlength=len(counts))
    return np.packbits(2 * ones > total[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """``(id, fingerprint bigint)`` per row: bit set where it is set in over half of the shingle hashes.

    A-Z are lower-cased; a text with fewer words than a shingle is one shingle; a null or empty
    text has fingerprint 0.
    """

    return _with_prints(_known(docs, id_col, text_col), shingle, seed).select("id", "fingerprint")


def _known(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(sig, id, text)``: rows by id, with a hash of the text."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.select(F.xxhash64("text").alias("sig"), "id", "text")


def _bucket_keys(blocks: int, distance: int) -> list:
    """One bucket key for each choice of blocks that must agree."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        key = F.lit(number).cast("bigint")
        for c in chosen:
            width = edges[c + 1] - edges[c]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned("fingerprint", edges[c]).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(key)
    return keys


def links(prints: DataFrame, distance: int = 4, blocks: int | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links ``(a, b)`` that connect exactly the fingerprints within ``distance`` bits of each other.

    ``prints`` holds distinct values in ``fingerprint``. The result has the same components as
    all such pairs, with at most one link per fingerprint and bucket. ``blocks`` (default
    ``distance + 2``) sets how small the buckets are against how often a fingerprint is copied.
    """
    blocks = blocks or min(distance + 2, BITS)
    if not 0 <= distance < blocks <= BITS:
        raise ValueError("distance must be below blocks, and blocks at most 64")
    keyed = cut_lineage(prints.select(F.explode(F.array(*_bucket_keys(blocks, distance))).alias("key"), "fingerprint"))
    heavy = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows)
    # A bucket over the limit is dealt into chunks by a hash; each pair of chunks is searched in a
    # task of its own, so a task holds two chunks at most and every pair of rows meets somewhere.
    chunks = F.ceil(F.col("n") / bucket_rows).cast("int")
    chunk = F.pmod(F.xxhash64("fingerprint"), chunks).cast("int")
    cells = F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), chunks - 1), lambda d: F.least(d, chunk) * chunks + F.greatest(d, chunk))
    )
    dealt = keyed.join(heavy, "key", "left").select("key", F.explode(cells).alias("cell"), "fingerprint")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, cell, prints in _whole_buckets(batches):
            a, b = linked((key, cell), prints, distance)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return dealt.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(each, "a bigint, b bigint")


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sorted rows in pieces that end where a bucket ends."""
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
    for batch in batches:
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "cell", "fingerprint")]
        held = [np.concatenate([h, n.view(h.dtype) if n.dtype.itemsize == 8 else n.astype(h.dtype)]) for h, n in zip(held, new)]
        if len(held[0]):
            cut = int(np.argmax((held[0] == held[0][-1]) & (held[1] == held[1][-1])))
            if cut:
                yield tuple(h[:cut] for h in held)
                held = [h[cut:] for h in held]
    if len(held[0]):
        yield tuple(held)


def linked(bucket: tuple[np.ndarray, np.ndarray], prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within each bucket: the two fingerprints of each link."""
    order = np.lexsort((prints, *bucket[::-1]))
    prints = prints[order]
    new = np.ones(len(prints), bool)
    if len(prints):
        new[1:] = (bucket[0][order][1:] != bucket[0][order][:-1]) | (bucket[1][order][1:] != bucket[1][order][:-1])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(prints))
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    root = np.arange(len(prints))
    # Small budgets first: what they join is then passed over by the larger ones.
    for budget in range(distance + 1):
        root = _trie_join(prints, lo, hi, budget, root)
    moved = np.flatnonzero(root != np.arange(len(root)))
    return prints[moved], prints[root[moved]]


def _trie_join(prints: np.ndarray, lo: np.ndarray, hi: np.ndarray, budget: int, root: np.ndarray) -> np.ndarray:
    """Descend pairs of trie nodes, which are ranges of the sorted fingerprints, bit by bit."""
    bits = [np.concatenate([[0], np.cumsum((prints >> np.uint64(b)) & np.uint64(1), dtype=np.int64)]) for b in range(BITS)] if len(lo) else []
    waiting = [(BITS - 1, lo, hi, lo, hi, np.full(len(lo), budget))]
    while waiting:
        bit, a, b, c, d, left = waiting.pop()
        while len(a):
            if len(a) > FRONTIER:
                half = len(a) // 2
                waiting.append((bit, a[half:], b[half:], c[half:], d[half:], left[half:]))
                a, b, c, d, left = a[:half], b[:half], c[:half], d[:half], left[:half]
            if bit < 0:
                root = _joined(root, a, c)
                break
            ones = bits[bit]
            m, k = b - (ones[b] - ones[a]), d - (ones[d] - ones[c])
            same = a == c
            apart = (left > 0)
            # zeros with zeros, ones with ones, and the two crossings at the cost of a bit
            pairs = [(a, m, c, k, left, ~same | (m - a > 1)), (m, b, k, d, left, ~same | (b - m > 1)),
                     (a, m, k, d, left - 1, apart), (m, b, c, k, left - 1, apart & ~same)]
            stacked = [np.concatenate([p[i][p[5] & (p[1] > p[0]) & (p[3] > p[2])] for p in pairs]) for i in range(5)]
            bit -= 1
            if len(stacked[0]):
                # pairs of nodes whose fingerprints all hang together already
                changes = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
                done = (changes[stacked[0]] == changes[stacked[1] - 1]) & (changes[stacked[2]] == changes[stacked[3] - 1]) & (root[stacked[0]] == root[stacked[2]])
                stacked = [x[~done] for x in stacked]
            a, b, c, d, left = stacked
    return root


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the sets that hold a[i] and b[i]; each root is the smallest place of its set."""
    root = root.copy()
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, seed: int = 42
) -> DataFrame:
    """One row per row of ``docs``: ``(id, fingerprint bigint, component bigint)``.

    ``component`` is the smallest id among the rows whose fingerprints are reachable by steps of
    at most ``distance`` bits. Rows with a null id take part and are numbered by the others;
    where all ids of a component are null it is null. Texts that are null or empty have
    fingerprint 0 and are linked like any other; repeated rows stay. Other columns of ``docs``
    are not read, so their names do not matter.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col, shingle, seed))
    distinct = cut_lineage(prints.groupBy("fingerprint").agg(F.min("id").alias("least")))
    labels = components(links(distinct, distance))
    rooted = distinct.join(labels.select(F.col("node").alias("fingerprint"), "root"), "fingerprint", "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root"), "least"
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    of_print = rooted.join(smallest, "root").select("fingerprint", "component")
    return prints.join(of_print, "fingerprint").select("id", "fingerprint", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, seed: int = 42) -> DataFrame:
    """``docs``, all columns, with one row of each component of near-duplicates.

    The row with the smallest id stays, and of rows that share it one with the smallest hash of
    its text; a row with a null id stays only where no row of the component has an id.
    """
    prints = cut_lineage(_with_prints(_known(docs, id_col, text_col), shingle, seed))
    distinct = cut_lineage(prints.select("fingerprint").distinct())
    labels = components(links(distinct, distance)).select(F.col("node").alias("fingerprint"), "root")
    rooted = prints.join(labels, "fingerprint", "left").select(F.coalesce("root", "fingerprint").alias("root"), "id", "sig")
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "sig")).alias("first"))
    stays = first.select(F.col("first.id").alias("__id"), F.col("first.sig").alias("__sig"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("bigint").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("sig"))
    kept = rows.join(stays, rows["id"].eqNullSafe(stays["__id"]) & (rows["sig"] == stays["__sig"])).dropDuplicates(["id", "sig"])
    return kept.select("row.*")


def _with_prints(rows: DataFrame, shingle: int, seed: int) -> DataFrame:
    """``(sig, id, fingerprint)`` of rows ``(sig, id, text)``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                prints = fingerprints_of(part.column("text"), shingle, seed)
                yield pa.RecordBatch.from_arrays([part.column("sig"), part.column("id"), pa.array(prints.view(np.int64))], ["sig", "id", "fingerprint"])

    return rows.mapInArrow(each, "sig bigint, id bigint, fingerprint bigint")
