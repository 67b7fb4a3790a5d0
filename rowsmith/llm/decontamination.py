"""Benchmark decontamination: size-partitioned MinHash containment search, then an exact check.

An item with n distinct shingles is in a document if at least ceil(similarity * n) of them are.
Such a document holds at least one of any n - ceil(similarity * n) + 1 of the item's shingles,
so the item's bottom MinHash values of that number are a sketch that no document in question
misses. How many values an item needs depends on its size alone: items are partitioned by size,
and every partition has one sketch width, that of its largest item. Documents of any length are
searched whole for the values of the sketches. Only documents that hold some are read again, for
the shingles of the items they may hold, and what they share is counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .words import LOWER, row_slices, run_hashes, shingle_starts, single_spaced, text_bytes, words

SHINGLE = 5
SIMILARITY = 0.8
BROADCAST_HASHES = 500_000  # hashes that tasks hold as they are (4 MB); beyond it they hold a bitmap of them
BITMAP_BITS = 29            # a bitmap has at most 2 to this many bits (64 MB), and 16 or more for each hash below that
BROADCAST_IDS = 1_000_000   # ids of documents that are looked up by broadcast (8 MB); beyond it by a shuffle join
SIZE_STEP = 2               # upper sizes of the partitions grow by this factor


def _hashed(column: pa.Array, shingle: int):
    """Lower-cased bytes, words, shingle starts, their rows and hashes of a slice of texts."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    found = words(data, offsets)
    at, rows = shingle_starts(found.first, shingle)
    hashes = run_hashes(found.hashes, at, shingle)
    return data, found, at, rows, hashes


def shingles(items: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """``(id, hash bigint, shingle string)``: the distinct shingles of each row, A-Z lower-cased."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                data, found, at, rows, hashes = _hashed(part.column("text"), shingle)
                text, starts, ends = single_spaced(data, found)
                strings = [text[s:e].decode() for s, e in zip(starts[at].tolist(), ends[at + shingle - 1].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(rows)), pa.array(hashes.view(np.int64)), pa.array(strings, pa.string())], ["id", "hash", "shingle"]
                )

    rows = items.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(each, "id bigint, hash bigint, shingle string").distinct()


def size_class(size: Column) -> Column:
    """Largest size of the partition an item of this size belongs to."""
    return F.pow(F.lit(float(SIZE_STEP)), F.ceil(F.log(float(SIZE_STEP), size) - 1e-9)).cast("bigint")


def sketches(of_items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(item, hash, need)``: the bottom MinHash values of each item, and the shared shingles needed.

    ``of_items`` holds ``(item, hash, shingle)``. The sketch of a partition by size is as wide as
    its largest possible item requires, so it serves all its items.
    """
    sizes = of_items.groupBy("item").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_set("hash")).alias("hashes"))
    largest = size_class(F.col("size"))
    width = (largest - F.ceil(F.lit(similarity) * largest - 1e-9) + 1).cast("int")
    need = F.ceil(F.lit(similarity) * F.col("size") - 1e-9).cast("bigint")
    return sizes.select("item", F.explode(F.slice("hashes", F.lit(1), F.greatest(width, F.lit(1)))).alias("hash"), need.alias("need"))


def _lookup(hashes: DataFrame, most: int) -> tuple[np.ndarray, int]:
    """The distinct ``hash`` values sorted (bits 0), or a bitmap of their first bits if over ``most``."""
    hashes = hashes.select("hash").distinct()
    number = hashes.count()
    if number <= most:
        return np.sort(hashes.toArrow().column("hash").to_numpy()), 0
    bits = min(BITMAP_BITS, max(6, (16 * number - 1).bit_length()))
    place = F.shiftrightunsigned("hash", 64 - bits)
    words_set = hashes.select(F.shiftright(place, 6).alias("word"), place.alias("place")).groupBy("word").agg(
        F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("set")
    ).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[words_set.column("word").to_numpy()] = words_set.column("set").to_numpy().view(np.uint64)
    return bitmap, bits


def _held(known: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes are known; with a bitmap some others are taken for known as well."""
    if bits:
        place = hashes.view(np.uint64) >> np.uint64(64 - bits)
        return (known[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0
    if not len(known):
        return np.zeros(len(hashes), bool)
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def _met(docs: DataFrame, hashes: DataFrame, shingle: int, most: int, texts: bool) -> DataFrame:
    """``(doc, hash)``, with ``texts`` also ``shingle``: the distinct shingles of ``docs`` whose hash is
    among ``hashes``, or shares its first bits with one if these are over ``most``."""
    held = docs.sparkSession.sparkContext.broadcast(_lookup(hashes, most))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = held.value
        for batch in batches:
            for part in row_slices(batch, "text"):
                data, found, at, rows, of_shingles = _hashed(part.column("text"), shingle)
                mine = of_shingles.view(np.int64)
                hit = np.flatnonzero(_held(known, bits, mine))
                if not texts:
                    _, once = np.unique(np.stack([rows[hit], mine[hit]]), axis=1, return_index=True)
                    hit = hit[once]
                columns = [part.column("id").take(pa.array(rows[hit])), pa.array(mine[hit])]
                if texts:
                    columns.append(pa.array([
                        " ".join(data[found.starts[w]:found.ends[w]].tobytes().decode() for w in range(i, i + shingle)) for i in at[hit].tolist()
                    ], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc", "hash", "shingle"][: len(columns)])

    return docs.mapInArrow(each, "doc bigint, hash bigint" + (", shingle string" if texts else "")).distinct()


def _among(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of ``rows`` on ``id`` with the distinct, written ``ids``; broadcast only if they are few."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", how)


def contaminated(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text",
    shingle: int = SHINGLE, similarity: float = SIMILARITY, broadcast_hashes: int = BROADCAST_HASHES,
) -> DataFrame:
    """``(doc, item, shared, size, containment)``: items of which a document holds at least ``similarity``.

    Containment is the share of an item's distinct shingles (``shingle`` words, A-Z lower-cased)
    that the document has anywhere. Items with fewer words than a shingle have none and match
    nothing, as do null and empty texts. Rows of ``docs`` that repeat an id count as one document
    with the shingles of all; rows with a null id in either table are left out. Only the named
    columns are read, so names of other columns do not matter.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be in (0, 1]")
    docs = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.col(f"`{doc_text}`").cast("string").alias("text")).where("id is not null and text is not null")
    items = items.select(F.col(f"`{item_id}`").cast("bigint").alias("id"), F.col(f"`{item_text}`").cast("string").alias("text")).where("id is not null and text is not null")
    of_items = cut_lineage(shingles(items, "id", "text", shingle).withColumnRenamed("id", "item"))
    sketch = cut_lineage(sketches(of_items, similarity))
    candidates = cut_lineage(_met(docs, sketch, shingle, broadcast_hashes, False).join(sketch, "hash").select("doc", "item", "need").distinct())
    asked = of_items.join(candidates.select("item").distinct(), "item", "left_semi")
    some = _among(docs, cut_lineage(candidates.select(F.col("doc").alias("id")).distinct()), "left_semi")
    met = _met(some, asked, shingle, broadcast_hashes, True)
    asked = candidates.join(asked, "item")
    shared = asked.join(met, ["doc", "hash", "shingle"]).groupBy("doc", "item").agg(F.count(F.lit(1)).alias("shared"), F.first("need").alias("need"))
    sizes = of_items.groupBy("item").agg(F.count(F.lit(1)).alias("size"))
    return shared.where(F.col("shared") >= F.col("need")).join(sizes, "item").select(
        "doc", "item", "shared", "size", (F.col("shared") / F.col("size")).alias("containment")
    )


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, without those that hold an item.

    Rows with a null id are told apart by their texts; rows with a null or empty text stay. Columns
    may have any names. The ids of rows to leave out are looked up by broadcast if counted few.
    """
    text = F.col(f"`{doc_text}`").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{doc_id}`").cast("bigint").alias("id"), text.alias("text"))
    found = contaminated(docs, items, doc_id=doc_id, doc_text=doc_text, **options).select(F.col("doc").alias("id")).distinct()
    kept = _among(rows, cut_lineage(found), "left_anti")
    lost = rows.where("id is null and text is not null").select(F.xxhash64("text").alias("id"), "text")
    if not lost.isEmpty():
        held = contaminated(lost, items, doc_id="id", doc_text="text", **options).select(F.col("doc").alias("id")).distinct()
        kept = _among(kept.withColumn("id", F.when(F.col("id").isNull(), F.xxhash64("text"))), cut_lineage(held), "left_anti")
    return kept.select("row.*")
