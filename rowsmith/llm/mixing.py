"""Mix the texts of several sources to target weights.

The words of each source, its documents one after another, are packed into blocks of a fixed
number of words. A source's target says how many blocks are wanted of it, one after another in a
pseudorandom order of its blocks, and when all are taken once, in another such order. How many of them each
output shard gets is a multinomial draw with the wanted number as its total: the number wanted is halved
between the first and the second half of the shards by a binomial draw, and so on down to single shards.
Each draw is seeded by what it splits, so any task finds the draws of its own shards, and the places
before them, without those of others. The places are mapped through the source's permutation to block numbers, and joined
with the blocks by number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import written
from .order import numbered
from .words import mix, row_slices, text_bytes, words

BLOCK_WORDS = 256
SHARD_BLOCKS = 4096
PIECE_BLOCKS = 1 << 14      # about so many blocks of a source are drawn by one row of the job
MOST_TASKS = 10_000
SETTLED = 1e-12


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """``(row, size)``: the words of each text, runs of anything but blanks; null texts have none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.zeros(0, np.int64)]
            for part in row_slices(batch, "text"):
                sizes.append(np.diff(words(*text_bytes(part.column("text")), hashed=False).first))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.concatenate(sizes).astype(np.int64))], ["row", "size"])

    rest = [F.col(f"`{c}`") for c in df.columns if c != text]
    given = df.select(F.struct(F.lit(0).alias("_"), *rest).alias("row"), F.col(f"`{text}`").alias("text"))
    return given.mapInArrow(count, f"row {given.schema['row'].dataType.simpleString()}, size bigint")


def targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """``sizes`` (source key ``part_of``, size) with ``target`` and ``number``, the rank of the source.

    Sources in the order of ``part_of`` have the weights in turn. Together they get ``share`` of all sizes by
    weight, none more than ``most`` times its size; what is above goes to the others by weight,
    until none is above. If all are at their most, that is all. The sources are a
    distributed table; each round returns two sums.
    """
    if share < 0 or most < 0 or not weights or min(weights) <= 0:
        raise ValueError("shares are not negative and weights are above zero")
    table = sizes.withColumn("all", F.lit(0))
    table = numbered(table, "all", ["part_of"]).drop("all", "group_rows").withColumnRenamed("position", "number")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    table = written(table.withColumn("weight", weight).withColumn("most", F.col("size") * F.lit(float(most))), "sources")
    wanted = share * (table.agg(F.sum("size")).first()[0] or 0)
    level = 0.0     # words for each unit of weight; it only rises
    while True:
        full = F.col("weight") * F.lit(level) > F.col("most") * (1 + SETTLED)
        row = table.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        if row[1] is None:
            level = float("inf")
            break
        raised = (wanted - (row[0] or 0.0)) / row[1]
        if raised <= level * (1 + SETTLED):
            break
        level = raised
    target = F.col("most") if level == float("inf") else F.least(F.col("most"), F.col("weight") * F.lit(level))
    return table.select("part_of", "number", "size", target.alias("target"))


def _permuted(at: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0 .. n-1, or its inverse: a Feistel network over the next
    power of four, gone on with until the number is below n."""
    if n <= 1:
        return at.copy()
    half = np.uint64(((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << int(half)) - 1)
    keys = mix(np.uint64(key & (2 ** 64 - 1)) + np.arange(1, 7, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def once(x: np.ndarray) -> np.ndarray:
        high, low = x >> half, x & mask
        for k in keys[::-1] if back else keys:
            if back:
                high, low = low ^ (mix(high ^ k) & mask), high
            else:
                high, low = low, high ^ (mix(low ^ k) & mask)
        return (high << half) | low

    x = once(at.astype(np.uint64))
    while (outside := x >= np.uint64(n)).any():
        x[outside] = once(x[outside])
    return x.astype(np.int64)


@dataclass
class Plan:
    """What is wanted of one source: its words, blocks of ``length`` words, and the order of the blocks."""

    number: int
    size: int
    wanted: int     # words
    length: int
    seed: int

    @property
    def blocks(self) -> int:
        return -(-self.size // self.length)

    def _key(self, turn: int) -> int:
        return int(mix(np.array([self.seed, self.number, turn], np.uint64) * np.uint64(0xD6E8FEB86659FD93)).sum() & np.uint64(2 ** 63 - 1))

    def _upto(self, turn: int, count: np.ndarray) -> np.ndarray:
        """Words in the first ``count`` blocks of a turn."""
        short = self.blocks * self.length - self.size
        at = int(_permuted(np.array([self.blocks - 1]), self.blocks, self._key(turn), back=True)[0])
        return count * self.length - np.where(count > at, short, 0)

    @property
    def places(self) -> int:
        """Blocks wanted, each turn over all blocks counted in full, the last as far as needed."""
        if not self.size:
            return 0
        turns, rest = divmod(self.wanted, self.size)
        if not rest:
            return turns * self.blocks
        least = rest // self.length
        counts = np.arange(least, min(least + 2, self.blocks) + 1)
        return turns * self.blocks + int(counts[self._upto(turns, counts) >= rest][0])

    def block_at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block number and words to take for each place in the source's order; the last block is cut to fit."""
        block, length = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        for turn in np.unique(places // self.blocks):
            here = places // self.blocks == turn
            at = places[here] % self.blocks
            block[here] = _permuted(at, self.blocks, self._key(int(turn)))
            left = self.wanted - int(turn) * self.size
            length[here] = np.minimum(self._upto(int(turn), at + 1), left) - np.minimum(self._upto(int(turn), at), left)
        return block, length


def _draws(seed: int, number: int, total: int, shards: int, first: int, last: int) -> Iterator[tuple[int, int, int]]:
    """``(shard, places before, places)`` of shards first .. last-1: a multinomial draw of ``total`` over all shards."""
    open_ = [(0, shards, 0, total)]
    while open_:
        low, high, before, n = open_.pop()
        if not n or high <= first or low >= last:
            continue
        if high - low == 1:
            yield low, before, n
            continue
        middle = (low + high) // 2
        rng = np.random.Generator(np.random.PCG64([seed, number, low, high]))
        left = int(rng.binomial(n, (middle - low) / (high - low)))
        open_ += [(middle, high, before + left, n - left), (low, middle, before, left)]


@dataclass
class Mix:
    """``documents``: (id, source, number, start, size, source_size, target); ``spans``: (shard, turn,
    number, block, start, first_word, n_words), what each block of a shard holds. A document is known by ``number``
    and ``start``, its source and its first word in it; ``turn`` orders the blocks of a shard."""

    documents: DataFrame
    spans: DataFrame


def mixed(
    df: DataFrame, text: str, source: str, key: str, weights: list[float], share: float, most: int,
    block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = 42,
) -> Mix:
    """Draw a mix of all documents; the same documents and seed give the same mix, however they lie.

    Sources are ordered by code point, the null source last, and have ``weights`` in turn; targets
    are those of ``targets``. Of each source the whole number of words nearest to its target is taken, and no document
    more than ``most`` times, a whole number. Documents are packed in the order of ``key`` (nulls first), then of
    size and text; repeated rows are packed one after another. Null texts and texts without words have
    size 0: they are in ``documents`` and in no span. An empty table gives an empty mix.
    """
    if most != int(most) or block_words < 1 or shard_blocks < 1:
        raise ValueError("a whole number of turns, and blocks and shards that hold something")
    chosen = df.select(
        F.col(f"`{key}`").alias("id"), F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("~")).alias("part_of"),
        F.xxhash64(F.col(f"`{text}`")).alias("hash"), F.col(f"`{text}`").alias("text"),
    )
    docs = written(word_counts(chosen, "text").select("row.id", "row.part_of", "row.hash", "size"), "sizes")
    sources = written(targets(docs.groupBy("part_of").agg(F.sum("size").alias("size")), weights, share, most), "targets")
    placed = numbered(docs, "part_of", ["id", "size", "hash"], amount="size").drop("group_rows", "position", "hash")
    documents = written(_with_sources(placed, sources), "placed")
    return Mix(documents, _spans(documents, sources, block_words, shard_blocks, seed))


def _with_sources(placed: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with the number and target of their source; rows of a hot source are met by the few lines of a broadcast,
    and where sources are too many for that, by a join in which a source's line is repeated for each of its slices."""
    found = sources.select("part_of", "number", "target", F.col("size").alias("source_size"))
    if found.limit(100_001).count() <= 100_000:
        joined = placed.join(F.broadcast(found), "part_of")
    else:
        slice_ = F.expr("before div 1048576")
        lines = found.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("source_size div 1048576"))))
        joined = placed.withColumn("slice", slice_).join(lines, ["part_of", "slice"])
    name = F.when(F.col("part_of") != "~", F.expr("substr(part_of, 2)"))
    return joined.select("id", name.alias("source"), "number", F.col("before").alias("start"), "size", "source_size", "target")


def _spans(documents: DataFrame, sources: DataFrame, block_words: int, shard_blocks: int, seed: int) -> DataFrame:
    places = _places(sources, block_words, shard_blocks, seed)
    held = documents.where("size > 0").select(
        "number", "start", "size", F.explode(F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}"))).alias("block"),
    )
    first = F.greatest(F.col("block") * block_words, F.col("start"))
    end = F.least((F.col("block") + 1) * block_words, F.col("start") + F.col("size"))
    held = held.select("number", "block", "start", (first - F.col("start")).alias("first_word"), (first - F.col("block") * block_words).alias("at"), (end - first).alias("held"))
    n_words = F.least(F.col("held"), F.col("words") - F.col("at"))
    # the plan cannot know how many places a line of a source stands for: no broadcast of them
    met = held.join(places.hint("merge"), ["number", "block"]).withColumn("n_words", n_words).where("n_words > 0")
    turn = F.xxhash64(F.lit(seed), "shard", "number", "place")
    return met.select("shard", turn.alias("turn"), "number", "block", "start", "first_word", "n_words")


def _places(sources: DataFrame, block_words: int, shard_blocks: int, seed: int) -> DataFrame:
    """(shard, number, place, block, words): every block of the mix."""

    def plan(number: int, size: int, target: float) -> Plan:
        return Plan(number, size, int(np.floor(target + 0.5)), block_words, seed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [plan(*row).places for row in zip(*[batch.column(c).to_pylist() for c in ("number", "size", "target")])]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("number", "size", "target")], pa.array(n, pa.int64())], ["number", "size", "target", "places"])

    counted = written(sources.mapInArrow(count, "number bigint, size bigint, target double, places bigint"), "places")
    shards = max(1, -(-int(counted.agg(F.sum("places")).first()[0] or 0) // shard_blocks))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, size, target, places, piece, pieces in zip(*[c.to_pylist() for c in batch.columns]):
                wanted = plan(number, size, target)
                for shard, before, n in _draws(seed, number, places, shards, piece * shards // pieces, (piece + 1) * shards // pieces):
                    for at in range(before, before + n, PIECE_BLOCKS):
                        here = np.arange(at, min(at + PIECE_BLOCKS, before + n))
                        block, length = wanted.block_at(here)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(here), shard)), pa.array(np.full(len(here), number)), pa.array(here), pa.array(block), pa.array(length)],
                            ["shard", "number", "place", "block", "words"],
                        )

    pieces = F.least(F.lit(shards), F.expr(f"(places + {PIECE_BLOCKS - 1}) div {PIECE_BLOCKS}")).cast("bigint")
    rows = counted.where("places > 0").select("number", "size", "target", "places", pieces.alias("pieces"))
    rows = rows.select("number", "size", "target", "places", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)).alias("piece"), "pieces")
    tasks = max(1, min(MOST_TASKS, int(counted.agg(F.sum(pieces)).first()[0] or 0)))
    return rows.repartition(tasks, "number", "piece").mapInArrow(draw, "shard bigint, number bigint, place bigint, block bigint, words bigint")


def taken(mix: Mix) -> DataFrame:
    """The documents of a mix with ``taken``, the words the mix takes of each, repeats counted."""
    sums = mix.spans.groupBy("number", "start").agg(F.sum("n_words").alias("taken"))
    some = mix.documents.where("size > 0").join(sums, ["number", "start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("bigint")))
    none = mix.documents.where("size = 0").withColumn("taken", F.lit(0).cast("bigint"))
    return some.unionByName(none)
