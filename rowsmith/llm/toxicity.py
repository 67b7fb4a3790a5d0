"""Toxicity: a factorization machine over hashed terms.

The terms of a text are its words and their beginnings, hashed. A bounded sample of labelled rows
shows which terms differ between the classes, alone or as one of a pair; the machine learns a weight
and a short vector for each, and two terms that occur together add the product of their vectors to
the score. So a pair can matter where neither term does alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .learning import about
from .words import row_slices, run_hashes, text_bytes, words

SAMPLE_ROWS = 20_000   # labelled rows the machine is fitted on
HASH_BITS = 22         # terms are hashed to this many bits
BEGINNINGS = (4, 5)    # bytes of a word's beginnings that are terms as well
LEAST_ROWS = 3         # rows of the sample a term must be in
ALONE = 8.0            # evidence (minus the log of a chance) a term needs to be one of the machine by itself
CHANCE = 0.01          # expected number of pairs that chance alone lets in
PAIR_ROWS = 256        # rows, and
PAIR_TERMS = 512       # terms of a block in which pairs are counted
PAIRS_AT_ONCE = 8_192  # pairs whose rows are compared at once
FACTORS = 8
STEPS = 400
RATE = 0.05
RIDGE = 1e-4   # of the mean loss of the sample

LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed term of every distinct term of each text."""
    data, offsets = text_bytes(pc.utf8_lower(pc.fill_null(column, "")))
    data = np.where(LETTER[data], data, 32).astype(np.uint8)
    found = words(data, offsets)
    rows = np.repeat(np.arange(len(column)), np.diff(found.first))
    length = found.ends - found.starts
    of, hashed = [rows], [found.hashes]
    for n in BEGINNINGS:
        long = np.flatnonzero(length > n)
        code = np.full(len(long), n, np.uint64)
        for i in range(n):
            code = code * np.uint64(257) + data[found.starts[long] + i]
        of.append(rows[long])
        hashed.append(run_hashes(code, np.arange(len(code)), 1, n))
    pairs = (np.concatenate(of).astype(np.int64) << HASH_BITS) | (np.concatenate(hashed) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
    pairs = np.unique(pairs)
    return pairs >> HASH_BITS, pairs & ((1 << HASH_BITS) - 1)


@dataclass
class FactorizationMachine:
    """Terms of the machine by hashed term (-1: not a term), their weights and vectors."""

    intercept: float
    known: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, column: pa.Array, place: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each text; ``place`` is ``places()``."""
        rows, hashed = terms(column)
        at = place[hashed]
        rows, at = rows[at >= 0], at[at >= 0]
        return _probability(_margin(self.intercept, self.weights, self.vectors, rows, at, len(column))[0])

    def places(self) -> np.ndarray:
        place = np.full(1 << HASH_BITS, -1, np.int32)
        place[self.known] = np.arange(len(self.known))
        return place


def _margin(intercept: float, weights: np.ndarray, vectors: np.ndarray, rows: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Intercept, weights and products of all pairs of terms; and the sum of vectors of each row."""
    total = np.stack([np.bincount(rows, v, n) for v in vectors[at].T], axis=1) if len(at) else np.zeros((n, vectors.shape[1]))
    squares = np.bincount(rows, (vectors**2).sum(1)[at], n)
    return intercept + np.bincount(rows, weights[at], n) + ((total**2).sum(1) - squares) / 2, total


def _probability(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _evidence(n: np.ndarray, ones: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Chernoff's bound: ``ones`` or more (fewer) of ``n`` rows at a given ``share`` have a chance of at most exp(-evidence)."""
    n = np.maximum(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ones > 0, ones * np.log(ones / (n * share)), 0)
        loss = np.where(ones < n, (n - ones) * np.log((n - ones) / (n * (1 - share))), 0)
    return gain + loss


def _telling_alone(n: np.ndarray, ones: np.ndarray, base: float) -> np.ndarray:
    """Places of the terms whose share of label 1 is not that of all rows."""
    return np.flatnonzero((n >= LEAST_ROWS) & (_evidence(n, ones, np.float64(base)) >= ALONE))


def _telling_together(rows: np.ndarray, at: np.ndarray, y: np.ndarray, n: np.ndarray, ones: np.ndarray, base: float) -> np.ndarray:
    """Places of the terms of pairs whose share of label 1 exceeds that of either term and of all rows.

    The evidence of a pair has to stand out among all pairs. A pair is in no more rows of label 1 than either of its
    terms, so terms in too few of these for any pair are left out without loss.
    """
    kept = np.arange(len(n))
    for _ in range(3):      # fewer terms have fewer pairs, and need less evidence
        least = np.log(max(len(kept), 2) ** 2 / 2 / CHANCE)
        kept = kept[ones[kept] >= least / -np.log(base)]
    if len(kept) < 2:
        return kept[:0]
    new = np.full(len(n), -1, np.int32)
    new[kept] = np.arange(len(kept), dtype=np.int32)
    inside = new[at] >= 0
    row, term = rows[inside], new[at[inside]]
    bits = np.zeros((len(kept), -(-len(y) // 64) * 8), np.uint8)     # rows of each term
    for part in range(0, len(row), 1 << 20):
        r = row[part:part + (1 << 20)]
        np.bitwise_or.at(bits, (term[part:part + (1 << 20)], r >> 3), (1 << (r & 7)).astype(np.uint8))
    bits = bits.view(np.uint64)
    positive = np.flatnonzero(y > 0)
    number = np.full(len(y), -1, np.int32)
    number[positive] = np.arange(len(positive), dtype=np.int32)
    toxic = number[row] >= 0
    row, term = number[row[toxic]], term[toxic]
    bounds = np.searchsorted(row, np.arange(0, len(positive) + PAIR_ROWS, PAIR_ROWS))
    share = np.maximum(ones[kept] / n[kept], base)
    found = np.zeros(len(kept), bool)
    for begin in range(0, len(kept), PAIR_TERMS):
        width = min(PAIR_TERMS, len(kept) - begin)
        both = np.zeros((width, len(kept) - begin), np.float32)
        for lot, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
            here = term[lo:hi] >= begin
            dense = np.zeros((PAIR_ROWS, len(kept) - begin), np.float32)
            dense[row[lo:hi][here] - lot * PAIR_ROWS, term[lo:hi][here] - begin] = 1
            both += dense[:, :width].T @ dense
        one, other = np.nonzero(both >= least / -np.log(base))
        one, other = one[other > one], other[other > one]
        for part in range(0, len(one), PAIRS_AT_ONCE):
            a, b = one[part:part + PAIRS_AT_ONCE], other[part:part + PAIRS_AT_ONCE]
            k, over = both[a, b].astype(float), np.maximum(share[a + begin], share[b + begin])
            possible = np.flatnonzero((over < 1) & (-k * np.log(over) >= least))   # if the pair were in no other rows
            a, b, k, over = a[possible] + begin, b[possible] + begin, k[possible], over[possible]
            m = np.bitwise_count(bits[a] & bits[b]).sum(1)
            tells = (k > m * over) & (_evidence(m, k, over) >= least)
            found[a[tells]] = found[b[tells]] = True
    return kept[found]


def fit(rows: np.ndarray, hashed: np.ndarray, y: np.ndarray) -> FactorizationMachine:
    """Minimise the logistic loss of ``y`` over the telling terms of the rows by Adam on all rows at once."""
    if not len(y):
        return FactorizationMachine(-30.0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)))
    base = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    size = 1 << HASH_BITS
    n, ones = np.bincount(hashed, minlength=size), np.bincount(hashed, y[rows], size)
    known = np.union1d(_telling_alone(n, ones, base), _telling_together(rows, hashed, y, n, ones, base))
    place = np.full(size, -1, np.int32)
    place[known] = np.arange(len(known))
    at = place[hashed]
    rows, at = rows[at >= 0].astype(np.int32), at[at >= 0]
    order = np.argsort(rows, kind="stable")
    rows, at = rows[order], at[order]
    by_term = np.argsort(at, kind="stable")
    rows_by_term = rows[by_term]
    first_of_row = np.flatnonzero(np.append(len(rows) > 0, rows[1:] != rows[:-1]))
    first_of_term = np.searchsorted(at[by_term], np.arange(len(known)))
    held = rows[first_of_row]       # rows with any term
    # weight and vector side by side
    intercept = np.log(base / (1 - base))
    state = np.zeros((len(known), 1 + FACTORS), np.float32)
    state[:, 1:] = np.random.default_rng(0).normal(0, 0.05, (len(known), FACTORS))
    moments = [np.zeros_like(state), np.zeros_like(state), 0.0, 0.0]
    for step in range(1, STEPS + 1):
        total, margin = np.zeros((len(y), 1 + FACTORS), np.float32), np.full(len(y), intercept)
        if len(rows):
            total[held] = np.add.reduceat(state[at], first_of_row)
            squares = np.add.reduceat((state[:, 1:] ** 2).sum(1)[at], first_of_row)
            margin[held] += total[held, 0] + ((total[held, 1:] ** 2).sum(1) - squares) / 2
        slope = (_probability(margin) - y) / len(y)
        total[:, 0] = 1
        slopes = RIDGE * state
        if len(rows):
            sums = np.add.reduceat((total * slope[:, None].astype(np.float32))[rows_by_term], first_of_term)
            slopes += sums
            slopes[:, 1:] -= sums[:, :1] * state[:, 1:]
        grow, settle = 1 / (1 - 0.9**step), 1 / (1 - 0.999**step)
        moments[0] = 0.9 * moments[0] + 0.1 * slopes
        moments[1] = 0.999 * moments[1] + 0.001 * slopes**2
        moments[2] = 0.9 * moments[2] + 0.1 * slope.sum()
        moments[3] = 0.999 * moments[3] + 0.001 * slope.sum() ** 2
        state = state - RATE * (moments[0] * grow) / (np.sqrt(moments[1] * settle) + 1e-8)
        intercept -= RATE * (moments[2] * grow) / (np.sqrt(moments[3] * settle) + 1e-8)
    return FactorizationMachine(float(intercept), known, state[:, 0].astype(float), state[:, 1:].astype(float))


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    only: Column | None = None, sample_rows: int = SAMPLE_ROWS,
) -> FactorizationMachine:
    """Fit on about ``sample_rows`` labelled rows (all, if there are no more) where ``only`` holds.

    Rows without an id or a label are not learned from; a null text counts as empty. Without any
    labelled rows every score is next to 0.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known if only is None else known.where(only)
    chosen = about(known.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")), F.col("id"), sample_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                rows, hashed = terms(part.column("text"))
                ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=part.num_rows))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashed.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("place"), part.column("y"), lists], ["place", "y", "terms"])

    rows = rows.select(F.xxhash64("id", "text").alias("place"), "y", "text")
    learned = rows.mapInArrow(each, "place bigint, y double, terms array<int>").toArrow().sort_by("place")
    lists = learned.column("terms").combine_chunks()
    row = np.repeat(np.arange(len(learned), dtype=np.int32), lists.value_lengths().to_numpy(zero_copy_only=False)) if len(learned) else np.zeros(0, np.int32)
    return fit(row, lists.flatten().to_numpy(zero_copy_only=False), (learned.column("y").to_numpy() > 0.5).astype(float))


def score(docs: DataFrame, model: FactorizationMachine, text_col: str = "text") -> DataFrame:
    """``(row, score)``: ``row`` is a struct of all columns of ``docs``, so no name can clash.

    Null texts are scored as empty ones; repeated rows stay; an empty table gives an empty one.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).cast("string").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = model.places()
        for batch in batches:
            for part in row_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(model.score(part.column("text"), place))], ["row", "score"])

    return rows.mapInArrow(each, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))
