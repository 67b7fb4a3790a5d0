"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in turn on one feature after the other; trees on one binned feature add
up to a lookup table over its bins. Pairs of features that explain most of what is left get
tables over two features in the same way. A score is a sum of looked-up numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .learning import about
from .words import LOWER, row_slices, run_hashes, text_bytes, words

SAMPLE_ROWS = 20_000   # labelled rows the model is fitted on
BINS = 64              # bins of a feature
PAIR_BINS = 16         # bins of a feature in a pair
PAIRS = 10             # pairs of features with a table
ROUNDS = 120           # rounds over all features
PAIR_ROUNDS = 60       # rounds over all pairs
RATE = 0.1             # share of each tree that is added
RIDGE = 1.0            # added to the second derivatives

FEATURES = [
    "words", "word_bytes", "word_bytes_spread", "longest_word", "letters", "capitals", "digits", "stops", "symbols", "blanks", "lines",
    "odd_ends", "plain_words", "capital_words", "distinct_words", "same_as_before", "commonest_word", "distinct_pairs", "distinct_fours",
    "repeated_lines", "byte_entropy",
]
LETTERS, CAPITALS, DIGITS, STOPS, SYMBOLS, LINE_ENDS, BLANKS = range(7)
KIND = np.full(256, SYMBOLS, np.uint8)
COUNTED = 1 << 20  # bytes counted at once
KIND[97:123] = KIND[128:] = LETTERS
KIND[65:91] = CAPITALS
KIND[48:58] = DIGITS
KIND[list(b".,;:!?'\"-()")] = STOPS
KIND[[9, 11, 12, 32]] = BLANKS
KIND[[10, 13]] = LINE_ENDS


def features(column: pa.Array) -> np.ndarray:
    """FEATURES of each text of an Arrow string column; an empty text has zeros."""
    data, offsets = text_bytes(column)
    rows = len(column)
    out = np.zeros((rows, len(FEATURES)))
    col = {name: out[:, i] for i, name in enumerate(FEATURES)}
    if not len(data):
        return out
    found = words(LOWER[data], offsets)
    size, count = np.maximum(np.diff(offsets), 1), np.diff(found.first)
    per_word = np.maximum(count, 1)
    of_word, kind = np.repeat(np.arange(rows), count), KIND[data]
    per_byte = np.zeros(rows * 256, np.int64)
    for at in range(0, len(data), COUNTED):
        of_byte = np.searchsorted(offsets, np.arange(at, min(at + COUNTED, len(data))), "right") - 1
        per_byte += np.bincount(of_byte * 256 + data[at:at + COUNTED], minlength=len(per_byte))
    per_byte = per_byte.reshape(rows, 256)
    kinds = np.stack([per_byte[:, KIND == k].sum(1) for k in range(7)], axis=1)
    col["words"][:] = np.log1p(count)
    length = (found.ends - found.starts).astype(float)
    col["word_bytes"][:] = np.bincount(of_word, length, rows) / per_word
    col["word_bytes_spread"][:] = np.sqrt(np.maximum(np.bincount(of_word, length**2, rows) / per_word - col["word_bytes"] ** 2, 0))
    np.maximum.at(col["longest_word"], of_word, np.log1p(length))
    alphabetic = np.maximum(kinds[:, LETTERS] + kinds[:, CAPITALS], 1)
    col["letters"][:] = (kinds[:, LETTERS] + kinds[:, CAPITALS]) / size
    col["capitals"][:] = kinds[:, CAPITALS] / alphabetic
    for name, k in (("digits", DIGITS), ("stops", STOPS), ("symbols", SYMBOLS), ("blanks", BLANKS), ("lines", LINE_ENDS)):
        col[name][:] = kinds[:, k] / size
    if len(found.starts):
        ends = kind[found.ends - 1]
        odd = (ends == SYMBOLS) | ((ends == STOPS) & (data[found.ends - 1] == 33))
        col["odd_ends"][:] = np.bincount(of_word, odd, rows) / per_word
        letters = np.concatenate([[0], np.cumsum((kind == LETTERS) | (kind == CAPITALS), dtype=np.int32)])
        small = np.concatenate([[0], np.cumsum(kind == LETTERS, dtype=np.int32)])
        lettered = letters[found.ends] - letters[found.starts]
        col["plain_words"][:] = np.bincount(of_word, lettered == length, rows) / per_word
        col["capital_words"][:] = np.bincount(of_word, (lettered > 1) & (small[found.ends] == small[found.starts]), rows) / per_word
    hashes = found.hashes
    pairs = run_hashes(hashes, np.arange(max(len(hashes) - 1, 0)), 2)
    fours = run_hashes(hashes, np.arange(max(len(hashes) - 3, 0)), 4)
    breaks = np.flatnonzero(data == 10)
    for r in np.flatnonzero(count):
        a, b = int(found.first[r]), int(found.first[r + 1])
        n = b - a
        _, times = np.unique(hashes[a:b], return_counts=True)
        out[r, 14] = len(times) / n
        out[r, 15] = np.count_nonzero(hashes[a + 1:b] == hashes[a:b - 1]) / n
        out[r, 16] = times.max() / n
        out[r, 17] = len(np.unique(pairs[a:b - 1])) / (n - 1) if n > 1 else 1
        out[r, 18] = len(np.unique(fours[a:b - 3])) / (n - 3) if n > 3 else 1
        inner = breaks[np.searchsorted(breaks, offsets[r]):np.searchsorted(breaks, offsets[r + 1])]
        if len(inner):
            lines = [x for x in data[offsets[r]:offsets[r + 1]].tobytes().split(b"\n") if x.strip()]
            out[r, 19] = 1 - len(set(lines)) / max(len(lines), 1)
    shares = per_byte / size[:, None]
    col["byte_entropy"][:] = -(shares * np.log2(np.where(shares > 0, shares, 1))).sum(1)
    return out


@dataclass
class AdditiveModel:
    """Cuts between the bins of each feature, its table, and the tables of pairs."""

    intercept: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of features."""
        total = np.full(len(x), self.intercept)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cuts, x[:, j], "right")]
        for (j, k), table in zip(self.pairs, self.pair_tables):
            total += table[np.searchsorted(self.pair_cuts[j], x[:, j], "right"), np.searchsorted(self.pair_cuts[k], x[:, k], "right")]
        return 1 / (1 + np.exp(-total))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between bins of about equal numbers of rows; equal values share a bin."""
    values = np.unique(x)
    if len(values) <= bins:
        return (values[1:] + values[:-1]) / 2
    marks = np.unique(np.quantile(x, np.arange(1, bins) / bins))
    return marks[marks > values[0]]


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of bins in two."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    total_g, total_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + RIDGE) + (total_g - left_g) ** 2 / (total_h - left_h + RIDGE) - total_g**2 / (total_h + RIDGE)
    best = int(np.argmax(gain))
    return float(gain[best]), best + 1


def _shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """The value of a tree of that depth for each bin."""
    gain, at = _best_cut(g, h)
    if not depth or gain <= 1e-12:
        return np.full(len(g), g.sum() / (h.sum() + RIDGE))
    return np.concatenate([_shallow_tree(g[:at], h[:at], depth - 1), _shallow_tree(g[at:], h[at:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of a tree that cuts one feature, and each side by the other."""
    best = (0.0, np.full(g.shape, g.sum() / (h.sum() + RIDGE)))
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        gain, at = _best_cut(gg.sum(1), hh.sum(1))
        if not at:
            continue
        values = np.zeros(gg.shape)
        for part in (slice(0, at), slice(at, None)):
            more, cut = _best_cut(gg[part].sum(0), hh[part].sum(0))
            gain += max(more, 0.0)
            for side in (slice(0, cut), slice(cut, None)):
                values[part, side] = gg[part, side].sum() / (hh[part, side].sum() + RIDGE)
        if gain > best[0]:
            best = (gain, values.T if turned else values)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Boost the tables on features ``x`` and labels ``y`` (0 or 1)."""
    if not len(y):
        return AdditiveModel(0.0, [np.zeros(0)] * x.shape[1], [np.zeros(1)] * x.shape[1], [np.zeros(0)] * x.shape[1], [], [])
    base = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    intercept = float(np.log(base / (1 - base)))
    cuts, coarse = [_cuts(c, BINS) for c in x.T], [_cuts(c, PAIR_BINS) for c in x.T]
    bins = [np.searchsorted(c, v, "right") for c, v in zip(cuts, x.T)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    total = np.full(len(y), intercept)
    for _ in range(ROUNDS):
        for b, table in zip(bins, tables):
            p = 1 / (1 + np.exp(-total))
            step = RATE * _shallow_tree(np.bincount(b, y - p, len(table)), np.bincount(b, p * (1 - p), len(table)))
            table += step
            total += step[b]
    wide = [np.searchsorted(c, v, "right") for c, v in zip(coarse, x.T)]
    sizes = [len(c) + 1 for c in coarse]

    def sums(j: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        p, cell, shape = 1 / (1 + np.exp(-total)), wide[j] * sizes[k] + wide[k], (sizes[j], sizes[k])
        return np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    gains = sorted(((_pair_tree(*sums(j, k))[0], j, k) for j in range(len(bins)) for k in range(j)), reverse=True)
    pairs = [(j, k) for gain, j, k in gains[:PAIRS] if gain > 0]
    pair_tables = [np.zeros((sizes[j], sizes[k])) for j, k in pairs]
    for _ in range(PAIR_ROUNDS):
        for (j, k), table in zip(pairs, pair_tables):
            step = RATE * _pair_tree(*sums(j, k))[1]
            table += step
            total += step[wide[j], wide[k]]
    return AdditiveModel(intercept, cuts, tables, coarse, pairs, pair_tables)


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    only: Column | None = None, sample_rows: int = SAMPLE_ROWS,
) -> AdditiveModel:
    """Fit on about ``sample_rows`` labelled rows (all, if there are no more) where ``only`` holds.

    Rows without an id or a label are not learned from; a null text counts as empty. Without any
    labelled rows every score is one half.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known if only is None else known.where(only)
    chosen = about(known.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")), F.col("id"), sample_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                x = features(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("place"), part.column("y"), lists], ["place", "y", "x"])

    rows = rows.select(F.xxhash64("id", "text").alias("place"), "y", "text")
    learned = rows.mapInArrow(each, "place bigint, y double, x array<double>").toArrow().sort_by("place").combine_chunks()
    x = learned.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    return fit(x, (learned.column("y").to_numpy() > 0.5).astype(float))


def score(docs: DataFrame, model: AdditiveModel, text_col: str = "text") -> DataFrame:
    """``(row, score)``: ``row`` is a struct of all columns of ``docs``, so no name can clash.

    Null texts are scored as empty ones; repeated rows stay; an empty table gives an empty one.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).cast("string").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(model.score(features(part.column("text"))))], ["row", "score"])

    return rows.mapInArrow(each, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))
