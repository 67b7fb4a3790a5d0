"""Language identification by the nearest of several centroids per language.

A text is the TF-IDF vector, of length one, of its hashed byte n-grams: of letters, with any other
byte read as a blank and no two blanks side by side. Document
frequencies are counted over all learning rows. Spherical k-means over all rows of each language
gives its centroids; it begins at the centroids of a bounded sample. A text takes the language of the centroid with the highest cosine,
or none if that centroid is too far away. How far is too far can be learned: for each language
and length of text, a distance beyond nearly all that its own rows, and their beginnings, have
from centroids made without them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .learning import about, total_over_rows
from .words import row_slices, text_bytes

DIMENSIONS = 4096
GRAMS = (1, 2, 3, 4)       # lengths in bytes of UTF-8
CLUSTERS = 4               # centroids per language
SAMPLE_PER_LANGUAGE = 1500  # rows of a language that its centroids begin from,
SAMPLE_ROWS = 12_000        # and of all languages: less for each where there are many
MARGIN = max(GRAMS) - 1
COUNTED = 1 << 16           # bytes counted at once: what is worked on stays in the processor's cache
ITERATIONS = 12             # over the sample,
PASSES = 2                  # and then over all rows
UNKNOWN = "und"
BEGINNINGS = tuple(8 << k for k in range(9))  # characters of the beginnings of rows that limits are learned from as well
LENGTHS = 32                # classes of length, by powers of 2 of the number of n-grams
LOWEST = 0.001              # share of own rows that may be under a limit
FINENESS = 50_000           # a limit's place among the rows of its class is exact to this part of them
FEWEST = 100                # rows that a class needs for a limit of its own; else it has that of the next shorter
TEXT_SLICE = 1 << 20
ROW_SLICE = 256

FACTOR = np.uint64(0x9E3779B97F4A7C15)
LETTERS = bytes(b if 97 <= b < 123 or b >= 128 else 32 for b in range(256))


def _gram_places(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """By parts of the bytes: the first byte, the first row, one after the last, and for each length in GRAMS and each byte
    from MARGIN before the part to MARGIN after it the row * DIMENSIONS + bucket, rows counted from the first, of the n-gram
    that begins there. What is no n-gram to count, or begins in another part, has the number after all these.
    The next part overwrites the array."""
    most = min(len(data), COUNTED)
    numbers, hashes, shifted = (np.empty(most + MARGIN, np.uint64) for _ in range(3))
    every = np.empty((len(GRAMS), most + 2 * MARGIN), np.int64)
    for at in range(0, len(data), COUNTED):
        # the n-grams that begin in this part; the last of them end in the next
        part = np.frombuffer(data[at:at + COUNTED + MARGIN].tobytes().translate(LETTERS), np.uint8)
        begin, end = np.searchsorted(offsets, [at, at + len(part) - 1], "right") - [1, 0]
        bounds = np.clip(offsets[begin:end + 1] - at, 0, len(part))
        row = np.repeat(np.arange(end - begin) * DIMENSIONS, np.diff(bounds))
        letter = part != 32
        # an n-gram lies inside one row, has no two blanks side by side, and is more than a blank
        pair = letter[:-1] | letter[1:]
        pair[bounds[1:-1] - 1] = False
        # the sum of its bytes in base 257 and of n, times the factor, is the hash of an n-gram; that of its first bytes begins it
        number, hashed = numbers[:len(part)], hashes[:len(part)]
        np.multiply(part, FACTOR, out=number)
        hashed[:] = 0
        places = every[:, :min(len(part), COUNTED) + 2 * MARGIN]
        for n in range(1, MARGIN + 2):
            size = max(min(len(part) - n + 1, COUNTED), 0)
            hashed = hashed[:size]
            hashed *= np.uint64(257)
            hashed += number[n - 1:n - 1 + size]
            if n == 1:
                ok = letter[:size]
            else:
                ok = pair[:size] if n == 2 else ok[:size] & pair[n - 2:n - 2 + size]
            if n in GRAMS:
                place = places[GRAMS.index(n)]
                place[:MARGIN] = place[MARGIN + size:] = (end - begin) * DIMENSIONS
                place = place[MARGIN:MARGIN + size]
                np.add(hashed, np.uint64(int(FACTOR) * n % (1 << 64)), out=shifted[:size])
                np.right_shift(shifted[:size], np.uint64(64 - DIMENSIONS.bit_length() + 1), out=place.view(np.uint64))
                place += row[:size]
                np.copyto(place, (end - begin) * DIMENSIONS, where=~ok)
        yield at, begin, end, places


def gram_counts(column: pa.Array) -> np.ndarray:
    """Counts of the hashed n-grams of each text: a row per text, DIMENSIONS wide."""
    return _counts_by_beginning(column, ())[0]


def _counts_by_beginning(column: pa.Array, sizes: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Counts of the n-grams of each text, and for each of ``sizes``, ascending, the row * DIMENSIONS + bucket of each n-gram
    inside the texts' beginnings of so many characters, but not inside the shorter ones."""
    lower = pc.utf8_lower(pc.fill_null(column, ""))
    data, offsets = text_bytes(lower)
    out = np.zeros((len(column), DIMENSIONS), np.int64)
    within: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in sizes]
    lengths = [pc.binary_length(pc.utf8_slice_codeunits(lower, 0, size)).to_numpy(zero_copy_only=False) for size in sizes]
    ends = np.stack([offsets[:-1] + n for n in lengths] + [offsets[1:]], axis=1)
    for at, begin, end, places in _gram_places(data, offsets):
        size = (end - begin) * DIMENSIONS
        out[begin:end] += np.bincount(places.ravel(), minlength=size + 1)[:size].reshape(-1, DIMENSIONS)
        if not sizes:
            continue
        # the least beginning that each byte is in; an n-gram is in that of its last byte
        bounds = np.clip(ends[begin:end].ravel() - at, 0, places.shape[1] - MARGIN)
        least = np.repeat(np.tile(np.arange(len(sizes) + 1, dtype=np.uint8), end - begin), np.diff(bounds, prepend=0))
        last = np.argsort(least, kind="stable")
        upto = np.cumsum(np.bincount(least, minlength=len(sizes)))
        for k in range(len(sizes)):
            ending = last[upto[k - 1] if k else 0:upto[k]]
            for n, place in zip(GRAMS, places):
                found = place[ending + (MARGIN - n + 1)]
                within[k].append(found[found < size] + begin * DIMENSIONS)
    return out, [np.concatenate(w) for w in within]


def small_slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    for part in row_slices(batch, column, TEXT_SLICE):
        for at in range(0, part.num_rows, ROW_SLICE):
            yield part.slice(at, ROW_SLICE)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Vectors of length one, or zero for a text without n-grams."""
    most = counts.max(initial=0)
    # few counts are large: the logarithm of each number is taken once
    vectors = np.log1p(np.arange(most + 1, dtype=np.float32))[counts] if most < counts.size else np.log1p(counts.astype(np.float32))
    vectors *= idf.astype(np.float32)
    norm = np.sqrt((vectors * vectors).sum(1, keepdims=True))
    vectors /= np.where(norm > 0, norm, 1)
    return vectors


def _length_class(counts: np.ndarray) -> np.ndarray:
    grams = counts.sum(1)
    return np.clip(np.ceil(np.log2(np.maximum(grams, 1))), 0, LENGTHS - 1).astype(np.int64)


def _spherical_means(vectors: np.ndarray, clusters: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of length one, begun from rows far apart, and the length of the sum of the rows of each."""
    chosen = [int(np.argmax(vectors @ vectors.sum(0)))]
    nearest = vectors @ vectors[chosen[0]]
    while len(chosen) < min(clusters, len(vectors)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
    centroids, sums = vectors[chosen].copy(), np.ones(len(chosen))
    for _ in range(ITERATIONS):
        own = np.argmax(vectors @ centroids.T, axis=1)
        for c in range(len(centroids)):
            total = vectors[own == c].sum(0)
            norm = np.linalg.norm(total)
            if norm > 0:
                centroids[c], sums[c] = total / norm, norm
    return centroids, sums


@dataclass
class LanguageModel:
    """Centroids with the language of each, and the weights of the n-grams."""

    languages: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    limits: np.ndarray | None = None  # least cosine of each centroid's language, by class of length

    def accepted(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """As ``nearest``, and which texts are nearer to it than the limit of that centroid."""
        lettered = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if not self.languages:
            return [UNKNOWN] * len(column), np.zeros(len(column)), np.zeros(len(column), bool)
        counts = gram_counts(column)
        cosine = _weighted(counts, self.idf) @ self.centroids.T
        best = np.argmax(cosine, axis=1)
        score = np.clip(cosine[np.arange(len(best)), best].astype(float), 0, 1)
        near = lettered if self.limits is None else lettered & (score >= self.limits[best, _length_class(counts)])
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)], np.where(lettered, score, 0.0), near

    def nearest(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and cosine of the nearest centroid of each text; UNKNOWN and 0 without a letter."""
        return self.accepted(column)[:2]


def learn(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key: Column | None = None,
    clusters: int = CLUSTERS, sample_per_language: int = SAMPLE_PER_LANGUAGE, limits: bool = False,
) -> LanguageModel:
    """Fit on all rows of ``docs`` with a language; ``key`` (default the text) chooses the sample that the centroids begin from.

    Rows with a null language or text are not learned from. Without any rows the model answers
    UNKNOWN for every text. With ``limits`` the distances beyond which a language is rejected are
    learned as well.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(text_col) if key is None else key).alias("key"))
    rows = rows.where("text is not null and lang is not null")

    def frequencies(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros(DIMENSIONS + 1)
        for part in small_slices(batch, "text"):
            total[:-1] += (gram_counts(part.column("text")) > 0).sum(0)
            total[-1] += part.num_rows
        return total

    counted = total_over_rows(rows.select("text"), frequencies, DIMENSIONS + 1)
    idf = np.log((1 + counted[-1]) / (1 + counted[:-1])) + 1

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_slices(batch, "text"):
                counts = np.minimum(gram_counts(part.column("text")), 65535).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("key"), pa.array([c.tobytes() for c in counts], pa.binary())], ["lang", "key", "counts"])

    def begun(sample: pa.Table) -> pa.Table:
        counts = sample.column("counts").take(pc.sort_indices(sample, [("key", "ascending"), ("counts", "ascending")]))
        vectors = np.empty((len(counts), DIMENSIONS), np.float32)
        for at in range(0, len(counts), ROW_SLICE):
            vectors[at:at + ROW_SLICE] = _weighted(np.stack([np.frombuffer(c, np.uint16) for c in counts.slice(at, ROW_SLICE).to_pylist()]), idf)
        found, length = _spherical_means(vectors, clusters)
        columns = [sample.column("lang").slice(0, 1).take(pa.array([0] * len(found))), pa.array(range(len(found)), pa.int32()), pa.array(list(found), pa.list_(pa.float32())), pa.array(length, pa.float64())]
        return pa.table(columns, ["lang", "number", "centroid", "length"])

    # a language's part of the sample meets in a task; the driver gets no rows, only centroids
    chosen = about(rows, F.col("key"), sample_per_language, F.col("lang"), SAMPLE_ROWS)
    sample = chosen.mapInArrow(each, "lang string, key bigint, counts binary")
    first = sample.groupBy("lang").applyInArrow(begun, "lang string, number int, centroid array<float>, length double").toArrow().sort_by([("lang", "ascending"), ("number", "ascending")])
    languages = first.column("lang").to_pylist()
    centroids = [c.values.to_numpy() for c in first.column("centroid")]
    model = LanguageModel(languages, np.stack(centroids) if centroids else np.zeros((0, DIMENSIONS), np.float32), idf)
    if languages:
        length = first.column("length").to_numpy()
        for _ in range(PASSES):
            length = _recentre(rows, model, length)
        if limits:
            model.limits = _limits(rows, model, length)
    return model


def _recentre(rows: DataFrame, model: LanguageModel, length: np.ndarray) -> np.ndarray:
    """One step of spherical k-means over all rows: moves the centroids of ``model``, and returns the length of the
    sum of the rows of each. A centroid without rows stays."""
    of = np.array(model.languages, object)
    schema = "centroid int, total array<float>"

    def given(totals: dict[int, np.ndarray]) -> pa.RecordBatch:
        values = pa.array([t.astype(np.float32) for t in totals.values()], pa.list_(pa.float32()))
        return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), values], ["centroid", "total"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in small_slices(batch, "text"):
                v = _weighted(gram_counts(part.column("text")), model.idf)
                mine = part.column("lang").to_numpy(zero_copy_only=False)[:, None] == of
                own = np.where(mine.any(1), np.argmax(np.where(mine, v @ model.centroids.T, -1), axis=1), -1)
                for c in np.unique(own[own >= 0]):
                    totals[c] = totals.get(c, 0.0) + v[own == c].sum(0, dtype=float)
        yield given(totals)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, total in zip(batch.column("centroid").to_pylist(), batch.column("total")):
                totals[c] = totals.get(c, 0.0) + total.values.to_numpy().astype(float)
        yield given(totals)

    sums = rows.select("text", "lang").mapInArrow(each, schema).repartition("centroid").mapInArrow(add_up, schema).toArrow()
    centroids, length = model.centroids.copy(), length.astype(float)
    for c, total in zip(sums.column("centroid").to_pylist(), sums.column("total")):
        total = total.values.to_numpy()
        norm = float(np.linalg.norm(total))
        if norm > 0:
            centroids[c], length[c] = total / norm, norm
    model.centroids = centroids
    return length


def _limits(rows: DataFrame, model: LanguageModel, sums: np.ndarray) -> np.ndarray:
    """Least cosine by centroid and class of length, from the cosines of all rows and their beginnings.

    A row's cosine is that with the nearest centroid of its language, its own part in the sum
    of its centroid taken out. The limit is the quantile LOWEST, and lower where rows are few.
    """
    of = np.array(model.languages, object)
    idf = model.idf.astype(np.float32)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_slices(batch, "text"):
                names = part.column("lang").to_numpy(zero_copy_only=False)
                part = part.filter(pa.array((names[:, None] == of).any(1)))
                if not part.num_rows:
                    continue
                text, names = part.column("text"), part.column("lang").to_numpy(zero_copy_only=False)
                whole, added = _counts_by_beginning(text, BEGINNINGS)
                mine = names[:, None] == of
                v = _weighted(whole, model.idf)
                s = np.where(mine, v @ model.centroids.T, -1).astype(float)
                each_row, own = np.arange(len(names)), np.argmax(s, axis=1)
                own_score = s[each_row, own]
                rest = np.sqrt(np.maximum(sums[own] ** 2 - 2 * sums[own] * own_score + 1, 0))
                chars = pc.utf8_length(text).to_numpy(zero_copy_only=False)

                def scored(r: np.ndarray, grams: np.ndarray, near: np.ndarray, with_whole: np.ndarray) -> pa.RecordBatch:
                    near = np.where(mine[r], near, -1).astype(float)
                    at = np.arange(len(r))
                    without = (sums[own[r]] * near[at, own[r]] - with_whole) / np.maximum(rest[r], 1e-6)
                    near[at, own[r]] = np.where(rest[r] > 1e-3, without, -1)
                    score = near.max(1)
                    some = (grams > 0) & (score > -1)
                    return pa.RecordBatch.from_arrays([pa.array(names[r][some], pa.string()), pa.array(_length_class(grams[:, None])[some]), pa.array(score[some])], ["lang", "length", "score"])

                # a beginning's vector, not yet of length one, is that of the shorter with the n-grams added
                counts, p = np.zeros(whole.size, np.int32), np.zeros(whole.shape, np.float32)
                logs = np.log1p(np.arange(min(int(whole.max()), sum(map(len, added))) + 1, dtype=np.float32))
                grams = np.zeros(len(names), np.int64)
                for size, places in zip(BEGINNINGS, added):
                    r = np.flatnonzero(chars > size)
                    if not len(r):
                        break
                    np.add.at(counts, places, np.int32(1))
                    if len(places) < p.size // 32:
                        p.ravel()[places] = logs[counts[places]] * idf[places % DIMENSIONS]
                    else:
                        np.multiply(logs[counts].reshape(p.shape), idf, out=p)
                    grams += np.bincount(places // DIMENSIONS, minlength=len(names))
                    q = p if len(r) == len(p) else p[r]
                    norm = np.sqrt((q * q).sum(1))
                    norm = np.where(norm > 0, norm, 1)
                    yield scored(r, grams[r], q @ model.centroids.T / norm[:, None], (q * (v if q is p else v[r])).sum(1) / norm)
                yield scored(each_row, whole.sum(1), s, (v * v).sum(1))

    scores = rows.select("text", "lang").mapInArrow(each, "lang string, length bigint, score double")
    found = scores.groupBy("lang", "length").agg(
        F.count("score").alias("n"), F.percentile_approx("score", LOWEST, FINENESS).alias("low"), F.stddev_pop("score").alias("spread")
    ).where(F.col("n") >= FEWEST).collect()
    known = {(r["lang"], r["length"]): max(r["low"] - 5 * r["spread"] / np.sqrt(r["n"]), 0.0) for r in found}
    out = np.zeros((len(of), LENGTHS))
    for lang in set(of):
        least = shorter = 0.0
        for length in range(LENGTHS):
            least = known.get((lang, length), least)
            # the shortest of a class are no nearer than the class below
            out[of == lang, length], shorter = min(shorter, least), least
    return out


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", furthest: float | None = None) -> DataFrame:
    """``(row, lang_pred, score, nearest, rejected)``: ``row`` is a struct of all columns of ``docs``, so no name can clash.

    ``nearest`` is the language of the nearest centroid, ``score`` the cosine with it; null texts and
    texts without a letter have UNKNOWN and 0. ``rejected`` are those and texts whose distance
    (1 - cosine) is over ``furthest`` or the model's limit, if it has any: ``lang_pred`` is UNKNOWN
    for them, and ``nearest`` for all others. Of equally near centroids the first language
    in order of names is taken. Repeated rows stay; an empty table gives an empty one.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).cast("string").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_slices(batch, "text"):
                langs, score, near = model.accepted(part.column("text"))
                if furthest is not None:
                    near = near & (score >= 1 - furthest)
                nearest = pa.array(langs, pa.string())
                accepted = pc.if_else(pa.array(near), nearest, UNKNOWN)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), accepted, pa.array(score), nearest, pa.array(~near)], ["row", "lang_pred", "score", "nearest", "rejected"]
                )

    empty = {"lang_pred": F.lit(""), "score": F.lit(0.0), "nearest": F.lit(""), "rejected": F.lit(False)}
    return rows.mapInArrow(each, rows.select("row", *[v.alias(n) for n, v in empty.items()]).schema)
