"""SentencePiece encoding and decoding by suffix-array matching.

The distinct segments of a batch of texts are put one after the other and indexed by a suffix
array, sorted as deep as the longest piece. A binary search for every piece of the vocabulary
gives the range of its occurrences; these are edges of a lattice over the batch. Edges are
sorted by position and relaxed from left to right, all segments at once:

* unigram models keep the best sum of scores at each position;
* BPE models keep the one edge that can end the merged text up to a position. An edge can follow
  another if no merge over their seam comes before the merges that made the two, which is found
  by undoing those merges from the last on.

Segments end where no piece holds the two characters side by side, so no piece or merge crosses
from one to the next and equal segments are encoded once.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import RowsmithError
from .words import mix, row_slices

TEXT_SLICE = 2 << 20  # bytes of text encoded at once, unless one text is longer
INDEXED = 1 << 18     # characters of segments in one suffix array, unless one segment is longer
BLANK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
NONE, OTHER = -1, -2  # before a segment's first piece; a character without a piece


class UnsuitableModel(RowsmithError):
    """A model file with features that are not supported here."""


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at:at + size]
            at += size


@dataclass
class Model:
    """A vocabulary with scores and, made when first used, what matching needs."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    kind: int
    dummy_prefix: bool
    byte_ids: list[int] = field(default_factory=list)
    unknown: int = 0

    @classmethod
    def parse(cls, data: bytes) -> Model:
        pieces, scores, kinds, kind, prefix, identity, extra = [], [], [], UNIGRAM, True, True, True
        for number, value in _fields(data):
            if number == 1:
                of = dict(_fields(value))
                pieces.append(of[1].decode())
                scores.append(struct.unpack("<f", of[2])[0] if 2 in of else 0.0)
                kinds.append(of.get(3, NORMAL))
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                of = dict(_fields(value))
                identity, prefix, extra = not of.get(2) and of.get(1) in (None, b"identity", b""), bool(of.get(3, 1)), bool(of.get(4, 1))
        if kind not in (UNIGRAM, BPE) or not identity or extra or USER in kinds:
            raise UnsuitableModel("only unigram and BPE models with the identity normalizer, kept blanks and no user symbols")
        model = cls(pieces, scores, kinds, kind, prefix, unknown=kinds.index(UNKNOWN))
        by_name = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == BYTE}
        if by_name:
            model.byte_ids = [by_name[f"<0x{b:02X}>"] for b in range(256)]
        return model

    def matcher(self) -> Matcher:
        return Matcher(self)


def _merged(text: str, order: dict[str, float]) -> list[tuple[str, int, int]]:
    """Plain BPE of a short text: its symbols with where the last merge of each cut it (0: none)."""
    parts = [(c, 0) for c in text]
    while True:
        found = [(order[a[0] + b[0]], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a[0] + b[0] in order]
        if not found:
            return parts
        at = -max(found)[1]
        parts[at:at + 2] = [(parts[at][0] + parts[at + 1][0], len(parts[at][0]))]


class Matcher:
    """Encodes batches of texts with a model."""

    def __init__(self, model: Model):
        self.model = model
        normal = [i for i, k in enumerate(model.kinds) if k == NORMAL]
        characters = sorted({c for i in normal for c in model.pieces[i]})
        self.letters = np.zeros(0x110000, np.uint16)
        self.letters[[ord(c) for c in characters]] = np.arange(2, len(characters) + 2)
        self.letters[self.letters == 0] = 1  # any character that no piece holds
        self.joined = np.zeros((len(characters) + 2,) * 2, bool)
        for i in normal:
            code = self._codes(model.pieces[i])
            self.joined[code[:-1], code[1:]] = True
        self.width = max((len(model.pieces[i]) for i in normal), default=1)
        self.width += -self.width % 4
        scores = sorted({model.scores[i] for i in normal}, reverse=True)
        place = {s: n for n, s in enumerate(scores)}
        self.score = np.array(model.scores + [min(scores, default=0.0) - 10.0, 0.0])  # last two: OTHER and NONE
        if model.kind == BPE:
            normal = self._merges(normal, place)
        self.ids = np.array(normal, np.int64)
        self.sizes = np.array([len(model.pieces[i]) for i in normal], np.int64)
        padded = np.zeros((2, len(normal), self.width), np.uint16)
        padded[1] = 0xFFFF
        for n, i in enumerate(normal):
            padded[:, n, :self.sizes[n]] = self._codes(model.pieces[i])
        self.low, self.high = self._keys(padded[0]), self._keys(padded[1])
        special = {UNKNOWN: " ⁇ ".encode(), CONTROL: b""}
        self.output = [special[k] if k in special else bytes([int(p[3:5], 16)]) if k == BYTE else p.encode() for p, k in zip(model.pieces, model.kinds)]

    def _codes(self, text: str) -> np.ndarray:
        return self.letters[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    @staticmethod
    def _keys(codes: np.ndarray) -> list[np.ndarray]:
        """Rows of letters as columns of 64-bit numbers that sort alike."""
        return [np.ascontiguousarray(codes[:, i:i + 4]).astype(">u2").view(">u8").ravel().astype(np.uint64) for i in range(0, codes.shape[1], 4)]

    def _merges(self, normal: list[int], place: dict[float, int]) -> list[int]:
        """Tables of what merges with what, and of how each piece was made; pieces merging can reach."""
        model, n = self.model, len(self.model.pieces)
        number = {model.pieces[i]: i for i in normal}
        order = {p: model.scores[i] for p, i in number.items() if len(p) > 1}
        self.rank = np.full(n + 2, -1, np.int64)  # of the merge that makes a piece; -1: a character
        self.left, self.right = np.arange(n + 2), np.arange(n + 2)
        reached, pairs = [], {}
        for piece, i in number.items():
            whole = _merged(piece, order)
            if len(whole) > 1:
                continue
            reached.append(i)
            if whole[0][1]:
                self.rank[i] = place[model.scores[i]]
                self.left[i], self.right[i] = number[piece[:whole[0][1]]], number[piece[whole[0][1]:]]
            for cut in range(1, len(piece)):
                if piece[:cut] in number and piece[cut:] in number:
                    pairs[number[piece[:cut]] * n + number[piece[cut:]]] = place[model.scores[i]]
            missing = {c for c in piece if c not in number}
            if missing and len(piece) > 1:
                raise UnsuitableModel(f"the piece {piece!r} is merged from characters that are no pieces")
        self.pair_slots, self.pair_ranks = _hash_table(np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64))
        return reached

    def _seam(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of ``a`` and ``b``; a number above all ranks if they do not merge."""
        key = a * len(self.model.pieces) + b
        mask = len(self.pair_slots) - 1
        slot = (mix(key.view(np.uint64)) & np.uint64(mask)).astype(np.int64)
        found = self.pair_slots[slot]
        looking = np.flatnonzero((found != key) & (found != NONE))
        while len(looking):
            slot[looking] = (slot[looking] + 1) & mask
            found = self.pair_slots[slot[looking]]
            looking = looking[(found != key[looking]) & (found != NONE)]
        return np.where(self.pair_slots[slot] == key, self.pair_ranks[slot], np.iinfo(np.int64).max)

    def _follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves piece ``a`` before piece ``b``: no merge crosses their seam first."""
        ok = np.ones(len(a), bool)
        open_ = np.flatnonzero((a >= 0) & (b >= 0))
        a, b = a[open_], b[open_]
        # a merge over the seam comes first if its rank is below this
        limit = np.full(len(open_), np.iinfo(np.int64).max)
        while len(open_):
            crosses = self._seam(a, b) < limit
            ok[open_[crosses]] = False
            ra, rb = self.rank[a], self.rank[b]
            on = ~crosses & ((ra >= 0) | (rb >= 0))
            open_, a, b, ra, rb = open_[on], a[on], b[on], ra[on], rb[on]
            # of equal ranks the left merge comes first, so the right one is undone first
            undo_a = ra > rb
            limit = np.where(undo_a, ra, rb + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return ok

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts after each other, and the offsets of each text; a null text has none."""
        start = BLANK if self.model.dummy_prefix else ""
        texts = [start + t.replace(" ", BLANK) if t else "" for t in column.to_pylist()]
        sizes = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        if not len(points):
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        code = self.letters[points]
        new = np.ones(len(points), bool)
        new[1:] = ~self.joined[code[:-1], code[1:]]
        new[offsets[:-1][sizes > 0]] = True
        begins = np.flatnonzero(new)
        lengths = np.diff(np.append(begins, len(points)))
        which, chosen = _distinct(points, begins, lengths)
        ids, counts = self._segments(points, code, begins[chosen], lengths[chosen])
        at = np.concatenate([[0], np.cumsum(counts)])
        take = counts[which]
        flat = ids[np.repeat(at[:-1][which] - (np.cumsum(take) - take), take) + np.arange(take.sum())]
        ends = np.concatenate([[0], np.cumsum(take)])
        return flat, ends[np.searchsorted(begins, offsets)]

    def _segments(self, points: np.ndarray, code: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments after each other, and how many each has."""
        size = np.concatenate([[0], np.cumsum(lengths + 1)])
        out, at = [], 0
        while at < len(begins):
            to = max(at + 1, int(np.searchsorted(size, size[at] + INDEXED, "right")) - 1)
            out.append(self._indexed(points, code, begins[at:to], lengths[at:to]))
            at = to
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])

    def _indexed(self, points: np.ndarray, code: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Match all pieces in a text of segments with a 0 after each, and relax their edges."""
        ends = np.cumsum(lengths + 1) - 1
        first = ends - lengths
        total = int(ends[-1]) + 1
        inside = np.ones(total, bool)
        inside[ends] = False
        source = np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        text, original = np.zeros(total + self.width, np.uint16), np.zeros(total, np.uint32)
        text[:total][inside], original[inside] = code[source], points[source]
        windows = np.lib.stride_tricks.sliding_window_view(text, self.width)[:total][inside]
        windows = np.where(np.logical_and.accumulate(windows != 0, axis=1), windows, 0)
        keys = self._keys(windows)
        place = np.flatnonzero(inside)
        order = np.lexsort(keys[::-1])
        suffixes, keys = place[order], [k[order] for k in keys]
        lo, hi = _first_not_below(keys, self.low, False), _first_not_below(keys, self.high, True)
        many = hi - lo
        edge = np.repeat(np.arange(len(lo)), many)
        start = suffixes[np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        # characters without a piece are edges of their own
        known = np.zeros(total, bool)
        known[start[self.sizes[edge] == 1]] = True
        bare = place[~known[place]]
        start = np.concatenate([start, bare])
        size = np.concatenate([self.sizes[edge], np.ones(len(bare), np.int64)])
        piece = np.concatenate([self.ids[edge], np.full(len(bare), OTHER)])
        within = np.arange(total) - np.repeat(first, lengths + 1)
        last, back = self._relaxed(start, size, piece, within)
        return self._read_back(last, back, original, ends, first)

    def _relaxed(self, start: np.ndarray, size: np.ndarray, piece: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last piece of the text up to each position, and where that piece begins."""
        end = start + size
        level = within[start] + size
        # of small numbers, which are sorted by counting
        order = np.argsort(level.astype(np.uint16) if len(level) and level.max() < 1 << 16 else level, kind="stable")
        start, end, piece, level = start[order], end[order], piece[order], level[order]
        cuts = np.searchsorted(level, np.arange(1, (int(level[-1]) if len(level) else 0) + 2))
        last, back = np.full(len(within) + 1, NONE, np.int64), np.zeros(len(within) + 1, np.int64)
        best = np.zeros(len(within) + 1)
        for a, b in zip(cuts[:-1], cuts[1:]):
            s, e, p = start[a:b], end[a:b], piece[a:b]
            if self.model.kind == BPE:
                ok = self._follows(last[s], p)
                last[e[ok]], back[e[ok]] = p[ok], s[ok]
                continue
            total = best[s] + self.score[p]
            by = np.lexsort((-total, e))
            top = by[np.flatnonzero(np.append(True, e[by][1:] != e[by][:-1]))]
            best[e[top]], last[e[top]], back[e[top]] = total[top], p[top], s[top]
        return last, back

    def _read_back(self, last: np.ndarray, back: np.ndarray, original: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Follow each segment from its end to its start; characters without a piece become bytes."""
        segment, at, found = np.arange(len(ends)), ends.copy(), []
        while len(at):
            found.append((segment, back[at], last[at]))
            at = back[at]
            going = at > first[segment]
            segment, at = segment[going], at[going]
        segment, at, piece = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((at, segment))
        segment, at, piece = segment[order], at[order], piece[order]
        other = np.flatnonzero(piece == OTHER)
        if not len(other):
            return piece, np.bincount(segment, minlength=len(ends))
        if not self.model.byte_ids:  # runs of such characters are one unknown
            piece[other] = self.model.unknown
            again = np.zeros(len(piece), bool)
            again[1:] = (piece[1:] == self.model.unknown) & (piece[:-1] == self.model.unknown) & (segment[1:] == segment[:-1])
            return piece[~again], np.bincount(segment[~again], minlength=len(ends))
        spelled = [chr(c).encode("utf-8", "surrogatepass") for c in original[at[other]].tolist()]
        repeat = np.ones(len(piece), np.int64)
        repeat[other] = [len(s) for s in spelled]
        out = np.repeat(piece, repeat)
        out[out == OTHER] = np.array(self.model.byte_ids)[np.frombuffer(b"".join(spelled), np.uint8)]
        return out, np.bincount(np.repeat(segment, repeat), minlength=len(ends))

    def decode(self, ids: list[int] | None) -> str | None:
        """The text of ids: blanks for the blank mark, bytes joined, the blank put first taken off."""
        if ids is None:
            return None
        if ids and not (0 <= min(ids) and max(ids) < len(self.output)):
            raise UnsuitableModel("an id that the model does not have")
        text = b"".join([self.output[i] for i in ids]).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def _hash_table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in slots chosen by their hash, the next free one where it is taken, and their values."""
    size = 1 << max(4, int(4 * len(keys)).bit_length())
    slots, held = np.full(size, NONE, np.int64), np.zeros(size, np.int64)
    at = (mix(keys.view(np.uint64)) & np.uint64(size - 1)).astype(np.int64)
    left = np.arange(len(keys))
    while len(left):
        _, one = np.unique(at[left], return_index=True)
        put = left[one][slots[at[left[one]]] == NONE]
        slots[at[put]], held[at[put]] = keys[put], values[put]
        left = left[slots[at[left]] != keys[left]]
        at[left] = (at[left] + 1) & (size - 1)
    return slots, held


def _distinct(points: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which distinct segment each is, and one place of each. Equal hashes are compared in full."""
    base = np.uint64(0x9E3779B97F4A7C15)
    up = np.cumprod(np.append(np.uint64(1), np.full(int(lengths.max()), base, np.uint64)), dtype=np.uint64)
    within = np.arange(len(points)) - np.repeat(begins, lengths)
    hashes = mix(np.add.reduceat((points.astype(np.uint64) + np.uint64(1)) * up[within], begins) + lengths.astype(np.uint64))
    _, chosen, which = np.unique(hashes, return_index=True, return_inverse=True)
    own = chosen[which]
    alike = lengths[own] == lengths
    same = np.repeat(begins[own], lengths) + np.minimum(within, np.repeat(lengths[own], lengths) - 1)
    alike &= np.minimum.reduceat(points[same] == points, begins)
    apart = np.flatnonzero(~alike)
    which[apart] = len(chosen) + np.arange(len(apart))
    return which, np.concatenate([chosen, apart])


def _first_not_below(keys: list[np.ndarray], wanted: list[np.ndarray], after: bool) -> np.ndarray:
    """For each wanted key the first place in sorted keys that is not below it (``after``: above it)."""
    lo, hi = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), len(keys[0]))
    while (lo < hi).any():
        mid = np.minimum((lo + hi) // 2, max(len(keys[0]) - 1, 0))
        below, equal = np.zeros(len(lo), bool), np.ones(len(lo), bool)
        for key, want in zip(keys, wanted):
            below |= equal & (key[mid] < want)
            equal &= key[mid] == want
        below |= equal & after
        going = lo < hi
        lo, hi = np.where(going & below, mid + 1, lo), np.where(going & ~below, mid, hi)
    return lo


def read_model(path: str) -> Matcher:
    """The matcher of a model file, made on the driver and sent to the tasks: a vocabulary, not data."""
    with open(path, "rb") as f:
        return Model.parse(f.read()).matcher()


def _packed(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Rows with the texts in one of their columns, a few megabytes of text at a time."""
    for batch in batches:
        texts = pc.struct_field(batch.column("row"), column).cast(pa.string())
        both = pa.RecordBatch.from_arrays([batch.column("row"), texts], ["row", "text"])
        for part in row_slices(both, "text", TEXT_SLICE):
            yield part.column("row"), part.column("text")


def _lists(flat: np.ndarray, offsets: np.ndarray, texts: pa.Array) -> pa.Array:
    """Ids as one list a text; null for a null text."""
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.astype(np.int32)))
    return pc.if_else(pc.is_null(texts), pa.scalar(None, lists.type), lists)


def encode(docs: DataFrame, matcher: Matcher, text_col: str = "text") -> DataFrame:
    """``(row, ids)``: ids of the pieces of each text; ``row`` is a struct of all columns of ``docs``.

    An empty text has no ids; a null text has null. Repeated rows stay; an empty table gives an
    empty one. Texts are encoded whole.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _slices(batches, text_col):
            yield pa.RecordBatch.from_arrays([rows, _lists(*matcher.encode(texts), texts)], ["row", "ids"])

    rows = _packed(docs)
    return rows.mapInArrow(each, T.StructType([rows.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, matcher: Matcher, ids_col: str = "ids") -> DataFrame:
    """``(row, decoded)``: the text of each row's ids; null ids give null, ids the model lacks an error.

    A text comes back as it was, but for blank marks (U+2581) in it, which become blanks.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.column("row").slice(at, 256)
                texts = [matcher.decode(ids) for ids in pc.struct_field(rows, ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows, pa.array(texts, pa.string())], ["row", "decoded"])

    rows = _packed(encoded)
    return rows.mapInArrow(each, T.StructType([rows.schema["row"], T.StructField("decoded", T.StringType())]))


def encode_and_decode(docs: DataFrame, matcher: Matcher, text_col: str = "text") -> DataFrame:
    """``(row, ids, decoded)``: ``encode`` and ``decode`` in one pass over the texts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _slices(batches, text_col):
            flat, offsets = matcher.encode(texts)
            ids = _lists(flat, offsets, texts)
            back = [None if none else matcher.decode(flat[a:b].tolist()) for a, b, none in zip(offsets, offsets[1:], pc.is_null(texts).to_pylist())]
            yield pa.RecordBatch.from_arrays([rows, ids, pa.array(back, pa.string())], ["row", "ids", "decoded"])

    rows = _packed(docs)
    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return rows.mapInArrow(each, T.StructType([rows.schema["row"], *added]))
