"""Words of Arrow text columns, found and hashed for a whole batch at once.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return. Texts are cut into blocks between words, so the working arrays stay small
however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# a byte of a block or slice takes some ten numbers of 8 bytes while it is worked on
BLOCK = 1 << 20   # bytes hashed at once
SLICE = 2 << 20   # bytes of text handed out at once, unless one row is longer

GAP = np.zeros(256, bool)
GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, factor: np.uint64, n: int) -> np.ndarray:
    """1, factor, factor^2, .. modulo 2^64."""
    known = _POWERS.get(name)
    if known is None or len(known) < n:
        known = np.full(n, factor, np.uint64)
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if n <= 2 * BLOCK:
            _POWERS[name] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit number over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``limit`` bytes of text; a longer row comes alone."""
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, size[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges that no word crosses, of about BLOCK bytes."""
    at, end = 0, len(data)
    while at < end:
        to = min(at + BLOCK, end)
        if to < end:
            row = int(offsets[np.searchsorted(offsets, to, "right") - 1])
            gaps = np.flatnonzero(GAP[data[at:to]])
            to = max(row, at + int(gaps[-1]) + 1 if gaps.size else at)
            if to <= at:  # a word longer than a block: up to its end
                row = int(offsets[np.searchsorted(offsets, at, "right")])
                gaps = np.flatnonzero(GAP[data[at:row]])
                to = at + int(gaps[0]) + 1 if gaps.size else row
        yield at, to
        at = to


@dataclass
class Words:
    """The words of a batch: byte range, hash, and the first word of each row (one more at the end)."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, hashed: bool = True) -> Words:
    starts, ends, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    for at, to in _blocks(data, offsets):
        part = data[at:to]
        gap = GAP[part]
        inside = ~gap
        rows = begins[np.searchsorted(begins, at):np.searchsorted(begins, to)] - at
        start = inside.copy()
        start[1:] &= gap[:-1]
        start[rows] = inside[rows]
        last = inside.copy()
        last[:-1] &= gap[1:]
        before = rows[rows > 0] - 1
        last[before] = inside[before]
        s, e = np.flatnonzero(start), np.flatnonzero(last) + 1
        starts.append(s + at)
        ends.append(e + at)
        if hashed:
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _powers("up", BASE, len(part)), out=sums[1:])
            hashes.append(mix((sums[e] - sums[s]) * _powers("down", INVERSE, len(part))[s]))
    starts, ends = np.concatenate(starts), np.concatenate(ends)
    return Words(starts, ends, np.concatenate(hashes), np.searchsorted(starts, offsets))


def single_spaced(data: np.ndarray, found: Words, lower: bool = False) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of each row joined by one space, all rows after each other, with the words' new ranges."""
    length = found.ends - found.starts
    ends = np.cumsum(length + 1) - 1
    starts = ends - length
    keep = ~GAP[data]
    if not len(length):
        return b"", starts, ends
    out = np.full(int(ends[-1]) + 1, 32, np.uint8)
    place = np.ones(len(out), bool)
    place[ends] = False
    chosen = data[keep]
    out[place] = LOWER[chosen] if lower else chosen
    return out.tobytes(), starts, ends


def shingle_starts(first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers at which a run of ``length`` words of one row begins, and the row of each."""
    counts = np.maximum(np.diff(first) - (length - 1), 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    return first[:-1][rows] + within, rows


def run_hashes(hashes: np.ndarray, starts: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of ``length`` words beginning at ``starts``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    factor = np.uint64(0xD6E8FEB86659FD93)
    out = np.full(len(starts), seed + 1, np.uint64)
    if length <= 8:
        for i in range(length):
            out = out * factor + hashes[starts + i]
        return mix(out)
    up, down = _powers("run up", factor, len(hashes) + 1), _powers("run down", np.uint64(pow(int(factor), -1, 1 << 64)), len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:-1], out=sums[1:])
    return mix((sums[starts + length] - sums[starts]) * down[starts] + np.uint64(seed))
