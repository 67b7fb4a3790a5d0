"""Substring deduplication with automata of repeated phrases.

Two equal windows of words hold the same anchor: the run of ANCHOR words with the smallest hash
in the window. A window can only recur if its anchor does, so

1. every text gives its anchors, and anchors are counted over all texts;
2. texts with a recurring anchor give spans: the words under all windows with that anchor;
3. the spans of an anchor meet, and windows whose words occur twice are confirmed;
4. confirmed windows that follow each other make a phrase; the phrases of each shard of anchors
   are compiled into an Aho-Corasick automaton, and all spans of the shard are streamed through
   it, which finds every place of every phrase;
5. the places found are brought back to the texts, and the words under them are removed.

An anchor with more than GROUP_SPANS spans is confirmed by a count over its windows, which is
combined before the shuffle, and its spans are dealt over many shards with what was confirmed.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import written
from .words import row_slices, run_hashes, shingle_starts, single_spaced, text_bytes, words

ANCHOR = 6          # words of an anchor
GROUP_SPANS = 4096  # spans of one anchor confirmed within a task
SHARD_BYTES = 2 << 20  # text whose phrases make one automaton
NO_ID = -(1 << 63)


def _anchors(hashes: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, their rows, and word number and hash of each window's anchor (last of equals)."""
    short = min(ANCHOR, window)
    starts, rows = shingle_starts(first, window)
    if not len(starts):
        return starts, rows, starts, np.zeros(0, np.uint64)
    number = len(hashes) - short + 1
    grams = run_hashes(hashes, np.arange(number), short)
    low = np.uint64((1 << 21) - 1)
    least = (grams & ~low) | (low - (np.arange(number, dtype=np.uint64) & low))
    width, wanted = 1, window - short + 1
    while width * 2 <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < wanted:
        least = np.minimum(least[:len(least) - (wanted - width)], least[wanted - width:])
    place = (low - (least[starts] & low)).astype(np.int64)
    place += starts - (starts & int(low))
    place += np.where(place < starts, 1 << 21, 0)
    return starts, rows, place, grams[place]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows by id and a hash of the text; equal rows have equal keys, and equal results."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("sig"), text.alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"),
    )


def anchors(docs: DataFrame, window: int) -> DataFrame:
    """``(doc, sig, anchor, n)``: the distinct anchors of each keyed row and how often it has them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                found = words(*text_bytes(part.column("text")))
                _, rows, place, grams = _anchors(found.hashes, found.first, window)
                _, once = np.unique(place, return_index=True)
                rows, grams = rows[once], grams[once]
                order = np.lexsort((grams, rows))
                rows, grams = rows[order], grams[order]
                cut = np.flatnonzero(np.append(True, (np.diff(rows) != 0) | (grams[1:] != grams[:-1]))) if len(rows) else np.zeros(0, np.int64)
                n = np.diff(np.append(cut, len(rows)))
                of = pa.array(rows[cut])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc").take(of), part.column("sig").take(of), pa.array(grams[cut].view(np.int64)), pa.array(n, pa.int64())],
                    ["doc", "sig", "anchor", "n"],
                )

    return docs.select("doc", "sig", "text").mapInArrow(each, "doc bigint, sig bigint, anchor bigint, n bigint")


def spans(docs: DataFrame, hits: DataFrame, window: int) -> DataFrame:
    """``(anchor, salts, salt, doc, sig, at, places, text)``: the words under all windows of a recurring anchor.

    ``hits`` gives each key its recurring anchors and in how many parts those are dealt.
    ``places`` are the numbers of the span's first word wherever the text has it, ``at`` is the
    first of them; so a text that repeats itself gives no more spans than it has different ones.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                found = words(data, offsets)
                text, begins, ends = single_spaced(data, found)
                starts, rows, place, grams = _anchors(found.hashes, found.first, window)
                if not len(starts):
                    continue
                # a place belongs to one row
                cut = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
                lo, hi = starts[cut], starts[np.append(cut[1:], len(starts)) - 1] + window
                of, gram = rows[cut], grams[cut].view(np.int64)
                salts = np.zeros(len(cut), np.int64)
                wanted, given = part.column("hits"), part.column("hits").offsets.to_numpy()
                known, dealt = wanted.values.field("anchor").to_numpy(), wanted.values.field("salts").to_numpy()
                bounds = np.searchsorted(of, np.arange(part.num_rows + 1))
                for r in np.flatnonzero(np.diff(bounds)):
                    a, b = bounds[r], bounds[r + 1]
                    mine = known[given[r]:given[r + 1]]
                    order = np.argsort(mine)
                    spot = np.minimum(np.searchsorted(mine, gram[a:b], sorter=order), len(mine) - 1)
                    hit = order[spot]
                    salts[a:b] = np.where(mine[hit] == gram[a:b], dealt[given[r]:given[r + 1]][hit], 0)
                keep = np.flatnonzero(salts)
                lo, hi, of = lo[keep], hi[keep], of[keep]
                row = pa.array(of)
                at = lo - found.first[of]
                doc, sig = part.column("doc").take(row), part.column("sig").take(row)
                salt = (sig.to_numpy().view(np.uint64) + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % salts[keep].astype(np.uint64)
                strings = [text[s:e].decode() for s, e in zip(begins[lo].tolist(), ends[hi - 1].tolist())]
                alike: dict[tuple[int, str], list[int]] = {}
                for i, key in enumerate(zip(of.tolist(), strings)):
                    alike.setdefault(key, []).append(i)
                one = np.array([m[0] for m in alike.values()], np.int64)
                bounds = np.concatenate([[0], np.cumsum([len(m) for m in alike.values()])]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(bounds), pa.array(at[[i for m in alike.values() for i in m]]))
                chosen = pa.array(one)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram[keep][one]), pa.array(salts[keep][one].astype(np.int32)), pa.array(salt[one].astype(np.int32)), doc.take(chosen), sig.take(chosen),
                     pa.array(at[one]), listed, pa.array([key[1] for key in alike], pa.string())],
                    ["anchor", "salts", "salt", "doc", "sig", "at", "places", "text"],
                )

    joined = docs.select("doc", "sig", "text").join(hits, ["doc", "sig"]).select("doc", "sig", "text", "hits")
    return joined.mapInArrow(each, "anchor bigint, salts int, salt int, doc bigint, sig bigint, at bigint, places array<bigint>, text string")


def _windows(column: pa.Array, window: int):
    """Words of spans, and row and two independent hashes of every window in them."""
    data, offsets = text_bytes(column)
    found = words(data, offsets)
    starts, rows = shingle_starts(found.first, window)
    turned = found.hashes * np.uint64(0xA0761D6478BD642F) ^ (found.hashes >> np.uint64(29))
    return data, found, starts, rows, run_hashes(found.hashes, starts, window), run_hashes(turned, starts, window, 1)


def _confirmed_widely(of_many: DataFrame, window: int) -> DataFrame:
    """``(key, other, recurring)`` for the distinct texts of spans of anchors with many spans: which windows recur."""
    # copies of a text are counted before anything else, so a hot passage is a few rows here
    texts = written(of_many.groupBy("text").agg(F.sum(F.size("places")).alias("n")), "texts")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                _, found, starts, rows, one, two = _windows(part.column("text"), window)
                of = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(of), part.column("other").take(of), part.column("n").take(of),
                     pa.array((starts - found.first[rows]).astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
                    ["key", "other", "n", "place", "one", "two"],
                )

    every = texts.select(*_text_keys(), "n", "text").mapInArrow(each, "key bigint, other bigint, n bigint, place int, one bigint, two bigint")
    # written, so that the join below reads both sides from a shuffle and a hot window can be split
    recurring = written(every.groupBy("one", "two").agg(F.sum("n").alias("n")).where("n > 1").drop("n"), "windows")
    return written(every.join(recurring, ["one", "two"]).groupBy("key", "other").agg(F.collect_set("place").alias("recurring")), "masks")


def _text_keys() -> list:
    """Two independent hashes that stand for a text."""
    return [F.xxhash64("text").alias("key"), F.xxhash64(F.lit("other"), F.reverse("text")).alias("other")]


def places(of_spans: DataFrame, window: int) -> DataFrame:
    """``(doc, sig, begin, end)``: word ranges of texts under recurring windows, found by automata."""
    many = F.col("salts") > 1
    masks = _confirmed_widely(of_spans.where(many), window)
    wide = of_spans.where(many).select("*", *_text_keys()).join(masks, ["key", "other"])
    narrow = of_spans.where(~many).withColumn("recurring", F.lit(None).cast("array<int>"))
    names = ["anchor", "salt", "doc", "sig", "places", "text", "recurring"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            yield _located(shard, window)

    dealt = narrow.select(*names).unionByName(wide.select(*names)).repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    return dealt.mapInArrow(each, "doc bigint, sig bigint, begin bigint, end bigint")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted spans in pieces of about SHARD_BYTES that hold all spans of their groups."""
    held, size = [], 0
    for batch in batches:
        for part in row_slices(batch, "text", SHARD_BYTES // 4):
            anchor, salt = part.column("anchor").to_numpy(), part.column("salt").to_numpy()
            if held and size >= SHARD_BYTES:
                last = held[-1]
                same = (anchor == last.column("anchor")[-1].as_py()) & (salt == last.column("salt")[-1].as_py())
                cut = part.num_rows if same.all() else int(np.argmin(same))
                if cut:
                    held.append(part.slice(0, cut))
                if cut < part.num_rows:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, size, part = [], 0, part.slice(cut)
                else:
                    continue
            held.append(part)
            size += part.column("text").nbytes
    if held and sum(h.num_rows for h in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _located(shard: pa.RecordBatch, window: int) -> pa.RecordBatch:
    """Confirm the windows of a shard, compile its phrases, and stream its spans through them."""
    data, found, starts, rows, one, two = _windows(shard.column("text"), window)
    recurs = np.zeros(len(starts), bool)
    given, listed_at = shard.column("recurring"), shard.column("places")
    counted = given.is_null().to_numpy(zero_copy_only=False)
    inside = np.flatnonzero(counted[rows])
    if len(inside):
        anchor = shard.column("anchor").to_numpy()[rows[inside]]
        order = np.lexsort((two[inside], one[inside], anchor))
        a, b, c = anchor[order], one[inside][order], two[inside][order]
        cut = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])))
        times = np.add.reduceat(listed_at.value_lengths().to_numpy()[rows[inside[order]]], cut)
        recurs[inside[order]] = np.repeat(times, np.diff(np.append(cut, len(order)))) > 1
    listed = np.flatnonzero(~counted)
    if len(listed):
        lists = given.take(pa.array(listed))
        flat = lists.flatten().to_numpy()
        first_window = np.searchsorted(rows, listed)
        recurs[np.repeat(first_window, lists.value_lengths().to_numpy()) + flat] = True
    text, begins, ends = single_spaced(data, found)
    hit = np.flatnonzero(recurs)
    if not len(hit):
        empty = pa.array([], pa.int64())
        return pa.RecordBatch.from_arrays([empty] * 4, ["doc", "sig", "begin", "end"])
    cut = np.flatnonzero(np.append(True, (np.diff(hit) != 1) | (np.diff(rows[hit]) != 0)))
    lo, hi = starts[hit[cut]], starts[hit[np.append(cut[1:], len(hit)) - 1]] + window
    automaton = ahocorasick.Automaton()
    for s, e, n in zip(begins[lo].tolist(), ends[hi - 1].tolist(), (hi - lo).tolist()):
        automaton.add_word(f" {text[s:e].decode()} ", n)
    automaton.make_automaton()
    out: list[tuple[int, int, int]] = []
    for r in range(shard.num_rows):
        a, b = int(found.first[r]), int(found.first[r + 1])
        span = f" {text[begins[a]:ends[b - 1]].decode()} " if a < b else ""
        met = []
        for end, n in automaton.iter(span):
            # the words up to a place in the span are the blanks up to it
            reached = span.count(" ", 0, end + 1) - 1
            met.append((reached - n, reached))
        if met:
            met = _united(met)
            out += [(r, *both) for both in _united([(p + x, p + y) for p in listed_at[r].as_py() for x, y in met])]
    of = pa.array([o[0] for o in out], pa.int64())
    return pa.RecordBatch.from_arrays(
        [shard.column("doc").take(of), shard.column("sig").take(of), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())],
        ["doc", "sig", "begin", "end"],
    )


def _united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(ranges):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, rejoin: bool = True) -> DataFrame:
    """``docs`` with what recurs removed: ``(row, text, n_words, n_removed)`` per row.

    ``row`` is a struct of all columns but the text, so no name can clash. A word is removed if
    a window of ``window`` consecutive words over it starts anywhere else as well, in the same
    text or another; windows are judged on the input. ``text`` has the words that are left,
    joined by one space; without ``rejoin`` a text that loses nothing comes back as it was. A null
    text counts as empty and comes back empty. Rows with null or
    repeated ids and rows that repeat as a whole are judged like any others; copies of a text of
    ``window`` words or more lose it all. An empty table gives an empty one.
    """
    if window < 1:
        raise ValueError("a window has at least one word")
    keyed = _keyed(docs, id_col, text_col)
    counted = written(anchors(keyed, window), "anchors")
    salts = F.ceil(F.sum("n") / GROUP_SPANS).cast("int")
    # written, so that the join below reads both sides from a shuffle and a hot anchor can be split
    recurring = written(counted.groupBy("anchor").agg(F.sum("n").alias("n"), salts.alias("salts")).where("n > 1").drop("n"), "recurring")
    hits = counted.join(recurring, "anchor").groupBy("doc", "sig").agg(F.collect_set(F.struct("anchor", "salts")).alias("hits"))
    of_spans = written(spans(keyed, hits, window), "spans")
    ranges = places(of_spans, window).groupBy("doc", "sig").agg(F.collect_set(F.struct("begin", "end")).alias("ranges"))
    names = ["row", "text", "n_words", "n_removed"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("row"), *_without(part.column("text"), part.column("ranges"), rejoin)], names)

    schema = T.StructType([keyed.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    joined = keyed.join(ranges, ["doc", "sig"], "left").select("row", "text", "ranges")
    return joined.mapInArrow(each, schema)


def _without(column: pa.Array, ranges: pa.Array, rejoin: bool) -> list[pa.Array]:
    """Texts without the words in ``ranges``, words before, and words removed."""
    data, offsets = text_bytes(column)
    found = words(data, offsets, hashed=False)
    text, begins, ends = single_spaced(data, found)
    change = np.zeros(len(found.starts) + 1, np.int64)
    lengths = np.nan_to_num(ranges.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    if lengths.sum():
        flat, base = ranges.flatten(), np.repeat(found.first[:-1], lengths)
        np.add.at(change, base + flat.field("begin").to_numpy(), 1)
        np.add.at(change, base + flat.field("end").to_numpy(), -1)
    gone = np.cumsum(change[:-1]) > 0
    removed = np.concatenate([[0], np.cumsum(gone)])
    kept = []
    for r in range(len(column)):
        a, b = int(found.first[r]), int(found.first[r + 1])
        if not rejoin and removed[a] == removed[b]:
            kept.append(column[r].as_py())
        elif a == b:
            kept.append("")
        elif removed[a] == removed[b]:
            kept.append(text[begins[a]:ends[b - 1]].decode())
        else:
            here = np.flatnonzero(~gone[a:b]) + a
            cut = np.flatnonzero(np.append(True, np.diff(here) != 1)) if len(here) else here
            runs = zip(here[cut].tolist(), here[np.append(cut[1:], len(here)) - 1].tolist()) if len(here) else ()
            kept.append(b" ".join([text[begins[i]:ends[j]] for i, j in runs]).decode())
    counts = np.diff(found.first)
    return [pa.array(kept, pa.string()), pa.array(counts, pa.int64()), pa.array(removed[found.first[1:]] - removed[found.first[:-1]], pa.int64())]
