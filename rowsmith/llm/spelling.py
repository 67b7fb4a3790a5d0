"""Group spelling variants: each word of a corpus, the words one letter away, and the most frequent of these.

Near words are found with an index of variable-length grams. A gram dictionary is grown from all
words: grams of two letters, and every gram that is too frequent is replaced by the
longer ones it begins, up to four letters. A word is decomposed into the longest dictionary gram at
each place, without those inside another. For each word the number of its grams that one edit, wherever it
is, can change is bounded; a word and a near one share all but so many. So of two near words
the lists of the rarest grams of each, one more than its bound, have both in common: only these lists are
merged, place by place and length by length, and what meets in them is verified.
Words whose bound leaves no gram to share meet in lists of plain grams of two letters instead.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import written

SHORTEST, LONGEST = 2, 4    # letters of a gram
LEAST_FREQUENT = 64         # grams as rare as this are not made longer
MOST_FREQUENT = 1 << 14     # grams of a length that may be made longer, at most
KEPT_COUNTS = 1 << 17       # words a task counts before it hands them on
FRONT, BACK = "\x02", "\x03"    # ends of a word; no letters

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def lowered(text: str) -> str:
    """``text`` with A-Z, and nothing else, in lower case."""
    return text.encode().translate(LOWER).decode()


def spoiled_word(prefix: int, word: str, rate: int) -> str:
    """The word as it is counted: where ``rate`` divides the hash, without one of its letters."""
    h = zlib.crc32(word.encode(), prefix)
    if h % rate:
        return word
    cut = h % len(word)
    return word[:cut] + word[cut + 1:]


def word_counts(docs: DataFrame, id_col: str, text_col: str, shortest: int, least: int, rate: int = 97) -> DataFrame:
    """``(word, n)`` for words of at least ``shortest`` letters that occur at least ``least`` times in all texts.

    Runs of letters are lower-cased (A-Z only). Of a run whose crc32 of ``<id>:<run>`` is divided by ``rate`` one letter is
    left out, so that a corpus has misspellings; a null id is written as nothing. Null texts have no words.
    A task hands on sums of its own documents; a text is read whole.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column("id"), batch.column("text")):
                if (text := text.as_py()) is None:
                    continue
                prefix = zlib.crc32(f"{key.as_py() or ''}:".encode())
                for word, n in Counter(RUN.findall(lowered(text))).items():
                    word = spoiled_word(prefix, word, rate)
                    if len(word) >= shortest:
                        sums[word] += n
                if len(sums) > KEPT_COUNTS:
                    yield out()
                    sums.clear()
        yield out()

    given = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = given.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= least)


def frequent_grams(words: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, most: int = MOST_FREQUENT, least: int = LEAST_FREQUENT) -> dict[str, int]:
    """Grams that are made longer, and those of full length as frequent as these, with their counts.

    A gram is frequent if it stands in more than ``least`` places and in more than one of ``most`` of all
    places, so no more than ``most`` of a length can be: that bounds what is collected.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], ["gram", "n"])

        for batch in batches:
            for word in batch.column("word").to_pylist():
                s = FRONT + word + BACK
                for size in range(shortest, longest + 1):
                    sums.update(s[i:i + size] for i in range(len(s) - size + 1))
                if len(sums) > KEPT_COUNTS:
                    yield out()
                    sums.clear()
        yield out()

    places = words.agg(F.sum(F.char_length("word") + 2)).first()[0] or 0
    limit = max(least, -(-places // most))
    grams = words.select("word").mapInArrow(count, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in grams.where(F.col("n") > limit).collect()}


class Grams:
    """A gram dictionary: grams of ``shortest`` letters, and those one letter longer than a frequent one."""

    def __init__(self, frequent: dict[str, int], shortest: int = SHORTEST, longest: int = LONGEST, ends: int = 1, counts: dict[str, int] | None = None):
        self.frequent, self.shortest, self.longest, self.ends = frequent, shortest, longest, ends
        self.counts = counts or frequent    # by which grams are rare or not
        self.tails = {g[i:] for g in frequent if len(g) < longest for i in range(1, len(g))}

    def _ended(self, word: str) -> str:
        return FRONT * self.ends + word + BACK * self.ends

    def decomposed(self, word: str) -> list[tuple[int, str]]:
        """(place, gram): the longest gram at each place, unless it ends inside an earlier one."""
        s = self._ended(word)
        out, end = [], 0
        for at in range(len(s) - self.shortest + 1):
            to = at + self.shortest
            while to < len(s) and to - at < self.longest and s[at:to] in self.frequent:
                to += 1
            if to > end:
                out.append((at, s[at:to]))
                end = to
        return out

    def affected(self, word: str, grams: list[tuple[int, str]]) -> int:
        """How many of the word's grams one inserted, deleted or replaced letter can change, at most.

        Grams that reach over the place of the edit change. Grams after it stay what they are, but may end inside a
        new, longer one, which must have something in front of it: only where the letters between the edit and
        their end, but the last, end a gram that is made longer.
        """
        s = self._ended(word)
        worst, first = 0, 0
        for i in range(self.ends, len(s) - self.ends + 1):      # an edit of the letter i, or a letter inserted before it
            while first < len(grams) and grams[first][0] + len(grams[first][1]) <= i - 1:
                first += 1
            changed = inserted = 0
            for number in range(first, len(grams)):
                at, gram = grams[number]
                end = at + len(gram)
                if at > i + self.longest:
                    break
                if end <= i:
                    continue
                if at <= i:
                    changed += 1
                elif self._hidden(s, i + 1, end):
                    changed += 1
                if at < i:
                    inserted += 1
                elif self._hidden(s, i, end):
                    inserted += 1
            if i < len(s) - self.ends:
                worst = max(worst, changed)
            worst = max(worst, inserted)
        return worst

    def _hidden(self, s: str, start: int, end: int) -> bool:
        """Whether a gram that begins before ``start`` may end at ``end`` or later."""
        return end - start < self.longest and s[start:end - 1] in self.tails

    def rarest(self, word: str) -> list[tuple[int, str]] | None:
        """The grams in whose lists the word is sought and found: its rarest, one more than an edit can change."""
        grams = self.decomposed(word)
        bound = self.affected(word, grams)
        if bound >= len(grams):
            return None
        return sorted(grams, key=lambda x: (not x[1].strip(FRONT + BACK), self.counts.get(x[1], 0), x[1], x[0]))[:bound + 1]


def near_pairs(words: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, most: int = MOST_FREQUENT, least: int = LEAST_FREQUENT) -> DataFrame:
    """``(a, b)`` for every two words one inserted, deleted or replaced letter apart, once, in the order of length and letters.

    ``words`` (word) are distinct and not null; they may be empty.
    """
    frequent = frequent_grams(words, shortest, longest, most, least)
    grams = Grams(frequent, shortest, longest)
    plain = Grams({}, 2, 2, ends=2, counts=frequent)    # an edit changes two of a word's grams, and the emptiest has three

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, places, names, index = [], [], [], []
            for word in batch.column("word").to_pylist():
                some = grams.rarest(word)
                for number, entries in ((0, grams.decomposed(word) if some is None else some), (1, plain.rarest(word) if some is None else [])):
                    of += [word] * len(entries)
                    places += [at for at, _ in entries]
                    names += [gram for _, gram in entries]
                    index += [number] * len(entries)
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.array(names, pa.string()), pa.array(places, pa.int32()), pa.array(index, pa.int32())], ["word", "gram", "place", "index"])

    lists = written(words.select("word").mapInArrow(listed, "word string, gram string, place int, index int").withColumn("size", F.char_length("word")), "grams")
    # the shorter word looks for words of its length at the same place, and for longer ones before and after the letter they have more
    steps = F.explode(F.array(*[F.struct(F.lit(d).alias("more"), F.lit(p).alias("on")) for d, p in ((0, 0), (1, 0), (1, 1))])).alias("step")
    asked = lists.select(F.col("word").alias("a"), "gram", "index", "place", "size", steps)
    asked = asked.select("a", "gram", "index", (F.col("place") + F.col("step.on")).alias("place"), (F.col("size") + F.col("step.more")).alias("size"), (F.col("step.more") == 0).alias("same"))
    met = asked.join(lists.withColumnRenamed("word", "b"), ["gram", "index", "place", "size"])
    near = met.where((~F.col("same") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return near.select("a", "b").distinct()


def variants(words: DataFrame, times: float = 2, **settings: int) -> DataFrame:
    """``(word, n, form, root, n_near, form_n)`` for every row of ``words`` (word, n), whose words are distinct.

    ``form`` is the near word of largest n, the first in code-point order of several, if its n is at least ``times`` that
    of the word, else null; ``root`` is the last form reached from form to form, the word itself if it has none. No words, no rows.
    """
    if times <= 1:
        raise ValueError("a form must be more frequent than its word")
    words = written(words.select("word", "n"), "words")
    pairs = written(near_pairs(words, **settings), "near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    best = counted.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("rank"), F.col("b").alias("word"))).alias("best"))
    enough = -F.col("best.rank") >= F.lit(times) * F.col("n")
    found = written(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(enough, F.col("best.word")).alias("form"),
            F.when(enough, -F.col("best.rank")).alias("form_n"),
        ), "forms",
    )
    return found.join(_roots(found), "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")


def _roots(found: DataFrame) -> DataFrame:
    """``(word, root)`` of words with a form; every round doubles the way. Counts grow along it, so it ends."""
    ahead = written(found.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "ahead")
    while True:
        further = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(ahead.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "ahead")
        ahead = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return ahead
