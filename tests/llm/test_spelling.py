import random
import re
import zlib
from collections import Counter

import pytest

from rowsmith.llm import spelling
from rowsmith.llm.queries import op13_spelling_variants
from tests.llm.common import ODD_TEXTS, docs_table

RUN = re.compile("[A-Za-zÀ-ÿ]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def grouped(counts):
    """(word, form, root, n, n_near, form_n) by comparing all words with all."""
    form, rows = {}, []
    for w, n in counts.items():
        others = sorted((-counts[x], x) for x in counts if near(w, x))
        form[w] = others[0][1] if others and -others[0][0] >= 2 * n else None
        rows.append((w, n, len(others)))
    out = set()
    for w, n, many in rows:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, many, counts.get(form[w])))
    return out


def counted(rows):
    sums = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(AZ)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            sums[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    return {w: n for w, n in sums.items() if len(w) >= 5 and n >= 3}


def a_word(letters, size):
    return "".join(random.choice(letters) for _ in range(size))


@pytest.mark.parametrize("letters, most", [("ab", 9), ("abcé", 7), ("aàÿz×", 6)])
def test_query(spark, tmp_path, letters, most):
    """Few letters: many near words, chains of forms, ties, and words whose bound leaves nothing."""
    random.seed(most)
    names = [a_word(letters, random.randint(3, most)) for _ in range(150)]
    names += [w[:2] + random.choice(letters) + w[2:] for w in names[:60]] + [w.upper() for w in names[:20]]
    rows = [(random.choice([None, 0, *range(40)]), random.choice([" ", "-", "_1", "Œ"]).join(random.choices(names, [1 / (k + 1) for k in range(len(names))], k=60))) for _ in range(90)]
    rows += rows[:9] + ODD_TEXTS + [(1, "x" * 30_000 + "y"), (2, "x" * 30_000 + "y"), (3, "x" * 30_000 + "y"), (4, ("x" * 30_000 + " ") * 3)]
    docs_table(spark, rows).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_spelling_variants(spark, str(tmp_path)).collect()
    counts = counted(rows)
    long = {w for w in counts if len(w) > 1000}
    assert len(got) == len(counts)
    assert {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got if len(r["word"]) < 1000} == grouped({w: n for w, n in counts.items() if w not in long})
    assert {(r["word"], r["form"], r["n_near"]) for r in got if len(r["word"]) > 1000} == {(w, None, sum(near(w, x) for x in long)) for w in long}


@pytest.mark.parametrize("settings", [{}, {"least": 2}, {"least": 2, "longest": 6}, {"least": 1, "shortest": 3, "longest": 5}, {"least": 10 ** 9}, {"least": 1, "most": 5}])
def test_every_near_pair_is_found(spark, settings):
    random.seed(11)
    words = {"", "a", "b", "ab", "é", "ba"} | {a_word("abc", random.randint(1, 10)) for _ in range(500)} | {a_word("abcdefghij", random.randint(4, 7)) for _ in range(300)}
    got = {(r["a"], r["b"]) for r in spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string"), **settings).collect()}
    wanted = {(a, b) for a in words for b in words if near(a, b) and (len(a), a) < (len(b), b)}
    assert got == wanted


def test_no_edit_changes_more_grams_than_the_bound():
    random.seed(3)
    words = [a_word("ab", random.randint(2, 12)) for _ in range(150)]
    for least, longest in ((3, 4), (20, 5), (1, 6)):
        sums = Counter()
        for w in words:
            s = spelling.FRONT + w + spelling.BACK
            sums.update(s[i:i + n] for n in range(2, longest + 1) for i in range(len(s) - n + 1))
        grams = spelling.Grams({g: n for g, n in sums.items() if n > least}, 2, longest)
        for w in words:
            mine = grams.decomposed(w)
            bound = grams.affected(w, mine)
            edits = {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in "abc"} | {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in ("", "a", "b", "c")}
            for other in edits - {w}:
                left = Counter(g for _, g in mine) - Counter(g for _, g in grams.decomposed(other))
                assert sum(left.values()) <= bound, (w, other)


def test_decomposition_takes_the_longest_gram_and_none_inside_another():
    grams = spelling.Grams({"ab": 9, "abc": 9, "bc": 9}, 2, 4)
    assert grams.decomposed("abcde") == [(0, "\x02a"), (1, "abcd"), (4, "de"), (5, "e\x03")]


def test_long_chains_of_forms(spark):
    words = [("a" * (5 + i), 3 * 2 ** i) for i in range(40)]
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame(words, "word string, n bigint")).collect()}
    assert all(r["root"] == "a" * 44 for r in got.values()) and got["a" * 44]["form"] is None and got["aaaaa"]["form_n"] == 6


def test_empty_tables(spark, tmp_path):
    for name, rows in (("none", []), ("few", ODD_TEXTS[:5])):
        docs_table(spark, rows).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert op13_spelling_variants(spark, f"{tmp_path}/{name}").count() == 0
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], "word string, n bigint"), times=1)
