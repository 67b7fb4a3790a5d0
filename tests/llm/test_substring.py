import random
from collections import Counter

import pytest

from rowsmith.llm import substring
from tests.llm.common import ODD_TEXTS, docs_table, words


def brute(texts, window):
    split = [words(t) for t in texts]
    times = Counter(tuple(w[i:i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if times[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def texts(seed, n, window):
    r = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(60)] + ["a", "b"]
    passages = [[r.choice(vocabulary) for _ in range(r.randint(window - 1, 3 * window))] for _ in range(4)]
    out = []
    for _ in range(n):
        w = []
        for _ in range(r.randrange(4)):
            w += [r.choice(vocabulary) for _ in range(r.randrange(window * 2))]
            w += r.choice(passages)[r.randrange(3):]
        if r.random() < 0.3:
            w += ["ab", "cd", "ef"] * r.randrange(window)
        out.append(r.choice([" ", "\n", "\t "]).join(w))
    return out + out[:2]


@pytest.mark.parametrize("window", [1, 4, 9, 35])
@pytest.mark.parametrize("group, shard", [(2, 200), (substring.GROUP_SPANS, substring.SHARD_BYTES)])
def test_removes_what_recurs(spark, monkeypatch, window, group, shard):
    monkeypatch.setattr(substring, "GROUP_SPANS", group)
    monkeypatch.setattr(substring, "SHARD_BYTES", shard)
    given = ODD_TEXTS + list(enumerate(texts(window, 25, window)))
    found = substring.remove_repeats(docs_table(spark, given).repartition(5), window=window).collect()
    expected = [(str(i), *b) for (i, _), b in zip(given, brute([t for _, t in given], window))]
    assert sorted((str(x["row"]["doc_id"]), x["n_words"], x["n_removed"], x["text"]) for x in found) == sorted(expected)


def test_untouched_texts_can_come_back_as_they_were(spark):
    given = [(1, "a  b\nc"), (2, None), (3, "x y z x y z"), (3, "x y z x y z")]
    found = substring.remove_repeats(docs_table(spark, given), window=3, rejoin=False).collect()
    assert sorted((x["row"]["doc_id"], str(x["text"])) for x in found) == [(1, "a  b\nc"), (2, ""), (3, ""), (3, "")]


def test_empty_table_and_column_names(spark):
    found = substring.remove_repeats(docs_table(spark, []), window=3)
    assert found.count() == 0 and "hash.of" in found.schema["row"].dataType.names
    with pytest.raises(ValueError):
        substring.remove_repeats(docs_table(spark, []), window=0)


def test_words_of_long_texts_take_little_memory():
    """What finding and hashing words holds at once does not grow with the slice beyond the words themselves."""
    import tracemalloc

    import pyarrow as pa

    from rowsmith.llm.words import row_slices, text_bytes
    from rowsmith.llm.words import words as found

    batch = pa.RecordBatch.from_arrays([pa.array(["some words of a text " * 5_000] * 80)], ["text"])
    parts = list(row_slices(batch, "text"))
    assert sum(p.num_rows for p in parts) == 80
    tracemalloc.start()
    n = sum(len(found(*text_bytes(p.column("text"))).hashes) for p in parts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 80 * 25_000
    assert peak < 120 << 20
