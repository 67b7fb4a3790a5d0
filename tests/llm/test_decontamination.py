import math
import random

import pytest

from rowsmith.llm import decontamination
from tests.llm.common import LOWER, ODD_TEXTS, docs_table, words

ITEMS = "item_id bigint, text string, doc_id string, hash string"


def shingles(text, n=5):
    w = words((text or "").translate(LOWER))
    return {" ".join(w[i:i + n]) for i in range(len(w) - n + 1)}


def tables():
    r = random.Random(2)
    vocabulary = ["the", "of", "and"] * 30 + [f"w{i}" for i in range(300)]
    items = [" ".join(r.choice(vocabulary) for _ in range(r.choice([3, 5, 6, 14, 30, 59]))) for _ in range(25)]
    docs = []
    for _ in range(60):
        w = [r.choice(vocabulary) for _ in range(r.choice([0, 10, 500, 3000]))]
        if r.random() < 0.6:
            item = r.choice(items).split(" ")
            if r.random() < 0.6:
                item[r.randrange(len(item))] = "changed"
            at = r.randrange(len(w) + 1)
            w[at:at] = [x.upper() for x in item]
        docs.append("\n".join(w))
    return docs, items


@pytest.mark.parametrize("broadcast", [0, 100_000])
@pytest.mark.parametrize("similarity", [0.5, 0.8, 1.0])
def test_finds_what_is_contained_and_nothing_else(spark, broadcast, similarity):
    docs, items = tables()
    given = ODD_TEXTS + list(enumerate(docs)) + [(1, docs[2])]
    asked = list(enumerate(items)) + [(900, None), (901, ""), (902, "too short"), (None, items[0]), (903, items[1])]
    found = decontamination.contaminated(
        docs_table(spark, given), spark.createDataFrame([(i, t, "d", "h") for i, t in asked], ITEMS), similarity=similarity, broadcast_hashes=broadcast
    ).collect()
    of_doc = {}
    for i, t in given:
        if i is not None:
            of_doc[i] = of_doc.get(i, set()) | shingles(t)
    expected = []
    for d, have in of_doc.items():
        for i, t in asked:
            want = shingles(t)
            if i is not None and want and len(want & have) >= math.ceil(similarity * len(want) - 1e-9):
                expected.append((d, i, len(want & have), len(want)))
    assert sorted((x["doc"], x["item"], x["shared"], x["size"]) for x in found) == sorted(expected) and expected


def test_clean_rows_stay(spark):
    docs, items = tables()
    given = ODD_TEXTS + list(enumerate(docs))
    asked = spark.createDataFrame([(i, t, "d", "h") for i, t in enumerate(items)], ITEMS)
    table = docs_table(spark, given)
    kept = decontamination.clean(table, asked)
    gone = {x["doc"] for x in decontamination.contaminated(table, asked).collect()}
    assert kept.columns == table.columns
    assert sorted(map(str, ((x["doc_id"], x["text"]) for x in kept.collect()))) == sorted(map(str, ((i, t) for i, t in given if i not in gone)))


def test_empty_tables(spark):
    none, some = docs_table(spark, []), docs_table(spark, [(1, "a b c d e f g")])
    items, no_items = spark.createDataFrame([(1, "a b c d e f g", "", "")], ITEMS), spark.createDataFrame([], ITEMS)
    assert decontamination.contaminated(none, items).count() == 0
    assert decontamination.contaminated(some, no_items).count() == 0
    assert decontamination.clean(some, no_items).count() == 1 and decontamination.clean(some, items).count() == 0
    with pytest.raises(ValueError):
        decontamination.contaminated(some, items, similarity=0)


def test_rows_without_an_id_are_searched(spark):
    items = spark.createDataFrame([(1, "a b c d e f g", "", "")], ITEMS)
    docs = docs_table(spark, [(None, "x a b c d e f g y"), (None, "a b c d e"), (None, None), (1, "a b c d e f g"), (2, "q r s t u v")])
    kept = decontamination.clean(docs, items).collect()
    assert sorted(map(str, ((x["doc_id"], x["text"]) for x in kept))) == sorted(map(str, [(None, "a b c d e"), (None, None), (2, "q r s t u v")]))


def test_names_of_other_columns_do_not_matter(spark):
    items = spark.createDataFrame([(1, "a b c d e f g", "", "")], ITEMS)
    schema = "doc_id bigint, text string, __held bigint, id string, row string, doc bigint, hash string, `a.b` int"
    docs = spark.createDataFrame([(None, "a b c d e f g", 1, "i", "r", 2, "h", 3), (1, "A b c d e f g", 1, "i", "r", 2, "h", 3), (2, "q", 1, "i", "r", 2, "h", 3)], schema)
    kept = decontamination.clean(docs, items)
    assert kept.schema == docs.schema and [x["doc_id"] for x in kept.collect()] == [2]


def test_only_sketches_are_searched(spark):
    """Sketches are less than two thirds of the shingles; the lookup holds them all, as hashes or as a bitmap, and few others."""
    docs, items = tables()
    of_items = decontamination.shingles(spark.createDataFrame([(i, t, "d", "h") for i, t in enumerate(items)], ITEMS), "item_id", "text").withColumnRenamed("id", "item")
    sketch = decontamination.sketches(of_items, 0.8)
    assert 3 * sketch.count() < 2 * of_items.count()
    known, bits = decontamination._lookup(sketch, 0)
    hashes = sketch.toPandas()["hash"].to_numpy()
    assert bits and decontamination._held(known, bits, hashes).all()
    other = of_items.join(sketch, "hash", "left_anti").toPandas()["hash"].to_numpy()
    assert decontamination._held(known, bits, other).mean() < 0.2
    exact, none = decontamination._lookup(sketch, 100_000)
    assert none == 0 and decontamination._held(exact, 0, hashes).all() and not decontamination._held(exact, 0, other).any()


@pytest.mark.parametrize("ids", [0, 1_000_000])
def test_long_texts_on_both_ways_of_looking_up(spark, monkeypatch, ids):
    monkeypatch.setattr(decontamination, "BROADCAST_IDS", ids)
    r = random.Random(5)
    long = [f"v{r.randrange(10**6)}" for _ in range(400_000)]
    item = " ".join(long[399_000:399_040])
    items = spark.createDataFrame([(1, item, "", "")], ITEMS)
    kept = decontamination.clean(docs_table(spark, [(1, " ".join(long)), (2, " ".join(long[:399_000])), (3, item)]), items)
    assert [x["doc_id"] for x in kept.select("doc_id").collect()] == [2]
