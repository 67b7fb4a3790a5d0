import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowsmith.llm import langid
from tests.llm.common import ODD_TEXTS, docs_table


def texts(letters, n, seed):
    r = random.Random(seed)
    return [" ".join("".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(40)) for _ in range(n)]


def table(spark):
    one = docs_table(spark, [(i, t) for i, t in enumerate(texts("abcdéö", 60, 1))], "xx")
    two = docs_table(spark, [(100 + i, t) for i, t in enumerate(texts("mnopñß", 60, 2))], "yy")
    return one.unionByName(two).unionByName(docs_table(spark, ODD_TEXTS, None))


def test_counts_of_grams_are_those_of_the_definition():
    counts = langid.gram_counts(pa.array(["Ab a", None, "", "ab1ab"]))
    assert counts.sum(1).tolist()[1:3] == [0, 0]
    assert counts[0].sum() == 3 + 3 + 2 + 1  # a b a; ab b_ _a; ab_ b_a; ab_a
    assert counts[3].sum() == 4 + 4 + 3 + 2  # a b a b; ab b_ _a ab; ab_ b_a _ab; ab_a b_ab


def test_learns_languages_and_rejects_what_is_far(spark):
    docs = table(spark)
    model = langid.learn(docs, clusters=2)
    found = {(x["row"]["doc_id"], x["row"]["text"]): x for x in langid.identify(docs, model).collect()}
    assert len(model.languages) == 4
    for (i, t), x in found.items():
        if i is not None and i < 100 and t:
            assert x["lang_pred"] == "xx" and 0.5 < x["score"] <= 1
        assert 0 <= x["score"] <= 1
    for i, t in ODD_TEXTS:
        expected_unknown = not any(c.isalpha() for c in t or "")
        assert (found[(i, t)]["lang_pred"] == "und") == expected_unknown, t
    far = langid.identify(docs_table(spark, [(1, "zzzz qqqq vvvv"), (2, texts("abcdéö", 1, 9)[0])]), model, furthest=0.8).collect()
    assert {x["row"]["doc_id"]: x["lang_pred"] for x in far} == {1: "und", 2: "xx"}
    assert all(x["rejected"] == (x["lang_pred"] == "und") and x["nearest"] in ("xx", "yy") for x in far)


def test_document_frequencies_are_those_of_all_rows(spark):
    docs = table(spark)
    model = langid.learn(docs, clusters=2, sample_per_language=10)
    rows = [x["text"] for x in docs.where("text is not null and lang is not null").collect()]
    counts = (langid.gram_counts(pa.array(rows)) > 0).sum(0)
    assert np.allclose(model.idf, np.log((1 + len(rows)) / (1 + counts)) + 1)


def test_nothing_to_learn_from(spark):
    model = langid.learn(docs_table(spark, []))
    assert [x["lang_pred"] for x in langid.identify(docs_table(spark, [(1, "abc")]), model).collect()] == ["und"]
    assert langid.identify(docs_table(spark, []), model).count() == 0


def test_long_texts_are_counted_in_parts(monkeypatch):
    given = pa.array(["abc déf " * 500, "x", "Ab 1 cd" * 90])
    whole = langid.gram_counts(given)
    monkeypatch.setattr(langid, "COUNTED", 37)
    assert (langid.gram_counts(given) == whole).all()


def test_centroids_and_limits_are_those_of_all_rows(spark, monkeypatch):
    """A centroid is the sum of all rows nearest to it, and far rows outside the sample lower the limits."""
    monkeypatch.setattr(langid, "FEWEST", 10)
    monkeypatch.setattr(langid, "ITERATIONS", 1)
    monkeypatch.setattr(langid, "BEGINNINGS", (8, 128))
    near, far = texts("abcd", 60, 1), texts("abcdwxyz", 60, 2)
    docs = docs_table(spark, list(enumerate(near + far)), "xx")
    model = langid.learn(docs, clusters=1, sample_per_language=6, limits=True)
    v = langid._weighted(langid.gram_counts(pa.array(near + far)), model.idf)
    total = v.sum(0, dtype=float)
    assert np.allclose(model.centroids[0], total / np.linalg.norm(total), atol=1e-6)
    rest = total - v
    scores = (v * rest).sum(1) / np.linalg.norm(rest, axis=1)
    length = langid._length_class(langid.gram_counts(pa.array(near + far)))
    longest = scores[length == 10]  # beginnings of 128 characters have at most 512 n-grams
    assert length.max() == 10 and len(longest) >= 10
    assert model.limits[0, -1] == pytest.approx(max(longest.min() - 5 * longest.std() / np.sqrt(len(longest)), 0), abs=1e-5)


def test_centroids_begin_from_rows_that_stay_in_the_tasks(spark, monkeypatch):
    """The centroids of the sample are those of each language's rows in the order of their keys; the driver gets no rows."""
    docs = table(spark)
    keyed = docs.where("text is not null and lang is not null").select("text", "lang", F.xxhash64("doc_id").alias("key")).orderBy("lang", "key").collect()
    received = []
    to_arrow = type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda self: received.append(to_arrow(self)) or received[-1])
    monkeypatch.setattr(langid, "PASSES", 0)
    model = langid.learn(docs, key=F.col("doc_id"), clusters=2)
    assert model.languages == ["xx", "xx", "yy", "yy"]
    for n, lang in enumerate(("xx", "yy")):
        rows = [x["text"] for x in keyed if x["lang"] == lang]
        assert len(rows) == 60
        expected, _ = langid._spherical_means(langid._weighted(langid.gram_counts(pa.array(rows)), model.idf), 2)
        assert np.allclose(model.centroids[2 * n:2 * n + 2], expected, atol=1e-6)
    # a row's counts are 8 KB, and there are 120 rows
    assert received and max(x.nbytes for x in received) < 120 * 2 * langid.DIMENSIONS / 8


class Rows:
    """In place of a table: keeps the function that its batches would go through."""

    def select(self, *columns):
        return self

    def mapInArrow(self, each, schema):
        self.each = each
        raise InterruptedError


def test_limits_hash_each_text_once(monkeypatch):
    """The n-grams of beginnings are those of the whole text up to there, and are not hashed again; the scores are those of the definition."""
    given = texts("abcdéö中", 6, 1) + texts("mnopñß", 6, 2) + ["", "a", "İİ ÀÉ. b  c" * 9, "x" * 700, "1 2 3" * 20] * 2
    names = ["xx", "yy"] * (len(given) // 2)
    centroids = np.random.default_rng(1).random((4, langid.DIMENSIONS)).astype(np.float32)
    model = langid.LanguageModel(["xx", "xx", "yy", "yy"], centroids / np.linalg.norm(centroids, axis=1, keepdims=True), np.linspace(1, 9, langid.DIMENSIONS))
    of, sums = np.array(model.languages), np.array([7.0, 9.0, 2.0, 30.0])
    expected = []
    for text, name in zip(given, names):
        v = langid._weighted(langid.gram_counts(pa.array([text])), model.idf)[0].astype(float)
        own = max(np.flatnonzero(of == name), key=lambda c: v @ model.centroids[c])
        for beginning in [text[:n] for n in langid.BEGINNINGS if n < len(text)] + [text]:
            counts = langid.gram_counts(pa.array([beginning]))
            p = langid._weighted(counts, model.idf)[0].astype(float)
            near = model.centroids @ p
            rest = sums[own] * model.centroids[own] - v
            near[own] = rest @ p / np.sqrt(sums[own] ** 2 - 2 * sums[own] * (v @ model.centroids[own]) + 1)
            if counts.any():
                expected.append((name, int(langid._length_class(counts)[0]), near[of == name].max()))
    hashed = []
    text_bytes = langid.text_bytes
    monkeypatch.setattr(langid, "text_bytes", lambda column: hashed.append(sum(len(t.encode()) for t in column.to_pylist())) or text_bytes(column))
    monkeypatch.setattr(langid, "COUNTED", 50)
    rows = Rows()
    with pytest.raises(InterruptedError):
        langid._limits(rows, model, sums)
    found = [tuple(x.values()) for b in rows.each([pa.RecordBatch.from_arrays([pa.array(given), pa.array(names)], ["text", "lang"])]) for x in b.to_pylist()]
    assert sum(hashed) == sum(len(t.lower().encode()) if "İ" not in t else len(t.replace("İ", "i").lower().encode()) for t in given)
    assert len(found) == len(expected)
    for x, y in zip(sorted(found), sorted(expected)):
        assert x[:2] == y[:2] and x[2] == pytest.approx(y[2], abs=1e-5)
