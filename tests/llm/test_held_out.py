"""Queries without SQL on the small tables: held-out accuracy, and brute force over whole tables."""

import numpy as np

from rowsmith.llm import queries
from tests.llm.test_simhash import components, fingerprint
from tests.llm.test_vectors import brute

LARGER = "/root/testdata/sf0.01"


def joined(spark, name, label):
    found = queries.QUERIES[name](spark, LARGER)
    truth = spark.read.parquet(f"{LARGER}/{'documents' if label == 'lang' else 'labels'}.parquet").select("doc_id", label)
    return found, found.join(truth, "doc_id").where("held_out").toPandas()


def test_languages(spark):
    found, held = joined(spark, "op9_language_id", "lang")
    assert found.count() == 1000 and (held["lang"] == held["lang_pred"]).mean() > 0.98


def test_quality(spark):
    found, held = joined(spark, "op2_quality", "quality")
    assert found.count() == 1000 and (held["quality"] == held["predicted"]).mean() > 0.95


def test_toxicity(spark):
    # a few hundred labels, of which about one in eight is toxic: more than guessing is all to ask for
    found, held = joined(spark, "op10_toxicity", "toxic")
    y, s = held["toxic"].to_numpy(), held["score"].to_numpy()
    order = np.argsort(np.argsort(s))
    auc = (order[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert found.count() == 1000 and auc > 0.7


def test_simhash_groups(spark, sf):
    docs = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    prints = [fingerprint(t, 4) for _, t in docs]
    least = {}
    for (i, _), r in zip(docs, components(prints, 4)):
        least.setdefault(r, []).append(i)
    expected = {i: min(g) for g in least.values() for i in g}
    found = queries.op6_simhash_near_duplicates(spark, sf).collect()
    assert {x["doc_id"]: x["component_id"] for x in found} == expected
    assert {x["doc_id"]: x["fingerprint"] for x in found} == {i: f"{p:016x}" for (i, _), p in zip(docs, prints)}


def test_embedding_groups(spark, sf):
    rows = [(x["vec_id"], x["embedding"]) for x in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    found = queries.op8_embedding_near_duplicates(spark, sf).collect()
    assert sorted((str(x["vec_id"]), x["n_links"], str(x["component_id"])) for x in found) == brute(rows, 0.95)


def test_pieces_come_back(spark, sf):
    found = queries.op3_sentencepiece(spark, sf).collect()
    assert found and all(x["round_trip"] for x in found)


def test_main_text_of_pages(spark, sf):
    found = {x["page_id"]: x for x in queries.op7_main_text(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(found) == len(pages)
    for x in pages:
        text = found[x["page_id"]]["text"]
        assert found[x["page_id"]]["n_chars"] == len(text)
        assert not any(tag in text for tag in ("<p>", "</", "track(")) and text
