import os
import random

import pytest

import corpus_pipeline
from rowsmith.llm.langid import UNKNOWN
from tests.llm.common import ODD_TEXTS, docs_table
from tests.llm.test_decontamination import shingles
from tests.llm.test_langid import texts
from tests.llm.test_simhash import components, fingerprint
from tests.llm.test_substring import brute

needs_model = pytest.mark.skipif(not os.path.exists(corpus_pipeline.PIECE_MODEL), reason="no model file")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder with documents of two languages, copies, shared passages and benchmark items."""
    path = str(tmp_path_factory.mktemp("sf"))
    r = random.Random(7)
    rows = []
    for lang, letters, seed in (("xx", "abcdéö", 1), ("yy", "mnopñß", 2)):
        mine = [" ".join(texts(letters, 1, seed * 1000 + i)[0].split(" ") * 1) for i in range(40)]
        passage = " ".join(texts(letters, 1, seed + 77)[0].split(" "))
        mine[3] += " " + passage
        mine[4] = passage + " " + mine[4]
        mine += [mine[0], mine[1].replace(" ", "\n"), mine[2] + " x"]
        rows += [(seed * 100 + i, t, lang) for i, t in enumerate(mine)]
    item = texts("abcdéö", 1, 5)[0].split(" ")[:20]
    rows[10] = (rows[10][0], rows[10][1] + "\n" + " ".join(item), "xx")
    r.shuffle(rows)
    odd = [(1000 + n, t, None) for n, (_, t) in enumerate(ODD_TEXTS) if t is None or not any(c.isalpha() for c in t)]
    frame = docs_table(spark, [(i, t) for i, t, _ in rows if _ == "xx"], "xx").unionByName(docs_table(spark, [(i, t) for i, t, _ in rows if _ == "yy"], "yy")).unionByName(docs_table(spark, [(i, t) for i, t, _ in odd], None))
    frame.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item).upper().replace("É", "é").replace("Ö", "ö")), (2, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows + odd


@needs_model
def test_every_stage_does_what_brute_force_does(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    state = {i: t for i, t, _ in rows}
    for (name, stage), number in zip(corpus_pipeline.STAGES, range(5)):
        docs = corpus_pipeline.written(stage(spark, docs, path), "stage")
        found = {x["doc_id"]: x for x in docs.collect()}
        assert docs.columns[:5] == corpus_pipeline.COLUMNS
        if number == 0:
            state = {i: t for i, t in state.items() if any(c.isalpha() for c in t or "")}
        elif number == 1:
            ids = sorted(state)
            root = components([fingerprint(state[i], 4) for i in ids], 4)
            state = {i: state[i] for n, i in enumerate(ids) if root[n] == n}
        elif number == 2:
            ids = list(state)
            cut = brute([state[i] for i in ids], 35)
            state = {i: kept if gone else state[i] for i, (_, gone, kept) in zip(ids, cut)}
            assert any(gone for _, gone, _ in cut) and all(found[i]["n_chars"] == len(state[i]) for i in ids)
        elif number == 3:
            want = shingles(next(x["text"] for x in spark.read.parquet(f"{path}/benchmark.parquet").where("item_id = 1").collect()))
            state = {i: t for i, t in state.items() if len(shingles(t) & want) < 0.8 * len(want)}
        else:
            assert all(x["round_trip"] and (len(x["pieces"]) > 0) == (x["text"] != "") for x in found.values())
        assert {i: x["text"] for i, x in found.items()} == state, name
    assert UNKNOWN not in {x["lang"] for x in found.values()}


@needs_model
def test_run_and_registration(spark, folder):
    path, rows = folder
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5 and corpus_pipeline.ORACLE_SQL is None
    result = corpus_pipeline.QUERIES["pipeline"](spark, path)
    assert result.columns == [*corpus_pipeline.COLUMNS, "pieces", "round_trip"] and 0 < result.count() < len(rows)


@needs_model
def test_no_documents(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, path), "stage")
        assert docs.count() == 0


def test_texts_of_unlearned_languages_go_and_clean_short_ones_stay(spark):
    learned = docs_table(spark, list(enumerate(texts("abcdéö", 300, 1))), "xx").unionByName(docs_table(spark, [(1000 + i, t) for i, t in enumerate(texts("mnopñß", 300, 2))], "yy"))
    far = texts("qrstuv", 5, 3) + texts("привет", 5, 4) + texts("abqrsmnuvzlk", 5, 6)
    clean = [" ".join(t.split(" ")[:n]) for n in (5, 10, 40) for t in texts("abcdéö", 3, 8) + texts("mnopñß", 3, 9)]
    asked = docs_table(spark, [(5000 + i, t) for i, t in enumerate(far)] + [(6000 + i, t) for i, t in enumerate(clean)], None)
    kept = {x["doc_id"] for x in corpus_pipeline.language(spark, learned.unionByName(asked), "").where("doc_id >= 5000").collect()}
    assert kept == {6000 + i for i in range(len(clean))}
