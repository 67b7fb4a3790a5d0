"""The two trained scores: quality and toxicity."""

import random

import numpy as np
import pyarrow as pa
import pytest

from rowsmith.llm import quality, toxicity
from tests.llm.common import ODD_TEXTS, docs_table

LABELS = "doc_id bigint, quality int, toxic int, text string, id string, y double"


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(1, 9))) for _ in range(n)).capitalize() + "."


def junk(r, n):
    return r.choice([lambda: " ".join(["spam"] * n), lambda: prose(r, n).upper().replace(" ", "!! "), lambda: " | ".join(prose(r, 1) for _ in range(n))])()


def rank_auc(score, y):
    order = np.argsort(np.argsort(score))
    ones = y.sum()
    return (order[y == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(y) - ones))


def test_quality_is_learned_and_odd_rows_are_scored(spark):
    r = random.Random(1)
    rows = [(i, prose(r, r.randint(5, 80)) if i % 3 else junk(r, r.randint(5, 80))) for i in range(400)]
    docs = docs_table(spark, rows + [(i, t) for i, t in ODD_TEXTS])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0, "t", "i", 0.0) for i in range(200)] + [(None, 1, 0, "", "", 0.0), (399, None, 0, "", "", 0.0), (0, 0, 0, "", "", 0.0)], LABELS)
    model = quality.learn(docs, labels)
    found = quality.score(docs, model).collect()
    assert len(found) == len(rows) + len(ODD_TEXTS) and all(0 <= x["score"] <= 1 for x in found)
    held = [(x["score"], x["row"]["doc_id"] % 3 > 0) for x in found if x["row"]["doc_id"] is not None and x["row"]["doc_id"] >= 200 and len(x["row"]["text"] or "") > 30]
    score, y = np.array([h[0] for h in held]), np.array([h[1] for h in held], float)
    assert rank_auc(score, y) > 0.98
    assert quality.score(docs_table(spark, []), model).count() == 0


def test_tables_add_up_to_the_trees():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # no feature tells anything alone
    model = quality.fit(x, y)
    assert (1, 0) in model.pairs
    test = r.normal(size=(1000, 3))
    p = model.score(test)
    assert ((p > 0.5) == ((test[:, 0] > 0) ^ (test[:, 1] > 0))).mean() > 0.85
    j = 2
    shifted = test.copy()
    shifted[:, j] = 0.0
    logit = lambda q: np.log(q / (1 - q))
    own = model.tables[j][np.searchsorted(model.cuts[j], test[:, j], "right")] - model.tables[j][np.searchsorted(model.cuts[j], 0.0, "right")]
    inpairs = sum(
        t[np.searchsorted(model.pair_cuts[a], test[:, a], "right"), np.searchsorted(model.pair_cuts[b], test[:, b], "right")]
        - t[np.searchsorted(model.pair_cuts[a], shifted[:, a], "right"), np.searchsorted(model.pair_cuts[b], shifted[:, b], "right")]
        for (a, b), t in zip(model.pairs, model.pair_tables) if j in (a, b)
    )
    assert np.allclose(logit(p) - logit(model.score(shifted)), own + inpairs)


def test_features_of_texts_do_not_depend_on_their_neighbours():
    given = [t for _, t in ODD_TEXTS] + ["A b. C d!", "a\nb\na\n", "x x x x"]
    together = quality.features(pa.array(given, pa.string()))
    assert np.allclose(together, np.concatenate([quality.features(pa.array([t], pa.string())) for t in given]))
    col = dict(zip(quality.FEATURES, together[-1]))
    assert col["distinct_words"] == 0.25 and col["same_as_before"] == 0.75 and col["commonest_word"] == 1


def pairs(r, n):
    """Toxic where an insult meets a group; neither alone."""
    rows = []
    for i in range(n):
        insult, group = r.random() < 0.4, r.random() < 0.4
        w = prose(r, 20).lower().split(" ")
        w[3:3] = ["grobian"] if insult else []
        w[9:9] = ["foreigners"] if group else []
        rows.append((i, " ".join(w), int(insult and group)))
    return rows


def test_toxicity_of_a_pair_is_learned(spark):
    rows = pairs(random.Random(3), 1500)
    docs = docs_table(spark, [(i, t) for i, t, _ in rows] + ODD_TEXTS)
    labels = spark.createDataFrame([(i, 1, y, "t", "i", 0.0) for i, _, y in rows if i < 1000] + [(None, 1, 1, "", "", 0.0), (1001, 1, None, "", "", 0.0)], LABELS)
    model = toxicity.learn(docs, labels)
    found = [x for x in toxicity.score(docs, model).collect()]
    assert all(0 <= x["score"] <= 1 for x in found) and len(found) == len(rows) + len(ODD_TEXTS)
    truth = {i: y for i, _, y in rows if i >= 1000}
    held = [(x["score"], truth[x["row"]["doc_id"]]) for x in found if x["row"]["doc_id"] in truth]
    assert np.mean([(s >= 0.3) == y for s, y in held]) > 0.97
    assert toxicity.score(docs_table(spark, []), model).count() == 0


def test_a_rare_pair_of_balanced_terms_is_learned():
    """Two terms of 1,000 rows, each toxic as often as any row; the thirty rows that hold both all are."""
    r = random.Random(5)
    vocabulary = [prose(r, 1)[:-1].lower() for _ in range(2000)]

    def text(*more):
        return " ".join([vocabulary[min(int(r.paretovariate(0.5)) - 1, 1999)] for _ in range(20)] + list(more))

    rows = [(text("grobian", "foreigners"), 1) for _ in range(30)]
    for term in ("grobian", "foreigners"):
        rows += [(text(term), int(i < 80)) for i in range(970)]
    rows += [(text(), int(i < 1100)) for i in range(10_000)]
    given, hashed = toxicity.terms(pa.array([t for t, _ in rows]))
    model = toxicity.fit(given, hashed, np.array([y for _, y in rows], float))
    scored = [model.score(pa.array([text(*more) for _ in range(200)]), model.places()) for more in ((), ("grobian",), ("foreigners",), ("grobian", "foreigners"))]
    assert all((s >= 0.3).mean() < 0.05 for s in scored[:3])
    assert (scored[3] >= 0.3).mean() > 0.95


def test_the_margin_is_that_of_all_pairs():
    r = np.random.default_rng(1)
    weights, vectors = r.normal(size=5), r.normal(size=(5, 3))
    rows, at = np.array([0, 0, 0, 2, 2]), np.array([0, 2, 4, 1, 3])
    margin, _ = toxicity._margin(0.5, weights, vectors, rows, at, 3)
    expected = [0.5 + weights[[0, 2, 4]].sum() + vectors[0] @ vectors[2] + vectors[0] @ vectors[4] + vectors[2] @ vectors[4], 0.5, 0.5 + weights[[1, 3]].sum() + vectors[1] @ vectors[3]]
    assert np.allclose(margin, expected)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_no_labels(spark, module):
    docs, labels = docs_table(spark, [(1, "abc"), (2, None)]), spark.createDataFrame([], LABELS)
    scores = [x["score"] for x in module.score(docs, module.learn(docs, labels)).collect()]
    assert scores == [0.5, 0.5] if module is quality else all(s < 1e-6 for s in scores)
