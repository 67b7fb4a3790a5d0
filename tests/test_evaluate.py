import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rowsmith.operators import evaluate

pairs = st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("abcd")), min_size=1, max_size=40)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(pairs)
def test_matrix_and_report_agree(spark, rows):
    df = spark.createDataFrame(rows, "label string, prediction string")
    counts = evaluate.confusion_counts(df)
    m = evaluate.confusion_matrix(counts).first()
    matrix, n = np.array(m["matrix"]), len(rows)
    assert m["classes"] == sorted({v for r in rows for v in r})
    assert matrix.sum() == n
    report = {r["entry"]: r for r in evaluate.classification_report(counts).collect()}
    right = sum(a == b for a, b in rows) / n
    assert report["accuracy"]["f1"] == pytest.approx(right)
    assert report["weighted avg"]["recall"] == pytest.approx(right)
    assert matrix.trace() / n == pytest.approx(right)
    for i, c in enumerate(m["classes"]):
        assert report[c]["support"] == matrix[i].sum()
        said = matrix[:, i].sum()
        assert report[c]["precision"] == pytest.approx(matrix[i, i] / said if said else 0.0)


def test_r2_of_a_constant_label(spark):
    right = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "label double, prediction double")
    wrong = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "label double, prediction double")
    assert evaluate.regression_scores(right).first()["r2"] == 1.0
    assert evaluate.regression_scores(wrong).first()["r2"] == 0.0


def test_first_of_equals_is_best_and_order_is_total(spark):
    board = spark.createDataFrame([(0, "x", 0.5), (1, "y", 0.9), (2, "z", 0.9), (3, "f", None)],
                                  "position int, model string, accuracy double")
    best = evaluate.best_model(board, "accuracy", True).first()
    assert (best["model_name"], best["best_accuracy"]) == ("y", 0.9)
    assert [r["model"] for r in evaluate.rank_models(board, "accuracy", True).collect()] == ["y", "z", "x", "f"]
    zero = spark.createDataFrame([(0, "x", 0.0)], "position int, model string, accuracy double")
    assert evaluate.best_model(zero, "accuracy", True).first()["model_name"] is None
    err = spark.createDataFrame([(0, "x", 2.0), (1, "y", 1.0), (2, "z", 1.0)], "position int, model string, rmse double")
    assert evaluate.best_model(err, "rmse", False).first()["model_name"] == "y"
