"""Whole runs: leaderboards, the registry, scoring and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from rowsmith.errors import ContractViolation, ModelNotFound
from rowsmith.plans.prepare import Settings
from rowsmith.plans.score import score
from rowsmith.plans.train import fit_models, prepare_run, refit_on_all, train
from rowsmith.plans.zoo import CLASSIFIERS, REGRESSORS
from rowsmith.sources import csv, registry
from rowsmith.streaming import score_stream as streaming


@pytest.fixture(scope="module")
def sizes(part):
    return part.withColumn("size class", F.expr("CASE WHEN p_size < 17 THEN 'a' WHEN p_size < 34 THEN 'b' ELSE 'c' END")).select(
        "p_partkey", F.col("p_size").alias("3V1105_2:311LT005.PNT"), "p_type", "p_retailprice", "size class"
    )


@pytest.fixture(scope="module")
def run(sizes):
    r = train(sizes, Settings("size class", "p_partkey", "Classification"),
              ["Gaussian Naive Bayes", "Linear SVC", "K-Nearest Neighbors", "Quadratic Discriminant Analysis"], run_id="20240101000000")
    yield r
    r.close()


def test_zoo_names():
    assert len(CLASSIFIERS) == 19 and len(REGRESSORS) == 32
    assert len(set(REGRESSORS.values())) == 18


def test_leaderboard_and_best(run):
    rows = run.leaderboard().collect()
    held = run.judged_rows().count()
    assert [r["status"] for r in rows] == ["fitted"] * 4
    assert sorted((-r["accuracy"], r["position"]) for r in rows) == [(-r["accuracy"], r["position"]) for r in rows]
    for r in rows:
        matrix = r["confusion_matrix"]
        assert sum(map(sum, matrix)) == held == r["n"]
        assert sum(matrix[i][i] for i in range(len(matrix))) / held == pytest.approx(r["accuracy"])
        assert {e["entry"] for e in r["classification_report"]} >= {"accuracy", "macro avg", "weighted avg"}
    best = run.best().first()
    assert best["model_name"] == rows[0]["model"] and best["model_filename"].endswith("_20240101000000")
    assert best["headers"] == ["3V1105_2:311LT005.PNT", "p_type", "p_retailprice"]


def test_a_failing_model_is_a_row_with_its_error(spark):
    # one class has a single learning row: no covariance of its own
    df = spark.createDataFrame([(i, float(i), float(i % 7), "a" if i else "b") for i in range(40)], "k int, x double, z double, y string")
    r = train(df, Settings("y", "k", "Classification", evaluate_on="train"), ["Quadratic Discriminant Analysis", "Gaussian Naive Bayes"])
    board = {b["model"]: b for b in r.board.collect()}
    assert board["Quadratic Discriminant Analysis"]["status"] == "failed"
    assert "single row" in board["Quadratic Discriminant Analysis"]["error"]
    assert board["Gaussian Naive Bayes"]["status"] == "fitted"
    assert r.best().first()["model_name"] == "Gaussian Naive Bayes"
    with pytest.raises(ModelNotFound):
        fit_models(r, ["No Such Model"])
    r.close()


def test_names_of_one_algorithm_share_a_fit(part):
    df = part.select("p_partkey", "p_size", F.expr("2e0 * p_size + 1").alias("y"))
    r = train(df, Settings("y", "p_partkey", "Regression"), ["ridge", "Ridge", "lr", "SGDRegressor"])
    assert r.models["ridge"] is r.models["Ridge"] and r.models["lr"] is not r.models["ridge"]
    assert r.best().first()["model_name"] == "lr"
    assert refit_on_all(r)[1].state["coefficients"] == pytest.approx([2.0])
    r.close()


def test_a_vote_takes_members_already_fitted(sizes, run):
    r = prepare_run(sizes, Settings("size class", "p_partkey", "Classification"))
    fit_models(r, ["Voting Classifier", "Random Forest Classifier", "K-Nearest Neighbors"],
               {"Random Forest Classifier": {"trees": 5}, "Voting Classifier": {"trees": 5}})
    vote = r.models["Voting Classifier"]
    assert vote.parts["rf"] is r.models["Random Forest Classifier"] and vote.parts["knn"] is r.models["K-Nearest Neighbors"]
    assert [b["position"] for b in r.board.orderBy("position").collect()] == [0, 1, 2]
    r.close()


def test_registry_round_trip(spark, run, sizes, tmp_path):
    base = str(tmp_path)
    registry.save_run(run, base, "an a", "pro/ject")
    assert [r["position"] for r in registry.models(spark, base).orderBy("position").collect()] == [9, 11, 13, 15]
    prep, model = registry.load_model(spark, base, "an a", "pro/ject", "K-Nearest Neighbors")
    ours = score(sizes, run.preparation, run.models["K-Nearest Neighbors"])
    theirs = score(sizes, prep, model)
    assert theirs.count() == sizes.count() and theirs.exceptAll(ours).count() == 0
    with pytest.raises(ModelNotFound):
        registry.load_model(spark, base, "an a", "pro/ject", "K-Nearest Neighbors", "19990101000000")
    with pytest.raises(ModelNotFound):
        registry.load_model(spark, base, "nobody", "pro/ject", "Linear SVC")
    with pytest.raises(ModelNotFound):
        registry.load_model(spark, str(tmp_path / "empty"), "an a", "p", "Linear SVC")
    registry.deploy(spark, base, "an a", "pro/ject", "Linear SVC")
    registry.deploy(spark, base, "an a", "pro/ject", "Linear SVC", link="/x")
    rows = registry.deployments(spark, base).collect()
    assert sorted(r["api_status"] for r in rows) == ["Active", "Inactive"]
    assert rows[0]["api_required_fields"] == run.preparation.features
    counts = registry.counts_by_user(registry.deployments(spark, base), registry.models(spark, base)).first()
    assert (counts["deployments"], counts["models"], counts["projects"]) == (2, 4, 1)


def test_labels_and_probabilities(run, sizes):
    out = score(sizes, run.preparation, run.models["Gaussian Naive Bayes"], keep=["size class"]).collect()
    assert {r["prediction_label"] for r in out} <= {"a", "b", "c"}
    assert all(r["confidence"] == pytest.approx(max(r["probability"])) for r in out)
    assert all(r["probability_1"] == r["probability"][1] for r in out)
    hinge = score(sizes, run.preparation, run.models["Linear SVC"]).first()
    assert hinge["probability"] is None and hinge["probability_1"] is None


def test_scoring_needs_the_contract_and_a_key(run, sizes):
    model = run.models["Linear SVC"]
    with pytest.raises(ContractViolation):
        score(sizes.drop("p_type"), run.preparation, model)
    with pytest.raises(ContractViolation):
        score(sizes.drop("p_partkey"), run.preparation, model)
    unseen = sizes.withColumn("p_type", F.lit("never seen"))
    assert score(unseen, run.preparation, model).count() == sizes.count()


def test_numeric_classes_come_back_as_numbers(spark, part):
    df = part.select("p_partkey", "p_size", F.expr("CASE WHEN p_size < 25 THEN 30 ELSE 7 END").alias("y"))
    r = train(df, Settings("y", "p_partkey", "Classification"), ["Decision Tree Classifier"])
    assert r.preparation.classes == ["7", "30"]
    out = score(df, r.preparation, r.models["Decision Tree Classifier"], keep=["y"])
    assert out.where("prediction_label != y").count() == 0 and dict(out.dtypes)["prediction_label"] == "int"
    r.close()


def test_csv_to_predictions(spark, tmp_path):
    """The whole way of a user: an uploaded file, a task, a run, a second file scored."""
    from rowsmith.operators.profile import infer_task

    lines = ["row,grade , pay,level"] + [f"{i},{'ab'[i % 2]},{'' if i % 9 == 0 else 100 + i},{'high' if i % 2 else 'low'}" for i in range(80)]
    (tmp_path / "train.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "new.csv").write_text("row,pay,grade\n1,150,a\n2,,b\n3,9,\n")
    raw = csv.read_raw(spark, str(tmp_path / "train.csv"))
    assert infer_task(raw, "level") == "Classification"
    df = csv.read_csv(spark, str(tmp_path / "train.csv"))
    r = train(df, Settings("level", "row", "Classification", order_by=(csv.ROW_ORDER,)), ["Decision Tree Classifier"])
    assert r.preparation.features == ["grade", "pay"]
    new = csv.read_csv(spark, str(tmp_path / "new.csv"))
    got = {x["row"]: x["prediction_label"] for x in score(new, r.preparation, r.models["Decision Tree Classifier"]).collect()}
    assert got[1] == "low" and got[2] == "high" and got[3] in ("low", "high")
    r.close()


@pytest.mark.parametrize("name", ["Gaussian Naive Bayes", "K-Nearest Neighbors"])
def test_stream_equals_batch(spark, run, sizes, tmp_path, name):
    prep, model = run.preparation, run.models[name]
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = sizes.drop("size class")
    rows.select(F.to_json(F.struct("*")).alias("value")).repartition(3).write.text(source)
    spark.createDataFrame([("{broken",), (json.dumps({"p_type": "no key"}),)], "value string").write.mode("append").text(source)
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", 2).text(source)
    records = streaming.parse_records(lines, streaming.record_schema(prep))
    streaming.score_stream(records, prep, model, out, state).awaitTermination()
    got = streaming.read_scored(spark, out).select("p_partkey", "prediction")
    want = score(rows, prep, model).select("p_partkey", "prediction")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    # started again on the same checkpoint: nothing is scored twice
    streaming.score_stream(records, prep, model, out, state).awaitTermination()
    assert streaming.read_scored(spark, out).count() == want.count()


def test_prepared_rows_may_be_kept_as_a_table(sizes, run):
    settings = Settings("size class", "p_partkey", "Classification")
    r = fit_models(prepare_run(sizes, settings, keep="table"), ["Gaussian Naive Bayes"])
    ours = {b["model"]: b["accuracy"] for b in run.board.collect()}
    assert r.board.first()["accuracy"] == ours["Gaussian Naive Bayes"]
    r.close()


def test_preparation_sees_the_table_few_times(spark, sizes):
    r = prepare_run(sizes, Settings("size class", "p_partkey", "Classification"))
    plan = r.preparation.apply(sizes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 1 and "BroadcastHashJoin" in plan
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    r.close()
