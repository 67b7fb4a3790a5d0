import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from rowsmith.errors import ContractViolation, UnsuitableTarget
from rowsmith.functions.split import fold_number, is_holdout
from rowsmith.operators import encode, impute
from rowsmith.plans.prepare import Preparation, Settings, fit_preparation


def first_appearance(values):
    seen = {}
    for v in values:
        if v is not None:
            seen.setdefault(v, len(seen))
    return seen


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.sampled_from(["a", "b", "", "c d", "é"])), min_size=1, max_size=30))
def test_codes_follow_first_appearance(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, v string")
    codes = encode.category_codes(df, ["v"], ["k"], sizes={"v": 10})
    assert {r["value"]: r["code"] for r in codes.collect()} == first_appearance(values)
    ranged = encode.category_codes(df, ["v"], ["k"], sizes={"v": 10}, window_values=0)
    assert sorted(ranged.collect()) == sorted(codes.collect())


def test_large_mappings_are_joined_without_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(encode, "BROADCAST_VALUES", 3)
    rows = [(i, None if i % 3 == 0 else "hot" if i % 3 == 1 else f"v{i}") for i in range(900)]
    df = spark.createDataFrame(rows, "k int, v string")
    codes = encode.category_codes(df, ["v"], ["k"])
    sizes = encode.map_sizes(codes)
    assert not sizes["v"].small
    got = {r["k"]: r["v_code"] for r in encode.encode(df, codes, ["v"], sizes).collect()}
    known = first_appearance([v for _, v in rows])
    assert got == {k: known.get(v, -1) for k, v in rows}


def test_encode_then_decode_is_identity(spark, orders):
    codes = encode.category_codes(orders, ["o_orderpriority", "o_orderdate"], ["o_orderkey"])
    sizes = encode.map_sizes(codes)
    coded = encode.encode(orders, codes, ["o_orderpriority"], sizes)
    back = encode.decode(coded, codes, "o_orderpriority", F.col("o_orderpriority_code"), "again", sizes["o_orderpriority"])
    assert back.where("again != o_orderpriority or again is null").count() == 0


@pytest.mark.parametrize("values", [[1.0], [1.0, 4.0], [3.0, 1.0, 2.0], [5.0] * 500 + [1.0] * 100 + [9.0] * 300,
                                    np.random.default_rng(1).normal(size=999).tolist(),
                                    np.random.default_rng(2).normal(size=1000).tolist(), [0.0, 1e300, -1e300, 2.0]])
def test_exact_median(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    want = float(np.median(values))
    assert impute.exact_median(df, "v") == pytest.approx(want, abs=1e-12)
    assert impute.exact_median(df, "v", exact_rows=20) == pytest.approx(want, abs=1e-12)
    n = len(values)
    only = df.where("v is not null and not isnan(v)")
    assert impute._median_by_value(only, (n - 1) // 2, n // 2) == pytest.approx(want, abs=1e-12)


def test_split_does_not_depend_on_partitioning(spark, orders):
    marked = orders.select("o_orderkey", is_holdout(F.col("o_orderkey")).alias("h"), fold_number(F.col("o_orderkey")).alias("f"))
    again = orders.repartition(7).select("o_orderkey", is_holdout(F.col("o_orderkey")).alias("h"),
                                         fold_number(F.col("o_orderkey")).alias("f"))
    assert marked.exceptAll(again).count() == 0
    assert 0.15 < marked.where("h").count() / marked.count() < 0.25


def staff(spark):
    rows = [(i, i % 2, None if i % 4 == 0 else f"{20 + i % 5}-30", None if i % 5 == 0 else float(i), None,
             "yes" if i % 3 else None) for i in range(60)]
    return spark.createDataFrame(
        rows, "id int, Gender int, `Age Group` string, `Length of Service (Years)` double, nothing double, `left.v` string"
    )


def test_preparation_of_an_awkward_table(spark, tmp_path):
    df = staff(spark)
    df = df.withColumn("target", F.when(F.col("id") % 3 == 0, "no").otherwise(F.col("`left.v`"))).drop("left.v")
    prep = fit_preparation(df, Settings("target", "id", "Classification", evaluate_on="train"))
    assert prep.used == ["Gender", "Age Group", "Length of Service (Years)"]  # the empty column is dropped
    out = prep.apply(df, with_label=True).select("id", vector_to_array("features").alias("x"), "label").collect()
    want = np.mean([float(i) for i in range(60) if i % 5])
    for r in out:
        assert r["x"][1] == -1 if r["id"] % 4 == 0 else r["x"][1] >= 0
        assert r["x"][2] == pytest.approx(want if r["id"] % 5 == 0 else r["id"])
    prep.save(spark, str(tmp_path / "p"))
    again = Preparation.load(spark, str(tmp_path / "p"))
    key = ["id", "features"]
    assert again.apply(df).select(key).exceptAll(prep.apply(df).select(key)).count() == 0
    assert again.contract() == prep.contract()


def test_contract(spark):
    df = staff(spark).withColumn("y", F.col("id") * 1.0)
    prep = fit_preparation(df, Settings("y", "id", "Regression", evaluate_on="train"))
    with pytest.raises(ContractViolation):
        prep.apply(df.drop("Gender"))
    assert prep.check(df)["extra"] == ["id", "y"]


def test_rows_without_a_class_are_left_out_and_counted(spark):
    df = spark.createDataFrame([(i, float(i), None if i % 4 == 0 else i % 2) for i in range(40)], "k int, x double, y int")
    prep = fit_preparation(df, Settings("y", "k", "Classification"))
    assert prep.missing_target == 10 and prep.apply(df, with_label=True).count() == 30


def test_missing_regression_target_takes_the_median(spark):
    df = spark.createDataFrame([(i, float(i), None if i % 4 == 0 else float(i)) for i in range(40)], "k int, x double, y double")
    prep = fit_preparation(df, Settings("y", "k", "Regression"))
    want = float(np.median([i for i in range(40) if i % 4]))
    labels = {r["k"]: r["label"] for r in prep.apply(df, with_label=True).collect()}
    assert prep.missing_target == 10 and all(labels[k] == (want if k % 4 == 0 else k) for k in range(40))


def test_unsuitable_targets(spark):
    one = spark.createDataFrame([(i, 1.0, "a") for i in range(5)], "k int, x double, y string")
    with pytest.raises(UnsuitableTarget):
        fit_preparation(one, Settings("y", "k", "Classification"))
    many = spark.range(3000).select(F.col("id").alias("k"), F.lit(1.0).alias("x"), (F.col("id") * 0.5).alias("y"))
    with pytest.raises(UnsuitableTarget):
        fit_preparation(many, Settings("y", "k", "Classification"))


def test_mixed_column_as_category_or_number(spark):
    df = spark.createDataFrame(
        [(i, "Unit Down" if i % 4 == 0 else str(float(i)), float(i)) for i in range(20)], "k int, m string, y double"
    )
    whole = fit_preparation(df, Settings("y", "k", "Regression", evaluate_on="train"))
    assert whole.kinds["m"] == "category" and whole.sizes["m"].values == 16
    numbers = fit_preparation(df, Settings("y", "k", "Regression", evaluate_on="train", coerce_numeric=("m",)))
    mean = np.mean([i for i in range(20) if i % 4])
    x = {r["k"]: r["x"][0] for r in numbers.apply(df).select("k", vector_to_array("features").alias("x")).collect()}
    assert all(x[k] == pytest.approx(mean if k % 4 == 0 else k) for k in range(20))


def test_draws_are_the_poisson_counts_of_their_places(spark):
    from rowsmith.functions.split import poisson_draw

    means, places = [0.0, 0.5, 4.0, 30.0, None], [0.0, 0.3, 0.97, 1 - 2.0 ** -32, None]
    df = spark.createDataFrame([(m, u) for m in means for u in places] + [(501.0, 0.1)], "m double, u double")
    drawn = df.select("m", "u", poisson_draw(F.col("m"), F.col("u")).alias("n"))
    assert dict(drawn.dtypes)["n"] == "int"
    for m, u, n in drawn.collect():
        if m == 501.0:
            assert n == 501
        elif u is None:
            assert n is None
        else:
            term = upto = math.exp(-(m or 0.0))
            want = 0
            while u >= upto and want < 200:
                want += 1
                term *= (m or 0.0) / want
                upto += term
            assert n == want or want == 200, (m, u)
    # no list of steps is worked through row by row
    assert "aggregate(" not in drawn._jdf.queryExecution().optimizedPlan().toString()
