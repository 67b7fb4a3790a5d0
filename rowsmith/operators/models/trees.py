"""Models on MLlib's distributed learners: logistic regression, boosted regression trees."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.split import key_bucket, poisson_draw
from ...session import cut_lineage, use_shared_folder
from .base import Fitted, Frame

CHECKPOINT_ROUNDS = 10
DRAW_STEPS = 1 << 31    # as many places a draw can fall on


class MlModel(Fitted):
    """A model of MLlib; its probability vector becomes an array."""

    def transform(self, df: DataFrame) -> DataFrame:
        keep = df.columns
        out = self.parts["model"].transform(df)
        if "probability" in out.columns:
            return out.select(*keep, "prediction", vector_to_array("probability").alias("probability"))
        return out.select(*keep, "prediction")


def _fit(estimator, frame: Frame) -> MlModel:
    return MlModel({}, {"model": estimator.fit(frame.df)})


# -- single models ------------------------------------------------------------------------


def logistic_regression(frame: Frame, cost: float = 1.0) -> MlModel:
    """L2 penalty with the mean loss weighted by ``cost * rows``; softmax for 3+ classes."""
    return _fit(
        LogisticRegression(
            regParam=1.0 / (cost * frame.rows), elasticNetParam=0.0, standardization=False, maxIter=100,
            family="multinomial" if frame.n_classes > 2 else "binomial",
        ),
        frame,
    )


# -- gradient boosting -----------------------------------------------------------------------


def gradient_boosting_regressor(frame: Frame, rounds: int = 100) -> MlModel:
    use_shared_folder(frame.df.sparkSession)
    return _fit(
        GBTRegressor(maxIter=rounds, maxDepth=3, stepSize=0.1, maxBins=128, seed=frame.seed,
                     checkpointInterval=CHECKPOINT_ROUNDS),
        frame,
    )


# -- adaptive boosting -------------------------------------------------------------------------


class WeightedMedian(Fitted):
    """The member prediction at half of the total member weight."""

    def transform(self, df: DataFrame) -> DataFrame:
        keep = df.columns
        said = []
        for m, weight in enumerate(self.state["weights"]):
            df = self.parts[f"member{m}"].transform(df).withColumnRenamed("prediction", f"_m{m}")
            said.append(F.struct(F.col(f"_m{m}").alias("p"), F.lit(float(weight)).alias("w")))
        half = 0.5 * float(sum(self.state["weights"]))
        empty = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("answer"))

        def step(a, v):
            total = a["sum"] + v["w"]
            hit = a["answer"].isNull() & (total >= half)
            return F.struct(total.alias("sum"), F.when(hit, v["p"]).otherwise(a["answer"]).alias("answer"))

        middle = F.aggregate(F.array_sort(F.array(*said)), empty, step, lambda a: a["answer"])
        return df.select(*keep, middle.alias("prediction"))


def ada_boost_regressor(frame: Frame, rounds: int = 50, depth: int = 3) -> WeightedMedian:
    """AdaBoost.R2 (Drucker 1997) with linear loss. Each round's tree learns from a weighted sample with
    replacement; a row's place in it depends on its key, the round and its weight alone. A round keeps its rows
    and its sample until the next has its own, so that no round works through the ones before it again."""
    kept: list[DataFrame] = []

    def keep(rows: DataFrame) -> DataFrame:
        kept.append(rows.persist(StorageLevel.MEMORY_AND_DISK))
        return rows

    try:
        return _ada_boost_rounds(frame, rounds, depth, keep, kept)
    finally:
        for rows in kept:
            rows.unpersist()


def _ada_boost_rounds(frame: Frame, rounds: int, depth: int, keep, kept: list[DataFrame]) -> WeightedMedian:
    df = frame.df.select("features", "label", F.col(frame.key).alias("_key")).withColumn("_w", F.lit(1.0))
    members, weights, total = [], [], float(frame.rows)
    for r in range(rounds):
        u = (key_bucket(F.col("_key"), DRAW_STEPS, f"{frame.seed}|draw|{r}") + 0.5) / DRAW_STEPS
        drawn = keep(df.withColumn("_n", poisson_draw(F.col("_w") * (frame.rows / total), u).cast("double")).where("_n > 0"))
        if not drawn.count():     # possible where rows are few
            drawn = df.withColumn("_n", F.col("_w"))
        tree = DecisionTreeRegressor(maxDepth=depth, maxBins=128, weightCol="_n", seed=frame.seed).fit(drawn)
        told = keep(tree.transform(df).select(
            "features", "label", "_key", "_w", F.abs(F.col("prediction") - F.col("label")).alias("_gap")
        ))
        row = told.agg(F.sum("_w"), F.sum(F.col("_w") * F.col("_gap")), F.max("_gap")).first()
        while len(kept) > 1:    # the rows told are complete now
            kept.pop(0).unpersist()
        worst = row[2]
        error = row[1] / (row[0] * worst) if worst > 0 else 0.0
        if error <= 0:
            members.append(tree)
            weights.append(1.0)
            break
        if error >= 0.5:
            if not members:
                members.append(tree)
                weights.append(1.0)
            break
        beta = error / (1 - error)
        members.append(tree)
        weights.append(math.log(1 / beta))
        df = told.select(
            "features", "label", "_key",
            (F.col("_w") * F.pow(F.lit(beta), 1 - F.col("_gap") / F.lit(worst))).alias("_w"),
        )
        total = df.agg(F.sum("_w")).first()[0]
        if (r + 1) % CHECKPOINT_ROUNDS == 0 and r + 1 < rounds:
            df = cut_lineage(df)
    return WeightedMedian({"weights": weights}, {f"member{m}": t for m, t in enumerate(members)})
