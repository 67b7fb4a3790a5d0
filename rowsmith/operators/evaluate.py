"""Metrics and ranking.

Predictions come as one long frame ``(model, label, prediction)`` or as one frame per
model; both are reduced to a few rows per model in one aggregation, and everything
else is computed from those rows.
"""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _ratio(top: Column, bottom: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def accuracy(label: Column, prediction: Column) -> Column:
    return F.avg((label == prediction).cast("double"))


def confusion_counts(df: DataFrame, by: list[str] | None = None, label="label", prediction="prediction") -> DataFrame:
    """(by.., label, prediction, n) for the pairs that occur."""
    return df.groupBy(*(by or []), F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_cells(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Every cell of the square matrix over the classes seen as label or prediction, zeros included.

    The cells are spread from an array of classes per model; each looks its count up in a join.
    """
    by = by or []
    classes = F.array_sort(F.array_union(F.collect_set("label"), F.collect_set("prediction")))
    wide = counts.groupBy(*by).agg(classes.alias("_classes"))
    cells = wide.select(*by, "_classes", F.explode("_classes").alias("label")).select(
        *by, "label", F.explode("_classes").alias("prediction")
    )
    known = counts.select(*by, "label", "prediction", F.col("n").alias("_n"))
    return cells.join(known, [*by, "label", "prediction"], "left").select(
        *by, "label", "prediction", F.coalesce("_n", F.lit(0)).cast("bigint").alias("n")
    )


def confusion_matrix(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by.., classes, matrix): rows true, columns predicted, both in class order."""
    by = by or []
    rows = confusion_cells(counts, by).groupBy(*by, "label").agg(
        F.array_sort(F.collect_list(F.struct("prediction", "n"))).alias("r")
    )
    table = rows.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("label", F.col("r")["n"].alias("n")))).alias("m")
    )
    return table.select(*by, F.col("m")["label"].alias("classes"), F.col("m")["n"].alias("matrix"))


def class_scores(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by.., class, precision, recall, f1, support) per class seen as label or prediction."""
    by = by or []
    sides = counts.select(
        *by, "n",
        F.inline(
            F.array(
                F.struct(F.col("label").alias("class"), F.lit(1).alias("true"), F.lit(0).alias("said"),
                         (F.col("label") == F.col("prediction")).cast("int").alias("hit")),
                F.struct(F.col("prediction").alias("class"), F.lit(0).alias("true"), F.lit(1).alias("said"),
                         F.lit(0).alias("hit")),
            )
        ),
    )
    sums = sides.groupBy(*by, "class").agg(
        F.sum(F.col("n") * F.col("true")).alias("support"),
        F.sum(F.col("n") * F.col("said")).alias("predicted"),
        F.sum(F.col("n") * F.col("hit")).alias("hits"),
    )
    precision = _ratio(F.col("hits"), F.col("predicted"))
    recall = _ratio(F.col("hits"), F.col("support"))
    return sums.withColumns({"precision": precision, "recall": recall}).select(
        *by, "class", "precision", "recall",
        _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"),
        F.col("support").cast("bigint").alias("support"), "hits",
    )


def classification_report(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Class rows followed by ``accuracy``, ``macro avg`` and ``weighted avg`` rows, as (entry, ...)."""
    by = by or []
    names = ("precision", "recall", "f1")
    total = F.sum("support")

    def entry(name: str, value) -> Column:
        return F.struct(F.lit(name).alias("entry"), *[value(c).alias(c) for c in names], total.alias("support"))

    # classes are few: their rows travel as one array beside the averages, so the counts are read once
    each = F.collect_list(F.struct(F.col("class").cast("string").alias("entry"), *names, "support"))
    averages = F.array(
        entry("accuracy", lambda c: F.sum("hits") / total),
        entry("macro avg", F.avg),
        entry("weighted avg", lambda c: F.sum(F.col(c) * F.col("support")) / total),
    )
    rows = class_scores(counts, by).groupBy(*by).agg(each.alias("classes"), averages.alias("averages"))
    return rows.select(*by, F.inline(F.concat("classes", "averages")))


def regression_scores(df: DataFrame, by: list[str] | None = None, label="label", prediction="prediction") -> DataFrame:
    """(by.., rmse, mae, r2, n). A constant label gives R2 1 if every prediction is right, else 0."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    sums = df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((y - p) * (y - p)).alias("mse"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.var_pop(y).alias("spread"),
    )
    r2 = F.when(F.col("spread") != 0, 1 - F.col("mse") / F.col("spread")).otherwise(
        F.when(F.col("mse") == 0, 1.0).otherwise(0.0)
    )
    return sums.select(*(by or []), F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"), "n")


def roc_auc(df: DataFrame, label="label", score="probability_1") -> float:
    """Area under the ROC curve of a binary label."""
    frame = df.select(F.col(label).cast("double").alias("l"), F.col(score).cast("double").alias("s"))
    return BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="l", numBins=0).evaluate(frame)


def rank_models(board: DataFrame, metric: str, higher_is_better: bool) -> DataFrame:
    """Leaderboard order: metric, then position in the list of models. One row per model."""
    column = F.col(metric)
    order = column.desc_nulls_last() if higher_is_better else column.asc_nulls_last()
    return board.orderBy(order, "position")


def best_model(board: DataFrame, metric: str, higher_is_better: bool) -> DataFrame:
    """One row: the best model, the first of equals. NULL where no accuracy is above 0."""
    column = F.col(metric)
    usable = column > 0 if higher_is_better else (column < F.lit(float("inf")))
    score = F.when(usable, -column if higher_is_better else column)
    # struct fields compare in turn, so equal scores fall back to position
    return board.agg(
        F.min_by(F.when(usable, F.col("model")), F.when(usable, F.struct(score, F.col("position")))).alias("model_name"),
        F.min_by(column, F.when(usable, F.struct(score, F.col("position")))).alias(f"best_{metric}"),
    )


def add_rank(board: DataFrame, metric: str, higher_is_better: bool) -> DataFrame:
    """The leaderboard with its place numbers; a table of models, so one window is enough."""
    column = F.col(metric)
    order = column.desc_nulls_last() if higher_is_better else column.asc_nulls_last()
    return board.withColumn("rank", F.row_number().over(W.orderBy(order, "position")).cast("bigint"))
