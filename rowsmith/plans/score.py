"""Score new rows with a fitted preparation and model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ContractViolation
from ..operators.models.base import Fitted
from ..operators.profile import CLASSIFICATION
from .prepare import Preparation


def score(
    df: DataFrame, prep: Preparation, model: Fitted, keep: list[str] | None = None, impute: str = "train"
) -> DataFrame:
    """(key, keep.., prediction, ...) for every row of ``df``.

    Classification adds ``prediction_label`` (the class itself), ``probability`` (all classes),
    ``probability_1`` (class number 1) and ``confidence`` (the largest), NULL for models without
    probabilities.
    """
    key = prep.settings.key
    if key not in df.columns:
        raise ContractViolation(f"scoring needs the row key {key!r}")
    keep = keep or []
    out = model.transform(prep.apply(df, impute=impute, keep=keep))
    if prep.settings.task != CLASSIFICATION:
        return out.select(key, *keep, "prediction")
    has = "probability" in out.columns
    probability = F.col("probability") if has else F.lit(None).cast("array<double>")
    return out.select(
        key, *keep, "prediction",
        prep.class_of(F.col("prediction")).alias("prediction_label"),
        F.get(probability, F.lit(1)).alias("probability_1"),
        F.array_max(probability).alias("confidence"),
        probability.alias("probability"),
    )
