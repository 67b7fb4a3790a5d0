"""Column profiles and the choice between regression and classification.

Each profile is one aggregation over all columns. Only its one wide row is turned
into long form, never the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import UnsuitableTarget
from ..functions.text import finite_or_null, is_blank, is_number
from .impute import exact_median

NUMERIC, CATEGORICAL, UNKNOWN = "Numeric", "Categorical", "Unknown"
REGRESSION, CLASSIFICATION = "Regression", "Classification"


def _text(name: str) -> Column:
    return F.col(f"`{name}`").cast("string")


def strict_type(name: str) -> Column:
    """``Numeric`` only if every cell, blanks included, spells a number."""
    all_numbers = F.bool_and(F.coalesce(is_number(_text(name)), F.lit(False)))
    return F.when(F.coalesce(all_numbers, F.lit(True)), NUMERIC).otherwise(CATEGORICAL)


def lenient_type(name: str) -> Column:
    """Blanks are ignored; a column of blanks only is ``Unknown``."""
    text = _text(name)
    numbers = F.bool_and(F.when(~is_blank(text), is_number(text)))
    return (
        F.when(numbers.isNull(), UNKNOWN).when(numbers, NUMERIC).otherwise(CATEGORICAL)
    )


def _long_form(df: DataFrame, names: list[str], fields: dict[str, callable]) -> DataFrame:
    per_column = [
        F.struct(F.lit(n).alias("column"), *[make(n).alias(f) for f, make in fields.items()])
        for n in names
    ]
    wide = df.agg(*[c.alias(f"p{i}") for i, c in enumerate(per_column)])
    return wide.select(F.inline(F.array(*[F.col(f"p{i}") for i in range(len(names))])))


def profile_columns(df: DataFrame, names: list[str] | None = None, strict: bool = False) -> DataFrame:
    """(column, data_type, missing_data_count) for text-level cells."""
    detect = strict_type if strict else lenient_type
    return _long_form(
        df,
        names or df.columns,
        {
            "data_type": detect,
            "missing_data_count": lambda n: F.count_if(is_blank(_text(n))),
        },
    )


def analyse_columns(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column, row_count, missing_records) for typed cells; NaN counts as missing."""
    kinds = dict(df.dtypes)

    def missing(name: str) -> Column:
        cell = F.col(f"`{name}`")
        gone = cell.isNull()
        if kinds[name] in ("double", "float"):
            gone = gone | F.isnan(cell)
        return F.count_if(gone)

    return _long_form(
        df, names or df.columns, {"row_count": lambda _: F.count(F.lit(1)), "missing_records": missing}
    )


def task_of_type(data_type: Column) -> Column:
    return F.when(data_type == NUMERIC, REGRESSION).otherwise(CLASSIFICATION)


def infer_task(df: DataFrame, target: str, strict: bool = False, target_type: str | None = None) -> str:
    """Task for one target column; ``target_type`` overrides what the cells say."""
    if target not in df.columns:
        raise UnsuitableTarget(f"no column {target!r}")
    if target_type is None:
        target_type = df.agg((strict_type if strict else lenient_type)(target)).first()[0]
    return REGRESSION if target_type == NUMERIC else CLASSIFICATION


def infer_tasks(df: DataFrame, names: list[str] | None = None, strict: bool = False) -> DataFrame:
    """(column, data_type, task) for every column taken as the target."""
    return profile_columns(df, names, strict).select(
        "column", "data_type", task_of_type(F.col("data_type")).alias("task")
    )


def missing_in_target(df: DataFrame, target: str) -> DataFrame:
    """Missing target cells before the fill with the median, and after it; the median of none is none."""
    cell = F.col(f"`{target}`").cast("double")
    filled = F.coalesce(finite_or_null(cell), F.lit(exact_median(df, target)).cast("double"))
    return df.agg(
        F.count_if(cell.isNull() | F.isnan(cell)).alias("missing_before"), F.count_if(filled.isNull()).alias("missing_after")
    )
