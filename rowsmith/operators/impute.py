"""Means for missing features, the median for a missing regression target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import finite_or_null

EXACT_ROWS = 200_000  # rows of the last bracket sorted to read off the middle


def column_means(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Mean of each column over its present cells; None for a column without any."""
    if not columns:
        return {}
    row = df.agg(
        *[F.avg(finite_or_null(F.col(f"`{c}`"))).alias(f"m{i}") for i, c in enumerate(columns)]
    ).first()
    return {c: row[i] for i, c in enumerate(columns)}


def fill_means(df: DataFrame, means: dict[str, float | None]) -> DataFrame:
    """Columns as doubles with their mean in missing cells; columns without a mean are dropped."""
    filled = {
        c: F.coalesce(finite_or_null(F.col(f"`{c}`")), F.lit(float(m))) for c, m in means.items() if m is not None
    }
    return df.withColumns(filled).drop(*[c for c, m in means.items() if m is None])


def fill_batch_means(df: DataFrame, columns: list[str]) -> DataFrame:
    """The means of the batch itself, not those of the training rows."""
    return fill_means(df, column_means(df, columns))


def exact_median(df: DataFrame, column: str, exact_rows: int = EXACT_ROWS) -> float | None:
    """Exact median (mean of the middle two for an even count) without sorting all rows.

    Approximate quantiles bracket the middle, a count below the bracket keeps the rank
    exact, and the bracket shrinks until its rows are few enough to be sorted.
    """
    values = df.select(finite_or_null(F.col(f"`{column}`")).alias("v")).where("v is not null")
    n = values.count()
    if n == 0:
        return None
    low_rank, high_rank = (n - 1) // 2, n // 2  # from zero, within the current bracket

    def bracketed(count: int, lo_rank: int, hi_rank: int) -> list[float]:
        slack = 0.001
        at = [max(0.0, lo_rank / count - slack), min(1.0, (hi_rank + 1) / count + slack)]
        return values.approxQuantile("v", at, slack / 4)

    count = n
    while count > exact_rows:
        low, high = bracketed(count, low_rank, high_rank)
        stats = values.agg(
            F.count_if(F.col("v") < low).alias("below"),
            F.count_if(F.col("v").between(low, high)).alias("inside"),
        ).first()
        below, inside = stats["below"], stats["inside"]
        if not (below <= low_rank and high_rank < below + inside):
            break  # the bracket missed the middle: fall through to counting by value
        low_rank, high_rank = low_rank - below, high_rank - below
        if low == high:
            return low
        if inside == count:
            break
        values, count = values.where(F.col("v").between(low, high)), inside
    if count > exact_rows:
        return _median_by_value(values, low_rank, high_rank)
    middle = [r["v"] for r in values.orderBy("v").limit(high_rank + 1).tail(high_rank - low_rank + 1)]
    return (middle[0] + middle[-1]) / 2


def _median_by_value(values: DataFrame, low_rank: int, high_rank: int) -> float:
    """Rank by bisection on the value: each step is one count over the rows."""

    def value_at(rank: int) -> float:
        low, high = values.agg(F.min("v"), F.max("v")).first()
        while low < high:
            mid = low + (high - low) / 2
            below, next_up, at_most = values.agg(
                F.count_if(F.col("v") <= mid),
                F.min(F.when(F.col("v") > mid, F.col("v"))),
                F.max(F.when(F.col("v") <= mid, F.col("v"))),
            ).first()
            if rank < below:
                high = at_most
            else:
                low = next_up
        return low

    low = value_at(low_rank)
    high = low if high_rank == low_rank else value_at(high_rank)
    return (low + high) / 2


def fill_median(df: DataFrame, column: str) -> tuple[DataFrame, float | None, int]:
    """Fill missing cells of a numeric target; returns the frame, the median and the count filled."""
    cell = finite_or_null(F.col(f"`{column}`"))
    missing = df.where(cell.isNull()).count()
    if not missing:
        return df.withColumn(column, cell), None, 0
    median = exact_median(df, column)
    return df.withColumn(column, F.coalesce(cell, F.lit(median))), median, missing
