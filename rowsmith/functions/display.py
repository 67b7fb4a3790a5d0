"""Expressions for values shown to people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two time stamp formats.
STAMP_FORMAT = "yyyyMMddHHmmss"
READABLE_FORMAT = "yyyy-MM-dd HH:mm:ss"


def stamp(ts: Column) -> Column:
    return F.date_format(ts, STAMP_FORMAT)


def readable(ts: Column) -> Column:
    return F.date_format(ts, READABLE_FORMAT)


def headline(accuracy: Column, rmse: Column, rmse_digits: int = 2) -> Column:
    """RMSE where there is one, else accuracy in percent with two decimals, else ``N/A``."""
    return (
        F.when(rmse.isNotNull(), F.format_string(f"%.{rmse_digits}f", F.round(rmse, rmse_digits)))
        .when(accuracy.isNotNull(), F.format_string("%.2f", F.round(accuracy * 100, 2)))
        .otherwise(F.lit("N/A"))
    )
