"""Previews, pages and result rows as a person sees them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut_lineage

PREVIEW_ROWS = 4
PAGE_ROWS = 5


def preview(df: DataFrame, order_by: list[str], rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows by an order key: a distributed top-k, not a sort of the table."""
    return df.orderBy(*order_by).limit(rows)


def page(df: DataFrame, order_by: list[str], number: int, rows: int = PAGE_ROWS) -> DataFrame:
    """One page, counted from 1. Rows up to the page's end are a top-k over the table."""
    if number < 1:
        raise ValueError("pages are counted from 1")
    return df.orderBy(*order_by).offset((number - 1) * rows).limit(rows)


def page_count(df: DataFrame, rows: int = PAGE_ROWS) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("bigint").alias("pages"),
    )


def number_pages(df: DataFrame, order_by: list[str], rows: int = PAGE_ROWS) -> DataFrame:
    """Every row with its page number.

    The table is range-partitioned by the order key and written out; a row's number is
    its place in its range plus the sizes of the ranges before it, so no task holds
    more than one range.
    """
    ranged = cut_lineage(
        df.repartitionByRange(*order_by).withColumn("_part", F.spark_partition_id())
    )
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # one row per range: bounded by the number of shuffle partitions
    offsets = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    place = F.row_number().over(W.partitionBy("_part").orderBy(*order_by))
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn("row_number", (F.col("_offset") + place).cast("bigint"))
        .withColumn("page", F.ceil(F.col("row_number") / F.lit(rows)).cast("bigint"))
        .drop("_part", "_offset")
    )


def result_rows(df: DataFrame, keep: list[str]) -> DataFrame:
    """Prediction beside probability; a missing probability shows as 0."""
    probability = F.col("probability_1") if "probability_1" in df.columns else F.lit(None)
    return df.select(
        *keep, "prediction", F.coalesce(probability.cast("double"), F.lit(0.0)).alias("probability")
    )
