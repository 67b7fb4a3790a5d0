"""Writing results: landed uploads, appended result tables, JSON records and CSV downloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.display import stamp


def land_upload(df: DataFrame, base: str, user: str, model: str, ts=None) -> None:
    """Append rows to the landing table under user / model / time stamp."""
    (
        df.withColumns(
            {
                "user": F.lit(user),
                "model": F.lit(model),
                "ts": stamp(ts if ts is not None else F.current_timestamp()),
            }
        )
        .write.mode("append")
        .partitionBy("user", "model", "ts")
        .parquet(base)
    )


def append_rows(df: DataFrame, path: str) -> None:
    """Append to a result table; columns may be added later (see ``read_appended``)."""
    df.write.mode("append").parquet(path)


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """All appended rows; rows written before a column existed show NULL there."""
    return spark.read.option("mergeSchema", True).parquet(path)


def stack_results(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows above new rows, matched by column name."""
    return old.unionByName(new, allowMissingColumns=True)


def as_records(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One JSON text per row in the column ``record``, NULL fields included."""
    return df.select(
        *(keep or []), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record")
    )


def download_csv(df: DataFrame, path: str) -> None:
    """Result rows as CSV files with a header, quotes doubled; nested columns as JSON text."""
    flat = [
        F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(f"`{c}`")
        for c, t in df.dtypes
    ]
    df.select(*flat).write.mode("overwrite").options(header=True, escape='"').csv(path)
