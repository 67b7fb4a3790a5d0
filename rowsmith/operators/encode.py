"""Integer codes for categories by order of first appearance.

The mapping is a table ``(column, value, code, rows)``: fitted once on training rows,
kept with the model, joined to whatever is scored later. Missing and unseen values
take the code -1.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut_lineage

MISSING_CODE = -1
WINDOW_VALUES = 1_000_000   # distinct values of one column numbered by a plain window
BROADCAST_VALUES = 100_000  # entries of one column's mapping that may be broadcast
BROADCAST_BYTES = 32 << 20  # and their text size
HOT_VALUES = 1_000          # frequent values looked up by broadcast beyond that
HOT_BYTES = 16 << 10        # and the longest text among them


def text_columns(df: DataFrame) -> list[str]:
    """Columns that are encoded: text, and dates or times, which are taken as text."""
    return [c for c, t in df.dtypes if t in ("string", "date") or t.startswith("timestamp")]


def place_of(order_by: list[str]) -> Column:
    """Order of rows as one value. A single number or time stays as it is: its minimum is kept in
    a hash aggregation, while a struct would have all rows sorted first."""
    columns = [F.col(f"`{c}`") for c in order_by]
    return columns[0] if len(columns) == 1 else F.struct(*columns)


def _first_seen(df: DataFrame, columns: list[str], order_by: list[str]) -> DataFrame:
    """(column, value, first, rows) for each distinct value, combined on the map side."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"))
            for c in columns
        ]
    )
    long = df.select(place_of(order_by).alias("place"), F.inline(cells)).where(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(
        F.min("place").alias("first"), F.count(F.lit(1)).alias("rows")
    )


def _number_by_window(values: DataFrame) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("column").orderBy("first", "value")) - 1
    return values.select("column", "value", rank.cast("bigint").alias("code"), "rows")


def _number_by_range(values: DataFrame) -> DataFrame:
    """The same numbers for columns with too many distinct values for one task.

    Values are range-partitioned in numbering order and written out, so that the
    ranges are fixed; a value's number is its place in its range plus the size of
    the ranges before it.
    """
    ranged = cut_lineage(
        values.repartitionByRange("column", "first", "value")
        .withColumn("part", F.spark_partition_id())
    )
    before = W.partitionBy("column").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranged.groupBy("column", "part").agg(F.count(F.lit(1)).alias("n")).select(
        "column", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    place = F.row_number().over(W.partitionBy("column", "part").orderBy("first", "value")) - 1
    # one row per column and range: bounded by columns x shuffle partitions
    return ranged.join(F.broadcast(offsets), ["column", "part"]).select(
        "column", "value", (F.col("offset") + place).cast("bigint").alias("code"), "rows"
    )


def category_codes(
    df: DataFrame,
    columns: list[str],
    order_by: list[str],
    window_values: int = WINDOW_VALUES,
    sizes: dict[str, int] | None = None,
) -> DataFrame:
    """Fit the mapping table. ``sizes`` may bring (approximate) distinct counts from an earlier pass."""
    if sizes is None:
        counts = df.agg(
            *[F.approx_count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(columns)]
        ).first()
        sizes = {c: counts[i] for i, c in enumerate(columns)}
    narrow = [c for c in columns if sizes[c] <= window_values]
    wide = [c for c in columns if sizes[c] > window_values]
    parts = []
    if narrow:
        parts.append(_number_by_window(_first_seen(df, narrow, order_by)))
    if wide:
        parts.append(_number_by_range(_first_seen(df, wide, order_by)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@dataclass(frozen=True)
class MapSize:
    values: int
    bytes: int

    @property
    def small(self) -> bool:
        return self.values <= BROADCAST_VALUES and self.bytes <= BROADCAST_BYTES


def map_sizes(codes: DataFrame) -> dict[str, MapSize]:
    """Exact size of each column's mapping: one row per column."""
    rows = codes.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value") + 16).alias("b")
    ).collect()
    return {r["column"]: MapSize(r["n"], r["b"]) for r in rows}


def _looked_up(df: DataFrame, text: Column, entries: DataFrame) -> DataFrame:
    """``df`` with ``_found``, the ``answer`` of the row's ``text`` among entries (asked, answer, rows) too many to broadcast.

    The most frequent values go in a broadcast of at most ``HOT_VALUES`` entries. Rows
    they answer, and rows without a value, carry a spread-out key that matches nothing,
    so no partition of the shuffle join receives a hot key.
    """
    # only values that hold at least 1/HOT_VALUES of the rows qualify: HOT_VALUES at most
    total = entries.agg(F.sum("rows")).first()[0] or 0
    short = (F.octet_length("asked") <= HOT_BYTES) & (F.octet_length(F.col("answer").cast("string")) <= HOT_BYTES)
    hot = entries.where((F.col("rows") * HOT_VALUES >= max(total, 1)) & short).select(
        F.col("asked").alias("_hv"), F.col("answer").alias("_hc")
    )
    cold = entries.select(F.col("asked").alias("_cv"), F.col("answer").alias("_cc"))
    spread = F.concat(F.lit("\u0000"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("string"))
    return (
        df.join(F.broadcast(hot), text == F.col("_hv"), "left")
        .withColumn("_key", F.when(F.col("_hc").isNotNull() | text.isNull(), spread).otherwise(text))
        .join(cold, F.col("_key") == F.col("_cv"), "left")
        .withColumn("_found", F.coalesce("_hc", "_cc"))
        .drop("_hv", "_hc", "_key", "_cv", "_cc")
    )


def encode(
    df: DataFrame,
    codes: DataFrame,
    columns: list[str],
    sizes: dict[str, MapSize],
    names: dict[str, str] | None = None,
) -> DataFrame:
    """Add the code of each column under ``names[column]`` (default ``<column>_code``)."""
    for i, column in enumerate(columns):
        out = (names or {}).get(column, f"{column}_code")
        if column not in sizes:  # nothing but missing values was seen in training
            df = df.withColumn(out, F.lit(MISSING_CODE).cast("bigint"))
            continue
        entries = codes.where(F.col("column") == column).select("value", "code", "rows")
        if sizes[column].small:
            small = entries.select(F.col("value").alias(f"_v{i}"), F.col("code").alias(f"_c{i}"))
            df = (
                df.join(F.broadcast(small), F.col(f"`{column}`").cast("string") == F.col(f"_v{i}"), "left")
                .withColumn(out, F.coalesce(F.col(f"_c{i}"), F.lit(MISSING_CODE)).cast("bigint"))
                .drop(f"_v{i}", f"_c{i}")
            )
        else:
            asked = entries.select(F.col("value").alias("asked"), F.col("code").alias("answer"), "rows")
            df = _looked_up(df, F.col(f"`{column}`").cast("string"), asked)
            df = df.withColumn(out, F.coalesce("_found", F.lit(MISSING_CODE)).cast("bigint")).drop("_found")
    return df


def decode(df: DataFrame, codes: DataFrame, column: str, code: Column, out: str, size: MapSize) -> DataFrame:
    """Original value of a code; -1 and codes never given are NULL."""
    entries = codes.where(F.col("column") == column)
    number = code.cast("bigint")
    if size.small:
        few = entries.select(F.col("code").alias("_dc"), F.col("value").alias(out))
        return df.join(F.broadcast(few), number == F.col("_dc"), "left").drop("_dc")
    asked = entries.select(F.col("code").cast("string").alias("asked"), F.col("value").alias("answer"), "rows")
    given = F.when(number != MISSING_CODE, number.cast("string"))
    return _looked_up(df, given, asked).withColumnRenamed("_found", out)
