"""What the trained operators share: which rows they learn from, and sums over all of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_STEPS = 1 << 30


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(modulus))


def about(df: DataFrame, key: Column, rows: int, of: Column | None = None, most: int | None = None) -> DataFrame:
    """About ``rows`` rows of ``df`` chosen by a hash of ``key``, or all if there are no more.

    With ``of``, about ``rows`` are chosen for each of its values, but about ``most`` in all; the
    values are those of a label, few enough to be listed.
    """
    place = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(SAMPLE_STEPS))
    if of is None:
        total = df.count()
        return df if total <= rows else df.where(place < int(SAMPLE_STEPS * rows / total))
    counts = df.groupBy(of.alias("v")).agg(F.count(F.lit(1)).alias("n")).collect()
    rows = rows if most is None else min(rows, most // max(len(counts), 1))
    allowed = F.lit(False)
    for r in counts:
        share = SAMPLE_STEPS if r["n"] <= rows else int(SAMPLE_STEPS * rows / r["n"])
        allowed = allowed | ((of == F.lit(r["v"])) & (place < share))
    return df.where(allowed)


def total_over_rows(df: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """Sum of ``part(batch)`` (``size`` numbers) over all rows; a task gives out one array."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += part(batch)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["place", "value"])

    sums = df.mapInArrow(each, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size)
    out[sums.column("place").to_numpy()] = sums.column("value").to_numpy()
    return out
