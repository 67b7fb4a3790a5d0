"""What every model shares: the training frame, sums over rows, and saving.

A fitted model adds ``prediction`` and, where it has one, ``probability`` (an array by
label number) to a frame with a ``features`` vector.
"""

from __future__ import annotations

import importlib
import json
import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ...errors import ModelNotFound, UnsuitableTarget

UNROLLED = 64       # dot products up to this width are written out for code generation
ROWS_PER_TASK = 10_000
DIRECT_PARTS = 64       # arrays of sums the driver adds up directly
GATHER_BYTES = 64 << 20  # and their total size
MAX_SUMS = 1 << 23      # numbers in one array of sums
START_ROWS = 1 << 15    # rows that an iteration over all rows is brought near its end with
START_STEPS = 1 << 30


@dataclass
class Frame:
    """Prepared training rows ``(key, features, label)``; persisted by the caller."""

    df: DataFrame
    key: str = "key"
    n_classes: int = 0
    seed: int = 42
    widest_square: int = 2_000  # widest feature vector whose square matrix is gathered

    @cached_property
    def _size(self) -> tuple[int, int]:
        row = self.df.agg(F.count(F.lit(1)), F.first(F.size(vector_to_array("features")))).first()
        if not row[0]:
            raise UnsuitableTarget("no training rows")
        return row[0], row[1]

    @property
    def rows(self) -> int:
        return self._size[0]

    @property
    def width(self) -> int:
        return self._size[1]

    @cached_property
    def parts(self) -> int:
        return self.df.rdd.getNumPartitions()

    @cached_property
    def arrays(self) -> DataFrame:
        """Rows as ``(x array<double>, y double, h bigint)``; ``h`` is a hash of the key."""
        return self.df.select(
            vector_to_array("features").alias("x"),
            F.col("label").cast("double").alias("y"),
            F.xxhash64(F.col(self.key)).alias("h"),
        )

    @contextmanager
    def start_rows(self) -> Iterator[Frame | None]:
        """About START_ROWS rows by a hash of their keys, to find a point from which the fit over all rows starts;
        None where the table is not much larger or none are found."""
        share = START_ROWS / self.rows
        if share > 0.25:
            yield None
            return
        place = F.pmod(F.xxhash64(F.col(self.key), F.lit("start")), F.lit(START_STEPS))
        cores = self.df.sparkSession.sparkContext.defaultParallelism
        some = self.df.where(place < int(START_STEPS * share)).coalesce(min(cores, self.parts)).persist()
        try:
            yield replace(self, df=some) if some.count() else None
        finally:
            some.unpersist()

    def check_square(self, width: int | None = None) -> None:
        if (width or self.width) > self.widest_square:
            raise UnsuitableTarget(
                f"more than {self.widest_square} features: too wide for a square matrix of sums; see Settings.widest_square"
            )

    @cached_property
    def _summary(self) -> tuple[np.ndarray, np.ndarray]:
        summary = Summarizer.metrics("mean", "variance").summary(F.col("features"))
        row = self.df.agg(summary.alias("s")).first()["s"]
        return row["mean"].toArray(), row["variance"].toArray() * (self.rows - 1) / self.rows

    @property
    def variance(self) -> np.ndarray:
        """Variance per feature, divided by n."""
        return self._summary[1]

    @property
    def moments(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean and standard deviation per feature, 1 for a constant feature."""
        mean, variance = self._summary
        return mean, np.where(variance > 0, np.sqrt(variance), 1.0)


def spread(df: DataFrame, rows: int) -> DataFrame:
    """Use all cores where the source came in few partitions; nothing to do on large tables."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    wanted = min(cores, math.ceil(rows / ROWS_PER_TASK))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arrow batch ``(x, y, h)`` as a matrix and two vectors."""
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    y = batch.column("y").to_numpy(zero_copy_only=False)
    h = batch.column("h").to_numpy(zero_copy_only=False)
    return x, y, h


def _add_up(batches):
    total = None
    for batch in batches:
        for value in batch.column("v"):
            v = np.asarray(value.values.to_numpy(zero_copy_only=False))
            total = v.copy() if total is None else total + v
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["v"])


def sum_over_rows(frame: Frame, part, size: int) -> np.ndarray:
    """Sum of ``part(x, y, h)`` (a flat array of ``size`` numbers) over all batches of rows.

    Each task returns one array; further stages add them up before the driver sees them.
    """

    def each(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(*rows_of(batch))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["v"])

    return _gather(frame, frame.arrays.mapInArrow(each, "v array<double>"), size)


def _gather(frame: Frame, sums: DataFrame, size: int) -> np.ndarray:
    """Add up one array per task. Stages of about the square root of the tasks add them up
    until so few arrays are left that the driver can take them."""
    parts = frame.parts
    direct = max(1, min(DIRECT_PARTS, GATHER_BYTES // (8 * size)))
    while parts > direct:
        parts = max(direct, math.isqrt(parts))
        sums = sums.repartition(parts).mapInArrow(_add_up, "v array<double>")
    total = np.zeros(size)
    for value in sums.toArrow().column("v"):    # not collected as rows, whose numbers are objects of four times their size
        total += value.values.to_numpy(zero_copy_only=False)
    return total


# -- column expressions ---------------------------------------------------------------


def features_array() -> Column:
    return vector_to_array("features")


def dot(x: Column, weights, constant: float = 0.0) -> Column:
    """Linear score of an array column, inside the JVM."""
    w = [float(v) for v in weights]
    if len(w) <= UNROLLED:
        total = F.lit(float(constant))
        for j, v in enumerate(w):
            total = total + F.lit(v) * x[j]
        return total
    products = F.zip_with(x, F.array(*[F.lit(v) for v in w]), lambda a, b: a * b)
    return F.aggregate(products, F.lit(float(constant)), lambda acc, v: acc + v)


def first_max(values: list[Column]) -> Column:
    """Number of the largest value, the first of equals, as a double."""
    return (F.array_position(F.array(*values), F.greatest(*values)) - 1).cast("double")


def softmax(values: list[Column]) -> Column:
    top = F.greatest(*values) if len(values) > 1 else values[0]
    raised = F.transform(F.array(*values), lambda v: F.exp(v - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, v: a + v)
    return F.transform(raised, lambda v: v / total)


def shares(raw: Column) -> Column:
    """Non-negative scores divided by their sum."""
    total = F.aggregate(raw, F.lit(0.0), lambda a, v: a + v)
    return F.when(total > 0, F.transform(raw, lambda v: v / total))


# -- fitted models ----------------------------------------------------------------------


class Fitted:
    """Learned numbers in ``state`` (plain JSON), ML models in ``parts``, tables in ``tables``."""

    def __init__(self, state: dict, parts: dict | None = None, tables: dict | None = None):
        self.state = state
        self.parts = parts or {}
        self.tables = tables or {}

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def save(self, spark: SparkSession, path: str) -> None:
        meta = {
            "class": f"{type(self).__module__}:{type(self).__qualname__}",
            "state": self.state,
            "parts": {n: isinstance(p, Fitted) for n, p in self.parts.items()},
            "tables": sorted(self.tables),
        }
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode(
            "overwrite"
        ).text(f"{path}/meta")
        for name, part in self.parts.items():
            if isinstance(part, Fitted):
                part.save(spark, f"{path}/parts/{name}")
            else:
                part.write().overwrite().save(f"{path}/parts/{name}")
        for name, table in self.tables.items():
            table.write.mode("overwrite").parquet(f"{path}/tables/{name}")


def load_fitted(spark: SparkSession, path: str) -> Fitted:
    try:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise ModelNotFound(path) from error
    module, name = meta["class"].split(":")
    parts = {
        n: load_fitted(spark, f"{path}/parts/{n}")
        if ours
        else DefaultParamsReader.loadParamsInstance(f"{path}/parts/{n}", spark)
        for n, ours in meta["parts"].items()
    }
    tables = {n: spark.read.parquet(f"{path}/tables/{n}") for n in meta["tables"]}
    return getattr(importlib.import_module(module), name)(meta["state"], parts, tables)
