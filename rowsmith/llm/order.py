"""Places of rows in the order of their group, and sums over what stands before them.

Groups may be few and huge: a group is spread over as many tasks as its rows fill, and only
one line per task and group is added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .files import written

FEW = 100_000   # lines looked up by broadcast; more are joined


def numbered(df: DataFrame, group: str, order: list[str], amount: str | None = None) -> DataFrame:
    """``df`` with its rows' places in their group, ordered by the columns ``order``.

    Adds ``position`` (from 0), ``group_rows``, and for a column ``amount`` of whole numbers
    ``before`` (its sum over earlier rows) and ``group_amount``. ``group`` and ``amount`` hold no nulls; in
    ``order`` nulls come first, and rows equal in all of it must be equal in every way that
    matters. ``df`` is read twice, so it should be a written table. No rows give no rows.
    """
    ranged = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, total = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.num_rows
            sizes = batch.column(batch.schema.get_field_index(amount)).to_numpy(zero_copy_only=False).astype(np.int64) if amount else np.zeros(n, np.int64)
            upto = total + np.cumsum(sizes)
            more = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), pa.array(upto - sizes)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], schema=batch.schema.append(pa.field("part", pa.int32())).append(pa.field("place", pa.int64())).append(pa.field("upto", pa.int64())))
            at, total = at + n, int(upto[-1]) if n else total

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    rows = written(ranged.mapInArrow(count, f"{schema}, part int, place bigint, upto bigint"), "ranged")
    sums = F.sum(amount).cast("bigint") if amount else F.lit(0).cast("bigint")
    parts = rows.groupBy(group, "part").agg(F.min("place").alias("first"), F.min("upto").alias("first_upto"), F.count(F.lit(1)).alias("n"), sums.alias("amounts"))
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    nought = F.lit(0).cast("bigint")
    parts = written(
        parts.select(
            F.col(group), "part", (F.coalesce(F.sum("n").over(earlier), nought) - F.col("first")).alias("shift"),
            (F.coalesce(F.sum("amounts").over(earlier), nought) - F.col("first_upto")).alias("shift_upto"),
            F.sum("n").over(whole).alias("group_rows"), F.sum("amounts").over(whole).alias("group_amount"),
        ), "parts",
    )
    few = parts.limit(FEW + 1).count() <= FEW
    found = rows.join(F.broadcast(parts) if few else parts, [group, "part"])
    kept = [F.col(f"`{c}`") for c in df.columns]
    place = [(F.col("place") + F.col("shift")).alias("position"), F.col("group_rows")]
    if amount:
        place += [(F.col("upto") + F.col("shift_upto")).alias("before"), F.col("group_amount")]
    return found.select(*kept, *place)
