"""Score JSON records as they arrive, against a saved model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.models.base import Fitted
from ..plans.prepare import Preparation
from ..plans.score import score


def record_schema(prep: Preparation, key_type: T.DataType | None = None) -> T.StructType:
    """The contract of the model with the row key in front."""
    return T.StructType([T.StructField(prep.settings.key, key_type or T.LongType()), *prep.contract().fields])


def parse_records(lines: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """Records by the contract; fields a record lacks are NULL. Lines without a key are not records: see ``broken_lines``."""
    rows = lines.select(F.from_json(F.col(column), schema).alias("r")).select("r.*")
    return rows.where(F.col(f"`{schema.fields[0].name}`").isNotNull())


def broken_lines(lines: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """Lines that are no JSON record or have no key, whole."""
    record = F.from_json(F.col(column), schema)
    return lines.where(F.col(column).isNull() | record[schema.fields[0].name].isNull())


def score_lines(
    lines: DataFrame, prep: Preparation, model: Fitted, out: str, rejects: str, checkpoint: str,
    column: str = "value", available_now: bool = True,
) -> StreamingQuery:
    """Score JSON lines as ``score_stream`` does; lines that are no records go to ``rejects/batch=<id>``."""
    schema = record_schema(prep)

    def one_batch(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        score(parse_records(rows, schema, column), prep, model).write.mode("overwrite").parquet(f"{out}/batch={batch}")
        broken_lines(rows, schema, column).write.mode("overwrite").parquet(f"{rejects}/batch={batch}")
        rows.unpersist()

    writer = lines.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def score_stream(
    records: DataFrame, prep: Preparation, model: Fitted, out: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Score each micro-batch into its own folder ``out/batch=<id>``.

    A batch that is run again after a failure overwrites its folder, so every record is
    scored once in the output. Works for all models, joins included.
    """

    def one_batch(rows: DataFrame, batch: int) -> None:
        score(rows, prep, model).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    writer = records.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_scored(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out)
