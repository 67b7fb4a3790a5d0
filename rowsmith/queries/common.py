"""Pieces the registered queries share: table reading and expressions both engines accept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bucket_sql(key: str, buckets: int, seed: int | str = 42) -> str:
    """The row bucket of ``functions.split.key_bucket`` in DuckDB."""
    return f"(('0x' || substr(md5(cast({key} AS VARCHAR) || '|{seed}'), 1, 8))::BIGINT % {buckets})"


def holdout_sql(key: str) -> str:
    """The share of 0.2: whole percents need the coarse bucket only."""
    return f"({bucket_sql(key, 100)} < 20)"


def fold_sql(key: str, folds: int) -> str:
    return bucket_sql(key, folds, "42|fold")


# A number in [0, 1) from the part key, and three classes by size.
NOISE_1 = "(p_partkey * 7919 % 101) / 101e0"
NOISE_2 = "(p_partkey * 104729 % 97) / 97e0"
NOISE_3 = "(p_retailprice - 900e0) / 1000e0"
SIZE_CLASS = "CASE WHEN p_size < 17 THEN 'a' WHEN p_size < 34 THEN 'b' ELSE 'c' END"
# Classes that overlap a little.
NOISY_CLASS = (
    "CASE WHEN p_size + p_partkey % 5 < 17 THEN 'a' WHEN p_size + p_partkey % 7 < 34 THEN 'b' ELSE 'c' END"
)
# Three corners of a square, far apart: every classifier should find them.
CORNERS = {
    "x1": f"CASE WHEN p_size >= 17 AND p_size < 34 THEN 4e0 ELSE 0e0 END + {NOISE_1}",
    "x2": f"CASE WHEN p_size >= 34 THEN 4e0 ELSE 0e0 END + {NOISE_2}",
    "x3": NOISE_3,
}
# A target with a linear part and a little noise, and one without noise.
LINEAR_NOISY = "3e0 * p_size - 0.5e0 * p_retailprice + (p_partkey * 7919 % 101) / 100e0"
LINEAR_EXACT = "3e0 * p_size - 0.5e0 * p_retailprice + 7e0"
# Three levels on one feature with wide gaps. The feature has nine values: fewer than a tree
# learner's bins, so that every cut between values is open to it, and so few that each value
# is in every bootstrap sample.
LEVEL = "CASE WHEN p_size < 17 THEN 10e0 WHEN p_size < 34 THEN 25e0 ELSE 70e0 END"
LEVEL_X = f"CASE WHEN p_size < 17 THEN 0e0 WHEN p_size < 34 THEN 4e0 ELSE 8e0 END + (p_partkey * 7919 % 3) / 3e0"


def part_frame(spark: SparkSession, sf: str, target: str, features: dict[str, str]) -> DataFrame:
    """(p_partkey, features.., target) of the whole part table."""
    return table(spark, sf, "part").select(
        "p_partkey", *[F.expr(e).alias(n) for n, e in features.items()], F.expr(target).alias("target")
    )


PLAIN = {"p_size": "cast(p_size as double)", "p_retailprice": "p_retailprice"}
SIZE_ONLY = {"p_size": "cast(p_size as double)"}
