"""Files and tables in the shared folder; tasks open files through the folder's own file system."""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import DataFrame

from ..session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a compressed table in the shared folder, read back: its lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or absolute path, and the path in it."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)
