"""Small tables with everything that can be odd about a row."""

import re

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("row", T.StringType()), T.StructField("id", T.LongType()), T.StructField("sig", T.StringType()),
    T.StructField("score", T.DoubleType()), T.StructField("hash.of", T.StringType()),
])
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_table(spark, rows, lang="en"):
    """Rows of (doc_id, text) with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, "s", None, "x", 7, "y", 0.5, "z") for i, t in rows], DOCS)


def words(text):
    return WORD.findall(text or "")


ODD_TEXTS = [(100, None), (101, ""), (102, " \t\n"), (103, "."), (104, "é"), (None, "a text without an id at all"), (105, "\x00 \x00"), (106, "x" * 5000), (103, ".")]
