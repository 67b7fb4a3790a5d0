"""A training corpus from ``documents``: five stages, each written as Parquet before the next.

1. language identification: documents without a recognised language go;
2. SimHash near-duplicates: one document of each group stays;
3. substring deduplication: passages that recur are cut out of the texts;
4. benchmark decontamination: documents that hold a benchmark item go;
5. SentencePiece: texts are encoded, and decoded again as a check.

A stage works on all rows its predecessor kept. Stages 1 to 4 return the columns of ``documents``,
the last adds the ids of the pieces. Rows with null or empty texts have no language and go in the
first stage; a text emptied by the third stays, as a row with no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.llm import decontamination, langid, pieces, simhash, substring
from rowsmith.llm.files import written
from rowsmith.llm.learning import remainder
from rowsmith.llm.queries import PIECE_MODEL
from rowsmith.queries.common import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model and its limits are learned from the labelled ones."""
    model = langid.learn(docs.where(remainder("doc_id", 3) != 1), key=F.col("doc_id"), limits=True)
    found = langid.identify(docs, model)
    return found.where(F.col("lang_pred") != langid.UNKNOWN).select(*[f"row.{c}" for c in COLUMNS])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group within 4 bits, by shingles of 4 words."""
    return simhash.keep_one(docs, shingle=4, distance=4, seed=42).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their words under recurring windows of 35; texts without any stay as they are."""
    cut = substring.remove_repeats(docs, window=35, rejoin=False)
    return cut.select("row.doc_id", "text", "row.lang", "row.source", F.char_length("text").cast("bigint").alias("n_chars"))


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than four fifths of the 5-word shingles of every benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"), shingle=5, similarity=0.8).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their pieces, and whether decoding these gives the text back."""
    model = pieces.read_model(PIECE_MODEL)
    back = pieces.encode_and_decode(docs.select(*COLUMNS), model)
    same = F.col("decoded").eqNullSafe(F.translate("row.text", pieces.BLANK, " "))
    return back.select(*[f"row.{c}" for c in COLUMNS], F.col("ids").alias("pieces"), same.alias("round_trip"))


STAGES = [
    ("language identification", language),
    ("simhash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_items),
    ("sentencepiece", tokens),
]

# Fingerprints, trained models and piece ids cannot be written in SQL; the stages are tested
# against brute force on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each returns is written and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
