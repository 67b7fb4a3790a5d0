"""Reading CSV uploads: as raw text, or typed with an inferred or a stored schema.

Both readers keep the place of each row in its file in the column ``ROW_ORDER`` so
that "first appearance" has a meaning later; drop it when it is not needed.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SourceRejected
from ..functions.text import MISSING_MARKS, clean_header, is_number, missing_to_null, to_number

ROW_ORDER = "_row_order"
CSV_GLOB = "*.[cC][sS][vV]"
END = "\x1eend"  # a cell put behind a row's last, to see where it comes to stand


def is_csv_name(name):
    """Column test: the text after the last dot is ``csv``, in any case."""
    return F.lower(name).rlike(r"\.csv$")


def _reader(spark: SparkSession, multiline: bool):
    """Quotes inside quoted cells are doubled, as the usual writers do."""
    return spark.read.options(escape='"', multiLine=multiline, pathGlobFilter=CSV_GLOB)


def _headers(spark: SparkSession, path: str, multiline: bool) -> tuple[list[str], list[str | None]]:
    """Cleaned column names, and the header cells as they are in the file."""
    try:
        first = _reader(spark, multiline).csv(path).first()
    except AnalysisException as error:
        if "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        first = None
    if first is None:
        raise SourceRejected(f"no .csv file with a header row: {path}")
    names = [clean_header(v or "") or f"Unnamed: {i}" for i, v in enumerate(first)]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise SourceRejected(f"duplicate headers: {twice}")
    return names, list(first)


def read_raw(spark: SparkSession, path: str, multiline: bool = True, trim: bool = True) -> DataFrame:
    """Every cell as text, trimmed unless ``trim`` is off; short rows give NULL cells.

    All files of a folder must have the same header; a file whose header differs fails the read,
    and so does a row with more cells than the header, blank or not. ``multiline`` allows line breaks in quoted
    cells, for which a file is read by one task; turn it off for large files without any, which
    are then read in parts.
    """
    names, header = _headers(spark, path, multiline)
    checked = all(header)  # an unnamed column has nothing to be compared with
    schema = T.StructType([
        T.StructField(h if checked else f"c{i}", T.StringType()) for i, h in enumerate(header)
    ])
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"),
    )
    line = next(n for n in ("_line", "_the_line", "_line_read") if n not in schema.names)
    rows = (
        _reader(spark, multiline).schema(T.StructType([*schema.fields, T.StructField(line, T.StringType())]))
        .options(header=True, enforceSchema=not checked, columnNameOfCorruptRecord=line)
        .csv(path)
    )
    # The reader marks rows whose number of cells is not the header's, short ones too. Those are
    # read again with a last cell more: it is lost behind cells that are too many, blank or not.
    wide = ", ".join(f"c{i} string" for i in range(len(names) + 1))
    ended = F.concat(F.regexp_replace(F.col(line), "[\\r\\n]+$", ""), F.lit(f",{END}"))
    cells = F.from_csv(ended, wide, {"escape": '"'})
    fits = F.exists(F.array(*[cells[f"c{i}"] for i in range(len(names) + 1)]), lambda c: F.coalesce(c.contains(END), F.lit(False)))
    text = F.concat(F.lit(f"a row has more cells than the header of {path}: "), F.col(line))
    checked_cell = lambda c: F.when(F.col(line).isNotNull() & ~fits, F.raise_error(text)).otherwise(c)
    values = [F.col(f"`{f.name}`") for f in schema.fields]
    values = [F.trim(v) for v in values] if trim else values
    return rows.select(*[checked_cell(v).alias(n) for v, n in zip(values, names)], place.alias(ROW_ORDER))


def infer_types(raw: DataFrame, marks: tuple[str, ...] = MISSING_MARKS) -> T.StructType:
    """Type per column from one pass: boolean, bigint, double or string."""
    names = [c for c in raw.columns if c != ROW_ORDER]
    checks = []
    for i, name in enumerate(names):
        cell = missing_to_null(F.col(f"`{name}`"), marks)
        checks += [
            F.count(cell).alias(f"n{i}"),
            F.bool_and(is_number(cell) & ~cell.contains("_")).alias(f"num{i}"),
            F.bool_and(F.when(cell.isNotNull(), cell.rlike(r"^\s*[+-]?\d+\s*$") & F.trim(cell).try_cast("bigint").isNotNull())).alias(f"int{i}"),
            F.bool_and(F.lower(cell).isin("true", "false")).alias(f"bool{i}"),
        ]
    seen = raw.agg(*checks).first()
    fields = []
    for i, name in enumerate(names):
        if seen[f"n{i}"] == 0:
            kind = T.DoubleType()
        elif seen[f"int{i}"]:
            kind = T.LongType()
        elif seen[f"num{i}"]:
            kind = T.DoubleType()
        elif seen[f"bool{i}"]:
            kind = T.BooleanType()
        else:
            kind = T.StringType()
        fields.append(T.StructField(name, kind))
    return T.StructType(fields)


def apply_types(raw: DataFrame, schema: T.StructType, marks: tuple[str, ...] = MISSING_MARKS) -> DataFrame:
    """Cast raw text to ``schema``; missing marks become NULL, and so does NaN."""
    columns = []
    for field in schema.fields:
        cell = missing_to_null(F.col(f"`{field.name}`"), marks)
        if isinstance(field.dataType, T.DoubleType):
            value = to_number(cell)
            cell = F.when(~F.isnan(value), value)
        elif not isinstance(field.dataType, T.StringType):
            cell = F.trim(cell).try_cast(field.dataType)
        columns.append(cell.alias(field.name))
    extra = [ROW_ORDER] if ROW_ORDER in raw.columns else []
    return raw.select(*columns, *extra)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, multiline: bool = True) -> DataFrame:
    """Typed read; blanks around text are kept. A stored ``schema`` (a contract) saves the inference pass."""
    raw = read_raw(spark, path, multiline, trim=False)
    return apply_types(raw, schema or infer_types(raw))


def clean_headers(df: DataFrame) -> DataFrame:
    """Any table with cleaned column names."""
    names = [clean_header(c) for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise SourceRejected(f"duplicate headers: {twice}")
    return df.toDF(*names)
