"""Column expressions over text: numbers, blanks, missing marks and header names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings a float parser accepts (digits with single underscores, optional
# fraction and exponent, or a signed inf / infinity / nan), matched without regard to case.
NUMBER_PATTERN = (
    r"(?i)^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
    r"|^[+-]?(inf|infinity|nan)$"
)

# Cell texts read as missing by the usual CSV reader.
MISSING_MARKS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null",
)


def is_number(text: Column) -> Column:
    """True where the trimmed text spells a number; NULL where the text is NULL."""
    return F.trim(text).rlike(NUMBER_PATTERN)


def is_blank(text: Column) -> Column:
    """True for NULL and for text that is empty after trimming."""
    return text.isNull() | (F.trim(text) == "")


def to_number(text: Column) -> Column:
    """Double value of a numeric spelling, NULL for anything else."""
    plain = F.regexp_replace(F.trim(text), "_", "")
    return F.when(is_number(text), plain.try_cast("double"))


def missing_to_null(text: Column, marks: tuple[str, ...] = MISSING_MARKS) -> Column:
    return F.when(~F.trim(text).isin(*marks), text)


def finite_or_null(value: Column) -> Column:
    """Double value with NaN read as missing."""
    number = value.cast("double")
    return F.when(~F.isnan(number), number)


def clean_header(name: str) -> str:
    """Header without outer white space and without line breaks."""
    return re.sub(r"\r\n", "", name.strip())
