"""String and truth-value helpers that follow the semantics of the audit rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every line end that splits a text into lines.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def blank_to_null(c: Column) -> Column:
    """Empty text counts as missing."""
    return F.nullif(c, F.lit(""))


def zero_to_null(c: Column) -> Column:
    """Zero counts as missing."""
    return F.nullif(c, F.lit(0))


def split_lines(text: Column) -> Column:
    """The lines of a text; a last empty piece is no line, an empty text has none."""
    pieces = F.split(text, LINE_END, -1)
    return F.when(F.get(pieces, F.size(pieces) - 1) == "", F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)


def forward_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))
