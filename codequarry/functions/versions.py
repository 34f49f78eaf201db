"""Version numbers as integer arrays, which Spark compares element by element."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def version_key(version: Column) -> Column:
    """Up to three numbers, padded with zeros; null if the text doesn't start with a number.

    Leading range operators are stripped, and what follows the first letter, hyphen or plus is ignored.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(version), r"^[\^~>=<! v]+", ""), r"[A-Za-z+\-].*$", "")
    parts = F.transform(F.slice(F.split(bare, r"\."), 1, 3), lambda p: p.try_cast("int"))
    good = (F.size(parts) > 0) & F.get(parts, F.lit(0)).isNotNull()
    number = [F.coalesce(F.get(parts, F.lit(i)), F.lit(0)) for i in range(3)]
    return F.when(good, F.array(*number))


def is_older(version: Column, than: Column) -> Column:
    """Whether ``version`` comes before ``than``; false if either can't be read."""
    return F.coalesce(version_key(version) < version_key(than), F.lit(False))


def in_affected_range(version: Column, ranges: Column) -> Column:
    """Whether any upper bound ``<X`` in the text lies above the version; lower bounds are ignored."""
    bounds = F.regexp_extract_all(ranges, F.lit(r"<\s*(\d+[\d.]*)"), F.lit(1))
    return F.coalesce(F.exists(bounds, lambda b: version_key(version) < version_key(b)), F.lit(False))
