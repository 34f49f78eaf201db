"""Patches: made for one safe case, and checked by analysing the text before and after."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOADER = r"^(\s*.*)yaml\.load\(([^,)]+)\)(.*)"


def made_patch(rule: Column, snippet: Column) -> Column:
    """The snippet with ``yaml.load(x)`` made safe, for rule PY008 and a call with one argument; else null."""
    return F.when((rule == "PY008") & snippet.rlike(LOADER), F.regexp_replace(snippet, LOADER, "$1yaml.safe_load($2)$3"))


def applied(content: Column, original: Column, replacement: Column) -> Column:
    """``content`` with the first occurrence of ``original`` replaced; null if it isn't there."""
    at = F.position(original, content)
    return F.when(at > 0, F.concat(F.substring(content, F.lit(1), at - 1), replacement, F.substring(content, at + F.length(original), F.length(content))))


def verified(rows: DataFrame, hits: Callable[[Column], Column]) -> DataFrame:
    """Adds ``status`` to rows of ``content, original, replacement``.

    ``hits`` counts the findings in a text as a Column. All gone is ``verified``, fewer ``partially_verified``; no
    fewer, or an original that isn't in the content, ``failed``. Nulls fail.
    """
    after = rows.withColumn("_after", applied(F.col("content"), F.col("original"), F.col("replacement")))
    n0, n1 = hits(F.col("content")), hits(F.col("_after"))
    status = F.when(F.col("_after").isNull() | (n1 >= n0), "failed").when(n1 == 0, "verified").otherwise("partially_verified")
    return after.withColumn("status", F.coalesce(status, F.lit("failed"))).drop("_after")
