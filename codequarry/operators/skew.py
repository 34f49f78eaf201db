"""Joins on keys of which one may hold a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that every key of the large side is split into.
SALTS = 16


def join_hot(large: DataFrame, small: DataFrame, key: str, spread: str | Sequence[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``large`` joined with ``small`` on ``key``, each key's rows of ``large`` hashed by ``spread`` into ``salts`` parts.

    ``small`` is copied once for each part, so it should be the side with few rows a key. ``how`` is ``inner`` or
    ``left``. Null keys match nothing. Where Spark knows ``small`` to be small it broadcasts it as always.
    """
    spread = [spread] if isinstance(spread, str) else list(spread)
    parts = F.sequence(F.lit(0), F.lit(salts - 1))
    salted = large.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    return salted.join(small.withColumn("_salt", F.explode(parts)), [key, "_salt"], how).drop("_salt")
