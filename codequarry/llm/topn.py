"""Top N items within every group, with a fixed order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Subgroups that each group is hashed into before its items are ranked.
SALTS = 16


def top_n_per_group(rows: DataFrame, group: str, item: str, order: Sequence[Column], n: int = 10, salts: int = SALTS) -> DataFrame:
    """``group, item, rank_no``: the ``n`` first distinct items of every group by ``order``, then by item.

    ``order`` are ascending sort keys without nulls. Rows with a null group or item are left out; an item that
    occurs in several rows of a group counts once, by its best row. Groups smaller than ``n`` come out whole,
    empty input gives no rows.

    Items are hashed into ``salts`` subgroups of their group. Repeats fold before the first shuffle, whose key
    holds the item and so spreads a hot group; each subgroup then keeps ``n`` (Spark applies the limit before
    the exchange, too) and the at most ``n * salts`` survivors of a group are ranked together.
    """
    keys = [f"_k{i}" for i in range(len(order))]
    slim = rows.select(F.col(group).alias("_g"), F.col(item).alias("_i"), *[c.alias(k) for c, k in zip(order, keys, strict=True)])
    items = (
        slim.where(F.col("_g").isNotNull() & F.col("_i").isNotNull())
        .groupBy("_g", "_i")
        .agg(F.min(F.struct(*keys)).alias("_k"))
        .withColumn("_salt", F.pmod(F.xxhash64("_i"), F.lit(salts)))
    )
    subgroup = Window.partitionBy("_g", "_salt").orderBy("_k", "_i")
    survivors = items.withColumn("_r", F.row_number().over(subgroup)).where(F.col("_r") <= n).drop("_r")
    whole = Window.partitionBy("_g").orderBy("_k", "_i")
    return (
        survivors.withColumn("rank_no", F.row_number().over(whole))
        .where(F.col("rank_no") <= n)
        .select(F.col("_g").alias(group), F.col("_i").alias(item), "rank_no")
    )


def severity_order(severity: Column) -> Column:
    """0 critical, 1 high, 2 medium, 3 low, 4 for info and anything else, null included."""
    s = F.lower(F.trim(severity))
    return F.when(s == "critical", 0).when(s == "high", 1).when(s == "medium", 2).when(s == "low", 3).otherwise(4)


def top_findings(findings: DataFrame, n: int = 10) -> DataFrame:
    """``scan_id, finding_id, rank_no``: the ``n`` findings of each scan ranked by severity, confidence (null is 0) and id."""
    order = [severity_order(F.col("severity")), -F.coalesce("confidence", F.lit(0))]
    return top_n_per_group(findings, "scan_id", "id", order, n).withColumnRenamed("id", "finding_id")
