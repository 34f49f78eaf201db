"""Parquet tables of the audit platform."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` below ``root``; with ``columns`` only those are read (column pruning is explicit in the plan)."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(rows: DataFrame) -> DataFrame:
    """A table just read, over all cores if it lies in fewer partitions: for work that is long in CPU but small in bytes.

    Files of some size have partitions enough and are left as they are, so that nothing large is shuffled for it.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)
