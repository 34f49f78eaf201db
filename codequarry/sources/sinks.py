"""Writers: findings and the history of scan states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators.findings import stored


def write_findings(findings: DataFrame, path: str, buckets: int = 64) -> None:
    """Appends findings as Parquet by scan bucket, so that one scan is one folder to read and no folder is a file per scan."""
    bucket = F.pmod(F.xxhash64("scan_id"), F.lit(buckets)).cast("int")
    stored(findings).withColumn("scan_bucket", bucket).write.mode("append").partitionBy("scan_bucket").parquet(path)


def read_scan(spark: SparkSession, path: str, scan_id: str, buckets: int = 64) -> DataFrame:
    """The findings of one scan; only its bucket is read."""
    bucket = F.pmod(F.xxhash64(F.lit(scan_id)), F.lit(buckets)).cast("int")
    return spark.read.parquet(path).where((F.col("scan_bucket") == bucket) & (F.col("scan_id") == scan_id)).drop("scan_bucket")


def append_rows(rows: DataFrame, path: str) -> None:
    """Appends projects, repositories or users as they are; readers fold repeats by id."""
    rows.write.mode("append").parquet(path)


def append_state(spark: SparkSession, path: str, scan_id: str, status: str) -> None:
    """Adds one state to a scan's history; nothing is ever updated in place."""
    spark.range(1).select(F.lit(scan_id).alias("scan_id"), F.lit(status).alias("status"), F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def current_states(history: DataFrame) -> DataFrame:
    """``scan_id, status``: the last state of each scan, ties by status."""
    return history.groupBy("scan_id").agg(F.max(F.struct("at", "status")).alias("s")).select("scan_id", "s.status")
