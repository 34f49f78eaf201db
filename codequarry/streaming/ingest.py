"""Findings as they arrive: an extension of the batch form, on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codequarry.operators.dedupe import fingerprint
from codequarry.operators.summary import severity_bucket


def findings_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Findings from Parquet files that arrive in a folder; ``schema`` must hold ``seen_at timestamp``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_seen(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each fingerprint of a scan once, as long as its repeats come within ``late``; state older than that is dropped."""
    return stream.withColumn("fp", fingerprint()).withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["scan_id", "fp"])


def severity_windows(stream: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """``start, severity, n`` in tumbling windows; rows later than ``late`` are left out."""
    w = stream.withWatermark("seen_at", late).groupBy(F.window("seen_at", width), severity_bucket(F.col("severity")).alias("severity"))
    return w.agg(F.count("*").alias("n")).select("window.start", "severity", "n")


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """To Parquet, exactly once, with what is there already; ends when all of that is written."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
