"""Context texts for a reviewer, their redaction, and the cache of earlier reviews. No review service is called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions.redaction import redact
from codequarry.functions.text import blank_to_null

LIMIT = 12_000
VERSION = "1"


def _line(label: str, c: Column) -> Column:
    return F.when(blank_to_null(c.cast("string")).isNotNull(), F.concat(F.lit(f"{label}: "), c.cast("string")))


def review_context(findings: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``finding_id, context, request_hash``: the finding as text, cut to ``limit`` characters, then redacted, then hashed.

    Missing fields leave no line. Equal contexts have equal hashes, so a repeated finding is reviewed once.
    """
    place = F.concat(F.col("file_path"), F.when(F.col("line_number") > 0, F.concat(F.lit(":"), F.col("line_number"))).otherwise(""))
    text = F.concat_ws(
        "\n",
        _line("Rule", F.col("rule_id")),
        _line("Title", F.col("title")),
        _line("Severity", F.col("severity")),
        _line("Category", F.col("category")),
        _line("Analyzer", F.col("analyzer")),
        _line("Location", place),
        _line("Description", F.col("description")),
        _line("Snippet", F.col("code_snippet")),
        F.when(~F.col("evidence").eqNullSafe(F.col("code_snippet")), _line("Evidence", F.col("evidence"))),
        _line("Source", F.col("source_label")),
        _line("Sink", F.col("sink_label")),
        _line("Dependency", F.col("dependency_name")),
    )
    redacted = redact(F.substring(text, 1, limit))
    return findings.select(
        F.col("id").alias("finding_id"), redacted.alias("context"), F.sha2(F.concat(redacted, F.lit(f"\nversion={VERSION}")), 256).alias("request_hash")
    ).distinct()


REVIEWS = """id string, finding_id string, request_hash string, analysis_version string, verdict string, confidence double, exploitability double,
explanation string, provider string, model string, created_at timestamp"""


def write_reviews(reviews: DataFrame, path: str, buckets: int = 16) -> None:
    """Appends reviews of the columns :data:`REVIEWS`, missing ones as null, in buckets by finding; a repeated review is folded when read."""
    spark = reviews.sparkSession
    rows = spark.createDataFrame([], REVIEWS).unionByName(reviews, allowMissingColumns=True)
    bucket = F.pmod(F.xxhash64("finding_id"), F.lit(buckets)).cast("int")
    rows.withColumn("finding_bucket", bucket).write.mode("append").partitionBy("finding_bucket").parquet(path)


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """The last review of each finding, hash and version, by ``created_at``, then id."""
    keys = ["finding_id", "request_hash", "analysis_version"]
    rest = [c for c in reviews.columns if c not in keys]
    return reviews.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("created_at", "id")).alias("r")).select(*keys, *[f"r.{c}" for c in rest])


def uncached(contexts: DataFrame, reviews: DataFrame, version: str = VERSION) -> DataFrame:
    """The contexts without a stored review of this version."""
    done = reviews.where(F.col("analysis_version") == version).select("finding_id", "request_hash").distinct()
    return contexts.join(done, ["finding_id", "request_hash"], "left_anti")
