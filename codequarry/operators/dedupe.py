"""Fingerprints of findings and the merge of those that share one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions.text import blank_to_null, forward_slashes
from codequarry.operators.confidence import level

BUCKET = 5
# The order of analyzers and severities, the titles that say nothing of the cause.
ANALYZER_RANK = {"dataflow": 4, "ast": 3, "import_graph": 2, "regex": 1}
SEVERITY_RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
GENERIC_TITLES = [
    "console statement left in code (JavaScript/TypeScript)",
    "debugger statement (JavaScript/TypeScript)",
    "Debug print statement (Python)",
]
FIRST_TRUTHY = ["source_label", "sink_label", "data_flow_text", "why_risky", "impact", "remediation", "fix_example", "evidence", "code_snippet"]


def _ranked(c: Column, ranks: dict[str, int]) -> Column:
    return F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in ranks.items()], F.lit(0))


def fingerprint(precise: bool = False) -> Column:
    """16 hex digits over rule, path, line bucket and sink; ``precise`` adds advisory and evidence.

    Quality findings of a QA rule or of none share one fingerprint for each bucket of five lines.
    """
    rule, path = F.coalesce("rule_id", F.lit("")), forward_slashes(F.coalesce("file_path", F.lit("")))
    line = F.coalesce("line_number", F.lit(0))
    place = F.concat(path, F.lit(":"), (line - line % BUCKET).cast("string"))
    named = F.coalesce(blank_to_null(rule), F.replace(F.lower("title"), F.lit(" "), F.lit("_")))
    sink = F.coalesce("sink_label", F.lit(""))
    plain_quality = (F.coalesce("category", F.lit("quality")) == "quality") & (rule.startswith("QA") | (rule == ""))
    text = F.when(plain_quality, F.concat(F.lit("quality:"), place)).otherwise(F.concat(named, F.lit(":"), place, F.lit(":"), sink))
    if precise:
        text = F.concat_ws(":", text, "advisory_id", "evidence")
    return F.substring(F.sha2(text, 256), 1, 16)


def merge_duplicates(findings: DataFrame, within: str = "scan_id", precise: bool = False) -> DataFrame:
    """One finding for each fingerprint ``within`` a scan.

    The best analyzer, then the highest confidence, then the least id wins and gives the plain columns. Severity
    and confidence are the highest of the group; explanatory texts are the first that say anything, in that order;
    ``merged`` counts the group; ``transforms``, where the rows have that column, is the union of its lists (of a few
    steps each), sorted. Null confidences rank last. Repeated rows count once.

    All of it is done by partial aggregates of one row's size (``max_by`` over an order key), so a fingerprint
    that a third of all rows share is folded before the shuffle and never collected.
    """
    rows = findings.where("id is not null").withColumn("fp", fingerprint(precise))
    best = F.struct(
        (-_ranked(F.col("analyzer"), ANALYZER_RANK)).alias("a"), (-F.coalesce("confidence", F.lit(-1))).alias("b"), F.col("id").alias("c")
    )
    gathered = []
    if "transforms" in findings.columns:  # before the sink, steps between source and sink are a list
        gathered = [F.array_sort(F.array_distinct(F.flatten(F.collect_set("transforms")))).alias("transforms")]
    winner = ["id", "rule_id", "category", "title", "description", "file_path", "line_number", "cwe", "language", "analyzer", "dependency_name", "advisory_id"]
    truthy = [F.min_by(blank_to_null(F.col(c)), F.when(blank_to_null(F.col(c)).isNotNull(), best)).alias(c) for c in FIRST_TRUTHY]
    telling = F.when(~F.col("title").isin(GENERIC_TITLES), best)
    merged = rows.groupBy(within, "fp").agg(
        F.min_by(F.struct(*winner), best).alias("w"),
        F.max(_ranked(F.lower(F.trim("severity")), SEVERITY_RANK)).alias("severity_rank"),
        F.max("confidence").alias("confidence"),
        F.min_by("title", telling).alias("telling_title"),
        F.min_by(F.struct("patch_text", "patch_available"), F.when(blank_to_null(F.col("patch_text")).isNotNull(), best)).alias("patch"),
        F.count_distinct("id").alias("merged"),
        *truthy,
        *gathered,
    )
    severity = F.coalesce(*[F.when(F.col("severity_rank") == v, F.lit(k)) for k, v in SEVERITY_RANK.items()], F.lit("info"))
    generic = F.col("w.title").isin(GENERIC_TITLES) & F.col("telling_title").isNotNull() & (F.coalesce("w.category", F.lit("quality")) == "quality")
    kept = [F.col(f"w.{c}").alias(c) for c in winner if c != "title"]
    return merged.select(
        within,
        F.col("fp").alias("fingerprint"),
        *kept,
        F.when(generic, F.col("telling_title")).otherwise(F.col("w.title")).alias("title"),
        severity.alias("severity"),
        "confidence",
        level(F.coalesce("confidence", F.lit(0))).alias("confidence_level"),
        "merged",
        F.col("patch.patch_text").alias("patch_text"),
        *FIRST_TRUTHY,
        *(["transforms"] if gathered else []),
    )


def in_order(merged: DataFrame) -> DataFrame:
    """Merged findings by file, line and fingerprint; findings without a file come first, as a range-partitioned sort."""
    return merged.orderBy(F.coalesce("file_path", F.lit("")), F.coalesce("line_number", F.lit(0)), "fingerprint")
