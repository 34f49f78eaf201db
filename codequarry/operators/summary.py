"""Per-scan summaries, scores and reports, each in one pass over the findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codequarry.functions.text import blank_to_null, zero_to_null
from codequarry.operators.findings import SAST_CATEGORIES, distinct_findings, is_security
from codequarry.operators.skew import join_hot

SEVERITIES = ["critical", "high", "medium", "low", "info"]
WEIGHTS = {"critical": 20, "high": 10, "medium": 4, "low": 1}


def severity_bucket(severity: Column) -> Column:
    """Trimmed, lower case; anything unknown is info."""
    s = F.lower(F.trim(severity))
    return F.when(s.isin(SEVERITIES), s).otherwise("info")


def domain(analyzer: Column, category: Column) -> Column:
    """sast, secrets, dependencies, iac or quality."""
    return (
        F.when(analyzer == "sca", "dependencies").when(analyzer == "secret_scanner", "secrets").when(analyzer == "iac", "iac")
        .when(category.isin(SAST_CATEGORIES), "sast").otherwise("quality")
    )


def _confidence() -> Column:
    return F.coalesce(zero_to_null(F.col("confidence")), F.lit(50))


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def scan_summary(findings: DataFrame) -> DataFrame:
    """One row for each scan with findings: severities, groups, domains, averages.

    A missing or zero confidence counts as 50 in the average, and as not high.
    """
    f = distinct_findings(findings, "scan_id", "severity", "category", "analyzer", "confidence", "patch_available")
    sev, security = severity_bucket(F.col("severity")), is_security(F.col("category"))
    scanner = F.coalesce("analyzer", F.lit(""))
    return (
        f.groupBy("scan_id")
        .agg(
            F.count("*").alias("total"),
            *[_count(sev == s).alias(s) for s in SEVERITIES],
            _count(security).alias("security"),
            _count(~security).alias("quality"),
            _count(F.col("confidence") >= 80).alias("high_confidence"),
            _count(F.col("patch_available")).alias("fixable"),
            _count(scanner == "sca").alias("dependency"),
            _count(scanner == "secret_scanner").alias("secret"),
            _count(scanner == "iac").alias("iac"),
            _count(~scanner.isin("sca", "secret_scanner", "iac") & security).alias("sast"),
            F.sum(_confidence()).alias("confidence_sum"),
        )
        .where("scan_id is not null")
    )


def score_from_counts(counts: DataFrame) -> DataFrame:
    """``scan_id, score, grade`` from a summary: weighted counts, scaled by the average confidence, half-even rounding."""
    average = F.col("confidence_sum") / F.col("total")
    scale = F.when(average >= 80, 1.0).when(average >= 50, 0.75).otherwise(0.5)
    penalty = sum((F.col(s) * w for s, w in WEIGHTS.items()), F.lit(0)) * scale
    score = F.greatest(F.lit(0), F.bround(100 - F.least(penalty, F.lit(100)), 0)).cast("int")
    return counts.select("scan_id", score.alias("score")).withColumn("grade", grade(F.col("score")))


def score_from_findings(findings: DataFrame) -> DataFrame:
    """``scan_id, score``: each finding's weight is scaled by its own confidence (1, 0.75, 0.5 or nothing)."""
    f = distinct_findings(findings, "scan_id", "severity", "confidence")
    weight = F.coalesce(*[F.when(severity_bucket(F.col("severity")) == s, F.lit(w)) for s, w in WEIGHTS.items()], F.lit(0))
    c = _confidence()
    scale = F.when(c >= 80, 1.0).when(c >= 50, 0.75).when(c >= 30, 0.5).otherwise(0.0)
    penalty = F.least(F.sum(weight * scale), F.lit(100.0))
    return f.where("scan_id is not null").groupBy("scan_id").agg(F.greatest(F.lit(0), F.bround(100 - penalty, 0)).cast("int").alias("score"))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def domain_breakdown(findings: DataFrame) -> DataFrame:
    """``scan_id, domain, n``."""
    f = distinct_findings(findings, "scan_id", "category", "analyzer")
    return f.where("scan_id is not null").groupBy("scan_id", domain(F.col("analyzer"), F.col("category")).alias("domain")).agg(F.count("*").alias("n"))


def category_counts(findings: DataFrame) -> DataFrame:
    """``scan_id, category, n``; a missing category is ``unknown``."""
    f = distinct_findings(findings, "scan_id", "category")
    name = F.coalesce(blank_to_null(F.col("category")), F.lit("unknown"))
    return f.where("scan_id is not null").groupBy("scan_id", name.alias("category")).agg(F.count("*").alias("n"))


def top_risks(findings: DataFrame, n: int = 5) -> DataFrame:
    """``scan_id, finding_id, position``: critical and high findings by confidence (null is 0), then id; severity doesn't order them."""
    f = distinct_findings(findings, "scan_id", "severity", "confidence").where(severity_bucket(F.col("severity")).isin("critical", "high"))
    w = Window.partitionBy("scan_id").orderBy(F.coalesce("confidence", F.lit(0)).desc(), F.col("id"))
    return f.where("scan_id is not null").select("scan_id", F.col("id").alias("finding_id"), F.row_number().over(w).alias("position")).where(F.col("position") <= n)


def severity_category_cube(findings: DataFrame) -> DataFrame:
    """``severity, category, n`` for all combinations and their totals; ``all`` stands for a total."""
    f = distinct_findings(findings, "severity", "category")
    rows = f.select(severity_bucket(F.col("severity")).alias("s"), F.coalesce("category", F.lit("unknown")).alias("c"))
    name = lambda c: F.when(F.grouping(c) == 1, "all").otherwise(F.col(c))
    return rows.cube("s", "c").agg(F.count("*").alias("n"), name("s").alias("severity"), name("c").alias("category")).select("severity", "category", "n")


def risk_summary(findings: DataFrame) -> DataFrame:
    """``scan_id, total, score, grade, top_finding`` of every scan."""
    summary = scan_summary(findings)
    first = top_risks(findings, 1).select("scan_id", F.col("finding_id").alias("top_finding"))
    return summary.select("scan_id", "total").join(score_from_counts(summary), "scan_id").join(first, "scan_id", "left")


def fingerprint_diff(findings: DataFrame, pairs: DataFrame) -> DataFrame:
    """``old_scan, new_scan, n_new, n_resolved, n_unchanged`` over the distinct fingerprints of each pair of scans."""
    prints = findings.select("scan_id", F.lower(F.trim("fingerprint")).alias("fp")).where(F.col("fp") != "").distinct()
    old = join_hot(prints.withColumnRenamed("scan_id", "old_scan"), pairs, "old_scan", "fp").select("old_scan", "new_scan", "fp", F.lit(1).alias("side"))
    new = join_hot(prints.withColumnRenamed("scan_id", "new_scan"), pairs, "new_scan", "fp").select("old_scan", "new_scan", "fp", F.lit(2).alias("side"))
    sides = old.unionByName(new).groupBy("old_scan", "new_scan", "fp").agg(F.sum("side").alias("s"))
    return sides.groupBy("old_scan", "new_scan").agg(
        _count(F.col("s") == 2).alias("n_new"), _count(F.col("s") == 1).alias("n_resolved"), _count(F.col("s") == 3).alias("n_unchanged")
    )
