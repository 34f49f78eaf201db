"""Confidence of a finding from its rule's base and the signals around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What each signal adds.
SIGNALS = {
    "has_user_controlled_source": 20,
    "has_direct_flow": 15,
    "is_ast_confirmed": 10,
    "has_framework_context": 5,
    "sink_is_known": 5,
    "source_is_constant": -30,
    "is_regex_only": -15,
    "flow_is_incomplete": -10,
    "is_generated_file": -20,
    "syntax_is_ambiguous": -10,
}
SANITIZED, UNSANITIZED = -25, 10


def score(base: Column, **signals: Column) -> Column:
    """0 to 100. Signals not given are off; without ``has_sanitizer`` the flow counts as unsanitized."""
    known = {k: F.coalesce(v, F.lit(False)) for k, v in signals.items()}
    total = base + F.when(known.pop("has_sanitizer", F.lit(False)), SANITIZED).otherwise(UNSANITIZED)
    for name, on in known.items():
        total = total + F.when(on, SIGNALS[name]).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int")


def level(confidence: Column) -> Column:
    return F.when(confidence >= 80, "high").when(confidence >= 50, "medium").otherwise("low")


def enrich(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Fills cwe and language from the rule registry and takes its base where the confidence is the default, 50.

    Findings of unknown rules stay as they are. The registry is a fixed table of a few dozen rows; of several rows of
    one rule the first by number counts.
    """
    known = rules.where("rule_id is not null").groupBy("rule_id").agg(F.min_by(F.struct("base_confidence", "cwe", "language"), "rule_no").alias("rule"))
    joined = findings.join(known, "rule_id", "left")
    base = F.when((F.col("confidence") == 50) & F.col("rule.base_confidence").isNotNull(), F.col("rule.base_confidence")).otherwise(F.coalesce("confidence", F.lit(50)))
    return joined.select(
        *[c for c in findings.columns if c not in ("cwe", "language")],
        F.coalesce("cwe", "rule.cwe").alias("cwe"),
        F.coalesce("language", "rule.language").alias("language"),
        base.alias("base_confidence"),
    )
