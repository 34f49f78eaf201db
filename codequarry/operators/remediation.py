"""Texts that explain a finding and say what to do, filled in from a registry of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions.text import blank_to_null
from codequarry.operators.patches import made_patch

TEXTS = ["why_risky", "impact", "remediation", "fix_example", "cwe"]


def rule_texts(findings: DataFrame) -> DataFrame:
    """``rule_id`` and each text as the rule's finding with the least id has it: a registry out of findings that have texts."""
    said = [F.min_by(blank_to_null(F.col(t)), F.when(blank_to_null(F.col(t)).isNotNull(), F.col("id"))).alias(t) for t in TEXTS]
    return findings.where("rule_id is not null and id is not null").groupBy("rule_id").agg(*said)


def remediated(findings: DataFrame, registry: DataFrame) -> DataFrame:
    """``findings`` with empty texts taken from ``registry`` (``rule_id`` and any of the texts) and safe patches made.

    A text that is there stays. A patch is made only for a finding without one, with a line and a snippet, whose rule
    has a replacement that can't change the meaning; ``patch_original`` and ``patch_replacement`` are null elsewhere.
    Findings of rules the registry doesn't have stay as they are.
    """
    texts = [t for t in TEXTS if t in registry.columns]
    known = registry.select("rule_id", *[F.col(t).alias(f"_registry_{t}") for t in texts])
    joined = findings.join(known, "rule_id", "left")
    made = F.when(~F.coalesce("patch_available", F.lit(False)) & (F.col("line_number") > 0), made_patch(F.col("rule_id"), F.col("code_snippet")))
    filled = {t: F.coalesce(blank_to_null(F.col(t)), F.col(f"_registry_{t}")) for t in texts}
    return joined.select(
        *[filled[c].alias(c) if c in filled else F.col(c) for c in findings.columns if c != "patch_available"],
        (F.coalesce("patch_available", F.lit(False)) | made.isNotNull()).alias("patch_available"),
        F.when(made.isNotNull(), F.col("code_snippet")).alias("patch_original"),
        made.alias("patch_replacement"),
    )
