"""The pN_ queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm import credentials, encode, handwritten, packing, sentences, syntax, topn
from codequarry.sources.tables import spread, table


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return handwritten.not_handwritten(spread(table(spark, root, "source_files", "file_id", "relative_path", "content"))).select("file_id")


def p2_kinds(spark: SparkSession, root: str) -> DataFrame:
    """Files and characters by kind; files that someone on the team wrote are ``hand-written``."""
    found = handwritten.kinds(spread(table(spark, root, "source_files", "file_id", "relative_path", "content")))
    return found.groupBy(F.coalesce("kind", F.lit("hand-written")).alias("kind")).agg(F.count("*").alias("n_files"), F.sum("chars").alias("n_chars"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return topn.top_findings(table(spark, root, "findings", "scan_id", "id", "severity", "confidence"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    files = spread(table(spark, root, "source_files", "file_id", "relative_path", "content"))
    findings = spread(table(spark, root, "findings", "id", "code_snippet", "file_path"))
    return (
        credentials.find_credentials(files, "source_files", "content", "file_id", F.col("relative_path"))
        .unionByName(credentials.find_credentials(files, "source_files", "relative_path", "file_id"))
        .unionByName(credentials.find_credentials(findings, "findings", "code_snippet", "id", F.lit("")))
    )


def p4_redacted(spark: SparkSession, root: str) -> DataFrame:
    """Every file with the credentials in its content and path blanked out, all offsets and line ends as they were."""
    files = spread(table(spark, root, "source_files", "file_id", "relative_path", "content"))
    contents = credentials.redacted(files, "content", "file_id", F.col("relative_path"))
    return credentials.redacted(contents, "relative_path", "file_id")


def p4_redacted_snippets(spark: SparkSession, root: str) -> DataFrame:
    """Every finding's snippet in the same way."""
    return credentials.redacted(spread(table(spark, root, "findings", "id", "code_snippet")), "code_snippet", "id", F.lit(""))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return syntax.syntax_errors(spread(table(spark, root, "source_files", "file_id", "extension", "language", "content"))).select("file_id")


def p5_rates(spark: SparkSession, root: str) -> DataFrame:
    """Checked and invalid files per repository and language."""
    return syntax.error_rates(spread(table(spark, root, "source_files", "file_id", "repository_id", "extension", "language", "content")))


def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    return encode.encode(spread(table(spark, root, "documents", "doc_id", "text")), "doc_id", "text")


def p6_decoded(spark: SparkSession, root: str) -> DataFrame:
    """Every text again, from its ids."""
    return encode.decode(p6_ids(spark, root), "doc_id")


def p7_packed(spark: SparkSession, root: str) -> DataFrame:
    sizes = encode.count_tokens(spread(table(spark, root, "documents", "doc_id", "text")), "doc_id", "text")
    return packing.fill_containers(sizes, "doc_id", "tokens")


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return sentences.sentences(spread(table(spark, root, "documents", "doc_id", "text")), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p2_kinds": p2_kinds,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_redacted": p4_redacted,
    "p4_redacted_snippets": p4_redacted_snippets,
    "p5_found": p5_found,
    "p5_rates": p5_rates,
    "p6_ids": p6_ids,
    "p6_decoded": p6_decoded,
    "p7_packed": p7_packed,
    "p8_found": p8_found,
}

SQL: dict[str, str] = {
    "p3_found": """
        WITH items AS (
          SELECT scan_id, id, min(CASE lower(trim(severity)) WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2
                                  WHEN 'low' THEN 3 ELSE 4 END) AS s, min(-coalesce(confidence, 0)) AS c
          FROM findings WHERE scan_id IS NOT NULL AND id IS NOT NULL GROUP BY scan_id, id),
        ranked AS (SELECT scan_id, id AS finding_id,
                          CAST(row_number() OVER (PARTITION BY scan_id ORDER BY s, c, id) AS INTEGER) AS rank_no FROM items)
        SELECT scan_id, finding_id, rank_no FROM ranked WHERE rank_no <= 10""",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
