"""Name -> query of everything outside the ``llm`` subpackage. Every query reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions.redaction import redact, redaction_count
from codequarry.functions.urls import canonical_url
from codequarry.functions.versions import is_older
from codequarry.operators import advisories, confidence, config_audit, dedupe, findings, imports, linerules, patches, pyflow, pyquality, remediation, review, scripts, snapshots, summary
from codequarry.sources import files, manifests
from codequarry.sources.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]
HOST = "git.example"

QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _tables(spark, root, *names):
    return [table(spark, root, n) for n in names]


@query
def p1_found(spark, root):
    scans = table(spark, root, "scans", "id", "repository_id", "status", "completed_at")
    rows = table(spark, root, "findings", "scan_id", "fingerprint", "severity", "confidence", "line_number", "patch_available")
    return snapshots.snapshot_changes(scans, rows)


@query
def p1_values(spark, root):
    """The values before and after of every changed fingerprint."""
    scans = table(spark, root, "scans", "id", "repository_id", "status", "completed_at")
    rows = table(spark, root, "findings", "scan_id", "fingerprint", "severity", "confidence", "line_number", "patch_available")
    fields = [F.col(f"{side}.{v}").alias(f"{side}_{v}") for side in ("old", "new") for v in ("severity", "confidence", "line_number", "patch_available")]
    return snapshots.changed_values(scans, rows).select("repository_id", "scan_id", "fingerprint", *fields)


# filters (F1-F4), ownership (F5, J1-J3), parents (J13), sorts


@query
def filter_equal(spark, root):
    return findings.where(table(spark, root, "findings"), severity="high", category="crypto", analyzer="regex").select("id").distinct()


@query
def filter_security_group(spark, root):
    return findings.where(table(spark, root, "findings"), group="security").select("id").distinct()


@query
def filter_quality_group(spark, root):
    return findings.where(table(spark, root, "findings"), group="quality").select("id").distinct()


@query
def filter_confidence_floor(spark, root):
    return findings.where(table(spark, root, "findings"), min_confidence=75).select("id").distinct()


@query
def owned_repositories(spark, root):
    return findings.owned_repositories(*_tables(spark, root, "projects", "repositories"))


@query
def owned_scans(spark, root):
    return findings.owned_scans(*_tables(spark, root, "projects", "repositories", "scans"))


@query
def owned_finding_counts(spark, root):
    owned = findings.owned_findings(*_tables(spark, root, "projects", "repositories", "scans", "findings"))
    return owned.groupBy("user_id", "repository_id").agg(F.count("*").alias("n"))


@query
def repository_counts(spark, root):
    return findings.repository_counts(*_tables(spark, root, "projects", "repositories"))


@query
def latest_scans(spark, root):
    return findings.latest_scans(table(spark, root, "scans"))


@query
def newest_scans(spark, root):
    return findings.newest_scans(table(spark, root, "scans"))


@query
def newest_repository(spark, root):
    """The repository of each project that was created last (S1, S3); ties go to the greater id."""
    rows = table(spark, root, "repositories", "id", "project_id", "created_at").where("project_id is not null")
    return rows.groupBy("project_id").agg(F.max(F.struct("created_at", "id")).alias("r")).select("project_id", F.col("r.id").alias("repository_id"))


# projections (C1-C7, J4) and the sink's form (B1)


@query
def finding_projection(spark, root):
    return findings.projection(table(spark, root, "findings"))


@query
def finding_details(spark, root):
    rows = findings.details(*_tables(spark, root, "repositories", "scans", "findings"), host=HOST)
    fields = ("file_path", "start_line", "end_line", "original", "replacement", "reason")
    return rows.select("*", *[F.col(f"patch.{c}").alias(f"patch_{c}") for c in fields]).drop("patch")


@query
def secret_view(spark, root):
    return findings.view(table(spark, root, "findings"), "secret")


@query
def iac_view(spark, root):
    return findings.view(table(spark, root, "findings"), "iac")


@query
def remediation_view(spark, root):
    rows = findings.remediation_view(table(spark, root, "findings"))
    return rows.select("*", F.col("patch.original").alias("patch_original"), F.col("patch.replacement").alias("patch_replacement")).drop("patch")


@query
def flow_texts(spark, root):
    """Source and sink of a finding, where both are named, as one text."""
    rows = table(spark, root, "findings", "id", "source_label", "sink_label", "line_number").where("source_label is not null and sink_label is not null").distinct()
    line = F.coalesce("line_number", F.lit(0)).alias("line")
    steps = F.array(F.struct(F.col("source_label").alias("label"), line), F.struct(F.col("sink_label").alias("label"), line))
    return rows.select("id", findings.rendered_flow(steps).alias("flow"))


@query
def sorted_findings(spark, root):
    """Findings in the order in which lists show them."""
    return findings.newest_first(table(spark, root, "findings", "id", "scan_id"))


@query
def remediated_findings(spark, root):
    """Texts that findings lack, from the findings of the same rule that have them, and safe patches."""
    cols = ["id", "rule_id", *remediation.TEXTS, "patch_available", "line_number", "code_snippet"]
    rows = table(spark, root, "findings", *cols).where("id is not null").distinct()
    return remediation.remediated(rows, remediation.rule_texts(rows)).drop("code_snippet")


@query
def source_links(spark, root):
    return findings.source_links(*_tables(spark, root, "repositories", "scans", "findings"), host=HOST)


@query
def canonical_urls(spark, root):
    return table(spark, root, "repositories", "id", "url").distinct().select("id", canonical_url(F.col("url"), HOST).alias("canonical"))


@query
def stored_nulls(spark, root):
    rows = findings.stored(table(spark, root, "findings").dropDuplicates(["id"]))
    return rows.groupBy("scan_id").agg(*[F.count(c).alias(f"n_{c}") for c in ("confidence", "line_number", "category", "evidence", "patch_available")])


# aggregations (D1-D8), scores, reports (S4), set operations


@query
def scan_summary(spark, root):
    return summary.scan_summary(table(spark, root, "findings"))


@query
def score_from_counts(spark, root):
    return summary.score_from_counts(summary.scan_summary(table(spark, root, "findings")))


@query
def score_from_findings(spark, root):
    return summary.score_from_findings(table(spark, root, "findings"))


@query
def domain_breakdown(spark, root):
    return summary.domain_breakdown(table(spark, root, "findings"))


@query
def category_counts(spark, root):
    return summary.category_counts(table(spark, root, "findings"))


@query
def top_risks(spark, root):
    return summary.top_risks(table(spark, root, "findings"))


@query
def risk_summary(spark, root):
    return summary.risk_summary(table(spark, root, "findings"))


@query
def severity_category_cube(spark, root):
    return summary.severity_category_cube(table(spark, root, "findings"))


@query
def scan_diff(spark, root):
    scans, rows = _tables(spark, root, "scans", "findings")
    pairs = snapshots.snapshot_sequence(scans).where("previous_id is not null").select(F.col("previous_id").alias("old_scan"), F.col("snapshot_id").alias("new_scan"))
    return summary.fingerprint_diff(rows, pairs)


# fingerprints and merging (D10), rules and confidence (J5, R23), reviews (R26), patches


@query
def fingerprints(spark, root):
    return table(spark, root, "findings").select("id", dedupe.fingerprint().alias("computed")).distinct()


@query
def merged_findings(spark, root):
    cols = ["scan_id", "fingerprint", "id", "rule_id", "title", "severity", "confidence", "confidence_level", "merged", "evidence", "code_snippet", "source_label"]
    return dedupe.in_order(dedupe.merge_duplicates(table(spark, root, "findings"))).select(cols)


@query
def rule_enrichment(spark, root):
    rows = table(spark, root, "findings", "id", "rule_id", "cwe", "language", "confidence").distinct()
    return confidence.enrich(rows, table(spark, root, "rule_registry")).select("id", "cwe", "language", "base_confidence")


@query
def confidence_scores(spark, root):
    rows = table(spark, root, "findings", "id", "rule_id", "cwe", "language", "confidence", "analyzer", "source_label", "sink_label").distinct()
    rows = confidence.enrich(rows, table(spark, root, "rule_registry"))
    flow, tree = F.col("source_label").isNotNull(), F.col("analyzer").isin("ast", "dataflow")
    score = confidence.score(
        F.col("base_confidence"), has_user_controlled_source=flow, has_direct_flow=flow & F.col("sink_label").isNotNull(), is_ast_confirmed=tree, is_regex_only=~tree
    )
    return rows.select("id", score.alias("score"), confidence.level(score).alias("level"))


@query
def review_hashes(spark, root):
    return review.review_context(table(spark, root, "findings")).select("finding_id", "request_hash")


@query
def redacted_snippets(spark, root):
    text = redact(F.col("code_snippet"))
    rows = table(spark, root, "findings", "code_snippet").where("code_snippet is not null").distinct()
    return rows.select("code_snippet", text.alias("redacted"), redaction_count(text).alias("n_redacted"))


@query
def patch_status(spark, root):
    """Patches checked by running the line rules over the snippet before and after."""
    rows = table(spark, root, "findings", "id", "code_snippet", "patch_text", "file_path").where("patch_text is not null").distinct()
    parsed = rows.select("id", F.col("code_snippet").alias("content"), F.from_json("patch_text", findings.PATCH).alias("p"), files.extension_of(F.coalesce("file_path", F.lit(""))).alias("ext"))
    checked = patches.verified(parsed.select("id", "content", "ext", F.col("p.original").alias("original"), F.col("p.replacement").alias("replacement")), lambda c: linerules.count_hits(c, F.col("ext")))
    return checked.groupBy("status").agg(F.count("*").alias("n"))


# files and lines (A2-A7), line rules (R1, R10), context frames


@query
def classified_files(spark, root):
    return files.classified(table(spark, root, "source_files"))


@query
def languages_found(spark, root):
    """The languages of each repository's files (D12), sorted; there are a few dozen at most."""
    rows = table(spark, root, "source_files", "repository_id", "relative_path").where("repository_id is not null")
    name = files.language_of(files.extension_of(F.col("relative_path")))
    return rows.groupBy("repository_id").agg(F.array_join(F.array_sort(F.collect_set(name)), ",").alias("languages"))


def _lines(spark, root):
    return files.delivered_lines(spread(table(spark, root, "source_files", "file_id", "relative_path", "content")))


@query
def line_counts(spark, root):
    each = _lines(spark, root).groupBy("file_id", "copy_no").agg(F.max("line_no").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))
    return each.groupBy("file_id").agg(F.max("n_lines").alias("n_lines"), F.max("n_chars").alias("n_chars"))


@query
def line_rule_hits(spark, root):
    return linerules.generic_hits(_lines(spark, root)).select("file_id", "line_no", "title", "severity")


@query
def weak_hashes(spark, root):
    parsing = pyflow.parsing(table(spark, root, "source_files", "file_id", "relative_path", "content"))
    return linerules.weak_hashes(_lines(spark, root), parsing).select("file_id", "line_no", "algorithm")


@query
def nearby_context(spark, root):
    js = scripts.script_lines(_lines(spark, root))
    source = F.col("line").rlike(scripts.SOURCES)
    flags = js.select("file_id", "copy_no", *[linerules.near(source, "file_id", a, b).alias(n) for n, a, b in (("near", 8, 8), ("wide", 30, 30), ("back", 15, 2))])
    each = flags.groupBy("file_id", "copy_no").agg(*[F.count(F.when(F.col(n), 1)).alias(f"n_{n}") for n in ("near", "wide", "back")])
    return each.groupBy("file_id").agg(*[F.max(f"n_{n}").alias(f"n_{n}") for n in ("near", "wide", "back")])


@query
def previous_assignment(spark, root):
    js = scripts.script_lines(_lines(spark, root))
    name = F.nullif(F.regexp_extract("line", r"^\s*(?:const|let|var)\s+(\w+)\s*=", 1), F.lit(""))
    return js.select("file_id", "line_no", linerules.previous_value(name, "file_id").alias("assigned")).where("assigned is not null").distinct()


@query
def suppressions(spark, root):
    return linerules.suppressions(_lines(spark, root))


# scripts (R2-R6), Python (R7-R12), configuration


@query
def script_sinks(spark, root):
    return scripts.sinks(_lines(spark, root)).select("file_id", "line_no", "rule_id", "severity", "has_source", "has_sanitizer")


@query
def script_quality(spark, root):
    return scripts.quality(_lines(spark, root)).select("file_id", "line_no", "rule_id", "severity")


@query
def script_secrets(spark, root):
    return scripts.literal_secrets(_lines(spark, root)).select("file_id", "line_no")


@query
def markup_provenance(spark, root):
    return scripts.provenance(_lines(spark, root)).select("file_id", "line_no", "source_class", "severity", "confidence_delta")


@query
def python_flows(spark, root):
    return pyflow.flows(table(spark, root, "source_files", "file_id", "relative_path", "content"))


@query
def python_quality(spark, root):
    return pyquality.python_quality(table(spark, root, "source_files", "file_id", "relative_path", "content"))


@query
def configuration_audit(spark, root):
    return config_audit.audit(table(spark, root, "source_files", "file_id", "relative_path", "content")).select("file_id", "line_no", "rule_id", "severity", "confidence")


@query
def analyzer_union(spark, root):
    """Hits of all line analyzers together, by rule."""
    rows = _lines(spark, root)
    parts = [
        linerules.generic_hits(rows).select("file_id", F.col("title").alias("what")),
        linerules.weak_hashes(rows).select("file_id", F.lit("CRY001").alias("what")),
        scripts.sinks(rows).select("file_id", F.col("rule_id").alias("what")),
        scripts.quality(rows).select("file_id", F.col("rule_id").alias("what")),
        scripts.literal_secrets(rows).select("file_id", F.lit("SEC001").alias("what")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("what").agg(F.count("*").alias("n"), F.count_distinct("file_id").alias("n_files"))


# manifests (A8-A13), advisories (J6, R22), import graph


@query
def locked_dependencies(spark, root):
    return manifests.dependencies(table(spark, root, "source_files", "file_id", "relative_path", "content"))


@query
def outdated_dependencies(spark, root):
    rows = table(spark, root, "findings", "id", "dependency_name", "dependency_version", "fixed_version").where("dependency_name is not null").distinct()
    return rows.select("id", "dependency_name", is_older(F.col("dependency_version"), F.col("fixed_version")).alias("outdated"))


@query
def advisory_matches(spark, root):
    rows = table(spark, root, "findings", "dependency_name", "dependency_version", "advisory_id", "fixed_version").where("dependency_name is not null")
    found = rows.select(F.col("dependency_name").alias("name"), F.col("dependency_version").alias("version"), F.lit("npm").alias("ecosystem")).distinct()
    known = rows.where("advisory_id is not null and fixed_version is not null").groupBy("advisory_id", "dependency_name").agg(F.max("fixed_version").alias("fix"))
    known = known.select("advisory_id", F.lit("npm").alias("ecosystem"), F.col("dependency_name").alias("package"), F.concat(F.lit("<"), "fix").alias("affected"))
    return advisories.affected(found, known).select("name", "version", "advisory_id", "confidence")


@query
def import_edges(spark, root):
    return imports.import_edges(table(spark, root, "source_files", "repository_id", "relative_path", "content"))


@query
def unused_imports(spark, root):
    return imports.unused_imports(table(spark, root, "source_files", "repository_id", "relative_path", "content"))


@query
def import_components(spark, root):
    return imports.import_components(import_edges(spark, root))


@query
def import_cycles(spark, root):
    return imports.import_cycles(import_edges(spark, root))
