"""The relational surface over findings: filters, ownership, projections, sorts.

Tables are those of the audit platform. A finding may be delivered twice as a literal repeat; ``distinct_findings``
folds repeats by id before anything counts them. Empty tables give empty results throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codequarry.functions.text import blank_to_null, zero_to_null
from codequarry.functions.urls import HOST, source_url
from codequarry.operators.skew import join_hot

# The category groups.
SECURITY_CATEGORIES = """code_execution command_injection xss sql_injection path_traversal ssrf open_redirect deserialization secrets crypto
template_injection configuration data_flow""".split()
SAST_CATEGORIES = [c for c in SECURITY_CATEGORIES if c not in ("secrets", "configuration")]
PATCH = "file_path string, start_line int, end_line int, original string, replacement string, reason string"


def distinct_findings(findings: DataFrame, *columns: str) -> DataFrame:
    """One row for each id, with the given columns; repeats fold before the shuffle. Rows without id are left out."""
    return findings.where("id is not null").groupBy("id").agg(F.min(F.struct(*columns)).alias("f")).select("id", *[f"f.{c}" for c in columns])


def is_security(category: Column) -> Column:
    return F.coalesce(category.isin(SECURITY_CATEGORIES), F.lit(False))


def where(
    findings: DataFrame,
    severity: str = "",
    category: str = "",
    analyzer: str = "",
    group: str = "",
    min_confidence: int | None = None,
) -> DataFrame:
    """The findings that pass all filters given; an empty one isn't applied.

    ``group`` is ``security`` or ``quality``, the latter with the findings without a category. A null
    confidence passes any floor. An unknown group filters nothing.
    """
    for name, value in (("severity", severity), ("category", category), ("analyzer", analyzer)):
        if value:
            findings = findings.where(F.col(name) == value)
    if group == "security":
        findings = findings.where(is_security(F.col("category")))
    elif group == "quality":
        findings = findings.where(~is_security(F.col("category")))
    if min_confidence is not None:
        findings = findings.where((F.col("confidence") >= min_confidence) | F.col("confidence").isNull())
    return findings


def current_scans(scans: DataFrame) -> DataFrame:
    """One row for each scan: of its deliveries the one furthest along, then the one finished last."""
    stage = F.coalesce(*[F.when(F.col("status") == s, F.lit(i)) for i, s in enumerate(("pending", "running", "completed", "failed"))], F.lit(-1))
    cols = ["repository_id", "status", "started_at", "completed_at", "commit_sha", "branch"]
    row = F.struct(stage.alias("stage"), F.col("completed_at").alias("t"), *cols)
    return scans.where("id is not null").groupBy("id").agg(F.max(row).alias("s")).select("id", *[f"s.{c}" for c in cols])


def owned_repositories(projects: DataFrame, repositories: DataFrame) -> DataFrame:
    """``user_id, repository_id``."""
    p = projects.select(F.col("id").alias("project_id"), "user_id").distinct()
    return repositories.select(F.col("id").alias("repository_id"), "project_id").distinct().join(p, "project_id").select("user_id", "repository_id")


def owned_scans(projects: DataFrame, repositories: DataFrame, scans: DataFrame) -> DataFrame:
    """``user_id, repository_id, scan_id`` up the chain scan, repository, project."""
    s = current_scans(scans).select(F.col("id").alias("scan_id"), "repository_id")
    return s.join(owned_repositories(projects, repositories), "repository_id").select("user_id", "repository_id", "scan_id")


def owned_findings(projects: DataFrame, repositories: DataFrame, scans: DataFrame, findings: DataFrame) -> DataFrame:
    """``user_id, repository_id, scan_id, finding_id`` up the whole chain; findings of unknown scans drop out."""
    f = findings.select(F.col("id").alias("finding_id"), "scan_id").distinct()
    return join_hot(f, owned_scans(projects, repositories, scans), "scan_id", "finding_id").select("user_id", "repository_id", "scan_id", "finding_id")


def repository_counts(projects: DataFrame, repositories: DataFrame) -> DataFrame:
    """``project_id, n_repositories`` of every project, 0 for those without."""
    n = repositories.select("id", "project_id").distinct().groupBy("project_id").agg(F.count("*").alias("n"))
    return (
        projects.select(F.col("id").alias("project_id")).distinct().join(n, "project_id", "left")
        .select("project_id", F.coalesce("n", F.lit(0)).alias("n_repositories"))
    )


def latest_scans(scans: DataFrame) -> DataFrame:
    """``repository_id, scan_id, status``: the scan of each repository that started last; ties go to the greater id."""
    last = F.max(F.struct("started_at", "id", "status")).alias("s")
    return current_scans(scans).where("repository_id is not null").groupBy("repository_id").agg(last).select("repository_id", F.col("s.id").alias("scan_id"), "s.status")


def newest_scans(scans: DataFrame, n: int = 8) -> DataFrame:
    """``repository_id, scan_id, position``: the ``n`` last started scans of each repository."""
    w = Window.partitionBy("repository_id").orderBy(F.col("started_at").desc_nulls_last(), F.col("id").desc())
    return (
        current_scans(scans).select("repository_id", F.col("id").alias("scan_id"), F.row_number().over(w).alias("position")).where(F.col("position") <= n)
    )


def projection(findings: DataFrame) -> DataFrame:
    """Response columns: the patch parsed from its JSON (null where that is cut off), the package by its name or the title."""
    cols = ["title", "dependency_name", "patch_text", "data_flow_text"]
    patch = F.from_json("patch_text", PATCH)
    good = F.when(patch["file_path"].isNotNull(), patch)
    return distinct_findings(findings, *cols).select(
        F.col("id").alias("finding_id"),
        F.coalesce(blank_to_null(F.col("dependency_name")), "title").alias("package_name"),
        good["file_path"].alias("patch_file"),
        good["start_line"].alias("patch_start"),
        good["replacement"].alias("patch_replacement"),
    )


#: The columns of a response, in their order; the patch and the link are made.
RESPONSE = """id scan_id severity title description file_path line_number rule_id category column_number end_line code_snippet cwe language analyzer
confidence confidence_level why_risky impact remediation fix_example source_label sink_label data_flow_text evidence patch_available fingerprint
dependency_name dependency_version fixed_version advisory_id secret_type redacted_value""".split()
VIEWS = {
    "secret": ("secret_scanner", "id secret_type redacted_value severity file_path line_number confidence evidence".split()),
    "iac": ("iac", "id rule_id title severity file_path line_number evidence remediation".split()),
}


def parsed_patch(text: Column) -> Column:
    """The patch of a finding; null where there is none or its JSON is cut off."""
    patch = F.from_json(text, PATCH)
    return F.when(patch["file_path"].isNotNull(), patch)


def details(repositories: DataFrame, scans: DataFrame, findings: DataFrame, host: str = HOST) -> DataFrame:
    """Every finding as a response shows it: all its columns, the parsed ``patch``, and ``source_url``, null where no link can be made."""
    links = source_links(repositories, scans, findings, host).withColumnsRenamed({"finding_id": "id", "url": "source_url"})
    rows = distinct_findings(findings, *[c for c in RESPONSE if c != "id"], "patch_text")
    return rows.join(links, "id", "left").select(*RESPONSE, parsed_patch(F.col("patch_text")).alias("patch"), "source_url")


def view(findings: DataFrame, kind: str) -> DataFrame:
    """The findings of one analyzer with the columns its view shows; ``kind`` is ``secret`` or ``iac``."""
    analyzer, columns = VIEWS[kind]
    return distinct_findings(findings.where(F.col("analyzer") == analyzer), *[c for c in columns if c != "id"])


def remediation_view(findings: DataFrame) -> DataFrame:
    """``finding_id``, the explaining texts and the parsed patch of every finding."""
    texts = ["why_risky", "impact", "remediation", "fix_example", "patch_available"]
    rows = distinct_findings(findings, *texts, "patch_text")
    return rows.select(F.col("id").alias("finding_id"), *texts, parsed_patch(F.col("patch_text")).alias("patch"))


def newest_first(rows: DataFrame) -> DataFrame:
    """Findings or scans by id, descending, each id once: the order of the lists of both."""
    return rows.where("id is not null").dropDuplicates(["id"]).orderBy(F.col("id").desc())


def rendered_flow(steps: Column) -> Column:
    """Data-flow steps, an array of ``label, line``, as one text."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["label"], F.lit(" (line "), s["line"], F.lit(")"))), " → ")


def source_links(repositories: DataFrame, scans: DataFrame, findings: DataFrame, host: str = HOST) -> DataFrame:
    """``finding_id, url`` of every finding whose repository, path and ref make a link; the ref is the commit, else the branch."""
    f = distinct_findings(findings, "scan_id", "file_path", "line_number", "end_line")
    s = current_scans(scans).select(F.col("id").alias("scan_id"), "repository_id", F.coalesce("commit_sha", "branch").alias("ref"))
    r = repositories.select(F.col("id").alias("repository_id"), "url").distinct()
    link = source_url(F.col("url"), F.col("file_path"), F.col("ref"), F.col("line_number"), F.col("end_line"), host)
    placed = join_hot(join_hot(f, s, "scan_id", "id"), r, "repository_id", "id")
    return placed.select(F.col("id").alias("finding_id"), link.alias("url")).where("url is not null")


def stored(findings: DataFrame) -> DataFrame:
    """As the sink keeps them: empty text and zero become null, ``patch_available`` is never null."""
    cols = []
    for name, kind in findings.dtypes:
        c = F.col(name)
        if name == "patch_available":
            c = F.coalesce(c, F.lit(False))
        elif kind == "string" and name not in ("id", "scan_id", "severity", "title", "description"):
            c = blank_to_null(c)
        elif kind in ("int", "bigint"):
            c = zero_to_null(c)
        cols.append(c.alias(name))
    return findings.select(cols)
