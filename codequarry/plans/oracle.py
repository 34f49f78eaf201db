"""The SQL counterpart of each query that has one, written for DuckDB."""

from __future__ import annotations

from codequarry.functions.redaction import PATTERNS
from codequarry.operators import config_audit, linerules, scripts
from codequarry.operators.dedupe import ANALYZER_RANK, GENERIC_TITLES, SEVERITY_RANK
from codequarry.operators.findings import SAST_CATEGORIES, SECURITY_CATEGORIES
from codequarry.sources import files


def q(text: str) -> str:
    """A SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def _case(column: str, table: dict, default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in table.items()) + f" ELSE {default} END"


SEV = f"CASE WHEN lower(trim(severity)) IN {_in(SEVERITY_RANK)} THEN lower(trim(severity)) ELSE 'info' END"
SECURITY = f"coalesce(category IN {_in(SECURITY_CATEGORIES)}, false)"
DOMAIN = (
    "CASE WHEN analyzer = 'sca' THEN 'dependencies' WHEN analyzer = 'secret_scanner' THEN 'secrets' WHEN analyzer = 'iac' THEN 'iac' "
    f"WHEN category IN {_in(SAST_CATEGORIES)} THEN 'sast' ELSE 'quality' END"
)
CONF = "coalesce(nullif(confidence, 0), 50)"
F_ = "f AS (SELECT DISTINCT id, scan_id, severity, category, analyzer, confidence, patch_available FROM findings WHERE id IS NOT NULL)"
CURRENT = """cs AS (SELECT id, repository_id, status, started_at, completed_at, commit_sha, branch FROM scans WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY CASE status WHEN 'pending' THEN 0 WHEN 'running' THEN 1 WHEN 'completed' THEN 2
  WHEN 'failed' THEN 3 ELSE -1 END DESC, completed_at DESC NULLS LAST,
  repository_id DESC NULLS LAST, started_at DESC NULLS LAST, commit_sha DESC NULLS LAST, branch DESC NULLS LAST) = 1)"""
OWNED = """o AS (SELECT DISTINCT user_id, r.id AS repository_id FROM repositories r JOIN projects p ON p.id = r.project_id)"""
SUMMARY = f"""s AS (SELECT scan_id, count(*) AS total, {", ".join(f"count(*) FILTER (sev = '{s}') AS {s}" for s in SEVERITY_RANK)},
  count(*) FILTER (sec) AS security, count(*) FILTER (NOT sec) AS quality, count(*) FILTER (confidence >= 80) AS high_confidence,
  count(*) FILTER (patch_available) AS fixable, count(*) FILTER (a = 'sca') AS dependency, count(*) FILTER (a = 'secret_scanner') AS secret,
  count(*) FILTER (a = 'iac') AS iac, count(*) FILTER (a NOT IN ('sca', 'secret_scanner', 'iac') AND sec) AS sast,
  CAST(sum({CONF}) AS BIGINT) AS confidence_sum
  FROM (SELECT *, {SEV} AS sev, {SECURITY} AS sec, coalesce(analyzer, '') AS a FROM f) WHERE scan_id IS NOT NULL GROUP BY scan_id)"""
GRADE = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END"
SCORED = f"""sc AS (SELECT *, {GRADE} AS grade FROM (SELECT scan_id, total, CAST(greatest(0, round_even(100 - least(
  (20 * critical + 10 * high + 4 * medium + low) * CASE WHEN confidence_sum / total >= 80 THEN 1.0 WHEN confidence_sum / total >= 50 THEN 0.75 ELSE 0.5 END,
  100), 0)) AS INTEGER) AS score FROM s))"""
TOP = f"""top AS (SELECT scan_id, id AS finding_id, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY coalesce(confidence, 0) DESC, id) AS INTEGER) AS position
  FROM f WHERE {SEV} IN ('critical', 'high') AND scan_id IS NOT NULL)"""
FP = """substr(sha256(CASE WHEN coalesce(category, 'quality') = 'quality' AND (coalesce(rule_id, '') LIKE 'QA%' OR coalesce(rule_id, '') = '')
  THEN 'quality:' || place ELSE coalesce(nullif(coalesce(rule_id, ''), ''), replace(lower(title), ' ', '_')) || ':' || place || ':' || coalesce(sink_label, '') END), 1, 16)"""
PLACED = r"""pl AS (SELECT *, replace(coalesce(file_path, ''), '\', '/') || ':' || CAST(coalesce(line_number, 0) - coalesce(line_number, 0) % 5 AS VARCHAR) AS place
  FROM findings)"""
EXT = r"lower(regexp_extract(path, '\.([^./\\]+)$', 1))"
LINES = (
    r"src AS MATERIALIZED (SELECT DISTINCT file_id, replace(coalesce(relative_path, ''), '\', '/') AS path, content FROM source_files WHERE content IS NOT NULL), "
    r"cut AS (SELECT file_id, path, regexp_split_to_array(content, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS a FROM src), "
    r"kept AS (SELECT file_id, path, CASE WHEN a[-1] = '' THEN a[:len(a) - 1] ELSE a END AS a FROM cut), "
    rf"l AS MATERIALIZED (SELECT file_id, path, {EXT} AS ext, CAST(unnest(range(1, len(a) + 1)) AS INTEGER) AS line_no, unnest(a) AS line FROM kept)"
)
JS = _in(linerules.JS)


def _matches(pattern: str, column: str = "line") -> str:
    return f"regexp_matches({column}, {q(pattern)})"


def _near(flag: str, a: int, b: int) -> str:
    return f"max(CAST({flag} AS INTEGER)) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING) = 1"


def _generic() -> str:
    parts = []
    for r in linerules.RULES:
        where = _matches(r.pattern)
        if r.extensions:
            where += f" AND ext IN {_in(r.extensions)}"
        if r.title in linerules.LEFT_TO_ANALYZERS:
            where += f" AND ext NOT IN {_in(linerules.PY + linerules.JS)}"
        parts.append(f"SELECT file_id, line_no, {q(r.title)} AS title, {q(r.severity)} AS severity FROM l WHERE {where}")
    return " UNION ALL ".join(parts)


def _redacted(column: str) -> str:
    for pattern, mark in PATTERNS:
        column = f"regexp_replace({column}, {q(pattern)}, {q(mark)}, 'g')"
    return column


def _label(label: str, column: str) -> str:
    return f"CASE WHEN CAST({column} AS VARCHAR) <> '' THEN {q(label + ': ')} || CAST({column} AS VARCHAR) END"


REVIEW = "concat_ws(chr(10), " + ", ".join([
    _label("Rule", "rule_id"), _label("Title", "title"), _label("Severity", "severity"), _label("Category", "category"), _label("Analyzer", "analyzer"),
    _label("Location", "(file_path || CASE WHEN line_number > 0 THEN ':' || line_number ELSE '' END)"), _label("Description", "description"),
    _label("Snippet", "code_snippet"), f"CASE WHEN evidence IS DISTINCT FROM code_snippet THEN {_label('Evidence', 'evidence')} END",
    _label("Source", "source_label"), _label("Sink", "sink_label"), _label("Dependency", "dependency_name"),
]) + ")"
URL = r"'^https://(?i:[w.]*git[.]example)/([A-Za-z0-9](?:[A-Za-z0-9-]{0,37}[A-Za-z0-9])?)/([A-Za-z0-9][A-Za-z0-9_.-]{0,98}?)(?:\.git)?/*$'"
CANON = f"CASE WHEN regexp_matches(trim(url), {URL}) THEN 'https://git.example/' || regexp_extract(trim(url), {URL}, 1) || '/' || regexp_extract(trim(url), {URL}, 2) END"


def _version(c: str) -> str:
    bare = rf"regexp_replace(regexp_replace(trim({c}), '^[\^~>=<! v]+', ''), '[A-Za-z+\-].*$', '')"
    part = lambda i: f"TRY_CAST(string_split({bare}, '.')[{i}] AS INTEGER)"
    return f"CASE WHEN {part(1)} IS NOT NULL THEN [{part(1)}, coalesce({part(2)}, 0), coalesce({part(3)}, 0)] END"


HEADS = " OR ".join(f"contains(head, {q(h.upper())})" for h in files.GENERATED_HEADS)
LANG = "CASE ext " + " ".join(f"WHEN {q(e)} THEN {q(n)}" for e, n in files.LANGUAGES.items()) + " END"
MODULE = r"replace(regexp_replace(regexp_replace(replace(relative_path, '\', '/'), '(?i)\.py$', ''), '(^|/)__init__$', ''), '/', '.')"
EDGES = rf"""py AS MATERIALIZED (SELECT DISTINCT repository_id, {MODULE} AS src, content FROM source_files
    WHERE lower(relative_path) LIKE '%.py' AND repository_id IS NOT NULL),
  m AS (SELECT DISTINCT repository_id, src AS dst FROM py),
  il AS (SELECT repository_id, src, unnest(regexp_split_to_array(content, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')) AS line FROM py WHERE content IS NOT NULL),
  im AS (SELECT DISTINCT repository_id, src, regexp_matches(line, '^\s*from\s+(\.*)([\w.]*)\s+import\b') AS is_from, length(regexp_extract(line, '^\s*from\s+(\.*)([\w.]*)\s+import\b', 1)) AS dots,
    regexp_extract(line, '^\s*from\s+(\.*)([\w.]*)\s+import\b', 2) AS tail, unnest([regexp_extract(x, '^\s*([\w.]+)', 1) FOR x IN string_split(regexp_extract(line, '^\s*import\s+([\w.]+(?:\s+as\s+\w+)?(?:\s*,\s*[\w.]+(?:\s+as\s+\w+)?)*)', 1), ',')]) AS plain
    FROM il WHERE regexp_matches(line, '^\s*from\s+(\.*)([\w.]*)\s+import\b|^\s*import\s+([\w.]+)')),
  tg AS (SELECT DISTINCT repository_id, src, CASE WHEN NOT is_from THEN plain WHEN dots = 0 THEN tail ELSE base || CASE WHEN base <> '' AND tail <> '' THEN '.' ELSE '' END || tail END AS target
    FROM (SELECT *, array_to_string(string_split(src, '.')[:greatest(len(string_split(src, '.')) - dots, 0)], '.') AS base FROM im)),
  px AS (SELECT repository_id, src, target, array_to_string(string_split(target, '.')[:n], '.') AS dst
    FROM (SELECT *, unnest(range(1, len(string_split(target, '.')) + 1)) AS n FROM tg WHERE target <> '')),
  e AS MATERIALIZED (SELECT DISTINCT repository_id, src, dst FROM (SELECT px.repository_id, px.src, px.target, arg_max(px.dst, length(px.dst)) AS dst
    FROM px JOIN m ON m.repository_id = px.repository_id AND m.dst = px.dst GROUP BY 1, 2, 3))"""

SUPPRESSED = r"(?i)(?:#|//|/\*|<!--)\s*pragma:\s*ignore\s+([A-Z0-9_]+)(?:\s+reason:\s*(.+?))?(?:\s*-->|\s*\*/)?$"


def _patch(field: str) -> str:
    return f"CASE WHEN json_valid(patch_text) THEN CASE WHEN patch_text ->> '$.file_path' IS NOT NULL THEN patch_text ->> '$.{field}' END END"


def _count_hits(column: str) -> str:
    """How often line rules match in the text of a column, by the extension ``ext``."""
    lines, parts = rf"regexp_split_to_array({column}, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')", []
    for r in linerules.RULES:
        n = f"len([x FOR x IN {lines} IF regexp_matches(x, {q(r.pattern)})])"
        parts.append(f"CASE WHEN ext IN {_in(r.extensions)} THEN {n} ELSE 0 END" if r.extensions else n)
    return "(" + " + ".join(parts) + ")"


def _sinks() -> str:
    """The first sink of each script line with its context, as ``k``."""
    first = "CASE " + " ".join(
        f"WHEN {_matches(p)}{' AND child' if rule == 'JS003' else ''} THEN {i}" for i, (rule, p, _, _) in enumerate(scripts.SINKS)
    ) + " END"
    table = ", ".join(f"({i}, {q(rule)}, {q(severity)})" for i, (rule, _, _, severity) in enumerate(scripts.SINKS))
    return f"""w AS (SELECT file_id, line_no, line, {_near(_matches(scripts.SOURCES), 8, 8)} AS has_source, {_near(_matches(scripts.SANITIZERS), 8, 8)} AS has_sanitizer,
          {_near(_matches(scripts.CHILD_PROCESS), 30, 30)} OR {_matches("child_process|childProcess")} AS child FROM l WHERE ext IN {JS}),
        k AS (SELECT file_id, line_no, v.rule_id, v.severity AS s, has_source, has_sanitizer FROM (SELECT *, {first} AS i FROM w) x JOIN (VALUES {table}) v(i, rule_id, severity) USING (i))"""


SQL: dict[str, str] = {
    "p1_found": """
        WITH snap AS (
          SELECT id, max(repository_id) AS repo, max(completed_at) AS t FROM scans
          WHERE status = 'completed' AND completed_at IS NOT NULL AND repository_id IS NOT NULL GROUP BY id),
        pair AS (SELECT id AS scan_id, repo, lag(id) OVER (PARTITION BY repo ORDER BY t, id) AS prev_id FROM snap),
        f AS (SELECT DISTINCT scan_id, lower(trim(fingerprint)) AS fp, lower(trim(severity)) AS s, confidence AS c, line_number AS l,
                     patch_available AS p FROM findings WHERE trim(fingerprint) <> ''),
        new AS (SELECT pair.*, fp, s, c, l, p FROM pair JOIN f USING (scan_id) WHERE prev_id IS NOT NULL),
        old AS (SELECT pair.*, fp, s, c, l, p FROM pair JOIN f ON f.scan_id = prev_id)
        SELECT coalesce(new.repo, old.repo) AS repository_id, coalesce(new.scan_id, old.scan_id) AS scan_id,
               coalesce(new.fp, old.fp) AS fingerprint,
               CASE WHEN old.fp IS NULL THEN 'added' WHEN new.fp IS NULL THEN 'removed' ELSE 'changed' END AS change_type
        FROM new FULL JOIN old ON new.scan_id = old.scan_id AND new.fp = old.fp
        WHERE old.fp IS NULL OR new.fp IS NULL OR (new.s, new.c, new.l, new.p) IS DISTINCT FROM (old.s, old.c, old.l, old.p)""",
    "p1_values": """
        WITH snap AS (
          SELECT id, max(repository_id) AS repo, max(completed_at) AS t FROM scans
          WHERE status = 'completed' AND completed_at IS NOT NULL AND repository_id IS NOT NULL GROUP BY id),
        pair AS (SELECT id AS scan_id, repo, lag(id) OVER (PARTITION BY repo ORDER BY t, id) AS prev_id FROM snap),
        f AS (SELECT DISTINCT scan_id AS sid, lower(trim(fingerprint)) AS fp, lower(trim(severity)) AS s, confidence AS c, line_number AS l,
                     patch_available AS p FROM findings WHERE trim(fingerprint) <> '')
        SELECT repo AS repository_id, scan_id, n.fp AS fingerprint, o.s AS old_severity, o.c AS old_confidence, o.l AS old_line_number,
               o.p AS old_patch_available, n.s AS new_severity, n.c AS new_confidence, n.l AS new_line_number, n.p AS new_patch_available
        FROM pair JOIN f n ON n.sid = scan_id JOIN f o ON o.sid = prev_id AND o.fp = n.fp
        WHERE (n.s, n.c, n.l, n.p) IS DISTINCT FROM (o.s, o.c, o.l, o.p)""",
    "filter_equal": "SELECT DISTINCT id FROM findings WHERE severity = 'high' AND category = 'crypto' AND analyzer = 'regex'",
    "filter_security_group": f"SELECT DISTINCT id FROM findings WHERE category IN {_in(SECURITY_CATEGORIES)}",
    "filter_quality_group": f"SELECT DISTINCT id FROM findings WHERE category IS NULL OR category NOT IN {_in(SECURITY_CATEGORIES)}",
    "filter_confidence_floor": "SELECT DISTINCT id FROM findings WHERE confidence >= 75 OR confidence IS NULL",
    "owned_repositories": f"WITH {OWNED} SELECT * FROM o",
    "owned_scans": f"WITH {CURRENT}, {OWNED} SELECT user_id, repository_id, cs.id AS scan_id FROM cs JOIN o USING (repository_id)",
    "owned_finding_counts": f"""WITH {CURRENT}, {OWNED} SELECT user_id, repository_id, count(*) AS n FROM (SELECT DISTINCT id, scan_id FROM findings) f
        JOIN cs ON cs.id = f.scan_id JOIN o USING (repository_id) GROUP BY user_id, repository_id""",
    "repository_counts": """SELECT p.id AS project_id, count(r.id) AS n_repositories FROM (SELECT DISTINCT id FROM projects) p
        LEFT JOIN (SELECT DISTINCT id, project_id FROM repositories) r ON r.project_id = p.id GROUP BY p.id""",
    "newest_repository": """SELECT project_id, id AS repository_id FROM (SELECT DISTINCT id, project_id, created_at FROM repositories WHERE project_id IS NOT NULL)
        QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC NULLS LAST, id DESC) = 1""",
    "languages_found": f"""WITH x AS (SELECT DISTINCT repository_id, {EXT.replace('path', 'relative_path')} AS ext FROM source_files WHERE repository_id IS NOT NULL),
        n AS (SELECT DISTINCT repository_id, {LANG} AS language FROM x)
        SELECT repository_id, coalesce(string_agg(language, ',' ORDER BY language), '') AS languages FROM n GROUP BY repository_id""",
    "latest_scans": f"""WITH {CURRENT} SELECT repository_id, id AS scan_id, status FROM cs WHERE repository_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY started_at DESC NULLS LAST, id DESC) = 1""",
    "newest_scans": f"""WITH {CURRENT} SELECT repository_id, id AS scan_id, CAST(row_number() OVER (PARTITION BY repository_id
        ORDER BY started_at DESC NULLS LAST, id DESC) AS INTEGER) AS position FROM cs QUALIFY position <= 8""",
    "finding_projection": """SELECT DISTINCT id AS finding_id, coalesce(nullif(dependency_name, ''), title) AS package_name,
        CASE WHEN json_valid(patch_text) THEN patch_text ->> '$.file_path' END AS patch_file,
        CASE WHEN json_valid(patch_text) THEN CAST(patch_text ->> '$.start_line' AS INTEGER) END AS patch_start,
        CASE WHEN json_valid(patch_text) THEN patch_text ->> '$.replacement' END AS patch_replacement FROM findings""",
    "finding_details": "",
    "secret_view": """SELECT DISTINCT id, secret_type, redacted_value, severity, file_path, line_number, confidence, evidence FROM findings
        WHERE analyzer = 'secret_scanner' AND id IS NOT NULL""",
    "iac_view": """SELECT DISTINCT id, rule_id, title, severity, file_path, line_number, evidence, remediation FROM findings
        WHERE analyzer = 'iac' AND id IS NOT NULL""",
    "remediation_view": f"""SELECT DISTINCT id AS finding_id, why_risky, impact, remediation, fix_example, patch_available,
        {_patch('original')} AS patch_original, {_patch('replacement')} AS patch_replacement FROM findings WHERE id IS NOT NULL""",
    "sorted_findings": "SELECT DISTINCT id, scan_id FROM findings WHERE id IS NOT NULL ORDER BY id DESC",
    "flow_texts": """SELECT DISTINCT id, source_label || ' (line ' || coalesce(line_number, 0) || ') → ' || sink_label || ' (line ' || coalesce(line_number, 0) || ')' AS flow
        FROM findings WHERE source_label IS NOT NULL AND sink_label IS NOT NULL""",
    "remediated_findings": r"""WITH f AS (SELECT DISTINCT id, rule_id, why_risky, impact, remediation, fix_example, cwe, patch_available, line_number, code_snippet FROM findings WHERE id IS NOT NULL),
        r AS (SELECT rule_id, arg_min(why_risky, id) FILTER (why_risky <> '') AS w, arg_min(impact, id) FILTER (impact <> '') AS i, arg_min(remediation, id) FILTER (remediation <> '') AS m,
          arg_min(fix_example, id) FILTER (fix_example <> '') AS x, arg_min(cwe, id) FILTER (cwe <> '') AS c FROM f WHERE rule_id IS NOT NULL GROUP BY rule_id),
        j AS (SELECT f.*, w, i, m, x, c, CASE WHEN NOT coalesce(patch_available, false) AND line_number > 0 AND f.rule_id = 'PY008' AND regexp_matches(code_snippet, '^(\s*.*)yaml\.load\(([^,)]+)\)(.*)')
          THEN regexp_replace(code_snippet, '^(\s*.*)yaml\.load\(([^,)]+)\)(.*)', '\1yaml.safe_load(\2)\3') END AS made FROM f LEFT JOIN r USING (rule_id))
        SELECT id, rule_id, coalesce(nullif(why_risky, ''), w) AS why_risky, coalesce(nullif(impact, ''), i) AS impact, coalesce(nullif(remediation, ''), m) AS remediation,
          coalesce(nullif(fix_example, ''), x) AS fix_example, coalesce(nullif(cwe, ''), c) AS cwe, line_number, coalesce(patch_available, false) OR made IS NOT NULL AS patch_available,
          CASE WHEN made IS NOT NULL THEN code_snippet END AS patch_original, made AS patch_replacement FROM j""",
    "canonical_urls": f"SELECT DISTINCT id, {CANON} || '.git' AS canonical FROM repositories",
    "source_links": rf"""WITH {CURRENT}, f AS (SELECT DISTINCT id, scan_id, file_path, line_number, end_line FROM findings),
        x AS (SELECT f.id AS finding_id, {CANON} AS base, trim(coalesce(commit_sha, branch)) AS ref, line_number AS a, end_line AS b,
          [p FOR p IN string_split(replace(file_path, '\', '/'), '/') IF p NOT IN ('', '.', '..')] AS parts
          FROM f JOIN cs ON cs.id = f.scan_id JOIN (SELECT DISTINCT id, url FROM repositories) r ON r.id = cs.repository_id)
        SELECT finding_id, url FROM (SELECT finding_id, base || '/blob/' || ref || '/' || array_to_string([url_encode(p) FOR p IN parts], '/')
          || coalesce(CASE WHEN a > 0 THEN '#L' || a || CASE WHEN b > a THEN '-L' || b ELSE '' END END, '') AS url FROM x
          WHERE len(parts) > 0 AND regexp_matches(ref, '^[A-Za-z0-9_./-]{{1,250}}$') AND NOT regexp_matches(ref, '^\.|\.$|\.\.')) WHERE url IS NOT NULL""",
    "stored_nulls": """SELECT scan_id, count(nullif(confidence, 0)) AS n_confidence, count(nullif(line_number, 0)) AS n_line_number, count(nullif(category, '')) AS n_category,
        count(nullif(evidence, '')) AS n_evidence, count(*) AS n_patch_available FROM (SELECT DISTINCT id, scan_id, confidence, line_number, category, evidence FROM findings) GROUP BY scan_id""",
    "scan_summary": f"WITH {F_}, {SUMMARY} SELECT * FROM s",
    "score_from_counts": f"WITH {F_}, {SUMMARY}, {SCORED} SELECT scan_id, score, grade FROM sc",
    "score_from_findings": f"""WITH {F_} SELECT scan_id, CAST(greatest(0, round_even(100 - least(sum({_case(SEV, {"critical": 20, "high": 10, "medium": 4, "low": 1}, "0")}
        * CASE WHEN {CONF} >= 80 THEN 1.0 WHEN {CONF} >= 50 THEN 0.75 WHEN {CONF} >= 30 THEN 0.5 ELSE 0.0 END), 100), 0)) AS INTEGER) AS score
        FROM f WHERE scan_id IS NOT NULL GROUP BY scan_id""",
    "domain_breakdown": f"WITH {F_} SELECT scan_id, {DOMAIN} AS domain, count(*) AS n FROM f WHERE scan_id IS NOT NULL GROUP BY ALL",
    "category_counts": f"WITH {F_} SELECT scan_id, coalesce(nullif(category, ''), 'unknown') AS category, count(*) AS n FROM f WHERE scan_id IS NOT NULL GROUP BY ALL",
    "top_risks": f"WITH {F_}, {TOP} SELECT * FROM top WHERE position <= 5",
    "risk_summary": f"""WITH {F_}, {SUMMARY}, {SCORED}, {TOP} SELECT sc.scan_id, sc.total, sc.score, sc.grade, top.finding_id AS top_finding
        FROM sc LEFT JOIN top ON top.scan_id = sc.scan_id AND top.position = 1""",
    "severity_category_cube": f"""WITH {F_}, r AS (SELECT {SEV} AS s, coalesce(category, 'unknown') AS c FROM f)
        SELECT CASE WHEN grouping(s) = 1 THEN 'all' ELSE s END AS severity, CASE WHEN grouping(c) = 1 THEN 'all' ELSE c END AS category, count(*) AS n FROM r GROUP BY CUBE (s, c)""",
    "scan_diff": """WITH snap AS (SELECT id, max(repository_id) AS repo, max(completed_at) AS t FROM scans WHERE status = 'completed' AND completed_at IS NOT NULL
          AND repository_id IS NOT NULL GROUP BY id),
        pair AS (SELECT id AS new_scan, lag(id) OVER (PARTITION BY repo ORDER BY t, id) AS old_scan FROM snap),
        fp AS (SELECT DISTINCT scan_id, lower(trim(fingerprint)) AS k FROM findings WHERE trim(fingerprint) <> ''),
        o AS (SELECT old_scan, new_scan, k FROM pair JOIN fp ON fp.scan_id = old_scan), n AS (SELECT old_scan, new_scan, k FROM pair JOIN fp ON fp.scan_id = new_scan WHERE old_scan IS NOT NULL),
        j AS (SELECT coalesce(o.old_scan, n.old_scan) AS old_scan, coalesce(o.new_scan, n.new_scan) AS new_scan, o.k AS a, n.k AS b
          FROM o FULL JOIN n ON o.new_scan = n.new_scan AND o.k = n.k)
        SELECT old_scan, new_scan, count(*) FILTER (a IS NULL) AS n_new, count(*) FILTER (b IS NULL) AS n_resolved, count(*) FILTER (a = b) AS n_unchanged FROM j GROUP BY ALL""",
    "fingerprints": f"WITH {PLACED} SELECT DISTINCT id, {FP} AS computed FROM pl",
    "merged_findings": f"""WITH {PLACED}, d AS (SELECT DISTINCT scan_id, {FP} AS fp, id, rule_id, category, title, severity, confidence, evidence, code_snippet, source_label,
          {_case("analyzer", ANALYZER_RANK, "0")} AS rank, {_case("lower(trim(severity))", SEVERITY_RANK, "0")} AS sr FROM pl WHERE id IS NOT NULL),
        g AS (SELECT scan_id, fp, {", ".join(f"first({c} ORDER BY rank DESC, coalesce(confidence, -1) DESC, id) AS {c}" for c in ("id", "rule_id", "category", "title"))},
          max(sr) AS sr, max(confidence) AS confidence, count(DISTINCT id) AS merged,
          first(title ORDER BY rank DESC, coalesce(confidence, -1) DESC, id) FILTER (title NOT IN {_in(GENERIC_TITLES)}) AS telling,
          {", ".join(f"first({c} ORDER BY rank DESC, coalesce(confidence, -1) DESC, id) FILTER ({c} <> '') AS {c}" for c in ("evidence", "code_snippet", "source_label"))}
          FROM d GROUP BY scan_id, fp)
        SELECT scan_id, fp AS fingerprint, id, rule_id, CASE WHEN title IN {_in(GENERIC_TITLES)} AND telling IS NOT NULL AND coalesce(category, 'quality') = 'quality' THEN telling ELSE title END AS title,
          CASE sr {" ".join(f"WHEN {v} THEN '{k}'" for k, v in SEVERITY_RANK.items())} ELSE 'info' END AS severity, confidence, CASE WHEN confidence >= 80 THEN 'high' WHEN confidence >= 50 THEN 'medium' ELSE 'low' END AS confidence_level, merged, evidence, code_snippet, source_label FROM g""",
    "rule_enrichment": """WITH r AS (SELECT rule_id, arg_min(base_confidence, rule_no) AS b, arg_min({'x': cwe}, rule_no).x AS cwe, arg_min({'x': language}, rule_no).x AS language
          FROM rule_registry WHERE rule_id IS NOT NULL GROUP BY rule_id),
        f AS (SELECT DISTINCT id, rule_id, cwe, language, confidence FROM findings)
        SELECT id, coalesce(f.cwe, r.cwe) AS cwe, coalesce(f.language, r.language) AS language,
          CASE WHEN confidence = 50 AND b IS NOT NULL THEN b ELSE coalesce(confidence, 50) END AS base_confidence FROM f LEFT JOIN r USING (rule_id)""",
    "confidence_scores": """WITH r AS (SELECT rule_id, arg_min(base_confidence, rule_no) AS b FROM rule_registry WHERE rule_id IS NOT NULL GROUP BY rule_id),
        f AS (SELECT DISTINCT id, rule_id, cwe, language, confidence, analyzer, source_label, sink_label FROM findings),
        s AS (SELECT id, CAST(greatest(0, least(100, CASE WHEN confidence = 50 AND b IS NOT NULL THEN b ELSE coalesce(confidence, 50) END + 10
          + CASE WHEN source_label IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN source_label IS NOT NULL AND sink_label IS NOT NULL THEN 15 ELSE 0 END
          + CASE WHEN analyzer IN ('ast', 'dataflow') THEN 10 WHEN analyzer IS NULL THEN 0 ELSE -15 END)) AS INTEGER) AS score FROM f LEFT JOIN r USING (rule_id))
        SELECT id, score, CASE WHEN score >= 80 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END AS level FROM s""",
    "review_hashes": f"SELECT DISTINCT id AS finding_id, sha256({_redacted(f'substr({REVIEW}, 1, 12000)')} || chr(10) || 'version=1') AS request_hash FROM findings",
    "redacted_snippets": rf"""SELECT code_snippet, redacted, CAST(len(regexp_extract_all(redacted, '\[REDACTED_[A-Z_]+\]')) AS INTEGER) AS n_redacted
        FROM (SELECT code_snippet, {_redacted("code_snippet")} AS redacted FROM (SELECT DISTINCT code_snippet FROM findings WHERE code_snippet IS NOT NULL))""",
    "patch_status": rf"""WITH p AS (SELECT DISTINCT id, code_snippet AS c, CASE WHEN json_valid(patch_text) THEN patch_text ->> '$.original' END AS o,
          CASE WHEN json_valid(patch_text) THEN patch_text ->> '$.replacement' END AS r, patch_text, lower(regexp_extract(coalesce(file_path, ''), '\.([^./\\]+)$', 1)) AS ext
          FROM findings WHERE patch_text IS NOT NULL),
        b AS (SELECT *, CASE WHEN instr(c, o) > 0 THEN substr(c, 1, instr(c, o) - 1) || r || substr(c, instr(c, o) + length(o)) END AS after FROM p),
        a AS (SELECT CASE WHEN c IS NOT NULL THEN {_count_hits("c")} END AS n0, CASE WHEN after IS NOT NULL THEN {_count_hits("after")} END AS n1 FROM b)
        SELECT CASE WHEN n1 IS NULL OR n1 >= n0 THEN 'failed' WHEN n1 = 0 THEN 'verified' ELSE 'partially_verified' END AS status, count(*) AS n FROM a GROUP BY 1""",
    "classified_files": rf"""WITH d AS (SELECT DISTINCT file_id, replace(relative_path, '\', '/') AS path, content, coalesce(is_binary, false) AS bin FROM source_files),
        x AS (SELECT *, {EXT} AS ext, upper(substr(content, 1, 1000)) AS head, regexp_split_to_array(content, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS a FROM d),
        y AS (SELECT *, {LANG} AS language, CASE WHEN a[-1] = '' THEN a[:len(a) - 1] ELSE a END AS k FROM x),
        z AS (SELECT file_id, language, ext, bin, content, regexp_matches(string_split(path, '/')[-1], {q(files.GENERATED_NAME)}) OR coalesce({HEADS}, false) AS generated,
          coalesce(language IN ('javascript', 'typescript') AND len([s FOR s IN k IF length(s) > 500]) > 0.2 * len(k), false) AS minified FROM y)
        SELECT file_id, language, generated, minified, NOT (ext IN {_in(files.BINARY)} OR bin) AND NOT generated AND NOT minified
          AND coalesce(language IN {_in(files.ANALYZED)}, false) AND content IS NOT NULL AS scannable FROM z""",
    "line_counts": f"WITH {LINES} SELECT file_id, max(line_no) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM l GROUP BY file_id",
    "line_rule_hits": f"WITH {LINES} {_generic()}",
    "weak_hashes": rf"WITH {LINES} SELECT file_id, line_no, lower(regexp_extract(line, {q(linerules.WEAK_HASH)}, 1)) AS algorithm FROM l WHERE ext = 'py' AND {_matches(linerules.WEAK_HASH)}",
    "nearby_context": f"""WITH {LINES}, j AS (SELECT file_id, line_no, {_matches(scripts.SOURCES)} AS s FROM l WHERE ext IN {JS}),
        w AS (SELECT file_id, {_near("s", 8, 8)} AS a, {_near("s", 30, 30)} AS b, {_near("s", 15, 2)} AS c FROM j)
        SELECT file_id, count(*) FILTER (a) AS n_near, count(*) FILTER (b) AS n_wide, count(*) FILTER (c) AS n_back FROM w GROUP BY file_id""",
    "previous_assignment": rf"""WITH {LINES}, j AS (SELECT file_id, line_no, nullif(regexp_extract(line, '^\s*(?:const|let|var)\s+(\w+)\s*=', 1), '') AS v FROM l WHERE ext IN {JS}),
        w AS (SELECT file_id, line_no, last_value(v IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AS assigned FROM j)
        SELECT * FROM w WHERE assigned IS NOT NULL""",
    "suppressions": rf"""WITH {LINES} SELECT file_id, line_no, upper(regexp_extract(line, {q(SUPPRESSED)}, 1)) AS rule_id,
        nullif(trim(regexp_extract(line, {q(SUPPRESSED)}, 2)), '') AS reason FROM l WHERE regexp_matches(line, {q(SUPPRESSED)})""",
    "script_sinks": f"""WITH {LINES}, {_sinks()} SELECT file_id, line_no, rule_id, CASE WHEN has_source AND NOT has_sanitizer THEN CASE s WHEN 'medium' THEN 'high' ELSE s END
        WHEN has_sanitizer THEN CASE s WHEN 'high' THEN 'medium' WHEN 'medium' THEN 'low' ELSE s END ELSE s END AS severity, has_source, has_sanitizer FROM k""",
    "script_secrets": f"WITH {LINES} SELECT file_id, line_no FROM l WHERE ext IN {JS} AND {_matches(scripts.SECRET)}",
    "script_quality": rf"""WITH {LINES}, j AS (SELECT file_id, line_no, line, regexp_replace(regexp_replace(regexp_replace(regexp_extract(line, '\bconsole\s*\.\s*\w+\s*\((.+)', 1),
          '''[^'']*''', '''''', 'g'), '"[^"]*"', '""', 'g'), '`[^`]*`', '``', 'g') AS bare FROM l WHERE ext IN {JS} AND NOT regexp_matches(trim(line), '^(//|\*)')),
        r AS (SELECT file_id, line_no, CASE WHEN {_matches(scripts.DEBUGGER)} THEN 'QA003' WHEN {_matches(scripts.CONSOLE)} THEN CASE WHEN {_matches(scripts.SENSITIVE, "bare")} THEN 'SEC002' ELSE 'QA003' END END AS rule_id FROM j)
        SELECT file_id, line_no, rule_id, CASE rule_id WHEN 'SEC002' THEN 'medium' ELSE 'low' END AS severity FROM r WHERE rule_id IS NOT NULL""",
    "analyzer_union": rf"""WITH {LINES}, {_sinks()}, u AS (SELECT file_id, title AS what FROM ({_generic()}) UNION ALL
        SELECT file_id, 'CRY001' FROM l WHERE ext = 'py' AND {_matches(linerules.WEAK_HASH)} UNION ALL SELECT file_id, rule_id FROM k UNION ALL
        SELECT file_id, 'SEC001' FROM l WHERE ext IN {JS} AND {_matches(scripts.SECRET)} UNION ALL
        SELECT file_id, 'QA003' FROM l WHERE ext IN {JS} AND NOT regexp_matches(trim(line), '^(//|\*)') AND ({_matches(scripts.DEBUGGER)} OR {_matches(scripts.CONSOLE)}))
        SELECT what, count(*) AS n, count(DISTINCT file_id) AS n_files FROM u GROUP BY what""",
    "configuration_audit": rf"""WITH {LINES}, t AS (SELECT * FROM l WHERE ext = 'tf' AND NOT regexp_matches(trim(line), '^(#|//)') AND NOT regexp_matches(path, '(^|/)(?:\.git|node_modules|\.venv|venv|__pycache__|\.next|dist|build|target|\.tox)/'))
        SELECT file_id, line_no, 'IAC012' AS rule_id, 'high' AS severity, 90 AS confidence FROM t WHERE {_matches(config_audit.OPEN_INGRESS)} UNION ALL
        SELECT file_id, line_no, 'IAC013', 'high', 80 FROM t WHERE {_matches(config_audit.TERRAFORM_SECRET)}
          AND NOT regexp_matches(regexp_extract(line, {q(config_audit.TERRAFORM_SECRET)}, 1), '^(\$\{{|var\.)')""",
    "locked_dependencies": r"""WITH d AS (SELECT DISTINCT file_id, lower(string_split(replace(relative_path, '\', '/'), '/')[-1]) AS name, content FROM source_files WHERE content IS NOT NULL
          AND NOT regexp_matches(replace(relative_path, '\', '/'), '(^|/)(?:\.git|node_modules|\.venv|venv|__pycache__|\.next|dist|build|target|\.tox)/') AND len(string_split(replace(relative_path, '\', '/'), '/')) <= 4),
        n AS (SELECT file_id, unnest(map_entries(from_json(content, '{"packages":"MAP(VARCHAR, JSON)"}').packages)) AS e FROM d WHERE name = 'package-lock.json' AND json_valid(content)),
        g AS (SELECT file_id, unnest(regexp_split_to_array(content, '\r\n|\n')) AS line FROM d WHERE name = 'go.sum'),
        p AS (SELECT file_id, unnest(regexp_extract_all(content, '\[\[package\]\]\s*\r?\nname = "([^"]+)"\r?\nversion = "([^"]+)"')) AS b FROM d WHERE name = 'poetry.lock')
        SELECT DISTINCT * FROM (SELECT file_id, string_split(e.key, 'node_modules/')[-1] AS name, e.value ->> '$.version' AS version, 'npm' AS ecosystem,
          NOT coalesce(CAST(e.value ->> '$.dev' AS BOOLEAN), false) AS is_direct FROM n WHERE e.key <> '' UNION ALL
        SELECT file_id, regexp_extract(line, '^(\S+) v([^\s/]+) h1:', 1), regexp_extract(line, '^(\S+) v([^\s/]+) h1:', 2), 'go', false FROM g WHERE regexp_matches(line, '^(\S+) v([^\s/]+) h1:') UNION ALL
        SELECT file_id, regexp_extract(b, 'name = "([^"]+)"', 1), regexp_extract(b, 'version = "([^"]+)"', 1), 'pypi', false FROM p)""",
    "outdated_dependencies": f"""SELECT id, dependency_name, coalesce({_version("dependency_version")} < {_version("fixed_version")}, false) AS outdated
        FROM (SELECT DISTINCT id, dependency_name, dependency_version, fixed_version FROM findings WHERE dependency_name IS NOT NULL)""",
    "advisory_matches": f"""WITH r AS (SELECT dependency_name AS name, dependency_version AS version, advisory_id, fixed_version FROM findings WHERE dependency_name IS NOT NULL),
        d AS (SELECT DISTINCT name, version FROM r), a AS (SELECT advisory_id, name, max(fixed_version) AS fix FROM r WHERE advisory_id IS NOT NULL AND fixed_version IS NOT NULL GROUP BY ALL),
        j AS (SELECT d.name, d.version, advisory_id, CASE WHEN version IS NULL THEN 40 WHEN {_version("version")} < {_version("fix")} THEN 75 END AS confidence
          FROM d JOIN a ON lower(d.name) = lower(a.name)) SELECT * FROM j WHERE confidence IS NOT NULL""",
    "import_edges": f"WITH {EDGES} SELECT * FROM e",
    "import_components": f"""WITH RECURSIVE {EDGES}, r AS (SELECT repository_id, src, dst FROM e WHERE src <> dst UNION
          SELECT r.repository_id, r.src, e.dst FROM r JOIN e ON e.repository_id = r.repository_id AND e.src = r.dst),
        c AS (SELECT a.repository_id, a.src AS module, least(a.src, min(a.dst)) AS component FROM r a JOIN r b ON b.repository_id = a.repository_id AND b.src = a.dst AND b.dst = a.src
          WHERE a.src <> a.dst GROUP BY 1, 2)
        SELECT *, count(*) OVER (PARTITION BY repository_id, component) AS n_modules FROM c""",
    "import_cycles": f"""WITH RECURSIVE {EDGES}, p AS (
          SELECT repository_id, [src, dst] AS path, dst AS at FROM e WHERE dst > src UNION ALL
          SELECT p.repository_id, list_append(path, e.dst), e.dst FROM p JOIN e ON e.repository_id = p.repository_id AND e.src = p.at
          WHERE e.dst > path[1] AND NOT list_contains(path, e.dst) AND len(path) < 4)
        SELECT DISTINCT p.repository_id, array_to_string(path, ' > ') AS members FROM p JOIN e ON e.repository_id = p.repository_id AND e.src = p.at AND e.dst = path[1]""",
}
SQL["finding_details"] = f"""SELECT f.* EXCLUDE (patch_text), url AS source_url, {_patch("file_path")} AS patch_file_path, CAST({_patch("start_line")} AS INTEGER) AS patch_start_line,
    CAST({_patch("end_line")} AS INTEGER) AS patch_end_line, {_patch("original")} AS patch_original, {_patch("replacement")} AS patch_replacement, {_patch("reason")} AS patch_reason
    FROM (SELECT DISTINCT * FROM findings WHERE id IS NOT NULL) f LEFT JOIN ({SQL["source_links"]}) l ON l.finding_id = f.id"""
