"""Line rules: one literal pattern each, evaluated together in one pass over the lines."""

from __future__ import annotations

from functools import reduce
from operator import add
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codequarry.functions.text import split_lines

PY, JS, JAVA, GO = ["py"], ["js", "jsx", "ts", "tsx"], ["java"], ["go"]


class Rule(NamedTuple):
    title: str
    severity: str
    extensions: list[str]
    pattern: str


# The rules, in their order. An empty list of extensions means every file.
RULES = [
    Rule("Unfinished-work marker", "info", [], r"(?i)\b(?:TODO|FIXME|HACK|XXX)\b"),
    Rule(
        "Possible hardcoded secret", "high", [],
        r"(?i)(?:API_KEY|SECRET_KEY|ACCESS_TOKEN|PASSWORD|PRIVATE_KEY|AUTH_TOKEN|CLIENT_SECRET|ENCRYPTION_KEY|DB_PASSWORD|DATABASE_PASSWORD)"
        r"\s*=\s*['\"][^'\"]{4,}['\"]",
    ),
    Rule("Broad exception handling (Python)", "medium", PY, r"\bexcept\s+Exception\s*:"),
    Rule("Bare except clause (Python)", "medium", PY, r"^\s*except\s*:"),
    Rule("Debug print statement (Python)", "low", PY, r"\bprint\s*\("),
    Rule("Assert statement in production code (Python)", "low", PY, r"^\s*assert\s+"),
    Rule(
        "Possible secret logged (Python)", "high", PY,
        r"(?i)(?:log(?:ging)?|logger)\s*\.\s*(?:debug|info|warning|error|critical|exception)\s*\(.*(?:password|secret|token|api.?key|private.?key)",
    ),
    Rule("console statement left in code (JavaScript/TypeScript)", "low", JS, r"\bconsole\s*\.\s*(?:log|debug|info|warn|error)\s*\("),
    Rule("debugger statement (JavaScript/TypeScript)", "low", JS, r"\bdebugger\b"),
    Rule("Hardcoded localhost URL (JavaScript/TypeScript)", "medium", JS, r"(?i)['\"]https?://(?:localhost|127\.0\.0\.1)(?::\d+)?"),
    Rule("Broad exception catch (Java)", "medium", JAVA, r"catch\s*\(\s*Exception\s+\w+\s*\)"),
    Rule("printStackTrace() call (Java)", "medium", JAVA, r"\.printStackTrace\s*\(\s*\)"),
    Rule(
        "Potential SQL injection via string concatenation (Java)", "high", JAVA,
        r"(?i)\"(?:SELECT|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER|EXEC)\s[^\"]*\"\s*\+",
    ),
    Rule("System.out.println() in production code (Java)", "low", JAVA, r"\bSystem\s*\.\s*out\s*\.\s*println\s*\("),
    Rule("Error return ignored with _ (Go)", "medium", GO, r",\s*_\s*:?="),
    Rule("fmt.Println in production code (Go)", "low", GO, r"\bfmt\s*\.\s*Println\s*\("),
    Rule("Possible hardcoded credential (Go)", "high", GO, r"(?i)(?:password|secret|apiKey|api_key|token)\s*:?=\s*\"[^\"]{4,}\""),
]
#: Where the structural analyzers do better, these are left to them.
LEFT_TO_ANALYZERS = {RULES[1].title, RULES[7].title, RULES[8].title}
#: The word that suppressing comments begin with.
MARK = "pragma"
WEAK_HASH = r"(?i)hashlib\s*\.\s*(md5|sha1)\s*\("


def generic_hits(lines: DataFrame, key: str = "file_id") -> DataFrame:
    """``key, path, line_no, title, severity, snippet`` for every line and rule that match."""
    hits = []
    for r in RULES:
        wanted = F.lit(True) if not r.extensions else F.col("extension").isin(r.extensions)
        if r.title in LEFT_TO_ANALYZERS:
            wanted = wanted & ~F.col("extension").isin(PY + JS)
        hits.append(F.when(wanted & F.col("line").rlike(r.pattern), F.struct(F.lit(r.title).alias("title"), F.lit(r.severity).alias("severity"))))
    found = lines.withColumn("hit", F.explode(F.array_compact(F.array(*hits))))
    return found.select(key, "path", "line_no", "hit.title", "hit.severity", F.trim("line").alias("snippet")).distinct()


def count_hits(text: Column, extension: Column) -> Column:
    """How often the line rules match in a text: what re-analysing a patched text counts. Null texts give null."""

    def count(rule: Rule) -> Column:
        matching = F.size(F.filter(split_lines(text), lambda line: line.rlike(rule.pattern)))
        return F.when(F.coalesce(extension.isin(rule.extensions), F.lit(False)), matching).otherwise(0) if rule.extensions else matching

    return F.when(text.isNotNull(), reduce(add, map(count, RULES)))


def weak_hashes(lines: DataFrame, parsing: DataFrame | None = None, key: str = "file_id") -> DataFrame:
    """``key, path, line_no, algorithm`` of MD5 and SHA-1 calls in Python files; with ``parsing`` only in files whose key it has."""
    name = F.lower(F.regexp_extract("line", WEAK_HASH, 1))
    hit = (F.col("extension") == "py") & F.col("line").rlike(WEAK_HASH) & ~is_suppressed(F.col("line"), "CRY001")
    found = lines.where(hit).select(key, "path", "line_no", name.alias("algorithm")).distinct()
    return found if parsing is None else found.join(parsing.select(key).distinct(), key, "left_semi")


def near(flag: Column, key: str, before: int, after: int) -> Column:
    """Whether any line from ``before`` lines back to ``after`` lines on has the flag; lines are numbered without gaps."""
    w = Window.partitionBy(key, "copy_no").orderBy("line_no").rowsBetween(-before, after)
    return F.coalesce(F.max(flag).over(w), F.lit(False))


def suppression(mark: str = MARK) -> str:
    """The pattern of the comments ``<mark>: ignore RULE [reason: ...]``."""
    return rf"(?i)(?:#|//|/\*|<!--)\s*{mark}:\s*ignore\s+([A-Z0-9_]+)(?:\s+reason:\s*(.+?))?(?:\s*-->|\s*\*/)?$"


def is_suppressed(line: Column, rule: Column | str, mark: str = MARK) -> Column:
    """Whether a line's own comment suppresses a rule on it. The other rules of the line still apply."""
    return F.upper(F.regexp_extract(line, suppression(mark), 1)) == (F.lit(rule) if isinstance(rule, str) else rule)


def suppressions(lines: DataFrame, key: str = "file_id", mark: str = MARK) -> DataFrame:
    """``key, line_no, rule_id, reason`` of the comments that suppress a rule, known or not."""
    pattern = suppression(mark)
    reason = F.nullif(F.trim(F.regexp_extract("line", pattern, 2)), F.lit(""))
    rule = F.upper(F.regexp_extract("line", pattern, 1))
    return lines.where(F.col("line").rlike(pattern)).select(key, "line_no", rule.alias("rule_id"), reason.alias("reason")).distinct()


def without_suppressed(hits: DataFrame, suppressed: DataFrame, key: str = "file_id") -> DataFrame:
    """The hits whose rule isn't suppressed on their line."""
    return hits.join(suppressed.select(key, "line_no", "rule_id"), [key, "line_no", "rule_id"], "left_anti")


def previous_value(value: Column, key: str, back: int = 15) -> Column:
    """The last non-null ``value`` of the at most ``back`` lines before a line: an as-of join as a row frame."""
    w = Window.partitionBy(key, "copy_no").orderBy("line_no").rowsBetween(-back, -1)
    return F.last(value, ignorenulls=True).over(w)
