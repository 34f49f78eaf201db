"""Ordered redaction of credentials in review texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns in their order (the more specific first) and what takes their place.
PATTERNS = [
    (r"(?:postgresql|postgres|mysql|mariadb|mongodb|redis|mssql|sqlite)(?:\+\w+)?://[^:@\s]+:[^@\s]+@[^\s\"']+", "[REDACTED_DB_URL]"),
    (r"(?:A3T[A-Z0-9]|AKIA|ASIA|ABIA|ACCA|AROA|AIDA|AIPA|ANPA|ANVA|APKA)[A-Z0-9]{16}", "[REDACTED_KEY]"),
    (r"(?:aws_secret_access_key|AWS_SECRET_ACCESS_KEY)\s*[=:]\s*[\"']?[A-Za-z0-9/+]{40}[\"']?", "aws_secret_access_key = [REDACTED_KEY]"),
    (r"eyJ[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+", "[REDACTED_TOKEN]"),
    (r"(?i)(?:Bearer|Authorization:\s*Bearer)\s+[A-Za-z0-9\-_.~+/]{20,}", "Bearer [REDACTED_TOKEN]"),
    (r"(?:gh[pousr]|github_pat)_[A-Za-z0-9_]{36,}", "[REDACTED_TOKEN]"),
    (r"gho_[A-Za-z0-9]{36}", "[REDACTED_TOKEN]"),
    (
        r"(?i)(?:api[_\-\.]?key|api[_\-\.]?token|access[_\-\.]?token|secret[_\-\.]?key|private[_\-\.]?key|auth[_\-\.]?token|client[_\-\.]?secret)"
        r"\s*[=:]\s*[\"']?[A-Za-z0-9\-_./+]{16,}[\"']?",
        "api_key = [REDACTED_KEY]",
    ),
    (r"sk-[A-Za-z0-9\-_]{20,}", "[REDACTED_KEY]"),
    (r"sk-ant-[A-Za-z0-9\-_]{30,}", "[REDACTED_KEY]"),
    (r"(?i)(?:password|passwd|pass|pwd)\s*[=:]\s*[\"'][^\"']{4,}[\"']", 'password = "[REDACTED_PASSWORD]"'),
    (
        r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----[\s\S]+?-----END (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----",
        "[REDACTED_KEY]",
    ),
    (r"(?i)(?:secret|token|credential|auth)\s*[=:]\s*[\"'][A-Za-z0-9\-_./+=]{16,}[\"']", 'secret = "[REDACTED_SECRET]"'),
    (r"(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{20,}", "[REDACTED_KEY]"),
    (r"xox[baprs]-[A-Za-z0-9\-]{10,}", "[REDACTED_TOKEN]"),
]
PLACEHOLDER = r"\[REDACTED_(?:DB_URL|KEY|TOKEN|PASSWORD|SECRET|CREDENTIAL)\]"


def redact(text: Column) -> Column:
    """``text`` with every pattern's matches replaced, in order; doing it twice changes nothing."""
    return reduce(lambda t, p: F.regexp_replace(t, p[0], p[1]), PATTERNS, text)


def redaction_count(text: Column) -> Column:
    """Placeholders in a redacted text."""
    return F.regexp_count(text, F.lit(PLACEHOLDER))
