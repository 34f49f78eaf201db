import pytest
from pyspark.sql import functions as F

from codequarry.functions.redaction import redact, redaction_count
from codequarry.functions.text import split_lines
from codequarry.functions.urls import canonical_url, source_url
from codequarry.functions.versions import in_affected_range, is_older


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\r\nb\rc", "\n\n", "a\x0bb\x0cc\x1cd\x85e f ", "no end\n\nx"])
def test_lines_are_pythons(spark, text):
    assert one(spark, split_lines(F.lit(text))) == text.splitlines()


@pytest.mark.parametrize(
    "a, b, older",
    [("4.17.10", "4.17.12", True), ("4.17.21", "4.17.12", False), ("1.0.0", "1.0", False), ("x", "1.0", False), ("^1.2.0", "1.10", True), (None, "1", False), ("1.9-beta", "1.10.0", True)],
)
def test_versions(spark, a, b, older):
    assert one(spark, is_older(F.lit(a).cast("string"), F.lit(b))) is older


def test_ranges_ignore_lower_bounds(spark):
    assert one(spark, in_affected_range(F.lit("0.21"), F.lit(">=1.0.0,<1.6.0"))) is True
    assert one(spark, in_affected_range(F.lit("7.5.2"), F.lit("<5.7.2,>=6.0.0 <6.3.1,>=7.0.0 <7.5.2"))) is False


@pytest.mark.parametrize(
    "url, good",
    [
        ("https://github.com/o/r", True), ("https://www.github.com/o/r.git/", True), ("http://github.com/o/r", False), ("https://github.com/o", False),
        ("https://u:p@github.com/o/r", False), ("https://github.com:8080/o/r", False), ("https://github.com/o/r?x=1", False), ("https://evil.com/o/r", False),
        ("https://github.com/o/..", False), ("", False), (None, False), ("https://github.com/o/r/tree", False),
    ],
)
def test_canonical_urls(spark, url, good):
    assert one(spark, canonical_url(F.lit(url).cast("string"))) == ("https://github.com/o/r.git" if good else None)


def test_source_links(spark):
    link = lambda p, r, a, b: one(spark, source_url(F.lit("https://github.com/o/r"), F.lit(p), F.lit(r), F.lit(a), F.lit(b)))
    assert link("/a b\\..\\c~*.py", "main", 3, 9) == "https://github.com/o/r/blob/main/a%20b/c~%2A.py#L3-L9"
    assert link("x.py", "main", 3, 3).endswith("#L3") and link("x.py", "a..b", 1, 1) is None and link("..", "main", 1, 1) is None


def test_redaction_is_idempotent(spark):
    text = "password = 'hunter22'; token: \"" + "a1" * 12 + "\" postgres://u:p@h/db AKIA" + "A" * 16 + "\n-----BEGIN PRIVATE KEY-----\nx\n-----END PRIVATE KEY-----"
    once = one(spark, redact(F.lit(text)))
    assert once == one(spark, redact(F.lit(once))) and "hunter22" not in once and "AKIA" not in once
    assert one(spark, redaction_count(F.lit(once))) == 5
