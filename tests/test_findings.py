import pytest
from pyspark.sql import functions as F

from codequarry.operators import confidence, dedupe, findings, review, summary
from codequarry.sources import sinks

COLS = "id string, scan_id string, severity string, category string, analyzer string, confidence int, patch_available boolean, other string"


@pytest.fixture
def four(spark):
    rows = [("1", "s", "high", "command_injection", "ast", 80, True, "x"), ("2", "s", "medium", "xss", "regex", 60, False, "x"),
            ("3", "s", "low", "debug", "regex", None, None, "x"), ("4", "s", "info", None, None, 0, None, "x")]
    return spark.createDataFrame(rows + rows[:2], COLS)


def test_groups_split_everything(four):
    ids = lambda **k: {r.id for r in findings.where(four, **k).collect()}
    assert ids(group="security") == {"1", "2"} and ids(group="quality") == {"3", "4"} and ids(group="odd") == {"1", "2", "3", "4"}
    assert ids(min_confidence=70) == {"1", "3"} and ids(severity="low", analyzer="") == {"3"}


def test_summary_counts_repeats_once(four):
    r = summary.scan_summary(four).first()
    assert (r.total, r.high, r.security, r.quality, r.high_confidence, r.fixable, r.sast, r.confidence_sum) == (4, 1, 2, 2, 1, 1, 2, 80 + 60 + 50 + 50)


def score(spark, counts):
    rows = [(str(i), "s", sev, "xss", "ast", 65, None, "") for i, sev in enumerate(s for s, n in counts.items() for _ in range(n))]
    return summary.score_from_counts(summary.scan_summary(spark.createDataFrame(rows, COLS))).first()


def test_score_rounds_half_even(spark):
    r = score(spark, {"critical": 1, "high": 2, "medium": 5, "low": 10, "info": 20})
    assert (r.score, r.grade) == (48, "F")
    assert score(spark, {"critical": 100, "high": 100}).score == 0


def test_score_of_findings(spark):
    rows = spark.createDataFrame([("1", "s", "low", "", "", 60, None, ""), ("2", "s", "low", "", "", 60, None, "")], COLS)
    assert summary.score_from_findings(rows).first().score == 98


def test_empty_tables(spark):
    none = spark.createDataFrame([], COLS)
    for f in (summary.scan_summary, summary.score_from_findings, summary.domain_breakdown, summary.category_counts, summary.top_risks, summary.risk_summary):
        assert f(none).count() == 0


def test_top_risks_order(spark):
    rows = [("b", "s", "high", "", "", 90, None, ""), ("a", "s", "critical", "", "", 80, None, ""), ("c", "s", "HIGH ", "", "", 90, None, ""), ("d", "s", "low", "", "", 99, None, "")]
    assert [r.finding_id for r in summary.top_risks(spark.createDataFrame(rows, COLS)).orderBy("position").collect()] == ["b", "c", "a"]


MERGE = """id string, scan_id string, rule_id string, category string, title string, description string, severity string, confidence int, file_path string,
line_number int, sink_label string, cwe string, language string, analyzer string, dependency_name string, advisory_id string, patch_text string, patch_available boolean,
source_label string, data_flow_text string, why_risky string, impact string, remediation string, fix_example string, evidence string, code_snippet string"""


def finding(i, line, rule="QA003", path="a.py", title="t", sev="low", conf=50, analyzer="regex", category="quality", **more):
    row = dict.fromkeys([c.split()[0] for c in MERGE.replace("\n", " ").split(",")])
    row |= {"id": str(i), "scan_id": "s", "rule_id": rule, "category": category, "title": title, "severity": sev, "confidence": conf, "file_path": path, "line_number": line, "analyzer": analyzer}
    return tuple((row | more).values())


def merged(spark, rows):
    return dedupe.merge_duplicates(spark.createDataFrame(rows, MERGE)).orderBy("file_path", "id").collect()


def test_fingerprint_value(spark):
    rows = spark.createDataFrame([finding(1, 0)], MERGE)
    assert rows.select(dedupe.fingerprint().alias("f")).first().f == "84bf67afa8a542de"


def test_buckets_of_five_lines(spark):
    assert len(merged(spark, [finding(1, 2), finding(2, 10), finding(3, 1, path="b.py"), finding(4, 20, path="b.py")])) == 4
    assert len(merged(spark, [finding(1, 5), finding(2, 9)])) == 1 and len(merged(spark, [finding(1, 4), finding(2, 5)])) == 2


def test_merge_takes_the_best_of_each(spark):
    generic = dedupe.GENERIC_TITLES[0]
    rows = [finding(1, 1, conf=50, title=generic, analyzer="ast", evidence=""), finding(2, 2, conf=70, sev="high", title="told", evidence="e", patch_text="{}", patch_available=True), finding(2, 2, conf=70, sev="high", title="told", evidence="e")]
    (r,) = merged(spark, rows)
    assert (r.id, r.confidence, r.severity, r.title, r.evidence, r.patch_text, r.merged) == ("1", 70, "high", "told", "e", "{}", 2)


def test_confidence_values(spark):
    value = lambda base, **k: spark.range(1).select(confidence.score(F.lit(base), **{n: F.lit(v) for n, v in k.items()}).alias("x")).first().x
    assert value(70, has_user_controlled_source=True, has_direct_flow=True, is_ast_confirmed=True) == 100
    assert value(70, is_ast_confirmed=True) == 90
    assert value(60, is_regex_only=True) == 55
    assert value(60, is_ast_confirmed=True, source_is_constant=True) == 50
    assert value(5, has_sanitizer=True, source_is_constant=True) == 0


def test_review_hash_is_stable_and_cached(spark):
    base = "id string, rule_id string, title string, severity string, category string, analyzer string, file_path string, line_number int, description string, code_snippet string, evidence string, source_label string, sink_label string, dependency_name string"
    row = ("1", None, "t", "high", None, None, "a.py", 3, "", "password = 'hunter22'", None, None, None, None)
    contexts = review.review_context(spark.createDataFrame([row, row], base))
    r = contexts.first()
    assert contexts.count() == 1 and "hunter22" not in r.context and "Rule" not in r.context and "a.py:3" in r.context
    reviews = spark.createDataFrame([("1", r.request_hash, "1", "2024-01-01", "a", "x"), ("1", r.request_hash, "1", "2024-01-02", "b", "y")], "finding_id string, request_hash string, analysis_version string, created_at string, id string, verdict string")
    assert review.uncached(contexts, reviews).count() == 0 and review.latest_reviews(reviews).first().verdict == "y"


def test_sink_turns_blank_and_zero_to_null(spark, tmp_path):
    rows = spark.createDataFrame([("1", "s", "", 0, None), ("2", "t", "x", 7, True)], "id string, scan_id string, evidence string, confidence int, patch_available boolean")
    sinks.write_findings(rows, str(tmp_path / "f"), buckets=4)
    r = sinks.read_scan(spark, str(tmp_path / "f"), "s", buckets=4).first()
    assert (r.evidence, r.confidence, r.patch_available) == (None, None, False)
    for state in ("pending", "running", "completed"):
        sinks.append_state(spark, str(tmp_path / "h"), "s", state)
    assert sinks.current_states(spark.read.parquet(str(tmp_path / "h"))).first().status == "completed"
