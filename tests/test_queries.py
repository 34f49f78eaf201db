"""Every query of the catalogue against its SQL on the smallest tables."""

import pytest
from oracle_check import compare, connect

from codequarry.plans import catalog, oracle

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(ROOT)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in oracle.SQL])
def test_query_equals_sql(spark, duck, name):
    assert compare(spark, duck, ROOT, name, catalog.QUERIES[name], oracle.SQL[name]).startswith("ok")


COLUMNS = {
    "markup_provenance": ["file_id", "line_no", "source_class", "severity", "confidence_delta"],
    "python_flows": ["file_id", "path", "line_no", "rule_id", "severity", "tainted", "sanitized"],
    "python_quality": ["file_id", "line_no", "rule", "name"],
    "unused_imports": ["repository_id", "path", "line_no", "name", "module"],
}


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in oracle.SQL])
def test_query_without_sql_runs_and_repeats_nothing(spark, name):
    """These need a parser or look-around; tests/test_rules.py has their expected rows."""
    got = catalog.QUERIES[name](spark, ROOT)
    rows = got.collect()
    assert got.columns == COLUMNS[name] and len(rows) == len(set(rows))
