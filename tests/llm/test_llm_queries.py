import pytest
from codequarry.llm.queries import QUERIES, SQL
from oracle_check import compare, connect

ROOT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    if name in SQL:
        assert compare(spark, connect(ROOT), ROOT, name, QUERIES[name], SQL[name]).startswith("ok")
    else:
        assert QUERIES[name](spark, ROOT).count() > 0
