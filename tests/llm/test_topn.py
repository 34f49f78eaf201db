import random

from codequarry.llm.topn import top_findings, top_n_per_group
from pyspark.sql import functions as F

SCHEMA = "id string, scan_id string, severity string, confidence int, rank_no int, _k string"


def brute(rows, n=10):
    order = {"critical": 0, "high": 1, "medium": 2, "low": 3}
    groups = {}
    for i, s, sev, conf, *_ in rows:
        if i is not None and s is not None:
            key = (order.get((sev or "").strip().lower(), 4), -(conf or 0))
            groups.setdefault(s, {})[i] = min(key, groups.get(s, {}).get(i, (9, 9)))
    return sorted((s, i, r) for s, items in groups.items() for r, (i, _) in enumerate(sorted(items.items(), key=lambda x: (*x[1], x[0]))[:n], 1))


def test_against_brute_force_with_a_hot_group(spark):
    r = random.Random(1)
    rows = [(f"f{r.randrange(900):03}", "hot" if r.random() < 0.5 else f"s{r.randrange(9)}", r.choice(["critical", " High", "LOW", None, "odd", ""]), r.choice([None, 0, 50, 90]), 7, "x") for _ in range(1500)]
    rows += rows[:200] + [(None, "hot", "critical", 1, 1, ""), ("x", None, "critical", 1, 1, "")]
    got = top_findings(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["scan_id", "finding_id", "rank_no"] and sorted(map(tuple, got.collect())) == brute(rows)


def test_small_groups_and_empty_table(spark):
    assert top_findings(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = spark.createDataFrame([("a", "s", "low", 1, 0, "")], SCHEMA)
    assert [tuple(x) for x in top_n_per_group(rows, "scan_id", "id", [F.lit(0)], 3).collect()] == [("s", "a", 1)]
