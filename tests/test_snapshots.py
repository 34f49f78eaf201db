import random
from datetime import datetime, timedelta

from codequarry.operators.snapshots import SnapshotIndex, changed_values, probe_buckets, snapshot_changes, snapshot_sequence

SCANS = "id string, repository_id string, status string, completed_at timestamp, extra string"
FINDINGS = "id string, scan_id string, fingerprint string, severity string, confidence int, line_number int, patch_available boolean, hash string, key string"


def brute(scans, findings):
    done = {}
    for sid, repo, status, at, _ in scans:
        if sid and repo and status == "completed" and at:
            done[sid] = max(done.get(sid, (at, repo)), (at, repo))
    by = {}
    for sid, (at, repo) in done.items():
        by.setdefault(repo, []).append((at, sid))
    content = {}
    for _, sid, fp, sev, conf, line, patch, *_ in findings:
        if fp and fp.strip():
            content.setdefault(sid, {})[fp.strip().lower()] = (sev and sev.strip().lower(), conf, line, patch)
    out = set()
    for repo, seq in by.items():
        seq.sort()
        for (_, a), (_, b) in zip(seq, seq[1:]):
            old, new = content.get(a, {}), content.get(b, {})
            for k in old.keys() | new.keys():
                kind = "added" if k not in old else "removed" if k not in new else "changed" if old[k] != new[k] else None
                if kind:
                    out.add((repo, b, k, kind))
    return out


def test_history_matches_brute_force(spark):
    r = random.Random(3)
    t0 = datetime(2024, 1, 1)
    scans, findings = [], []
    for i in range(60):
        sid, repo = f"s{r.randrange(50):02}", f"r{i % 4}"
        repo = f"r{int(sid[1:]) % 4}"
        at = t0 + timedelta(hours=int(sid[1:]) % 17 * 7)
        scans.append((sid, repo, r.choice(["completed", "completed", "running"]), r.choice([at, at, at, None]), "x"))
    scans += [(None, "r1", "completed", t0, None), ("n1", None, "completed", t0, None), *scans[:5]]
    for sid in {s[0] for s in scans if s[0]}:
        for k in range(12):
            if r.random() < 0.6:
                row = (f"{sid}-{k}", sid, r.choice([f"fp{k}", f" FP{k} "]), r.choice(["high", " High", None]), k % 3 or None, None if k == 4 else 1, None, "h", "k")
                findings += [row] * r.choice([1, 2])
    findings += [("a", "s01", None, "x", 1, 1, True, "", ""), ("b", "s01", "  ", "x", 1, 1, True, "", ""), ("c", None, "z", "x", 1, 1, True, "", "")]
    got = snapshot_changes(spark.createDataFrame(scans, SCANS), spark.createDataFrame(findings, FINDINGS))
    assert {tuple(x) for x in got.collect()} == brute(scans, findings)
    assert got.count() == len(brute(scans, findings))


def test_null_is_a_value_and_empty_snapshots_count(spark):
    t = datetime(2024, 1, 1)
    scans = [(f"s{i}", "r", "completed", t + timedelta(days=i), None) for i in range(3)]
    findings = [("1", "s0", "a", "low", None, 5, None, "", ""), ("2", "s1", "a", "low", 5, None, None, "", "")]
    got = snapshot_changes(spark.createDataFrame(scans, SCANS), spark.createDataFrame(findings, FINDINGS))
    assert {tuple(x)[1:] for x in got.collect()} == {("s1", "a", "changed"), ("s2", "a", "removed")}


def test_empty_tables(spark):
    assert snapshot_changes(spark.createDataFrame([], SCANS), spark.createDataFrame([], FINDINGS)).count() == 0


def test_neighbours_cross_days_and_ties(spark):
    t = datetime(2024, 1, 1, 23)
    scans = [("b", "r", "completed", t, None), ("a", "r", "completed", t, None), ("c", "r", "completed", t + timedelta(hours=3), None)]
    got = {x.snapshot_id: (x.previous_id, x.next_id) for x in snapshot_sequence(spark.createDataFrame(scans, SCANS)).collect()}
    assert got == {"a": (None, "b"), "b": ("a", "c"), "c": ("b", None)}


def test_index_keeps_the_last_snapshot(spark, tmp_path):
    index = SnapshotIndex(spark, str(tmp_path / "index"), ["k"], ["v", "w"], buckets=4)
    frame = lambda rows: spark.createDataFrame(rows, "k string, v int, w string, _hash string")
    assert index.apply(frame([("a", 1, None, "x"), ("b", 2, "y", "x"), ("b", 2, "y", "x"), (None, 1, "", "")])).count() == 0
    second = {r.k: (r.change_type, r.old and r.old.v, r.new and r.new.v) for r in index.apply(frame([("a", None, "1", ""), ("c", 3, "", "")])).collect()}
    assert second == {"a": ("changed", 1, None), "b": ("removed", 2, None), "c": ("added", None, 3)}
    third = {r.k: r.change_type for r in index.apply(frame([("a", None, "1", ""), ("c", 3, "", "")])).collect()}
    assert third == {}


def test_bucket_is_probed_across_batches():
    """One row a batch: the index and the snapshot being read outlive the batch."""
    import pyarrow as pa

    names = ["owner", "snapshot_id", "previous_id", "next_id", "key", "hash"]
    entries = [("r", "s1", None, "s2", "a", 1), ("r", "s1", None, "s2", "b", 1), ("r", "s2", "s1", "s3", "b", 2), ("r", "s4", "s3", None, "b", 2)]
    entries += [("t", "x1", None, "x2", "a", 1)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, e))]) for e in entries]
    got = {(r["scan_id"], r["fingerprint"], r["change_type"]) for b in probe_buckets(batches) for r in b.to_pylist()}
    assert got == {("s2", "a", "removed"), ("s2", "b", "changed"), ("s3", "b", "removed"), ("s4", "b", "added"), ("x2", "a", "removed")}
    assert [b.num_rows for b in probe_buckets(iter([]))] == []


def test_values_of_changed_keys(spark):
    t = datetime(2024, 1, 1)
    scans = [(f"s{i}", "r", "completed", t + timedelta(days=i), None) for i in range(3)]
    findings = [("1", "s0", "a", "low", None, 5, None, "", ""), ("2", "s1", "A ", "HIGH", 5, None, None, "", ""), ("3", "s1", "b", "low", 1, 1, None, "", "")]
    got = changed_values(spark.createDataFrame(scans, SCANS), spark.createDataFrame(findings, FINDINGS), buckets=3).collect()
    assert [(r.scan_id, r.fingerprint, tuple(r.old), tuple(r.new)) for r in got] == [("s1", "a", ("low", None, 5, None), ("high", 5, None, None))]


def test_index_outlives_its_writer_and_is_not_shuffled(spark, tmp_path):
    root = str(tmp_path / "index")
    frame = lambda rows: spark.createDataFrame(rows, "k string, v int, extra string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for i in range(4):
            got = SnapshotIndex(spark, root, ["k"], ["v"], buckets=4).apply(frame([("a", i, ""), (f"n{i}", 1, "")]))
            assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(r.k, r.change_type) for r in got.collect()} == {("a", "changed"), ("n3", "added"), ("n2", "removed")}
    index = SnapshotIndex(spark, root, ["k"], ["v"], buckets=4)
    assert len(index._generations()) == 2 and len([p for p in (tmp_path / "index").iterdir() if p.name != "pointer"]) == 2
    (tmp_path / "index" / "000000000009-half-written").mkdir()  # a run that was lost before the pointer
    assert index.apply(frame([("a", 3, ""), ("n3", 1, "")])).count() == 0
    assert {(r.k, r.change_type) for r in index.apply(frame([("a", 3, "")])).collect()} == {("n3", "removed")}
