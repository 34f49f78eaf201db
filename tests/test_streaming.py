from datetime import datetime, timedelta

from codequarry.streaming import ingest

SCHEMA = "id string, scan_id string, rule_id string, category string, title string, severity string, file_path string, line_number int, sink_label string, advisory_id string, evidence string, seen_at timestamp"


def test_repeats_are_dropped_and_windows_counted(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(str(i), "s", "R1", "xss", "t", "High", "a.py", 1 if i < 3 else 40, None, None, None, t + timedelta(minutes=i)) for i in range(5)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = ingest.findings_stream(spark, str(tmp_path / "in"), SCHEMA)
    q = ingest.write_stream(ingest.first_seen(stream), str(tmp_path / "out"), str(tmp_path / "c1"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    q = ingest.severity_windows(ingest.findings_stream(spark, str(tmp_path / "in"), SCHEMA)).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(60)
    assert [(r.severity, r.n) for r in spark.sql("select * from w").collect()] == [("high", 5)]
