"""Sessions and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, name: str = "codequarry") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session (tests, a laptop) that names none gets a temporary folder; elsewhere that is an error,
    as one machine's folder is none that the executors share.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    where = where or sc.getCheckpointDir()
    if not where and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not where:
        where = tempfile.mkdtemp(prefix="codequarry-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def written(rows: DataFrame) -> DataFrame:
    """``rows`` as a table in the shared folder, read again: cuts the lineage, and later reads prune its columns."""
    where = f"{shared_dir(rows.sparkSession).rstrip('/')}/table-{uuid4().hex}"
    rows.write.parquet(where)
    return rows.sparkSession.read.schema(rows.schema).parquet(where)
