"""Dependencies against advisories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions.versions import in_affected_range, version_key

# Public advisories (id, ecosystem, package, affected range, severity, fixed version).
ADVISORIES = [
    ("CVE-2019-10744", "npm", "lodash", "<4.17.12", "critical", "4.17.12"),
    ("CVE-2021-23337", "npm", "lodash", "<4.17.21", "high", "4.17.21"),
    ("CVE-2020-7598", "npm", "minimist", "<0.2.1,<1.2.3", "medium", "1.2.3"),
    ("CVE-2023-45857", "npm", "axios", ">=1.0.0,<1.6.0", "medium", "1.6.0"),
    ("CVE-2022-24999", "npm", "qs", "<6.11.0", "high", "6.11.0"),
    ("CVE-2024-45296", "npm", "path-to-regexp", "<0.1.10,>=1.0.0 <6.3.0", "high", "6.3.0"),
    ("CVE-2022-25883", "npm", "semver", "<5.7.2,>=6.0.0 <6.3.1,>=7.0.0 <7.5.2", "medium", "7.5.2"),
    ("CVE-2023-25577", "pypi", "werkzeug", "<2.2.3", "high", "2.2.3"),
    ("CVE-2024-49767", "pypi", "werkzeug", "<3.0.6", "high", "3.0.6"),
    ("CVE-2023-44271", "pypi", "pillow", "<10.0.1", "high", "10.0.1"),
    ("CVE-2023-32681", "pypi", "requests", ">=2.1.0,<2.31.0", "medium", "2.31.0"),
    ("CVE-2023-49083", "pypi", "cryptography", "<41.0.6", "medium", "41.0.6"),
    ("CVE-2024-6345", "pypi", "setuptools", "<70.0.0", "high", "70.0.0"),
    ("CVE-2017-18342", "pypi", "pyyaml", "<4.2b1", "critical", "5.1"),
    ("CVE-2023-45803", "pypi", "urllib3", "<1.26.18,>=2.0.0 <2.0.7", "medium", "1.26.18"),
]
SCHEMA = "advisory_id string, ecosystem string, package string, affected string, severity string, fixed_version string"


def advisory_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ADVISORIES, SCHEMA)


def affected(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """The dependencies an advisory applies to, with ``confidence`` 75, or 40 where the version isn't known.

    A version that can't be read matches nothing. The join is by ecosystem and lower-case name, the range is a
    condition on top; Spark chooses how to join from the advisories' size.
    """
    a = advisories.withColumn("_name", F.lower("package")).withColumnRenamed("ecosystem", "_eco")
    hits = dependencies.join(a, (F.col("ecosystem") == F.col("_eco")) & (F.lower("name") == F.col("_name")))
    known = F.col("version").isNotNull()
    confidence = F.when(~known, 40).when(version_key(F.col("version")).isNotNull() & in_affected_range(F.col("version"), F.col("affected")), 75)
    return hits.withColumn("confidence", confidence).where("confidence is not null").drop("_name", "_eco")
