"""What changed between consecutive full snapshots.

A snapshot delivers everything then present. The operator keeps, per key, one 64-bit hash of the compared
values: the *index* of the last snapshot, in hash buckets of (owner, key). New rows probe the index, old values
are fetched only where the hashes differ, and the new rows' hashes then take the index's place.

* :func:`snapshot_changes` works through a whole history: one task per bucket reads its entries in time order,
  probes the index of the snapshot before with each snapshot's entries, and swaps.
* :func:`changed_values` fetches the values before and after, for the changed keys alone.
* :class:`SnapshotIndex` keeps the index between runs as bucketed tables and takes one delivery at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codequarry.operators.skew import join_hot
from codequarry.session import written


def value_hash(*values: Column) -> Column:
    """64-bit hash in which null is a value of its own (``xxhash64`` alone skips nulls)."""
    return F.xxhash64(*[x for v in values for x in (v, v.isNull())])


def snapshot_sequence(scans: DataFrame) -> DataFrame:
    """``snapshot_id, owner, at, previous_id, next_id`` of every completed scan.

    A scan counts once, if any of its rows is ``completed`` with a ``completed_at`` (the latest such row
    counts); ties in time are ordered by id. Scans without id or repository are left out.

    A single repository may own a third of all scans, so neighbours are found within (repository, day) and
    only each day's first and last scan is ordered per repository.
    """
    done = (
        scans.where((F.col("status") == "completed") & F.col("completed_at").isNotNull())
        .where(F.col("id").isNotNull() & F.col("repository_id").isNotNull())
        .groupBy(F.col("id").alias("snapshot_id"))
        .agg(F.max(F.struct("completed_at", "repository_id")).alias("s"))
        .select("snapshot_id", F.col("s.repository_id").alias("owner"), F.col("s.completed_at").alias("at"))
        .withColumn("day", F.to_date("at"))
    )
    within = Window.partitionBy("owner", "day").orderBy("at", "snapshot_id")
    days = done.groupBy("owner", "day").agg(
        F.min(F.struct("at", "snapshot_id")).alias("first"), F.max(F.struct("at", "snapshot_id")).alias("last")
    )
    across = Window.partitionBy("owner").orderBy("day")
    days = days.select(
        "owner",
        "day",
        F.lag("last.snapshot_id").over(across).alias("day_before"),
        F.lead("first.snapshot_id").over(across).alias("day_after"),
    )
    return (
        done.withColumn("before", F.lag("snapshot_id").over(within))
        .withColumn("after", F.lead("snapshot_id").over(within))
        .join(days, ["owner", "day"])
        .select(
            "snapshot_id",
            "owner",
            "at",
            F.coalesce("before", "day_before").alias("previous_id"),
            F.coalesce("after", "day_after").alias("next_id"),
        )
    )


def _compared(findings: DataFrame) -> DataFrame:
    """``snapshot_id, key, hash, values`` of every finding with a fingerprint."""
    severity = F.lower(F.trim("severity"))
    return findings.select(
        F.col("scan_id").alias("snapshot_id"),
        F.lower(F.trim("fingerprint")).alias("key"),
        value_hash(severity, F.col("confidence"), F.col("line_number"), F.col("patch_available")).alias("hash"),
        F.struct(severity.alias("severity"), "confidence", "line_number", "patch_available").alias("values"),
    ).where(F.col("key") != "")


def index_entries(findings: DataFrame) -> DataFrame:
    """``snapshot_id, key, hash``: one entry per fingerprint of a scan.

    Fingerprints are compared trimmed and in lower case; null and blank ones have no entry. Should rows of one
    fingerprint disagree, the one with the least hash stands for it. Repeats are folded before the shuffle.
    """
    return _compared(findings).groupBy("snapshot_id", "key").agg(F.min("hash").alias("hash"))


CHANGES = "repository_id string, scan_id string, fingerprint string, change_type string, held_by string"


def probe_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The changes of one bucket, whose entries come in order of owner and snapshot.

    Held are the key-to-hash index of the last snapshot and the one that is being read; both are as large as a
    snapshot's share of one bucket. Which snapshot should follow is known from the entries, so one that has
    nothing in this bucket is noticed by its absence.
    """
    schema = pa.schema([(c.split()[0], pa.string()) for c in CHANGES.split(", ")])
    owner = last_id = last_next = None  # whose index is held, and of which snapshot
    index: dict[str, int] = {}
    fresh: dict[str, int] = {}
    reading: tuple | None = None  # owner, snapshot, the one before, the one after
    out: list[tuple] = []

    def gone(keys, scan) -> None:
        out.extend((owner, scan, k, "removed", last_id) for k in keys)

    def probe_and_swap() -> None:
        nonlocal owner, last_id, last_next, index, fresh
        who, scan, before, after = reading
        if who == owner and before == last_id:
            out.extend((who, scan, k, "added", None) for k in fresh.keys() - index.keys())
            out.extend((who, scan, k, "changed", before) for k, h in fresh.items() if index.get(k, h) != h)
            gone(index.keys() - fresh.keys(), scan)
        else:
            if last_next is not None:
                gone(index, last_next)
            if before is not None:
                out.extend((who, scan, k, "added", None) for k in fresh)
        owner, last_id, last_next, index, fresh = who, scan, after, fresh, {}

    def emitted() -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [[]] * len(schema)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], schema=schema)

    for batch in batches:
        place = [batch.column(c).to_pylist() for c in ("owner", "snapshot_id", "previous_id", "next_id")]
        for *at, key, held in zip(*place, batch.column("key").to_pylist(), batch.column("hash").to_pylist()):
            if reading is None or at[1] != reading[1] or at[0] != reading[0]:
                if reading is not None:
                    probe_and_swap()
                reading = tuple(at)
            fresh[key] = held
        yield emitted()
    if reading is not None:
        probe_and_swap()
        if last_next is not None:
            gone(index, last_next)
        yield emitted()


def snapshot_probes(scans: DataFrame, findings: DataFrame, buckets: int | None = None) -> DataFrame:
    """The columns of :func:`snapshot_changes` and ``held_by``, the snapshot whose entry was probed or removed."""
    entries = join_hot(index_entries(findings), snapshot_sequence(scans), "snapshot_id", "key")
    count = buckets or int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        entries.repartition(count, "owner", "key")  # a bucket is a partition
        .sortWithinPartitions("owner", "at", "snapshot_id")
        .select("owner", "snapshot_id", "previous_id", "next_id", "key", "hash")
        .mapInArrow(probe_buckets, CHANGES)
    )


def snapshot_changes(scans: DataFrame, findings: DataFrame, buckets: int | None = None) -> DataFrame:
    """``repository_id, scan_id, fingerprint, change_type`` for every two consecutive snapshots.

    ``added``, ``removed`` and ``changed`` as seen from the later snapshot, ``scan_id``. The first snapshot of
    a repository has no changes; a snapshot may be empty, then everything before it is removed. Empty tables
    give no rows. ``buckets`` (the session's shuffle partitions if None) split every repository, so one that has
    a third of all rows is a third of each bucket; a task holds two snapshots' shares of its bucket.
    """
    return snapshot_probes(scans, findings, buckets).drop("held_by")


def changed_values(scans: DataFrame, findings: DataFrame, buckets: int | None = None) -> DataFrame:
    """The ``changed`` rows of :func:`snapshot_changes` with the structs ``old`` and ``new`` of the compared values.

    Values are fetched for the changed keys alone: the scan of the findings is cut down to them by a semi join
    before anything is grouped; the keys are written to the shared folder once. Should rows of one fingerprint disagree, the one with the least hash stands.
    """
    cases = written(snapshot_probes(scans, findings, buckets).where("change_type = 'changed'").drop("change_type"))
    both = cases.select("fingerprint", F.explode(F.array("scan_id", "held_by")).alias("snapshot_id")).distinct()
    values = (
        _compared(findings)
        .select("snapshot_id", F.col("key").alias("fingerprint"), "hash", "values")
        .join(both, ["snapshot_id", "fingerprint"], "left_semi")
        .groupBy("snapshot_id", "fingerprint")
        .agg(F.min_by("values", "hash").alias("values"))
    )
    side = lambda on, name: values.select(F.col("snapshot_id").alias(on), "fingerprint", F.col("values").alias(name))
    return cases.join(side("held_by", "old"), ["held_by", "fingerprint"]).join(side("scan_id", "new"), ["scan_id", "fingerprint"]).select(
        "repository_id", "scan_id", "fingerprint", "old", "new"
    )


class SnapshotIndex:
    """The key-to-hash index of the last snapshot, as Parquet tables below ``root`` bucketed by the keys.

    ``apply`` compares one delivery with it and swaps the index: a new generation is written beside the old one
    and then named by creating one file, which succeeds or doesn't, so a run that is lost half-way leaves the
    old index valid. Generations before the last two are removed. One writer at a time is assumed.

    Rows with a null in any key column are left out. Of several rows of one key, the one with the least hash
    stands. Key and value columns may have any names but ``_hash``, ``_held`` and ``_values``; others are ignored.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], values: Sequence[str], buckets: int = 64):
        self.spark, self.root, self.keys, self.values, self.buckets = spark, root.rstrip("/"), list(keys), list(values), buckets
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda name: path(f"{self.root}/{name}")
        self._files = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _generations(self) -> list[str]:
        """Names of the valid generations, oldest first."""
        if not self._files.exists(self._path("pointer")):
            return []
        return sorted(f.getPath().getName() for f in self._files.listStatus(self._path("pointer")))

    def _table(self, generation: str, part: str) -> DataFrame:
        """One bucketed table of a generation, declared anew where this session doesn't know it."""
        name, where = f"index_{generation.replace('-', '_')}_{part}", f"{self.root}/{generation}/{part}"
        if not self.spark.catalog.tableExists(name):
            columns = self.spark.read.parquet(where).schema.toDDL()
            by = ", ".join(f"`{k}`" for k in self.keys)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{where}'")
        return self.spark.table(name)

    def _write(self, rows: DataFrame, generation: str, part: str) -> None:
        name = f"index_{generation.replace('-', '_')}_{part}"
        rows.write.bucketBy(self.buckets, *self.keys).sortBy(*self.keys).option("path", f"{self.root}/{generation}/{part}").saveAsTable(name)

    def apply(self, rows: DataFrame) -> DataFrame:
        """``keys..., change_type, old, new`` against the index, which then holds ``rows``.

        ``old`` and ``new`` are structs of the values, fetched for changed, removed and added keys only, within the
        buckets: only the delivery itself is shuffled, once, when it is written. The first delivery has no changes
        and only fills the index. The result reads both generations, so use it before the next but one delivery.
        """
        known = self._generations()
        generation = f"{int(known[-1].split('-')[0]) + 1 if known else 0:012d}-{uuid4().hex}"
        entries = (
            rows.select(*self.keys, value_hash(*[F.col(v) for v in self.values]).alias("_hash"), F.struct(*self.values).alias("_values"))
            .dropna(subset=self.keys)
            .repartition(self.buckets, *self.keys)
            .groupBy(*self.keys)
            .agg(F.min(F.struct("_hash", "_values")).alias("e"))
            .select(*self.keys, "e.*")
        )
        self._write(entries, generation, "store")
        stored = self._table(generation, "store")
        self._write(stored.drop("_values"), generation, "hashes")
        fresh = self._table(generation, "hashes")
        new = stored.select(*self.keys, F.col("_values").alias("new"))
        if known:
            held = self._table(known[-1], "hashes").withColumnRenamed("_hash", "_held")
            old = self._table(known[-1], "store").select(*self.keys, F.col("_values").alias("old"))
            kind = F.when(F.col("_held").isNull(), "added").when(F.col("_hash") != F.col("_held"), "changed")
            present = fresh.join(held, self.keys, "left").select(*self.keys, kind.alias("change_type")).where("change_type is not null")
            gone = held.join(fresh, self.keys, "left_anti").select(*self.keys, F.lit("removed").alias("change_type"))
            result = present.join(old, self.keys, "left").join(new, self.keys).unionByName(gone.join(old, self.keys), allowMissingColumns=True)
        else:
            result = new.where("false").select(*self.keys, F.lit("").alias("change_type"), F.col("new").alias("old"), "new")
        self._files.mkdirs(self._path("pointer"))
        self._files.createNewFile(self._path(f"pointer/{generation}"))
        for old in known[:-1]:
            for part in ("store", "hashes"):
                self.spark.sql(f"DROP TABLE IF EXISTS index_{old.replace('-', '_')}_{part}")
            self._files.delete(self._path(f"pointer/{old}"), False)
            self._files.delete(self._path(old), True)
        return result.select(*self.keys, "change_type", "old", "new")
