"""Versioned tables: a version is a list of folders, by partition, and whoever makes the next number's file first has committed.

Parquet has no MERGE, so a write makes new folders and the next version points to them; partitions that a write doesn't touch keep
theirs. Writers are optimistic: each works on the version that it read, and of two that would follow the same one the second gets
a Conflict, unless they touched different partitions. Readers keep the version they began with until vacuum() takes it.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import commits

#: Seconds that vacuum() spares what no version needs: jobs may still be writing or reading it.
KEEP_SECONDS = 7 * 86400.0


class Conflict(RuntimeError):
    """Another writer changed what this one had read."""


class SnapshotTable:
    """A table under `path` with rows of `schema`; partitioned by the values of a column, or by `buckets` hash values of it."""

    def __init__(self, spark: SparkSession, path: str, schema: str, partition: str | None = None, buckets: int | None = None):
        self.spark, self.path, self.schema, self.partition, self.buckets = spark, path.rstrip("/"), schema, partition, buckets
        self._columns = [f.name for f in spark.createDataFrame([], schema).schema]
        self._base: int | None = None  # the oldest version read since the last write

    def version(self) -> int:
        """Number of the newest version; 0 if nothing was written."""
        return commits.newest(self.spark, f"{self.path}/versions")

    def folders(self, version: int | None = None) -> dict[str, str]:
        """Folder of each partition of a version, the newest if none is given."""
        n = self.version() if version is None else version
        return json.loads(commits.text(self.spark, f"{self.path}/versions/{commits.number(n)}")) if n else {}

    def part(self):
        """Column: name of a row's partition; a null has one of its own."""
        if self.partition is None:
            return F.lit("all")
        c = F.col(self.partition)
        value = (F.pmod(F.xxhash64(c), F.lit(self.buckets)) if self.buckets else c).cast("string")
        return F.coalesce(F.concat(F.lit("p"), value), F.lit("n"))

    def read(self, version: int | None = None, parts: list[str] | None = None) -> DataFrame:
        """Rows of a version, the newest if none is given; only those of some partitions if these are given, whose folders alone are read."""
        n = self.version() if version is None else version
        if version is None:
            self._base = n if self._base is None else min(self._base, n)
        at = self.folders(n)
        paths = [f"{self.path}/data/{f}" for p, f in sorted(at.items()) if parts is None or p in parts]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def restart(self) -> None:
        """Forget what was read: the next write works on what is read from now on."""
        self._base = None

    def parts_of(self, keys: DataFrame) -> list[str]:
        """Names of the partitions that rows with the partition's column would be in."""
        if self.partition is None:
            return ["all"]
        return sorted(r.p for r in keys.select(self.part().alias("p")).distinct().collect())  # as many as there are partitions

    def _store(self, rows: DataFrame) -> dict[str, str]:
        folder = uuid.uuid4().hex
        out = rows.select(*self._columns)
        if self.partition is None:
            out.write.parquet(f"{self.path}/data/{folder}")
            return {"all": folder}
        out.withColumn("_part", self.part()).write.partitionBy("_part").parquet(f"{self.path}/data/{folder}")
        made = [n for n in commits.names(self.spark, f"{self.path}/data/{folder}") if n.startswith("_part=")]
        unescape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        return {unescape(n.removeprefix("_part=")): f"{folder}/{n}" for n in made}

    def write(self, rows: DataFrame) -> int:
        """Make rows, which may derive from read(), the whole next version. Its number; Conflict if another one came since read()."""
        base = self.version() if self._base is None else self._base
        made = self._store(rows)
        self._base = None
        if self.version() != base or not commits.create_once(self.spark, f"{self.path}/versions/{commits.number(base + 1)}", json.dumps(made)):
            raise Conflict(f"{self.path}: version {base} is no longer the newest")
        return base + 1

    def replace(self, rows: DataFrame, parts: list[str] | None = None) -> int:
        """Replace whole partitions: those that rows are in, and any others of `parts`, which become empty. The others keep their files.

        The version's number. Conflict if one of these partitions changed since read(); changes of other partitions are no conflict.
        """
        base = self.version() if self._base is None else self._base
        before = self.folders(base)
        made = self._store(rows)
        self._base = None
        touched = {*made, *(parts or [])}
        while True:
            newest = self.version()
            now = self.folders(newest)
            if newest < base or any(now.get(p) != before.get(p) for p in touched):
                raise Conflict(f"{self.path}: a partition of {sorted(touched)[:3]} changed since version {base}")
            merged = {p: f for p, f in now.items() if p not in touched} | made
            if commits.create_once(self.spark, f"{self.path}/versions/{commits.number(newest + 1)}", json.dumps(merged)):
                return newest + 1

    def vacuum(self, keep: int = 2, seconds: float = KEEP_SECONDS) -> int:
        """Delete all but the newest `keep` versions, and data that these don't need, if older than `seconds`. Number of files and folders deleted; readers and writers of older versions must have ended."""
        old = time.time() - seconds
        there = commits.names(self.spark, f"{self.path}/versions")
        versions = sorted((n for n in there if n.isdigit()), reverse=True)
        gone = [n for n in versions[max(1, keep) :] if there[n] <= old]
        needed = {f.split("/")[0] for n in versions if n not in gone for f in self.folders(int(n)).values()}
        doomed = [f"versions/{n}" for n in gone] + [f"data/{f}" for f, t in commits.names(self.spark, f"{self.path}/data").items() if f not in needed and t <= old]
        part = {f for n in versions if n not in gone for f in self.folders(int(n)).values() if "/" in f}
        for top in {f.split("/")[0] for f in part} - {d.removeprefix("data/") for d in doomed}:  # partitions of a folder that others of it outlived
            doomed += [f"data/{top}/{p}" for p, t in commits.names(self.spark, f"{self.path}/data/{top}").items() if p.startswith("_part=") and f"{top}/{p}" not in part and t <= old]
        for name in doomed:
            commits.delete(self.spark, f"{self.path}/{name}")
        return len(doomed)
