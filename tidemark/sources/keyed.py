"""A keyed table on files: upserts that rewrite only the buckets they touch, committed by one file a version.

    <path>/data/<version>-<writer>/bucket=<b>/...   rows of the buckets that a version rewrote
    <path>/commits/<version>.json                   folder of each bucket, and the last batch of each stream

A version exists if its commit file does. The file is written under another name and renamed, which on a shared
file system fails if the version is there already (a local one is asked before), so of two writers one wins and the
other begins again from the new version; a writer that dies leaves folders that no version names. Readers see one
version, whole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..checkpoint import written


class Conflict(RuntimeError):
    """Another writer committed the version first."""


@dataclass
class Commit:
    version: int = 0
    schema: str = ""
    buckets: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class KeyedTable:
    """Rows by key: one a key, the latest by the order columns. The number of buckets is fixed when it is made."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.order, self.n = spark, path.rstrip("/"), keys, order, buckets
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.path}/commits"))

    def versions(self) -> list[int]:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.path}/commits"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def commit(self, version: int | None = None) -> Commit:
        """A version's commit, by default the last one's; an empty one for a new table."""
        there = self.versions()
        if version is None:
            version = there[-1] if there else 0
        if not version:
            return Commit()
        if version not in there:
            raise LookupError(f"version {version} isn't there")
        text = self.spark.read.text(f"{self.path}/commits/{version}.json", wholetext=True).first()[0]
        return Commit(**json.loads(text))

    def _publish(self, commit: Commit) -> None:
        target = self._path(f"{self.path}/commits/{commit.version}.json")
        draft = self._path(f"{self.path}/commits/.{commit.version}-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(json.dumps(commit.__dict__).encode())
        out.close()
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise Conflict(f"version {commit.version} is there already")

    def _rows(self, commit: Commit, buckets: list[str] | None = None) -> DataFrame | None:
        folders = [f for b, f in commit.buckets.items() if buckets is None or b in buckets]
        if not folders:
            return None
        return self.spark.read.schema(StructType.fromJson(json.loads(commit.schema))).parquet(*(f"{self.path}/data/{f}" for f in sorted(folders)))

    def read(self, version: int | None = None) -> DataFrame:
        commit = self.commit(version)
        rows = self._rows(commit)
        if rows is None:
            raise LookupError("the table has no version yet" if not commit.version else "the version has no rows")
        return rows

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.n)).cast("int")

    def upsert(self, changes: DataFrame, stream: str | None = None, batch: int | None = None, tries: int = 5, _before_commit: Callable[[], None] | None = None) -> int:
        """Put the last change of each key in its place, or add it; gives the version.

        Rows that are older than what is stored, by the order columns, change nothing; of equal ones the change
        counts. A batch of a stream that is committed already is left alone, so a repeated micro-batch does nothing.
        Null keys are a key. Changes have the table's columns; without rows there is no new version.
        """
        changes = written(changes, "changes")  # read more than once, and alike each time
        for _ in range(tries):
            before = self.commit()
            if stream is not None and before.batches.get(stream, -1) >= batch:
                return before.version
            try:
                return self._once(before, changes, stream, batch, _before_commit)
            except Conflict:
                continue
        raise Conflict(f"other writers came first {tries} times")

    def _once(self, before: Commit, changes: DataFrame, stream: str | None, batch: int | None, before_commit: Callable[[], None] | None) -> int:
        folder = f"{before.version + 1}-{uuid.uuid4().hex}"
        schema = changes.schema
        if before.schema and [f.name for f in StructType.fromJson(json.loads(before.schema))] != schema.names:
            raise ValueError("changes must have the columns of the table, in its order")
        touched = [str(r[0]) for r in changes.select(self._bucket().alias("b")).distinct().collect()]  # at most as many as buckets
        batches = before.batches | ({stream: batch} if stream is not None else {})
        if touched:
            rows = changes.withColumn("_new", F.lit(1))
            stored = self._rows(before, touched)
            if stored is not None:
                rows = rows.unionByName(stored.withColumn("_new", F.lit(0)))
            rest = [c for c in schema.names if c not in self.keys]
            last = F.max_by(F.struct(*rest), F.struct(*self.order, "_new", F.xxhash64(*rest)))
            kept = rows.groupBy(*self.keys).agg(last.alias("_r")).select(*self.keys, "_r.*").select(*schema.names)
            kept.withColumn("bucket", self._bucket()).write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        if before_commit:
            before_commit()
        if not touched and batches == before.batches:
            return before.version
        buckets = before.buckets | {b: f"{folder}/bucket={b}" for b in touched}
        self._publish(Commit(before.version + 1, before.schema or json.dumps(json.loads(schema.json())), buckets, batches))
        return before.version + 1

    def sink(self, stream: str) -> Callable[[DataFrame, int], None]:
        """For writeStream.foreachBatch."""

        def put(rows: DataFrame, batch: int) -> None:
            self.upsert(rows, stream, batch)

        return put

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove data that none of the last `keep` versions names, and older commits; gives the folders removed.

        Not while a writer is at work: its folder has no version yet.
        """
        there = self.versions()
        needed = {f.split("/")[0] for v in there[-keep:] for f in self.commit(v).buckets.values()}
        data = self._path(f"{self.path}/data")
        found = [f.getPath().getName() for f in self._fs.listStatus(data)] if self._fs.exists(data) else []
        gone = sorted(f for f in found if f not in needed)
        for v in there[:-keep]:
            self._fs.delete(self._path(f"{self.path}/commits/{v}.json"), False)
        for f in gone:
            self._fs.delete(self._path(f"{self.path}/data/{f}"), True)
        return gone
