"""A project store on any file system Spark writes to: bucketed snapshots behind a manifest.

A project belongs to a bucket by its id. A version is a manifest, a small JSON file that names the folder
of each bucket; folders are never written twice. Saving reads and rewrites only the buckets that the
changes touch, then puts the next manifest in place by one rename that fails where another writer was
first. What is written before that rename is seen by nobody, so a crash leaves the old version whole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import projects


class Conflict(RuntimeError):
    """Another writer made the next version first."""


class ProjectStore:
    """Projects under ``path``: rows of ``schema``, which has id, created_at and updated_at, in ``buckets`` buckets."""

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = 64, key: str = "id", created: str = "created_at", updated: str = "updated_at") -> None:
        self.spark, self.path, self.key, self.created, self.updated = spark, path.rstrip("/"), key, created, updated
        self.schema = spark.createDataFrame([], schema).schema
        held = self._manifest(self.version())
        self.buckets = held["buckets"] if held else buckets

    # ---- files ----

    def _file(self, path: str):
        file = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return file.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), file

    def _names(self, folder: str) -> list[str]:
        fs, at = self._file(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def version(self) -> int:
        """The current version; 0 where nothing has been saved."""
        return max((int(n.removesuffix(".json")) for n in self._names("versions") if n.endswith(".json") and n[:1].isdigit()), default=0)

    def _manifest(self, version: int) -> dict | None:
        if not version:
            return None
        fs, at = self._file(f"{self.path}/versions/{version:012d}.json")
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, version: int, folders: dict[str, str]) -> None:
        fs, draft = self._file(f"{self.path}/versions/draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        try:
            stream.write(json.dumps({"buckets": self.buckets, "folders": folders}, sort_keys=True).encode())
        finally:
            stream.close()
        _, final = self._file(f"{self.path}/versions/{version:012d}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise Conflict(f"version {version} of {self.path} is there already")

    # ---- reading ----

    def _read(self, folders: Iterable[str]) -> DataFrame:
        paths = sorted({f"{self.path}/data/{f}" for f in folders})
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """All projects of a version, by default the current one."""
        held = self._manifest(self.version() if version is None else version)
        return self._read(held["folders"].values()) if held else self._read([])

    def get(self, key_value: object) -> DataFrame:
        """One project; only its bucket is read, and in it the id is pushed down to the scan."""
        held = self._manifest(self.version())
        if not held:
            return self._read([])
        kind = self.schema[self.key].dataType.simpleString()
        bucket = self.spark.range(1).select(self._bucket(F.lit(key_value).cast(kind))).first()[0]
        folder = held["folders"].get(str(bucket))
        return projects.get(self._read([folder] if folder else []), key_value, self.key)

    def listing(self, *columns: str) -> DataFrame:
        """Projects newest first (equal times by id): only id, update time and ``columns`` are read."""
        return projects.listing(self.read().select(self.key, self.updated, *columns), self.updated, self.key)

    # ---- writing ----

    def _bucket(self, key):
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _rewrite(self, changes: DataFrame, merged) -> int:
        """A new version in which the buckets of ``changes`` hold ``merged(their projects, changes)``."""
        version = self.version()
        held = (self._manifest(version) or {"folders": {}})["folders"]
        touched = [r[0] for r in changes.select(self._bucket(F.col(self.key)).alias("b")).distinct().collect()]  # at most ``buckets``
        if not touched:
            return version
        rows = merged(self._read(held[str(b)] for b in touched if str(b) in held), changes)
        run = uuid.uuid4().hex
        self._write(rows, run)
        written = {n.removeprefix("_bucket=") for n in self._names(f"data/{run}") if n.startswith("_bucket=")}
        folders = {b: f for b, f in held.items() if int(b) not in touched} | {b: f"{run}/_bucket={b}" for b in written}
        self._publish(version + 1, folders)
        return version + 1

    def _write(self, rows: DataFrame, run: str) -> None:
        """One file a bucket, newest first in it."""
        dealt = rows.withColumn("_bucket", self._bucket(F.col(self.key))).repartition("_bucket").sortWithinPartitions("_bucket", F.col(self.updated).desc())
        dealt.write.partitionBy("_bucket").parquet(f"{self.path}/data/{run}")

    def save(self, changes: DataFrame) -> int:
        """Insert or replace projects (see ``projects.upsert``: creation times stay); the new version."""
        return self._rewrite(changes.select(*self.schema.names).filter(F.col(self.key).isNotNull()), lambda old, new: projects.upsert(old, new, self.key, self.created, self.updated))

    def delete(self, ids: DataFrame) -> int:
        """Take projects away; the new version."""
        return self._rewrite(ids.select(F.col(self.key).cast(self.schema[self.key].dataType)).filter(F.col(self.key).isNotNull()), lambda old, gone: projects.delete(old, gone, self.key))

    def compact(self, keep: int = 1) -> None:
        """Delete versions before the last ``keep``, and folders that no version left names: those of old versions and of crashed writers.

        No writer may be at work meanwhile.
        """
        versions = sorted(int(n.removesuffix(".json")) for n in self._names("versions") if n.endswith(".json") and n[:1].isdigit())
        left = versions[-keep:] if keep > 0 else versions[-1:]
        named = {f for v in left for f in self._manifest(v)["folders"].values()}
        gone = [f"versions/{n}" for n in self._names("versions") if n.startswith("draft-")] + [f"versions/{v:012d}.json" for v in versions if v not in left]
        for run in self._names("data"):
            inside = [n for n in self._names(f"data/{run}") if n.startswith("_bucket=")]
            unused = [n for n in inside if f"{run}/{n}" not in named]
            gone += [f"data/{run}"] if len(unused) == len(inside) else [f"data/{run}/{n}" for n in unused]
        for path in gone:
            fs, at = self._file(f"{self.path}/{path}")
            fs.delete(at, True)
