"""Sharding by size-tiered compaction. DataFrame functions only.

A store is a folder with immutable Parquet shards and numbered manifests. An arrival
is appended as the small files its tasks write, and committed. Compaction looks at
the tiers, runs of shards of similar size (a factor of ``FANOUT``), from the smallest
up; a tier with at least ``FANOUT`` shards is merged into files of the target size, or
into one shard of a higher tier where it holds less. Merging coalesces scan tasks, so
rows are not shuffled and whole texts are read and written once per tier they rise.

A commit writes the manifest of version n + 1 to a hidden file and puts it in its place
by an operation that refuses a place already taken: a hard link on a local file system,
a rename without overwriting (``FileContext``) on others, which HDFS does atomically. The
writer that is refused starts again from the newer manifest. On object stores whose
rename is a copy, writers need a lock of their own. Readers see whole versions. Shards that a
version no longer names go with ``vacuum``. A job that dies leaves files that no
manifest names.

Manifests hold paths and sizes and no rows; they grow with bytes / target size.
Empty arrivals commit a version without new shards. All columns, null or not, are kept
as they are; rows are neither dropped nor made unique.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET_BYTES, FANOUT, TIER_BASE = 128 << 20, 4, 1 << 20


class ShardStore:
    """The shards of one table below ``root``, a folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target_bytes, fanout
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # manifests

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def version(self) -> int:
        """The last committed version, 0 for none."""
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        return json.loads(self._read(f"{self.root}/manifests/v{version:010d}.json"))

    def _commit(self, change) -> dict:
        """``change`` turns the shards of the last version into the next ones, or raises where it no longer applies."""
        while True:
            last = self.manifest()
            made = {"version": last["version"] + 1, **change(last)}
            hidden, place = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}"), self._path(f"{self.root}/manifests/v{made['version']:010d}.json")
            self._fs.mkdirs(hidden.getParent())
            stream = self._fs.create(hidden, False)
            stream.write(bytearray(json.dumps(made).encode()))
            stream.close()
            try:
                if self._claim(hidden, place):
                    return made
            finally:
                self._fs.delete(hidden, False)

    def _claim(self, hidden, place, link: bool | None = None) -> bool:
        """Put a file in its place, by a link where the file system is local; False where another writer has taken it."""
        from py4j.protocol import Py4JJavaError

        jvm = self.spark._jvm
        try:
            if self._fs.getScheme() == "file" if link is None else link:
                local = [jvm.java.nio.file.Paths.get(self._fs.makeQualified(p).toUri().getPath(), self.spark._sc._gateway.new_array(jvm.java.lang.String, 0)) for p in (place, hidden)]
                jvm.java.nio.file.Files.createLink(*local)
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(hidden, place, self.spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
            return True
        except Py4JJavaError as e:
            if self._fs.exists(place) and "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise

    def _listed(self, folder: str) -> list[dict]:
        files = self._fs.listStatus(self._path(folder))
        return sorted(({"path": f"{folder}/{f.getPath().getName()}", "bytes": f.getLen()} for f in files if f.getPath().getName().startswith("part-")), key=lambda x: x["path"])

    def _write(self, df: DataFrame) -> list[dict]:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return self._listed(folder)

    # operations

    def append(self, arrivals: DataFrame) -> dict:
        """Write the rows as new shards and commit them."""
        shards, schema = self._write(arrivals), arrivals.schema.json()
        return self._commit(lambda last: {"schema": last["schema"] or schema, "shards": last["shards"] + shards})

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(1, size) / TIER_BASE, self.fanout) + 1))

    def due(self, manifest: dict) -> list[dict]:
        """The shards of the lowest tier that is due, below the target size."""
        tiers: dict[int, list[dict]] = {}
        for s in manifest["shards"]:
            if s["bytes"] < self.target // 2:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fanout), [])

    def compact(self) -> dict:
        """Merge due tiers until none is left; every merge is a commit of its own."""
        while old := self.due(self.manifest()):
            gone = {s["path"] for s in old}
            files = max(1, round(sum(s["bytes"] for s in old) / self.target))
            merged = self._write(self._scan(old).coalesce(files))

            def change(last: dict) -> dict:
                if not gone <= {s["path"] for s in last["shards"]}:
                    raise RuntimeError("another writer has merged these shards")
                return {"schema": last["schema"], "shards": [s for s in last["shards"] if s["path"] not in gone] + merged}

            self._commit(change)
        return self.manifest()

    def vacuum(self) -> int:
        """Delete files that the last version does not name; returns their number. Not for use beside writers."""
        named, gone = {s["path"] for s in self.manifest()["shards"]}, 0
        for folder in self._fs.listStatus(self._path(f"{self.root}/data")):
            for s in self._listed(f"{self.root}/data/{folder.getPath().getName()}"):
                if s["path"] not in named:
                    gone += bool(self._fs.delete(self._path(s["path"]), False))
        return gone

    def _scan(self, shards: list[dict]) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(self.manifest()["schema"]))
        return self.spark.read.schema(schema).parquet(*[s["path"] for s in shards]) if shards else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        return self._scan(self.manifest(version)["shards"])


def shard_arrivals(table: DataFrame, root: str, arrival_col: str | None = None, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT) -> ShardStore:
    """Append ``table`` as one arrival, compact, and drop what was merged."""
    store = ShardStore(table.sparkSession, root, target_bytes, fanout)
    store.append(table)
    store.compact()
    store.vacuum()
    return store


def content(table: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and sha256 of every row's text."""
    return table.select(id_col, F.octet_length(text_col).cast("long").alias("n_bytes"), F.sha2(text_col, 256).alias("text_sha256"))
