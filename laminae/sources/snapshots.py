"""Versioned bases in a store that Spark can write.

A version is a Parquet directory and a manifest file. Manifests are created, never replaced: two
writers that start from one version both try to create the next manifest and one fails, so a
publish is a compare-and-swap. A version that is being read is never overwritten.

The store must create a file only where none is, in one step: HDFS and local disks do; an object
store does where its connector is set to conditional writes.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..spec import LayerSpec
from ..operators.layer import LayeredTable


class StaleSnapshot(RuntimeError):
    """Another writer published first."""


class _Manifests:
    """Numbered manifests under ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _read(self, path: str) -> dict:
        fs, at = self._fs(path)
        stream = fs.open(at)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def version(self) -> int:
        """The newest version, 0 before the first."""
        fs, at = self._fs(f"{self.path}/manifest")
        if not fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = version or self.version()
        return self._read(f"{self.path}/manifest/{version:010d}.json") if version else {}

    def swap(self, expected: int, **facts) -> int:
        """Create the manifest after ``expected`` with the old one's facts and these."""
        facts = {**self.manifest(expected), **facts, "version": expected + 1}
        fs, at = self._fs(f"{self.path}/manifest/{expected + 1:010d}.json")
        if self.version() > expected:
            raise StaleSnapshot(f"{self.path}: version {self.version()} is there, {expected} was expected")
        try:
            stream = fs.create(at, False)
        except Py4JJavaError as e:
            # Only a file that is there already means another writer; other failures are what they are.
            if fs.exists(at):
                raise StaleSnapshot(f"{self.path}: version {expected + 1} is there already") from e
            raise
        stream.write(bytearray(json.dumps(facts).encode()))
        stream.close()
        return expected + 1

    def _folder(self, version: int, table: str = "") -> str:
        return f"{self.path}/data/{version:010d}-{uuid.uuid4().hex}{f'/{table}' if table else ''}"


class SnapshotStore(_Manifests):
    """The base of one layer, and of one tenant, under ``path``."""

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.manifest(version)["base"])

    def layer(self, spec: LayerSpec, source: DataFrame, version: int | None = None) -> LayeredTable:
        return LayeredTable(spec, self.read(version), source)

    def publish(self, base: DataFrame, expected: int, partition_by: str | None = None, **facts) -> int:
        """Write the next version after ``expected``; ``StaleSnapshot`` if another is there already."""
        folder = self._folder(expected + 1)
        writer = base.write.partitionBy(partition_by) if partition_by else base.write
        writer.parquet(folder)
        return self.swap(expected, base=folder, **facts)

    def truncate(self, schema) -> int:
        """Publish an empty base; the source is never touched."""
        return self.publish(self.spark.createDataFrame([], schema), self.version())


class SnapshotSet(_Manifests):
    """The bases of several layers whose changes become visible together."""

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.manifest(version)["tables"][table])

    def layer(self, spec: LayerSpec, source: DataFrame, table: str | None = None, version: int | None = None) -> LayeredTable:
        return LayeredTable(spec, self.read(table or spec.name, version), source)

    def publish(self, bases: dict[str, LayeredTable | DataFrame], expected: int | None = None, **facts) -> int:
        """Write all bases, then one manifest that names them; tables left out keep theirs. ``StaleSnapshot`` if another version is there."""
        expected = self.version() if expected is None else expected
        tables = dict(self.manifest(expected).get("tables", {}))
        for name, base in bases.items():
            tables[name] = self._folder(expected + 1, name)
            (base.base if isinstance(base, LayeredTable) else base).write.parquet(tables[name])
        return self.swap(expected, tables=tables, **facts)
