"""A partitioned table in versions: files are staged first, then one manifest makes them the table.

    <root>/data/commit=<id>/<partition columns>/part-*.parquet      staged once, never changed
    <root>/versions/<number>                                        which commit holds each partition

A version names the folder of every partition. A writer stages new folders, which no version names yet, and publishes by
moving a finished manifest to the next number; a writer killed before that leaves the table as it was. Readers take one
manifest and see that version, whatever is written meanwhile. Two writers that start from one version cannot both publish
the next: the second is refused and may merge again. A manifest has one line for each partition (interval and date).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Partition = tuple[str, ...]


class ConflictError(RuntimeError):
    """Another writer published first."""


class SnapshotTable:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, partition_by: tuple[str, ...]):
        self.spark, self.root, self.schema, self.partition_by = spark, root.rstrip("/"), schema, partition_by

    # ---- files

    def _path(self, *parts: str) -> Any:
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self) -> Any:
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        fs, folder = self._fs(), self._path("versions")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def version(self) -> int:
        """Number of the newest version, 0 before the first."""
        return max(self.versions(), default=0)

    def exists(self) -> bool:
        return self.version() > 0

    def manifest(self, version: int | None = None) -> dict[Partition, str]:
        """The commit that holds each partition."""
        n = self.version() if version is None else version
        if n == 0:
            return {}
        stream = self._fs().open(self._path("versions", f"{n:012d}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {tuple(p): c for p, c in json.loads(text)}

    # ---- reading

    def read(self, version: int | None = None, wanted: Callable[[Partition], bool] | None = None) -> DataFrame:
        """One version's rows, of the partitions that `wanted` accepts (values as text, in partition order)."""
        found = self.manifest(version)
        folders = [self._folder(p, c) for p, c in sorted(found.items()) if wanted is None or wanted(p)]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        schema = T.StructType([*self.schema.fields, T.StructField("commit", T.StringType())])
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/data").parquet(*folders)
        return rows.select(*self.schema.names)

    def _folder(self, partition: Partition, commit: str) -> str:
        keys = "/".join(f"{k}={v}" for k, v in zip(self.partition_by, partition, strict=True))
        return f"{self.root}/data/commit={commit}/{keys}"

    # ---- writing

    def stage(self, rows: DataFrame, order: tuple[str, ...]) -> tuple[str, list[Partition]]:
        """Write rows as a commit that no version names yet; the commit and the partitions it has."""
        commit, keys = uuid.uuid4().hex[:16], list(self.partition_by)
        dealt = rows.select(*self.schema.names).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
        dealt.write.partitionBy(*keys).parquet(f"{self.root}/data/commit={commit}")
        if self._fs().exists(self._path("data", f"commit={commit}", "_SUCCESS")) and not self._has_folders(commit):
            return commit, []
        stored = self.spark.read.parquet(f"{self.root}/data/commit={commit}")
        found = stored.select(*[F.col(k).cast("string") for k in keys]).distinct().collect()
        return commit, [tuple(r) for r in found]

    def _has_folders(self, commit: str) -> bool:
        return any(s.isDirectory() for s in self._fs().listStatus(self._path("data", f"commit={commit}")))

    def publish(self, manifest: dict[Partition, str], after: int) -> int:
        """Make `manifest` the version after `after`."""
        fs, n = self._fs(), after + 1
        draft, final = self._path("versions", f".{uuid.uuid4().hex}"), self._path("versions", f"{n:012d}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(sorted([list(p), c] for p, c in manifest.items())), "utf-8"))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise ConflictError(f"version {n} of {self.root} is there already")
        return n

    def commit(self, rows: DataFrame, order: tuple[str, ...], *, after: int, dropped: set[Partition] = frozenset()) -> int:
        """Replace the partitions that `rows` have, drop the `dropped` ones, keep the rest; returns the new version."""
        commit, partitions = self.stage(rows, order)
        kept = {p: c for p, c in self.manifest(after).items() if p not in dropped}
        return self.publish(kept | dict.fromkeys(partitions, commit), after)

    def expire(self, keep: int = 1) -> list[str]:
        """Delete all versions but the last `keep`, and the commits that only those named; what was deleted.

        Not while a writer is at work: a staged commit is named by no version.
        """
        numbers, fs = self.versions(), self._fs()
        live = {c for n in numbers[-keep:] for c in self.manifest(n).values()}
        gone = [f"versions/{n:012d}" for n in numbers[:-keep]]
        data = self._path("data")
        commits = [s.getPath().getName() for s in fs.listStatus(data)] if fs.exists(data) else []
        gone += [f"data/{c}" for c in commits if c.startswith("commit=") and c.removeprefix("commit=") not in live]
        for name in gone:
            fs.delete(self._path(name), True)
        return gone
