"""A versioned state: tables of a version are written beside those of the last one, and a marker file makes the version the present one.

    <root>/versions/00000012-<id>/<table>   tables of a version, whole before the marker stands
    <root>/commits/00000012-<id>            an empty file; the greatest name is the present version

Creating an empty file is one step on any file system, so a reader sees the last version or the new one, and whatever a job that is
killed leaves behind isn't read. A writer starts from a version and may only commit while that is still the present one. Versions
older than the one before the present are removed after a commit, so readers that began before it go on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class State:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def commits(self) -> list[str]:
        """Names of the committed versions, in order."""
        where = self._path("commits")
        return sorted(f.getPath().getName() for f in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def present(self) -> str | None:
        return (self.commits() or [None])[-1]

    def read(self, table: str, version: str | None = None) -> DataFrame | None:
        """A table of the present version (or the one named); None before the first."""
        version = version or self.present()
        return self.spark.read.parquet(f"{self.root}/versions/{version}/{table}") if version else None

    def write(self, base: str | None, tables: dict[str, DataFrame], keep: int = 2) -> str:
        """Write a version that was made from ``base`` (None: from nothing) and commit it; its name."""
        number = int(base.split("-")[0]) + 1 if base else 1
        name = f"{number:08d}-{uuid.uuid4().hex}"
        for table, rows in tables.items():
            rows.write.parquet(f"{self.root}/versions/{name}/{table}")
        if self.present() != base:
            raise RuntimeError(f"the state has moved on from {base}")
        self.commit(name)
        self.clean(keep)
        return name

    def commit(self, name: str) -> None:
        self.fs.mkdirs(self._path("commits"))
        if not self.fs.createNewFile(self._path(f"commits/{name}")):
            raise RuntimeError(f"version {name} exists")

    def clean(self, keep: int) -> None:
        """Remove markers of old versions, then tables of versions without a marker that are older than the present one."""
        names = self.commits()
        for old in names[:-keep]:
            self.fs.delete(self._path(f"commits/{old}"), False)
        kept, last = set(names[-keep:]), names[-1] if names else ""
        for f in self.fs.listStatus(self._path("versions")) if self.fs.exists(self._path("versions")) else ():
            if (name := f.getPath().getName()) not in kept and name < last:
                self.fs.delete(f.getPath(), True)
