"""S3: computed tables that are reused until their input changes.

A table's name ends in a digest of its input files (path, size and time of
change, from the file system's listing, so no data are read).  The same input
finds the table written before; a changed, added or removed file gives another
name, and the table is computed anew.  ``ReusedTables`` owns its folder: it alone
writes there and deletes what is out of date.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from attrita.session import scratch_path


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def input_files(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of every file under ``paths``, hidden ones left out, sorted."""
    out = []
    for path in paths:
        p, fs = _path(spark, path)
        if not fs.exists(p):
            continue
        found = fs.listFiles(p, True)
        while found.hasNext():
            f = found.next()
            if not f.getPath().getName().startswith(("_", ".")):
                out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def input_version(spark: SparkSession, paths: Sequence[str]) -> str:
    return hashlib.blake2b(repr(input_files(spark, paths)).encode(), digest_size=8).hexdigest()


class ReusedTables:
    """Tables under one folder, a sub-folder for each name and input version."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, (folder or scratch_path(spark, "reused")).rstrip("/")

    def get(self, name: str, inputs: Sequence[str], make: Callable[[], DataFrame]) -> DataFrame:
        """The table ``name`` for the present state of the files under ``inputs``, computed if it is not there; older
        versions of it are deleted once the new one is complete."""
        path = f"{self.folder}/{name}/{input_version(self.spark, inputs)}"
        done, fs = _path(self.spark, path + "/_SUCCESS")
        if not fs.exists(done):
            make().write.mode("overwrite").parquet(path)
            self.keep_only(name, path)
        return self.spark.read.parquet(path)

    def versions(self, name: str) -> list[str]:
        p, fs = _path(self.spark, f"{self.folder}/{name}")
        return sorted(f.getPath().toString() for f in fs.listStatus(p)) if fs.exists(p) else []

    def keep_only(self, name: str, path: str) -> None:
        keep = path.rsplit("/", 1)[1]
        for old in self.versions(name):
            if old.rsplit("/", 1)[1] != keep:
                self._delete(old)

    def drop(self, name: str) -> None:
        """Delete all versions of ``name``."""
        for old in self.versions(name):
            self._delete(old)

    def _delete(self, path: str) -> None:
        p, fs = _path(self.spark, path)
        fs.delete(p, True)
