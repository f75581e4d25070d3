"""Named tables in versions: a manifest names the folder of every table, and one new manifest switches any number of them.

A table's rows never change in place. New folders are written first; then a manifest with the next number is put in place by one
rename, which fails where another writer has taken that number. Readers see the tables of one manifest or of the next, never a
mixture, and a job that fails leaves the manifest before as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

from stayloom.session import delete_path


class CommitConflict(RuntimeError):
    """Another writer has switched one of the same tables since this writer began."""


@dataclass(frozen=True)
class Manifest:
    number: int
    tables: Mapping[str, Mapping[str, str]]  # name: folder below the root, and the schema as JSON


class VersionedTables:
    """Tables below the folder ``root``, which all executors must reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _files(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifest_path(self, number: int) -> str:
        return f"{self.root}/manifests/{number:012d}.json"

    def versions(self) -> list[int]:
        """Numbers of the manifests that are kept, oldest first."""
        folder = self._path(f"{self.root}/manifests")
        if not self._files().exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files().listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, number: int | None = None) -> Manifest:
        """The manifest of that number, or the current one."""
        numbers = self.versions()
        if number is None:
            number = numbers[-1] if numbers else 0
        if number == 0:
            return Manifest(0, {})
        if number not in numbers:
            raise KeyError(f"no version {number} below {self.root}")
        return Manifest(number, json.loads(self.spark.read.text(self._manifest_path(number), wholetext=True).first()[0]))

    def names(self) -> list[str]:
        return sorted(self.manifest().tables)

    def read(self, name: str, number: int | None = None) -> DataFrame:
        """A table as of a version, by default the current one."""
        entry = self.manifest(number).tables[name]
        return self._open(entry)

    __getitem__ = read

    def _open(self, entry: Mapping[str, str]) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(entry["schema"]))).parquet(f"{self.root}/{entry['folder']}")

    def batch(self) -> Batch:
        """Writes that become visible together."""
        return Batch(self)

    def write(self, frames: Mapping[str, DataFrame]) -> Manifest:
        """New versions of several tables, switched at once. The frames may read the tables they replace."""
        batch = self.batch()
        for name, df in frames.items():
            batch.write(name, df)
        return batch.commit()

    def update(self, name: str, column: str, value: Column) -> DataFrame:
        """Set one column of a table for every row: a new version of it, which is returned as read back."""
        batch = self.batch()
        now = self._open(batch.start.tables[name])
        batch.write(name, now.withColumn(column, value).select(*now.columns, *([] if column in now.columns else [column])))
        return self.read(name, batch.commit().number)

    def _put(self, number: int, tables: Mapping[str, Mapping[str, str]]) -> bool:
        files = self._files()
        files.mkdirs(self._path(f"{self.root}/manifests"))
        draft, final = self._path(f"{self.root}/manifests/{uuid.uuid4().hex}.draft"), self._path(self._manifest_path(number))
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(tables, sort_keys=True).encode()))
        out.close()
        if files.exists(final) or not files.rename(draft, final):
            files.delete(draft, False)
            return False
        return True

    def remove_before(self, number: int) -> list[str]:
        """Remove the manifests before ``number`` and the folders that none of the kept ones names; returns those folders."""
        kept = {e["folder"] for n in self.versions() if n >= number for e in self.manifest(n).tables.values()}
        old = [n for n in self.versions() if n < number]
        gone = sorted({e["folder"] for n in old for e in self.manifest(n).tables.values()} - kept)
        for n in old:
            delete_path(self.spark, self._manifest_path(n))
        for folder in gone:
            delete_path(self.spark, f"{self.root}/{folder}")
        return gone


class Batch:
    """Folders written for the next version; nothing is visible before ``commit``."""

    def __init__(self, store: VersionedTables):
        self.store, self.start = store, store.manifest()
        self.tables: dict[str, dict[str, str]] = {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Write a table's new folder and return it read back, so that further tables of the batch can start from it."""
        folder = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.store.root}/{folder}")
        self.tables[name] = {"folder": folder, "schema": df.schema.json()}
        return self.store._open(self.tables[name])

    def commit(self) -> Manifest:
        """Switch all tables of the batch by one manifest.

        Other tables that were switched meanwhile keep their new versions; a table of this batch that was makes it fail.
        """
        while True:
            now = self.store.manifest()
            for name in self.tables:
                if now.tables.get(name) != self.start.tables.get(name):
                    raise CommitConflict(f"{name} has changed since version {self.start.number}")
            merged = {**now.tables, **self.tables}
            if self.store._put(now.number + 1, merged):
                return Manifest(now.number + 1, merged)
