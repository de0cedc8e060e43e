"""Tables as numbered snapshots with an atomic pointer to the committed one.

A snapshot is a folder of Parquet that Spark's committed writer fills.  It is published by a small file that bears the snapshot's number and holds its folder's name:
the file is written aside and renamed to its place, which fails if another writer took that number.  Readers see the greatest
number, so a writer that dies leaves the last snapshot readable, and of two writers that started from one snapshot only one wins.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTERS = "_versions"


class Conflict(RuntimeError):
    """Another writer has published the number meanwhile."""


class Snapshots:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._fs = jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, *names: str):
        return self._fs.Path("/".join((self.path, *names)))

    def versions(self) -> dict[int, str]:
        """Folder of each published number."""
        fs = self._at().getFileSystem(self._conf)
        if not fs.exists(self._at(POINTERS)):
            return {}
        names = [x.getPath().getName() for x in fs.listStatus(self._at(POINTERS))]
        found = {}
        for name in names:
            if name.isdigit():
                stream = fs.open(self._at(POINTERS, name))
                try:
                    found[int(name)] = stream.readUTF()
                finally:
                    stream.close()
        return found

    def latest(self) -> int | None:
        return max(self.versions(), default=None)

    def read(self, number: int | None = None) -> DataFrame | None:
        """The snapshot of a number, or the latest; None where nothing is published."""
        versions = self.versions()
        if not versions:
            return None
        return self.spark.read.parquet(f"{self.path}/{versions[max(versions) if number is None else number]}")

    def write(self, rows: DataFrame) -> str:
        """Writes a snapshot that isn't published yet."""
        folder = f"snapshot-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def publish(self, folder: str, after: int | None) -> int:
        """Makes a written snapshot the one after number ``after`` (None: the first)."""
        fs, number = self._at().getFileSystem(self._conf), 0 if after is None else after + 1
        aside = self._at(POINTERS, f".{folder}")
        stream = fs.create(aside, False)
        stream.writeUTF(folder)
        stream.close()
        context = self._fs.FileContext.getFileContext(aside.toUri(), self._conf)
        how = self.spark.sparkContext._gateway.new_array(getattr(self._fs, "Options$Rename"), 0)
        try:
            context.rename(aside, self._at(POINTERS, f"{number:010d}"), how)
        except Exception as e:
            fs.delete(aside, False)
            if "already exist" in str(e) or "FileAlreadyExists" in str(e):
                raise Conflict(f"{self.path}: number {number} is taken") from e
            raise
        return number

    def commit(self, rows: DataFrame, after: int | None) -> int:
        return self.publish(self.write(rows), after)

    def refresh(self, rows: DataFrame, changed: str, after: int | None) -> int | None:
        """Publishes ``rows`` without their column ``changed`` if any of them changed; the number that holds now."""
        folder = self.write(rows)
        written = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{folder}")
        if after is not None and written.where(F.col(changed)).isEmpty():
            return after
        return self.publish(folder, after)
