"""The folder that driver and executors share, and tables that cut lineage there.

``spark.checkpoint.dir`` names the folder.  Where it is unset a local master (tests) gets a folder of
its own, any other an error.  Tables go there as Parquet through Spark's committed writer, so a lost executor
costs its running tasks only; binary files are named by task attempt, and only names that
reach a committed table are ever read.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def base_dir(spark: SparkSession) -> str:
    """URI of the shared folder."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _OWN:
        import tempfile

        _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="sextant-")
    return _OWN["dir"]


def new_dir(spark: SparkSession, label: str) -> str:
    """URI of a folder that nobody has used yet."""
    return f"{base_dir(spark)}/{label}-{uuid.uuid4().hex}"


def local_path(uri: str) -> str | None:
    """The mounted path behind a URI, or None if only a file system client reaches it."""
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def file_system(uri: str):
    """(pyarrow file system, path in it); a mounted path is created."""
    from pyarrow import fs

    if path := local_path(uri):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(uri)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes a DataFrame to the shared folder and returns it as read from there."""
    spark = df.sparkSession
    path = new_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, uri: str) -> None:
    """Deletes a folder that this module has named."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
