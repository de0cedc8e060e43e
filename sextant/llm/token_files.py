"""Token-id output: flat unsigned integer files with 64-bit document offsets.

A corpus is a folder of parts.  A part has three flat files, each readable by memory map:

* ``<part>.bin``  ids, ``<u2`` if the vocabulary allows it, else ``<u4``
* ``<part>.off``  ``<i8`` offsets in ids, one more than documents, from 0
* ``<part>.doc``  ``<i8`` document ids (``MISSING`` for a null id)

and a row in the manifest table ``(part, name, n_docs, n_ids)``.  Parts are in ascending document
order; the base of a part is the sum of the ids of the parts before it, so the global offset of a document is
base + offset and no task needs to know the others' sizes while writing.

Edge cases: a null or empty text holds the end id alone; null ids sort first; rows that share an id stay apart,
ordered by a hash of the text; an empty table gives an empty corpus; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import file_system, local_path, materialise, new_dir
from .tokens import default_vocabulary, encoder

MISSING = -(1 << 63)
MANIFEST = "part int, name string, n_docs long, n_ids long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _write_part(batches: Iterator[pa.RecordBatch], folder: str, vocabulary: str, end_id: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(vocabulary, end_id)
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    part = TaskContext.get().partitionId()
    name = f"part-{part:06d}-{uuid.uuid4().hex}"
    n_docs = n_ids = 0
    with fs.open_output_stream(f"{root}/{name}.bin") as ids, fs.open_output_stream(f"{root}/{name}.off") as off, fs.open_output_stream(f"{root}/{name}.doc") as doc:
        off.write(np.zeros(1, "<i8").tobytes())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                encoded = enc.encode(rows.column("text").to_pylist())
                sizes = np.array([len(x) for x in encoded], np.int64) // enc.dtype.itemsize
                ids.write(b"".join(encoded))
                off.write((n_ids + np.cumsum(sizes)).astype("<i8").tobytes())
                doc.write(rows.column("doc_id").fill_null(MISSING).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                n_docs += rows.num_rows
                n_ids += int(sizes.sum())
    if n_docs:
        yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "n_docs": n_docs, "n_ids": n_ids}], pa.schema([("part", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))
    else:
        for kind in ("bin", "off", "doc"):
            fs.delete_file(f"{root}/{name}.{kind}")


def write_token_files(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """Writes ``docs(doc_id, text)`` in ascending doc_id order to ``folder``; returns the manifest with each part's ``base``."""
    vocabulary = vocabulary or default_vocabulary()
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    parts = materialise(ordered.mapInArrow(lambda it: _write_part(it, folder, vocabulary, end_id), MANIFEST), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _flat(fs, root: str, folder: str, name: str, dtype) -> np.ndarray:
    """A flat file as an array: mapped where it is mounted, else read."""
    if (path := local_path(folder)) is not None:
        return np.memmap(f"{path}/{name}", dtype, "r")
    with fs.open_input_file(f"{root}/{name}") as f:
        return np.frombuffer(f.read(), dtype)


def _read_parts(batches: Iterator[pa.RecordBatch], folder: str, dtype: str) -> Iterator[pa.RecordBatch]:
    fs, root = file_system(folder)
    for batch in batches:
        for row in batch.to_pylist():
            offsets, docs = (_flat(fs, root, folder, f"{row['name']}.{kind}", "<i8") for kind in ("off", "doc"))
            ids = _flat(fs, root, folder, f"{row['name']}.bin", dtype)
            for at in range(0, len(docs), 4096):
                ends = offsets[at : at + 4097].tolist()
                crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(ends, ends[1:], strict=False)]
                own = np.asarray(docs[at : at + 4096])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, mask=own == MISSING), pa.array(row["base"] + np.asarray(ends[:-1])), pa.array(np.diff(ends)), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )


def read_token_files(manifest: DataFrame, folder: str, vocabulary: str | None = None) -> DataFrame:
    """One row for each document of the parts: doc_id, global start, n_tokens and the crc32 of its ids as unsigned 32-bit integers."""
    dtype = encoder(vocabulary or default_vocabulary()).dtype.str
    return manifest.repartition(max(1, manifest.count())).mapInArrow(lambda it: _read_parts(it, folder, dtype), READ)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` as token-id files, read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = new_dir(spark, "token-files")
    return read_token_files(write_token_files(docs, folder), folder)
