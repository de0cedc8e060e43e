"""WARC archives: a writer of one gzip member a record, and a splittable reader.

Archives have one gzip member for each record, so any member is a place to start.  A reading task scans its byte range for gzip
magic, checks each candidate by decoding the member's first bytes up to a WARC version line, and owns the records whose
members start inside its range; it reads past the range's end to finish the last one.

Records with equal payloads (by SHA-1, from ``min_bytes`` on) share one response, that of the largest page id; the others are
revisit records without a block that carry the digest and refer to it.

Edge cases: a null payload is empty; a null page id is written as ``-``, and never answers for others unless all its copies
have null ids; rows that repeat both id and payload are one response each (neither revisits itself); an empty table gives no
archive; other columns are ignored; payloads that hold gzip magic or WARC headers are told apart, since inside a member they are
compressed and a false candidate does not decode to a version line.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import file_system, materialise, new_dir

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 16 << 20
WINDOW = 1 << 16
DATE = "2024-01-01T00:00:00Z"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
MANIFEST = "name string, size long, records long"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None) -> str:
    return f"urn:page:{'-' if page_id is None else page_id}"


def page_of(uri: str) -> int | None:
    tail = uri.strip("<>").rpartition(":")[2]
    return None if tail == "-" else int(tail)


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as it stands in the archive, uncompressed."""
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{record_uri(page_id)}>",
        "WARC-Target-URI": "".join(c if " " < c < "\x7f" else "%" + c.encode("utf-8", "replace").hex() for c in url or ""),
        "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}",
        "X-Payload-Length": str(len(payload)),
        "Content-Type": "text/html; charset=utf-8",
    }
    if refers_to is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{record_uri(refers_to)}>"}
    block = payload if refers_to is None else b""
    lines = "".join(f"{k}: {v}\r\n" for k, v in (head | {"Content-Length": str(len(block))}).items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    revisit = fields["WARC-Type"] == "revisit"
    block = rest[: int(fields["Content-Length"])]
    return {
        "page_id": page_of(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI") or None,
        "payload_bytes": int(fields["X-Payload-Length"]) if revisit else len(block),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else sha1_base32(block),
        "record_type": fields["WARC-Type"],
        "refers_to": page_of(fields["WARC-Refers-To"]) if revisit else None,
        "payload": None if revisit else block,
    }


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
    size = records = 0
    out = None
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for row in batch.slice(at, 256).to_pylist():
                out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                member = gzip_member(write_record(row["page_id"], row["url"], (row["html"] or "").encode("utf-8", "replace"), row["refers_to"]))
                out.write(member)
                size += len(member)
                records += 1
    if out:
        out.close()
        yield pa.RecordBatch.from_pylist([{"name": name, "size": size, "records": records}], pa.schema([("name", pa.string()), ("size", pa.int64()), ("records", pa.int64())]))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes ``pages(page_id, url, html)`` and returns the manifest (name, size, records) of committed archives."""
    rows = pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "cast(html as string) as html").withColumn("digest", F.sha1(F.coalesce(F.col("html").cast("binary"), F.lit(b""))))
    long_enough = F.octet_length(F.coalesce("html", F.lit(""))) >= min_bytes
    shared = rows.where(long_enough).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies")).where("copies > 1").select("digest", "keeper")
    # only payloads that repeat are joined; Spark splits a digest that holds many rows
    decided = rows.join(shared, "digest", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")))
    return materialise(decided.select("page_id", "url", "html", "refers_to").mapInArrow(lambda it: _write(it, folder), MANIFEST), "warc-manifest")


def starts(f, size: int, lo: int, hi: int) -> Iterator[int]:
    """Offsets in [lo, hi) where a member of a record starts."""
    for at in range(lo, hi, WINDOW):
        f.seek(at)
        data = f.read(min(WINDOW, hi - at) + len(MAGIC) - 1)
        k = data.find(MAGIC)
        while k >= 0:
            f.seek(at + k)
            try:
                head = zlib.decompressobj(31).decompress(f.read(512), 9)
            except zlib.error:
                head = b""
            if head.startswith(b"WARC/1."):
                yield at + k
            k = data.find(MAGIC, k + 1)


def read_member(f, at: int) -> bytes:
    f.seek(at)
    z, out = zlib.decompressobj(31), io.BytesIO()
    while not z.eof:
        data = f.read(WINDOW)
        if not data:
            raise EOFError(f"member at {at} is cut off")
        out.write(z.decompress(data))
    return out.getvalue()


def _read(batches: Iterator[pa.RecordBatch], folder: str, payloads: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    fs, root = file_system(folder)
    for batch in batches:
        for split in batch.to_pylist():
            with fs.open_input_file(f"{root}/{split['name']}") as f:
                out, held = [], 0
                for at in starts(f, split["size"], split["lo"], split["hi"]):
                    row = parse_record(read_member(f, at))
                    held += row["payload_bytes"]
                    out.append(row if payloads else row | {"payload": None})
                    if len(out) >= 1024 or held > 16 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, schema)


def read_archives(manifest: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """All records of the archives; one task for each byte range of ``split_bytes``."""
    ranges = manifest.select("name", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("lo"))
    ranges = ranges.withColumn("hi", F.least("size", F.col("lo") + split_bytes))
    n = manifest.agg(F.sum(F.ceil(F.col("size") / split_bytes)).alias("n")).first()["n"] or 1
    return ranges.repartition(int(n)).mapInArrow(lambda it: _read(it, folder, payloads), RECORDS)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` as archives, read back."""
    folder = new_dir(spark, "warc")
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(manifest, folder, split_bytes=1 << 20, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
