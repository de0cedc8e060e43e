"""Media columns: WAV bytes in a binary column, spectra, and time-coded spectral-peak fingerprints.

A media value is a one-channel WAV file of 8-bit samples written by the ``wave`` module.  Features come from
the stored bytes as read back from the written table: frames of 192 samples that overlap by half, a Hann window and a short-time Fourier transform;
in each frame the local maxima over frequency that exceed their neighbour frames too are peaks; each peak is paired with the next peaks in time, and a pair
(frequency, frequency, distance) with the anchor's frame is one fingerprint.  The array holds ``frame << 32 | pair``, in time
order.

Edge cases: a null or empty payload is padded to one block of blanks, so no media value is empty; a null
media value has null features; repeated rows are apart but alike, an empty table gives no rows, other columns are ignored; silence has no peaks and an empty array; equal payloads have equal media, arrays and features;
very long payloads go through frame blocks of fixed size.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise

BLOCK = 192
#: Samples from one frame to the next.
HOP = 96
FAN = 3
REACH = 8
FRAMES = 8192
RATE = 8000


def to_wav(payload: bytes) -> bytes:
    """Bytes as 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, frequency bin) of the spectral peaks, in time order: the strongest bin among its neighbours in time and frequency, above the frame's mean."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, BLOCK)[::HOP]
    window = np.hanning(BLOCK).astype(np.float32)
    found = []
    for at in range(0, len(frames), FRAMES):
        lo, hi = max(0, at - 1), min(len(frames), at + FRAMES + 1)
        x = frames[lo:hi].astype(np.float32) - np.float32(128)
        power = np.abs(np.fft.rfft((x - x.mean(1, keepdims=True)) * window, axis=1)).astype(np.float32)
        mid = np.pad(power, 1, constant_values=-1)
        top = (power > mid[1:-1, :-2]) & (power > mid[1:-1, 2:]) & (power >= mid[:-2, 1:-1]) & (power >= mid[2:, 1:-1]) & (power > 2 * power.mean(1, keepdims=True))
        t, f = np.nonzero(top)
        own = (t + lo >= at) & (t + lo < min(len(frames), at + FRAMES))
        found.append((t[own] + lo, f[own]))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def fingerprints(samples: np.ndarray) -> np.ndarray:
    """``frame << 32 | f1 << 16 | f2 << 8 | distance`` for each peak and each of the next FAN peaks within REACH frames."""
    t, f = peaks(samples)
    pairs = []
    for k in range(1, FAN + 1):
        gap = t[k:] - t[:-k]
        near = gap <= REACH
        pairs.append((t[:-k][near].astype(np.int64) << 32) | (f[:-k][near].astype(np.int64) << 16) | (f[k:][near].astype(np.int64) << 8) | gap[near].astype(np.int64))
    return np.sort(np.concatenate(pairs))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            rows = batch.slice(at, 512)
            data = [x or b"" for x in rows.column("payload").to_pylist()]
            wavs = [to_wav(x + b" " * (max(BLOCK, -(-len(x) // BLOCK) * BLOCK) - len(x))) for x in data]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([len(x) for x in data], pa.int64()), pa.array(wavs, pa.binary())], ["doc_id", "n_bytes", "media"])


def media_column(payloads: DataFrame) -> DataFrame:
    """``payloads(doc_id, payload binary)`` to (doc_id, n_bytes unpadded, media): blanks fill the payload up to a positive multiple of 192."""
    return payloads.select("doc_id", "payload").mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, fingerprints array<long>"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _FEATURES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            out = []
            for row in batch.slice(at, 512).to_pylist():
                if (media := row["media"]) is None:
                    out.append({"doc_id": row["doc_id"], "n_bytes": row["n_bytes"]})
                    continue
                data = from_wav(media)
                out.append(
                    {
                        "doc_id": row["doc_id"],
                        "n_bytes": row["n_bytes"],
                        "payload_bytes": len(data),
                        "payload_sha256": hashlib.sha256(data).hexdigest(),
                        "tail_crc32": zlib.crc32(data[-16:]),
                        "media_bytes": len(media),
                        "media_sha256": hashlib.sha256(media).hexdigest(),
                        "fingerprints": fingerprints(np.frombuffer(data, np.uint8)),
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema)


def media_features(media: DataFrame) -> DataFrame:
    """What the stored bytes of ``media(doc_id, n_bytes, media)`` hold: sizes, digests and the fingerprint array."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, _FEATURES)


def op7_wav_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` as WAV payloads; ``feature`` is the number of fingerprints and a digest of the time-coded array."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    payloads = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("payload"))
    found = media_features(materialise(media_column(payloads), "media"))
    feature = F.concat_ws(":", F.size("fingerprints").cast("string"), F.md5(F.array_join(F.col("fingerprints").cast("array<string>"), ",")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
