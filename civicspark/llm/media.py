"""Operator 3: media columns. Bytes kept losslessly as WAV, with spectral-peak pair fingerprints.

Each payload becomes an 8-bit mono WAV file written and read by the standard ``wave`` module. A
short-time Fourier transform over the samples that were read back, in frames that overlap by half, gives
up to ``PEAKS`` spectral peaks a frame; a peak is paired with those of the ``REACH`` frames that follow, and the pairs are kept as time-coded arrays
(``times[i]`` is the frame, ``codes[i]`` packs both frequencies and the distance).

Edge cases: a null or empty text is one block of 64 zero bytes, whose spectrum has no peak, so its
arrays are empty. Equal payloads give equal columns, repeated rows stay repeated, extra columns of
the input are dropped, an empty table gives an empty table. Every text is read whole; frames are
transformed in blocks, so memory follows one text, not the table.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.llm.common import map_arrow, table, utf8

BLOCK = 64
RATE = 8000
FRAME = 256
HOP = 128
PEAKS = 3
REACH = 3
FRAMES_AT_ONCE = 4096
SCHEMA = (
    "doc_id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, times array<int>, codes array<int>"
)


def pad(data: bytes) -> bytes:
    return data + bytes(BLOCK - len(data) % BLOCK if len(data) % BLOCK or not data else 0)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        return f.readframes(f.getnframes())


def spectral_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame and frequency bin of the strongest local maxima of each frame, frame by frame."""
    frames = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    padded = np.zeros((frames - 1) * HOP + FRAME, np.float32)
    padded[: len(samples)] = samples
    padded[: len(samples)] -= np.float32(128)
    window = np.hanning(FRAME).astype(np.float32)
    when, what = [], []
    for at in range(0, frames, FRAMES_AT_ONCE):
        n = min(FRAMES_AT_ONCE, frames - at)
        block = np.lib.stride_tricks.as_strided(padded[at * HOP :], (n, FRAME), (padded.strides[0] * HOP, padded.strides[0]))
        power = np.abs(np.fft.rfft(block * window, axis=1)).astype(np.float32)
        inner = power[:, 1:-1]
        top = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]), inner, np.float32(0))
        bins = np.argsort(-top, axis=1, kind="stable")[:, :PEAKS]  # of equal ones the lower
        bins.sort(axis=1)
        strong = np.take_along_axis(top, bins, axis=1) > 1.0
        rows = np.broadcast_to(np.arange(at, at + n)[:, None], bins.shape)
        when.append(rows[strong])
        what.append(bins[strong] + 1)
    return np.concatenate(when), np.concatenate(what)


def peak_pairs(when: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time-coded pairs of each peak with the next peaks, at most REACH frames ahead."""
    times, codes = [], []
    for ahead in range(1, PEAKS * (REACH + 1)):
        if ahead >= len(when):
            break
        gap = when[ahead:] - when[:-ahead]
        near = (gap >= 1) & (gap <= REACH)
        times.append(when[:-ahead][near])
        codes.append((what[:-ahead][near] << 16) | (what[ahead:][near] << 4) | gap[near])
    if not times:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


def _media(batch: pa.RecordBatch) -> pa.RecordBatch:
    out: list[list] = [[] for _ in range(9)]
    for data in batch.column("text"):
        data = data.as_py()
        media = to_wav(pad(data))
        back = from_wav(media)
        times, codes = peak_pairs(*spectral_peaks(np.frombuffer(back, np.uint8)))
        row = (len(data), media, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), times, codes)
        for column, value in zip(out, row, strict=True):
            column.append(value)
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    names = ["n_bytes", "media", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "times", "codes"]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))], ["doc_id", *names])


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, the WAV file, its sizes and digests, and the time-coded fingerprint arrays."""
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")), _media, SCHEMA)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digests; ``feature`` is the pair count, the last frame and a digest of the pairs."""
    found = media_columns(table(spark, sf_dir, "documents"))
    pairs = F.concat_ws(",", F.zip_with("times", "codes", lambda t, c: F.concat_ws(":", t.cast("string"), c.cast("string"))))
    feature = F.concat_ws(":", F.size("times").cast("string"), F.coalesce(F.try_element_at("times", F.lit(-1)), F.lit(-1)).cast("string"), F.sha2(pairs, 256))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
