"""Media columns: bytes stored as WAV, read by the wave module, with spectral-peak pair fingerprints.

A payload is the text's UTF-8 bytes and zero bytes up to a positive multiple of 64, stored
as 8-bit mono samples. Features: a short-time Fourier transform (frames of FRAME samples,
Hann window, hop HOP), in each frame the strongest bin of each of BANDS bands if it exceeds
the frame's mean magnitude, and pairs of peaks of neighbouring frames packed with their time
into one 64-bit number: ``frame << 32 | bin << 20 | later bin << 8 | frames between``. The
array is ordered by time. Frames are transformed in blocks; of a sound the payload, the WAV
and the codes (about as many bytes each, the codes up to half a number a sample) are held whole.

Defined cases: null text counts as empty: 64 zero samples, one frame, no peak.
Equal texts give equal values: nothing depends on the row or its place.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailnote.llm.common import mapped

UNIT, RATE = 64, 8000
FRAME, HOP, BANDS, AHEAD = 256, 128, 4, 2
BLOCK = 512  # frames transformed at once
_HANN = np.hanning(FRAME).astype(np.float32)
#: Bins 1..128 in BANDS equal bands.
_WIDE = FRAME // 2 // BANDS


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as sound:
        sound.setnchannels(1)
        sound.setsampwidth(1)
        sound.setframerate(RATE)
        sound.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as sound:
        return sound.readframes(sound.getnframes())


def peaks(samples: np.ndarray) -> np.ndarray:
    """(frames, BANDS) of the strongest bin, or 0 where the band has no peak."""
    n = max(1, -(-max(len(samples) - FRAME, 0) // HOP) + 1)
    found = np.zeros((n, BANDS), np.int64)
    for at in range(0, n, BLOCK):
        padded = np.full((min(BLOCK, n - at) - 1) * HOP + FRAME, 128, np.float32)
        own = samples[at * HOP : at * HOP + len(padded)]
        padded[: len(own)] = own
        part = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP] - np.float32(128)
        spectrum = np.abs(np.fft.rfft((part - part.mean(1, keepdims=True)) * _HANN))[:, 1:]
        bands = spectrum.reshape(len(spectrum), BANDS, _WIDE)
        best = bands.argmax(2)
        strong = np.take_along_axis(bands, best[:, :, None], 2)[:, :, 0] > np.maximum(spectrum.mean(1, keepdims=True), 1e-3)
        found[at : at + BLOCK] = np.where(strong, best + 1 + np.arange(BANDS) * _WIDE, 0)
    return found


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Time-coded peak pairs, ordered by time."""
    bins, out = peaks(samples), []
    for ahead in range(1, AHEAD + 1):
        near, far = bins[:-ahead], bins[ahead:]
        t, band = np.nonzero((near > 0) & (far > 0)) if len(far) else (np.zeros(0, np.int64),) * 2
        out.append(t << 32 | near[t, band] << 20 | far[t, band] << 8 | ahead)
    return np.sort(np.concatenate(out))


def stored(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, wav): the media column itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                raw = [(x.as_py() or "").encode() for x in part.column(1)]
                wavs = [to_wav(x + bytes(-len(x) % UNIT or (0 if x else UNIT))) for x in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array(wavs, pa.binary())], ["doc_id", "n_bytes", "wav"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), run, "doc_id long, n_bytes long, wav binary")


def features(media: DataFrame) -> DataFrame:
    """What the stored bytes give: digests, the fingerprint array and feature, its SHA-256 and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows = []
                for ids, n, wav in zip(*(c.to_pylist() for c in part.columns)):
                    payload = from_wav(wav)
                    codes = fingerprint(np.frombuffer(payload, np.uint8))
                    rows.append((ids, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(wav), hashlib.sha256(wav).hexdigest(), f"{len(codes)}:{hashlib.sha256(codes.astype('<i8').tobytes()).hexdigest()}", codes))
                *plain, codes = zip(*rows)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, codes)], dtype=np.int32)), pa.array(np.concatenate(codes).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(plain, _TYPES)), lists], _NAMES)

    return mapped(media.select("doc_id", "n_bytes", "wav"), run, _SCHEMA)


_NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "fingerprint"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, fingerprint array<long>"
