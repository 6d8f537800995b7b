"""Media columns: bytes stored as 8-bit WAV, read back, and described by pairs of spectral peaks."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, table

FRAME, HOP, RATE = 256, 128, 8000
#: Bins of the spectrum in which one peak a frame is looked for.
BANDS = ((4, 16), (16, 44), (44, 124))
FAN, REACH, QUIET = 3, 63, 1e-3


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """One-channel WAV with a byte a sample."""
    with io.BytesIO() as out:
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(rate)
            w.writeframes(payload)
        return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        if w.getnchannels() != 1 or w.getsampwidth() != 1:
            raise ValueError("one channel of 8-bit samples is expected")
        return w.readframes(w.getnframes())


def power_spectrum(samples: np.ndarray, block: int = 4096) -> Iterator[np.ndarray]:
    """Short-time Fourier transform (Hann window): squared magnitudes, frames by bins, ``block`` frames at a time.
    The end is padded with silence to a whole frame."""
    count = max(1, -(-(len(samples) - FRAME) // HOP) + 1) if len(samples) > FRAME else 1
    for first in range(0, count, block):
        n = min(block, count - first)
        x = samples[first * HOP : (first + n - 1) * HOP + FRAME]
        x = (x.astype(np.float32) - np.float32(128)) / np.float32(128)
        x = np.pad(x, (0, (n - 1) * HOP + FRAME - len(x)))
        frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
        z = np.fft.rfft(frames * _HANN, axis=1)
        yield z.real**2 + z.imag**2


_HANN = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)).astype(np.float32)


def peak_pairs(power: Iterable[np.ndarray]) -> tuple[int, np.ndarray]:
    """The number of frames in ``power`` (blocks of them), and time-coded pairs of peaks, in order of time: frame << 32 | bin << 20 | bin of the later peak << 8 | frames between.

    A peak is the strongest bin of a band where it exceeds the same band's strongest of the frames before and after it.
    Each peak is paired with the ``FAN`` next peaks, in order of time and then bin, that lie at most ``REACH`` frames on.
    """
    found = [[] for _ in BANDS]
    for some in power:
        for (low, high), of in zip(BANDS, found, strict=True):
            best = some[:, low:high].argmax(axis=1)
            of.append((best, some[np.arange(len(some)), best + low]))
    times, bins = [], []
    for (low, _), of in zip(BANDS, found, strict=True):
        best, top = (np.concatenate(x) for x in zip(*of, strict=True))
        side = np.pad(top, 1, constant_values=-1)
        t = np.flatnonzero((top > side[:-2]) & (top > side[2:]) & (top > QUIET))
        times.append(t)
        bins.append(best[t] + low)
    t, f = np.concatenate(times).astype(np.int64), np.concatenate(bins).astype(np.int64)
    order = np.lexsort((f, t))
    t, f = t[order], f[order]
    out = []
    for k in range(1, FAN + 1):
        gap = t[k:] - t[:-k]
        ok = gap <= REACH
        out.append(((t[:-k] << 32) | (f[:-k] << 20) | (f[k:] << 8) | gap)[ok] if len(t) > k else np.zeros(0, np.int64))
    return len(best), np.sort(np.concatenate(out))


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 64) -> DataFrame:
    """Store each whole text as a WAV column: (doc_id, n_bytes, media).

    The payload is the text's UTF-8 bytes (null: none) and zeros up to a positive multiple of ``block``.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            media = [to_wav(x + bytes(max(block, -(-len(x) // block) * block) - len(x))) for x in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def describe_media(stored: DataFrame) -> DataFrame:
    """Read stored WAV columns back: adds payload, payload_sha256, tail_crc32, n_frames and peaks (time-coded array)."""
    kind = stored.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in b.column(2).to_pylist():
                p = from_wav(m)
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), *peak_pairs(power_spectrum(np.frombuffer(p, np.uint8)))))
            c = list(zip(*rows, strict=True)) if rows else [[]] * 7
            arrays = [b.column(0), b.column(1), *[pa.array(x, k) for x, k in zip(c, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64())), strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "peaks"])

    return stored.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, peaks array<long>")


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts stored as WAV, read back and described: (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, n_frames, peaks).

    Rows are independent: nothing is shuffled, rows keep their multiplicity, ids may be null or repeat, equal texts have
    equal values. Null and empty texts are one block of zeros. An empty table gives an empty result. Only the two named
    columns are read.
    """
    return describe_media(encode_media(docs, id_col, text_col))


def op5_media(spark, sf_dir):
    """Every text as a stored WAV, read back; the feature digests its time-coded peaks."""
    m = media_features(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.array_join(F.col("peaks").cast("array<string>"), ","), 256)
    return m.withColumn("feature", F.concat_ws(":", "n_frames", F.size("peaks"), digest)).drop("n_frames", "peaks")
