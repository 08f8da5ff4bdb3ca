"""Media columns: bytes as WAV samples, short-time spectra and spectral-peak pair fingerprints."""

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

from .common import slices, utf8

UNIT = 192  # bytes: a payload is a positive multiple
RATE = 8000
FRAME, HOP = 256, 128
PEAKS = 3  # of a frame
FAN = 5  # later peaks that a peak is paired with
AHEAD = 16  # frames between the two of a pair at most

_WINDOW = np.hanning(FRAME).astype(np.float32)
_PART = 4096  # frames of which spectra are held at once


def payload(text: bytes, unit: int = UNIT) -> bytes:
    """The bytes and spaces up to a positive multiple of ``unit``."""
    return text.ljust(max(1, -(-len(text) // unit)) * unit)


def encode(samples: bytes, rate: int = RATE) -> bytes:
    """The bytes as the unsigned 8-bit samples of a mono WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def decode(media: bytes) -> bytes:
    """The samples of a WAV file."""
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frame and frequency bin of the strongest bins of each frame that exceed both neighbours.

    Frames of FRAME samples start every HOP samples; the last one is filled with silence.
    """
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    frames = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    x = np.pad(x, (0, max(0, (frames - 1) * HOP + FRAME - len(x))))
    times, bins = [], []
    view = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    for s in range(0, frames, _PART):
        # Rounded, so that equal samples give equal peaks wherever they are computed.
        power = np.round(np.abs(np.fft.rfft(view[s : s + _PART] * _WINDOW)), 3)
        inner = power[:, 1:-1]
        inner = np.where((inner > power[:, :-2]) & (inner > power[:, 2:]), inner, -1)
        top = np.sort(np.argsort(-inner, axis=1, kind="stable")[:, :PEAKS], axis=1)
        real = np.take_along_axis(inner, top, 1) > 0
        t, k = np.nonzero(real)
        times.append(t + s)
        bins.append(top[t, k] + 1)
    return np.concatenate(times), np.concatenate(bins)


def fingerprints(samples: bytes) -> np.ndarray:
    """Time-coded pairs of peaks: frame << 32 | first bin << 16 | second bin << 8 | frames between."""
    t, f = peaks(samples)
    out = []
    for k in range(1, FAN + 1):
        gap = t[k:] - t[:-k]
        near = (gap > 0) & (gap <= AHEAD)
        out.append(t[:-k][near].astype(np.int64) << 32 | f[:-k][near] << 16 | f[k:][near] << 8 | gap[near])
    return np.sort(np.concatenate(out))



def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT, with_media: bool = False, with_fingerprints: bool = True) -> DataFrame:
    """Store each text as WAV samples and read features off the stored bytes.

    Returns per row: doc_id, n_bytes (UTF-8), payload_bytes, payload_sha256 (read back), tail_crc32
    (of the last 16 bytes read back), media_bytes, media_sha256 (the stored file), feature (pairs
    and a digest of them), fingerprints (sorted, time-coded; null if not asked for) and media (the
    file; null unless asked for).  Null text counts as empty: one unit of spaces.  A null id stays
    null, repeated rows give repeated rows, an empty table an empty one, and other columns play no
    part.  Each text is handled whole, its spectra in parts.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, fingerprints array<long>, media binary"

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                stored = encode(payload(text, unit))
                back = decode(stored)
                pairs = fingerprints(back)
                feature = f"{len(pairs)}:{hashlib.sha256(pairs.tobytes()).hexdigest()[:32]}"
                rows.append((
                    doc, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(),
                    feature, pairs if with_fingerprints else None, stored if with_media else None,
                ))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.binary())
            names = [x.split()[0] for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(convert, schema)
