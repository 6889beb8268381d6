"""Media columns: lossless 8-bit WAV bytes, read back by the wave module, with spectral fingerprints.

The fingerprints are those of acoustic matching: a short-time Fourier transform, in each frame the strongest bin of each
band, of these the ones that top their neighbours in time, and pairs of each peak with the FAN that follow it, however far
off. A pair is one integer, frame * 2**40 + (first bin * 2**31 + second bin * 2**22 + frames between), so an array of them is
sorted by time. Two recordings match where many pairs agree below the 2**40 at one distance above it. The fields hold
texts of up to 2**22 frames, 1.2 GB.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, PADDING, RATE = 576, 255, 8000
FRAME, HOP, FAN = 576, 288, 2
BANDS = (1, 10, 30, 90, 289)
MOST_FRAMES = 4096
_window = np.hanning(FRAME)


def padded(text: bytes) -> bytes:
    """Filled up to a positive multiple of BLOCK."""
    return text + bytes([PADDING]) * ((-len(text)) % BLOCK if text else BLOCK)


def wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def samples_of(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def band_peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of each frame and band: the strongest bin and its rounded magnitude. Long media go through in parts."""
    wave_form = np.frombuffer(samples, np.uint8)
    frames = np.lib.stride_tricks.sliding_window_view(wave_form, FRAME)[::HOP]
    bins, power = [], []
    for a in range(0, len(frames), MOST_FRAMES):
        part = frames[a : a + MOST_FRAMES].astype(np.float64)
        part -= part.mean(1, keepdims=True)
        size = np.rint(np.abs(np.fft.rfft(part * _window, axis=1))).astype(np.int64)
        best = np.stack([size[:, low:high].argmax(1) + low for low, high in zip(BANDS, BANDS[1:], strict=False)], 1)
        bins.append(best)
        power.append(np.take_along_axis(size, best, 1))
    return np.concatenate(bins), np.concatenate(power)


def fingerprints(samples: bytes) -> np.ndarray:
    """Time-coded pairs of spectral peaks."""
    bins, power = band_peaks(samples)
    edge = np.full((1, power.shape[1]), -1)
    top = (power > 0) & (power >= np.r_[edge, power[:-1]]) & (power > np.r_[power[1:], edge])
    frame, band = np.nonzero(top)
    peak = bins[frame, band]
    pairs = []
    for step in range(1, FAN + 1):
        pairs.append((frame[:-step] << 40) | (peak[:-step] << 31) | (peak[step:] << 22) | (frame[step:] - frame[:-step]))
    return np.sort(np.concatenate(pairs))


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row: id_col, n_bytes (of the text in UTF-8, null: 0) and media, a WAV of its padded bytes.

    A null id is carried, equal rows stay as many, no rows give no rows; other columns are left out, so no name can clash.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = [t or b"" for t in part.column("text").cast(pa.large_binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([wav(padded(t)) for t in texts], pa.binary())], names=["id", "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def read_media(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each row: id_col, n_bytes, media, payload (the samples read from it) and fingerprints (time-coded longs).

    stored: what store_media returns; media must not be null. A null id is carried, equal rows stay as many, equal media have
    equal fingerprints, no rows give no rows.
    """
    kind = stored.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                payloads = [samples_of(m) for m in part.column("media").to_pylist()]
                marks = [fingerprints(p) for p in payloads]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, marks)]).astype(np.int32)), pa.array(np.concatenate(marks) if marks else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes"), part.column("media"), pa.array(payloads, pa.binary()), lists], names=["id", "n_bytes", "media", "payload", "fingerprints"])

    return (
        stored.select(F.col(id_col).alias("id"), "n_bytes", "media")
        .mapInArrow(run, f"id {kind}, n_bytes long, media binary, payload binary, fingerprints array<long>")
        .withColumnRenamed("id", id_col)
    )
