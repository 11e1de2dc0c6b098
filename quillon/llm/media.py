"""Media columns: text bytes as WAV sound, short-time Fourier transform, spectral-peak pair fingerprints.

``store(payload)`` makes an 8-bit mono WAV file, ``load`` reads its samples back with the wave module.
``media_columns`` adds them and an array of time-coded peak pairs to each row.

Defined cases: a null text is the empty text; it and any other text are padded with spaces to a positive
multiple of 192 bytes. A constant signal has no spectral peak, so its array is empty. Equal texts give equal
values. Other columns of the input are not read, so clashing names do no harm.
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

from . import common

UNIT, HOP, RATE = 192, 96, 8000
#: Peaks that each frame may give, and later peaks that each is paired with.
PEAKS, FAN = 2, 3
#: Frames that are transformed at once.
FRAMES = 2048
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, media binary, pairs array<long>"


def pad(data: bytes) -> bytes:
    return data + b" " * (-len(data) % UNIT or (0 if data else UNIT))


def store(payload: bytes) -> bytes:
    """A WAV file with one 8-bit sample for each byte."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def load(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(data: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(frame, bin) of the peaks, FRAMES frames at a time. owner: the sound of each hop of ``data``."""
    frames = np.lib.stride_tricks.sliding_window_view(data, UNIT)[::HOP]
    window = np.hanning(UNIT + 1)[:-1].astype(np.float32)
    inside = np.flatnonzero(owner[:-1] == owner[1:])  # a frame covers two hops of one sound
    for i in range(0, len(inside), FRAMES):
        low, high = max(0, i - 1), min(len(inside), i + FRAMES + 1)  # one frame more on both sides
        at = inside[low:high]
        block = frames[at].astype(np.float32) - 128
        mag = np.abs(np.fft.rfft((block - block.mean(1, keepdims=True)) * window, axis=1)).astype(np.float32)
        peak = np.zeros(mag.shape, bool)
        peak[:, 1:-1] = (mag[:, 1:-1] > mag[:, :-2] + 1e-3) & (mag[:, 1:-1] > mag[:, 2:] + 1e-3)
        same = owner[at[1:]] == owner[at[:-1]]
        peak[1:] &= ~same[:, None] | (mag[1:] >= mag[:-1])
        peak[:-1] &= ~same[:, None] | (mag[:-1] >= mag[1:])
        own = slice(i - low, min(len(inside), i + FRAMES) - low)
        strength = np.where(peak[own], mag[own], -1)
        top = np.argpartition(-strength, PEAKS, axis=1)[:, :PEAKS]
        top.sort(axis=1)
        frame, col = np.nonzero(np.take_along_axis(strength, top, 1) > 0)
        yield at[own][frame], top[frame, col]


def peak_pairs(samples: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Time-coded pairs of each sound, flat, and offsets.

    Frames of UNIT samples every HOP samples, Hann window, magnitudes. A peak is a bin larger than both its
    neighbours in frequency and not smaller than itself one frame before and after; of each frame the PEAKS
    strongest count. Each is paired with the next FAN peaks of its sound: frame << 32 | bin << 24 | bin << 16
    | frames between.
    """
    sizes = np.array([len(s) for s in samples]) // HOP
    owner = np.repeat(np.arange(len(samples)), sizes)
    found = [*zip(*peaks(np.frombuffer(b"".join(samples), np.uint8), owner), strict=True)] or [[np.zeros(0, np.int64)]] * 2
    frame, freq = map(np.concatenate, found)
    who = owner[frame]
    t = frame - (np.cumsum(sizes) - sizes)[who]
    parts, order = [], []
    n = len(frame)
    for step in range(1, FAN + 1):
        a, b = slice(0, max(0, n - step)), slice(step, n)
        ok = who[a] == who[b]
        parts.append(((t[a] << 32) | (freq[a] << 24) | (freq[b] << 16) | np.minimum(t[b] - t[a], 65535))[ok])
        order.append(np.arange(max(0, n - step))[ok] * FAN + step)
    codes, order = np.concatenate(parts), np.concatenate(order)
    at = np.argsort(order)
    return codes[at].astype(np.int64), np.searchsorted(who[(order[at] - 1) // FAN], np.arange(len(samples) + 1))


def _rows(keep_media: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in common.steps(batches):
            media = [store(pad(t)) for t in texts]
            back = [load(m) for m in media]
            codes, offsets = peak_pairs(back)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id").cast(pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([len(b) for b in back], pa.int64()),
                    pa.array([hashlib.sha256(b).hexdigest() for b in back]),
                    pa.array([zlib.crc32(b[-16:]) for b in back], pa.int64()),
                    pa.array([len(m) for m in media], pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                    pa.array(media if keep_media else [None] * len(media), pa.binary()),
                    common.lists(codes, offsets, pa.int64()),
                ],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "media", "pairs"],
            )

    return run


def media_columns(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """One row per document: sizes and digests, the WAV file itself if asked for, and the peak pairs."""
    common.prepare(docs.sparkSession)
    return common.text_of(docs).mapInArrow(common.lean(_rows(keep_media)), SCHEMA)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media_columns(common.documents(spark, sf_dir), keep_media=False)
    feature = F.concat(F.size("pairs").cast("string"), F.lit(":"), F.sha2(F.concat_ws(",", F.transform("pairs", lambda x: x.cast("string"))), 256))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "pairs")
