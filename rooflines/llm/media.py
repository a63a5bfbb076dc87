"""Audio features: 8-bit samples in a WAV container, polyphase resampling by 2/3, overlapped log-mel frames and segments.

One document is one clip. Its payload is stored as unsigned 8-bit PCM at 8 kHz; the stored bytes are read back and all
features come from them. Frames of 256 samples with half overlap at the resampled rate give log-mel energies, cut into
fixed-shape tensors (PATCH frames by MELS bands, padded with the floor) with their time spans; they are kept as an
Arrow IPC stream whose tensor column has the fixed-shape tensor type. Segments are runs of frames above a low level
that reach a high level. Every document is worked on where it is read; nothing is shuffled.

Defined cases: null text counts as empty; an empty text is one block of blanks; rows that are the same give the same
values; an empty table gives no rows; extra columns are ignored; long texts give more tensors, never a cut.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

BLOCK, RATE, UP, DOWN, TAPS = 192, 8000, 2, 3, 16
FRAME, HOP, MELS, PATCH = 256, 128, 20, 32
#: Levels of the segmentation in decibels above a clip's median frame energy.
HIGH_DB, LOW_DB = 1.0, -0.5
FLOOR = 1e-6
OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media binary, n_frames int, tensors binary, segments array<struct<start_s:double,end_s:double>>, feature string"


def encode(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframesraw(payload)
    return out.getvalue()


def decode(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


@cache
def _phases() -> tuple[np.ndarray, np.ndarray]:
    """The two branches of a windowed-sinc low pass, in the order in which they meet the samples."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    h = np.sinc(n / DOWN) * np.hamming(UP * TAPS) * UP / DOWN
    return h[0::2][::-1].astype("f4").copy(), h[1::2][::-1].astype("f4").copy()


def resample(x: np.ndarray) -> np.ndarray:
    """By 2/3: each branch of the filter makes every other sample; zeros stuffed between samples are never touched."""
    even, odd = _phases()
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(TAPS - 1, "f4"), x]), TAPS)
    out = np.empty(len(x) // DOWN * UP, "f4")
    out[0::2] = windows[0::3] @ even
    out[1::2] = windows[1::3] @ odd
    return out


@cache
def _mel() -> tuple[np.ndarray, np.ndarray]:
    """The frame's window and the triangular filters, bins by bands."""
    rate = RATE * UP / DOWN
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), MELS + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, FRAME // 2 + 1)[:, None]
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    return np.hanning(FRAME).astype("f4"), np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid))).astype("f4")


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies, frames by bands, and each frame's energy in decibels; a frame for each hop."""
    window, bands = _mel()
    frames = np.lib.stride_tricks.sliding_window_view(np.concatenate([y, np.zeros(FRAME - HOP, "f4")]), FRAME)[::HOP] * window
    power = np.abs(np.fft.rfft(frames)) ** 2
    return np.log(power @ bands + FLOOR), 10 * np.log10((frames**2).mean(1) + FLOOR)


def segment(db: np.ndarray) -> np.ndarray:
    """First and last+1 frame of each run at LOW_DB or more that reaches HIGH_DB; levels are above the median."""
    over = db - np.median(db)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (over >= LOW_DB).astype("i1"), [0]])))
    runs = edge.reshape(-1, 2)
    reached = np.concatenate([[0], np.cumsum(over >= HIGH_DB)])
    return runs[reached[runs[:, 1]] > reached[runs[:, 0]]]


def tensors(mel: np.ndarray) -> bytes:
    n = -(-len(mel) // PATCH)
    full = np.full((n * PATCH, MELS), np.log(FLOOR), "f4")
    full[: len(mel)] = mel
    hop = HOP * DOWN / UP / RATE
    starts = np.arange(n) * PATCH * hop
    column = pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, PATCH, MELS))
    batch = pa.record_batch([pa.array(starts), pa.array(np.minimum(starts + PATCH * hop, len(mel) * hop)), column], names=["start_s", "end_s", "log_mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def features(text: bytes) -> tuple:
    payload = text + b" " * (-len(text) % BLOCK or (0 if text else BLOCK))
    media = encode(payload)
    back = decode(media)
    mel, db = log_mel(resample((np.frombuffer(back, "u1").astype("f4") - 128) / 128))
    runs = segment(db)
    hop = HOP * DOWN / UP / RATE
    means = np.round(mel.mean(0) * 100).astype(int)
    feature = f"frames={len(mel)};segments={len(runs)};active={int((runs[:, 1] - runs[:, 0]).sum())};mel=" + ",".join(map(str, means.tolist()))
    spans = [{"start_s": float(a * hop), "end_s": float(b * hop)} for a, b in runs]
    return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), media, len(mel), tensors(mel), spans, feature


def _clips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), spans, pa.string()]
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media", "n_frames", "tensors", "segments", "feature"]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    for batch in batches:
        rows, held = [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            raw = text.as_py() or b""
            rows.append((doc_id, *features(raw)))
            held += len(raw) + 2000
            if held > 16_000_000:
                yield made(rows)
                rows, held = [], 0
        yield made(rows)


def audio_features(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: the stored clip, the tensors as an Arrow IPC stream, the segments and a summary."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_clips, OUT)


def op3_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_features(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
        "n_frames", F.size("segments").alias("n_segments"), F.sha2("tensors", 256).alias("tensors_sha256"),
    )
