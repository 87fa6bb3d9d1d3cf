"""Media columns: bytes kept losslessly as 8-bit WAV samples, fingerprinted by spectral peaks.

A payload is written by the wave module (mono, 8 bits, RATE frames a second) and read back from
the stored bytes. Its short-time Fourier transform (Hann frames of FRAME samples less their mean, a
frame every HOP samples from HOP before the first, so each sample lies in two frames; edges and zeros at the end are
silence outside the mean) gives each frame's peaks: the PEAKS strongest bins that are stronger than both
neighbours and have at least 1 / FAINT of the frame's greatest power. A peak forms pairs with the weaker ones of its frame and with
the peaks of the next FAN frames; the fingerprint is the array of pairs in time order, each
as frame * 2**16 + anchor bin * 2**9 + target bin * 2**2 + distance in frames.

Null texts count as empty, and an empty payload is one block of zeros, so its frames are silent, as
are those of one repeated byte: silent frames have no peak and no pair. Any other payload has pairs, as two frames
hold each of its samples. Peaks are no digest: a few unequal texts, very short ones first, share theirs. Equal texts give equal values. Whole payloads are
transformed in blocks of frames, so memory follows the longest payload only by its bytes.
"""

from __future__ import annotations

import io
import wave

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, table

BLOCK, RATE, FRAME, HOP, PEAKS, FAINT, FAN, FRAMES_AT_ONCE = 64, 8000, 256, 128, 3, 10, 3, 2048


def payload_of(text: str) -> tuple[int, bytes]:
    """The text's UTF-8 length and its bytes with zeros up to a positive multiple of BLOCK."""
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // BLOCK)) * BLOCK, b"\0")


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("expected mono 8-bit samples")
        return w.readframes(w.getnframes())


def frame_peaks(payload: bytes) -> np.ndarray:
    """The strongest local peaks of each frame, strongest first, but not the constant bin; -1 where there are fewer."""
    samples = np.frombuffer(payload, np.uint8)
    n = -(-len(samples) // HOP) + 1
    samples = samples[: len(payload.rstrip(b"\0"))]  # the padding is silence: a step down to it would drown short texts
    window, out = np.hanning(FRAME).astype(np.float32), np.empty((n, PEAKS), np.int64)
    for lo in range(0, n, FRAMES_AT_ONCE):
        hi = min(n, lo + FRAMES_AT_ONCE)
        block, real = np.zeros((2, (hi - lo + 1) * HOP), np.float32)
        first = (lo - 1) * HOP  # the sample at the block's start
        part = samples[max(first, 0) : hi * HOP]
        at = max(-first, 0)
        block[at : at + len(part)] = part
        real[at : at + len(part)] = 1
        frames, there = (np.concatenate([x.reshape(-1, HOP)[:-1], x.reshape(-1, HOP)[1:]], axis=1) for x in (block, real))
        mean = frames.sum(axis=1, keepdims=True) / np.maximum(there.sum(axis=1, keepdims=True), 1)
        spectrum = np.fft.rfft((frames - mean) * there * window, axis=1)[:, 1:]
        power = spectrum.real**2 + spectrum.imag**2
        most = power.max(axis=1, keepdims=True)
        local = (power > 0) & (power * FAINT >= most)
        local[:, 1:] &= power[:, 1:] > power[:, :-1]
        local[:, :-1] &= power[:, :-1] >= power[:, 1:]
        power[~local] = 0
        for k in range(PEAKS):
            best = power.argmax(axis=1)
            out[lo:hi, k] = np.where(power[np.arange(hi - lo), best] > 0, best, -1)
            power[np.arange(hi - lo), best] = 0
    return out


def peaks(payload: bytes) -> np.ndarray:
    """The strongest bin but the constant one in each frame, -1 where the frame is silent."""
    return frame_peaks(payload)[:, 0]


def fingerprint(payload: bytes) -> np.ndarray:
    """Time-coded pairs of spectral peaks, by anchor frame, then by distance, then strongest first."""
    bins = frame_peaks(payload)
    n = len(bins)
    same = [(i, k) for i in range(PEAKS) for k in range(i + 1, PEAKS)]
    codes = np.full((n, len(same) + FAN * PEAKS * PEAKS), -1, np.int64)
    pairs = [(0, i, k) for i, k in same] + [(d, i, k) for d in range(1, FAN + 1) for i in range(PEAKS) for k in range(PEAKS)]
    for j, (d, i, k) in enumerate(pairs):
        if d < n:
            a, b = bins[: n - d, i], bins[d:, k]
            codes[: n - d, j] = np.where((a >= 0) & (b >= 0), (np.arange(n - d) << 16) | (a << 9) | (b << 2) | d, -1)
    flat = codes.ravel()
    return flat[flat >= 0]


MEDIA = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("media", T.BinaryType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("fingerprint", T.ArrayType(T.LongType())),
    ]
)


def media_columns(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Each text's stored WAV (media), the payload read back from it and its fingerprint.

    keep: columns carried along. A map over rows: nothing is shuffled, repeated rows repeat.
    """

    def make():
        def work(texts):
            sizes, stored, read, prints = [], [], [], []
            for text in texts:
                n, payload = payload_of(text)
                media = to_wav(payload)
                back = from_wav(media)
                sizes.append(n)
                stored.append(media)
                read.append(back)
                prints.append(fingerprint(back))
            return sizes, stored, read, prints

        return work

    return map_texts(df, text, MEDIA, make, keep if keep is not None else [c for c in df.columns if c != text])


def op10_media(spark, sf_dir: str) -> DataFrame:
    """Digests of media_columns over all documents; null texts count as empty."""
    made = media_columns(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return made.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -BLOCK, BLOCK)).cast("long").alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("fingerprint"), F.sha2(F.array_join(F.col("fingerprint").cast("array<string>"), ","), 256)).alias("feature"),
    )


QUERIES = {"op10_media": op10_media}
ORACLES: dict[str, str] = {}
