"""Texts as audio: WAV columns, short-time Fourier transforms and spectral-peak fingerprints."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 576
HOP = UNIT // 2
RATE = 8000
BANDS = ((1, 24), (24, 72), (72, 144), (144, 289))
FAN_OUT = 3  # a peak is paired with the peaks of this many following frames
FRAMES_AT_ONCE = 4096


def to_wav(payload: bytes) -> bytes:
    """One channel of unsigned 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        if r.getnchannels() != 1 or r.getsampwidth() != 1:
            raise ValueError("not a one-channel file of 8-bit samples")
        return r.readframes(r.getnframes())


def padded(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8 bytes filled with 255 up to a positive multiple of UNIT, and their number before that."""
    raw = (text if isinstance(text, str) else "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * ((-len(raw)) % UNIT if raw else UNIT), len(raw)


_WINDOW = np.hanning(UNIT).astype(np.float32)


def spectral_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the short-time Fourier transform, for each frame and band: the strongest bin and its power."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, UNIT)[::HOP]
    bins = np.empty((len(frames), len(BANDS)), np.int32)
    height = np.empty((len(frames), len(BANDS)), np.float32)
    for k in range(0, len(frames), FRAMES_AT_ONCE):
        part = (frames[k : k + FRAMES_AT_ONCE].astype(np.float32) - 128) * _WINDOW
        spectrum = np.fft.rfft(part, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        for b, (lo, hi) in enumerate(BANDS):
            best = power[:, lo:hi].argmax(axis=1) + lo
            bins[k : k + FRAMES_AT_ONCE, b] = best
            height[k : k + FRAMES_AT_ONCE, b] = power[np.arange(len(best)), best]
    return bins, height


def fingerprints(payloads: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each payload the time codes (frame numbers) and hashes of its peak pairs (first bin, second bin,
    distance in frames).

    A band's strongest bin is a peak where it is stronger than in the frame before and not weaker than
    in the next. A peak of band b at frame t is paired with the peaks of bands b and b+1 in the next
    FAN_OUT frames and with that of band b+1 in its own frame, so that one frame makes pairs too. All
    payloads go through one transform; frames that reach over two of them are left out.
    """
    sizes = [len(p) // UNIT for p in payloads]
    bins, height = spectral_peaks(np.frombuffer(b"".join(payloads), np.uint8))
    owner = np.repeat(np.arange(len(sizes)), [2 * m for m in sizes])[:-1]
    ends = np.cumsum(sizes) * 2
    within = np.ones(len(owner), bool)
    within[ends[:-1] - 1] = False
    bins, height, owner = bins[within], height[within], owner[within]
    starts = ends - 2 * np.asarray(sizes) - np.arange(len(sizes))  # each payload before has one frame less
    same = owner[1:] == owner[:-1]
    peak = np.ones(height.shape, bool)
    peak[1:] &= (height[1:] > height[:-1]) | ~same[:, None]
    peak[:-1] &= (height[:-1] >= height[1:]) | ~same[:, None]
    n, bands = bins.shape
    times, hashes = [], []
    for dt in range(min(FAN_OUT, n - 1) + 1):
        together = owner[dt:] == owner[: n - dt]
        for b in range(bands):
            for c in (b, b + 1):
                if c < bands and (dt or c > b):
                    at = np.flatnonzero(peak[: n - dt, b] & peak[dt:, c] & together)
                    times.append(at)
                    hashes.append((bins[at, b] << 12) | (bins[at + dt, c] << 3) | dt)
    t, h = np.concatenate(times), np.concatenate(hashes)
    order = np.lexsort((h, t))
    t, h = t[order], h[order]
    cuts = np.searchsorted(t, starts[1:])
    return [(x.astype(np.int32) - np.int32(s), y) for x, y, s in zip(np.split(t, cuts), np.split(h, cuts), starts)]


_COLUMNS = ("media", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "fp_time", "fp_hash")
_TYPES = ("binary", "long", "long", "string", "long", "long", "string", "array<int>", "array<int>")
BYTES_AT_ONCE = 2 << 20


def _rows(texts: list[str | None]) -> list[tuple]:
    stored = [(to_wav(payload), n) for payload, n in map(padded, texts)]
    back = [from_wav(media) for media, _ in stored]
    digest = hashlib.sha256
    return [
        (media, n, len(b), digest(b).hexdigest(), zlib.crc32(b[-32:]), len(media), digest(media).hexdigest(), *found)
        for (media, n), b, found in zip(stored, back, fingerprints(back))
    ]


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """For every row its text as a WAV file with checksums and the fingerprint as time-coded arrays.

    Null texts count as empty and give one unit of 255s. Ids pass through (null too), repeated rows
    stay, an empty table gives an empty result, further columns are not read. Rows are handled about
    BYTES_AT_ONCE at a time, so memory is bounded by an Arrow batch and the longest text.
    """
    kind = df.schema[id_col].dataType.simpleString()
    skip = 0 if keep_media else 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["_text"].str.len().fillna(0).to_numpy()
            group = (sizes + UNIT).cumsum() // BYTES_AT_ONCE
            for _, part in batch.groupby(group, sort=False):
                out = pd.DataFrame([r[skip:] for r in _rows(part["_text"].tolist())], columns=_COLUMNS[skip:])
                out.insert(0, id_col, part["_id"].array)
                yield out

    schema = ", ".join([f"`{id_col}` {kind}", *(f"{c} {t}" for c, t in zip(_COLUMNS[skip:], _TYPES[skip:]))])
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInPandas(run, schema)


def with_feature(media: DataFrame) -> DataFrame:
    """Adds ``feature``, a name of the fingerprint: the number of its pairs and a checksum of the arrays, which stay."""
    code = F.concat_ws(":", F.concat_ws(",", "fp_time"), F.concat_ws(",", "fp_hash"))
    return media.withColumn("feature", F.concat(F.lit("peaks-"), F.size("fp_hash").cast("string"), F.lit("-"), F.sha1(code)))
