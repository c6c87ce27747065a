"""Media columns: payloads kept as WAV, and spectral fingerprints of them.

A payload is stored as 8-bit mono samples in a WAV container and read back by
the wave module. The samples go through a short-time Fourier transform; each
frame gives its strongest local maxima, and pairs of peaks close in time become
landmarks: time-coded numbers of the frame and of both frequencies and their
distance.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame

from gridloom.llm.common import id_and_text, mapped

ALIGN = 64
RATE = 8000
FRAME, HOP = 512, 256
#: Peaks of a frame, frames ahead in which a peak is paired, and pairs of a peak.
PEAKS, ZONE, FAN_OUT = 2, 16, 2
_CHUNK = 2048
_WINDOW = np.hanning(FRAME).astype(np.float32)


def padded(text: str | None) -> tuple[int, bytes]:
    """Length in UTF-8, and the payload: zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % ALIGN if raw else ALIGN)


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
        return w.readframes(w.getnframes())


def peaks(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frame and frequency bin of each frame's PEAKS strongest local maxima.

    The last frame is filled with the middle level; a frame without a local
    maximum gives none; of equal ones the lower frequency goes first.
    """
    samples = np.frombuffer(payload, dtype=np.uint8)
    frames = max(1, -(-(len(samples) - FRAME + HOP) // HOP))
    level = np.full((frames - 1) * HOP + FRAME, 128, dtype=np.uint8)
    level[: len(samples)] = samples
    windows = np.lib.stride_tricks.sliding_window_view(level, FRAME)[::HOP]
    at, bins = [], []
    for first in range(0, frames, _CHUNK):
        part = (windows[first : first + _CHUNK].astype(np.float32) - 128) * _WINDOW
        spectrum = np.fft.rfft(part, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        inner = power[:, 1:-1]
        strength = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]), inner, 0)
        rows = np.arange(len(part))
        for _ in range(PEAKS):
            best = strength.argmax(axis=1)
            found = strength[rows, best] > 1e-3
            at.append(first + rows[found])
            bins.append(best[found] + 1)
            strength[rows, best] = 0
    at, bins = np.concatenate(at), np.concatenate(bins)
    by = np.lexsort((bins, at))
    return at[by], bins[by]


def landmarks(at: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Pairs of peaks as numbers: frame * 2**24 + bin * 2**15 + second bin * 2**6 + distance.

    Each peak is paired with the FAN_OUT next peaks of later frames, none more
    than ZONE frames ahead.
    """
    following = np.searchsorted(at, at, side="right")
    out = []
    for k in range(FAN_OUT):
        ahead = following + k
        first = np.flatnonzero(ahead < len(at))
        second = ahead[first]
        gap = at[second] - at[first]
        near = gap <= ZONE
        first, second, gap = first[near], second[near], gap[near]
        out.append((at[first] << 24) | (bins[first] << 15) | (bins[second] << 6) | gap)
    return np.sort(np.concatenate(out)).astype(np.int64)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, landmarks) of each text, read back from its media.

    ``feature`` is a digest of the landmarks, after their number. With
    ``keep_media`` the WAV itself follows in ``media``. A null text counts as
    empty and has a payload of 64 zero bytes. Repeated rows and null ids come
    back as they are; other columns are ignored.
    """
    schema = {
        "n_bytes": "long",
        "payload_bytes": "long",
        "payload_sha256": "string",
        "tail_crc32": "long",
        "media_bytes": "long",
        "media_sha256": "string",
        "feature": "string",
        "landmarks": "array<long>",
    }
    if keep_media:
        schema["media"] = "binary"

    def run(texts: list[str | None]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in schema}
        for text in texts:
            n, payload = padded(text)
            media = to_wav(payload)
            back = from_wav(media)
            marks = landmarks(*peaks(back))
            digest = hashlib.sha256(marks.astype("<i8").tobytes()).hexdigest()
            row = (
                n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ALIGN:]), len(media),
                hashlib.sha256(media).hexdigest(), f"{len(marks)}:{digest}", marks, media
            )
            for column, value in zip(out.values(), row, strict=False):
                column.append(value)
        return out

    return mapped(id_and_text(docs, id_col, text_col), run, schema)
