import hashlib
import io
import wave
import zlib

import numpy as np

from gridloom.llm import media
from gridloom.llm.queries import queries


def test_payloads_round_trip():
    for text in [None, "", "a", "é" * 32, "x" * 64, "x" * 65, "漢" * 5000]:
        n, payload = media.padded(text)
        raw = (text or "").encode()
        assert n == len(raw) and len(payload) % 64 == 0 and payload and payload[:n] == raw and not any(payload[n:])
        assert len(payload) - n < 64 or n == 0
        stored = media.to_wav(payload)
        assert media.from_wav(stored) == payload
        with wave.open(io.BytesIO(stored)) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.getframerate()) == (1, 1, 8000)


def test_peaks_find_tones():
    t = np.arange(4096)
    tone = 128 + 60 * np.sin(2 * np.pi * t * 40 / media.FRAME) + 30 * np.sin(2 * np.pi * t * 100 / media.FRAME)
    at, bins = media.peaks(np.round(tone).astype(np.uint8).tobytes())
    assert set(at.tolist()) == set(range(15))
    assert set(bins.tolist()) == {40, 100}
    marks = media.landmarks(at, bins)
    assert set((marks & 63).tolist()) <= set(range(1, media.ZONE + 1))
    assert set((marks >> 15 & 511).tolist()) | set((marks >> 6 & 511).tolist()) == {40, 100}


def test_chunks_do_not_change_peaks(monkeypatch):
    payload = bytes(np.random.default_rng(1).integers(32, 120, 30_000, dtype=np.uint8))
    whole = media.peaks(payload)
    monkeypatch.setattr(media, "_CHUNK", 7)
    for a, b in zip(whole, media.peaks(payload), strict=True):
        assert np.array_equal(a, b)


def test_landmarks_against_loops():
    rng = np.random.default_rng(2)
    at = np.sort(rng.integers(0, 60, 50))
    bins = rng.integers(1, 256, 50)
    want = []
    for i in range(50):
        later = [j for j in range(50) if at[j] > at[i]][: media.FAN_OUT]
        want += [int(at[i]) << 24 | int(bins[i]) << 15 | int(bins[j]) << 6 | int(at[j] - at[i]) for j in later if at[j] - at[i] <= media.ZONE]
    assert media.landmarks(at, bins).tolist() == sorted(want)


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, None, b"x"), (1, None, b"x"), (None, "a", b"y")], "doc_id long, text string, media binary")
    rows = media.media_columns(df, keep_media=True).collect()
    assert sorted((r.id or 0, r.n_bytes, r.payload_bytes) for r in rows) == [(0, 1, 64), (1, 0, 64), (1, 0, 64)]
    assert all(media.from_wav(bytes(r.media))[: r.n_bytes] in (b"", b"a") for r in rows)
    assert media.media_columns(df.limit(0)).count() == 0


def test_query_on_given_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries()["op4_media_columns"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    features = {}
    for r in rows:
        raw = docs[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        stored = media.to_wav(payload)
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(stored))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(stored).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        assert features.setdefault(docs[r.doc_id], (r.feature, r.landmarks)) == (r.feature, r.landmarks)


def test_large_ids_beside_a_null_one(spark):
    ids = [2**60 + 1, None, 2**60 + 3]
    df = spark.createDataFrame([(i, "a") for i in ids], "doc_id long, text string").coalesce(1)
    assert media.media_columns(df).toArrow()["id"].to_pylist() == ids
