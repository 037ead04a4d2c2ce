import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
import pytest

from shutterlake.llm.media import CLIP, MELS, audio_features, features_of, log_mel, payload_of, resample, segments, store_audio, tensor_stream, wav_of

from .fixtures import awkward, documents, empty


def test_wav_round_trip():
    payload = bytes(range(256)) * 3
    w = wave.open(io.BytesIO(wav_of(payload)))
    assert (w.getnchannels(), w.getsampwidth(), w.getframerate()) == (1, 1, 16_000)
    assert w.readframes(10_000) == payload == payload_of(wav_of(payload))


@pytest.mark.parametrize(("up", "down"), [(1, 2), (2, 3), (3, 2), (1, 1)])
def test_resample_keeps_a_slow_tone(up, down):
    n = 6000
    x = np.sin(2 * np.pi * 0.01 * np.arange(n)).astype(np.float32)
    y = resample(x, up, down)
    assert len(y) == -(-n * up // down)
    peak = np.argmax(np.abs(np.fft.rfft(y)))
    assert abs(peak / len(y) - 0.01 * down / up) < 2e-3
    assert 0.9 < np.abs(y[200:-200]).max() < 1.1


def test_segments_have_hysteresis():
    e = np.array([0, 0, 0, 5, 2, 2, 0.5, 2, 0, 0, 0, 4], np.float32)
    assert segments(e) == [(3, 6), (11, 12)]
    assert segments(np.zeros(4, np.float32)) == []


def test_tensor_shape_and_spans():
    mel, energy = log_mel(np.random.default_rng(1).normal(size=9000).astype(np.float32), 8000)
    t = pa.ipc.open_stream(tensor_stream(mel, 128 / 8000)).read_all()
    assert t["logmel"].type == pa.fixed_shape_tensor(pa.float32(), [CLIP, MELS])
    got = t["logmel"].chunk(0).to_numpy_ndarray().reshape(-1, MELS)
    assert np.array_equal(got[: len(mel)], mel) and (got[len(mel) :] == -100).all()
    assert len(energy) == len(mel) and t["end_s"].to_pylist()[-1] == len(mel) * 128 / 8000


def test_features_are_of_the_whole_payload():
    rng = np.random.default_rng(5)
    for n in [*range(1, 12), *range(500, 1200, 13), 1024, 1088, 1152, 4096, 70_001]:
        text = rng.integers(97, 123, n).astype(np.uint8).tobytes()
        other = text[:-1] + bytes([text[-1] ^ 1])
        pad = bytes(-n % 64)
        assert features_of(text + pad)[0] != features_of(other + pad)[0], n


def test_awkward_and_empty(spark):
    rows = audio_features(store_audio(awkward(spark))).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in awkward(spark).collect()}
    assert len(rows) == 8
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        payload = raw + bytes(-len(raw) % 64 or 64 * (not raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_sha256"] == hashlib.sha256(wav_of(payload)).hexdigest()
    assert audio_features(store_audio(empty(spark))).collect() == []
    twice = audio_features(store_audio(documents(spark, ["same text " * 70, "other", "same text " * 70]))).orderBy("doc_id").collect()
    assert twice[0][2:] == twice[2][2:]
