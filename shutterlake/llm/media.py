"""Media columns: texts' bytes as 8-bit audio, log-mel tensors and time spans.

A payload is stored as a WAV file (8-bit mono) in a binary column written by
Spark, so that any store works. Read back, its samples are resampled by a
polyphase filter, cut into overlapped frames (the last one filled up with zeros,
so that every sample is in one), and turned into log-mel energies;
segments come from an energy threshold with hysteresis. A clip is a fixed number
of frames (the last one is padded with the floor value); the clips of a file are
one Arrow IPC stream with a fixed-shape tensor column and its time spans.

Everything is computed file by file in blocks of fixed size, so equal payloads
give equal results and memory doesn't grow with a file's length.

Nulls and edge cases: a null text is empty; an empty payload is one unit of
zeros; null doc_ids and repeated rows stay; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame

from shutterlake.llm.common import materialize, text_batches, texts_of

UNIT, RATE = 64, 16_000
UP, DOWN, TAPS = 1, 2, 24
FRAME, HOP, MELS, CLIP = 256, 128, 32, 32
FLOOR_DB, RISE_DB, FALL_DB = -100.0, 3.0, 1.0


def wav_of(payload: bytes, rate: int = RATE) -> bytes:
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload


def payload_of(wav: bytes) -> bytes:
    """The data chunk of a WAV file."""
    at = 12
    while at + 8 <= len(wav):
        name, size = struct.unpack_from("<4sI", wav, at)
        if name == b"data":
            return wav[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@cache
def _filters(up: int, down: int, taps: int) -> np.ndarray:
    """Windowed-sinc low-pass, one row per phase."""
    n = np.arange(taps * up) - (taps * up - 1) / 2
    cut = 1 / max(up, down)
    h = np.sinc(n * cut) * cut * np.hamming(taps * up) * up
    return np.ascontiguousarray(h.reshape(taps, up).T[:, ::-1], np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Polyphase resampling: output m takes phase (m*down) mod up at input (m*down) div up."""
    phases = _filters(up, down, taps)
    n = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(taps // 2, np.float32), x, np.zeros(taps, np.float32)])
    windows = sliding_window_view(padded, taps)
    out = np.empty(n, np.float32)
    for first in range(min(up, n)):  # outputs first, first+up, ... share a phase
        m = np.arange(first, n, up)
        at = m * down // up
        phase = phases[first * down % up]
        for lo in range(0, len(m), 1 << 16):
            part = at[lo : lo + (1 << 16)]
            step = slice(int(part[0]), int(part[-1]) + 1, max(1, down if up == 1 else int(part[1] - part[0]) if len(part) > 1 else 1))
            out[m[lo : lo + (1 << 16)]] = windows[step] @ phase
    return out


@cache
def _mel_bank(rate: int, frame: int, mels: int) -> np.ndarray:
    top = 2595 * np.log10(1 + rate / 2 / 700)
    hz = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    bins = np.arange(frame // 2 + 1) * rate / frame
    up = (bins[:, None] - hz[:-2]) / (hz[1:-1] - hz[:-2])
    down = (hz[2:] - bins[:, None]) / (hz[2:] - hz[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(x: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(frames, mels) in dB, and the frames' energy in dB; at least one frame, the last one filled up with zeros."""
    full = FRAME + max(0, -(-(len(x) - FRAME) // HOP)) * HOP
    x = np.concatenate([x, np.zeros(full - len(x), np.float32)])
    windows = sliding_window_view(x, FRAME)[::HOP]
    hann, bank = np.hanning(FRAME).astype(np.float32), _mel_bank(rate, FRAME, MELS)
    mel, energy = [], []
    for lo in range(0, len(windows), 2048):
        spectrum = np.fft.rfft(windows[lo : lo + 2048] * hann, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32) / FRAME
        mel.append(power @ bank)
        energy.append(power.sum(axis=1))
    to_db = lambda v: np.maximum(10 * np.log10(np.concatenate(v) + 1e-10), FLOOR_DB).astype(np.float32)
    return to_db(mel), to_db(energy)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frame ranges that rise RISE_DB over the median and last until they are under FALL_DB."""
    middle = float(np.median(energy))
    state = np.where(energy >= middle + RISE_DB, 1, np.where(energy < middle + FALL_DB, 0, -1))
    last = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    on = np.r_[False, np.where(last >= 0, state[last], 0) == 1, False]
    edges = np.flatnonzero(on[1:] != on[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def tensor_stream(mel: np.ndarray, hop_s: float) -> bytes:
    """Clips of CLIP frames as an Arrow IPC stream: start_s, end_s, logmel (CLIP x MELS)."""
    clips = -(-len(mel) // CLIP)
    full = np.full((clips * CLIP, MELS), FLOOR_DB, np.float32)
    full[: len(mel)] = mel
    kind = pa.fixed_shape_tensor(pa.float32(), [CLIP, MELS])
    storage = pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), CLIP * MELS)
    start = np.arange(clips) * CLIP * hop_s
    end = np.minimum(start + CLIP * hop_s, len(mel) * hop_s)
    batch = pa.record_batch([pa.array(start), pa.array(end), pa.ExtensionArray.from_storage(kind, storage)], names=["start_s", "end_s", "logmel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def features_of(payload: bytes) -> tuple[bytes, list[tuple[float, float]]]:
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    rate = RATE * UP // DOWN
    mel, energy = log_mel(resample(x), rate)
    hop_s = HOP / rate
    return tensor_stream(mel, hop_s), [(a * hop_s, b * hop_s) for a, b in segments(energy)]


def store_audio(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's bytes, padded to a unit, as a stored WAV file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_batches(batches):
            raw = [t.encode("utf-8", "replace") for t in texts]
            wav = [wav_of(r + bytes(-len(r) % UNIT or UNIT * (not r))) for r in raw]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(r) for r in raw], pa.int64()), pa.array(wav, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return materialize(texts_of(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary"), "audio")


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tensors binary, spans array<struct<start_s: double, end_s: double>>"


def audio_features(media: DataFrame) -> DataFrame:
    """Digests of the stored bytes, the clips' tensors (an Arrow IPC stream) and the segments."""
    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("tensors", pa.binary()), ("spans", pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])))])

    def one(doc: int | None, n: int, wav: bytes) -> tuple:
        payload = payload_of(wav)
        tensors, spans = features_of(payload)
        return (doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(wav), hashlib.sha256(wav).hexdigest(), tensors, [{"start_s": a, "end_s": b} for a, b in spans])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = [one(*r) for r in zip(*(part.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    return media.mapInArrow(run, _FEATURES)
