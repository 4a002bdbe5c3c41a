"""Audio features of a media column: polyphase resampling, overlapped log-mel filterbanks and hysteresis energy segmentation.

A payload is kept losslessly as unsigned 8-bit mono samples in a RIFF/WAVE container. Features are computed from the
samples read back, and stored as an Arrow IPC stream: one row for each time span, with a tensor of fixed shape."""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import col, map_arrow, quoted

#: Payloads are padded to a multiple of this many bytes.
UNIT = 192
RATE, UP, DOWN = 24_000, 2, 3  # samples a second of the stored form; resampled to RATE * UP / DOWN
FRAME, HOP, FFT, MELS = 400, 160, 512, 24
SPAN = 100  # frames of a tensor
#: A segment starts over HIGH times the file's mean frame energy and lasts while energy stays over LOW times it.
HIGH, LOW = 1.05, 0.95
HEADER = "<4sI4s4sIHHIIHH4sI"


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with bytes 32 appended up to a positive multiple of UNIT, and how many bytes the text has."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b" " * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data)), len(data)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    pad = len(payload) % 2
    return struct.pack(HEADER, b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload + b"\0" * pad


def from_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of what to_wav() wrote; ValueError for another format."""
    riff, _, wave, fmt, _, code, channels, rate, _, _, bits, data, size = struct.unpack_from(HEADER, media)
    if (riff, wave, fmt, data) != (b"RIFF", b"WAVE", b"fmt ", b"data") or (code, channels, bits) != (1, 1, 8):
        raise ValueError("not 8-bit mono PCM")
    at = struct.calcsize(HEADER)
    if len(media) < at + size:
        raise ValueError("samples are missing")
    return media[at : at + size], rate


@cache
def _phases(up: int, down: int, half: int = 8) -> np.ndarray:
    """A windowed sinc low-pass filter at the lower of both rates, dealt out to its `up` phases: [up, taps]."""
    n = 2 * half * max(up, down) + 1
    t = np.arange(n) - n // 2
    h = np.sinc(t / max(up, down)) * np.hamming(n) / max(up, down) * up
    return np.pad(h, (0, -n % up)).reshape(-1, up).T.astype(np.float32)


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """Polyphase resampling by up / down: an output takes only the filter phase and the inputs that meet it, none that upsampling would fill with zeros."""
    phases = _phases(up, down)
    taps = phases.shape[1]
    n = -(-len(x) * up // down)
    centre = (taps * up) // 2
    padded_x = np.pad(x.astype(np.float32), (taps, taps))
    out = np.empty(n, np.float32)
    for k in range(up):  # outputs k, k + up, ... use one phase and step `down` inputs
        m = np.arange(k, n, up)
        if len(m):
            at = m[0] * down + centre
            first, phase = at // up, at % up
            windows = np.lib.stride_tricks.sliding_window_view(padded_x, taps)[first + 1 :: down][: len(m)]
            if len(windows) < len(m):
                windows = np.concatenate((windows, np.zeros((len(m) - len(windows), taps), np.float32)))
            out[k::up] = windows @ phases[phase][::-1]
    return out


@cache
def _mels(rate: int) -> np.ndarray:
    """Triangles equally spaced on the mel scale: [FFT // 2 + 1, MELS]."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20), mel(rate / 2), MELS + 2) / 2595) - 1)
    bins = np.arange(FFT // 2 + 1) * rate / FFT
    up = (bins[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(x: np.ndarray, rate: int, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Natural logarithms of mel energies of overlapped Hann frames [frames, MELS], and frame energies. Zeros follow the signal
    so that the last frame reaches its end; a short signal is one frame."""
    x = np.pad(x, (0, FRAME + max(0, -(-(len(x) - FRAME) // HOP)) * HOP - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    window, bank = np.hanning(FRAME).astype(np.float32), _mels(rate)
    mels, energy = np.empty((len(frames), MELS), np.float32), np.empty(len(frames), np.float32)
    for at in range(0, len(frames), block):
        part = frames[at : at + block] * window
        power = np.abs(np.fft.rfft(part, FFT)) ** 2
        mels[at : at + block] = np.log(power.astype(np.float32) @ bank + 1e-6)
        energy[at : at + block] = (part**2).mean(1)
    return mels, energy


def segments(energy: np.ndarray, high: float = HIGH, low: float = LOW) -> list[tuple[int, int]]:
    """Runs of frames that stay over `low` times the mean energy and reach `high` times it."""
    mean = float(energy.mean())
    over = np.flatnonzero(np.diff(np.r_[False, energy > low * mean, False].astype(np.int8)))
    peaks = np.flatnonzero(energy > high * mean)
    pairs = over.reshape(-1, 2)
    reach = np.searchsorted(peaks, pairs[:, 1]) > np.searchsorted(peaks, pairs[:, 0])
    return [(int(a), int(b)) for a, b in pairs[reach]]


def features(media: bytes) -> dict:
    """What a stored form's samples give: mels [frames, MELS], energy, segments (frames) and the rate after resampling."""
    samples, rate = from_wav(media)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    y, to = resample(x, UP, DOWN), rate * UP // DOWN
    mels, energy = log_mel(y, to)
    return {"mels": mels, "energy": energy, "segments": segments(energy), "rate": to}


def tensors(found: dict) -> bytes:
    """An Arrow IPC stream, a row for each time span: start_s, end_s, frames, voiced (of them, those in segments), onsets
    (segments that start there) and mel, a tensor of shape [SPAN, MELS], zero beyond the end."""
    mels = found["mels"]
    spans = -(-len(mels) // SPAN)
    block = np.zeros((spans, SPAN, MELS), np.float32)
    block.reshape(-1, MELS)[: len(mels)] = mels
    inside, onset = (np.zeros(spans * SPAN, np.int32) for _ in range(2))
    for a, b in found["segments"]:
        inside[a:b] = 1
        onset[a] = 1
    starts = np.arange(spans) * SPAN
    ends = np.minimum(starts + SPAN, len(mels))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(starts * HOP / found["rate"]), pa.array(((ends - 1) * HOP + FRAME) / found["rate"]), pa.array((ends - starts).astype(np.int32)), *(pa.array(x.reshape(spans, SPAN).sum(1, dtype=np.int32)) for x in (inside, onset)), pa.FixedShapeTensorArray.from_numpy_ndarray(block)],
        ["start_s", "end_s", "frames", "voiced", "onsets", "mel"],
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def summary(stored: bytes) -> str:
    """Of tensors(), read back: frames, segments, frames in segments, then the mean of each mel band to one decimal."""
    rows = pa.ipc.open_stream(stored).read_all()
    frames, voiced, onsets = (rows[k].to_numpy() for k in ("frames", "voiced", "onsets"))
    mel = rows["mel"].combine_chunks().to_numpy_ndarray()
    means = mel.sum((0, 1), dtype=np.float64) / frames.sum()  # zero beyond the end
    return ";".join([str(frames.sum()), str(onsets.sum()), str(voiced.sum()), ",".join(f"{m + 0.0:.1f}" for m in means)])


def media_column(docs: DataFrame, id_col: str = "doc_id", text: str = "text", with_media: bool = True) -> DataFrame:
    """For each document: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (of the
    tensors read back), tensors_sha256 and, if with_media, media (the stored form) and tensors (see tensors()).

    A null text counts as empty: 192 spaces. Equal texts give equal values. A null id and repeated rows stay; other columns
    are not read; an empty table gives no rows. A document is computed alone, in memory in proportion to its own length."""
    fields = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tensors_sha256 string" + ", media binary, tensors binary" * with_media
    source = docs.select(col(id_col).alias("id"), col(text).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    names = [id_col, *(x.split()[0] for x in fields.split(", "))]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def row(text):
        payload, n = padded(text)
        media = to_wav(payload)
        back, _ = from_wav(media)
        stream = tensors(features(media))
        out = [n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), summary(stream), hashlib.sha256(stream).hexdigest()]
        return [*out, media, stream] if with_media else out

    def make():
        def step(batch, most=100):
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                rows = [row(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], types[x.split()[1]]) for i, x in enumerate(fields.split(", ")))], names)

        return step

    return map_arrow(source, make, f"{quoted(id_col)} {kind}, {fields}")
