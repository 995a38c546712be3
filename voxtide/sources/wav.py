"""PCM sound files as rows of frames.

A file is decoded inside its task and leaves it as frame rows: time, energy,
pitch, cepstral prominence, formants, mel coefficients and the power spectrum's
shape, so that all aggregates over frames are ordinary SQL.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

RATE = 16_000


@dataclass(frozen=True)
class FrameConfig:
    frame: int = 400
    hop: int = 160
    pitch_min: float = 70.0
    pitch_max: float = 400.0
    voicing: float = 0.30
    lpc_order: int = 12
    pre_emphasis: float = 0.97
    mels: int = 26
    mfcc: int = 13


class AudioError(ValueError):
    """``code`` is INVALID_AUDIO, UNSUPPORTED_AUDIO or INVALID_AUDIO_CHANNEL."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


def decode(content: bytes) -> tuple[np.ndarray, int, int]:
    """(channels by samples in [-1, 1), rate, bytes a sample) of a RIFF file with 8, 16, 24 or 32 bit PCM."""
    if len(content) < 12 or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise AudioError("INVALID_AUDIO", "not a RIFF/WAVE file")
    at, fmt, data = 12, None, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack("<I", content[at + 4 : at + 8])[0]
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt ":
            fmt = body
        elif name == b"data":
            data = body
            if len(body) < size:
                raise AudioError("INVALID_AUDIO", "data ends early")
        at += 8 + size + size % 2
    if fmt is None or data is None or len(fmt) < 16:
        raise AudioError("INVALID_AUDIO", "no format or no data")
    tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", fmt[:16])
    if tag == 0xFFFE and len(fmt) >= 26:
        tag = struct.unpack("<H", fmt[24:26])[0]
    if tag != 1 or bits not in (8, 16, 24, 32) or not channels or not rate:
        raise AudioError("UNSUPPORTED_AUDIO", f"format {tag}, {bits} bits, {channels} channels")
    width = bits // 8
    raw = np.frombuffer(data[: len(data) // (width * channels) * width * channels], np.uint8).reshape(-1, width)
    if not len(raw):
        raise AudioError("INVALID_AUDIO", "no samples")
    if width == 1:
        x = (raw[:, 0].astype(np.float64) - 128) / 128
    else:
        wide = np.zeros((len(raw), 4), np.uint8)
        wide[:, 4 - width :] = raw
        x = wide.view("<i4")[:, 0] / 2.0**31
    return x.reshape(-1, channels).T, rate, width


def resample(x: np.ndarray, rate: int, to: int = RATE, taps: int = 32) -> np.ndarray:
    """Polyphase windowed-sinc resampling by up / down."""
    if rate == to:
        return x
    g = gcd(rate, to)
    up, down = to // g, rate // g
    cut = min(1.0, up / down)
    half = int(np.ceil(taps / cut))
    out = np.arange(int(np.ceil(len(x) * up / down)))
    pos = out * down / up
    base = np.floor(pos).astype(np.int64)
    k = np.arange(-half, half + 1)
    y = np.zeros(len(out))
    padded = np.pad(x, half + 1)
    for lo in range(0, len(out), 20_000):
        p, b = pos[lo : lo + 20_000], base[lo : lo + 20_000]
        d = p[:, None] - (b[:, None] + k)
        h = cut * np.sinc(cut * d) * np.where(np.abs(d) <= half, 0.5 + 0.5 * np.cos(np.pi * d / half), 0)
        y[lo : lo + 20_000] = (padded[b[:, None] + k + half + 1] * h).sum(1)
    return y


def frames(x: np.ndarray, c: FrameConfig) -> np.ndarray:
    """Hamming-weighted frames, the last one filled with zeros; none for a clip of no more than frame - hop samples."""
    n = int(np.ceil((len(x) - c.frame) / c.hop)) + 1
    if n <= 0:
        return np.empty((0, c.frame))
    padded = np.zeros((n - 1) * c.hop + c.frame)
    padded[: len(x)] = x[: len(padded)]
    return np.lib.stride_tricks.sliding_window_view(padded, c.frame)[:: c.hop] * np.hamming(c.frame)


def pitch(w: np.ndarray, rate: int, c: FrameConfig) -> tuple[np.ndarray, np.ndarray]:
    """Pitch and its normalized correlation of each frame, NaN where unvoiced; the shortest of equally good lags.

    All lags at once: products from one Fourier transform, means and energies of both parts from running sums.
    """
    lo, hi = max(int(np.ceil(rate / c.pitch_max)), 1), min(int(np.floor(rate / c.pitch_min)), w.shape[1] - 1)
    if hi <= lo or not len(w):
        return np.full(len(w), np.nan), np.zeros(len(w))
    n = w.shape[1]
    spec = np.fft.rfft(w, 2 * n)
    lags = np.arange(lo, hi + 1)
    dot = np.fft.irfft(np.abs(spec) ** 2)[:, lags]
    run, run2 = (np.pad(np.cumsum(v, 1), ((0, 0), (1, 0))) for v in (w, w * w))
    m = n - lags
    head, head2, tail, tail2 = run[:, m], run2[:, m], run[:, -1:] - run[:, lags], run2[:, -1:] - run2[:, lags]
    den = np.sqrt(np.maximum(head2 - head**2 / m, 0) * np.maximum(tail2 - tail**2 / m, 0))
    r = (dot - head * tail / m) / np.maximum(den, 1e-12)
    best = r.argmax(1)
    top = r[np.arange(len(w)), best]
    ok = top >= c.voicing
    return np.where(ok, rate / lags[best], np.nan), np.where(ok, top, 0.0)


def prominence(w: np.ndarray, rate: int, c: FrameConfig) -> np.ndarray:
    """Height of the cepstral peak in the pitch range above a straight line through that range, in dB."""
    q = np.arange(max(int(np.ceil(rate / c.pitch_max)), 1), min(int(np.floor(rate / c.pitch_min)), w.shape[1] - 1) + 1)
    if len(q) < 2 or not len(w):
        return np.full(len(w), np.nan)
    cep = np.fft.irfft(20 * np.log10(np.maximum(np.abs(np.fft.rfft(w)), 1e-12)))[:, q]
    line = np.polyval(np.polyfit(q, cep.T, 1)[:, :, None], q) if len(w) else cep
    k = cep.argmax(1)
    return (cep - line)[np.arange(len(w)), k]


def formants(w: np.ndarray, rate: int, c: FrameConfig) -> np.ndarray:
    """First three formants with bandwidths of each frame (frame, 3, 2), NaN where fewer are stable.

    Levinson's recursion runs over all frames together; the roots come from companion matrices.
    """
    out = np.full((len(w), 3, 2), np.nan)
    if not len(w):
        return out
    p = np.concatenate([w[:, :1], w[:, 1:] - c.pre_emphasis * w[:, :-1]], 1)
    r = np.fft.irfft(np.abs(np.fft.rfft(p, 2 * p.shape[1])) ** 2)[:, : c.lpc_order + 1]
    live = r[:, 0] > 1e-12
    a, err = np.zeros((len(w), c.lpc_order + 1)), np.where(live, r[:, 0], 1.0)
    a[:, 0] = 1
    for i in range(1, c.lpc_order + 1):
        k = -(a[:, :i] * r[:, i:0:-1]).sum(1) / err
        a[:, 1 : i + 1] += k[:, None] * a[:, i - 1 :: -1][:, :i] if i > 1 else k[:, None]
        err = err * (1 - k * k)
        err = np.where(np.abs(err) < 1e-300, 1e-300, err)
    live &= np.isfinite(a).all(1)
    comp = np.zeros((int(live.sum()), c.lpc_order, c.lpc_order))
    comp[:, 0, :] = -a[live, 1:]
    comp[:, np.arange(1, c.lpc_order), np.arange(c.lpc_order - 1)] = 1
    roots = np.linalg.eigvals(comp)
    angle, size = np.angle(roots), np.abs(roots)
    freq, band = angle * rate / (2 * np.pi), -rate * np.log(np.maximum(size, 1e-300)) / np.pi
    good = (angle > 0) & (angle < np.pi) & (size < 1) & (band > 0)
    for row, f, b, g in zip(np.flatnonzero(live), freq, band, good):
        if g.sum() >= 3:
            o = np.argsort(f[g])[:3]
            out[row] = np.column_stack([f[g][o], b[g][o]])
    return out


def mel_coefficients(power: np.ndarray, rate: int, c: FrameConfig) -> np.ndarray:
    """Cosine transform (orthonormal, type II) of log energies in triangular mel bands, without the zeroth."""
    freq = np.linspace(0, rate / 2, power.shape[1])
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + rate / 1400), c.mels + 2) / 2595) - 1)
    bands = np.stack([np.interp(freq, edges[i : i + 3], [0, 1, 0], 0, 0) for i in range(c.mels)])
    log = np.log(np.maximum(power @ bands.T, np.finfo(float).eps))
    k, n = np.arange(1, c.mfcc + 1)[:, None], np.arange(c.mels)[None, :]
    return log @ (np.sqrt(2 / c.mels) * np.cos(np.pi * k * (2 * n + 1) / (2 * c.mels))).T


_FRAME_SCHEMA = "path string, region int, frame_idx int, t_s double, energy double, rms double, f0_hz double, nccf double, cpp_db double, f1 double, b1 double, f2 double, b2 double, f3 double, b3 double, mfcc array<double>, power array<double>, error_code string"
_INFO_SCHEMA = "path string, rate int, width int, channels int, samples long, audio_duration_s double, audio_dc_offset double, audio_clipping_ratio double, audio_rms_dbfs double, sha256 string, error_code string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of sound files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _mono(content: bytes, channel: int | None) -> tuple[np.ndarray, int, int, int]:
    """Mono at its own rate: the mean of up to two channels, or one ``channel`` of any number."""
    x, rate, width = decode(content)
    if channel is not None:
        if not 0 <= channel < len(x):
            raise AudioError("INVALID_AUDIO_CHANNEL", f"no channel {channel}")
        return x[channel], rate, width, len(x)
    if len(x) > 2:
        raise AudioError("UNSUPPORTED_AUDIO", f"{len(x)} channels")
    return x.mean(0), rate, width, len(x)


def info(files: DataFrame, channel: int | None = None) -> DataFrame:
    """One row per file: format, duration, offset, clipping and level (null for silence), digest, and an error code if unreadable."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                row = dict.fromkeys(("rate", "width", "channels", "samples", "audio_duration_s", "audio_dc_offset", "audio_clipping_ratio", "audio_rms_dbfs", "error_code"))
                row |= {"path": p, "sha256": hashlib.sha256(content).hexdigest()}
                try:
                    x, rate, width, channels = _mono(content, channel)
                    rms, top = float(np.sqrt((x * x).mean())), 1 - 2.0 ** -(8 * width - 1)
                    row |= {"rate": rate, "width": width, "channels": channels, "samples": len(x), "audio_duration_s": len(x) / rate, "audio_dc_offset": float(x.mean()), "audio_clipping_ratio": float((np.abs(x) >= top).mean()), "audio_rms_dbfs": 20 * float(np.log10(rms)) if rms > 0 else None}
                except AudioError as e:
                    row["error_code"] = e.code
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=_arrow(_INFO_SCHEMA))

    return files.select("path", "content").mapInArrow(run, _INFO_SCHEMA)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


def frame_rows(files: DataFrame, config: FrameConfig = FrameConfig(), channel: int | None = None, spectra: bool = True) -> DataFrame:
    """One row per frame of each file; with a column ``regions`` (array of start and end in seconds) only of those regions.

    An unreadable file is one row with its error code; an empty or short region has no frames.
    """
    has_regions = "regions" in files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(_FRAME_SCHEMA)
        for b in batches:
            regions = b.column(2).to_pylist() if has_regions else [None] * b.num_rows
            for p, content, rs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), regions):
                try:
                    x, rate, _, _ = _mono(content, channel)
                except AudioError as e:
                    yield pa.RecordBatch.from_pylist([{"path": p, "error_code": e.code}], schema=schema)
                    continue
                x = resample(x, rate)
                for k, (s, e) in enumerate(rs if rs is not None else [(0.0, len(x) / RATE)]):
                    at = int(round(s * RATE))
                    w = frames(x[at : int(round(e * RATE))], config)
                    for lo in range(0, len(w), 3000):  # half a minute at a time
                        part = w[lo : lo + 3000]
                        power = np.abs(np.fft.rfft(part)) ** 2
                        f0, r = pitch(part, RATE, config)
                        f = formants(part, RATE, config)
                        none = lambda a: pa.array(a, from_pandas=True)
                        cols = [[p] * len(part), np.full(len(part), k, np.int32), np.arange(lo, lo + len(part), dtype=np.int32), s + np.arange(lo, lo + len(part)) * config.hop / RATE, (part**2).sum(1), np.sqrt((part**2).mean(1)), none(f0), r, none(prominence(part, RATE, config))]
                        cols += [none(f[:, i, j]) for i in range(3) for j in range(2)]
                        cols += [list(mel_coefficients(power, RATE, config)) if spectra else [None] * len(part), list(power) if spectra else [None] * len(part), [None] * len(part)]
                        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, t in zip(cols, schema.types)], schema=schema)

    return files.select("path", "content", *(["regions"] if has_regions else [])).mapInArrow(run, _FRAME_SCHEMA)
