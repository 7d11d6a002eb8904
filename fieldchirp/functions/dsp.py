"""Numpy kernels for what column expressions can't say, and the UDFs that run them on Arrow batches.

Written from textbook definitions; there is no signal library on the workers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf

MORLET_CENTRE = 0.8125


def spectrum(x: np.ndarray) -> np.ndarray:
    """One-sided magnitudes scaled 2/N; DC, and Nyquist for even N, halved."""
    mag = np.abs(np.fft.rfft(x)) * 2 / len(x)
    mag[0] /= 2
    if len(x) % 2 == 0:
        mag[-1] /= 2
    return mag


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def frames(x: np.ndarray, window: int, hop: int) -> np.ndarray:
    n = 1 + (len(x) - window) // hop if len(x) >= window else 0
    return np.lib.stride_tricks.sliding_window_view(x, window)[:: hop][:n] if n else np.zeros((0, window))


def power_spectrogram(x: np.ndarray, window: int = 512, hop: int | None = None, fft_size: int | None = None) -> np.ndarray:
    """Power by (frequency, frame), Hann window normalised so that a full-scale tone has its own amplitude."""
    w = hann(window)
    f = np.fft.rfft(frames(x, window, hop or window // 2) * w, fft_size or window, axis=1)
    return (np.abs(f) * 2 / w.sum()).T ** 2 / 2


def frame_rms(power: np.ndarray, even: bool = True) -> np.ndarray:
    """Level per frame: outer rows halved, as they stand for one-sided bins."""
    p = power.copy()
    if len(p):
        p[0] /= 2
        if even:
            p[-1] /= 2
    return np.sqrt(p.sum(axis=0))


def mel_filterbank(n_fft: int, rate: float, n_mels: int = 64, f_min: float = 0.0, f_max: float | None = None) -> np.ndarray:
    """Triangles evenly spaced on the HTK mel scale, by (mel, bin)."""
    mel = lambda f: 2595 * np.log10(1 + np.asarray(f) / 700)
    hz = lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = hz(np.linspace(mel(f_min), mel(f_max or rate / 2), n_mels + 2))
    f = np.fft.rfftfreq(n_fft, 1 / rate)
    up = (f[None] - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - f[None]) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down))


def pcen(power: np.ndarray, gain: float = 0.8, bias: float = 10.0, root: float = 0.25, smooth: float = 0.02, eps: float = 1e-6) -> np.ndarray:
    """Per-channel energy normalisation with a first-order smoother."""
    m = np.empty_like(power)
    if power.shape[1]:
        m[:, 0] = power[:, 0]
        for t in range(1, power.shape[1]):
            m[:, t] = (1 - smooth) * m[:, t - 1] + smooth * power[:, t]
    return (power / (eps + m) ** gain + bias) ** root - bias**root


@dataclass(frozen=True)
class Butterworth:
    """Digital Butterworth filter by bilinear transform: ``low`` alone a high-pass, ``high`` alone a low-pass, both the band-pass transformed from one prototype."""

    order: int
    low: float | None
    high: float | None
    rate: float

    def __post_init__(self) -> None:
        for f in (self.low, self.high):
            if f is not None and not 0 < f < self.rate / 2:
                raise ValueError("filter edges must lie between 0 and half the sample rate")
        if self.low is not None and self.high is not None and self.low >= self.high:
            raise ValueError("the lower edge must lie below the upper one")

    def power(self, n: int) -> np.ndarray:
        """Squared magnitude at the Fourier bins of ``n`` samples."""
        warp = lambda f: np.tan(np.pi * np.minimum(f, self.rate * 0.4999999) / self.rate)
        w = warp(np.fft.rfftfreq(n, 1 / self.rate))
        with np.errstate(divide="ignore", invalid="ignore"):
            if self.low is not None and self.high is not None:
                a, b = warp(self.low), warp(self.high)
                x = (w * w - a * b) / ((b - a) * w)
            elif self.high is not None:
                x = w / warp(self.high)
            elif self.low is not None:
                x = warp(self.low) / w
            else:
                return np.ones(len(w))
            return 1 / (1 + np.abs(x) ** (2 * self.order))


def zero_phase(x: np.ndarray, design: Butterworth) -> np.ndarray:
    """Filter with no delay: the squared magnitude response, applied in the frequency domain over an odd extension."""
    n = len(x)
    if not n:
        return x
    edge = min(n - 1, 48 * (2 * design.order + 1))
    ext = np.concatenate([2 * x[0] - x[edge:0:-1], x, 2 * x[-1] - x[-2 : -edge - 2 : -1]]) if edge else x
    return np.fft.irfft(np.fft.rfft(ext) * design.power(len(ext)), len(ext))[edge : edge + n]


def resample(x: np.ndarray, rate: float, new_rate: float) -> np.ndarray:
    """Band-limited resampling by the Fourier method, clipped to [-1, 1]."""
    n, m = len(x), round(len(x) * new_rate / rate)
    if not n or not m:
        return np.zeros(m)
    f = np.fft.rfft(x)
    keep = min(len(f), m // 2 + 1)
    g = np.zeros(m // 2 + 1, dtype=complex)
    g[:keep] = f[:keep]
    return np.clip(np.fft.irfft(g, m) * m / n, -1, 1)


def noise(n: int, color: str = "white", dbfs: float = -10.0, seed: int = 0) -> np.ndarray:
    """Seeded coloured noise at a level, clipped to [-1, 1]."""
    slope = {"white": 0.0, "pink": -0.5, "brown": -1.0, "brownian": -1.0, "blue": 0.5, "violet": 1.0}[color]
    f = np.fft.rfft(np.random.default_rng(seed).standard_normal(n))
    k = np.arange(len(f), dtype=float)
    k[0] = 1
    x = np.fft.irfft(f * k**slope, n)
    level = 10 ** (dbfs / 20) / np.sqrt(2)
    return np.clip(x / max(np.sqrt(np.mean(x**2)), 1e-12) * level, -1, 1)


def gcc(x: np.ndarray, y: np.ndarray, how: str = "phat", eps: float = 1e-3, band: tuple[float, float] | None = None, rate: float | None = None) -> np.ndarray:
    """Generalised cross-correlation over all lags, from -(len(y)-1) to len(x)-1."""
    if how == "cc_norm":
        x, y = x - x.mean(), y - y.mean()
    n = len(x) + len(y) - 1
    X, Y = np.fft.rfft(x, n), np.fft.rfft(y, n)
    if band:
        f = np.fft.rfftfreq(n, 1 / (rate or 1))
        X = np.where((f >= band[0]) & (f <= band[1]), X, 0)
    G = X * np.conj(Y)
    sx, sy = np.abs(X) ** 2, np.abs(Y) ** 2
    if how == "phat":
        G = G / (np.abs(G) + eps)
    elif how == "roth":
        G = G / (sx + eps)
    elif how == "scot":
        G = G / (np.sqrt(sx * sy) + eps)
    elif how == "ht":
        coh = np.abs(G) ** 2 / (sx * sy + eps)
        G = G / (np.abs(G) + eps) * coh / (1 - coh + eps)
    elif how not in ("cc", "cc_norm"):
        raise ValueError(f"unknown filter {how}")
    c = np.fft.irfft(G, n)
    c = np.concatenate([c[len(x) :], c[: len(x)]])
    if how == "cc_norm":
        c = c / max(np.sqrt((x**2).sum() * (y**2).sum()), 1e-12)
    return c


def tdoa(x: np.ndarray, reference: np.ndarray, max_delay: float, rate: float = 1.0, how: str = "phat", band: tuple[float, float] | None = None) -> tuple[float, float]:
    """(delay of x after the reference in seconds, peak of the correlation), within +-max_delay."""
    if max_delay * rate * 2 >= min(len(x), len(reference)):
        raise ValueError("max_delay must be less than half the length of either signal")
    c = gcc(x, reference, how, band=band, rate=rate)
    lags = np.arange(-(len(reference) - 1), len(x))
    ok = np.abs(lags) <= max_delay * rate
    at = np.argmax(np.where(ok, c, -np.inf))
    return lags[at] / rate, float(c[at])


def pulse_score(amplitude: np.ndarray, rate: float, pulse_rates: tuple[float, float], nfft: int = 1024, segment: int = 256) -> float:
    """Largest Welch power density of the amplitude strictly within the pulse rates; 0 if no bin lies there."""
    if not len(amplitude):
        raise ValueError("no samples")
    seg = min(segment, len(amplitude))
    w = hann(seg)
    fr = frames(amplitude, seg, max(seg // 2, 1))
    fr = fr - fr.mean(axis=1, keepdims=True)
    p = (np.abs(np.fft.rfft(fr * w, max(nfft, seg), axis=1)) ** 2).mean(axis=0) / (rate * (w**2).sum())
    p[1:-1] *= 2
    f = np.fft.rfftfreq(max(nfft, seg), 1 / rate)
    ok = (f > pulse_rates[0]) & (f < pulse_rates[1])
    return float(p[ok].max()) if ok.any() else 0.0


def ribbit_scores(x: np.ndarray, rate: float, band: tuple[float, float], pulse_rates: tuple[float, float], clip_duration: float, window: int = 512, noise_bands: tuple = ()) -> list[tuple[float, float, float]]:
    """(start, end, score) per clip: pulse score of the band's level over the recording's frames."""
    p = power_spectrogram(x, window)
    f = np.fft.rfftfreq(window, 1 / rate)
    level = lambda b: np.sqrt(p[(f >= b[0]) & (f <= b[1])].sum(axis=0))
    amp = level(band) / (band[1] - band[0])
    if noise_bands:
        amp = np.maximum(amp - sum(level(b) for b in noise_bands) / sum(b[1] - b[0] for b in noise_bands), 0)
    frame_rate = rate / (window // 2)
    out, total = [], len(x) / rate
    for i in range(int(np.ceil(total / clip_duration))):
        a, b = i * clip_duration, min((i + 1) * clip_duration, total)
        part = amp[int(a * frame_rate) : int(b * frame_rate)]
        part = np.pad(part, (0, max(0, int(clip_duration * frame_rate) - len(part))))
        out.append((a, b, pulse_score(part, frame_rate, pulse_rates) if len(part) else 0.0))
    return out


def cwt_peaks(x: np.ndarray, rate: float, frequency: float, threshold: float = 0.2, separation: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Times and heights of peaks of the envelope of a single-scale Morlet transform."""
    scale = frequency_to_scale(frequency, rate)
    t = np.arange(-int(8 * scale), int(8 * scale) + 1) / scale
    w = np.exp(-(t**2) / 2) * np.cos(5 * t) / np.sqrt(scale)
    y = np.convolve(x, w[::-1], "same")[: len(x)]
    top = np.abs(y).max() if len(y) else 0
    if top == 0:
        return np.array([]), np.array([])
    y = (y / top) ** 2
    f = np.fft.fft(y)
    h = np.zeros(len(y))
    h[0] = 1
    h[1 : (len(y) + 1) // 2] = 2
    if len(y) % 2 == 0:
        h[len(y) // 2] = 1
    env = np.abs(np.fft.ifft(f * h))
    env /= env.max()
    at = np.flatnonzero((env[1:-1] > env[:-2]) & (env[1:-1] >= env[2:]) & (env[1:-1] >= threshold)) + 1
    if separation:
        kept: list[int] = []
        for i in at[np.argsort(-env[at], kind="stable")]:
            if all(abs(i - k) >= separation * rate for k in kept):
                kept.append(i)
        at = np.sort(np.array(kept, dtype=int))
    return at / rate, env[at]


def accel_sequences(t: np.ndarray, dt=(0.05, 0.8), dy=(-0.2, 0.0), d2y=(-0.05, 0.15), max_skip: int = 3, duration=(1.0, 15.0), points=(5, 100)) -> list[np.ndarray]:
    """Sequences of times that come ever faster.

    Every time but the last has a gap, the one to the time after it.  A time
    belongs to the running sequence when its distance from the last one
    accepted, the change of its gap against that one's gap, and the change of
    this change all lie in range.  Times that don't belong are passed over;
    more than ``max_skip`` of them in a row, or a distance out of range, end
    the sequence.  Kept are sequences with enough points and duration.
    """
    inside = lambda v, r: r[0] <= v <= r[1]
    found: list[np.ndarray] = []
    run: list[float] = []
    mark: tuple[float, float, float | None] | None = None  # time, gap and its change where we stand
    place = 0

    def close() -> None:
        if len(run) > 1 and inside(len(run), points) and inside(run[-1] - run[0], duration):
            found.append(np.array(run))

    for i, (now, gap) in enumerate(zip(t[:-1], np.diff(t), strict=True)):
        if mark is not None:
            change = gap - mark[1]
            if inside(now - mark[0], dt) and inside(change, dy) and (mark[2] is None or inside(change - mark[2], d2y)):
                run.append(now)
                mark, place = (now, gap, change), i
                continue
        if not run:
            mark = (now, gap, None)
        elif i - place > max_skip or not inside(now - mark[0], dt):
            close()
            run = []
    close()
    return found


def peak_sequences(x: np.ndarray, rate: float, new_rate: float = 400.0, window_s: float = 60.0, frequency: float = 50.0, threshold: float = 0.2, separation: float | None = 15 / 400, **ranges) -> list[tuple]:
    """Accelerating sequences of wavelet peaks per whole window: (window start, points, first, last, midpoint, times); what is left at the end is dropped."""
    y = resample(x, rate, new_rate) if rate != new_rate else x
    n = int(window_s * new_rate)
    out = []
    for w in range(len(y) // n):
        at, _ = cwt_peaks(y[w * n : (w + 1) * n], new_rate, frequency, threshold, separation)
        for q in accel_sequences(at, **({"points": (9, 100)} | ranges)):
            out.append((w * window_s, len(q), float(q[0]), float(q[-1]), float((q[0] + q[-1]) / 2), q.tolist()))
    return out


def frequency_to_scale(frequency: float, rate: float, centre: float = MORLET_CENTRE) -> float:
    """Scale of a wavelet at which its centre lies at a frequency."""
    return centre * rate / frequency


def per_array(kernel: Callable[[np.ndarray], object], returns: str = "array<double>"):
    """Pandas UDF that runs a kernel on every sample array; null gives null."""

    @pandas_udf(returns)
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else kernel(np.asarray(v, dtype=np.float64)))

    return run
