"""Spectrograms as columns: power by frequency row and frame, array<array<double>>, with the bins' frequencies and frame times known to the caller."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nearest_bin(values: list[float], bound: float) -> int:
    """Index of the bin nearest to a bound; of two equally near the lower."""
    return min(range(len(values)), key=lambda i: (abs(values[i] - bound), i))


def bandpass(power: Column, frequencies: list[float], low: float, high: float) -> tuple[Column, list[float]]:
    """Rows between the bins nearest to both bounds, these included, and their frequencies."""
    if high <= low:
        raise ValueError("the band's upper edge must lie above its lower one")
    a, b = nearest_bin(frequencies, low), nearest_bin(frequencies, high)
    return F.slice(power, a + 1, b - a + 1), frequencies[a : b + 1]


def trim(power: Column, times: list[float], start: float, end: float) -> tuple[Column, list[float]]:
    """Frames between those nearest to both times, these included, and their times."""
    if end <= start:
        raise ValueError("the end must lie after the start")
    a, b = nearest_bin(times, start), nearest_bin(times, end)
    return F.transform(power, lambda row: F.slice(row, a + 1, b - a + 1)), times[a : b + 1]


def cells(power: Column, f) -> Column:
    """A function of every cell."""
    return F.transform(power, lambda row: F.transform(row, f))


def decibels(power: Column) -> Column:
    return cells(power, lambda v: F.lit(10.0) * F.log10(v + F.lit(1e-10)))


def magnitude(power: Column) -> Column:
    return cells(power, F.sqrt)


def limit_range(values: Column, low: float = -100.0, high: float = -20.0) -> Column:
    return cells(values, lambda v: F.least(F.greatest(v, F.lit(float(low))), F.lit(float(high))))


def min_max_scale(values: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """From the least and greatest cell to ``low`` and ``high``; a flat spectrogram gives null cells."""
    flat = F.flatten(values)
    least, span = F.array_min(flat), F.array_max(flat) - F.array_min(flat)
    return cells(values, lambda v: F.when(span > 0, (v - least) / span * F.lit(high - low) + F.lit(low)))


def linear_scale(values: Column, in_range: tuple[float, float] = (-100.0, -20.0), out_range: tuple[float, float] = (0.0, 1.0)) -> Column:
    return cells(values, lambda v: (v - in_range[0]) / (in_range[1] - in_range[0]) * (out_range[1] - out_range[0]) + out_range[0])


def frame_rms(power: Column, window: int, even: bool = True) -> Column:
    """Level per frame of a one-sided spectrogram: outer rows count half."""
    n = F.size(power)
    weight = lambda i: F.when((i == 0) | (F.lit(even) & (i == n - 1)), 0.5).otherwise(1.0)
    weighed = F.transform(power, lambda row, i: F.transform(row, lambda v: v * weight(i)))
    summed = F.aggregate(weighed, F.transform(F.element_at(power, 1), lambda _: F.lit(0.0)), lambda s, row: F.zip_with(s, row, lambda a, b: a + b))
    return F.transform(summed, lambda v: F.sqrt(v * 2.0 / window))


def net_amplitude(power: Column, frequencies: list[float], band: tuple[float, float], reject: list[tuple[float, float]] | None, window: int, even: bool = True) -> Column:
    """Level of a band per hertz less that of the reject bands per hertz of all of them; not below 0 where there are reject bands."""

    def level(b: tuple[float, float]) -> Column:
        return frame_rms(bandpass(power, frequencies, *b)[0], window, even)

    signal = F.transform(level(band), lambda v: v / F.lit(float(band[1] - band[0])))
    if not reject:
        return signal
    width = float(sum(b[1] - b[0] for b in reject))
    noise = level(reject[0])
    for b in reject[1:]:
        noise = F.zip_with(noise, level(b), lambda u, v: u + v)
    return F.zip_with(signal, noise, lambda s, n: F.greatest(s - n / F.lit(width), F.lit(0.0)))


def shape_of(power: Column) -> tuple[Column, Column]:
    """(frequency rows, frames)."""
    return F.size(power), F.size(F.element_at(power, 1))


def duration(frames: Column | int, window_s: float, hop_s: float) -> Column:
    """Seconds from the first frame's begin to the last one's end."""
    n = F.lit(frames) if isinstance(frames, int) else frames
    return (n - 1) * F.lit(hop_s) + F.lit(window_s)


def window_start_times(times: list[float], window_s: float) -> list[float]:
    return [t - window_s / 2 for t in times]


def to_image(power: Column, low: float = -80.0, high: float = 0.0, invert: bool = False, db: bool = True) -> Column:
    """Cells from 0 to 1 with the highest frequency on top."""
    v = limit_range(decibels(power) if db else power, low, high)
    scaled = cells(v, lambda x: (x - F.lit(low)) / F.lit(high - low))
    return F.reverse(cells(scaled, lambda x: 1.0 - x) if invert else scaled)


def mask_rows(power: Column, first: Column, n: Column, fill: Column | float = 0.0) -> Column:
    """Frequency mask: rows [first, first + n) filled."""
    value = F.lit(fill) if isinstance(fill, float) else fill
    return F.transform(power, lambda row, i: F.when((i >= first) & (i < first + n), F.transform(row, lambda _: value)).otherwise(row))


def mask_frames(power: Column, first: Column, n: Column, fill: Column | float = 0.0) -> Column:
    """Time mask: frames [first, first + n) filled."""
    value = F.lit(fill) if isinstance(fill, float) else fill
    return F.transform(power, lambda row: F.transform(row, lambda v, i: F.when((i >= first) & (i < first + n), value).otherwise(v)))
