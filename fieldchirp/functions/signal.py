"""Sample arrays as columns: everything that needs no transform stays an expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def silence(duration: float, sample_rate: int) -> Column:
    return F.array_repeat(F.lit(0.0), int(duration * sample_rate))


def trim_samples(x: Column, start: int | Column, end: int | Column | None = None) -> Column:
    """Samples [start, end); a negative start is 0, None and ends past the array mean its end, a negative end counts from it."""
    n = F.size(x)
    s = F.greatest(F.lit(start) if isinstance(start, int) else start, F.lit(0))
    e = n if end is None else (F.lit(end) if isinstance(end, int) else end)
    e = F.least(F.when(e < 0, n + e).otherwise(e), n)
    return F.slice(x, s + 1, F.greatest(e - s, F.lit(0)))


def trim(x: Column, start_s: float, end_s: float | None, sample_rate: int) -> Column:
    return trim_samples(x, int(start_s * sample_rate), None if end_s is None else int(end_s * sample_rate))


def loop_to(x: Column, n: int) -> Column:
    """Repeat the samples to length ``n``; an empty array stays empty."""
    return F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at(x, (i % F.size(x)) + 1))).otherwise(x)


def extend_to(x: Column, n: int) -> Column:
    """Zeros at the end up to ``n`` samples; never shortens."""
    return F.concat(x, F.array_repeat(F.lit(0.0), F.greatest(F.lit(n) - F.size(x), F.lit(0))))


def pad(x: Column, before: int, after: int) -> Column:
    return F.concat(F.array_repeat(F.lit(0.0), before), x, F.array_repeat(F.lit(0.0), after))


def pad_to(x: Column, n: int) -> Column:
    """Zeros on both sides; of an odd number the larger half comes last."""
    more = F.greatest(F.lit(n) - F.size(x), F.lit(0))
    first = F.floor(more / 2).cast("int")
    return F.concat(F.array_repeat(F.lit(0.0), first), x, F.array_repeat(F.lit(0.0), more - first))


def clamp(x: Column, lo: float = -1.0, hi: float = 1.0) -> Column:
    return F.transform(x, lambda v: F.least(F.greatest(v, F.lit(lo)), F.lit(hi)))


def apply_gain(x: Column, db: float, lo: float = -1.0, hi: float = 1.0) -> Column:
    g = 10.0 ** (db / 20.0)
    return clamp(F.transform(x, lambda v: v * F.lit(g)), lo, hi)


def normalize(x: Column, peak: float = 1.0) -> Column:
    """Scale to the peak level; silence stays as it is."""
    top = F.greatest(F.array_max(x), -F.array_min(x))
    return F.when(top > 0, F.transform(x, lambda v: v / top * F.lit(peak))).otherwise(x)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double"))


def rms(x: Column) -> Column:
    return F.when(F.size(x) > 0, F.sqrt(total(F.transform(x, lambda v: v.cast("double") * v.cast("double"))) / F.size(x)))


def dbfs(x: Column) -> Column:
    return F.lit(20.0) * F.log10(rms(x) * F.sqrt(F.lit(2.0)))


def clipped_count(x: Column, threshold: float = 0.6) -> Column:
    return F.size(F.filter(x, lambda v: v > threshold))


def mix(a: Column, b: Column, gain_db: float = -3.0) -> Column:
    """Sum of two tracks after gain, as long as the longer one, clipped."""
    g = F.lit(10.0 ** (gain_db / 20.0))
    return clamp(F.zip_with(a, b, lambda u, v: F.coalesce(u, F.lit(0.0)) * g + F.coalesce(v, F.lit(0.0)) * g))


def concat(*tracks: Column) -> Column:
    """Tracks of one rate after each other; a null track makes the whole null."""
    return F.concat(*tracks)


def mix_tracks(tracks: list[Column], n: Column | int | None = None, gains: list[float] | float = -3.0, offsets: list[int] | None = None, lo: float = -1.0, hi: float = 1.0) -> Column:
    """Sum of tracks after gain, each delayed by its offset (samples), cut or filled to ``n`` samples (the longest by default), clipped."""
    gains = gains if isinstance(gains, list) else [gains] * len(tracks)
    gained = lambda t, g: F.transform(t, lambda v: v * F.lit(10.0 ** (g / 20.0)))
    placed = [F.concat(F.array_repeat(F.lit(0.0), o), gained(t, g)) for t, g, o in zip(tracks, gains, offsets or [0] * len(tracks), strict=True)]
    total_ = placed[0]
    for p in placed[1:]:
        total_ = F.zip_with(total_, p, lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))
    if n is not None:
        m = F.lit(n) if isinstance(n, int) else n
        total_ = F.slice(F.concat(total_, F.array_repeat(F.lit(0.0), F.greatest(m - F.size(total_), F.lit(0)))), F.lit(1), m)
    return clamp(total_, lo, hi)


def duration(x: Column, rate: Column | int) -> Column:
    return F.size(x) / (F.lit(rate) if isinstance(rate, int) else rate)


def trim_with_timestamps(x: Column, rate: int, recorded_at: Column, start: Column, end: Column | None = None, seconds: float | None = None) -> Column:
    """Samples between two instants; give the end or the seconds after the start.  Instants before the recording count as its begin; null without ``recorded_at``."""
    if (end is None) == (seconds is None):
        raise ValueError("give the end or the duration")
    since = lambda c: (F.unix_micros(c.cast("timestamp")) - F.unix_micros(recorded_at.cast("timestamp"))) / 1e6
    a = since(start)
    b = since(end) if end is not None else a + F.lit(seconds)
    cut = lambda c: F.greatest(F.floor(c * rate), F.lit(0)).cast("int")
    return F.when(a.isNotNull(), trim_samples(x, cut(a), cut(b)))


def to_mono(channels: Column) -> Column:
    """Mean over an array of equally long channels."""
    first = F.element_at(channels, 1)
    summed = F.aggregate(channels, F.transform(first, lambda _: F.lit(0.0)), lambda s, c: F.zip_with(s, c, lambda u, v: u + v))
    return F.transform(summed, lambda v: v / F.size(channels))


def change_speed(x: Column, factor: float) -> Column:
    """Samples at another rate (the rate is the caller's to scale); a negative factor plays backwards."""
    return F.reverse(x) if factor < 0 else x


def event_runs(x: Column, threshold: float) -> Column:
    """Runs of samples >= threshold as array<struct<start, length>>; NaN and null never reach it."""
    on = F.transform(x, lambda v: F.coalesce((v >= threshold) & ~F.isnan(v), F.lit(False)))
    at = F.filter(F.transform(on, lambda v, i: F.when(v, i)), lambda i: i.isNotNull())
    starts = F.filter(at, lambda i: ~F.array_contains(at, i - 1))
    ends = F.filter(at, lambda i: ~F.array_contains(at, i + 1))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e - s + 1).alias("length")))


def min_max_scale(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    a, b = F.array_min(x), F.array_max(x)
    return F.transform(x, lambda v: (v - a) / (b - a) * F.lit(hi - lo) + F.lit(lo))


def linear_scale(v: Column, in_range: tuple[float, float] = (0.0, 1.0), out_range: tuple[float, float] = (0.0, 255.0)) -> Column:
    return (v - in_range[0]) / (in_range[1] - in_range[0]) * (out_range[1] - out_range[0]) + out_range[0]


def to_db(v: Column, power: int = 2, eps: float = 1e-10) -> Column:
    return F.lit(10.0 if power == 2 else 20.0) * F.log10(F.greatest(v, F.lit(eps)))


def dft_bins(x: Column, n: int, bins: int) -> Column:
    """Magnitudes of the first ``bins`` Fourier bins of ``n`` samples, scaled 2/n, DC and Nyquist halved."""
    import math

    def part(f, k: int) -> Column:
        table = F.array(*[F.lit(f(2 * math.pi * k * i / n)) for i in range(n)])
        return total(F.zip_with(x, table, lambda v, t: v.cast("double") * t))

    out = []
    for k in range(bins):
        mag = F.sqrt(F.pow(part(math.cos, k), F.lit(2.0)) + F.pow(part(math.sin, k), F.lit(2.0))) * (2.0 / n)
        out.append(mag / 2 if k == 0 or 2 * k == n else mag)
    return F.array(*out)


def inrange(v: Column, lo: float, hi: float) -> Column:
    return v.between(lo, hi)


def binarize(v: Column, threshold: float) -> Column:
    """1 above the threshold, 0 at it and below; null stays null."""
    return (v > threshold).cast("int")


class Track:
    """A column of samples with its rate, with the usual operators: + joins or adds decibels, - takes them away, * mixes or scales, ** repeats, [a:b] cuts by seconds."""

    def __init__(self, samples: Column, rate: int) -> None:
        self.samples, self.rate = samples, rate

    def _same(self, other: Track) -> None:
        if other.rate != self.rate:
            raise ValueError("tracks of different rates")

    def __add__(self, other: Track | float) -> Track:
        if isinstance(other, Track):
            self._same(other)
            return Track(concat(self.samples, other.samples), self.rate)
        return Track(apply_gain(self.samples, other), self.rate)

    def __sub__(self, db: float) -> Track:
        return Track(apply_gain(self.samples, -db), self.rate)

    def __mul__(self, other: Track | float) -> Track:
        if isinstance(other, Track):
            self._same(other)
            return Track(mix_tracks([self.samples, other.samples]), self.rate)
        return Track(F.transform(self.samples, lambda v: v * F.lit(float(other))), self.rate)

    def __pow__(self, n: int) -> Track:
        return Track(F.flatten(F.array_repeat(self.samples, n)), self.rate)

    def __getitem__(self, s: slice) -> Track:
        at = lambda v: None if v is None else int(v * self.rate)
        a, n = at(s.start) or 0, F.size(self.samples)
        return Track(trim_samples(self.samples, F.greatest(n + a, F.lit(0)) if a < 0 else a, at(s.stop)), self.rate)
